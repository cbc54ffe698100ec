"""The pipeline's stages on the small tables, each against what brute force says of its own input."""

import os
import re

import corpus_pipeline as P
from memloom.llm.common import cut, read
from tests.llm.test_llm import brute_components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, held = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, SF))
        held[name] = ({r.doc_id: r for r in before.collect()}, docs.collect())
        assert docs.columns == columns
    before, after = held["exact_dedup"]
    best = {}
    for r in before.values():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if key not in best or (-len(r.text or ""), r.doc_id) < best[key]:
            best[key] = (-len(r.text or ""), r.doc_id)
    assert {r.doc_id for r in after} == {i for _, i in best.values()}
    before, after = held["near_dedup"]
    roots = brute_components({i: r.text for i, r in before.items()}, 5)
    assert {r.doc_id for r in after} == {i for i, root in roots.items() if i == root}
    before, after = held["source_mixing"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = 1.5 * sum(map(size, before.values()))
    assert abs(sum(map(size, after)) - want) <= 0.1 * want
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in pieces) == len(after)
    full = {}
    for r in pieces:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 4096 and len(full) <= -(-sum(full.values()) // 4096) + 2
