"""A corpus from raw documents in five stages, each of which is written as Parquet and read again.

STAGES: (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns
of documents; the last returns pieces with their places in sequences.

Defined cases: null and empty texts are kept by the first stage unless texts without words are mostly labelled toxic, are one
group of exact copies, are near copies of nothing, have size 0 in the mix, and are packed as one end token; repeated rows are
exact copies; rows without doc_id stay, unless their text is a copy; extra columns of any name go through all stages but
the last, which leaves them out; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import exact_dedup, minhash, mixing, packing, toxicity
from memloom.llm.common import cut, free, read
from memloom.llm.queries import tokenizer_path

#: Documents of this probability or more are toxic, as op2_toxicity has it, and go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity lies below TOXIC. All labels may be learnt from."""
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    names = free(docs, "toxicity"), free(docs, "evidence")
    scored = toxicity.score(docs, index, names=names)
    return scored.filter(F.col(names[0]) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard of 0.8 or more), the smallest doc_id."""
    gone = minhash.near_duplicates(docs, n=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 3, 1, 2 in turn, 150 % of all words, twice at most."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 tokens with sequence_id and offset."""
    return packing.best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Nearest neighbours, MinHash and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
