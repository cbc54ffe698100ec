"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block elements and their first class names. Per path, text
length and punctuation of its blocks are divided by their number. Both ratios are laid out in the order of the blocks,
smoothed with a Gaussian kernel and multiplied; a path whose blocks' mean product reaches `share` of the standard
deviation over all blocks is selected, and its blocks are content nodes. The main text is what the smallest element around
the content nodes holds, in page order, its headings, captions and other short blocks too.

What ratios can't tell apart is settled by names. Text of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments may read like an article's: an element that says so by its tag, role, or a class or id made of such words
alone, is passed over, unless it holds most of the page's text. Where article or main elements hold half of the content
nodes' text, the outermost of them that hold any take the place of the smallest element. A paragraph, list item or other block
of text gives way to what it stands in. A parent of the smallest element
whose other blocks are all headings takes its place too.

Defined cases: null and empty html give an empty text; unclosed and misplaced tags are repaired as far as paths need it,
quotes open only after an equals sign; a tag, comment or script that never ends runs to the end of the page; text without
tags is one block; unknown character references stay as they are; repeated rows give repeated results; an empty table gives
an empty table; extra columns of any name are kept, but one that has the name of the result gives way to it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

_REST = r"""((?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?|[^=>])*+)"""
#: Comments, declarations, elements with raw text, and tags.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)(?=[\s/>]){_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*){_REST}(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = frozenset(("article", "main"))
#: Elements that are a block of text, not a region.
LEAVES = HEADINGS | frozenset("p li dt dd td th tr pre figcaption caption".split())
#: Elements and roles of what isn't main text.
ASIDE = frozenset("head nav header footer aside form button select option fieldset object canvas audio video dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Words of class names and ids that say the same, and words that add nothing beside them. A name counts if it is made of both
#: alone: cookie-notice and site-nav do, share-note, related-work and no-sidebar don't.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion sidebar comment comments reply replies disqus notice notices cookie cookies consent gdpr banner newsletter subscribe share sharing social related menu nav navbar navigation breadcrumb breadcrumbs header footer popup modal login signup".split()
)
PLAIN_WORDS = frozenset("area article bar block bottom box buttons column container form group inner item items left links list main outer page panel post posts reader right section site slot text thread top unit user widget wrap wrapper".split())
#: What an opening tag closes, and where that stops.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
PUNCTUATION = re.compile(r"[.,;:!?\"'()…。、！？；：¿¡«»„“”]")
#: Weights of the block before, the block itself and the block after.
KERNEL = np.exp(-np.array([1.0, 0.0, 1.0]) / 2) / (1 + 2 * np.exp(-0.5))


def told_aside(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element's tag, role or names say that it isn't main text."""
    if tag in ASIDE or attributes.get("role", "").lower() in ASIDE_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
        if any(p in ASIDE_WORDS for p in parts) and all(p in ASIDE_WORDS or p in PLAIN_WORDS for p in parts):
            return True
    return False


class _Element:
    __slots__ = ("aside", "inline", "order", "parent", "path", "size", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: _Element | None, order: int, paths: dict[tuple[int, str], int]) -> None:
        self.tag, self.parent, self.order, self.size = tag, parent, order, 0
        self.inline = tag in INLINE
        own = attributes.get("class", "").lower().split()
        name = f"{tag}.{own[0]}" if own else tag
        # A path's number: of its parent's number and its last name.
        self.path = 0 if parent is None else parent.path if self.inline else paths.setdefault((parent.path, name), len(paths) + 1)
        self.aside = parent is not None and told_aside(tag, attributes)

    def up(self) -> Iterator[_Element]:
        at: _Element | None = self
        while at is not None:
            yield at
            at = at.parent


def blocks(page: str) -> list[tuple[_Element, str]]:
    """The element and text of every block, in page order."""
    paths: dict[tuple[int, str], int] = {}
    here = _Element("", {}, None, 0, paths)
    out: list[tuple[_Element, str]] = []
    text: list[str] = []
    last, order = 0, 0

    def flush() -> None:
        if text:
            if said := " ".join(html.unescape("".join(text)).split()):
                out.append((next(e for e in here.up() if not e.inline), said))
            text.clear()

    for m in TOKEN.finditer(page):
        if m.start() > last:
            text.append(page[last : m.start()])
        last = m.end()
        tag = m[4].lower() if m[4] else ""
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[3]:
            at = here
            while at.parent is not None and at.tag != tag:
                if at.tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "body", "html", "article", "main", "div"):
                    break
                at = at.parent
            if at.parent is not None and at.tag == tag:
                here = at.parent
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends, stops = CLOSES.get(tag, ({"p"}, {"td", "th", "div", "article", "section", "main", "li", "blockquote"}))
            at, found = here, None
            while at.parent is not None and at.tag not in stops:
                if at.tag in ends or at.tag == "p":
                    found = at
                at = at.parent
            if found is not None:
                here = found.parent
        order += 1
        said = m[5]
        here = _Element(tag, {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(said)} if said and not said.isspace() else {}, here, order, paths)
    if last < len(page):
        text.append(page[last:])
    flush()
    return out


def path_scores(found: list[tuple[int, int, int]]) -> tuple[dict[int, float], float]:
    """From blocks' (path, length, punctuation): each path's fused ratio, and the standard deviation over the blocks."""
    sums: dict[int, list[int]] = {}
    for path, length, marks in found:
        own = sums.setdefault(path, [0, 0, 0])
        own[0], own[1], own[2] = own[0] + length, own[1] + marks, own[2] + 1
    ratios = np.array([[sums[p][0] / sums[p][2], 1 + sums[p][1] / sums[p][2]] for p, _, _ in found])
    smooth = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = KERNEL[0] * smooth[:-2] + KERNEL[1] * smooth[1:-1] + KERNEL[2] * smooth[2:]
    fused = smooth[:, 0] * smooth[:, 1]
    total: dict[int, float] = dict.fromkeys(sums, 0.0)
    for (path, _, _), f in zip(found, fused.tolist(), strict=True):
        total[path] += f
    return {p: total[p] / sums[p][2] for p in sums}, float(fused.std())


def main_text(page: str | None, share: float = 0.5) -> str:
    found = blocks(page or "")
    whole = 0
    for at, said in found:
        whole += len(said)
        for e in at.up():
            e.size += len(said)
    # An element that holds most of the page is no aside, whatever its class says; tags and roles don't err.
    passed: dict[int, bool] = {}

    def aside(e: _Element | None) -> bool:
        chain = []
        while e is not None and e.order not in passed:
            chain.append(e)
            e = e.parent
        told = e is not None and passed[e.order]
        for x in reversed(chain):
            told = told or (x.aside and (x.tag in ASIDE or 2 * x.size <= whole))
            passed[x.order] = told
        return told

    kept = [(at, said) for at, said in found if not aside(at)]
    if not kept:
        return ""
    scores, spread_of = path_scores([(at.path, len(said), len(PUNCTUATION.findall(said))) for at, said in kept])
    nodes = [(at, len(said)) for at, said in kept if scores[at.path] >= share * spread_of]
    regions = [[e.order for e in at.up() if e.tag in REGIONS][-1:] for at, _ in nodes]
    if regions and 2 * sum(n for (_, n), r in zip(nodes, regions, strict=True) if r) >= sum(n for _, n in nodes):
        roots = {o for r in regions for o in r}
    else:
        roots = {_around([at for at, _ in nodes], [at for at, _ in kept]).order}
    return "\n".join(said for at, said in kept if any(e.order in roots for e in at.up()))


def _around(nodes: list[_Element], every: list[_Element]) -> _Element:
    """The smallest element around all nodes, or its parent where that adds but headings."""
    root = nodes[0]
    above = {e.order for e in root.up()}
    for at in nodes[1:]:
        near = next(e for e in at.up() if e.order in above)
        if near is not root:
            root, above = near, {e.order for e in near.up()}
    while root.tag in LEAVES and root.parent is not None:
        root = root.parent
    while root.parent is not None:
        more = [list(at.up()) for at in every]
        if not all(any(e.tag in HEADINGS for e in up) for up in more if root.parent in up and root not in up):
            break
        root = root.parent
    return root


def extract(df: DataFrame, page: str = "html", into: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in keep) and the main text."""
    names = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{page}`").cast("string").alias("_page_to_read"))
    schema = rows.drop("_page_to_read").schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*names, into])

    return spread(rows).mapInArrow(run, schema)
