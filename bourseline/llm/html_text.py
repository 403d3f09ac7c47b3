"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags.  Words score positive and tags
negative; words in links, menus, notices and the like score negative too.  The
weights come from labelled pages: pages that mark their content with an
``article`` or ``main`` element, a bounded sample of them (``sample_pages``).
One linear scan finds the contiguous region with the highest score; of equal
regions the first and shortest counts.  Parts of the region that are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments
or reader comments by their element, class, id or role are left out.

Character references are decoded, white space in a block becomes one space,
and blocks are joined by one line feed.  Null or empty html, and a page without
a word of content, give an empty text.  Unclosed elements end with the page.
Repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|button|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^"'<>]|"[^"]*"|'[^']*')*)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)[^<>]*>|<[!?][^>]*>|[^<]+|<""",
    re.S | re.I,
)

#: Elements that begin and end a block (fixed values).
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold content (fixed values).
SKIPPED = frozenset("aside dialog footer form head header menu nav".split())
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role that speak against content (fixed values).
SKIPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment|comments|commentlist|consent|contentinfo|cookie\w*|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|side-bar|signup|social|sponsor\w*|subscribe|subscription|toolbar|widget\w*)(?:$|[\s_-])",
    re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: Weights where there is no labelled page.
DEFAULT = {"word": 1.0, "word:marked": 1.0, "word:unmarked": -0.5, "word:link": -1.0, "word:skipped": -0.05, "tag:skipped": -0.05, "tag": -0.5}


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(class, text or tag name, marked) of each run of text and each tag; marked: inside article or main.

    Classes: word, word:link, word:skipped, tag, and tag:skipped for the tags of a left-out element.
    """
    skip: list[str] = []  # open elements from the outermost skipped one on
    links = marked = 0
    for m in _TOKEN.finditer(page):
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0][0] != "<" or len(m[0]) == 1:
                yield ("word:skipped" if skip else "word:link" if links else "word", m[0], marked > 0)
            continue
        end = m["end"] or m["end2"]
        left_out = bool(skip)
        if skip:
            if end:
                if name in skip:
                    while skip.pop() != name:
                        pass
                elif name in ("article", "main", "body", "html"):
                    skip.clear()
                    marked = max(0, marked - (name in ("article", "main")))
            elif name in ("article", "main"):  # content is not opened inside a menu: the menu was left open
                skip.clear()
                marked += 1
            elif name not in VOID and (name in SKIPPED or name in ("div", "section", "ul", "ol", "span", "p", "li")):
                skip.append(name)
        elif end:
            if name == "a":
                links = max(0, links - 1)
            elif name in ("article", "main"):
                marked = max(0, marked - 1)
        elif name not in VOID and (name in SKIPPED and not (name == "header" and marked) or m["attrs"] and any(SKIPPED_NAMES.search(x.strip("\"'")) for x in _NAMED.findall(m["attrs"]))) and name not in ("body", "html", "article", "main"):
            skip.append(name)
        elif name == "a":
            links += 1
        elif name in ("article", "main"):
            marked += 1
        elif name in BLOCKS:
            links = 0
        yield ("tag:skipped" if left_out or skip else "tag", name, marked > 0)


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest sum, (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found = list(tokens(page))
    has_mark = any(marked for kind, _, marked in found if kind == "word")
    scores = []
    for kind, value, marked in found:
        if kind == "tag":
            scores.append(weights.get(f"tag:{value}", weights["tag"]))
        elif kind == "tag:skipped":
            scores.append(weights[kind])
        else:
            if kind == "word" and has_mark:
                kind = "word:marked" if marked else "word:unmarked"
            elif kind == "word:link" and marked:
                kind = "word:marked"
            scores.append(weights[kind] * len(value.split()))
    a, b = region(scores)
    blocks, parts = [], []
    for kind, value, marked in [*found[a:b], ("tag", "p", True)]:
        if kind in ("tag", "tag:skipped"):
            if value in BLOCKS:
                line = " ".join(html.unescape("".join(parts)).split())
                if line:
                    blocks.append(line)
                parts = []
        elif kind != "word:skipped":
            parts.append(value)
    return "\n".join(blocks)


_LABELLED = r"(?i)<(?:article|main)\b"


def learn_weights(pages: DataFrame, sample_pages: int = 400) -> dict[str, float]:
    """Weights from at most ``sample_pages`` labelled pages: those whose page_id has the least hash."""
    labelled = pages.filter("html IS NOT NULL AND page_id IS NOT NULL").filter(F.rlike("html", F.lit(_LABELLED)))
    chosen = labelled.select("page_id", F.xxhash64("page_id").alias("order")).orderBy("order", "page_id").limit(sample_pages).select("page_id").distinct()
    rows = labelled.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for kind, value, marked in tokens(page):
                    key, n = (f"tag:{value}", 1) if kind == "tag" else (kind, 1 if kind == "tag:skipped" else len(value.split()))
                    (inside if marked else outside)[key] += n
        keys = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])

    counts = rows.mapInArrow(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights_from({r["key"]: (r["inside"], r["outside"]) for r in counts})


def weights_from(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of the classes, kept negative for tags, links and skipped words and positive for words."""
    if not any(a for a, _ in counts.values()) or not any(b for _, b in counts.values()):
        return dict(DEFAULT)
    odds = {k: math.log((a + 0.5) / (b + 0.5)) for k, (a, b) in counts.items()}
    weights = dict(DEFAULT)
    weights["word:marked"] = min(4.0, max(0.2, odds.get("word", 1.0)))
    weights["word:link"] = max(-4.0, min(-0.2, odds.get("word:link", -1.0)))
    for k in ("word:skipped", "tag:skipped"):  # left out in any case: what follows them may still belong to the region
        weights[k] = max(-0.1, min(-0.02, odds.get(k, -0.05)))
    weights |= {k: max(-3.0, min(-0.05, v)) for k, v in odds.items() if k.startswith("tag:") and k not in ("tag:article", "tag:main", "tag:skipped")}
    return weights


def extract_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
