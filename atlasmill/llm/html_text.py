"""HTML extraction: the maximum-scoring subsequence of a page's words and tags.

A page becomes a sequence of tokens: words, which score positive, and tags, which score negative. What
a token scores comes from labelled pages: log odds of its kinds inside and outside the content, kinds
being the element that a word stands in, the elements of a purpose around it, and the class words
around it; a tag's kind is its name. Elements whose name announces another purpose (`nav`, `footer` and
the like) start from a negative weight, which the labelled pages may change; what class words mean is
learned alone. One linear scan finds the contiguous region with the largest sum. A second one, over the
region's scores with their signs turned, finds its maximal-scoring subsequences: the boxes inside it
(adverts, notices, hidden parts), with the words between their tags, whatever these score themselves.
The main text is the region without them. An `article` or `main` element is a label and no kind: pages
without one are read in the same way.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import per_text, text_or_empty

# Names of HTML elements by their part in a page.
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form ul ol dl table thead tbody tfoot tr blockquote figure fieldset details dialog menu select template noscript iframe object svg button".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre hr address figcaption legend summary option center".split())
HIDDEN = frozenset("select template noscript iframe object svg button".split())
RAW = frozenset("script style title textarea".split())
HEAD = frozenset("head meta link base".split()) | RAW
SEMANTIC = frozenset("nav footer aside header form menu dialog fieldset".split())
#: At most so many labelled pages, those of the smallest hashes, are counted for the weights.
LABELLED_PAGES = 4000
#: The weight of what announces another purpose, before labelled pages are seen, and the count at which they weigh as much.
PRIOR, PRIOR_COUNT = -4.0, 50
#: A word scores 1 and what its kinds weigh, from LOW to HIGH in all; a tag costs 1 less its kind's weight, within CHEAP and DEAR.
LOW, HIGH, CHEAP, DEAR = -4.0, 2.0, 0.1, 3.0

_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]|\Z")
_CLOSES = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def prior(kind: str) -> float:
    """A kind's weight before labelled pages are seen."""
    return PRIOR if kind[:1] == "#" and kind[1:] in SEMANTIC else 0.0


class Element:
    """A container; its own kinds are "#" and a name of purpose, and "." and each class word."""

    __slots__ = ("name", "parent", "hidden", "kinds", "content", "holds")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.holds = name, parent, False
        within = parent is not None and parent.content is not None
        self.hidden = name in HIDDEN or (parent is not None and parent.hidden)
        kinds, role = [], ""
        if name in SEMANTIC and not (name == "header" and within):
            kinds.append("#" + name)
        if "=" in attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                role = value if key.lower() == "role" else role
                if name not in ("html", "body", "article", "main"):
                    kinds += ["." + x for x in dict.fromkeys(value.split())]
        starts = (name in CONTENT or role == "main") and not within and not self.hidden
        self.kinds = tuple(kinds)
        self.content = self if starts else parent.content if parent is not None else None
        up = self if starts else None
        while up is not None and not up.holds:  # what holds a content element says nothing of other purpose
            up.holds, up.kinds, up = True, (), up.parent


def _tag_end(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """The place of the > that ends the tag whose attributes start at `at`, or -1; whether quotes still hide it in later tags."""
    start = at
    while quotes and (m := _QUOTE_OR_END.search(page, at)) is not None:
        if m[0] == ">":
            return m.start(), True
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    return page.find(">", start), False  # a quote that never closes: from here on quotes are plain characters


def tokens(page: str, elements: list[Element] | None = None) -> Iterator[tuple[str, str, Element, int]]:
    """(kind, text, element, block): kind is "<" and a tag's name or the element that a text stands in; a text is a run up to the next tag.

    `elements` takes the containers in page order. Every character is looked at a bounded number of times.
    """
    here = root = Element("html", None, "")
    elements = elements if elements is not None else []
    elements.append(root)
    inner, block, at, size, quotes = "", 0, 0, len(page), True
    opened: Counter[str] = Counter()
    text_from = 0
    while (lt := page.find("<", at)) >= 0:
        c = page[lt + 1 : lt + 2]
        closing = c == "/"
        head = page[lt + 2 : lt + 3] if closing else c
        if c in ("!", "?") and c:
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            if end < lt + 2:
                end = size if page.startswith("<!--", lt) else -1
            if end < 0:
                break
            if lt > text_from:
                yield inner or here.name, page[text_from:lt], here, block
            at = text_from = end + 1
            continue
        if not (head.isascii() and head.isalpha()):
            at = lt + 1
            continue
        name_from = lt + 1 + closing
        name_end = _NAME_END.search(page, name_from).start()
        end, quotes = _tag_end(page, name_end, quotes)
        if end < 0:
            break
        if lt > text_from:
            yield inner or here.name, page[text_from:lt], here, block
        name, attributes = page[name_from:name_end].lower(), page[name_end:end]
        at = text_from = end + 1
        if name in RAW and not closing:
            found = _CLOSES[name].search(page, at)
            close = page.find(">", found.end()) if found else -1
            at = text_from = close + 1 if close >= 0 else size
            yield "<" + name, "", here, block
            continue
        if name in BLOCKS:
            block, inner = block + 1, ""
        if name in CONTAINERS:
            if not closing and not attributes.endswith("/"):
                if name not in ("html", "body"):
                    here = Element(name, here, attributes)
                    elements.append(here)
                    opened[name] += 1
            elif closing and opened[name]:
                while here.name != name:
                    opened[here.name] -= 1
                    here = here.parent
                opened[name] -= 1
                here = here.parent
        elif name in BLOCKS:
            inner = "" if closing else name
        alone = name == "a" and inner in ("", "li", "a")  # a link within a paragraph is like the rest of it
        if alone:
            inner = "" if closing else "a"
        yield "<" + (name if name in BLOCKS or name in HEAD or name == "br" or alone else "inline"), "", here, block
    if text_from < size:
        yield inner or here.name, page[text_from:], here, block


def counted(page: str) -> tuple[Counter, Counter] | None:
    """Tokens by kind inside and outside of a labelled page's content; None if the page has no content element."""
    elements: list[Element] = []
    found = list(tokens(page, elements))
    if not any(e.content is not None for e in elements):
        return None
    inside, outside = Counter(), Counter()
    words: dict[int, list[int]] = {id(e): [0, 0] for e in elements}
    for kind, text, element, _ in found:
        n = len(text.split()) if text else 1
        if not element.hidden:
            (inside if element.content is not None else outside)[kind] += n
            if text:
                words[id(element)][element.content is None] += n
    for e in reversed(elements):  # children come before their parents
        n_in, n_out = words[id(e)]
        for kind in e.kinds:
            inside[kind] += n_in
            outside[kind] += n_out
        if e.parent is not None:
            up = words[id(e.parent)]
            up[0], up[1] = up[0] + n_in, up[1] + n_out
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log odds by kind, with pseudo-counts, drawn to the kind's prior where it was seen little."""
    n_in, n_out = (sum(n for k, n in c.items() if k[:1] not in ".#") + 1 for c in (inside, outside))
    out = {}
    for k in {*inside, *outside}:
        odds = math.log((inside[k] / n_in + 1e-4) / (outside[k] / n_out + 1e-4))
        n = inside[k] + outside[k]
        out[k] = (odds * n + prior(k) * PRIOR_COUNT) / (n + PRIOR_COUNT)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region with the largest sum; empty if no sum is above 0. One scan."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, region = total, (start, k + 1)
    return region


def maximal_regions(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal-scoring subsequences: disjoint regions of a positive sum, none of which grows by taking more on. One scan."""
    # start, end, sum of all scores before the start and up to the end, and the last region before whose sum before its start is less
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, left, right = k, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, k + 1, left, right, j))
    return [(a, b) for a, b, *_ in found]


def scored(page: str, weight: dict[str, float]) -> tuple[list[tuple[str, str, Element, int]], list[float]]:
    """The page's tokens and the score of each: a text's is that of a word times its words."""
    elements: list[Element] = []
    found = list(tokens(page, elements))
    around: dict[int, float] = {}
    for e in elements:  # parents come first
        own = sum(weight.get(k, prior(k)) for k in e.kinds)
        around[id(e)] = own + (around[id(e.parent)] if e.parent is not None else 0.0)
    scores = []
    for kind, text, element, _ in found:
        if not text:
            scores.append(-min(max(1.0 - weight.get(kind, 0.0), CHEAP), DEAR))
        else:
            word = LOW if element.hidden else 1.0 + min(max(weight.get(kind, 0.0) + around[id(element)], LOW), HIGH)
            scores.append(word * len(text.split()))
    return found, scores


def extract(page: str, weight: dict[str, float]) -> str:
    """The main text: its blocks in page order, joined by line feeds; empty if no region scores above 0."""
    found, scores = scored(page, weight)
    first, last = best_region(scores)
    inside = found[first:last]
    keep = [True] * len(inside)
    for a, b in maximal_regions([-x for x in scores[first:last]]):
        keep[a:b] = [False] * (b - a)
    blocks: dict[int, list[str]] = {}
    for (kind, text, _, block), stays in zip(inside, keep, strict=True):
        if kind == "<br" or (text and stays):
            blocks.setdefault(block, []).append(" " if kind == "<br" else text)
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def learn_weights(pages: DataFrame, id_col: str, html_col: str, most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `most` different pages with a content element, those of the smallest hashes of id and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                if got := counted(page):
                    inside.update(got[0])
                    outside.update(got[1])
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "inside": pa.array([inside[k] for k in kinds], pa.int64()), "outside": pa.array([outside[k] for k in kinds], pa.int64())})

    rows = pages.select(F.xxhash64(F.col(id_col), F.col(html_col)).alias("h"), text_or_empty(html_col).alias("html"))
    labelled = rows.filter(F.col("html").rlike(r"(?i)<(article|main)[\s/>]|role\s*=\s*[\"']?main"))
    smallest = labelled.select("h").distinct().orderBy("h").limit(most).agg(F.max("h").alias("h")).first().h
    if smallest is None:
        return {}
    chosen = labelled.filter(F.col("h") <= smallest).dropDuplicates(["h"])
    sums = chosen.select("html").mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights(Counter({r.kind: r.inside for r in sums}), Counter({r.kind: r.outside for r in sums}))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weight: dict[str, float] | None = None) -> DataFrame:
    """A row per page: id, url, text, n_chars (code points).

    The whole html is read; null html counts as empty and gives an empty text. Character references
    are decoded; white space inside a block becomes one space. Without `weight`, weights are counted
    on the pages themselves; where none has a content element, words score 1 and tags -1 but for names of another purpose. Repeated rows give repeated rows; an empty table gives an empty result;
    other columns are ignored.
    """
    learned = weight if weight is not None else learn_weights(pages, id_col, html_col)

    def work(texts: list[str]) -> list:
        out = [extract(t, learned) for t in texts]
        return [out, [len(t) for t in out]]

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("address"), F.col(html_col).alias("html"))
    made = per_text(rows, "html", ["id", "address"], lambda: work, "text string, n_chars long")
    return made.select(F.col("id").alias(id_col), F.col("address").alias(url_col), "text", "n_chars")
