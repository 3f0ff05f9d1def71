"""Main text of web pages by site style trees (operator 10).

The pages of a host are merged into one tree of styles: a branch is the way of structural elements (tag, classes, id)
from the root. For each branch, over the host's distinct pages that have it,

* content importance is the entropy of its texts, as a share of the most that many pages could have, and
* presentation importance is the same of the sequences of elements inside it.

A branch on one page only has importance 1 for both. Importance is the larger of the mean and content importance, and
is weighed by what the style itself says: an article or main element (``MAIN``), other branches (``PLAIN``, or ``BESIDE``
on a page whose article stands elsewhere), times ``MARKED`` for a word of navigation, adverts, comments and the like somewhere in a
class or id. Branches below ``LEAST`` are removed, so the host's pages decide: a banner that repeats goes even
from an article, and text of its own lifts a marked branch.

Without entropy it is decided what is no text wherever it stands and however much it varies from page to page (``NOISE``): navigation, header, footer,
aside, menu, dialog or hidden by tag, role or attribute; a form; and what a class or id calls reader comments, adverts, notices, menus or sidebars
and nothing else ("comments", "comment-list", "cookie-notice", but not "related-comments-study" or "no-ads"). html, body and the elements around an
article or main are not noise, unless what they hold are comments written as articles beside an article elsewhere; a form that holds all of a page's
text is its wrapper. An article or main inside other noise is an article. A main branch goes only if it repeats on ``FEW`` pages
at least, and not if no main text of the page would be left: such a page is a copy of others.

What is left is cut into blocks at block elements; character references are decoded, white space in a block becomes one
space, blocks are joined in page order by two line breaks. Scripts, styles, templates and comments are never text.
Null and empty pages give an empty text. Repeated rows and ids give equal results; null ids stay; a url without a host
counts as host "". Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import words as W
from quillon.llm.shared import spread_join, table

MAIN, PLAIN, BESIDE, MARKED, NOISE, LEAST = 1.0, 0.6, 0.45, 0.6, 0.1, 0.3
FEW = 3
# each alternative ends at the end of the page at the latest, so no place is looked at twice
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_DIGITS = re.compile(r"\d+")
_STRUCTURE = frozenset("html body div section article main aside nav header footer form ul ol dl table figure blockquote details dialog fieldset menu search center".split())
_BLOCK = _STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre hr figcaption caption address thead tbody tfoot summary legend hgroup optgroup option".split())
_RAW = frozenset("script style noscript template iframe object svg canvas textarea select button head title noframes audio video math".split())
_NOISE_TAGS = frozenset("nav header footer aside menu dialog search".split())
#: What an unclosed one of these swallows is no text; the others of _RAW only lose their tag then.
_ENDLESS = frozenset("script style textarea title noframes iframe".split())
#: Elements that a following block, or the next of their kind, ends.
_CLOSED_BY_NEXT = frozenset(["p", "li"])
_MAIN_TAGS = frozenset(["article", "main"])
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus discussion login "
    "search toolbar skip copyright widget pagination pager".split()
)
#: Words that say what is no text, words that go with them in a name, and names that say text.
_STRONG = frozenset(
    "comment comments disqus advert adverts advertisement advertisements ad ads adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup "
    "newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar".split()
)
_ALONG = frozenset(
    "list box section area wrapper wrap container block item items body thread banner bar form row col column inner outer content panel slot unit group holder zone region left "
    "right top bottom main page site global fixed sticky new first last message text title link links widget reader readers user users reply replies author meta".split()
)
_TEXT = frozenset("content post article entry story layout page main body".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _says_noise(names: list[str]) -> bool:
    """Whether some class or id is made of words for what is no text, and none is a plain word for text."""
    for name in names:
        parts = {w.lower() for w in _PARTS.findall(name)}
        if parts & _STRONG and parts <= _STRONG | _ALONG and not any(n.lower() in _TEXT for n in names):
            return True
    return False


def _style(name: str, tag: str) -> tuple[str, str, bool]:
    """A style's name in the tree, what it says (main, noise, form, told by a name to be noise, or nothing), and whether it is marked."""
    found = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(tag, len(name) + 1)} if len(tag) > len(name) + 2 else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    said = {w.lower() for n in names for w in _PARTS.findall(n)}
    role = found.get("role", "").lower()
    label = name + "".join(f".{c}" for c in sorted(found.get("class", "").split())) + (f"#{found['id']}" if found.get("id") else "")
    label = _DIGITS.sub("0", label)
    if name in ("html", "body"):
        return label, "", False
    if name in _NOISE_TAGS or role in _NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        kind = "noise"
    elif names and _says_noise(names):
        kind = "told"
    elif name == "form":
        kind = "form"
    elif name in _MAIN_TAGS or role in ("main", "article"):
        kind = "main"
    else:
        kind = ""
    return label, kind, bool(said & _NOISE_WORDS)


class Page:
    """Branches of a page: the way to each, what their styles say, their blocks of text and their inner elements."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str]] = []  # branch and text, in page order
        # elements: the one around, tag, style, what it says, whether marked
        elements: list[list] = [[0, "", "", "", False]]
        shapes: list[list[str]] = [[]]
        stack: list[tuple[str, int]] = [("", 0)]
        open_ = Counter()  # names on the stack
        unclosed: set[str] = set()  # names without another end
        text: list[str] = []

        def flush() -> None:
            if text:
                words = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if words:
                    self.blocks.append((stack[-1][1], words))

        at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                text.append(html[at : m.start()])
            at, tag = m.end(), m[0]
            if tag[1] in "!?":
                continue
            name = _NAME.match(tag)[1].lower()
            if tag[1] == "/":
                if name in _BLOCK:
                    flush()
                if name in _BLOCK and open_[name]:
                    closed = ""
                    while closed != name:
                        closed, _ = stack.pop()
                        open_[closed] -= 1
                continue
            if name in _BLOCK and stack[-1][0] in _CLOSED_BY_NEXT and (stack[-1][0] == "p" or stack[-1][0] == name):
                flush()
                open_[stack.pop()[0]] -= 1
            parent = stack[-1][1]
            if name in _RAW:
                if tag[-2:] != "/>":
                    end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    if end:
                        close = html.find(">", end.end())
                        at = len(html) if close < 0 else close + 1
                    else:
                        unclosed.add(name)
                        if name in _ENDLESS:
                            at = len(html)
                if name in ("button", "select", "textarea", "iframe"):
                    text.append(" ")
            elif name in _BLOCK:
                flush()
                shapes[parent].append(name)
                style = _style(name, tag) if name in _STRUCTURE or name in _CLOSED_BY_NEXT and len(tag) > len(name) + 2 else None
                # a paragraph or list item is a branch of its own only if its name tells what it is
                if style and (name in _STRUCTURE or style[1] == "told"):
                    elements.append([parent, name, *style])
                    shapes.append([])
                    stack.append((name, len(elements) - 1))
                    open_[name] += 1
            elif name == "br":
                text.append(" ")
        text.append(html[at:])
        flush()
        self._merge(elements, shapes)
        self.has_main = any(self.kinds[b] == "main" for b, _ in self.blocks)

    def _merge(self, elements: list[list], shapes: list[list[str]]) -> None:
        """Elements of one way become one branch."""
        told = [False] * len(elements)
        for i, (parent, _, _, kind, _) in enumerate(elements):
            told[i] = i > 0 and told[parent] or kind == "told"
        mains = [i for i, e in enumerate(elements) if e[3] == "main"]
        blocks = self.blocks
        # comments may be articles too, and a form or what is told to be noise may be a wrapper of all text
        for inside, forms in ((False, "noise"), (False, ""), (True, "noise"), (True, "")):
            own = [i for i in mains if inside or not told[i]]
            around = [False] * len(elements)
            for i in own:
                up = elements[i][0]
                while up and not around[up]:
                    around[up] = True
                    up = elements[up][0]
            of = self._ways(elements, shapes, around, forms, set(mains) - set(own))
            self.blocks = [(of[e], t) for e, t in blocks]
            if any(self.kinds[b] != "noise" for b, _ in self.blocks):
                return

    def _ways(self, elements: list[list], shapes: list[list[str]], around: list[bool], forms: str, none: set[int]) -> list[int]:
        self.ways, self.kinds, self.marked, self.shapes = [""], [""], [False], [list(shapes[0])]
        known, of = {"": 0}, [0]
        for i in range(1, len(elements)):
            parent, name, label, kind, mark = elements[i]
            kind = "noise" if i in none else {"told": "noise", "form": forms}.get(kind, kind)
            up = of[parent]
            inside = self.kinds[up]
            if around[i] and kind == "noise":
                kind = ""
            # a header of an article is its own heading; other noise inside it is noise
            if kind == "" or kind == "noise" and name == "header" and inside == "main":
                kind = inside if not (around[i] and inside == "noise") else ""
            mark = not around[i] and (mark or self.marked[up] and kind == inside)
            # a way is known by a hash, however deep it is
            way = f"{_hash(f'{self.ways[up]}/{label}!{kind}!{mark}'):x}"
            if way not in known:
                known[way] = len(self.ways)
                self.ways.append(way)
                self.kinds.append(kind)
                self.marked.append(mark)
                self.shapes.append([])
            of.append(known[way])
            self.shapes[known[way]] += shapes[i]
        return of

    def weight(self, branch: int) -> float:
        """What the style itself says."""
        kind = self.kinds[branch]
        if kind == "noise":
            return NOISE
        return (MAIN if kind == "main" else BESIDE if self.has_main else PLAIN) * (MARKED if self.marked[branch] else 1)

    def text(self, removed: frozenset[str] | set[str]) -> str:
        keep = [self.weight(i) >= LEAST and way not in removed for i, way in enumerate(self.ways)]
        if self.has_main and not any(keep[b] and self.kinds[b] == "main" for b, _ in self.blocks):
            keep = [k or kind == "main" for k, kind in zip(keep, self.kinds, strict=True)]
        return "\n\n".join(t for b, t in self.blocks if keep[b])


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each branch with text of its own: where, what its style says, and hashes of its texts and shape."""
    for whole in batches:
        for batch in W.slices(whole, "html", 8_000_000):
            rows: list[tuple] = []
            for page_id, url, html, key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "key")), strict=True):
                page, host = Page(html or ""), _host(url)
                texts: dict[int, list[str]] = {}
                for b, t in page.blocks:
                    texts.setdefault(b, []).append(t)
                rows += [(page_id, key, host, page.ways[b], page.weight(b), _hash("\n".join(t)), _hash(" ".join(page.shapes[b]))) for b, t in texts.items()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "key", "host", "way", "weight", "content", "shape"])


def _entropy(pages: DataFrame, by: str) -> DataFrame:
    """(host, way, n, share): the entropy of ``by`` over the pages of a branch, as a share of log n; two partial sums."""
    counts = pages.groupBy("host", "way", by).agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "way").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    share = F.when(F.col("n") > 1, 1 - F.col("clogc") / (F.col("n") * F.log("n"))).otherwise(1.0)
    return sums.select("host", "way", "n", share.alias(f"{by}_share"))


def site_styles(branches: DataFrame) -> DataFrame:
    """(host, way, n, importance before weighing) of each branch of each host's tree."""
    pages = branches.select("host", "way", "key", "content", "shape").distinct()
    return _entropy(pages, "content").join(_entropy(pages, "shape").drop("n"), ["host", "way"]).select(
        "host", "way", "n", ((F.col("content_share") + F.col("shape_share")) / 2).alias("mean"), "content_share"
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("key", F.xxhash64("html"))
    branches = table(pages.mapInArrow(_branches, "page_id long, key long, host string, way string, weight double, content long, shape long"), "branches")
    # texts that repeat on a host are little worth, and so is a shape that repeats; texts that don't repeat keep a branch
    worth = F.greatest("mean", "content_share")
    # only styles that some weight brings below LEAST; written, so that Spark knows how few they are
    styles = table(site_styles(branches).select("host", "way", "n", worth.alias("worth")).where(F.col("worth") * PLAIN * MARKED < LEAST), "styles")
    weighed = table(branches.where(f"weight >= {LEAST}"), "weighed")
    low = spread_join(weighed, styles, ["host", "way"]).where((F.col("weight") * F.col("worth") < LEAST) & ((F.col("weight") < MAIN) | (F.col("n") >= FEW)))
    # a page's own branches only
    low = table(low.groupBy("page_id", "key").agg(F.collect_set("way").alias("low")), "low")
    low = low.select(F.col("page_id").alias("of"), F.col("key").alias("page_key"), "low")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "html", 8_000_000):
                texts = [Page(h or "").text(frozenset(low or ())) for h, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # the table of removed branches is written, so Spark knows its size: small ones are broadcast, others are shuffled
    joined = pages.join(low, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("page_key")), "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
