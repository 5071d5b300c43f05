"""Operator 2, main-text extraction with a site style tree.

Each page is parsed to text blocks under element nodes (tag, class and id, from the root).  The pages of a host are
merged on these nodes: Spark counts the presentations (sequences of child tags) and contents of each node over the
host's pages, and from their entropies comes the importance of the node.  Branches of low importance are removed
from each page, besides those whose markup itself names them as navigation, advertising, comments and the like.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_side

#: A node is judged by its host's pages if it stands on this many; up to MANY_PAGES, few pages repeat by chance, and
#: it is noise only below the importance SURE.
MIN_PAGES = 3
MANY_PAGES = 8
SURE = 0.02
#: Importance below which a branch is noise, and the weight of content against presentation.
NOISE = 0.2
GAMMA = 0.9
#: Elements nested deeper are counted as parts of the one at this depth; their text is kept like any other.
DEPTH = 64
#: An ``article`` or ``main`` with less than this share of a page's text does not stand for the page.
MAIN_SHARE = 0.4
#: Marked node lists that may be broadcast: 8 MB of longs.
NOISY_NODES = 1_000_000

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea svg math iframe object canvas menu dialog audio video map noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An element that is open ends where one of these begins.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("table ul ol dl select html body".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark a branch as no part of the article.
MARKED = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies discussion disqus dropdown"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended recommendations related"
    " replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toast toolbar topbar widget widgets".split()
)

#: Words that make a class name tell of a state or of what else the page has, not of the branch itself.
STATES = frozenset("has have no not non with without is open opened closed enabled disabled on off allow allowed allows hide hidden show shown supports".split())

_NAME = r"[a-zA-Z][^\s/>]*"
TAG = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^>]*)>|<[!?/][^>]*(?:>|\Z)|<{_NAME}[^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=4096)
def _attributes(text: str) -> tuple[str, frozenset[str], bool, str]:
    """Presentation, marking words, whether hidden, and role of a tag's attributes."""
    values = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        values.setdefault(name.lower(), _html.unescape(a or b or c))
    shown = " ".join(values.get(k, "") for k in ("class", "id"))
    names = [WORDS.findall(n) for n in f"{shown} {values.get('role', '')}".lower().split()]
    words = frozenset(w for name in names if STATES.isdisjoint(name) for w in name)
    style = values.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in values or "display:none" in style or "visibility:hidden" in style or values.get("aria-hidden") == "true"
    return " ".join(WORDS.findall(shown.lower())), words, hidden, values.get("role", "").lower()


class _Node:
    __slots__ = ("children", "dropped", "main", "sign", "tag")

    def __init__(self, tag: str, sign: int, dropped: bool, main: bool):
        self.tag, self.sign, self.dropped, self.main, self.children = tag, sign, dropped, main, []


class Page:
    """The text blocks of a page: ``blocks`` holds (text, in main, signs of the nodes above); ``styles`` pairs (sign, style)."""

    def __init__(self, text: str):
        self.blocks: list[tuple[str, bool, tuple[int, ...]]] = []
        self.styles: set[tuple[int, int]] = set()
        self.stack = [_Node("", 0, False, False)]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []
        self._parse(text)

    def _flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held = []
            if text and not self.stack[-1].dropped:
                self.blocks.append((text, self.stack[-1].main, tuple(n.sign for n in self.stack[1 : DEPTH + 1])))

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        if not node.dropped and node.tag in BLOCKS:
            self.styles.add((node.sign, xxhash.xxh64_intdigest(" ".join(node.children)) >> 1))

    def _close(self, tag: str, through: frozenset[str] | set[str] = frozenset()) -> None:
        """End the innermost open ``tag`` (or one of ``through``), unless a scope stands between."""
        if not self.open[tag] and not any(self.open[t] for t in through):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag or name in through:
                if any(n.tag in BLOCKS for n in self.stack[k:]):
                    self._flush()
                while len(self.stack) > k:
                    self._pop()
                return
            if through and name in SCOPES:
                return

    def _open(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        if tag in BLOCKS:
            self._flush()
            self._close("p", {"p"})
            if tag in IMPLIED:
                self._close(tag, IMPLIED[tag])
            above = self.stack[-1]
            kids = above.children
            if not kids or kids[-1] != tag:
                kids.append(tag)
        shown, words, hidden, role = _attributes(attributes.strip()) if attributes.strip() else ("", frozenset(), False, "")
        exempt = tag in ("html", "body") or tag in MAIN and not words & {"comment", "comments", "reply", "related", "ad", "ads", "advert", "sponsored", "promo"}
        heading = above.main and tag in ("header", "hgroup") or above.main and not words & (MARKED - {"banner"}) and "header" in words
        marked = not exempt and (tag in DROPPED or bool(words & MARKED) or tag == "header" or bool(words & {"header"} and tag in BLOCKS)) and not heading
        main = above.main or tag in MAIN or role == "main"
        sign = xxhash.xxh64_intdigest(f"{above.sign} {tag} {shown}") >> 1 if len(self.stack) <= DEPTH else above.sign
        self.open[tag] += 1
        self.stack.append(_Node(tag, sign, above.dropped or marked or hidden, main))

    def _parse(self, text: str) -> None:
        at, size = 0, len(text)
        while at < size:
            found = TAG.search(text, at)
            if found is None:
                self._text(text[at:])
                break
            if found.start() > at:
                self._text(text[at : found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, ends, attributes = tag.lower(), found[1] or found[4], (found[3] or found[6] or "")
            if ends:
                if tag == "p" and not self.open["p"]:
                    self._flush()
                self._close(tag)
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
                    self._close("p", {"p"})
                elif tag == "br":
                    self.held.append(" ")
            else:
                self._open(tag, attributes)
                if attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
                    self._close(tag)
                elif tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                    if tag not in DROPPED:
                        self._text(text[at : end.start() if end else size])
                    at = end.end() if end else size
                    self._close(tag)
        while len(self.stack) > 1:
            self._flush()
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        if not self.stack[-1].dropped:
            self.held.append(_html.unescape(text) if "&" in text else text)


def main_text(page: Page, noise: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of the main part (of the whole page if it has none to speak of), without noisy branches, parted by blank lines.

    Where every block would be noise, as on hosts that repeat one article, none is removed.
    """
    main, size = [b for b in page.blocks if b[1]], lambda blocks: sum(len(b[0]) for b in blocks)
    own = main if size(main) >= MAIN_SHARE * size(page.blocks) else page.blocks
    clean = [b for b in own if noise.isdisjoint(b[2])] if noise else own
    return "\n\n".join(b[0] for b in clean or own)


def host_of(url):
    """The lower-case host of a URL column; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _features(batches):
    """host, sign, kind, value: kind 0 a page, 1 a presentation, 2 a content of the node; once for each page."""
    for batch in batches:
        out: list[tuple[str, int, int, int]] = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = Page(text.as_py() or "")
            contents = {(sign, xxhash.xxh64_intdigest(t) >> 1) for t, _, signs in page.blocks for sign in signs}
            out += [(host, s, 0, 0) for s in {s for s, _ in contents}]
            out += [(host, s, 1, v) for s, v in page.styles]
            out += [(host, s, 2, v) for s, v in contents]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int8(), pa.int64()), strict=True)], names=["host", "sign", "kind", "value"])


def node_importance(pages: DataFrame) -> DataFrame:
    """host, sign, pages and importance of the element nodes of each host's site style tree.  ``pages``: host, html.

    Content: 1 less the mean, over a node's distinct contents, of log_m(pages that have it), of m pages with the
    node.  Presentation: entropy to base m of the node's child sequences.  Importance mixes them by
    GAMMA ^ (number of presentations).
    """
    counted = pages.select("host", "html").mapInArrow(_features, "host string, sign long, kind byte, value long").groupBy("host", "sign", "kind", "value").agg(F.count("*").alias("c"))
    is_style, is_content = F.col("kind") == 1, F.col("kind") == 2
    log = F.ln(F.col("c").cast("double"))
    nodes = counted.groupBy("host", "sign").agg(
        F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.avg(F.when(is_content, log)).alias("repeat"),
        F.count(F.when(is_style, 1)).alias("styles"),
        F.sum(F.when(is_style, F.col("c"))).alias("shown"),
        F.sum(F.when(is_style, F.col("c") * log)).alias("clogc"),
    )
    nodes = nodes.where("pages > 1")
    base = F.ln(F.col("pages").cast("double"))
    content = 1 - F.col("repeat") / base
    shown = F.when(F.col("shown") > 0, (F.ln(F.col("shown").cast("double")) - F.col("clogc") / F.col("shown")) / base).otherwise(0.0)
    weight = F.pow(F.lit(GAMMA), F.greatest(F.col("styles"), F.lit(1)))
    return nodes.select("host", "sign", "pages", ((1 - weight) * F.least(shown, F.lit(1.0)) + weight * content).alias("importance"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's main text.

    ``pages`` has page_id, url and html.  A null html, or one without text, gives an empty text; pages with a null
    or odd url share one host; repeated rows give repeated rows; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of(F.col("url")).alias("host"))
    least = F.when(F.col("pages") < MANY_PAGES, SURE).otherwise(NOISE)
    noisy = node_importance(rows).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < least))
    noisy = noisy.groupBy(F.col("host").alias("_host")).agg(F.collect_set("sign").alias("noise"))  # at most the nodes on MIN_PAGES pages
    noisy = materialize(noisy, "noise")
    few = (noisy.agg(F.sum(F.size("noise"))).first()[0] or 0) <= NOISY_NODES
    joined = rows.join(small_side(noisy) if few else noisy, F.col("host") == F.col("_host"), "left")

    def run(batches):
        for batch in batches:
            noise = batch.column("noise").to_pylist()
            texts = [main_text(Page(t.as_py() or ""), frozenset(n or ())) for t, n in zip(batch.column("html"), noise, strict=True)]
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "noise").mapInArrow(run, "page_id long, url string, text string, n_chars long")
