"""Main text of web pages by consensus host paths.

First pass: every page scores its containers (article, main, section, div, td and
body) by the share of the page's running text they hold, links and boilerplate left
out, and votes with these scores for the containers' paths: tags and classes from
the body down, digits generalised. The votes of a host are summed in Spark, added
up per task first, and each host gets one winning path. Second pass: a page's text
is re-extracted from the containers on its host's winning path; a page without such
a container takes its own best one.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and
reader comments are left out by tag, role or class in either pass. White space
inside a block becomes one space, blocks are joined by one space in page order,
character references are decoded once; nothing else is dropped or cut.

Defined results: null html counts as empty and gives an empty text; null or
malformed urls form a host of their own; unclosed tags, comments and quotes are read
as a browser would; repeated rows are extracted once each; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisesift.llm.common import query, staged, table

BROADCAST_BYTES = 8 << 20

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head li dd dt option td th tr tbody thead tfoot legend summary".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CONTAINER = frozenset("article main section div td body".split())
JUNK_TAGS = frozenset("nav header footer aside form button select menu dialog template svg canvas object embed audio video map head".split()) | RAW
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond replies disqus share "
    "sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager "
    "skip login search form".split()
)
#: a name like has-sidebar or share-enabled tells of the layout around, not of the element
LAYOUT_WORDS = frozenset("has with without no enabled disabled".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SAFE = frozenset("html body article main".split())


def _junk(tag: str, attrs: dict[str, str]) -> bool:
    if tag in JUNK_TAGS:
        return True
    if not attrs or tag in SAFE:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "") in JUNK_ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"]):
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        if words & JUNK_WORDS and not words & LAYOUT_WORDS:
            return True
    return False


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """Blocks of running text of a page, each with the container that holds it."""

    def __init__(self, source: str):
        self.paths, self.parents = ["body"], [-1]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        pieces: list[str] = []
        linked = 0
        # open elements: tag, container, junk, in a link
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        at, n = 0, len(source)

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((stack[-1][1], text, linked))
                pieces.clear()
            linked = 0

        def put(raw: str):
            nonlocal linked
            if raw and not stack[-1][2]:
                text = entities.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                if stack[-1][3]:
                    linked += len(text)

        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                put(source[at:])
                break
            put(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                if tag == "br":
                    flush()
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                if depth and tag not in ("html", "body"):
                    if any(s[0] in BLOCK for s in stack[depth:]):
                        flush()
                    del stack[depth:]
                continue
            rest = m[3] if m[2] else m[6]
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)} if rest.strip(" /") else {}
            if tag in BLOCK:
                flush()
            if tag in CLOSES_P:
                self._close(stack, ("p",), ("td", "th", "button", "table"))
            if tag in CLOSES:
                self._close(stack, CLOSES[tag], SCOPE[tag])
            if tag in VOID:
                continue
            _, held, junk, link = stack[-1]
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag == "body" or tag == "html":
                continue
            junk = junk or _junk(tag, attrs)
            if tag in CONTAINER and not junk:
                self.paths.append(f"{self.paths[held]}>{_step(tag, attrs)}")
                self.parents.append(held)
                held = len(self.paths) - 1
            if rest.endswith("/") and tag not in BLOCK:
                continue
            stack.append((tag, held, junk, link or tag == "a"))
        flush()

    @staticmethod
    def _close(stack, tags, scope) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    def scores(self) -> list[float]:
        """A container's share of the page's running text, less where one container inside holds nearly all of it.

        An article or main element counts more and stays whole.
        """
        text = [0.0] * len(self.paths)
        for held, block, linked in self.blocks:
            text[held] += max(0, len(block) - 2 * linked)
        inner = [0.0] * len(text)
        for k in range(len(text) - 1, 0, -1):
            up = self.parents[k]
            text[up] += text[k]
            inner[up] = max(inner[up], text[k])
        whole = text[0]
        if not whole:
            return text
        out = []
        for k, t in enumerate(text):
            last = self.paths[k].rpartition(">")[2].partition(".")[0]
            bonus = {"article": 0.5, "main": 0.3}.get(last, 0.0)
            share = t / whole
            out.append(share * (1 + bonus if bonus else 0.5 if share < 0.5 or inner[k] > 0.8 * t else 1.0))
        return out

    def text(self, path: str | None) -> str:
        """Text of all containers on a path, or of the page's own best container."""
        chosen = {k for k, p in enumerate(self.paths) if p == path}
        if not chosen:
            scores = self.scores()
            chosen = {max(range(len(scores)), key=lambda k: (scores[k], -k))}
        inside = [False] * len(self.paths)
        for k in range(len(self.paths)):
            inside[k] = k in chosen or (k > 0 and inside[self.parents[k]])
        return " ".join(block for held, block, _ in self.blocks if inside[held])


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a host: the container path with most votes (ties: the smallest path)."""

    def run(batches):
        votes: dict[tuple[str, str], float] = defaultdict(float)
        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(source.as_py() or "")
                best: dict[str, float] = defaultdict(float)
                for path, score in zip(page.paths, page.scores(), strict=True):
                    best[path] += score
                for path, score in best.items():
                    if score > 0:
                        votes[host, path] += score
            if len(votes) > 20_000:
                yield _votes(votes)
                votes.clear()
        if votes:
            yield _votes(votes)

    counted = pages.select(host_of(url_col).alias("host"), html_col).mapInArrow(run, "host string, path string, votes double")
    summed = counted.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    top = summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "path")).alias("top"))
    return top.select("host", F.col("top.path").alias("path"))


def _votes(votes) -> pa.RecordBatch:
    hosts, paths = zip(*votes, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(votes.values()))], names=["host", "path", "votes"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text."""
    paths = staged(winning_paths(pages, url_col, html_col), "paths")
    size = paths.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    side = F.broadcast(paths) if size <= BROADCAST_BYTES else paths
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    rows = rows.join(side, "host", "left").select("page_id", "url", "path", "html")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [Page(s.as_py() or "").text(p) for p, s in zip(b.column(2).to_pylist(), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")


@query("op9_html_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
