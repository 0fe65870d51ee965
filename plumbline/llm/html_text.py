"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score positive and tags
negative, by log-odds counted on labelled pages: those that mark their content
with an ``article`` or ``main`` element. A linear scan finds the contiguous
region with the largest sum; boilerplate elements inside it are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|object|canvas|math|button)\b(?:>|[\s/](?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = {"article", "main"}
#: Elements that are never content; a header only outside content.
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: Parts of class and id names that mark boilerplate.
BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription share sharing social sidebar breadcrumb breadcrumbs menu nav navbar navigation footer masthead topbar "
    "comment comments commentlist disqus reply replies respond related recommended pagination pager login signup signin banner skip".split()
)
TAGS = BLOCKS | {"a", "b", "br", "em", "i", "img", "input", "label", "small", "span", "strong", "u"}
#: Weights where no page is labelled.
DEFAULTS = {"plain": 1.0, "link": -0.5, "boiler": -1.0, "inside": 1.0, "outside": -1.0}
#: Log-odds are cut at CAP, so a tag outweighs at most CAP words; no tag is lighter than LEAST.
LEAST, CAP = 0.01, 3.0


@dataclass
class Run:
    """Words between two tags, or a tag (``text`` is None)."""

    kind: str
    text: str | None = None
    words: int = 0
    content: bool = False
    boiler: bool = False
    breaks: bool = False


def _boiler(name: str, rest: str, in_content: bool, in_boiler: bool = False) -> str:
    """"hard" or "soft" for an element that is boilerplate, else empty.

    Forms and elements that only a part of their class or id speaks against are
    soft: what they hold may overrule it. Such a name alone never speaks against
    ``article`` and ``main``, only inside other boilerplate against an ``article``.
    """
    if name in ("body", "html") or name in CONTENT and not rest:
        return ""
    if name in BOILER and name != "form" and not (name == "header" and in_content):
        return "hard"
    soft = "soft" if name == "form" else ""
    if not rest.strip():
        return soft
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "hard"
        if key == "role" and value.lower() in BOILER_ROLES:
            return "hard"
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hard"
        named = name not in ("main", "a", "h1") and (name != "article" or in_boiler)
        if key in ("class", "id") and named and BOILER_NAMES & {p.lower() for p in PART.findall(value)}:
            soft = "soft"
    return soft


def _holders(page: str) -> set[int]:
    """Where soft boilerplate elements open that hold an h1 or most of the page's plain words."""
    opened: dict[str, list[tuple[str, int, int, int]]] = {}
    words = headings = hard = link = at = 0
    ended: list[tuple[int, int]] = []
    found = set()

    def end(kind: str, place: int, words_then: int, headings_then: int) -> None:
        if kind == "soft":
            ended.append((place, words - words_then))
            if headings > headings_then:
                found.add(place)

    for match in TOKEN.finditer(page):
        if not hard and not link:
            words += len(html.unescape(page[at : match.start()]).split())
        at = match.end()
        if not match["name"]:
            continue
        name = match["name"].lower()
        if match["close"]:
            if opened.get(name):
                last = opened[name].pop()
                hard -= last[0] == "hard" and hard > 0
                end(*last)
        elif name not in VOID:
            if name in CONTENT:
                hard = 0
            kind = _boiler(name, match["rest"], False)
            hard += kind == "hard"
            headings += name == "h1" and not hard
            opened.setdefault(name, []).append((kind, match.start(), words, headings))
        if name == "a":
            link = 0 if match["close"] else 1
        elif name in BLOCKS and name != "li":
            link = 0
    if not hard and not link:
        words += len(html.unescape(page[at:]).split())
    for left in opened.values():
        for one in left:
            end(*one)
    return found | {place for place, inside in ended if 2 * inside > words}


def runs(page: str) -> list[Run]:
    """Tags and word runs of a page, each with what surrounds it."""
    out, doubtful = _runs(page, frozenset())
    return _runs(page, _holders(page))[0] if doubtful else out


def _runs(page: str, holders: set[int] | frozenset[int]) -> tuple[list[Run], bool]:
    """``runs`` with ``holders`` not taken for boilerplate, and whether soft boilerplate may hold the text."""
    out: list[Run] = []
    content, link = 0, 0
    boiler: str | None = None  # name of the open boilerplate element, and how many of that name are open in it
    depth = 0
    soft = heading = False
    counted = {"plain": 0, "soft": 0}

    def judge(match: re.Match, name: str, inside: bool = False) -> str:
        kind = _boiler(name, match["rest"], content > 0, inside)
        return "" if kind == "soft" and match.start() in holders else kind

    def words(text: str) -> None:
        if not text or text.isspace():
            if text and out:
                out.append(Run("space", " "))
            return
        text = html.unescape(text)
        kind = "boiler" if boiler else "link" if link else "plain"
        out.append(Run(kind, text, len(text.split()), content > 0, boiler is not None))
        if kind != "link" and (soft or not boiler):
            counted["soft" if boiler else "plain"] += out[-1].words

    at = 0
    for match in TOKEN.finditer(page):
        words(page[at : match.start()])
        at = match.end()
        name = match["name"]
        if not name:
            continue
        name, closing = name.lower(), bool(match["close"])
        if not closing and name not in VOID:
            if boiler:
                depth += name == boiler
                if name in CONTENT and name != boiler:  # content never sits in an element that was left open before it
                    kind = judge(match, name, True)
                    boiler, depth, soft = (name, 1, kind == "soft") if kind else (None, 0, False)
            elif kind := judge(match, name):
                boiler, depth, soft = name, 1, kind == "soft"
            heading = heading or name == "h1" and boiler is not None and soft
        was_boiler = boiler is not None
        if closing and boiler == name:
            depth -= 1
            if not depth:
                boiler = None
        elif closing and boiler and name in CONTENT | {"body", "html"}:
            boiler, depth = None, 0
        if name in CONTENT and not was_boiler:
            content = max(0, content + (-1 if closing else 1))
        if name == "a":
            link = 0 if closing else 1
        elif name in BLOCKS and name != "li":
            link = 0
        out.append(Run(("/" if closing else "") + (name if name in TAGS else "other"), None, 0, content > 0, was_boiler, name in BLOCKS))
        if name == "br":
            out.append(Run("space", " "))
    words(page[at:])
    return out, heading or counted["soft"] > counted["plain"]


def _labelled(page: list[Run]) -> bool:
    return any(r.content and r.words for r in page)


def count(page: list[Run], into: Counter) -> None:
    """Add a labelled page's (kind, is content) counts."""
    if not _labelled(page):
        return
    for run in page:
        own = run.content and not run.boiler
        if run.text is None:
            into[run.kind, own] += 1
        elif run.words:
            into[run.kind, own] += run.words
            if not run.boiler:
                into["inside" if run.content else "outside", own] += run.words


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of content per kind: words at least slightly positive unless they mostly lie outside, tags always negative."""
    out = dict(DEFAULTS)
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 0.5) / (counts.get((kind, False), 0) + 0.5))
        odds = max(-CAP, min(CAP, odds))
        out[kind] = odds / CAP if kind in DEFAULTS else min(odds, -LEAST)
    out["plain"] = max(out["plain"], LEAST)
    return out


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest positive sum, the first such; empty if none."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """Blocks of the best region, each with single spaces, joined by an empty line."""
    if not page:
        return ""
    tokens = runs(page)
    marked = _labelled(tokens)
    scores = []
    for run in tokens:
        if marked and run.content:  # every kind of tag lies in marked content; boilerplate there is left out, not held against it
            scores.append(-LEAST if run.text is None else 0.0 if run.boiler else run.words * weight["inside"])
        elif run.text is None:
            scores.append(weight.get(run.kind, -LEAST))
        elif marked and not run.boiler:
            scores.append(run.words * weight["outside"])
        else:
            scores.append(run.words * weight.get(run.kind, 0.0))
    start, stop = region(scores)
    blocks, held = [], []
    for run in tokens[start:stop]:
        if run.text is not None:
            if not run.boiler:
                held.append(run.text)
        elif run.breaks:
            blocks.append(" ".join("".join(held).split()))
            held = []
    blocks.append(" ".join("".join(held).split()))
    return "\n\n".join(b for b in blocks if b)


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages; the kinds of tokens are a fixed list, so few rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "html"):
                for page in part.column("html").to_pylist():
                    if page:
                        count(runs(page), total)
        yield pa.RecordBatch.from_pydict(
            {"kind": [k for k, _ in total], "own": [o for _, o in total], "n": list(total.values())},
            schema=pa.schema([("kind", pa.string()), ("own", pa.bool_()), ("n", pa.int64())]),
        )

    with batches_of(pages.sparkSession, 1024):
        counted = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "kind string, own boolean, n long")
        rows = counted.groupBy("kind", "own").agg(F.sum("n").alias("n")).collect()
    return weights({(r["kind"], r["own"]): r["n"] for r in rows})


def extract(
    pages: DataFrame, weight: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    Null, empty and markup-only pages give an empty text; each row is read by
    itself, so repeated rows repeat and null ids stay. Unclosed elements end with
    the page, an unclosed boilerplate element at the next content element. A form,
    or an element named like boilerplate, is kept if it holds an h1 or most words. Other
    columns are not read. Weights are learnt from ``pages`` unless given.
    """
    weight = weight or learn(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, weight) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
