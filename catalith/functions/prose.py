"""Untrusted prose cut into typed blocks, from which a summary and safe HTML are written.

A small state machine reads the lines once and yields blocks (paragraph,
heading, bullets, steps, quote, code).  Each block is written twice, as HTML and
as text; nothing that is written is parsed again.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that carry no prose.
BOILERPLATE = frozenset({"table of contents", "contents", "build status", "documentation"})
# Elements of HTML that end a block of text.
ENDS_BLOCK = frozenset({"p", "div", "li", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"})

#: Fields of a rendered text.
RENDERED = "summary_text string, summary_html string, body_html string, detected_format string, truncated boolean"

#: How a line opens a block of each kind; the group is the text that is kept.
_OPENERS = [("heading", re.compile(r"(#{1,6})\s+(.*)")), ("bullet", re.compile(r"[-*+]\s+(.*)")), ("step", re.compile(r"\d+[.)]\s+(.*)")), ("quote", re.compile(r">\s?(.*)"))]
_IMAGE_LINK = r"!?\[[^\]]*\]\([^)]*\)"
_BADGES = re.compile(rf"(?:\[{_IMAGE_LINK}\]\([^)]*\)|!{_IMAGE_LINK.lstrip('!?')}|\s)+")
#: Marks inside a line, as (pattern, HTML, text).
_MARKS = [
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>", r"\1"), (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>", r"\1"),
    (re.compile(r"(?<![*\w])\*([^*\n]+)\*(?!\w)"), r"<em>\1</em>", r"\1"), (re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)"), r'<a href="\2">\1</a>', r"\1"),
]
#: Marks that make a text Markdown; a single star may be anything.
_TELLING = [_MARKS[i][0] for i in (0, 1, 3)]
_SAFE_LINK = re.compile(r"\]\((?!https?://|#|/)[^)]*\)")


class Block(NamedTuple):
    """Lines of one kind; ``level`` is that of a heading."""

    kind: str
    lines: list[str]
    level: int = 0


def _said(line: str) -> bool:
    """Whether a line is more than badges or a boilerplate heading."""
    return not (_BADGES.fullmatch(line) or line.casefold() in BOILERPLATE)


def blocks(text: str, marked: bool = True) -> Iterator[Block]:
    """The blocks of a text; without ``marked`` all are paragraphs."""
    kind, held, fenced = "", [], False
    for raw in [*text.split("\n"), ""]:
        line = raw.strip()
        if marked and line.startswith("```"):
            if held or fenced:
                yield Block("code" if fenced else kind, held)
            kind, held, fenced = "", [], not fenced
            continue
        if fenced:
            held.append(raw.rstrip())
            continue
        opens, body, level = "paragraph", line, 0
        for name, pattern in _OPENERS if marked else ():
            if m := pattern.match(line):
                opens, body, level = name, m[m.lastindex], len(m[1]) if name == "heading" else 0
                break
        if opens == "paragraph" and kind in ("bullet", "step", "quote") and line:
            held[-1] += " " + line  # a line that goes on
            continue
        if held and (not line or opens != kind):
            yield Block(kind, held)
            kind, held = "", []
        if level:
            yield Block("heading", [body], level)
        elif line and _said(line):
            kind = opens
            held.append(body)
    if held:
        yield Block("code" if fenced else kind, held)


def _signs(block: Block) -> bool:
    """Whether a block is anything but plain text."""
    return block.kind != "paragraph" or any(p.search(x) for x in block.lines for p in _TELLING)


def as_html(block: Block, marked: bool = True) -> str:
    """A block as HTML; whatever it holds is escaped first."""
    safe = [html.escape(x, quote=False) for x in block.lines]
    if block.kind == "code":
        return "<pre><code>" + "\n".join(safe) + "</code></pre>"
    if marked:
        safe = [_SAFE_LINK.sub("](#)", x) for x in safe]
        for pattern, shape, _ in _MARKS:
            safe = [pattern.sub(shape, x) for x in safe]
    match block.kind:
        case "heading":
            return f"<h{block.level}>{safe[0]}</h{block.level}>"
        case "bullet" | "step":
            tag = "ul" if block.kind == "bullet" else "ol"
            return f"<{tag}>" + "".join(f"<li>{x}</li>" for x in safe) + f"</{tag}>"
        case "quote":
            return "<blockquote><p>" + "\n".join(safe) + "</p></blockquote>"
    return "<p>" + ("\n" if marked else "<br>").join(safe) + "</p>"


def as_text(block: Block, marked: bool = True) -> str:
    """A block on one line, without its marks."""
    line = " ".join(block.lines)
    if marked and block.kind != "code":
        for pattern, _, shape in _MARKS:
            line = pattern.sub(shape, line)
    return " ".join(html.unescape(line).split())


def cut_behind_word(text: str, limit: int) -> str:
    """``text`` within ``limit`` characters and an ellipsis, as ``functions.text.truncate`` does for columns."""
    if len(text) <= limit:
        return text
    last = text.rfind(" ", 0, limit + 1)
    whole = re.sub(r"[ ,.;:\-]+$", "", text[:last] if last >= 0 else text[: limit + 1])
    return (whole if len(whole) >= limit // 2 else text[:limit].rstrip()) + "…"


class Rendered(NamedTuple):
    """A text for lists and pages."""

    summary_text: str
    summary_html: str
    body_html: str
    detected_format: str
    truncated: bool


def write(found: Iterable[Block], marked: bool, summary_limit: int, lost: bool = False) -> Rendered:
    """Blocks as summary and body; a body of one paragraph has no element around it."""
    found = list(found)
    line = " ".join(filter(None, (as_text(b, marked) for b in found)))
    summary = cut_behind_word(line, summary_limit)
    bodies = [as_html(b, marked) for b in found]
    alone = len(found) == 1 and found[0].kind == "paragraph"
    body = bodies[0][3:-4] if alone else ("\n" if marked else "").join(bodies)
    return Rendered(summary, html.escape(summary), body, "markdown" if marked else "plain", lost or summary != line)


def prose(text: str | None, summary_limit: int = 160, body_limit: int = 64_000, block_limit: int | None = None, marked: bool | None = None) -> Rendered:
    """A text of at most ``body_limit`` characters and ``block_limit`` blocks; Markdown is recognised unless ``marked`` says.

    Null and empty texts give an empty summary and body.
    """
    clean = unicodedata.normalize("NFKC", text or "").replace("\0", "")
    kept = "\n".join(clean[:body_limit].splitlines())
    found = list(blocks(kept))
    if marked is None:
        marked = any(map(_signs, found))
    if not marked:
        found = list(blocks(kept, marked=False))
    shown = list(islice(found, block_limit))
    return write(shown, marked, summary_limit, lost=len(clean) > body_limit or len(shown) < len(found))


class _Cutter(HTMLParser):
    """Collects the text of a fragment in blocks."""

    def __init__(self) -> None:
        super().__init__()
        self.cuts: list[list[str]] = [[]]

    def handle_data(self, data: str) -> None:
        self.cuts[-1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ENDS_BLOCK:
            self.cuts.append([])


def texts_of(fragment: str | None) -> list[str]:
    """The text of each block of an HTML fragment, on one line; empty ones are left out."""
    reader = _Cutter()
    reader.feed(fragment or "")
    reader.close()
    return [t for t in (" ".join("".join(c).split()) for c in reader.cuts) if t]


def excerpt(fragment: str | None, body_limit: int = 4_000, block_limit: int = 2) -> Rendered:
    """The first blocks of an HTML fragment as plain paragraphs, within ``body_limit`` characters."""
    every = texts_of(fragment)
    room, shown = body_limit, []
    for line in every[:block_limit]:
        if room > 0:
            shown.append(Block("paragraph", [line[:room]]))
        room -= len(line)
    return write(shown, False, 160, lost=len(every) > block_limit or room < 0)


def rendered(c: Column, summary_limit: int = 160, body_limit: int = 64_000, block_limit: int | None = None) -> Column:
    """``prose`` as a struct column."""

    @F.pandas_udf(RENDERED)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prose(v, summary_limit, body_limit, block_limit) for v in values], columns=Rendered._fields)

    return run(c)


def excerpted(c: Column, body_limit: int = 4_000, block_limit: int = 2) -> Column:
    """``excerpt`` as a struct column."""

    @F.pandas_udf(RENDERED)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([excerpt(v, body_limit, block_limit) for v in values], columns=Rendered._fields)

    return run(c)
