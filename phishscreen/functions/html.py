"""HTML bodies in one pass over their tags (F6, F8): the visible text, and whether a hidden element holds random text.

Mail is hostile: a pattern that scans on from every open tag takes hours for one message of some megabytes. Here every search
either finds its end and goes on behind it, or is known not to find it again: tags are only looked for before the last ``>``, a
script or style block without an end ends the search for its kind, and hidden elements that lie in one whose text is already known
to be harmless are not read again. So the time is linear in the size of a message, but for blocks of scripts that are hidden
inside each other. A null body counts as empty.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import by_row

READ = pa.struct([("text", pa.string()), ("hidden", pa.bool_())])

#: White space as browsers see it.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS = f"[{BLANKS}]"
_FLAGS = re.I | re.A
_OPEN = re.compile("<([a-z]+)(?![a-z0-9_])", _FLAGS)
_CLOSE = re.compile("</([a-z]+)", _FLAGS)
_BLOCK = re.compile("<(script|style)(?![a-z0-9_])", _FLAGS)
_ENDS = {name: re.compile(f"</{name}>", _FLAGS) for name in ("script", "style")}
_TAG = re.compile("<[^>]+>")
_HIDING = re.compile("|".join(f"{k}{_WS}*:{_WS}*{v}" for k, v in (("display", "none"), ("visibility", "hidden"), ("font-size", "0"), ("opacity", "0"), ("max-height", "0"))), _FLAGS)
_RANDOM = re.compile("[A-Za-z0-9]{16}")
_BLANK_RUN = re.compile(f"{_WS}+")
#: Replaced in this order, numeric entities before the last one.
_BREAKS = ((re.compile(f"<br{_WS}*/?>", _FLAGS), "\n"), (re.compile("</(p|div|tr|li|h[1-6])>", _FLAGS), "\n"))
_ENTITIES = ((re.compile("&nbsp;", _FLAGS), " "), (re.compile("&lt;", _FLAGS), "<"), (re.compile("&gt;", _FLAGS), ">"), (re.compile("&quot;", _FLAGS), '"'), (re.compile("&#39;"), "'"))
_NUMBER, _AMPERSAND = re.compile("&#([0-9]{1,7});"), re.compile("&amp;", _FLAGS)
_SPACES, _LINES = re.compile("[ \t\u00a0]+"), re.compile("\n{3,}")
#: Characters that an element without an end is read for, and that are read at once where such elements overlap.
REACH, WIDE = 4000, 64_000


def _character(m: re.Match) -> str:
    n = int(m[1])
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m[0]


def script_blocks(html: str, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges from a script or style tag to the end tag of its kind."""
    out, open_ended = [], set()
    found = _BLOCK.search(html, start, end)
    while found and len(open_ended) < 2:
        name, at = found[1].lower(), found.start() + 1
        if name not in open_ended:
            close = html.find(">", found.end(), end)
            if close < 0:
                break
            stop = _ENDS[name].search(html, close + 1, end)
            if stop:
                at = stop.end()
                out.append((found.start(), at))
            else:
                open_ended.add(name)
        found = _BLOCK.search(html, at, end)
    return out


def visible_text(html: str, start: int = 0, end: int | None = None) -> str:
    """F6 of a part of a body: no scripts, styles and tags; breaks and block ends as line breaks, entities as characters,
    blanks squeezed."""
    end = len(html) if end is None else end
    parts, at = [], start
    for a, b in script_blocks(html, start, end):
        parts.append(html[at:a])
        at = b
    parts.append(html[at:end])
    out = " ".join(parts)
    for pattern, by in _BREAKS:
        out = pattern.sub(by, out)
    last = out.rfind(">") + 1
    out = _TAG.sub(" ", out[:last]) + out[last:]
    if "&" in out:
        for pattern, by in _ENTITIES:
            out = pattern.sub(by, out)
        out = _AMPERSAND.sub("&", _NUMBER.sub(_character, out))
    return _LINES.sub("\n\n", _SPACES.sub(" ", out)).strip(BLANKS)


def hidden_ranges(html: str) -> list[tuple[int, int]]:
    """Where the content of each element that a style hides begins and ends: at the first end tag whose name begins with its
    own, else after REACH characters."""
    tags, at = [], 0
    found = _OPEN.search(html)
    while found:
        close = html.find(">", found.end())
        if close < 0:
            break
        if _HIDING.search(html, found.end(), close):
            tags.append((close + 1, found[1].lower()))
        at = close + 1
        found = _OPEN.search(html, at)
    if not tags:
        return []
    sizes, nearest, out = sorted({len(name) for _, name in tags}), {}, []
    ends = [(m.start(), m[1].lower()) for m in _CLOSE.finditer(html, tags[0][0])]
    for start, name in reversed(tags):
        while ends and ends[-1][0] >= start:
            where, run = ends.pop()
            for size in sizes:
                if size > len(run):
                    break
                nearest[run[:size]] = where
        out.append((start, nearest.get(name, min(len(html), start + REACH))))
    return out[::-1]


class _Harmless:
    """A range of a body whose text holds no random run, and what of it can't be read the same way from the middle."""

    def __init__(self, html: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        blocks = script_blocks(html, start, end)
        self.opens, self.closes = [a for a, _ in blocks], [b for _, b in blocks]
        # blocks, breaks and block ends go before tags do, and a tag may reach over them
        parts, at = [], start
        for a, b in blocks:
            parts += [html[at:a], " " * (b - a)]
            at = b
        left = "".join([*parts, html[at:end]])
        for pattern, _ in _BREAKS:
            left = pattern.sub(lambda m: " " * len(m[0]), left)
        tags = [m.span() for m in _TAG.finditer(left, 0, left.rfind(">") + 1)]
        self.tag_opens, self.tag_closes = [start + a for a, _ in tags], [start + b for _, b in tags]

    def clears(self, html: str, start: int, end: int) -> bool:
        """Whether a range inside is harmless too. What its end cuts off a tag is text, and is read."""
        if start < self.start or end > self.end or any(_inside(self.opens, self.closes, x) is not None for x in (start, end)) or _inside(self.tag_opens, self.tag_closes, start) is not None:
            return False
        tag = _inside(self.tag_opens, self.tag_closes, end)
        return tag is None or not _random_run(html, tag, end)


def _inside(opens: list[int], closes: list[int], x: int) -> int | None:
    """Where the range around x begins, if there is one."""
    i = bisect_right(opens, x) - 1
    return opens[i] if i >= 0 and opens[i] < x < closes[i] else None


def _random_run(html: str, start: int, end: int) -> bool:
    return _RANDOM.search(_BLANK_RUN.sub("", visible_text(html, start, end))) is not None


def hides_random_text(html: str) -> bool:
    """F8: an element that a style hides holds a run of 16 letters and digits, white space aside."""
    known, tried = None, 0
    for start, end in hidden_ranges(html):
        if known and known.clears(html, start, end):
            continue
        wide = max(end, min(len(html), start + WIDE))
        if start >= tried and wide > end:
            # many elements without an end overlap: a wide range without such a run clears all of them at once
            if _random_run(html, start, wide):
                tried = wide
            else:
                known = _Harmless(html, start, wide)
                if known.clears(html, start, end):
                    continue
        if _random_run(html, start, end):
            return True
        if known is None or end > known.end:
            known = _Harmless(html, start, end)
    return False


def html_parts(html: Column) -> Column:
    """STRUCT<text, hidden> of a body, read once. Rows without HTML send a null to Python."""

    @F.arrow_udf("text string, hidden boolean")
    def read(bodies: pa.Array) -> pa.Array:
        return by_row(lambda x: {"text": visible_text(x), "hidden": hides_random_text(x)} if x is not None else {"text": "", "hidden": False}, [bodies], READ)

    return read(F.when(html != "", html))


def html_to_text(html: Column) -> Column:
    """F6."""
    return F.coalesce(html_parts(html)["text"], F.lit(""))


def hidden_random_text(html: Column) -> Column:
    """F8."""
    return F.coalesce(html_parts(html)["hidden"], F.lit(False))
