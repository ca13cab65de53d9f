"""Chunks of a text by a loop over strings: the definition that the fold is tested against."""

from __future__ import annotations

import re
from collections.abc import Iterator

from studyspark.functions.chunking import CHUNK_OVERLAP, CHUNK_SIZE, checked

_GAP = "\n\n"
_BEFORE_HEADING = re.compile(r"^(?=## .)", re.MULTILINE)
#: Breaks that an overlap may begin at, best first.
_BREAKS = tuple(map(re.compile, (_GAP, "\n", " ")))


def _spans(text: str, limit: int) -> Iterator[tuple[int, int]]:
    """Where the pieces of a text begin and end: paragraphs, those over the limit cut at the last line end
    under it, else the last space, else hard; blank ones are left out."""
    cut = re.compile(rf"(?s).{{1,{limit - 1}}}(?=\n)|.{{1,{limit - 1}}}(?= )|.{{{limit}}}")
    ends = [m.start() for m in re.finditer(_GAP, text)]
    for at, end in zip([0, *(e + len(_GAP) for e in ends)], [*ends, len(text)], strict=True):
        if not text[at:end].strip():
            continue
        while end - at > limit:
            stop = cut.match(text, at, end).end()
            if text[at:stop].strip():
                yield at, at + len(text[at:stop].rstrip())
            at = end - len(text[stop:end].lstrip())
        if text[at:end].strip():
            yield at, end


def carried(chunk: str, overlap: int) -> str:
    """The end of a chunk that opens the next one: from a break in its last characters on."""
    end = chunk[len(chunk) - min(overlap, len(chunk)) :]
    found = next(filter(None, (mark.search(end) for mark in _BREAKS)), None) if overlap < len(chunk) else None
    return end[found.end() :].lstrip() if found else end


def _packed(parts: Iterator[str], size: int, after) -> Iterator[str]:
    """Greedy packing; ``after(full chunk)`` opens the next."""
    now = ""
    for part in parts:
        if now and len(now) + len(_GAP) + len(part) > size:
            yield now
            now = after(now)
        now = now + _GAP + part if now else part
    if now:
        yield now


def sections(text: str) -> list[str] | None:
    """Heading-led sections with what precedes them, or None under three headings."""
    opening, *led = (part.strip() for part in _BEFORE_HEADING.split(text))
    if len(led) < 3:
        return None
    return [opening, *led] if opening else led


def chunk(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters, on sections where there are headings, else on paragraphs."""
    checked(size, overlap)
    plain = lambda t: list(_packed((t[a:b] for a, b in _spans(t, size - overlap - len(_GAP))), size, lambda c: carried(c, overlap)))
    own = sections(text)
    if own is None:
        return plain(text)
    out: list[str] = []
    run: list[str] = []
    for section in [*own, None]:
        if section is None or len(section) > size:
            out += _packed(iter(run), size, lambda _: "")
            run = []
            out += plain(section) if section else []
        else:
            run.append(section)
    return out
