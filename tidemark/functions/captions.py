"""Caption layout: display widths and splits, which need Unicode properties.

The split depends on what stands in the buffer, so it is a sequential rule inside one
text; it runs as a pandas function over batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

_DROPPED = dict.fromkeys(map(ord, "，。,.、､"))
_MARKS = set("，。！？、,.!?；;：:\"'“”‘’（）()[]【】《》<>+-_/")


class _Widths(dict):
    """Widths by character, each found once."""

    def __missing__(self, ch: str) -> float:
        wide = unicodedata.east_asian_width(ch) in "WF"
        width = 0.0 if ch.isspace() else 0.5 if not wide and (ch.isascii() and ch.isalnum() or ch in _MARKS) else 1.0
        self[ch] = width
        return width


_width = _Widths().__getitem__


def display_width(text: str) -> float:
    """Wide characters count 1, ASCII letters, digits and punctuation a half, white space nothing."""
    return sum(map(_width, text), 0.0)


def _clean(text: str) -> str:
    return text.translate(_DROPPED).strip()


def _guarded(line: str, words: tuple[str, ...]) -> int:
    """Length of the longest end of a line that begins a protected word (2 at least), for the first such word."""
    for word in words:
        for n in range(len(word), 1, -1):
            if line.endswith(word[:n]):
                if n < len(line):
                    return n
                break
    return 0


def _hard_wrap(text: str, limit: float, words: tuple[str, ...]) -> list[str]:
    lines, line, width = [], "", 0.0  # widths are halves, so sums are exact
    for ch in text:
        width += _width(ch)
        if not line or width <= limit:
            line += ch
            continue
        n = _guarded(line + ch, words)
        if n:
            whole = line + ch
            keep, line = whole[:-n], whole[-n:]
        elif ch in K.LINE_START_MARKS and len(line) > 1:
            keep, line = line[:-1], line[-1] + ch
        else:
            keep, line = line, ch
        width = display_width(line)
        if keep.strip():
            lines.append(keep.strip())
    if line.strip():
        lines.append(line.strip())
    return lines


def _packed(parts: list[str], limit: float) -> list[str]:
    """Neighbours joined as long as they fit."""
    out: list[str] = []
    width = 0.0
    for p in parts:
        width += display_width(p)
        if out and width <= limit:
            out[-1] += p
        else:
            out.append(p)
            width = display_width(p)
    return out


def _clauses(text: str, marks: str) -> list[str]:
    parts, start = [], 0
    for i, ch in enumerate(text):
        if ch in marks:
            parts.append(text[start : i + 1])
            start = i + 1
    return [p for p in (_clean(x) for x in [*parts, text[start:]]) if p]


def split_caption(text: str | None, limit: float = 12, words: tuple[str, ...] = K.PROTECTED_WORDS) -> list[str]:
    """Lines of at most ``limit`` units: clauses packed, longer ones wrapped.

    Null and blank texts give one empty line. Protected words and marks that must not
    begin a line move to the next or stay with the one before.
    """
    text = (text or "").strip()
    lines: list[str] = []
    for part in _packed(_clauses(text, K.CAPTION_BREAKS), limit):
        lines += [part] if display_width(part) <= limit else _hard_wrap(part, limit, words)
    return lines or [_clean(text)]


def _lines(texts: pd.Series) -> pd.Series:
    return texts.map(split_caption)


def _units(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: display_width(t or ""))


caption_lines = F.pandas_udf(_lines, T.ArrayType(T.StringType()))
display_units = F.pandas_udf(_units, T.DoubleType())
