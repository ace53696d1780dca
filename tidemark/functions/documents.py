"""JSON found in texts: extraction, repair, collection at any depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_object(c: Column) -> Column:
    """The JSON text in a model's answer: whole, in a fence, or from the first to the last brace.

    Null where none of them parses.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*```[A-Za-z]*\s*$", ""), r"\A\s+|\s+\z", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(ok(bare), ok(F.when(inner != "", inner)))


def closed(text: str) -> str:
    """The text with all braces and brackets closed that are open at its end."""
    open_, quoted, skip = [], False, False
    for ch in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]" and open_ and open_[-1] == ch:
            open_.pop()
    return text + ('"' if quoted else "") + "".join(reversed(open_))


def repair(text: str | None) -> str | None:
    """Valid JSON from an answer with a fence, curly quotes or a cut-off end; null if hopeless."""
    if text is None:
        return None
    lines = [x for x in text.strip().splitlines() if not x.strip().startswith("```")]
    body = "\n".join(lines).strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    for form in (body, body[: max(body.rfind("}"), body.rfind("]")) + 1], closed(body.rstrip().rstrip(","))):
        for fixed in (form, form.translate({0x201C: '"', 0x201D: '"'})):
            try:
                return json.dumps(json.loads(fixed), ensure_ascii=False)
            except ValueError:
                continue
    return None


def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair)


repaired_json = F.pandas_udf(_repaired, T.StringType())


_TEXT = ("text", "sentence", "subtitle", "content", "word")
_START = ("start", "start_time", "start_ms", "begin", "begin_time", "begin_ms", "time_begin")
_END = ("end", "end_time", "end_ms", "finish", "finish_time", "finish_ms", "time_end")


def _seconds(value, duration: float | None) -> float | None:
    try:
        v = float(value)
    except (TypeError, ValueError):
        return None
    return round(v / 1000 if duration and v > 3 * duration else v, 3)


def subtitles(document: str | None, duration: float | None) -> list[dict]:
    """Timed texts at any depth of a document, sorted, each once."""
    try:
        todo = [json.loads(document or "")]
    except ValueError:
        return []
    found = {}
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += v
            continue
        if not isinstance(v, dict):
            continue
        todo += v.values()
        text = next((v[k] for k in _TEXT if isinstance(v.get(k), str)), None)
        start, end = (next((_seconds(v[k], duration) for k in names if k in v), None) for names in (_START, _END))
        if text is None or start is None or end is None or end <= start:
            continue
        row = {"text": text, "start_s": start, "end_s": end, "char_start": None, "char_end": None}
        try:
            row |= {
                "char_start": int(v.get("pronounce_text_begin", v.get("text_begin"))),
                "char_end": int(v.get("pronounce_text_end", v.get("text_end"))),
            }
        except (TypeError, ValueError):
            pass
        found.setdefault((start, end, text), row)
    return [found[k] for k in sorted(found)]


def _subtitles(documents: pd.Series, durations: pd.Series) -> pd.Series:
    return pd.Series([subtitles(d, t) for d, t in zip(documents, durations, strict=True)])


_ITEM = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
     T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]
)
#: See subtitles(); for any nesting, which no fixed schema covers.
subtitle_items = F.pandas_udf(_subtitles, T.ArrayType(_ITEM))


def variant_rows(c: Column, *keys: str) -> Column:
    """A document's rows: the document if it is a list, else the first list under one of the keys."""
    v = F.try_parse_json(c)
    rows = [F.try_variant_get(v, "$", "array<variant>")]
    rows += [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    return F.coalesce(*rows, F.when(v.isNotNull(), F.array(v)))
