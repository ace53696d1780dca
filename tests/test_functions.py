import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import captions, coerce, documents, scoring, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_coalesce(spark):
    null = F.lit(None).cast("string")
    assert one(spark, coerce.first_nonblank(null, F.lit(""), F.lit("a"), F.lit("b"))) == "a"
    assert one(spark, coerce.first_truthy(F.lit(0), F.lit(3))) == 3
    assert one(spark, coerce.as_double(F.lit("x"), 1.5)) == 1.5
    assert one(spark, coerce.as_list(F.lit(""))) == []
    assert one(spark, coerce.as_bool(F.lit(" Yes "))) is True
    assert one(spark, coerce.as_bool(null)) is False
    assert one(spark, coerce.time_range(F.array(F.lit(1.0)), F.lit(9.0), F.lit(4.0))) == [1.0, 4.0]
    assert one(spark, F.round(coerce.frame_rate(F.lit("30000/1001")), 3)) == 29.97
    assert one(spark, coerce.frame_rate(F.lit("1/0"))) == 0.0
    assert one(spark, coerce.slug(F.lit("  Ab c! "))) == "ab-c"
    assert one(spark, coerce.slug(F.lit("!!"))) == "item"
    assert one(spark, coerce.status_of(F.lit("OK"), {"ok": "pass"}, "warning")) == "pass"
    assert one(spark, coerce.blank_fields(a=F.lit(" "), b=F.lit("x"), c=null)) == ["a", "c"]


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == pytest.approx(1)
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0, 0))) == -1
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == -1
    assert one(spark, vectors.dot(v(1, 2, 3), v(4, 5))) == 14
    m = F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(1.0))
    assert one(spark, vectors.mean_weighted(m, vectors.weight_map({"a": 1, "b": 3}))) == pytest.approx(0.875)
    assert one(spark, vectors.mean_weighted(m, vectors.weight_map({"c": 1}))) == -1
    assert vectors.weights_for("cta", "asr=2, ocr=x")["asr"] == 2.0


def test_texts(spark):
    assert one(spark, text.query_terms(F.lit("防水，a 防水/测试很长很长很长很长很长"))) == ["防水"]
    assert one(spark, text.repeated_sentences(F.lit("abcdefg。abcdefg！xy。xy。"))) == ["abcdefg"]
    assert one(spark, text.relative_position(F.lit("abcd"), F.array(F.lit("c"), F.lit("z")))) == 0.5
    assert one(spark, text.relative_position(F.lit("abcd"), F.array(F.lit("z")))) is None
    assert one(spark, text.spoken(F.lit("SPF 50+ PA +++ 618"))) == "SPF五十加PA三个加六一八"
    assert one(spark, text.spoken_notes(F.lit("spf50"))) == ["SPF50"]
    assert one(spark, text.redacted(F.lit("Bearer abcdefghijklmnop ?token=xyz&a=1"))) == "Bearer <redacted> ?token=<redacted>&a=1"
    assert one(spark, text.variant_index(F.lit("v3"), 4)) == 2
    assert one(spark, text.variant_index(F.lit("v"), 4)) == one(spark, text.stable_index(F.lit("v"), 4))
    assert one(spark, text.last_progress(F.lit("[1/4]\n[3/4]"))).percent == 75
    assert one(spark, text.last_progress(F.lit("none"))) is None
    assert one(spark, text.all_times(F.lit("start: 1.5 end: 2 start=3 end=4"), "start", "end"))[1].end == 4
    assert one(spark, text.failure_line(F.lit("a ReadTimeout 1\nReadTimeout 2\nx"), [("nope", "n"), ("ReadTimeout", "late")])) == "late: ReadTimeout 2"
    assert one(spark, text.redacted_map(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("u"), F.lit("v")))) == {"api_key": "<redacted>", "u": "v"}


def test_captions():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("防晒气垫补妆一层底粉ab, 。！、x") for _ in range(rng.randrange(0, 60)))
        lines = captions.split_caption(t)
        assert "".join(lines).replace(" ", "") == captions._clean(t).replace(" ", "")
        assert all(captions.display_width(x) <= 12 or "防晒" in x or "！" in x or "一层" in x for x in lines)
    assert captions.split_caption(None) == [""]
    joined = captions.split_caption("今天我们要给大家介绍的是防晒气垫好用")
    assert any("防晒气垫" in x for x in joined)


def test_json():
    assert documents.repair('```json\n{"a": [1, 2\n```') == '{"a": [1, 2]}'
    assert documents.repair('say {"a": "b"} end') == '{"a": "b"}'
    assert documents.repair("nothing") is None
    rows = documents.subtitles('{"x": [{"text": "a", "start_ms": 1000, "end_ms": 2000, "text_begin": 0, "text_end": 1}, {"text": "a", "start": 1.0, "end": 2.0}]}', 10.0)
    assert rows == [{"text": "a", "start_s": 1.0, "end_s": 2.0, "char_start": None, "char_end": None}] or len(rows) == 1


def test_json_object(spark):
    assert one(spark, documents.json_object(F.lit('text {"a": 1} more'))) == '{"a": 1}'
    assert one(spark, documents.json_object(F.lit("no"))) is None


def test_scores(spark):
    hits = scoring.role_hits(F.lit("防水 测试"), F.lit(""), F.lit("proof"))
    assert one(spark, scoring.role_bonus(hits)) == pytest.approx(0.07)
    assert one(spark, scoring.risk_adjustment(F.lit("high"), F.lit("good"))) == pytest.approx(-0.13)
    assert one(spark, scoring.duration_adjustment(F.lit(None).cast("double"), F.lit(3.0))) == pytest.approx(-0.08)
    assert one(spark, scoring.product_matches(F.lit(""), F.lit(""), "x")) is True
    assert one(spark, scoring.product_matches(F.lit("yy"), F.lit("z"), "x")) is False
    v = one(spark, scoring.theme_verdict(F.lit("ab cd"), F.create_map(F.lit("t"), F.array(F.lit("zz"))), F.array(F.lit("cd"))))
    assert (v.allowed, v.missing, v.forbidden) == (False, ["t"], ["cd"])
    assert one(spark, scoring.loop_enabled(F.lit(False), F.lit("no_loop"))) is False


def test_captions_are_laid_out_once_and_each_character_a_few_times(spark, monkeypatch):
    """the width of a line follows its characters, and repairing times doesn't lay texts out again."""
    from tidemark.functions import captions as C
    from tidemark.plans import timeline

    seen = []
    whole = C.display_width
    monkeypatch.setattr(C, "display_width", lambda t: seen.append(len(t)) or whole(t))
    text = "abcdefgh ij" * 200
    assert "".join(C.split_caption(text)).replace(" ", "") == text.replace(" ", "") and sum(seen) < 6 * len(text)
    monkeypatch.undo()
    rows = spark.createDataFrame([(1, 1, 1, text, 0.0, 60.0)], "task_id int, section_id int, timeline_order int, voice_text string, start_s double, end_s double")
    out = timeline.captions(rows)
    assert "EvalPython" not in out._jdf.queryExecution().toString() and out.count() > 50
