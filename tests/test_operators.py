import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedupe, intervals, joins, projections, quality, selection, sets, topk
from tidemark.plans import dashboard, orchestration, timeline
from tidemark.streaming import incremental, streams


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_merge_short_equals_sequential(spark):
    def sequential(bounds, least, forward):
        segs = [[a, b] for a, b in zip(bounds, bounds[1:])]
        while len(segs) > 1:
            i = next((i for i, s in enumerate(segs) if s[1] - s[0] < least), None)
            if i is None:
                break
            left = i > 0 and (i == len(segs) - 1 or not forward and segs[i - 1][1] - segs[i - 1][0] <= segs[i + 1][1] - segs[i + 1][0])
            a = i - 1 if left else i
            segs[a : a + 2] = [[segs[a][0], segs[a + 1][1]]]
        return [(round(a, 3), round(b, 3)) for a, b in segs if b - a > 0.05]

    rng = random.Random(4)
    data = [(i, sorted(round(rng.uniform(0, 20), 2) for _ in range(rng.randrange(2, 12)))) for i in range(40)]
    df = spark.createDataFrame(data, "i int, b array<double>")
    for forward in (False, True):
        out = df.select("i", intervals.merge_short(F.col("b"), 1.2, forward).alias("s")).collect()
        for r in out:
            assert [tuple(x) for x in r.s] == sequential(dict(data)[r.i], 1.2, forward)


def test_snap(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 4.1, [4.0, 8.2]), ("a", 2, 4.2, 8.0, [4.0, 8.2]), ("a", 3, 8.1, 12.0, [4.0, 8.2])], "k string, n int, start_s double, end_s double, cuts array<double>")
    out = intervals.snap_to_cuts(df, ["k"], ["n"], "cuts").orderBy("n").select("snapped_start_s", "snapped_end_s")
    assert rows(out) == [(0.0, 4.0), (4.0, 8.2), (8.2, 12.0)]


def test_capped_islands_and_units(spark):
    docs = spark.createDataFrame(
        [("v", None, "p", 30.0, [(0.0, 3.0, "x"), (3.5, 6.0, "y"), (6.2, 9.8, "z"), (20.0, 22.0, "w")])],
        "id string, asset_id string, product string, duration_s double, highlights array<struct<start:double,end:double,label:string>>",
    )
    full = docs.withColumn("highlights", F.transform("highlights", lambda h: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("start_s", "double"), ("start_time", "double"), ("end_s", "double"), ("end_time", "double"), ("usable_start", "double"), ("usable_end", "double"),
            ("visual_summary", "string"), ("source_meaning", "string"), ("source_asr", "string"), ("source_ocr", "array<string>"), ("hard_subtitle_risk", "string"),
            ("voiceover_fit", "string"), ("can_standalone", "boolean"), ("selling_points", "array<string>"), ("visual_actions", "array<string>"))])))
    s = projections.shots(full)
    assert s.count() == 4
    units = projections.inferred_units(s).orderBy("unit_no").select("start_s", "end_s", F.size("child_shot_ids"))
    assert rows(units) == [(0.0, 6.0, 2), (6.2, 9.8, 1), (20.0, 22.0, 1)]
    kids = projections.unit_children(projections.inferred_units(s), s)
    assert kids.filter("size(child_shot_ids) = 0").count() == 0
    assert projections.channel_inputs(s).count() == 24
    pieces = intervals.split_by_cuts(s.withColumn("cuts", F.array(F.lit(1.5))), shortest=1.2)
    assert projections.physical_shots(pieces).filter("needs_refine").count() == 2


def test_two_caps_equal_model():
    def model(items, k, pp, pa):
        chosen, parents, assets = [], {}, {}
        for by_p, by_a in ((True, True), (True, False), (False, False)):
            for i, p, a in items:
                if len(chosen) == k or i in chosen or by_p and parents.get(p, 0) >= pp or by_a and assets.get(a, 0) >= pa:
                    continue
                chosen.append(i)
                parents[p] = parents.get(p, 0) + 1
                assets[a] = assets.get(a, 0) + 1
        return chosen

    rng = random.Random(1)
    for _ in range(200):
        items = [(i, rng.randrange(4), f"a{rng.randrange(3)}") for i in range(12)]
        assert [i for i, _ in topk.select_capped(items, 6, 1, 2)] == model(items, 6, 1, 2)


def fingerprints(spark, data):
    return spark.createDataFrame(data, "shot_id string, asset_id string, story_unit_id string, duration_s double, clip_sha256 string, phash array<bigint>, dhash array<bigint>, status string")


def test_duplicates(spark):
    a, far = [5, 6, 7, 8, 9], [5, 6, 7, (1 << 40) - 1, (1 << 41) - 1]
    f = fingerprints(spark, [
        ("s1", "A", "", 3.0, "", a, a, "ok"), ("s2", "B", "", 4.0, "", a, a, "ok"), ("s3", "B", "", 3.0, "", far, far, "ok"),
        ("s4", "C", "", 3.0, "x", [1 << 60] * 5, [1 << 61] * 5, "ok"), ("s5", "C", "", 3.0, "x", [-1] * 5, [-1] * 5, "ok"), ("s6", "C", "", 90.0, "", a, a, "ok"), ("s7", "", "", 1.0, "", a, a, "failed"),
    ])
    pairs = {(r.a, r.b): r.status for r in dedupe.duplicate_pairs(f).collect()}
    assert pairs[("s1", "s2")] == "strong_duplicate" and pairs[("s4", "s5")] == "strong_duplicate"
    assert not any("s6" in p or "s7" in p for p in pairs)
    groups = dedupe.duplicate_groups(f, dedupe.duplicate_pairs(f))
    by = {tuple(r.members): r for r in groups.collect()}
    first = next(r for m, r in by.items() if "s1" in m)
    assert first.canonical_id == "s2"
    marked = {r.shot_id: r.duplicate_role for r in dedupe.annotate(f, groups).collect()}
    assert marked["s2"] == "canonical" and marked["s1"] == "duplicate" and marked["s6"] is None


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.getrandbits(62) for _ in range(5)] for _ in range(6)]

    def near(h):
        return [x ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) if rng.random() < 0.7 else rng.getrandbits(62) for x in h]

    data = [(f"s{i:03d}", "A", "", 3.0, "", h := near(rng.choice(base)), h, "ok") for i in range(60)]
    f = fingerprints(spark, data)
    row = F.struct("shot_id", "asset_id", "duration_s", "clip_sha256", "phash", "dhash")
    x, y = f.select(row.alias("x")), f.select(row.alias("y"))
    every = dedupe.pair_score(x.crossJoin(y).filter("x.shot_id < y.shot_id"))
    assert sorted(rows(dedupe.duplicate_pairs(f))) == sorted(rows(every))


@pytest.mark.parametrize("dense", [True, False])
def test_groups_need_few_links(spark, dense):
    """links make the groups and statuses of all pairs, without all pairs of a large group."""
    rng = random.Random(12)
    flip = lambda h, n: [x ^ sum(1 << b for b in rng.sample(range(60), rng.randrange(n))) for x in h]
    new = lambda n=5: [rng.getrandbits(60) for _ in range(n)]
    data, base = [], new()
    add = lambda p, d, sha="", dur=3.0, st="ok": data.append((f"s{len(data):04d}", "A", "", dur, sha, p, d, st))
    for _ in range(150 if dense else 0):
        add(flip(base, 8), flip(base, 10))
    for _ in range(20):  # small groups: close ones, copies, and files of one hash
        h = new()
        for _ in range(rng.randrange(1, 5)):
            add(x := flip(h, rng.choice([1, 2, 9])), flip(h, 4) if rng.random() < 0.5 else x, rng.choice(["", "", f"f{rng.randrange(6)}"]))
    h, mixed = new(), new()
    for i in range(60 if dense else 25):
        add(h, h, "", None if i % 2 else 3.0)
    mixed[1] = None
    for x in (mixed, mixed, mixed[:1], [], None, new(2)):
        for y in (x, x, None):
            add(x, y, "z" if x is None else "")
    add(base, base, "", 90.0)
    add(base, base, "", 3.0, "failed")
    rng.shuffle(data)
    f = fingerprints(spark, data).repartition(3)
    every = dedupe.duplicate_pairs(f)
    want = sorted(rows(dedupe.duplicate_groups(f, every)))
    assert len(want) > 5 and {r[1] for r in want} == {"strong_duplicate", "near_duplicate_candidate"}
    for block_rows in (20, 1000):
        links = dedupe.linking_pairs(f, block_rows)
        assert sorted(rows(dedupe.duplicate_groups(f, links))) == want
        if dense and block_rows == 20:
            assert links.count() < every.count() / 5


def test_close_pairs_by_blocks(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(32) for _ in range(5)]
    data = [(f"s{i:03d}", "ok", [None if rng.random() < 0.1 else b ^ (1 << rng.randrange(32)) ^ (rng.getrandbits(32) if rng.random() < 0.4 else 0) for b in base[: rng.randrange(6)]]) for i in range(90)]
    data += [("", "ok", base), ("x", "failed", base), ("y", "ok", None), ("z", "ok", [-1, 1 << 62, -(1 << 63)])]
    f = spark.createDataFrame(data, "shot_id string, status string, phash array<bigint>")
    known = [(i, h) for i, st, h in data if i and st == "ok" and h]
    near = lambda p, q: sum(x is not None and y is not None and bin((x ^ y) & (2**64 - 1)).count("1") <= dedupe.BITS for x, y in zip(p, q)) >= 3
    want = sorted((a, b) for a, p in known for b, q in known if a < b and near(p, q))
    for rows_a_block in (7, 1000):
        got = dedupe.close_pairs(f, 3, block_rows=rows_a_block)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    assert dedupe.close_pairs(f.filter("false"), 3).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r.node: r.component for r in dedupe.least_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_frame_hashes(spark):
    import math

    rng = random.Random(6)
    grey = [float(rng.randrange(256)) for _ in range(1024)]
    small = [float(rng.randrange(256)) for _ in range(72)]
    r = dedupe.frame_hashes(spark.createDataFrame([("s", 0, grey, small)], "shot_id string, frame int, grey array<double>, small array<double>")).first()
    terms = [sum(grey[y * 32 + x] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for y in range(32) for x in range(32)) for v in range(8) for u in range(8) if u or v]
    mid = sorted(terms)[31]
    assert r.phash == int("".join("1" if x > mid else "0" for x in terms), 2)
    bits = "".join("1" if small[i * 9 + j] > small[i * 9 + j + 1] else "0" for i in range(8) for j in range(8))
    assert r.dhash % (1 << 64) == int(bits, 2)


def test_joins_and_sets(spark):
    l = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "z"]), (3, [])], "k int, ids array<string>")  # noqa: E741
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(rows(joins.known_lists(l, "k", "ids", known, "id"))) == [(1, True), (2, False), (3, False)]
    assert rows(joins.unacknowledged(l, "k", "ids", spark.createDataFrame([("b",)], "a string"), "a").select("k").orderBy("k")) == [(2,), (3,)]
    d = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, o int")
    assert rows(joins.lookup(spark.createDataFrame([(1,), (2,)], "k int"), d, ["k"], "o").orderBy("k")) == [(1, "y"), (2, None)]
    with pytest.raises(Exception, match="unknown"):
        joins.required_lookup(spark.createDataFrame([(9,)], "k int"), d, "k", "unknown").collect()
    jobs = spark.createDataFrame([(True, "j1", ""), (True, "j2", "d2"), (False, "j1", ""), (False, "", "d2"), (True, "j3", "")], "is_job boolean, job_id string, job_dir string")
    assert sets.hide_jobs_with_runs(jobs).filter("is_job").select("job_id").collect() == [("j3",)]


def test_selection(spark):
    assert selection.allocate([1.0, 5.0, 5.0], 8.0) == ([(1, 5.0), (2, 3.0)], 0.0)
    assert selection.allocate([1.0, 2.0], 8.0) == ([(0, 1.0)], 7.0)
    assert selection.allocate([], 8.0) == ([], 8.0)
    rows_in = [("t", s, f"x{i}", f"u{i}", "a", 1.0 - i / 10, 4.0, 4.0) for s in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows_in, "task_id string, section_order int, shot_id string, unit_id string, asset_id string, score double, duration_s double, budget_s double")
    got = selection.select_sections(df).orderBy("section_order").select("shot_id").collect()
    assert [r[0] for r in got] == ["x0", "x1"]  # the second section pays for the first's pick
    facts = selection.usage_facts(spark.createDataFrame([("b", "t1", "x"), ("b", "t2", "x"), ("b", "t2", "x")], "batch string, task string, shot string"), "batch", "task", shot="shot")
    again = selection.replace_tasks(facts, facts.filter("task = 't2'"), "batch", "task")
    assert {r.task: r.n_others for r in selection.others(again, "batch", "task").collect()} == {"t1": 2, "t2": 1}


def test_quality(spark):
    s = spark.createDataFrame([("s1", "Hello, world", "Hello world!", 0.0, 2.0)], "section_id string, voice_text string, subtitle_text string, audio_start_s double, audio_end_s double")
    c = spark.createDataFrame([("s1", 1, "Hello", 0.0, 1.0), ("s1", 2, "world", 1.0, 2.0)], "section_id string, caption_order int, text string, start_s double, end_s double")
    ok = quality.caption_check(s, c)
    assert ok.first().status == "pass"
    short = quality.render_check(spark.createDataFrame([(39.933, 41.339)], "final_s double, audio_axis_s double"))
    assert short.first().status == "block"
    checks, messages = quality.report(ok, short)
    assert quality.overall(checks).first().status == "block"
    assert messages.first().message == "final is too short"


def test_increments(spark):
    src = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "source_fingerprint string")
    reg = spark.createDataFrame([("f1", "ready"), ("f2", "failed")], "source_fingerprint string, status string")
    get = lambda **k: {r[0]: (r.reason, r.selected) for r in incremental.classify(src, reg, **k).collect()}
    assert get() == {"f1": ("already_ready", False), "f2": ("retry_failed", True), "f3": ("new_source", True)}
    assert get(retry_failed=False)["f2"] == ("existing_failed_deferred", False)
    assert get(force=True)["f1"] == ("registry_status_ready", True)
    old = spark.createDataFrame([("t", "a", "1"), ("t", "b", "1"), ("t", "c", "1")], "task_id string, stage string, input_hash string")
    new = spark.createDataFrame([("t", "a", "1"), ("t", "b", "2"), ("t", "c", "1")], "task_id string, stage string, input_hash string")
    got = {r.stage: r.state for r in incremental.changed_stages(old, new, {"a": 0, "b": 1, "c": 2}).collect()}
    assert got == {"b": "changed", "c": "stale"}


def test_timeline(spark):
    s = spark.createDataFrame([("t", 1, "s1", "abcd", "abcd", 10.0), ("t", 2, "s2", "efgh", "efgh", 10.0)], "task_id string, timeline_order int, section_id string, voice_text string, tts_text string, audio_duration_s double")
    items = spark.createDataFrame([("t", "abc", 0.0, 4.0, 0, 3), ("t", "defgh", 5.0, 10.0, 3, 8)], "task_id string, text string, start_s double, end_s double, char_start int, char_end int")
    got = timeline.aligned_sections(s, items).orderBy("timeline_order").select("timing_source", "start_s", "end_s")
    assert rows(got) == [("character_offsets", 0.0, pytest.approx(5.6, abs=0.11)), ("character_offsets", pytest.approx(5.6, abs=0.11), 10.0)]
    none = items.filter("false")
    got = timeline.aligned_sections(s, none).orderBy("timeline_order").select("timing_source", "start_s", "end_s")
    assert rows(got) == [("proportional", 0.0, 5.0), ("proportional", 5.0, 10.0)]


def test_dashboard(spark):
    st = spark.createDataFrame([({"copy": "done", "tts": "failed"},), ({"copy": "running"},)], "s map<string,string>")
    out = st.select(dashboard.current_stage(F.col("s")).alias("c"), dashboard.failed_stage(F.col("s")).alias("f")).collect()
    assert [tuple(r) for r in out] == [("retrieve", "tts"), ("copy", None)]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, o int, v int").coalesce(1).write.parquet(src)
    schema = "k string, o int, v int"
    sink = streams.upsert_into(out, ["k"], "o")
    streams.run_available(streams.file_stream(spark, src, schema), sink, str(tmp_path / "ck"))
    spark.createDataFrame([("a", 2, 11)], schema).coalesce(1).write.mode("append").parquet(src)
    streams.run_available(streams.file_stream(spark, src, schema), sink, str(tmp_path / "ck"))
    assert sorted(rows(spark.read.parquet(f"{out}/v1"))) == [("a", 2, 11), ("b", 1, 20)]


def test_sources_and_sinks(spark, tmp_path):
    from tidemark.sources import readers, writers

    (tmp_path / "a.json").write_text('{"rows": [{"id": "x"}, {"id": "y"}]}')
    (tmp_path / "b.json").write_text('[{"id": "z"}]')
    (tmp_path / "c.json").write_text("{broken")
    texts = readers.read_texts(spark, str(tmp_path), "*.json")
    got = readers.container_rows(texts.filter(~F.col("path").contains("c.json")), "id string", "rows").select("row.id").collect()
    assert sorted(r[0] for r in got) == ["x", "y", "z"]
    wanted = texts.select("path").unionByName(spark.createDataFrame([("nope",)], "path string"))
    state = {r.path.rsplit("/")[-1]: (r.exists, r.valid_json) for r in readers.document_state(wanted, texts).collect()}
    assert state["c.json"][1] is None or state["c.json"][1] is False
    assert state["nope"][0] is False
    best = readers.preferred(texts.withColumn("k", F.lit(1)).withColumn("n", F.element_at(F.split("path", "/"), -1)).select("k", "n", "value"), ["k"], "n", ["q.json", "b.json", "a.json"])
    assert best.first().n == "b.json"
    target = str(tmp_path / "t")
    writers.promote(spark.range(3), target)
    writers.write_back(writers.promoted(spark, target).withColumn("id", F.col("id") + 1), target, 2)
    assert sorted(r[0] for r in writers.promoted(spark, target).collect()) == [1, 2, 3]
    assert writers.promote(spark.range(9), target, 1) is False and writers.promoted(spark, target).count() == 3
    with writers.locked(spark, target), pytest.raises(RuntimeError):
        writers.promote(spark.range(5), target, 3)
    assert writers.promote(spark.range(5), target, 3) and writers.promoted(spark, target).count() == 5
    rows_ = [(f"{i}|b", i) for i in range(50, 0, -1)]
    lines = writers.report_lines(spark.createDataFrame(rows_, "x string, y int").coalesce(2), ["x", "y"])
    assert [r[0] for r in lines.collect()][2:] == [f"| {i}\\|b | {i} |" for _, i in rows_]
    env = spark.createDataFrame([("# c\nA=1\nexport B='2'\nA=3\n",)], "value string")
    assert {r.key: r.value for r in readers.settings(env).collect()} == {"A": "1", "B": "2"}
    sse = spark.createDataFrame([(1, 'data: {"a":1}'), (2, "event: x"), (3, "data: [DONE]"), (4, 'data: {"b":1}')], "n int, value string")
    assert readers.events_from_stream_text(sse).count() == 1


def test_orchestration(spark):
    def bad():
        raise ValueError("no")

    states = orchestration.run_stages([("a", lambda: None), ("b", bad), ("c", lambda: None)])
    assert states["a"] == "done" and states["b"].startswith("failed") and states["c"] == "pending"
    out = orchestration.run_queue(spark, {"x": lambda: spark.range(5).count(), "y": bad})
    assert out["x"] == ("done", 5) and out["y"][0] == "failed"




def test_calls(spark):
    from tidemark.operators import calls

    df = spark.createDataFrame([("a", "tags", "text", "x", True), ("b", "tags", "text", "bad", True), ("c", "asr", "text", "short", True), ("d", "asr", "text", "", False)], "shot_id string, channel string, mode string, value string, enabled boolean")
    def make():  # nested, so that workers need no module of tests
        def call(value):
            if value == "bad":
                raise TimeoutError("Bearer abcdefghijklmnop")
            return [1.0] * (3 if value == "short" else 4)

        return call

    got = {r.shot_id: (r.status, r.error) for r in calls.embed_channels(df, make, 4).collect()}
    assert got == {"a": ("ok", None), "b": ("failed", "TimeoutError: Bearer <redacted>"), "c": ("failed", "invalid result")}
    out = spark.range(1).select(calls.stored_url(F.lit('{"url": "oss://b/k"}')).alias("a"), calls.stored_url(F.lit("done\nurl: oss://b/z ok")).alias("b"), calls.stored_url(F.lit("none")).alias("c")).first()
    assert tuple(out) == ("oss://b/k", "oss://b/z", None)


def test_clips(spark):
    from tidemark.functions.text import within_length
    from tidemark.operators import clips

    kids = spark.createDataFrame([([("a", 1.0), ("b", 3.0), ("c", 1.0), ("d", 5.0)],)], "k array<struct<shot_id:string,duration_s:double>>")
    run = kids.select(clips.child_run(F.col("k"), F.lit("b"), F.lit(6.0), F.lit("opening"), F.lit(2.5)).alias("r")).first().r
    assert [(x.shot_id, x.planned_s) for x in run] == [("b", 3.0), ("d", 3.0)]
    r = spark.range(1).select(
        clips.start_offset(F.lit(10.0), F.lit(4.0), F.lit(0.5), F.lit("opening"), F.lit(True)).alias("a"), clips.start_offset(F.lit(10.0), F.lit(4.0), F.lit(None).cast("double"), F.lit("proof"), F.lit(True)).alias("b"),
        clips.parent_clip(F.lit(1.0), F.lit(9.0), F.lit(2.0), F.lit(20.0), F.lit(30.0)).alias("c"), within_length(F.array(F.lit("ab。cd。"), F.lit("efg。hi。")), 10).alias("d"),
    ).first()
    assert (r.a, r.b, tuple(r.c), r.d) == (3.88, 3.9, (2.0, 9.0, 7.0), ["ab。cd。", "efg。"])


def test_records(spark):
    from tidemark.operators import records as R

    s = spark.createDataFrame([("s1", "防水测试，很好用", "", ["上脸"])], "k string, visual string, meaning string, keywords array<string>")
    got = {r.term: r.weight for r in R.section_terms(s, "k", ["防水"], {"visual": 1.1, "meaning": 1.0}).collect()}
    assert got == {"防水": 1.1, "上脸": 1.05, "防水测试": 0.55, "很好用": 0.55}
    units = spark.createDataFrame([("A", "u1", 0.4, 5.2), ("A", "u2", 20.0, 21.0)], "asset_id string, unit_id string, start_s double, end_s double")
    scenes = spark.createDataFrame([("A", 0, 0.0, 3.0), ("A", 1, 3.0, 6.0), ("A", 2, 6.0, 9.0)], "asset_id string, idx int, start_s double, end_s double")
    assert sorted((r.unit_id, r.start_s, r.end_s) for r in R.scene_bounds(units, scenes).collect()) == [("u1", 0.0, 6.0), ("u2", 20.0, 21.0)]
    runs = spark.createDataFrame([("r", True, True, 0, False), ("r", False, True, 1, False)], "run_id string, uploaded boolean, trimmed boolean, channels_failed int, needs_refine boolean")
    assert R.run_rollup(runs).first().warnings == ["uploads are missing", "channels failed"]
    prev = R.previous(spark.createDataFrame([("t", i, f"x{i}") for i in range(4)], "t string, i int, v string"), ["t"], "i", "v", 2)
    assert prev.orderBy("i").collect()[3].before == ["x1", "x2"]
    res = spark.createDataFrame([("a", "ok", "u"), ("b", "ok", "")], "shot_id string, status string, url string")
    assert R.all_done(res.select("shot_id"), res).first().complete is False
    c = spark.createDataFrame([("a", "p", None, 1.0, 4.0, None, None, 2.0, None, None, None, None)], "shot_id string, parent_shot_id string, time_range array<double>, start_s double, end_s double, usable_range array<double>, clip_actual_duration_s double, duration_s double, visual_summary string, source_meaning string, visual_actions array<string>, duplicate_status string")
    r = R.child_records(c).first()
    assert (r.start_s, r.usable_end, r.duration_s, r.duplicate_status) == (1.0, 4.0, 2.0, "unique")


def test_least_reachable_fails_unsettled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    with pytest.raises(RuntimeError):
        dedupe.least_reachable(path, rounds=1)
    assert {r.component for r in dedupe.least_reachable(path).collect()} == {0}


KID = dict(
    idx=0, shot_id="a", role="product", target_s=4.0, semantic=0.0, n_hard_hits=0, n_hits=0, n_parent_hits=0, verified=True, anchor=None, proof_anchor=None, duration_s=4.0,
    opening_reuse=0, duplicate_status=None, hard_subtitle_risk="low", hard_required=False, has_terms=True, preferred=False,
)
KID_SCHEMA = (
    "c string, idx int, shot_id string, role string, target_s double, semantic double, n_hard_hits int, n_hits int, n_parent_hits int, verified boolean, anchor double, "
    "proof_anchor double, duration_s double, opening_reuse int, duplicate_status string, hard_subtitle_risk string, hard_required boolean, has_terms boolean, preferred boolean"
)


def kids_of(spark, **groups):
    return spark.createDataFrame([("%s" % c, *(KID | {"idx": i, "shot_id": "abcdef"[i]} | k).values()) for c, ks in groups.items() for i, k in enumerate(ks)], KID_SCHEMA)


def test_child_scores_and_choice(spark):
    from tidemark.operators import records as R

    long_enough = 0.18 * 0.35
    kids = kids_of(
        spark,
        hard=[{"semantic": 5.0}, {"n_hard_hits": 1, "n_hits": 1}, {"n_hard_hits": 5, "n_hits": 5, "duplicate_status": "strong_duplicate"}],
        proof=[{"role": "proof", "n_parent_hits": 1, "verified": False}, {"role": "proof", "n_parent_hits": 1, "verified": False}],
        order=[{"anchor": 0.9}, {"anchor": 0.9}],
        opening=[{"role": "opening", "opening_reuse": 1}, {"role": "opening", "opening_reuse": 3}, {"role": "opening", "hard_subtitle_risk": "high"}],
        short=[{"duration_s": 1.0, "duplicate_status": "near_duplicate_candidate"}],
    ).withColumn("hard_required", F.col("c") == "hard")
    got = {(r.c, r.shot_id): (r["rank"], r.child_score) for r in R.rank_children(kids, ["c"]).collect()}
    near = lambda x: pytest.approx(x, abs=1e-6)
    assert got == {
        ("hard", "b"): (2, near(1.8 + 0.42 + long_enough)), ("hard", "c"): (1, near(1.8 + 1.6 - 0.22 + long_enough)),
        ("proof", "a"): (2, near(-0.4 - 0.28 - 0.08 + long_enough)), ("proof", "b"): (1, near(0.9 - 0.28 - 0.08 + long_enough)),
        ("order", "a"): (2, near(long_enough)), ("order", "b"): (1, near((0.42 - 0.15) * 0.45 + long_enough)),
        ("opening", "a"): (2, near(long_enough - 0.72)), ("opening", "b"): (3, near(long_enough - 1.4)), ("opening", "c"): (1, near(long_enough - 0.35)),
        ("short", "a"): (1, near(long_enough - 0.24)),
    }
    wish = {"preferred": True}
    kids = kids_of(
        spark,
        taken=[{"semantic": 9.0}, wish], hard=[{"n_hard_hits": 1, "n_hits": 1}, wish | {"semantic": 9.0}],
        proof=[{"role": "proof", "semantic": 9.0, "n_hits": 1}, wish | {"role": "proof", "n_parent_hits": 1}], opening=[{"role": "opening"}, wish | {"role": "opening", "opening_reuse": 1}],
        copy=[{}, wish | {"duplicate_status": "strong_duplicate"}], best=[wish | {"duplicate_status": "strong_duplicate", "semantic": 9.0}, {}], none=[{}, {"semantic": 1.0}],
    ).withColumn("hard_required", F.col("c") == "hard")
    got = {r.c: (r.shot_id, r.by) for r in R.choose_child(kids, R.rank_children(kids, ["c"]), ["c"]).collect()}
    score = ("a", "score")
    assert got == {"taken": ("b", "planner"), "hard": score, "proof": score, "opening": score, "copy": score, "best": ("a", "planner"), "none": ("b", "score")}


def test_clip_rules(spark):
    from tidemark.functions import scoring as G
    from tidemark.operators import clips

    null = F.lit(None).cast("string")
    kids = spark.createDataFrame([([("a", 1.0), ("b", 1.5), ("c", 1.0)],)], "k array<struct<shot_id:string,duration_s:double>>")
    run = lambda chosen, packaging=False: clips.child_run(F.col("k"), F.lit(chosen), F.lit(6.0), F.lit("product"), F.lit(2.5), F.lit(packaging))
    own = lambda packaging, offset: clips.clip_run(F.col("k"), F.lit("b"), F.lit(6.0), F.lit("cta"), F.lit(0.5), F.lit(packaging), F.lit("u"), F.lit(8.0), F.lit(offset), F.lit(0.5))
    r = kids.select(run("b").alias("a"), run("b", True).alias("b"), own(False, 5.0).alias("c"), own(True, 5.0).alias("d"), own(False, 8.0).alias("e")).first()
    assert [[tuple(x) for x in c] for c in r] == [
        [("b", 0.0, 1.5, True)], [("a", 0.0, 1.0, True)], [("u", 5.5, 2.5, False)], [("u", 0.5, 6.0, False)], [("b", 0.0, 1.5, False), ("c", 0.0, 1.0, False)],
    ]
    off = lambda d, p, a, role, act=True: clips.start_offset(F.lit(d), F.lit(p), F.lit(a).cast("double"), F.lit(role), F.lit(act))
    r = spark.range(1).select(
        off(10.0, 9.7, 0.5, "proof").alias("a"), off(10.0, 4.0, 0.5, "proof", False).alias("b"), off(10.0, 4.0, None, "product").alias("c"), off(10.0, 4.0, 0.99, "proof").alias("d"),
        G.is_verified(F.lit("parent_context_only"), null, F.lit(False)).alias("e"), G.is_verified(null, F.lit("video_only_until_child_vlm_refine"), F.lit(False)).alias("f"),
        G.is_verified(null, null, F.lit(True)).alias("g"), G.is_verified(F.lit("highlight_overlap"), null, F.lit(True)).alias("h"), G.is_verified(null, null, null.cast("boolean")).alias("i"),
        G.loop_enabled(F.lit(None).cast("boolean"), F.lit("no-loop")).alias("j"), G.loop_enabled(F.lit(False), F.lit("Loop Disabled")).alias("k"), G.loop_enabled(F.lit(False), F.lit(""), F.lit("loop_short")).alias("l"),
        G.valid_url(F.lit("oss://b/" + "k" * 80 + ".MP4")).alias("m"), G.valid_url(F.lit("oss://b/k.mp4")).alias("n"), G.valid_url(F.lit("https://b/" + "k" * 80 + ".mp4")).alias("o"),
        G.valid_url(F.lit("oss://b/" + "k" * 80 + "\nx.mp4")).alias("p"), G.duration_score(F.lit(2.0), F.lit(4.0)).alias("q"), G.duration_score(F.lit(20.0), F.lit(4.0)).alias("r"),
    ).first()
    assert list(r) == [0.0, 0.0, 0.0, 6.0, False, False, False, True, True, True, False, True, True, False, False, False, pytest.approx(-0.11), pytest.approx(0.10)]


def test_selection_rules(spark):
    base = dict(task_id="t", section_order=1, shot_id=1, unit_id=1, asset_id=1, score=1.0, duration_s=4.0, budget_s=4.0)

    def picked(*rows, **kw):
        keys = sorted({k for r in rows for k in r} | set(base))
        df = spark.createDataFrame([tuple((base | {"shot_id": i, "unit_id": i, "asset_id": i} | r).get(k) for k in keys) for i, r in enumerate(rows)], ", ".join(f"{k} {KINDS[k]}" for k in keys))
        return [(r.shot_id, r.strategy) for r in selection.select_sections(df, **kw).orderBy("section_order", "clip_order").collect()]

    KINDS = {"task_id": "string", "section_order": "int", "shot_id": "int", "unit_id": "int", "asset_id": "int", "score": "double", "duration_s": "double", "budget_s": "double"} | {k: v for k, (v, _) in selection.OPTIONAL.items()}
    seen = {"visual_score": 3.0, "semantic_score": 2.0}
    assert picked({}, {"score": 0.5} | seen) == [(1, "single")]  # what is long and means the right thing, before the better score
    assert picked({"duration_s": 2.6, "semantic_score": 2.0, "hits": ["x"], "budget_s": 6.0}, {"duration_s": 3.4, "semantic_score": 1.7, "hits": ["x"], "score": 0.4, "budget_s": 6.0}, {"duration_s": 9.0, "budget_s": 6.0}) == [(0, "several"), (1, "several")]
    far = {"duration_s": 3.0, "semantic_score": 2.0, "budget_s": 9.0, "allowed_top_up": False}
    pair = lambda **kw: picked({"hits": ["x"]} | far, {"hits": ["y"], "score": 0.5} | far | kw)
    assert pair() == [(0, "several")]  # a hit of another kind is no reason
    assert pair(query_terms=["y"]) == pair(asset_id=0) == pair(hits=["y", "x"]) == [(0, "several"), (1, "several")]
    hit = {k: v for k, v in zip(("needs_child_hit", "hard_hits"), (True, 1))}
    assert picked({"needs_child_hit": True, "hard_hits": 0}, {"score": 0.1} | hit) == [(1, "single")]
    assert picked({"needs_child_hit": True, "hard_hits": 0}, {"score": 0.1, "needs_child_hit": True, "hard_hits": 0}) == [(0, "single")]
    assert picked({"role": "opening", "opening_pressure": 4}, {"role": "opening", "opening_pressure": 1, "score": 0.2}, {"role": "opening", "opening_pressure": 1, "score": 0.1, "visual_score": 1.0}) == [(2, "single")]
    assert picked({"role": "opening", "opening_pressure": 4}, {"role": "opening", "opening_pressure": 4}) == [(0, "single")]
    long_ = {"budget_s": 8.0}
    assert picked({"planner_order": 1.0, "hits": ["x"]} | long_, {"score": 0.9} | long_, {"score": 0.5, "hits": ["x"]} | long_) == [(0, "planner"), (2, "planner")]
    assert picked({"planner_order": 1.0, "packaging": True} | long_, {"score": 0.9, "packaging": True} | long_) == [(0, "planner")]
    assert picked({"override_order": 1.0, "role": "opening", "opening_pressure": 9} | long_, {} | long_) == [(0, "override")]
    assert picked({"allowed": False}, {"renderable": False}, {"score": 0.1}) == [(2, "single")]
    picks = spark.createDataFrame(
        [("a", 1.0, True, 0.0, "single", False, "low"), ("b", 3.0, False, 1.0, "several", False, "high"), ("b", 1.0, True, 1.0, "several", False, "medium"), ("c", -1.0, False, 0.0, "override", True, None)],
        "s string, score double, hit boolean, gap_s double, strategy string, override boolean, hard_subtitle_risk string",
    )
    got = {r.s: r.confidence for r in selection.confidence(picks, ["s"]).collect()}
    assert got == {"a": 0.9, "b": pytest.approx(0.52 + 0.24 + 0.06 - 0.28 - 0.18), "c": 0.78}


def test_allocation_of_runs():
    from types import SimpleNamespace as N

    def r(shot, duration=9.0, **kw):
        return N(**({"shot_id": shot, "duration_s": duration, "packaging": False, "role": "product", "own_file": False, "parent_offset_s": 0.0, "inner_offset_s": 0.0, "chosen_child": "", "children": []} | kw))

    def clips(*rows, budget=8.0):
        plan, gap = selection.planned_clips(list(rows), budget)
        return [(c, at, s, short) for _, c, at, s, short in plan], gap

    kids = lambda *ds: [{"shot_id": f"k{i}", "duration_s": d} for i, d in enumerate(ds)]
    # A file is used from its chosen child on; packaging from its start.
    assert clips(r("a", own_file=True, parent_offset_s=2.0, inner_offset_s=0.5)) == ([("a", 2.5, 6.5, False)], 1.5)
    assert clips(r("a", own_file=True, parent_offset_s=2.0, packaging=True)) == ([("a", 0.0, 8.0, False)], 0.0)
    # A chosen child at the file's very end leaves only the children.
    assert clips(r("a", 2.0, own_file=True, parent_offset_s=1.98, children=kids(3.0, 3.0, 3.0))) == ([("k0", 0.0, 3.0, False), ("k1", 0.0, 3.0, False)], 2.0)
    assert clips(r("a", role="proof", chosen_child="k1", children=kids(1.0, 2.6, 2.7, 2.8))) == ([("k1", 0.0, 2.6, False), ("k2", 0.0, 2.7, False), ("k3", 0.0, 2.7, False)], 0.0)
    # Short children wait over all candidates; one stands in only if there is nothing else.
    assert clips(r("a", children=kids(1.0, 0.5)), r("b", children=kids(2.0, 6.0))) == ([("k1", 0.0, 6.0, False)], 2.0)
    assert clips(r("a", children=kids(1.0, 0.5)), r("b", 0.7)) == ([("k0", 0.0, 1.0, True)], 7.0)
    # Less than the least length is no reason to begin another candidate.
    assert clips(r("a", 7.0), r("b", 9.0)) == ([("a", 0.0, 7.0, False)], 1.0)
    assert clips(r("a", 0.0), r("b", 4.0, inner_offset_s=1.0), budget=2.0) == ([("b", 1.0, 2.0, False)], 0.0)
    assert clips() == ([], 8.0)


def test_nation_texts_join_last(spark, sf):
    from tidemark.plans.record_queries import join_fallback_key

    plan = join_fallback_key(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if " Join " in line]
    assert "c_nationkey" in joins[0] and "rightHint=(strategy=broadcast)" in joins[0]  # no shuffle carries a text for each order
    gathered = [i for i, line in enumerate(plan) if "collect_list" in line and "none" in line]
    assert not gathered  # children without a key are not one group


def test_nation_texts_are_written_once_a_task(spark, tmp_path):
    """some 2,900 of the 5,000 orders have one of 25 texts of 57 KB, over 1 MB together; files hold a text a few times, not for each order."""
    from tidemark.plans.record_queries import join_fallback_key

    base = 10**18
    spark.range(75_000).select((F.col("id") + base).alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") + base + 74_000).alias("o_custkey"))
    orders.unionByName(spark.sql("SELECT -7L AS o_orderkey, 1L AS o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    join_fallback_key(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(x.stat().st_size for x in (tmp_path / "out").iterdir()) < 10 << 20
    out = spark.read.parquet(f"{tmp_path}/out").select("o_orderkey", F.md5("kids").alias("kids"))
    got = {r.o_orderkey: r.kids for r in out.collect()}

    def kids(o):
        if o % 3 == 0 and o + 74_000 < 75_000:
            return [c for c in (o + 74_000, o + 74_001) if c < 75_000]
        return range(o % 40, 75_000, 25) if 0 <= o and o % 40 < 25 else []

    md5 = lambda xs: hashlib.md5(",".join(str(base + c) for c in xs).encode()).hexdigest()
    texts = {n: md5(range(n, 75_000, 25)) for n in range(25)}
    assert out.count() == len(got) == 5001
    for o, k in got.items():
        own = kids(o)
        assert k == (texts[o % 40] if len(own) > 2 else md5(own))


def test_tasks_follow_rows(spark):
    from tidemark.operators import selection as S

    rows = spark.range(1000)
    assert S.parts_of(rows, 50) == 20 and S.parts_of(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = spark.createDataFrame([(1, t, "part", str(k), 1 + k % 2) for t in range(30) for k in range(t % 7)], "b int, t int, kind string, key string, n long")
    got = S.others(facts, "b", "t", 23)
    assert got._jdf.queryExecution().executedPlan().toString().count(", 23)") >= 2
    assert sorted(got.collect()) == sorted(S.others(facts, "b", "t").collect())
