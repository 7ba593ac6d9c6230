"""Job, model and source operators on small tables."""

import random
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechprep.operators import checks, folds, jobs, models, quantiles
from speechprep.operators.quantiles import percentiles
from speechprep.sources import tables

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_quotes_are_spoken_apart(spark):
    def voice(text, params, seed):
        return np.full(4000, params.get("temperature", 0.0))

    rows = [("j", 0, 'He said "yes, I do" and left.', {"temperature": 0.3}, 1), ("j", 1, "No quote here.", {"temperature": 0.2}, 1), ("j", 2, '"All of it."', None, 1)]
    df = spark.createDataFrame(rows, "job_id string, seg_idx int, text string, params map<string,double>, seed int")
    got = {r.seg_idx: np.array(r.samples) for r in models.speak(df, voice, 8000).collect()}
    assert got[0].size == 3 * 4000 + 2 * 640 and got[1].size == 4000 and got[2].size == 4000
    assert got[0][0] == np.float32(0.3) and got[0][4000:4640].max() == 0 and got[0][4640] == np.float32(0.45)
    assert got[2][0] == np.float32(0.45)


def test_limiter_counts_only_accepted(spark):
    log = spark.createDataFrame([("a", at(t)) for t in (0, 10, 20, 30, 65, 66, 67)], "key string, ts timestamp")
    got = [r.accepted for r in folds.rate_limited(log, 3, 60).orderBy("ts").collect()]
    assert got == [True, True, True, False, True, False, False]


def test_state_and_outcomes(spark):
    ev = spark.createDataFrame([("j", at(0), "processing", None), ("j", at(5), "completed", "local://x")], "job_id string, ts timestamp, status string, audio_uri string")
    r = jobs.job_state(ev, ["status", "audio_uri"]).first()
    assert (r.status, r.audio_uri) == ("completed", "local://x")
    subs = spark.createDataFrame([("j", at(-1)), ("k", at(0)), ("m", at(0))], "job_id string, ts timestamp")
    ev = ev.unionByName(spark.createDataFrame([("k", at(60), "processing", None)], ev.schema))
    assert {r.job_id: r.outcome for r in jobs.job_outcome(subs, ev).collect()} == {"j": "completed", "k": "not finished", "m": "no status"}


def test_overlay_and_checks(spark):
    d = spark.createDataFrame([(0.9, 50)], "temperature double, top_k int")
    o = spark.createDataFrame([("a", None, 10), ("b", 0.0, None)], "id string, temperature double, top_k int")
    assert sorted(map(tuple, jobs.effective_params(d, o, ["temperature", "top_k"]).collect())) == [("a", 0.9, 10), ("b", 0.0, 50)]
    m = spark.createDataFrame([(0.5, -16.0, 0), (-3.0, -22.0, 0), (-3.0, -16.0, 3), (-3.0, -16.0, 4), (None, None, None)], "true_peak_dbfs double, integrated_lufs double, long_silence_gaps int").withColumn("target_lufs", F.lit(-16.0))
    assert [r.reason for r in checks.final_gate(m).collect()] == ["true peak", "loudness", None, "silence gaps", None]
    ip = spark.createDataFrame([("1.1.1.1, 2.2.2.2, 3.3.3.3",), ("9.9.9.9",), (None,)], "xff string")
    assert [r.ip for r in ip.select(checks.client_ip(F.col("xff"), F.lit("p"), 1).alias("ip")).collect()] == ["2.2.2.2", "9.9.9.9", "p"]


def test_defaults_may_be_missing(spark):
    d = spark.createDataFrame([], "temperature double, top_k int")
    o = spark.createDataFrame([("a", None, 10), ("b", 0.5, None)], "voice string, temperature double, top_k int")
    assert [tuple(r) for r in jobs.effective_params(d, o, ["temperature", "top_k"]).orderBy("voice").collect()] == [("a", None, 10), ("b", 0.5, None)]


def test_sites_by_automaton(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab.") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    sites = [(rng.randrange(20), f"s{k}", n) for k, n in enumerate(names)]
    found = jobs.Hostnames(sites)
    for _ in range(3000):
        host = "".join(rng.choice("abc.") for _ in range(rng.randrange(9)))
        assert found.slug(host) == min(((r, s) for r, s, n in sites if n in host), default=(0, None))[1]
    urls = spark.createDataFrame([("http://x.aa.b/p",), (None,), ("nothing",), ("https://zz.zz:80/x",), ("https://m4999.com?q",)], "url string")
    many = spark.createDataFrame([(k, f"slug{k}", f"m{k}.com") for k in range(9_990)] + [(0, "first", "aa.b")], "rank int, slug string, hostname string")
    out = jobs.route_site(urls, many)
    assert [r.site_slug for r in out.collect()] == ["first", "", "", "zz-zz", "slug4999"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="over 5 sites"):
        jobs.route_site(urls, many, 5)


def test_snapshots_of_any_split_merge_to_the_whole(spark):
    rng = random.Random(6)
    rows = [(k, f"j{rng.randrange(6)}", T0 + dt.timedelta(seconds=rng.randrange(40)), rng.choice(["a", "b", None]), rng.choice(["x", "y", None])) for k in range(200)]
    schema, fields = "event_id long, job_id string, ts timestamp, status string, error string", ["status", "error"]
    whole = sorted(map(tuple, jobs.job_state(spark.createDataFrame(rows, schema), fields).collect()))
    for n in (1, 2, 5):
        rng.shuffle(rows)
        snapshot = jobs.job_snapshot(spark.createDataFrame(rows[:0], schema), fields)
        for k in range(n):  # with some events twice
            snapshot = jobs.merge_snapshots(snapshot, jobs.job_snapshot(spark.createDataFrame(rows[k::n] + rows[:7], schema), fields))
        assert sorted(map(tuple, jobs.state_of(snapshot).collect())) == whole


def test_days_are_dropped_whole(spark, tmp_path):
    path, day = str(tmp_path / "dated"), dt.timedelta(days=1)
    rows = [(k, T0 + k * day / 2) for k in range(8)] + [(99, None)]
    tables.write_dated(spark.createDataFrame(rows, "id long, ts timestamp"), path, "ts")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "dated").rglob("*.parquet")}
    assert tables.drop_expired(spark, path, 86_400, T0 + 3 * day) == ["date=2024-01-01", "date=2024-01-02"]
    assert spark.read.parquet(path).count() == 9  # nothing but said
    assert tables.drop_expired(spark, path, 86_400, T0 + 3 * day, dry_run=False) == ["date=2024-01-01", "date=2024-01-02"]
    assert {r.id for r in spark.read.parquet(path).collect()} == {4, 5, 6, 7, 99}
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "dated").rglob("*.parquet")}
    assert left.items() <= files.items() and tables.drop_expired(spark, path, 86_400, T0 + 3 * day, dry_run=False) == []


def test_wide_and_broken_wav(spark, tmp_path):
    import io
    import wave

    def wav(width, raw):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        return out.getvalue()

    (tmp_path / "a24.wav").write_bytes(wav(3, b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 23), (1 << 23) - 1))))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    (tmp_path / "c8.wav").write_bytes(wav(1, bytes([128, 192, 0])))
    got = {r.path[-7:]: r for r in tables.read_clips(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a24.wav"].samples == pytest.approx([0, 0.5, -1, 1], abs=1e-6) and got["a24.wav"].error is None
    assert got["/c8.wav"[-7:]].samples == [0, 0.5, -1]
    broken = next(r for p, r in got.items() if p.endswith("b.wav"))
    assert broken.samples is None and broken.error


@pytest.mark.parametrize(("p", "most"), [(0.5, 40), (0.05, 10**6)])
def test_percentiles_of_large_groups_are_exact(spark, p, most):
    rng = np.random.default_rng(8)
    groups = {"hot": rng.lognormal(0, 4, 3001), "same": np.full(500, 2.5), "two": np.array([1.0] * 200 + [7.0] * 200), "far": np.concatenate([[-1e300, 1e300], rng.normal(size=60)]), "few": rng.normal(size=9), "one": np.array([3.0]), None: rng.integers(0, 5, 400) * 1.0}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("hot", None), ("nan", float("nan")), ("nan", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.value) for r in percentiles(df, ["k"], "v", p, most).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k][0] == len(values) and got[k][1] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_a_hot_group_is_counted_before_it_is_shuffled(spark):
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as k", "cast(id * 7919 % 60000 as double) as v")
    large = spark.createDataFrame([("hot", 20_000, 0.0, 59_999.0, 9_999, 0, 20_000)], "k string, n long, low double, high double, rank long, below long, left long")
    step = quantiles._narrowed(df.withColumnRenamed("v", "value"), large, ["k"])
    got = step.first()
    assert got.left <= 2 * (20_000 // quantiles.BINS + 2) and got.below <= 9_999 and got.below + got.left > 9_999
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "BroadcastHashJoin" in plan


def test_payload_shapes(spark):
    post = {"id": "1", "slug": "s"}
    shapes = [{"post": {"current": post}}, {"current": post}, {"post": post}, {"body": {"post": {"current": post}}}, {"body": {"post": post}}, post]
    df = spark.createDataFrame([(json.dumps(s),) for s in shapes] + [("not json",)], "raw string")
    assert [(r.post_id, r.slug) for r in tables.extract_post(df).collect()] == [("1", "s")] * 6 + [(None, None)]


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(800) / 10).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(tables.encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"broken")
    got = {r.path[-5:]: r for r in tables.read_clips(spark, str(tmp_path)).collect()}
    assert got["b.wav"].samples is None and got["a.wav"].sr == 8000
    assert np.abs(np.array(got["a.wav"].samples) - x).max() < 1e-3
    tables.write_clips(spark.createDataFrame([("j", 8000, [float(v) for v in x])], "job_id string, sr int, samples array<float>"), str(tmp_path / "out"))
    sr, y = tables.decode_wav(bytes(spark.read.parquet(str(tmp_path / "out")).first().wav))
    assert sr == 8000 and y.size == 800


def test_metrics_table(spark):
    ev = spark.createDataFrame([("queued", 0.5), ("completed", 7.0)], "status string, duration_s double")
    lines = {r.line for r in tables.metrics_table(jobs.job_counters(ev), jobs.duration_histogram(ev, "duration_s", [1, 10]), "job").collect()}
    assert {"jobs_created 1.0", 'job_bucket{le="1.0"} 1.0', 'job_bucket{le="Infinity"} 2.0'} <= lines


def test_rewrite_rounds(spark):
    def fn(messages):
        text = messages[-1]["content"]
        return text.split("\n\n", 1)[1] if "Tell it" in text else " ".join(text.split()[: len(text.split()) // 2])

    chunks = spark.createDataFrame([(1, 0, "one two three four five six seven eight"), (1, 1, "a b"), (2, 0, "x y z w")], "doc_id long, seg_idx int, text string")
    got = {(r.doc_id, r.seg_idx): (r.passed, r.rounds) for r in models.rewrite_with_checks(chunks, fn).collect()}
    assert got == {(1, 0): (True, 1), (1, 1): (True, 1), (2, 0): (True, 1)}
    ordered = chunks.withColumn("messages", models.chat("s"))
    out = {(r.doc_id, r.seg_idx): r.output for r in models.rewrite(ordered, lambda m: str(len(m)), ordered=True).collect()}
    assert out == {(1, 0): "2", (1, 1): "3", (2, 0): "2"}
    done = chunks.withColumn("output", F.lit("o"))
    fixed = models.completeness(done, lambda m: '["b"]' if "List" in m[-1]["content"] else "new")
    assert {r.output for r in fixed.collect()} == {"new"}
    assert {r.output for r in models.completeness(done, lambda m: "?").collect()} == {"o"}


def test_retry_rounds(spark):
    segs = spark.createDataFrame([("j", 0, "one two three, four five six seven"), ("j", 1, "short one"), ("k", 0, "never, never, never, never passes here now")], "job_id string, seg_idx int, text string")

    def gate(clips):
        return clips.select("job_id", "seg_idx", (((F.col("job_id") == "j") & (F.col("word_count") <= 4))).alias("passed"))

    def voice(text, params, seed):  # 0.40 s of a sine for each word
        return 0.3 * np.sin(2 * np.pi * (110 + seed % 50) * np.arange(int(0.4 * max(len(text.split()), 1) * 8000)) / 8000)

    got = {(r.job_id, r.seg_idx): (r.passed, r["round"]) for r in models.retry_rounds(segs, voice, gate).collect()}
    assert got == {("j", 0): (True, 2), ("j", 1): (True, 0), ("k", 0): (False, 4)}


def test_objects_are_written_by_site(spark, tmp_path):
    df = spark.createDataFrame([("007", "a", "x/007/a.mp3"), ("press", "b", "x/press/b.mp3"), ("press", "c", "x/press/c.mp3"), (None, "d", "d.mp3")], "site_slug string, job string, object string")
    path = str(tmp_path / "objects")
    tables.write_by_site(df, path)
    tables.write_by_site(df.filter("job = 'b'"), path)
    back = tables.read_by_site(spark, path, df.schema)
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, [*df.collect(), *df.filter("job = 'b'").collect()]), key=str)
    assert {f.split("/")[-2] for f in back.filter("site_slug = '007'").inputFiles()} >= {"site_slug=007"}
    assert [r.job for r in back.filter("site_slug = '007'").collect()] == ["a"]
    plan = back.filter("site_slug = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_slug" in plan


def test_clips_leave_the_worker_as_they_are_made(spark):
    """A voice that says how much memory (MB) its worker has; its 60 clips have 4 MB each and 240 MB together."""

    def voice(text, params, seed):
        with open("/proc/self/statm") as f:
            return np.full(1 << 20, int(f.read().split()[1]) * 4096 / 1e6)

    df = spark.range(0, 60, 1, 1).selectExpr("cast(id as string) as job_id", "0 as seg_idx", "'a word' as text", "map('temperature', 0.3D) as params", "1 as seed")
    held = [r.mb for r in models.speak(df, voice, 8000).select(F.array_max("samples").alias("mb")).collect()]
    assert len(held) == 60 and max(held) - held[0] < 120


def test_clips_of_retries_are_not_shuffled(spark):
    """Each round deals its texts over the session's partitions; their clips meet no join, and no round works on those before it."""
    plans = []

    def gate(clips):
        plans.append((clips._jdf.queryExecution().toString(), clips.rdd.getNumPartitions()))
        return clips.select("job_id", "seg_idx", (F.col("word_count") <= 5).alias("passed"))

    df = spark.range(0, 40, 1, 1).selectExpr("cast(id as string) as job_id", "0 as seg_idx", "trim(repeat('word ', cast(1 + id % 30 as int))) as text")
    got = {int(r.job_id): (r.round, r.passed) for r in models.retry_rounds(df, lambda text, params, seed: [0.1] * 9, gate).collect()}
    want = {i: (0 if n <= 5 else 2 if n <= 10 else 3 if n <= 20 else 4, n <= 20) for i in range(40) for n in (1 + i % 30,)}
    assert got == want
    assert len(plans) == 5 and all("Join" not in p and n == 4 for p, n in plans)
