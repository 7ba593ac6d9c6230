"""Streams give the rows of their batch twins."""

import datetime as dt
import json
import random
import re
import shutil
import time

import pytest
from pyspark.sql import functions as F

from speechprep.operators import folds, jobs
from speechprep.sources import posts
from speechprep.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drained(spark, df, name, mode="append"):
    """Rows once all input is worked; a query with state that expires by the clock would go on with empty batches."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        until = time.time() + 60
        while not (q.lastProgress and any(p["numInputRows"] for p in q.recentProgress) and not q.lastProgress["numInputRows"]) and time.time() < until and q.isActive:
            time.sleep(0.2)
        assert q.exception() is None, q.exception()
    finally:
        q.stop()
    return spark.table(name).collect()


def as_stream(spark, df, path):
    df.coalesce(1).write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def in_batches(spark, path, df, make, name, late_rows=(), n=6, seed=1):
    """``make(stream)``'s rows when the rows of ``df`` come shuffled over ``n`` files, one a batch; a row far ahead comes last, and then ``late_rows``.  Also how many rows were dropped as late."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    parts = [rows[k::n] for k in range(n)]
    key, end = rows[0][0], max(r.ts for r in rows) + dt.timedelta(days=30)
    path.mkdir()
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    sentinel = tuple(end if f == "ts" else ("end" if f == df.columns[0] else rows[0][f]) for f in df.columns)
    try:
        for part in [*parts, [sentinel], list(late_rows), [sentinel]]:
            if part:
                spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
                q.processAllAvailable()
        dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    finally:
        q.stop()
    assert key != "end"
    return [r for r in spark.table(name).collect() if r[0] != "end"], dropped


def test_limiter_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(k, at(t * (1 + ord(k) % 3))) for k in "abc" for t in (0, 10, 20, 30, 65, 66, 67, 130, 131, 190)], "key string, ts timestamp")
    got, dropped = in_batches(spark, tmp_path / "log", log, lambda s: S.rate_limit(s, 3, 60, "20 minutes"), "limited", [("a", at(5)), ("b", at(6))])
    assert {(r.key, r.ts): r.accepted for r in got} == {(r.key, r.ts): r.accepted for r in folds.rate_limited(log, 3, 60).collect()}
    assert len(got) == log.count() and dropped == 2


def test_machine_equals_batch(spark, tmp_path):
    kinds = ["queued", "processing", "paused", "resumed", "completed", "paused", "deleted", "processing"]
    ev = spark.createDataFrame([(j, at(17 * k), s) for j in "ab" for k, s in enumerate(kinds[:: 1 if j == "a" else -1])] + [("c", at(1), None)], "job_id string, ts timestamp, status string")
    want = {(r.job_id, r.ts, r.status, r.state, r.applied) for r in folds.job_states(ev).collect()}
    for k, ttl in enumerate((86_400, None)):
        got, dropped = in_batches(spark, tmp_path / f"ev{k}", ev, lambda s: S.job_machine(s, ttl, "10 minutes"), f"machine{k}", [("a", at(3), "paused")], seed=k)
        assert {tuple(r) for r in got} == want and len(got) == len(want) and dropped == 1
    assert [(r[3], r[4]) for r in sorted((x for x in want if x[0] == "a"), key=lambda x: x[1])] == [("queued", True), ("processing", True), ("paused", True), ("processing", True), ("completed", True), ("completed", False), ("deleted", True), ("deleted", False)]


def test_machine_forgets_in_event_time(spark, tmp_path):
    ev = spark.createDataFrame([("j", at(0), "deleted"), ("j", at(5000), "queued")], "job_id string, ts timestamp, status string")
    got, _ = in_batches(spark, tmp_path / "ev", ev, lambda s: S.job_machine(s, 600, "2 hours"), "forgot", n=1)
    assert [r.applied for r in sorted(got, key=lambda r: r.ts)] == [True, False]  # both came before the state could go
    path = tmp_path / "apart"
    path.mkdir()
    q = S.job_machine(spark.readStream.schema(ev.schema).parquet(str(path)), 600, "1 minute").writeStream.format("memory").queryName("apart").outputMode("append").start()
    for row in [("j", at(0), "deleted"), ("x", at(4000), "queued"), ("j", at(5000), "queued"), ("x", at(9000), "queued")]:
        spark.createDataFrame([row], ev.schema).coalesce(1).write.mode("append").parquet(str(path))
        q.processAllAvailable()
    q.stop()
    assert [(r.status, r.applied) for r in sorted(spark.table("apart").filter("job_id = 'j'").collect(), key=lambda r: r.ts)] == [("deleted", True), ("queued", True)]


def test_breaker_equals_batch(spark, tmp_path):
    calls = [(e, at(t * 20), (t + ord(e)) % 4 == 0) for e in "ef" for t in range(30)] + [("g", at(t), ok) for t, ok in ((0, False), (1, False), (2, False), (3, True), (70, True), (71, True))]
    calls = spark.createDataFrame(calls, "endpoint string, ts timestamp, ok boolean")
    got, dropped = in_batches(spark, tmp_path / "calls", calls, lambda s: S.breaker(s, late="1 hour"), "breaker", [("e", at(7), True)])
    assert {tuple(r) for r in got} == {tuple(r) for r in folds.breaker_states(calls).collect()} and len(got) == calls.count() and dropped == 1
    assert [(r.allowed, r.state) for r in sorted((r for r in got if r.endpoint == "g"), key=lambda r: r.ts)] == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_first_submission_and_metrics(spark, tmp_path):
    ev = spark.createDataFrame([("j", at(0), "queued", 0.5), ("j", at(5), "queued", 2.0), ("k", at(70), "completed", 20.0), ("z", at(4000), "queued", 1.0)], "job_id string, ts timestamp, status string, duration_s double")
    got = drained(spark, S.first_submissions(as_stream(spark, ev, tmp_path / "ev")), "firsts")
    assert sorted(r.job_id for r in got) == ["j", "k", "z"]
    rows = {r.start: r for r in drained(spark, S.metrics(as_stream(spark, ev, tmp_path / "ev2")), "metrics")}
    assert rows[T0].created == 2 and rows[T0].le_1 == 1 and rows[T0].n == 2


def test_posts_and_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"post": {"current": {"id": str(k), "status": s}}}) for k, s in ((1, "published"), (2, "draft"))))
    assert [r.post_id for r in drained(spark, S.stream_posts(spark, str(tmp_path / "in")), "posts")] == ["1"]
    docs = spark.createDataFrame([(1, "<p>One two.</p>"), (2, "a b c")], "doc_id long, text string")
    got = {(r.doc_id, r.seg_idx): (r.text, r.word_count) for r in drained(spark, S.stream_segments(as_stream(spark, docs, tmp_path / "docs")), "segments")}
    assert got == {(1, 0): ("One two.", 2), (2, 0): ("a b c", 3)}


POSTS = [f"{k:024x}" for k in range(40)]


@pytest.fixture
def blog(spark, tmp_path):
    table = str(tmp_path / "posts")
    posts.create(spark.createDataFrame([(p, f"<p>{p}</p>") for p in POSTS], "post_id string, html string"), table)
    return table


def called_back(spark, tmp_path, table, name, uris, checkpoint=None):
    """A stream of callbacks: post number -> address of its audio."""
    ev = spark.createDataFrame([(f"blog-pid-{POSTS[k]}-s-1", at(0), "completed", uri) for k, uri in uris.items()], "job_id string, ts timestamp, status string, audio_uri string")
    q = S.apply_callbacks(as_stream(spark, ev, tmp_path / name), table, checkpoint or str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def players(spark, table, number=None):
    rows = posts.read(spark, table, number).collect()
    assert sorted(r.post_id for r in rows) == POSTS
    return {POSTS.index(r.post_id): re.findall('src="([^"]*)"', r.html) for r in rows if "src=" in r.html}


def test_callbacks_move_the_table_on(spark, tmp_path, blog):
    called_back(spark, tmp_path, blog, "a", {0: "https://a", 1: "https://b"})
    assert players(spark, blog) == {0: ["https://a"], 1: ["https://b"]}
    old, new = posts.version(spark, blog, 0), posts.version(spark, blog)
    assert new.number == 1 and 1 <= sum(old.parts[k] != new.parts[k] for k in old.parts) <= 2
    assert players(spark, blog, 0) == {}


def test_a_second_stream_with_its_own_checkpoint(spark, tmp_path, blog):
    called_back(spark, tmp_path, blog, "a", {0: "https://a"})
    called_back(spark, tmp_path, blog, "b", {0: "https://c", 2: "https://b"})
    assert players(spark, blog) == {0: ["https://c"], 2: ["https://b"]}
    # the same place, but a checkpoint that begins anew
    shutil.rmtree(tmp_path / "b-cp")
    called_back(spark, tmp_path, blog, "c", {3: "https://d"}, str(tmp_path / "b-cp"))
    assert players(spark, blog) == {0: ["https://c"], 2: ["https://b"], 3: ["https://d"]}
    assert len(posts.version(spark, blog).epochs) == 3


def test_a_replayed_epoch_changes_nothing(spark, tmp_path, blog):
    called_back(spark, tmp_path, blog, "a", {0: "https://a"})
    before = posts.version(spark, blog)
    (tmp_path / "a-cp/commits/0").unlink()  # as if the driver had died between the table's commit and the stream's
    (tmp_path / "a-cp/commits/.0.crc").unlink(missing_ok=True)
    called_back(spark, tmp_path, blog, "a2", {})
    ev = spark.readStream.schema("job_id string, ts timestamp, status string, audio_uri string").parquet(str(tmp_path / "a"))
    assert S.apply_callbacks(ev, blog, str(tmp_path / "a-cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert (tmp_path / "a-cp/commits/0").exists()
    after = posts.version(spark, blog)
    assert after == before and players(spark, blog) == {0: ["https://a"]}


def test_a_crash_before_the_commit(spark, tmp_path, blog, monkeypatch):
    def dies(*_):
        raise OSError("gone")

    real = posts.commit
    monkeypatch.setattr(posts, "commit", dies)
    with pytest.raises(Exception, match="gone"):
        called_back(spark, tmp_path, blog, "a", {0: "https://a"})
    assert posts.version(spark, blog).number == 0 and players(spark, blog) == {}
    monkeypatch.setattr(posts, "commit", real)
    ev = spark.readStream.schema("job_id string, ts timestamp, status string, audio_uri string").parquet(str(tmp_path / "a"))
    assert S.apply_callbacks(ev, blog, str(tmp_path / "a-cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert players(spark, blog) == {0: ["https://a"]}


def test_writers_that_meet(spark, blog, monkeypatch):
    def stamped(word):
        return lambda df: df.withColumn("html", F.concat("html", F.lit(f' src="{word}"')))

    part = {k: r for k, r in enumerate(r.part for r in spark.createDataFrame([(p,) for p in POSTS], "post_id string").select(posts.part_of(F.col("post_id")).alias("part")).collect())}
    other = next(k for k in part if part[k] != part[0])
    real, met = posts.commit, []

    def late(spark, table, new):
        if not met:  # another writer comes first, to another part and then to the same one
            met.append(1)
            assert posts.update(spark, table, stamped("other"), [part[other]])
            assert posts.update(spark, table, stamped("first"), [part[0]])
        return real(spark, table, new)

    monkeypatch.setattr(posts, "commit", late)
    assert posts.update(spark, blog, stamped("second"), [part[0]])
    got = players(spark, blog)
    assert got[0] == ["first", "second"] and got[other] == ["other"]
    assert not posts.commit(spark, blog, posts.Version(1))  # a taken number
    assert not posts.update(spark, blog, stamped("x"), [posts.PARTS])


def test_vacuum_keeps_what_versions_name(spark, tmp_path, blog):
    for k in range(3):
        called_back(spark, tmp_path, blog, f"v{k}", {0: f"https://{k}"})
    posts._written(posts.read(spark, blog), blog)  # of a writer that died
    assert posts.vacuum(spark, blog) == []  # all too young
    gone = posts.vacuum(spark, blog, 1, -1, dry_run=True)
    assert len([x for x in gone if x.startswith("data/")]) == 3 and len([x for x in gone if x.startswith("commits/")]) == 3
    assert posts.vacuum(spark, blog, 1, -1) == gone
    assert players(spark, blog) == {0: ["https://2"]} and posts.vacuum(spark, blog, 1, -1) == []
    with pytest.raises(Exception):
        posts.read(spark, blog, 0)


def test_timeouts(spark, tmp_path):
    subs = spark.createDataFrame([("j", at(0)), ("k", at(1)), ("m", at(2)), ("late", at(100_000))], "job_id string, ts timestamp")
    st = spark.createDataFrame([("j", at(30), "processing"), ("j", at(900), "completed"), ("m", at(30), "processing"), ("late", at(100_000), "completed")], "job_id string, ts timestamp, status string")
    df = S.timeouts(as_stream(spark, subs, tmp_path / "s"), as_stream(spark, st, tmp_path / "t"))
    q = df.writeStream.format("memory").queryName("timeouts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {("k", "no status"), ("k", "not finished"), ("m", "not finished")}
    assert {(r.job_id, r.reason) for r in spark.table("timeouts").collect()} == want
    assert {(r.job_id, r.reason) for r in S.timeouts(subs, st).collect()} == want


def test_overdue_states(spark, tmp_path):
    ev = [("a", at(0), "processing"), ("a", at(40_000), "completed"), ("b", at(0), "paused"), ("b", at(100), "resumed"), ("c", at(5), "paused"), ("d", at(0), "paused"), ("d", at(3599), "processing"), ("d", at(3700), "completed"), ("z", at(200_000), "queued"), ("z", at(200_001), "completed")]
    ev = spark.createDataFrame(ev, "job_id string, ts timestamp, status string")
    want = {("a", "processing", at(0)), ("c", "paused", at(5))}
    for k in range(3):
        got, _ = in_batches(spark, tmp_path / f"ev{k}", ev, lambda s: S.overdue(s, late="3 days"), f"overdue{k}", seed=k, n=4)
        assert sorted(tuple(r) for r in got) == sorted(want)
    # the limit passes before the next event is there
    path = tmp_path / "apart"
    path.mkdir()
    q = S.overdue(spark.readStream.schema(ev.schema).parquet(str(path))).writeStream.format("memory").queryName("overdue_apart").outputMode("append").start()
    for row in [("a", at(0), "paused"), ("x", at(5000), "queued"), ("x", at(5100), "queued"), ("a", at(6000), "completed"), ("x", at(9000), "queued")]:
        spark.createDataFrame([row], ev.schema).coalesce(1).write.mode("append").parquet(str(path))
        q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("overdue_apart").collect()] == [("a", "paused", at(0))]
    assert want == {(r.job_id, r.status, r.since) for r in jobs.overdue(ev, F.lit(at(200_001)), S.LIMITS).collect()}
