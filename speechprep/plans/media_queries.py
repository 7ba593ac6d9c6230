"""Queries over clips, model calls and streams; clips are the vectors of ``embeddings`` or tones made from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from speechprep.operators import audio, checks, folds, jobs, models
from speechprep.plans.table_queries import ORACLES, QUERIES, _EV, _STATUS, events, query, sql_of, table, tones, total
from speechprep.plans.text_queries import SEGMENTS_OF_NORMALISED
from speechprep.sources import posts, tables
from speechprep.sources.shared import new_folder
from speechprep.streaming import jobs as streams

__all__ = ["ORACLES", "QUERIES"]

_CELLS = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _vectors(spark, d, job: str = "CAST(vec_id AS STRING)", seg: str = "CAST(0 AS INTEGER)", sr: int = 100, samples: str = "embedding"):
    return sql_of(spark, d, "embeddings", f"{job} AS job_id, {seg} AS seg_idx, {sr} AS sr, {samples} AS samples")


# files


@query("SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(44 + 2 * len(embedding) AS INTEGER) AS bytes FROM embeddings")
def s5_write_clips(spark, d):
    path = new_folder(spark, "clips")
    tables.write_clips(_vectors(spark, d), path)
    return spark.read.parquet(path).select("job_id", F.length("wav").alias("bytes"))


@query("SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(100 AS INTEGER) AS sr, CAST(len(embedding) AS INTEGER) AS n, embedding[1] * 32767 > 0.5 AS positive FROM embeddings")
def s4_read_clips(spark, d):
    """Clips written and read back as WAV bytes."""
    path = new_folder(spark, "clips")
    tables.write_clips(_vectors(spark, d), path)
    back = tables.decoded(spark.read.parquet(path), "job_id string", "wav").filter("error is null")
    return back.select("job_id", "sr", F.size("samples").alias("n"), (F.element_at("samples", 1) > 0).alias("positive"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def s10_drop_days(spark, d):
    """Events in folders by day, of which those past their time are removed whole."""
    path = new_folder(spark, "dated")
    tables.write_dated(table(spark, d, "events", "event_id", "ts"), path, "ts")
    tables.drop_expired(spark, path, 604_800, dt.datetime(2024, 1, 31), dry_run=False)
    return spark.read.parquet(path).select("event_id", "ts")


# clips


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN count(value) FILTER (event_type <> 'error') >= 10 THEN round(median(value) FILTER (event_type <> 'error'), 6) END AS f0 FROM events GROUP BY user_id")
def a8_median_f0(spark, d):
    fr = table(spark, d, "events", "cast(user_id as string) as job_id", "0 as seg_idx", "case when event_type <> 'error' then value end as f0")
    return audio.median_f0_of_frames(fr).select("job_id", F.round("f0", 6).alias("f0"))


_SHORT = "0.14 + 0.04 * (vec_id % 3)"
#: The clips of ``tones`` with ``_SHORT`` seconds at 4,000 samples a second.
_TONES_SQL = """SELECT CAST(vec_id AS VARCHAR) AS job_id, list_transform(range(CAST(floor((0.14 + 0.04 * (vec_id % 3)) * 4000 + 1e-6) AS INTEGER)), lambda i: CAST(CAST(0.3 * sin(i * hz * 2 * 3.141592653589793 / 4000) + 0.1 * w * sin(i * hz * 4 * 3.141592653589793 / 4000) AS FLOAT) AS DOUBLE)) AS s
FROM (SELECT vec_id, 90 + 60 * abs(CAST(embedding[1] AS DOUBLE)) + vec_id % 40 AS hz, coalesce(CAST(embedding[2] AS DOUBLE), 0.1) AS w FROM embeddings)"""
#: Magnitudes of the discrete Fourier transform of 512 samples under a Hann window, bin by bin.
_FLATNESS_SQL = f"""WITH c AS ({_TONES_SQL}),
fr AS (SELECT job_id, CAST(i AS INTEGER) AS frame_idx, list_transform(range(512), lambda n: s[i * 128 + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 511))) AS x FROM (SELECT job_id, s, unnest(range(greatest((len(s) - 512) // 128 + 1, 0))) AS i FROM c)),
m AS (SELECT job_id, frame_idx, sqrt(power(list_sum(list_transform(range(512), lambda n: x[n + 1] * cos(2 * pi() * (n * k % 512) / 512))), 2) + power(list_sum(list_transform(range(512), lambda n: x[n + 1] * sin(2 * pi() * (n * k % 512) / 512))), 2)) + 1e-10 AS m FROM fr, range(257) AS b(k)),
f AS (SELECT job_id, frame_idx, CASE WHEN avg(m) > 0.005 THEN exp(avg(ln(m))) / avg(m) END AS flatness FROM m GROUP BY job_id, frame_idx)"""


def _short_tones(spark, d):
    return tones(spark, d, _SHORT).drop("vec_id")


@query(f"{_FLATNESS_SQL} SELECT job_id, CAST(0 AS INTEGER) AS seg_idx, round(coalesce(avg(flatness), 0), 5) AS flatness FROM f GROUP BY job_id")
def a10_spectral_flatness(spark, d):
    return audio.mean_flatness(audio.frame_flatness(_short_tones(spark, d))).withColumn("flatness", F.round("flatness", 5))


@query(f"{_FLATNESS_SQL} SELECT job_id, CAST(0 AS INTEGER) AS seg_idx, frame_idx, round(flatness, 5) AS flatness FROM f")
def g4_frame_flatness(spark, d):
    return audio.frame_flatness(_short_tones(spark, d)).withColumn("flatness", F.round("flatness", 5))


@query(
    f"""WITH c AS ({_TONES_SQL}),
fr AS (SELECT job_id, CAST(i AS INTEGER) AS frame_idx, s[i * 60 + 1:i * 60 + 120] AS x FROM (SELECT job_id, s, unnest(range(greatest((len(s) - 120) // 60 + 1, 0))) AS i FROM c)),
z AS (SELECT job_id, frame_idx, list_transform(x, lambda v: v - list_avg(x)) AS x FROM fr),
r AS (SELECT job_id, frame_idx, list_sum(list_transform(x, lambda v: v * v)) AS r0, list_transform(range(8, 67), lambda g: list_sum(list_transform(range(120 - g), lambda n: x[n + 1] * x[n + 1 + g]))) AS r FROM z),
p AS (SELECT *, list_max(r) AS peak, list_position(r, list_max(r)) + 7 AS lag FROM r),
o AS (SELECT *, CASE WHEN lag // 2 >= 8 AND r[lag // 2 - 7] >= 0.9 * peak THEN lag // 2 ELSE lag END AS best FROM p)
SELECT job_id, CAST(0 AS INTEGER) AS seg_idx, frame_idx, round(CASE WHEN r0 > 1e-8 AND peak > 0.5 * r0 THEN 4000.0::DOUBLE / best END, 6) AS f0 FROM o"""
)
def g3_frame_f0(spark, d):
    return audio.frame_f0(_short_tones(spark, d)).withColumn("f0", F.round("f0", 6))


_POWERS = "CAST(user_id AS STRING) AS job_id, CASE WHEN event_id % 5 = 0 THEN value * 1e-10 WHEN event_id % 3 = 0 THEN value * 1e-6 ELSE value * 1e-4 END AS power"


@query(
    f"""WITH b AS (SELECT {_POWERS} FROM events), a AS (SELECT job_id, avg(power) FILTER (power > power_floor) AS mean FROM (SELECT *, power(10, -6.9309) AS power_floor FROM b) GROUP BY job_id)
SELECT a.job_id, round(-0.691 + 10 * log10(avg(b.power)), 6) AS integrated_lufs FROM a LEFT JOIN b ON b.job_id = a.job_id AND b.power > power(10, -6.9309) AND b.power > a.mean / 10 GROUP BY a.job_id"""
)
def a14_integrated_lufs(spark, d):
    return audio.gated_loudness(sql_of(spark, d, "events", _POWERS)).withColumn("integrated_lufs", F.round("integrated_lufs", 6))


@query()
def a14_final_metrics(spark, d):
    """Tones joined to jobs of five, measured across their borders and put through the final gate."""
    clips = tones(spark, d).withColumn("job_id", F.floor(F.col("vec_id") / 5).cast("string")).withColumn("seg_idx", (F.col("vec_id") % 5).cast("int")).withColumn("gap_ms", F.lit(250))
    found = audio.final_metrics(audio.join_clips(clips.drop("vec_id"))).withColumn("target_lufs", F.lit(-16.0))
    return checks.final_gate(found)


_PITCHED = "CAST(user_id AS STRING) AS job_id, 0 AS seg_idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS frame_idx, CASE WHEN event_type <> 'error' THEN value + 100 END AS f0, CASE WHEN user_id % 7 = 0 THEN 0.01 ELSE 0.05 END AS rms"


@query(
    f"""WITH fr AS (SELECT {_PITCHED} FROM events),
p AS (SELECT *, unnest([frame_idx // 5 - 1, frame_idx // 5]) AS w FROM fr),
g AS (SELECT job_id, w, median(f0) AS f0, count(f0) AS voiced, sqrt(avg(CAST(rms AS DOUBLE) * rms)) AS level FROM p WHERE w >= 0 GROUP BY job_id, w)
SELECT job_id, CAST(w AS INTEGER) AS "window", round(f0, 6) AS f0, abs(12 * log2(f0 / 110)) > 6 AS bad FROM g WHERE level >= 0.02 AND voiced >= 3"""
)
def w10_windowed_f0(spark, d):
    return audio.windowed_f0(sql_of(spark, d, "events", _PITCHED), 110.0, hop_s=0.3).select("job_id", "window", F.round("f0", 6).alias("f0"), "bad")


@query(
    f"""WITH c AS (SELECT vec_id, list_concat(list_transform(range(30), lambda i: 0.0::DOUBLE), {_CELLS}) AS s FROM embeddings),
l AS (SELECT *, len(s) // 2 AS nb, list_filter(range(0, len(s) // 2), lambda i: sqrt((s[2 * i + 1] * s[2 * i + 1] + s[2 * i + 2] * s[2 * i + 2]) / 2) > power(10, -2.5)) AS loud FROM c),
b AS (SELECT *, s[(CASE WHEN coalesce(loud[1], 0) > 10 THEN loud[1] ELSE 0 END) * 2 + 1:(CASE WHEN nb - 1 - coalesce(loud[-1], nb - 1) > 10 THEN loud[-1] + 1 ELSE nb END) * 2] AS x FROM l)
SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(len(x) AS INTEGER) AS n, round(coalesce(list_sum(CASE WHEN len(x) > 40 THEN x[1:len(x) - 40] ELSE x END), 0), 4) AS total FROM b"""
)
def g6_trim(spark, d):
    clips = _vectors(spark, d, sr=200, samples="concat(array_repeat(cast(0 as float), 30), embedding)")
    return audio.trim(clips).select("job_id", F.size("samples").alias("n"), F.round(total(F.col("samples")), 4).alias("total"))


_PAIR = "(SELECT a.vec_id // 2 AS job, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_FADED = "list_sum(list_transform(range(0, 16), lambda i: greatest(-32768, least(32767, round((a[len(a) - 15 + i] * cos(pi() / 2 * i / 15) + b[i + 1] * sin(pi() / 2 * i / 15)) * 32768))) / 32768))"


@query(f"SELECT CAST(job AS VARCHAR) AS job_id, CAST(len(a) + len(b) - 16 AS INTEGER) AS n, round(list_sum(a[1:len(a) - 16]) + list_sum(b[17:]) + {_FADED}, 3) AS total FROM {_PAIR}")
def g8_crossfade(spark, d):
    clips = _vectors(spark, d, "CAST(vec_id div 2 AS STRING)", "CAST(vec_id % 2 AS INTEGER)")
    both = clips.groupBy("job_id").agg(F.count("*").alias("m")).filter("m = 2").select("job_id")
    parts = audio.join_clips(clips.join(both.hint("merge"), "job_id"), "overlap", 160).select("job_id", F.size("samples").alias("n"), total(F.col("samples")).alias("total"))
    return parts.groupBy("job_id").agg(F.sum("n").cast("int").alias("n"), F.round(F.sum("total"), 3).alias("total"))


@query(f"SELECT CAST(job AS VARCHAR) AS job_id, CAST(len(a) + len(b) + 5 AS INTEGER) AS n, round(b[1], 5) AS second_part, 0.0::DOUBLE AS gap FROM {_PAIR}")
def g10_join_with_gap(spark, d):
    parts = sql_of(spark, d, "embeddings", "CAST(vec_id div 2 AS STRING) AS job_id, 0 AS seg_idx, 100 AS sr, CAST(vec_id % 2 AS INTEGER) AS part_idx, embedding AS samples")
    out = audio.join_with_gap(parts, 50).withColumn("n", F.size("samples")).withColumn("k", ((F.col("n") - 5) / 2).cast("int"))
    whole = out.filter("n > 100")
    return whole.select("job_id", "n", F.round(F.element_at("samples", F.col("k") + 6).cast("double"), 5).alias("second_part"), F.element_at("samples", F.col("k") + 3).cast("double").alias("gap"))


@query(
    f"""WITH t AS (SELECT k, CASE WHEN k = 0 THEN 1.0 ELSE sin(pi() * 0.475 * k) / (pi() * 0.475 * k) END * CASE WHEN abs(k) < 135 THEN 0.42 + 0.5 * cos(pi() * k / 135) + 0.08 * cos(2 * pi() * k / 135) ELSE 0 END AS h FROM range(-134, 136) AS r(k)),
w AS (SELECT list(h ORDER BY k) AS w, sum(h) AS total FROM t),
c AS (SELECT vec_id, {_CELLS} AS x FROM embeddings),
y AS (SELECT vec_id, len(x) AS n, list_transform(range(CAST(round(len(x) / 2.0) AS INTEGER)), lambda i: list_sum(list_transform(range(-134, 136), lambda k: x[greatest(1, least(len(x), 2 * i + k + 1))] * w[k + 135])) / total) AS y FROM c, w)
SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(len(y) * 2 AS INTEGER) AS n, round(2 * list_sum(list_transform(y, lambda v: greatest(-32768, least(32767, round(v * 32768))) / 32768)), 3) AS total FROM y"""
)
def g11_convert(spark, d):
    """To half the rate and two channels."""
    return audio.convert(_vectors(spark, d), 50, 2).select("job_id", F.size("samples").alias("n"), F.round(total(F.col("samples")), 3).alias("total"))


_LOUD = "event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE -10 - value / 5 END AS lufs, -value / 30 AS true_peak_dbfs, value AS seconds"


@query(f"SELECT event_id, round(CASE WHEN lufs IS NULL OR seconds < 10 THEN 1.0 ELSE power(10, least(-16 - lufs, CASE WHEN true_peak_dbfs > -1.0 THEN -2.5 ELSE -2.0 END - true_peak_dbfs) / 20) END, 6) AS gain FROM (SELECT {_LOUD} FROM events)")
def g12_gain_plan(spark, d):
    return audio.gain_plan(sql_of(spark, d, "events", _LOUD)).select("event_id", F.round("gain", 6).alias("gain"))


@query("SELECT CAST(vec_id AS VARCHAR) AS job_id FROM embeddings WHERE len(embedding) / (4.0 + vec_id % 5) >= 10")
def g13_long_enough(spark, d):
    return audio.long_enough(sql_of(spark, d, "embeddings", "CAST(vec_id AS STRING) AS job_id, 4 + vec_id % 5 AS sr, embedding AS samples")).select("job_id")


@query(
    f"""WITH c AS (SELECT vec_id, flatten(list_transform(range(1 + vec_id % 3), lambda k: {_CELLS})) AS s FROM embeddings),
f AS (SELECT vec_id, 20 * log10(quantile_cont(abs(x), 0.05)) AS floor_dbfs FROM (SELECT vec_id, unnest(s) AS x FROM c) WHERE x <> 0 GROUP BY vec_id)
SELECT CAST(c.vec_id AS VARCHAR) AS name, len(s) / 20.0::DOUBLE AS seconds, round(floor_dbfs, 5) AS floor_dbfs, array_to_string(list_filter([CASE WHEN len(s) / 20.0 < 5 THEN 'too short' END, CASE WHEN floor_dbfs > -55 THEN 'noisy' END], lambda x: x IS NOT NULL), '|') AS errors FROM c LEFT JOIN f ON f.vec_id = c.vec_id"""
)
def g14_voice_report(spark, d):
    voices = sql_of(spark, d, "embeddings", "CAST(vec_id AS STRING) AS name, 20 AS sr, flatten(array_repeat(embedding, cast(1 + vec_id % 3 as int))) AS samples")
    return audio.voice_report(voices).select("name", "seconds", F.round("floor_dbfs", 5).alias("floor_dbfs"), F.array_join("errors", "|").alias("errors"))


# model calls with small deterministic functions in the models' place

_WORDS = "CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER)"


def _turns(spark, d):
    return table(spark, d, "conversations", "conv_id as doc_id", "cast(turn as int) as seg_idx", "text")


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, CAST(length(text) AS VARCHAR) || ' signs' AS output FROM conversations")
def u1_rewrite(spark, d):
    return models.rewrite(_turns(spark, d).withColumn("messages", models.chat("Tell it.")), lambda m: f"{len(m[-1]['content'])} signs")


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN '2 messages' ELSE '3 messages' END AS output FROM conversations")
def u1_rewrite_in_order(spark, d):
    return models.rewrite(_turns(spark, d).withColumn("messages", models.chat("Tell it.")), lambda m: f"{len(m)} messages", ordered=True)


@query(f"SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn AS INTEGER) AS seg_idx, CAST(300 * ({_WORDS} + 3) + 160 AS INTEGER) AS n, 0.45::DOUBLE AS loudest FROM conversations WHERE text NOT LIKE '%\"%'")
def u2_speak(spark, d):
    """A stand-in voice of 300 samples a word, as loud as its temperature; the quote is livelier."""
    rows = table(spark, d, "conversations", "cast(conv_id as string) as job_id", "cast(turn as int) as seg_idx", "text").filter("not contains(text, '\"')")
    said = rows.withColumn("text", F.concat("text", F.lit(' "so '), F.col("seg_idx").cast("string"), F.lit('" end'))).withColumn("params", F.create_map(F.lit("temperature"), F.lit(0.3))).withColumn("seed", F.lit(1))
    clips = models.speak(said, lambda text, params, seed: [params["temperature"]] * (300 * len(text.split())), 1000)
    return clips.select("job_id", "seg_idx", F.size("samples").alias("n"), F.round(F.array_max("samples").cast("double"), 6).alias("loudest"))


@query("SELECT CAST(vec_id AS VARCHAR) AS job_id, CAST(len(embedding) AS VARCHAR) || ' heard' AS transcript FROM embeddings")
def u3_transcribe(spark, d):
    return models.transcribe(_vectors(spark, d), lambda x: f"{len(x)} heard").select("job_id", "transcript")


@query("SELECT CAST(c_custkey AS VARCHAR) AS job_id, CASE WHEN n <= 5 THEN 0 WHEN n <= 10 THEN 2 WHEN n <= 20 THEN 3 ELSE 4 END AS round, n <= 20 AS passed FROM (SELECT c_custkey, 1 + c_custkey % 30 AS n FROM customer)")
def u4_retry_rounds(spark, d):
    """A gate that passes parts of up to five words."""
    segs = table(spark, d, "customer", "cast(c_custkey as string) as job_id", "0 as seg_idx", "trim(repeat('word ', cast(1 + c_custkey % 30 as int))) as text")
    gate = lambda clips: clips.select("job_id", "seg_idx", (F.col("word_count") <= 5).alias("passed"))
    return models.retry_rounds(segs, lambda text, params, seed: [0.1] * len(text.split()), gate).select("job_id", "round", "passed")


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, true AS passed, CAST(1 AS INTEGER) AS rounds, 1.0::DOUBLE AS word_ratio FROM conversations")
def u5_rewrite_with_checks(spark, d):
    """A model that leaves half out and tells the whole when it is asked again."""

    def model(messages):
        said = messages[-1]["content"]
        return said.split("\n\n", 1)[1] if "Tell " in said else " ".join(said.split()[: len(said.split()) // 2])

    return models.rewrite_with_checks(_turns(spark, d), model).select("doc_id", "seg_idx", "passed", "rounds", "word_ratio")


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, CASE WHEN length(text) % 2 = 0 THEN 'made whole' ELSE 'short' END AS output FROM conversations")
def u6_completeness(spark, d):
    """A model that finds something missing in texts of an even length."""

    def model(messages):
        said = messages[-1]["content"]
        return "made whole" if said.startswith("Add: ") else '["an item"]' if (len(said) - len("List what is missing as a JSON array.\n\n---\nshort")) % 2 == 0 else "nothing"

    return models.completeness(_turns(spark, d).withColumn("output", F.lit("short")), model).select("doc_id", "seg_idx", "output")


@query("SELECT c_custkey AS job, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS round FROM customer")
def o5_merge_rounds(spark, d):
    rows = table(spark, d, "customer", "c_custkey as job")
    passed = rows.filter("job % 3 <> 0").withColumn("round", F.lit(0))
    again = rows.join(passed.select("job").hint("merge"), "job", "left_anti").withColumn("round", F.lit(1))
    return jobs.union_sites(passed, again)


# streams and their batch forms


def _stream(spark, d, name: str):
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _ended(query, seconds: int = 3600) -> None:
    """Wait until the stream has used up its input."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream still runs after {seconds} s")


def _landed(spark, df, name: str):
    """What the stream ``df`` writes until its input is used up."""
    path = new_folder(spark, name)
    _ended(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, f"{name}-log")).trigger(availableNow=True).start())
    return spark.read.schema(df.schema).parquet(path)


@query("SELECT CAST(page_id AS VARCHAR) AS post_id, CASE WHEN page_id % 2 = 0 THEN 'Published' END AS status FROM pages WHERE page_id % 3 <> 0")
def st1_stream_posts(spark, d):
    path = new_folder(spark, "payloads")
    raw = "concat('{\"body\":{\"post\":{\"current\":{\"id\":\"', page_id, case when page_id % 3 = 0 then '\",\"status\":\"draft' when page_id % 2 = 0 then '\",\"status\":\"Published' else '' end, '\"}}}}') as value"
    table(spark, d, "pages", raw).write.text(path)
    return _landed(spark, streams.stream_posts(spark, path).select("post_id", "status"), "posts")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id FROM events")
def st2_first_submissions(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _landed(spark, streams.first_submissions(rows, "60 days"), "firsts").select("job_id")


_MACHINE = f"(SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, ts, CASE WHEN event_id % 11 = 0 THEN 'deleted' WHEN event_id % 5 = 0 THEN 'resumed' ELSE {_STATUS} END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events)"


@query(
    f"""WITH RECURSIVE r AS {_MACHINE},
m AS (
  SELECT job_id, n, event_id, CASE WHEN status = 'resumed' THEN NULL ELSE status END AS state, status <> 'resumed' AS applied FROM r WHERE n = 1
  UNION ALL
  SELECT job_id, n, event_id, CASE WHEN NOT ok THEN state WHEN status = 'resumed' THEN 'processing' ELSE status END, ok FROM (
    SELECT r.*, m.state, m.state IS DISTINCT FROM 'deleted' AND NOT (r.status = 'paused' AND coalesce(m.state, '') IN ('completed', 'failed')) AND NOT (r.status = 'resumed' AND m.state IS DISTINCT FROM 'paused') AS ok FROM m JOIN r ON r.job_id = m.job_id AND r.n = m.n + 1)
)
SELECT event_id, state, applied FROM m"""
)
def st4_job_states(spark, d):
    rows = events(spark, d).withColumn("status", F.when(F.col("event_id") % 11 == 0, "deleted").when(F.col("event_id") % 5 == 0, "resumed").otherwise(F.col("status")))
    return folds.job_states(rows.select("event_id", "job_id", "ts", "status")).select("event_id", "state", "applied")


@query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) FILTER (status = 'queued') AS created, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, {', '.join(f'count(*) FILTER (duration_s <= {e}) AS le_{e}' for e in (1, 5, 10, 30, 60))}, count(duration_s) AS n FROM {_EV} GROUP BY 1")
def st5_window_metrics(spark, d):
    return streams.metrics(events(spark, d), "1 hour")


@query(
    f"""WITH s AS (SELECT job_id, ts FROM {_EV} WHERE status = 'queued'), t AS (SELECT job_id, ts, status FROM {_EV} WHERE status <> 'queued')
SELECT job_id, ts AS submitted, 'no status' AS reason FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job_id = s.job_id AND t.ts >= s.ts AND t.ts <= s.ts + INTERVAL 12000 SECONDS)
UNION ALL SELECT job_id, ts, 'not finished' FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.job_id = s.job_id AND t.status IN ('completed', 'failed', 'deleted') AND t.ts >= s.ts AND t.ts <= s.ts + INTERVAL 36000 SECONDS)"""
)
def st6_timeouts(spark, d):
    ev = events(spark, d)
    return streams.timeouts(ev.filter("status = 'queued'").select("job_id", "ts"), ev.filter("status <> 'queued'").select("job_id", "ts", "status"), 12_000, 36_000)


@query(f"SELECT job_id, status, ts AS since, round(s, 3) AS seconds FROM (SELECT job_id, status, ts, epoch_us(coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts), TIMESTAMP '2024-02-01 00:00:00')) / 1e6 - epoch_us(ts) / 1e6 AS s FROM {_EV}) WHERE (status = 'processing' AND s > 28800) OR (status = 'paused' AND s > 3600)")
def st6_overdue(spark, d):
    return jobs.overdue(events(spark, d), F.expr("timestamp'2024-02-01 00:00:00'"), streams.LIMITS).withColumn("seconds", F.round("seconds", 3))


@query(
    """WITH RECURSIVE r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS endpoint, epoch_us(ts) / 1e6 AS t, event_type IN ('signup', 'purchase') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
b AS (
  SELECT endpoint, n, event_id, true AS allowed, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, 0.0::DOUBLE AS opened FROM r WHERE n = 1
  UNION ALL
  SELECT endpoint, n, event_id, allowed, CASE WHEN NOT allowed THEN 'open' WHEN ok THEN 'closed' WHEN half OR failures + 1 >= 3 THEN 'open' ELSE state END,
    CASE WHEN NOT allowed THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN allowed AND NOT ok AND (half OR failures + 1 >= 3) THEN t WHEN allowed AND ok THEN 0.0 ELSE opened END
  FROM (SELECT r.*, b.state, b.failures, b.opened, b.state = 'open' AND r.t - b.opened >= 20000 AS half, NOT (b.state = 'open' AND r.t - b.opened < 20000) AS allowed FROM b JOIN r ON r.endpoint = b.endpoint AND r.n = b.n + 1)
)
SELECT event_id, allowed, state FROM b"""
)
def st7_breaker(spark, d):
    calls = table(spark, d, "events", "event_id", "cast(user_id as string) as endpoint", "ts", "event_type in ('signup', 'purchase') as ok")
    return folds.breaker_states(calls, 3, 20_000).select("event_id", "allowed", "state")


@query(f"SELECT page_id, CASE WHEN uri IS NOT NULL THEN '<div class=\"audio-player\"><audio src=\"' || uri || '\"></audio></div>' ELSE '' END || html AS html FROM (SELECT p.page_id, 'post ' || p.page_id AS html, e.uri FROM pages p LEFT JOIN (SELECT job_id, arg_max(audio_uri, ts) AS uri FROM {_EV} WHERE status = 'completed' GROUP BY job_id) e ON e.job_id = CAST(p.page_id AS VARCHAR))")
def st8_apply_callbacks(spark, d):
    folder = new_folder(spark, "posts")
    posts.create(table(spark, d, "pages", "page_id", "lpad(cast(page_id as string), 24, '0') as post_id", "concat('post ', page_id) as html"), folder)
    done = _stream(spark, d, "events").filter("event_type = 'purchase'").selectExpr("concat('blog-pid-', lpad(cast(user_id as string), 24, '0'), '-slug-1') as job_id", "ts", "'completed' as status", "concat('local://out/', cast(event_id as string), '.mp3') as audio_uri")
    _ended(streams.apply_callbacks(done, folder, new_folder(spark, "posts-log")).trigger(availableNow=True).start())
    return posts.read(spark, folder).select("page_id", "html")


@query(SEGMENTS_OF_NORMALISED)
def st9_stream_segments(spark, d):
    docs = _stream(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return _landed(spark, streams.stream_segments(docs), "segments").select("doc_id", "seg_idx", "word_count")
