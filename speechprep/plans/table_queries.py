"""Queries over jobs, checks, routing and signals, each with a DuckDB oracle.

``events`` stand for job events (user -> job, type -> status, value -> duration), requests and calls;
``conversations`` for chat messages, ``customer`` and ``orders`` for requests and hosts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.functions import values as V
from speechprep.operators import audio, checks, folds, jobs
from speechprep.sources import tables
from speechprep.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
#: Shared by both engines: job events.
EVENTS = f"event_id, CAST(user_id AS STRING) AS job_id, ts, {_STATUS} AS status, CAST(value AS DOUBLE) AS duration_s, CASE WHEN event_type = 'purchase' THEN 'local://out/' || CAST(event_id AS STRING) || '.mp3' END AS audio_uri, CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id AS STRING) END AS error"
_EV = f"(SELECT {EVENTS} FROM events)"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df.createOrReplaceTempView("speechprep_events")
    return spark.sql(f"SELECT {EVENTS} FROM speechprep_events")


def sql_of(spark: SparkSession, sf_dir: str, name: str, select: str) -> DataFrame:
    """``select`` over the table ``name``, whose text the oracle shares."""
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"speechprep_{name}")
    return spark.sql(f"SELECT {select} FROM speechprep_{name}")


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# jobs


@query(f"SELECT job_id, arg_max(status, ts) AS status, arg_max(audio_uri, ts) FILTER (audio_uri IS NOT NULL) AS audio_uri, arg_max(error, ts) FILTER (error IS NOT NULL) AS error, max(ts) AS updated_at FROM {_EV} GROUP BY job_id")
def w12_job_state(spark, d):
    return jobs.job_state(events(spark, d).drop("event_id"), ["status", "audio_uri", "error"])


@query(ORACLES["w12_job_state"])
def w12_job_snapshots(spark, d):
    """The same from a kept snapshot of some events and the others, part of which it has seen."""
    ev, fields, path = events(spark, d), ["status", "audio_uri", "error"], new_folder(spark, "snapshot")
    jobs.job_snapshot(ev.filter("event_id % 3 <> 0").drop("event_id"), fields).write.parquet(path)
    return jobs.state_of(jobs.merge_snapshots(spark.read.parquet(path), jobs.job_snapshot(ev.filter("event_id % 3 <> 1").drop("event_id"), fields)))


@query(f"SELECT status, count(*) AS jobs FROM (SELECT job_id, arg_max(status, ts) AS status FROM {_EV} GROUP BY job_id) GROUP BY status")
def a1_job_counts(spark, d):
    return jobs.job_counts(jobs.job_state(events(spark, d).drop("event_id"), ["status"]))


@query(f"SELECT created, completed, failed, cancelled, created - completed - failed - cancelled AS active FROM (SELECT count(*) FILTER (status = 'queued') AS created, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'deleted') AS cancelled FROM {_EV})")
def a2_job_counters(spark, d):
    return jobs.job_counters(events(spark, d))


_EDGES = ", ".join(f"({e}.0)" for e in jobs.EDGES["job"])


@query(f"SELECT status, e.le AS le, count(*) FILTER (duration_s <= e.le) AS n, count(*) AS count, round(sum(duration_s), 3) AS sum FROM {_EV} CROSS JOIN (VALUES {_EDGES}, (CAST('inf' AS DOUBLE))) AS e(le) GROUP BY status, e.le")
def a3_duration_histogram(spark, d):
    return jobs.duration_histogram(events(spark, d), "duration_s", jobs.EDGES["job"], ["status"]).withColumn("sum", F.round("sum", 3))


_OUTCOME = "CASE event_id % 4 WHEN 0 THEN 'triggered' WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' ELSE 'error' END"


@query(f"SELECT site, count(*) FILTER (o = 'triggered') AS triggered, count(*) FILTER (o = 'done') AS done, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'error') AS error FROM (SELECT event_type AS site, {_OUTCOME} AS o FROM events) GROUP BY ROLLUP (site)")
def a4_backfill_summary(spark, d):
    return jobs.backfill_summary(sql_of(spark, d, "events", f"event_type AS site, {_OUTCOME} AS outcome"))


@query("SELECT h AS hits, m AS misses, h / CAST(h + m AS DOUBLE) AS hit_ratio FROM (SELECT count(*) FILTER (value > 20) AS h, count(*) FILTER (value <= 20) AS m FROM events)")
def a5_cache_stats(spark, d):
    return jobs.cache_stats(sql_of(spark, d, "events", "value > 20 AS hit"))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def a6_reassemble(spark, d):
    return jobs.reassemble(table(spark, d, "conversations", "conv_id as doc_id", "turn as seg_idx", "text"))


@query("SELECT avg(CASE WHEN value > 5 THEN 0.0 ELSE 1.0 END) AS retry_rate FROM events")
def a16_retry_rate(spark, d):
    return jobs.retry_rate(table(spark, d, "events", "value > 5 as passed"))


@query("SELECT DISTINCT name FROM (SELECT 'voice-' || CAST(user_id % 7 AS VARCHAR) AS name FROM events UNION ALL SELECT 'default')")
def a17_list_voices(spark, d):
    return jobs.list_voices(table(spark, d, "events", "concat('voice-', cast(user_id % 7 as string)) as name"))


@query("SELECT conv_id AS doc_id, CAST(sum(n) AS BIGINT) AS source_words, CAST(sum(k) AS BIGINT) AS output_words, CAST(count(*) FILTER (turn % 2 = 0) AS BIGINT) AS missing, sum(k) / CAST(greatest(sum(n), 1) AS DOUBLE) AS ratio FROM (SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n, CAST(least(len(w), 3) AS BIGINT) AS k FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)) GROUP BY conv_id")
def a12_fidelity_summary(spark, d):
    out = jobs.fidelity_summary(table(spark, d, "conversations", "conv_id as doc_id", "text", "array_join(slice(filter(split(text, '\\\\s+'), x -> x <> ''), 1, 3), ' ') as out_text", "cast(turn % 2 = 0 as int) as missing"))
    return out.withColumn("missing", F.col("missing").cast("long"))


def _messages(spark, d):
    return table(spark, d, "conversations", "conv_id as doc_id", "turn as seg_idx", "text")


@query("SELECT conv_id AS doc_id, turn AS seg_idx, 'SECTION ' || CAST(row_number() OVER w AS VARCHAR) || ' of ' || CAST(count(*) OVER (PARTITION BY conv_id) AS VARCHAR) || ', ~' || CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS VARCHAR) || ' words' AS position FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w1_with_position(spark, d):
    return jobs.with_position(_messages(spark, d)).drop("text")


_S = "list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.?!]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT conv_id AS doc_id, turn AS seg_idx, lag(array_to_string({_S}[greatest(len({_S}) - 2, 1):], ' ')) OVER (PARTITION BY conv_id ORDER BY turn) AS tail FROM conversations")
def w2_with_tails(spark, d):
    return jobs.with_tails(_messages(spark, d)).drop("text")


@query("SELECT conv_id AS doc_id, turn AS seg_idx, concat_ws(chr(10) || chr(10), lag(p[len(p)]) OVER (PARTITION BY conv_id ORDER BY turn), t) AS text FROM (SELECT conv_id, turn, t, string_split(t, chr(10) || chr(10)) AS p FROM (SELECT conv_id, turn, text || chr(10) || chr(10) || 'Turn ' || CAST(turn AS VARCHAR) AS t FROM conversations))")
def w3_with_overlap(spark, d):
    rows = _messages(spark, d).withColumn("text", F.expr("concat(text, '\n\nTurn ', cast(seg_idx as string))"))
    return jobs.with_overlap(rows)


@query("SELECT doc_id, seg_idx, CAST(CASE WHEN nxt IS NULL OR nxt = '' THEN 0 WHEN regexp_matches(trim(t), '[.!?]\\s*$') AND regexp_matches(lower(trim(nxt)), '^(?:now,|however|meanwhile|finally,)') THEN 700 WHEN regexp_matches(trim(t), '[.!?]\\s*$') THEN 450 ELSE 250 END AS INTEGER) AS gap_ms FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS nxt FROM (SELECT conv_id AS doc_id, turn AS seg_idx, CASE turn % 3 WHEN 0 THEN 'However, ' WHEN 1 THEN 'Then ' ELSE '' END || text AS t FROM conversations))")
def w4_gap_after(spark, d):
    rows = _messages(spark, d).withColumn("text", F.expr("concat(CASE seg_idx % 3 WHEN 0 THEN 'However, ' WHEN 1 THEN 'Then ' ELSE '' END, text)"))
    return jobs.gap_after(rows).drop("text")


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 300 WHEN event_id % 3 = 1 THEN 700 ELSE 450 END AS INTEGER) AS gap_ms FROM events")
def w5_choose_gap(spark, d):
    return jobs.choose_gap(table(spark, d, "events", "event_id", "case when event_id % 3 = 0 then 300 else 0 end as explicit_ms", "case when event_id % 3 = 1 then 700 end as gap_ms")).select("event_id", "gap_ms")


@query("SELECT key, count(*) AS failures, min(ts) AS since, max(ts) AS until FROM (SELECT key, ts, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id AS key, ts, event_type IN ('signup', 'purchase') AS ok FROM events)) WHERE NOT ok GROUP BY key, run HAVING count(*) >= 3")
def w13_failure_streaks(spark, d):
    return jobs.failure_streaks(table(spark, d, "events", "user_id as key", "ts", "event_type in ('signup', 'purchase') as ok"))


@query(f"SELECT event_id, job_id, status, before FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts) AS before FROM {_EV}) WHERE status = 'paused' AND before IN ('completed', 'failed')")
def w14_illegal_transitions(spark, d):
    return jobs.illegal_transitions(events(spark, d)).select("event_id", "job_id", "status", "before")


@query(f"SELECT job_id, status, round(sum(s), 3) AS seconds, count(*) AS times FROM (SELECT job_id, status, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM {_EV}) GROUP BY job_id, status")
def w15_time_in_state(spark, d):
    return jobs.time_in_state(events(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("SELECT job_id, seg_idx, CAST(coalesce(sum(duration_ms - overlap_ms + gap_ms) OVER (PARTITION BY job_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM (SELECT user_id AS job_id, event_id AS seg_idx, CAST(floor(value * 10) AS BIGINT) + 1 AS duration_ms, event_id % 5 AS overlap_ms, 450 AS gap_ms FROM events)")
def w16_timeline(spark, d):
    return audio.timeline(table(spark, d, "events", "user_id as job_id", "event_id as seg_idx", "cast(floor(value * 10) as bigint) + 1 as duration_ms", "event_id % 5 as overlap_ms", "450 as gap_ms")).select("job_id", "seg_idx", "start_ms")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n = 1 AND user_id % 3 <> 0")
def j2_submit_created(spark, d):
    ev = events(spark, d)
    known = ev.filter("cast(job_id as int) % 3 = 0").select("job_id", F.lit("queued").alias("status")).distinct()
    return jobs.submit(ev.select("event_id", "job_id", "ts"), known)[0].select("event_id", "job_id", "ts")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CASE WHEN user_id % 3 = 0 THEN 'paused' ELSE 'queued' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE user_id % 3 = 0 OR n > 1")
def j2_submit_duplicates(spark, d):
    ev = events(spark, d)
    known = ev.filter("cast(job_id as int) % 3 = 0").select("job_id", F.lit("paused").alias("status")).distinct()
    return jobs.submit(ev.select("event_id", "job_id", "ts"), known)[1].select("event_id", "job_id", "status")


@query("SELECT page_id AS post_id, url FROM pages WHERE NOT regexp_matches(html, '(?i)<audio[^>]*>') AND page_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')")
def j1_backfill_candidates(spark, d):
    return jobs.backfill_candidates(table(spark, d, "pages", "page_id as post_id", "url", "html"), table(spark, d, "events").filter("event_type = 'signup'").selectExpr("user_id as post_id")).select("post_id", "url")


@query("SELECT a.conv_id AS doc_id, a.turn AS seg_idx, length(a.text) AS source_length, length(reverse(a.text)) AS output_length FROM conversations a WHERE a.turn % 2 = 0")
def j3_pair_chunks(spark, d):
    src = _messages(spark, d)
    out = src.filter("seg_idx % 2 = 0").withColumn("text", F.reverse("text"))
    return jobs.pair_chunks(src, out).select("doc_id", "seg_idx", F.length("text").cast("long").alias("source_length"), F.length("out_text").cast("long").alias("output_length"))


@query("SELECT a.doc_id, CAST(i.item_id AS VARCHAR) AS value FROM documents a, benchmark i WHERE i.item_id = a.doc_id % 40 AND NOT contains(lower(a.text), lower(substr(i.text, 1, 6))) AND NOT contains(lower(a.text), lower(substr(i.text, 8, 4)))")
def j4_missing_entities(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    items = table(spark, d, "benchmark", "item_id", "cast(item_id as string) as value", "array(substr(text, 1, 6), substr(text, 8, 4)) as forms")
    ents = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(items, "item_id").select("doc_id", "value", "forms")
    return jobs.missing_entities(ents, docs)


_SITES = [(1, "com-site", "example.com"), (2, "net-site", "example.net"), (3, "any-site", "example")]


@query("SELECT page_id, coalesce(CASE WHEN contains(h, 'example.com') THEN 'com-site' WHEN contains(h, 'example.net') THEN 'net-site' WHEN contains(h, 'example.o') THEN NULL END, replace(h, '.', '-')) AS site_slug FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages)")
def j5_route_site(spark, d):
    sites = spark.createDataFrame(_SITES[:2], "rank int, slug string, hostname string")
    return jobs.route_site(table(spark, d, "pages", "page_id", "url"), sites).select("page_id", "site_slug")


_TIERS = [("low_vram", 1.0, 12.0), ("mid_vram", 12.0, 18.0), ("high_vram", 18.0, 1e9)]


@query("SELECT event_id, CASE WHEN value < 1 THEN 'cpu_only' WHEN value < 12 THEN 'low_vram' WHEN value < 18 THEN 'mid_vram' ELSE 'high_vram' END AS tier FROM events WHERE value IS NOT NULL")
def j6_assign_tier(spark, d):
    tiers = spark.createDataFrame(_TIERS, "tier string, lo_gb double, hi_gb double")
    return jobs.assign_tier(table(spark, d, "events", "event_id", "value as vram_gb").filter("vram_gb is not null"), tiers).select("event_id", "tier")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 0.9 END AS temperature, CAST(CASE WHEN event_id % 3 = 0 THEN 10 ELSE 50 END AS INTEGER) AS top_k FROM events")
def j7_effective_params(spark, d):
    defaults = spark.createDataFrame([(0.9, 50)], "temperature double, top_k int")
    return jobs.effective_params(defaults, table(spark, d, "events", "event_id", "case when event_id % 2 = 0 then value end as temperature", "case when event_id % 3 = 0 then 10 end as top_k"), ["temperature", "top_k"])


@query("SELECT event_id, CASE WHEN user_id % 4 < 2 THEN 'v/' || CAST(user_id % 4 AS VARCHAR) || '.wav' ELSE 'v/default.wav' END AS path, user_id % 4 >= 2 AS missing FROM events")
def j8_resolve_voice(spark, d):
    voices = spark.createDataFrame([("v0", "v/0.wav"), ("v1", "v/1.wav"), ("default", "v/default.wav")], "name string, path string")
    return jobs.resolve_voice(table(spark, d, "events", "event_id", "concat('v', cast(user_id % 4 as string)) as voice_profile"), voices).select("event_id", "path", "missing")


@query(f"SELECT e.event_id, p.page_id FROM {_EV} e JOIN pages p ON p.page_id = CAST(e.job_id AS BIGINT) WHERE e.status = 'completed'")
def j9_callbacks(spark, d):
    ev = events(spark, d).withColumn("job_id", F.concat(F.lit("blog-pid-"), F.lpad("job_id", 24, "0"), F.lit("-slug-1")))
    posts = table(spark, d, "pages", "page_id", "lpad(cast(page_id as string), 24, '0') as post_id")
    return jobs.callbacks(ev, posts).select("event_id", "page_id")


@query(
    f"WITH s AS (SELECT job_id, ts FROM {_EV} WHERE status = 'queued'), t AS (SELECT job_id, ts, status FROM {_EV} WHERE status <> 'queued'), "
    "j AS (SELECT s.job_id, s.ts, min(t.ts) AS first_at, min(t.ts) FILTER (t.status IN ('completed', 'failed', 'deleted')) AS ended_at, arg_min(t.status, t.ts) FILTER (t.status IN ('completed', 'failed', 'deleted')) AS o FROM s LEFT JOIN t ON t.job_id = s.job_id AND t.ts >= s.ts AND t.ts <= s.ts + INTERVAL 36000 SECONDS GROUP BY s.job_id, s.ts) "
    "SELECT job_id, ts, CASE WHEN first_at IS NULL OR first_at > ts + INTERVAL 12000 SECONDS THEN 'no status' WHEN ended_at IS NULL THEN 'not finished' ELSE o END AS outcome FROM j"
)
def j10_job_outcome(spark, d):
    ev = events(spark, d)
    return jobs.job_outcome(ev.filter("status = 'queued'").select("job_id", "ts"), ev.filter("status <> 'queued'"), 12_000, 36_000).select("job_id", "ts", "outcome")


@query(f"SELECT p.job_id, p.ts, (SELECT arg_max(e.status, e.ts) FROM {_EV} e WHERE e.job_id = p.job_id AND e.ts <= p.ts AND e.event_id % 5 <> 0) AS status FROM {_EV} p WHERE p.event_id % 5 = 0")
def j11_status_as_of(spark, d):
    ev = events(spark, d)
    return jobs.status_as_of(ev.filter("event_id % 5 = 0"), ev.filter("event_id % 5 <> 0"))


@query("SELECT event_id, user_id * 2 AS value FROM events")
def j13_memoize(spark, d):
    df = table(spark, d, "events", "event_id", "user_id")
    key = F.sha2(F.to_json(F.struct("user_id")), 256)
    cache = df.filter("user_id % 2 = 0").select(key.alias("cache_key"), (F.col("user_id") * 2).alias("value"), F.expr("timestamp'2024-01-30 23:59:00'").alias("stored_at")).distinct()
    out, _ = jobs.memoize(df, ["user_id"], lambda x: x.withColumn("value", F.col("user_id") * 2), cache, F.expr(_NOW.replace("TIMESTAMP ", "timestamp")), 3600)
    return out.select("event_id", "value")


@query(f"SELECT job_id, max(ts) AS updated_at FROM {_EV} GROUP BY job_id ORDER BY updated_at DESC, job_id LIMIT 50")
def t2_cap_jobs(spark, d):
    return jobs.cap_jobs(jobs.job_state(events(spark, d), []), 50)


@query("SELECT site, post_id, CAST(row_number() OVER (PARTITION BY site ORDER BY post_id) AS INTEGER) AS position FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS site, page_id AS post_id FROM pages)")
def t5_worklist(spark, d):
    return jobs.worklist(table(spark, d, "pages", "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as site", "page_id as post_id"))


@query("SELECT conv_id AS doc_id, turn AS seg_idx, text FROM conversations")
def t1_ordered(spark, d):
    return jobs.ordered(_messages(spark, d))


@query("SELECT page_id, url, CAST(NULL AS VARCHAR) AS site FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, url, 'b' AS site FROM pages WHERE page_id % 3 = 0")
def o1_union_sites(spark, d):
    p = table(spark, d, "pages", "page_id", "url")
    return jobs.union_sites(p.filter("page_id % 2 = 0"), p.filter("page_id % 3 = 0").withColumn("site", F.lit("b")))


@query("SELECT page_id, regexp_matches(h, '(?i)<audio[^>]*>') AS has FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html || '<audio src=a>' WHEN 1 THEN html END AS h FROM pages) WHERE h IS NOT NULL")
def o4_split_has_audio(spark, d):
    has, needs = checks.split_has_audio(table(spark, d, "pages", "page_id", "case page_id % 3 when 0 then concat(html, '<audio src=a>') when 1 then html end as html"))
    return has.select("page_id", F.lit(True).alias("has")).unionByName(needs.select("page_id", F.lit(False).alias("has")))


# checks

_REQUESTS = "doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN 'bad id' ELSE 'j' || CAST(doc_id AS STRING) END AS job_id, CASE WHEN doc_id % 7 = 0 THEN 'a b' ELSE 'site' END AS site_slug, CASE WHEN doc_id % 3 = 0 THEN '/abs' WHEN doc_id % 3 = 1 THEN 'a/../b' ELSE ' ' END AS storage_path"


@query(f"SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'text is blank' END, CASE WHEN length(text) > 100000 THEN 'text is too long' END, CASE WHEN NOT regexp_matches(job_id, '^[a-zA-Z0-9_-]+$') OR length(job_id) > 200 THEN 'bad job_id' END, CASE WHEN NOT regexp_matches(site_slug, '^[a-zA-Z0-9_-]+$') THEN 'bad site_slug' END, CASE WHEN contains(storage_path, '..') THEN 'path climbs' END, CASE WHEN starts_with(storage_path, '/') THEN 'path is absolute' END], lambda x: x IS NOT NULL), '|') AS violations FROM (SELECT {_REQUESTS} FROM documents)")
def p1_validate_requests(spark, d):
    return checks.validate_requests(sql_of(spark, d, "documents", _REQUESTS)).select("doc_id", F.array_join("violations", "|").alias("violations"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) WHEN doc_id % 3 = 1 THEN 'my-job-' || CAST(doc_id AS VARCHAR) END AS job_id FROM documents")
def p2_sanitize_job_id(spark, d):
    return table(spark, d, "documents", "doc_id", "case doc_id % 3 when 0 then ' ' when 1 then concat(' My Job ', cast(doc_id as string)) else 'x/y' end as j").select("doc_id", checks.sanitize_job_id(F.col("j"), F.col("doc_id").cast("string")).alias("job_id"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'status is ' || CASE event_type WHEN 'signup' THEN 'draft' ELSE 'deleted' END END AS skip_reason FROM (SELECT event_id, CASE WHEN event_type IN ('signup', 'view', 'click') THEN event_type ELSE 'x' END AS event_type FROM events)")
def p3_publishable(spark, d):
    return checks.publishable(table(spark, d, "events", "event_id", "case event_type when 'view' then 'Published' when 'click' then null when 'signup' then 'draft' else 'deleted' end as status")).select("event_id", "skip_reason")


@query("SELECT doc_id, words, CASE WHEN words < 50 THEN 'only ' || CAST(words AS VARCHAR) || ' words' END AS skip_reason FROM (SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents)")
def p4_min_words(spark, d):
    return checks.min_words(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "words", "skip_reason")


_PARAMS = "event_id, value / 20 AS temperature, value / 30 AS repetition_penalty, CAST(event_id % 300 AS INTEGER) AS top_k, value / 50 AS top_p, 1.0 AS temperature_sub_talker, 50 AS top_k_sub_talker, CAST(event_id % 9000 AS INTEGER) AS max_new_tokens"


@query(f"SELECT event_id, array_to_string(list_filter([CASE WHEN NOT (temperature BETWEEN 0 AND 2) THEN 'temperature out of range' END, CASE WHEN NOT (repetition_penalty BETWEEN 1 AND 2) THEN 'repetition_penalty out of range' END, CASE WHEN NOT (top_k BETWEEN 1 AND 200) THEN 'top_k out of range' END, CASE WHEN NOT (top_p BETWEEN 0 AND 1) THEN 'top_p out of range' END, CASE WHEN NOT (max_new_tokens BETWEEN 100 AND 8192) THEN 'max_new_tokens out of range' END], lambda x: x IS NOT NULL), '|') AS violations FROM (SELECT {_PARAMS} FROM events)")
def p8_validate_params(spark, d):
    return checks.validate_params(sql_of(spark, d, "events", _PARAMS)).select("event_id", F.array_join("violations", "|").alias("violations"))


_VOICES = "event_id, CASE WHEN event_id % 5 = 0 THEN 'Default' WHEN event_id % 5 = 1 THEN 'a b' ELSE 'ok' END AS name, CASE WHEN event_id % 3 = 0 THEN 'a.MP3' ELSE 'a.WAV' END AS path, value AS duration_s, CAST(8000 * (1 + event_id % 4) AS INTEGER) AS sr"


@query(f"SELECT event_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(name, '^[a-zA-Z0-9_-]+$') THEN 'bad name' END, CASE WHEN lower(name) = 'default' THEN 'reserved name' END, CASE WHEN NOT ends_with(lower(path), '.wav') THEN 'not a wav file' END, CASE WHEN duration_s < 5 THEN 'too short' END, CASE WHEN duration_s > 120 THEN 'too long' END, CASE WHEN sr < 16000 THEN 'sample rate too low' END], lambda x: x IS NOT NULL), '|') AS violations FROM (SELECT {_VOICES} FROM events)")
def p9_validate_voices(spark, d):
    return checks.validate_voices(sql_of(spark, d, "events", _VOICES)).select("event_id", F.array_join("violations", "|").alias("violations"))


_METRICS = "event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value / 10 END AS true_peak_dbfs, -16 - value / 8 AS integrated_lufs, CAST(event_id % 6 AS INTEGER) AS long_silence_gaps, -16.0 AS target_lufs"


@query(f"SELECT event_id, reason IS NULL AS passed, reason FROM (SELECT event_id, CASE WHEN true_peak_dbfs > -1.0 THEN 'true peak' WHEN abs(integrated_lufs - target_lufs) > 3.0 THEN 'loudness' WHEN long_silence_gaps > 3 THEN 'silence gaps' END AS reason FROM (SELECT {_METRICS} FROM events))")
def p10_final_gate(spark, d):
    return checks.final_gate(sql_of(spark, d, "events", _METRICS)).select("event_id", "passed", "reason")


@query(f"SELECT event_id, array_to_string(list_filter([CASE WHEN abs(integrated_lufs - target_lufs) > 2.0 THEN 'loudness' END, CASE WHEN true_peak_dbfs > -1.0 THEN 'true peak' END, CASE WHEN long_silence_gaps > 0 THEN 'silence gap' END], lambda x: x IS NOT NULL), '|') AS warnings FROM (SELECT {_METRICS} FROM events)")
def p11_final_warnings(spark, d):
    return checks.final_warnings(sql_of(spark, d, "events", _METRICS)).select("event_id", F.array_join("warnings", "|").alias("warnings"))


@query("SELECT doc_id, CASE WHEN n_chars <= 400 THEN 'one' ELSE 'segments' END AS pieces, CASE WHEN n_chars > least(8000, floor(16384 / 6.0)) THEN 'chunked' ELSE 'single' END AS strategy FROM documents")
def p12_choose_path(spark, d):
    return checks.choose_path(table(spark, d, "documents", "doc_id", "n_chars as words", "400 as seg_words", "16384 as num_ctx")).select("doc_id", "pieces", "strategy")


@query("SELECT conv_id AS doc_id, string_agg(CAST(turn AS VARCHAR) || ':' || CAST(n AS VARCHAR), '|' ORDER BY turn) AS oversized FROM (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations) WHERE n > 52 GROUP BY conv_id")
def p13_oversized(spark, d):
    segs = table(spark, d, "conversations", "conv_id as doc_id", "turn as seg_idx", "size(filter(split(text, '\\\\s+'), x -> x <> '')) as word_count")
    return checks.oversized(segs, 40).select("doc_id", F.expr("array_join(transform(oversized, x -> concat(x.seg_idx, ':', x.word_count)), '|')").alias("oversized"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'peer' WHEN 1 THEN '10.0.0.1' ELSE '2.2.2.2' END AS ip FROM events")
def p15_client_ip(spark, d):
    return table(spark, d, "events", "event_id", "case event_id % 3 when 1 then '10.0.0.1' when 2 then '1.1.1.1, 2.2.2.2, 3.3.3.3' end as xff").select("event_id", checks.client_ip(F.col("xff"), F.lit("peer"), 1).alias("ip"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')")
def p16_drop_health(spark, d):
    return checks.drop_health(table(spark, d, "events", "event_id", "case event_type when 'view' then '/health' when 'click' then '/metrics' else '/tts' end as path")).select("event_id")


@query("SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 409 WHEN 2 THEN 404 WHEN 3 THEN 400 WHEN 4 THEN 410 WHEN 5 THEN 500 ELSE 200 END AS INTEGER) AS code FROM events")
def p17_download_check(spark, d):
    df = table(spark, d, "events", "event_id", "case event_id % 7 when 0 then null when 1 then 'queued' else 'completed' end as status", "case event_id % 7 when 2 then null when 3 then 'local://../x' else 'local://x' end as audio_uri", "case event_id % 7 when 4 then null when 5 then 0 else 9 end as file_size")
    return checks.download_check(df).select("event_id", "code")


@query("SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 400 ELSE least(1000, greatest(10, event_id % 2000)) END AS INTEGER) AS chunk_words, CAST(least(32, greatest(1, event_id % 64)) AS INTEGER) AS workers, CAST(86400 AS INTEGER) AS job_ttl FROM events")
def p18_clamp_config(spark, d):
    return checks.clamp_config(table(spark, d, "events", "event_id", "case when event_id % 4 = 0 then 'many' else cast(event_id % 2000 as string) end as chunk_words", "cast(event_id % 64 as string) as workers", "cast(null as string) as job_ttl"))


# numbers and paths


@query("SELECT event_id, round(abs(12 * log2((value + 100) / 110)), 6) AS semitones, round(20 * log10((value + 1) / 1000), 6) AS dbfs FROM events")
def n3_semitones(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(V.semitones(F.col("value") + 100, F.lit(110.0)), 6).alias("semitones"), F.round(V.dbfs((F.col("value") + 1) / 1000), 6).alias("dbfs"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 9 = 0 THEN 400 ELSE greatest(200, least(CASE WHEN event_id % 2 = 0 THEN 400 ELSE 300 END, floor((event_id % 1000 - 512) * 1048576.0 / 150000 / 5.54))) END AS BIGINT) AS words FROM events")
def n4_segment_budget(spark, d):
    return table(spark, d, "events", "event_id", "case when event_id % 9 = 0 then null else event_id % 1000 end as free", "case when event_id % 2 = 0 then 'q-1.7B' else 'q-0.6B' end as model").select("event_id", V.segment_budget(F.col("free"), F.col("model")).alias("words"))


@query("SELECT event_id, CASE WHEN value > CAST(user_id % 50 AS DOUBLE) * CAST(0.40 AS DOUBLE) * CAST(1.6 AS DOUBLE) THEN 'too long' WHEN value < CAST(user_id % 50 AS DOUBLE) * CAST(0.40 AS DOUBLE) * CAST(0.4 AS DOUBLE) THEN 'too short' ELSE 'ok' END AS verdict FROM events WHERE value IS NOT NULL")
def n5_length_verdict(spark, d):
    return table(spark, d, "events", "event_id", "value", "user_id").filter("value is not null").select("event_id", V.length_verdict(F.col("value"), F.col("user_id") % 50).alias("verdict"))


@query("SELECT event_id, array_to_string(list_transform(range(0, greatest(event_id % 7 - 1, 0)), lambda k: CAST(least(CAST(power(2, k) AS BIGINT), 10) AS VARCHAR)), ',') AS delays FROM events")
def n6_backoff(spark, d):
    return table(spark, d, "events", "event_id").select("event_id", F.array_join(F.transform(V.backoff(F.lit(1.0), F.lit(10.0), (F.col("event_id") % 7).cast("int")), lambda x: x.cast("long").cast("string")), ",").alias("delays"))


@query("SELECT event_id, round(least(coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value / 100 END, 0), 0.3) + 0.15, 0.55), 9) AS temperature, CAST(0.9 AS DOUBLE) AS top_p FROM events")
def n7_quote_params(spark, d):
    p = V.quote_params(F.col("t"), F.lit(0.0))
    return table(spark, d, "events", "event_id", "case when event_id % 3 = 0 then 0.0D else value / 100 end as t").select("event_id", F.round(p["temperature"], 9).alias("temperature"), F.round(p["top_p"], 9).alias("top_p"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 0 ELSE greatest(1, least(4, floor((value - 8) / 2))) END AS INTEGER) AS slots FROM events WHERE value IS NOT NULL")
def n8_parallel_slots(spark, d):
    df = table(spark, d, "events", "event_id", "case event_id % 4 when 0 then 'cpu_only' when 1 then 'mid_vram' else 'low_vram' end as tier", "value").filter("value is not null")
    return df.select("event_id", V.parallel_slots(F.col("tier"), F.col("value"), F.lit(5), F.lit(2), F.lit(1), F.lit(2.0)).alias("slots"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x/y.mp3' WHEN 1 THEN 'z.mp3' ELSE 'pre/site/' || CAST(event_id AS VARCHAR) || '.mp3' END AS path FROM events")
def s6_object_path(spark, d):
    return table(spark, d, "events", "event_id", "case event_id % 3 when 0 then '/x/y/' when 1 then 'z.mp3' end as e").select("event_id", V.object_path(F.lit("pre"), F.lit("site"), F.col("event_id").cast("string"), F.col("e")).alias("path"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://storage.googleapis.com/b/k.mp3' WHEN 1 THEN 'https://b.s3.us-east-1.amazonaws.com/k/l.mp3' WHEN 2 THEN 'http://localhost:8000/k.mp3' END AS url, CASE WHEN event_id % 4 = 3 THEN 'unknown scheme: ftp' END AS reason FROM events")
def s7_public_url(spark, d):
    u = V.public_url(F.col("u"))
    return table(spark, d, "events", "event_id", "case event_id % 4 when 0 then 'gs://b/k.mp3' when 1 then 's3://b/k/l.mp3' when 2 then 'local://k.mp3' else 'ftp://x' end as u").select("event_id", u["url"].alias("url"), u["reason"].alias("reason"))


@query("SELECT CAST(page_id AS VARCHAR) AS post_id, url FROM pages WHERE page_id % 2 = 0")
def s1_read_articles(spark, d):
    """Articles landed as files, read with their filter."""
    path = new_folder(spark, "articles")
    table(spark, d, "pages", "cast(page_id as string) as post_id", "concat('p-', page_id) as slug", "'a title' as title", "html", "'text' as plaintext", "url", "case when page_id % 2 = 0 then 'published' else 'draft' end as status", "'x' as lexical").write.parquet(path)
    return tables.read_articles(spark, path).select("post_id", "url")


@query("SELECT doc_id, doc_id % 3 = 0 AS ok FROM documents")
def s3_read_static(spark, d):
    ok, bad = tables.read_static(table(spark, d, "documents", "doc_id", "case when doc_id % 3 <> 1 then 'text' else ' ' end as plain_text", "cast(doc_id as string) as job_id", "case when doc_id % 3 <> 2 then 'p' end as storage_path"))
    return ok.select("doc_id", F.lit(True).alias("ok")).unionByName(bad.select("doc_id", F.lit(False).alias("ok")))


@query(f"SELECT job_id, ts, '{{\"job_id\":\"' || job_id || '\",\"status\":\"' || status || '\"' || CASE WHEN audio_uri IS NOT NULL THEN ',\"audio_uri\":\"' || audio_uri || '\",\"gcs_uri\":\"' || audio_uri || '\"' ELSE '' END || CASE WHEN error IS NOT NULL THEN ',\"error\":\"' || error || '\"' ELSE '' END || '}}' AS payload FROM {_EV} WHERE status IN ('completed', 'failed')")
def s8_notifications(spark, d):
    return tables.notifications(events(spark, d))


@query(f"SELECT event_id, ts >= {_NOW} - INTERVAL 604800 SECONDS AS live FROM events")
def s10_retention(spark, d):
    ev, now = table(spark, d, "events", "event_id", "ts"), F.expr("timestamp'2024-01-31 00:00:00'")
    return tables.live(ev, "ts", 604_800, now).select("event_id", F.lit(True).alias("live")).unionByName(tables.expired(ev, "ts", 604_800, now).select("event_id", F.lit(False).alias("live")))


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS post_id, CASE WHEN page_id % 3 = 0 THEN 's' END AS slug, CASE WHEN page_id % 3 = 2 THEN 'published' END AS status FROM pages")
def s2_extract_post(spark, d):
    raw = "case page_id % 3 when 0 then concat('{\"post\":{\"current\":{\"id\":\"', page_id, '\",\"slug\":\"s\"}}}') when 1 then concat('{\"body\":{\"post\":{\"id\":\"', page_id, '\"}}}') else concat('{\"id\":\"', page_id, '\",\"status\":\"published\"}') end as raw"
    return tables.extract_post(table(spark, d, "pages", "page_id", raw)).select("page_id", "post_id", "slug", "status")


# signals: clips derived from vectors and events

_LEVELS = "CAST(user_id AS STRING) AS job_id, CAST(event_id AS INTEGER) AS seg_idx, -value AS dbfs"


@query("SELECT job_id, median(dbfs) AS median_dbfs FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, -value AS dbfs FROM events) WHERE dbfs IS NOT NULL GROUP BY job_id HAVING count(*) >= 2")
def a7_job_median_dbfs(spark, d):
    return audio.job_median_dbfs(sql_of(spark, d, "events", _LEVELS))


@query("SELECT e.job_id, e.seg_idx FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS INTEGER) AS seg_idx, -value AS dbfs FROM events) e JOIN (SELECT CAST(user_id AS VARCHAR) AS job_id, median(-value) AS m FROM events GROUP BY 1 HAVING count(value) >= 2) m ON m.job_id = e.job_id WHERE abs(e.dbfs - m.m) > 3.0")
def w17_loudness_outliers(spark, d):
    return audio.loudness_outliers(sql_of(spark, d, "events", _LEVELS)).select("job_id", "seg_idx")


_FRAMES = "CAST(user_id AS STRING) AS job_id, 0 AS seg_idx, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS frame_idx, value / 1000 AS rms"
_FR = f"(SELECT {_FRAMES} FROM events)"


def _frames(spark, d):
    return sql_of(spark, d, "events", _FRAMES)


@query(f"SELECT job_id, frame_idx, coalesce(rms > 1.41 * lag(rms) OVER (PARTITION BY job_id ORDER BY frame_idx) AND rms > 0.01, false) AS onset FROM {_FR}")
def w7_onsets(spark, d):
    return audio.onsets(_frames(spark, d)).select("job_id", "frame_idx", "onset")


@query(f"SELECT job_id, round(count(*) FILTER (o) / (n * 0.01), 6) AS onset_rate FROM (SELECT job_id, coalesce(rms > 1.41 * lag(rms) OVER (PARTITION BY job_id ORDER BY frame_idx) AND rms > 0.01, false) AS o, count(*) OVER (PARTITION BY job_id) AS n FROM {_FR}) GROUP BY job_id, n")
def a11_onset_rate(spark, d):
    return audio.onset_rate(_frames(spark, d)).select("job_id", F.round("onset_rate", 6).alias("onset_rate"))


@query(f"SELECT job_id, round(20 * log10(quantile_cont(rms, 0.05)), 6) AS floor_dbfs, 20 * log10(quantile_cont(rms, 0.05)) <= -55 AS quiet FROM {_FR} WHERE rms > 0 GROUP BY job_id")
def a9_noise_floor(spark, d):
    return audio.noise_floor(_frames(spark, d)).select("job_id", F.round("floor_dbfs", 6).alias("floor_dbfs"), "quiet")


@query(f"SELECT job_id, frame_idx, round(median(rms) OVER (PARTITION BY job_id ORDER BY frame_idx ROWS BETWEEN 40 PRECEDING AND CURRENT ROW), 9) AS local FROM {_FR}")
def w8_local_median(spark, d):
    return audio.local_median(_frames(spark, d)).select("job_id", "frame_idx", F.round("local", 9).alias("local"))


@query(f"SELECT job_id, CAST(CASE WHEN lo > 10 THEN lo ELSE 0 END AS INTEGER) AS first_block, CAST(CASE WHEN n - 1 - hi > 10 THEN hi + 1 ELSE n END AS INTEGER) AS end_block FROM (SELECT job_id, min(frame_idx) FILTER (rms > 0 AND 20 * log10(CASE WHEN rms > 0 THEN rms ELSE 1 END) > -28) AS lo, max(frame_idx) FILTER (rms > 0 AND 20 * log10(CASE WHEN rms > 0 THEN rms ELSE 1 END) > -28) AS hi, count(*) AS n FROM {_FR} GROUP BY job_id)")
def w11_trim_bounds(spark, d):
    scaled = _frames(spark, d).withColumn("rms", F.col("rms") * F.pow(F.lit(10.0), F.lit(-22 / 20)))
    return audio.trim_bounds(scaled).select("job_id", "first_block", "end_block")


_RUNS = f"""
WITH fr AS (SELECT job_id, frame_idx, CASE WHEN frame_idx % {{period}} > {{quiet}} THEN 0 ELSE rms + 0.02 END AS rms FROM {_FR})"""


@query(
    _RUNS.format(period=61, quiet=45)
    + """, m AS (SELECT *, median(rms) OVER (PARTITION BY job_id ORDER BY frame_idx ROWS BETWEEN 40 PRECEDING AND CURRENT ROW) AS local FROM fr),
l AS (SELECT *, CASE WHEN local < 0.01 THEN 'quiet' WHEN rms < 0.1 * local THEN 'low' ELSE 'normal' END AS label FROM m WHERE frame_idx >= 40),
c AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY job_id ORDER BY frame_idx) IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT job_id, run, label, count(*) AS n, min(frame_idx) AS start FROM r GROUP BY job_id, run, label),
e AS (SELECT *, lead(label) OVER (PARTITION BY job_id ORDER BY run) AS after FROM g)
SELECT job_id, CAST(0 AS INTEGER) AS seg_idx, start, CAST(n * 0.05 AS DOUBLE) AS seconds FROM e WHERE label = 'low' AND after = 'normal' AND n >= 12 AND n <= 40"""
)
def w9_drops(spark, d):
    return audio.drops(_frames(spark, d).withColumn("rms", F.when(F.col("frame_idx") % 61 > 45, 0.0).otherwise(F.col("rms") + 0.02)))


@query(
    _RUNS.format(period=100, quiet=55)
    + """, r AS (SELECT *, sum(CASE WHEN rms > 0 AND 20 * log10(CASE WHEN rms > 0 THEN rms ELSE 1 END) >= -40 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS run,
  rms <= 0 OR 20 * log10(CASE WHEN rms > 0 THEN rms ELSE 1 END) < -40 AS silent FROM fr),
g AS (SELECT job_id, run, count(*) FILTER (silent) AS n FROM r GROUP BY job_id, run)
SELECT job_id, CAST(0 AS INTEGER) AS seg_idx, count(*) FILTER (n * 0.05 >= 2.0) AS gaps FROM g GROUP BY job_id"""
)
def a15_silence_gaps(spark, d):
    return audio.silence_gaps(_frames(spark, d).withColumn("rms", F.when(F.col("frame_idx") % 100 > 55, 0.0).otherwise(F.col("rms") + 0.02)))


_CLIPS = "CAST(label AS STRING) AS job_id, CAST(vec_id AS INTEGER) AS seg_idx, 100 AS sr, embedding AS samples"


def _clips(spark, d):
    return sql_of(spark, d, "embeddings", _CLIPS)


def total(samples):
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double"))


@query("SELECT seg_idx, round(sqrt(list_sum(list_transform(s, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(s)), 6) AS rms, round(len(s) / 100.0, 6) AS seconds FROM (SELECT CAST(vec_id AS INTEGER) AS seg_idx, embedding AS s FROM embeddings)")
def g2_clip_levels(spark, d):
    return audio.clip_levels(_clips(spark, d)).select("seg_idx", F.round("rms", 6).alias("rms"), F.round("seconds", 6).alias("seconds"))


@query("SELECT seg_idx, CAST(i / 5 AS INTEGER) AS frame_idx, round(sqrt(list_sum(list_transform(s[i + 1:i + 10], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 10), 6) AS rms FROM (SELECT CAST(vec_id AS INTEGER) AS seg_idx, embedding AS s, unnest(range(0, len(embedding) - 10 + 1, 5)) AS i FROM embeddings)")
def g1_frames(spark, d):
    return audio.frame_rms(audio.frames(_clips(spark, d), 100, 50)).select("seg_idx", "frame_idx", F.round("rms", 6).alias("rms"))


@query("SELECT CAST(vec_id AS INTEGER) AS seg_idx, CAST(least(len(embedding), 20) AS INTEGER) AS n, round(CAST(embedding[greatest(len(embedding) - 19, 1)] AS DOUBLE), 6) AS first_sample FROM embeddings")
def g7_tail(spark, d):
    return audio.tail(_clips(spark, d), 200).select("seg_idx", F.size("samples").alias("n"), F.round(F.element_at("samples", 1).cast("double"), 6).alias("first_sample"))


@query("SELECT CAST(vec_id // 3 AS VARCHAR) AS job_id, CAST(sum(len(embedding)) + (count(*) - 1) * 5 AS INTEGER) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 3) AS total, round(arg_max(CAST(embedding[-1] AS DOUBLE), vec_id), 5) AS last_sample FROM embeddings GROUP BY vec_id // 3")
def g9_join_clips(spark, d):
    clips = sql_of(spark, d, "embeddings", "CAST(vec_id div 3 AS STRING) AS job_id, CAST(vec_id % 3 AS INTEGER) AS seg_idx, 100 AS sr, embedding AS samples, 50 AS gap_ms")
    parts = audio.join_clips(clips).select("job_id", "part_idx", F.size("samples").alias("n"), total(F.col("samples")).alias("total"), F.element_at("samples", -1).cast("double").alias("end"))
    return parts.groupBy("job_id").agg(F.sum("n").cast("int").alias("n"), F.round(F.sum("total"), 3).alias("total"), F.round(F.max_by("end", "part_idx"), 5).alias("last_sample"))


def tones(spark, d, seconds: str = "1 + 0.5 * (vec_id % 3)", sr: int = 4000):
    """A clip of harmonics for each vector, whose cells set pitch and strengths."""
    base = sql_of(spark, d, "embeddings", f"CAST(vec_id AS STRING) AS job_id, 0 AS seg_idx, {sr} AS sr, vec_id, embedding, 90 + 60 * abs(CAST(embedding[0] AS DOUBLE)) + vec_id % 40 AS hz, {seconds} AS s")
    wave = lambda k: F.coalesce(F.try_element_at("embedding", F.lit(k + 1)), F.lit(0.1)).cast("double")
    tone = F.transform(F.sequence(F.lit(0), (F.col("s") * sr).cast("int") - 1), lambda i: (0.3 * F.sin(i * F.col("hz") * 2 * 3.141592653589793 / sr) + 0.1 * wave(1) * F.sin(i * F.col("hz") * 4 * 3.141592653589793 / sr)).cast("float"))
    return base.repartition(spark.sparkContext.defaultParallelism).select("job_id", "seg_idx", "sr", "vec_id", tone.alias("samples"))


@query()
def g5_acoustic_gate(spark, d):
    """Tones made from the vectors, judged with their features."""
    return audio.acoustic_gate(tones(spark, d).withColumn("word_count", F.lit(3)).withColumn("ref_f0", F.lit(120.0)))


@query(
    """WITH RECURSIVE r AS (SELECT user_id AS key, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (
  SELECT key, ts, n, [t] AS kept, true AS accepted FROM r WHERE n = 1
  UNION ALL
  SELECT key, ts, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM (SELECT r.key, r.ts, r.t, r.n, list_filter(f.kept, lambda x: x > r.t - 36000) AS live FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
)
SELECT key, ts, accepted FROM f"""
)
def st3_rate_limited(spark, d):
    """The sliding-log limiter's batch form over all requests."""
    return folds.rate_limited(table(spark, d, "events", "user_id as key", "ts"), limit=3, window_s=36_000)


# prompts, texts and lookups


@query("SELECT doc_id, substr('ValueError: ' || text, 1, 450) AS error FROM documents")
def n12_error_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", V.error_text(F.lit("ValueError"), F.col("text")).alias("error"))


@query("SELECT event_id, '{\"value\":\"' || event_type || '\"}' AS json FROM events")
def n13_json_safe(spark, d):
    return table(spark, d, "events", "event_id", "event_type").select("event_id", V.json_safe(F.col("event_type")).alias("json"))


@query("SELECT doc_id, CASE WHEN r < 0.25 THEN 'Far too short (' || CAST(CAST(floor(r * 100) AS BIGINT) AS VARCHAR) || '%). Tell all of the ' || CAST(n_chars AS VARCHAR) || ' words again:' || chr(10) || chr(10) || text WHEN doc_id % 3 = 0 THEN 'Too short (' || CAST(CAST(floor(r * 100) AS BIGINT) AS VARCHAR) || '%). Tell it in full, about ' || CAST(n_chars AS VARCHAR) || ' words:' || chr(10) || chr(10) || text ELSE 'Left out:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || 'Tell it in full, about ' || CAST(n_chars AS VARCHAR) || ' words:' || chr(10) || chr(10) || text END AS prompt FROM (SELECT *, (doc_id % 8) / 8.0 AS r FROM documents)")
def n11_retry_prompt(spark, d):
    df = table(spark, d, "documents", "doc_id", "text", "n_chars", "(doc_id % 8) / 8D as r", "case when doc_id % 3 = 0 then array('[META] x') else array('a', '[WORD] y', 'b') end as missing")
    return df.select("doc_id", V.retry_prompt(F.col("r"), F.col("missing"), F.col("text"), F.col("n_chars")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Base.' || chr(10) || chr(10) || 'Mark breaths with [PAUSE] and changes of topic with [LONG_PAUSE].' ELSE 'Base.' END || chr(10) || chr(10) || 'SECTION 1 of 1' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Go on from: end.' ELSE '' END AS system, '/no_think' || chr(10) || text AS ask FROM documents")
def n10_prompt(spark, d):
    df = table(spark, d, "documents", "doc_id", "text", "case when doc_id % 2 = 0 then 'high_vram' else 'low_vram' end as tier", "case when doc_id % 3 = 0 then 'end.' else '' end as tail")
    messages = V.prompt(F.lit("Base."), F.col("tier"), F.lit(""), F.lit("SECTION 1 of 1"), F.col("tail"), F.col("text"), direct=True)
    return df.select("doc_id", messages.alias("m")).selectExpr("doc_id", "m[0].content as system", "m[1].content as ask")


@query("SELECT event_id, array_to_string(list_filter(['[M] x', 'a' || CAST(event_id AS VARCHAR), 'b', 'c', 'd', 'e', 'f'], lambda x: NOT starts_with(x, '['))[1:5], '|') AS top FROM events")
def t3_top_missing(spark, d):
    items = F.expr("array('[M] x', concat('a', cast(event_id as string)), 'b', 'c', 'd', 'e', 'f')")
    return table(spark, d, "events", "event_id").select("event_id", F.array_join(V.top_missing(items), "|").alias("top"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n FROM documents")
def w6_merge_short_tail(spark, d):
    from speechprep.functions.text import merge_short_tail

    df = table(spark, d, "documents", "doc_id", "array(text, repeat('w ', case when doc_id % 2 = 0 then 39 else 40 end)) as s")
    return df.select("doc_id", F.size(merge_short_tail(F.col("s"))).alias("n"))


@query("SELECT event_id, CASE WHEN user_id % 5 < 3 THEN CAST(100 + user_id % 5 AS DOUBLE) END AS ref_f0 FROM events")
def j14_reference_pitch(spark, d):
    voices = table(spark, d, "events", "user_id % 5 as voice", "cast(100.0 + user_id % 5 as double) as f0").filter("voice < 3").distinct()
    return audio.with_reference_f0(table(spark, d, "events", "event_id", "user_id % 5 as voice"), voices).select("event_id", "ref_f0")


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seg_idx, CASE WHEN event_id % 4 = 0 THEN 'heard ' || event_type END AS transcript FROM events WHERE event_id % 200000 <= 120000")
def j15_pair_transcripts(spark, d):
    clips = table(spark, d, "events", "cast(user_id as string) as job_id", "event_id as seg_idx", "event_id % 200000 as duration_ms")
    heard = table(spark, d, "events", "cast(user_id as string) as job_id", "event_id as seg_idx", "case when event_id % 4 = 0 then concat('heard ', event_type) else ' ' end as transcript")
    return audio.pair_transcripts(clips, heard).select("job_id", "seg_idx", "transcript")


@query(f"SELECT 'jobs_' || k AS metric, CAST(NULL AS DOUBLE) AS le, CAST(v AS DOUBLE) AS value FROM (SELECT 'created' AS k, count(*) FILTER (status = 'queued') AS v FROM {_EV} UNION ALL SELECT 'completed', count(*) FILTER (status = 'completed') FROM {_EV} UNION ALL SELECT 'failed', count(*) FILTER (status = 'failed') FROM {_EV} UNION ALL SELECT 'cancelled', 0 UNION ALL SELECT 'active', count(*) FILTER (status = 'queued') - count(*) FILTER (status IN ('completed', 'failed')) FROM {_EV}) UNION ALL SELECT 'job_bucket', e.le, CAST(count(*) FILTER (duration_s <= e.le) AS DOUBLE) FROM {_EV} CROSS JOIN (VALUES (1.0), (10.0), (CAST('inf' AS DOUBLE))) AS e(le) GROUP BY e.le")
def s9_metrics_table(spark, d):
    ev = events(spark, d)
    return tables.metrics_table(jobs.job_counters(ev), jobs.duration_histogram(ev, "duration_s", [1, 10]), "job").drop("line")


_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"SELECT event_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode('v' || CAST(event_id AS VARCHAR))))) AS sig, event_id % 2 = 0 AS ok FROM events")
def p14_verify_hmac(spark, d):
    body = F.concat(F.lit("v"), F.col("event_id").cast("string"))
    signed = table(spark, d, "events", "event_id").withColumn("sig", V.hmac_sha256(body, b"key"))
    given = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sha256="), F.upper("sig"), F.lit(",t=1"))).otherwise(F.concat(F.lit("0"), F.substring("sig", 2, 63)))
    return signed.select("event_id", "sig", (checks.verify_hmac(body, given, b"key") & (F.col("event_id") % 2 == 0)).alias("ok"))


@query()
def a14_clip_features(spark, d):
    """Pitch, flatness, loudness and true peak of tones made from the vectors."""
    return audio.features(tones(spark, d).withColumn("ref_f0", F.lit(120.0)).drop("vec_id"))
