"""Job state, counters, joins and windows over ``job_events(job_id, ts, status, audio_uri, error, duration_s)`` and its kin."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.functions.text import gap_ms, post_of_job, tail_sentences, word_count

#: Edges of the duration histograms, in seconds.
EDGES = {"job": [1, 5, 10, 30, 60, 120, 300], "job_duration": [1, 5, 10, 30, 60, 120, 300, 600], "synthesis": [0.1, 0.5, 1, 2, 5, 10, 30, 60], "upload": [0.5, 1, 2, 5, 10, 30], "narration": [1, 5, 10, 20, 30, 60]}
TERMINAL = ("completed", "failed", "deleted")


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


# joins


def backfill_candidates(articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Articles without an audio element and without a job."""
    return articles.filter(~F.col("html").rlike(r"(?i)<audio[^>]*>")).join(jobs.select("post_id").distinct(), "post_id", "left_anti")


def submit(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First submission of each unknown job; all others with the status they meet."""
    ranked = new.withColumn("#n", F.row_number().over(Window.partitionBy("job_id").orderBy("ts")))
    created = ranked.filter("`#n` = 1").join(existing.select("job_id"), "job_id", "left_anti").drop("#n")
    known = ranked.join(existing.select("job_id", "status"), "job_id").drop("#n")
    again = ranked.filter("`#n` > 1").join(existing.select("job_id"), "job_id", "left_anti").drop("#n").withColumn("status", F.lit("queued"))
    return created, known.unionByName(again)


def pair_chunks(src: DataFrame, out: DataFrame) -> DataFrame:
    return src.join(out.withColumnRenamed("text", "out_text").hint("merge"), ["doc_id", "seg_idx"])


def match_entities(entities: DataFrame, outputs: DataFrame) -> DataFrame:
    """``entities(doc_id, value, forms)`` against ``outputs(doc_id, text)``: ``found`` if any form occurs, case folded."""
    met = entities.join(outputs.hint("merge"), "doc_id")
    return met.groupBy("doc_id", "value").agg(F.max(F.exists("forms", lambda f: F.lower("text").contains(F.lower(f)))).alias("found"))


def missing_entities(entities: DataFrame, outputs: DataFrame) -> DataFrame:
    return match_entities(entities, outputs).filter("not found").select("doc_id", "value")


class Hostnames:
    """An automaton of all hostnames (Aho and Corasick): each state knows the best site that ends there or in one of its suffixes."""

    def __init__(self, sites: list[tuple]):
        self.next: list[dict[str, int]] = [{}]
        self.best: list[tuple | None] = [None]
        for rank, slug, hostname in sites:
            state = 0
            for c in hostname:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.best.append(None)
                state = self.next[state][c]
            self.best[state] = min(filter(None, (self.best[state], (rank, slug))))
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for c, to in self.next[state].items():
                self.fail[to] = self._step(self.fail[state], c)
                waiting.append(to)
            self.best[state] = min(filter(None, (self.best[state], self.best[self.fail[state]])), default=None)
        if self.best[0]:  # an empty hostname is part of any
            self.best = [min(filter(None, (b, self.best[0]))) for b in self.best]

    def _step(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(c, 0)

    def slug(self, host: str) -> str | None:
        """The slug of the least rank among hostnames in ``host``, in one pass over it."""
        state, found = 0, self.best[0]
        for c in host:
            state = self._step(state, c)
            b = self.best[state]
            if b and (found is None or b < found):
                found = b
        return found and found[1]


def route_site(df: DataFrame, sites: DataFrame, most: int = 10_000) -> DataFrame:
    """The first site, by rank and then slug, whose hostname is part of the url's, else the hostname with dashes.

    ``sites(rank, slug, hostname)`` above ``most`` are refused, so the table that each worker makes its automaton of is bounded; only hostnames go to it.
    """
    listed = [tuple(r) for r in sites.filter("hostname is not null").select("rank", "slug", "hostname").limit(most + 1).collect()]
    if len(listed) > most:
        raise ValueError(f"over {most} sites")
    table = df.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("string")
    def routed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, known = Hostnames(table.value), {}
        for hosts in batches:
            if len(known) > 100_000:
                known.clear()
            known.update({h: names.slug(h) for h in hosts.unique() if h not in known})
            yield hosts.map(known)

    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    return df.withColumn("site_slug", F.coalesce(routed(host), F.replace(host, F.lit("."), F.lit("-"))))


def assign_tier(hosts: DataFrame, tiers: DataFrame, most: int = 1000) -> DataFrame:
    """``hosts(vram_gb)`` to ``tiers(tier, lo_gb, hi_gb)``.  Tiers above ``most`` are refused, so the broadcast is bounded."""
    if tiers.limit(most + 1).count() > most:
        raise ValueError(f"over {most} tiers")
    return hosts.join(F.broadcast(tiers), (F.col("vram_gb") >= F.col("lo_gb")) & (F.col("vram_gb") < F.col("hi_gb")), "left").withColumn("tier", F.coalesce("tier", F.lit("cpu_only")))


def effective_params(defaults: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """One row of defaults under each row of overrides; an omitted value keeps the default, or null without defaults."""
    row = defaults.select(*columns).first()  # one row at most
    types = {f.name: f.dataType for f in defaults.schema}
    others = [c for c in overrides.columns if c not in columns]
    return overrides.select(*others, *[F.coalesce(F.col(c), F.lit(row[c] if row else None).cast(types[c])).alias(c) for c in columns])


def resolve_voice(df: DataFrame, voices: DataFrame) -> DataFrame:
    """Path of the named profile, else of ``default``; ``missing`` marks a named profile that isn't there."""
    own = voices.select(F.col("name").alias("voice_profile"), F.col("path").alias("own_path"))
    fallback = voices.filter("name = 'default'").limit(1).select(F.col("path").alias("default_path"))
    return df.join(own, "voice_profile", "left").join(F.broadcast(fallback), how="left").withColumn("missing", F.col("own_path").isNull() & (F.col("voice_profile") != "default")).withColumn("path", F.coalesce("own_path", "default_path")).drop("own_path", "default_path")


def callbacks(events: DataFrame, articles: DataFrame) -> DataFrame:
    return events.filter("status = 'completed'").withColumn("post_id", post_of_job(F.col("job_id"))).join(articles, "post_id")


def job_outcome(submissions: DataFrame, statuses: DataFrame, first_s: int = 600, last_s: int = 1800) -> DataFrame:
    """First status within ``first_s`` of submission and terminal one within ``last_s``; which limit broke otherwise."""
    s = statuses.select(F.col("job_id").alias("sid"), F.col("ts").alias("at"), "status")
    near = submissions.join(s, (F.col("job_id") == F.col("sid")) & (F.col("at") >= F.col("ts")) & (F.col("at") <= F.col("ts") + F.expr(f"interval {last_s} seconds")), "left")
    ended = F.col("status").isin(*TERMINAL)
    out = near.groupBy("job_id", "ts").agg(F.min("at").alias("first_at"), F.min(F.when(ended, F.col("at"))).alias("ended_at"), F.min_by("status", F.when(ended, F.col("at"))).alias("outcome"))
    late = F.col("first_at").isNull() | (F.col("first_at") > F.col("ts") + F.expr(f"interval {first_s} seconds"))
    return out.withColumn("outcome", F.when(late, "no status").when(F.col("ended_at").isNull(), "not finished").otherwise(F.col("outcome")))


def status_as_of(polls: DataFrame, events: DataFrame) -> DataFrame:
    """Last status at or before each poll: union and one window, so one shuffle.  At equal times events come first."""
    rows = events.select("job_id", "ts", "status", F.lit(0).alias("poll")).unionByName(polls.select("job_id", "ts", F.lit(None).cast("string").alias("status"), F.lit(1).alias("poll")))
    w = Window.partitionBy("job_id").orderBy("ts", "poll").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("status", F.last("status", ignorenulls=True).over(w)).filter("poll = 1").select("job_id", "ts", "status")


def memoize(df: DataFrame, keys: list[str], compute, cache: DataFrame, now: Column, ttl_s: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``value``, new cache entries): only keys without a live entry reach ``compute(df) -> key columns, value``."""
    key = F.sha2(F.to_json(F.struct(*keys)), 256)
    keyed, live = df.withColumn("cache_key", key), cache.filter(F.col("stored_at") >= now - F.make_interval(secs=F.lit(ttl_s)))
    miss = keyed.select("cache_key", *keys).join(live, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    fresh = compute(miss).select("cache_key", "value")
    return keyed.join(live.select("cache_key", "value").unionByName(fresh).hint("merge"), "cache_key", "left"), fresh.filter("value is not null").withColumn("stored_at", now)


# aggregates


def job_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("jobs"))


def job_counters(events: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("status") == s).alias(k) for k, s in (("created", "queued"), ("completed", "completed"), ("failed", "failed"), ("cancelled", "deleted"))}
    return events.agg(*n.values()).withColumn("active", F.col("created") - F.col("completed") - F.col("failed") - F.col("cancelled"))


def duration_histogram(df: DataFrame, column: str, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative ``le`` buckets as one row per edge with ``sum`` and ``count``; the last edge is infinite.  One pass, edges are literals."""
    v = F.col(column)
    sums = [F.count_if(v <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    agg = df.groupBy(*(by or [])).agg(*sums, F.count(v).alias("count"), F.sum(v).alias("sum"))
    cells = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("n"))]
    return agg.select(*(by or []), "sum", "count", F.inline(F.array(*cells)))


def backfill_summary(df: DataFrame) -> DataFrame:
    """``df(site, outcome)`` -> per site and in all (site null): triggered, already done, skipped, errors."""
    return df.rollup("site").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("triggered", "done", "skipped", "error")])


def cache_stats(df: DataFrame) -> DataFrame:
    out = df.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_ratio", F.try_divide("hits", F.col("hits") + F.col("misses")))


def reassemble(chunks: DataFrame) -> DataFrame:
    """Texts of a document in order, joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def segment_plan(segs: DataFrame, by: str = "doc_id") -> DataFrame:
    return segs.groupBy(by).agg(F.count("*").alias("segments"), F.sum("word_count").alias("words"), F.max("word_count").alias("longest"))


def fidelity_summary(pairs: DataFrame) -> DataFrame:
    """``pairs(doc_id, text, out_text, missing)``: words, ratio and entities missing of each document."""
    out = pairs.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("source_words"), F.sum(word_count(F.col("out_text"))).alias("output_words"), F.sum("missing").alias("missing"))
    return out.withColumn("ratio", F.col("output_words") / F.greatest("source_words", F.lit(1)))


def retry_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((~F.col("passed")).cast("double")).alias("retry_rate"))


def list_voices(voices: DataFrame) -> DataFrame:
    return voices.select("name").distinct().unionByName(voices.sparkSession.createDataFrame([("default",)], "name string")).distinct()


# windows


def with_position(chunks: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id")
    i, n = F.row_number().over(by.orderBy("seg_idx")), F.count("*").over(by)
    return chunks.withColumn("position", F.format_string("SECTION %d of %d, ~%d words", i, n, word_count(F.col("text"))))


def with_tails(chunks: DataFrame, n: int = 3) -> DataFrame:
    """Last sentences of the chunk before."""
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    return chunks.withColumn("tail", F.lag(tail_sentences(F.col("text"), n)).over(w))


def with_overlap(chunks: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` paragraphs of the chunk before put in front."""
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    paras = F.split("text", "\n\n")
    last = F.array_join(F.slice(paras, F.greatest(F.size(paras) - n + 1, F.lit(1)), n), "\n\n")
    return chunks.withColumn("text", F.concat_ws("\n\n", F.lag(last).over(w), F.col("text")))


def gap_after(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    return chunks.withColumn("gap_ms", gap_ms(F.col("text"), F.lead("text").over(w)))


def choose_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap_ms", F.coalesce(F.when(F.col("explicit_ms") > 0, F.col("explicit_ms")), F.col("gap_ms"), F.lit(450)))


def job_snapshot(events: DataFrame, fields: list[str]) -> DataFrame:
    """(job_id, one struct (at, value) for each field, updated_at): the last non-null value of each field and when it came.

    Structs are compared by time, so snapshots of any parts of the events, repeated ones included, merge to that of all.
    """
    at = F.struct("ts", "event_id") if "event_id" in events.columns else F.struct("ts")
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c) for c in fields]
    return events.groupBy("job_id").agg(*last, F.max("ts").alias("updated_at"))


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """A kept snapshot and that of newer (or late) events; the history isn't read again."""
    both = old.unionByName(new)
    return both.groupBy("job_id").agg(*[F.max(c).alias(c) for c in old.columns if c != "job_id"])


def state_of(snapshot: DataFrame) -> DataFrame:
    fields = [c for c in snapshot.columns if c not in ("job_id", "updated_at")]
    return snapshot.select("job_id", *[F.col(f"{c}.value").alias(c) for c in fields], "updated_at")


def job_state(events: DataFrame, fields: list[str]) -> DataFrame:
    """Later events overlay earlier ones field by field: the last non-null value of each."""
    return state_of(job_snapshot(events, fields))


def failure_streaks(events: DataFrame, k: int = 3) -> DataFrame:
    """``events(key, ts, ok)``: runs of ``k`` or more failures without a success between."""
    w = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.count_if("ok").over(w)).filter("not ok")
    return runs.groupBy("key", "run").agg(F.count("*").alias("failures"), F.min("ts").alias("since"), F.max("ts").alias("until")).filter(F.col("failures") >= k).drop("run")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Pauses of ended jobs and resumptions of jobs that aren't paused."""
    w = Window.partitionBy("job_id").orderBy("ts")
    before = F.lag("status").over(w)
    out = events.withColumn("before", before)
    return out.filter(((F.col("status") == "paused") & F.col("before").isin("completed", "failed")) | ((F.col("status") == "resumed") & ~(F.coalesce("before", F.lit("")) == "paused")))


def time_in_state(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("ts")
    spent = events.withColumn("seconds", _seconds(F.lead("ts").over(w)) - _seconds(F.col("ts")))
    return spent.groupBy("job_id", "status").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("times"))


def cap_jobs(state: DataFrame, n: int = 1000) -> DataFrame:
    """The newest ``n`` jobs: a top-k, not a sort of all."""
    return state.orderBy(F.col("updated_at").desc(), "job_id").limit(n)


def worklist(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy("post_id")))


def union_sites(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def ordered(df: DataFrame) -> DataFrame:
    """Chunks in the order of their documents: the index that they carry decides, never the place in a partition."""
    return df.orderBy("doc_id", "seg_idx")


def overdue(events: DataFrame, now: Column, limits: dict[str, int]) -> DataFrame:
    """States that lasted longer than their limit in seconds, up to the next event or ``now``: (job_id, status, since, seconds)."""
    w = Window.partitionBy("job_id").orderBy("ts")
    until = F.coalesce(F.lead("ts").over(w), now)
    spent = events.withColumn("seconds", _seconds(until) - _seconds(F.col("ts")))
    late = F.lit(False)
    for status, most in limits.items():
        late = late | ((F.col("status") == status) & (F.col("seconds") > most))
    return spent.filter(late).select("job_id", "status", F.col("ts").alias("since"), "seconds")
