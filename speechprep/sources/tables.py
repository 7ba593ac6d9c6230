"""Sources and sinks: article files, webhook payloads, WAV files, notifications, metrics, retention."""

from __future__ import annotations

import datetime as dt
import io
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.sources.shared import listed, removed

ARTICLE = "post_id string, slug string, title string, html string, plaintext string, url string, status string"
POST_PLACES = ["$.post.current", "$.current", "$.post", "$.body.post.current", "$.body.post", "$"]


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Published articles; the field list and the status filter reach the scan."""
    return spark.read.schema(ARTICLE).format(fmt).load(path).filter("status = 'published'")


def extract_post(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The post's fields from a payload in any of six shapes: the first place that has an id."""
    v = F.try_parse_json(raw)

    def field(name: str) -> Column:
        return F.coalesce(*[F.when(F.try_variant_get(v, f"{p}.id", "string").isNotNull(), F.try_variant_get(v, f"{p}.{name}", "string")) for p in POST_PLACES])

    return df.withColumn("post", F.struct(*[field(c).alias(to) for c, to in (("id", "post_id"), ("slug", "slug"), ("title", "title"), ("html", "html"), ("plaintext", "plaintext"), ("url", "url"), ("status", "status"))])).select(*df.columns, "post.*")


def read_static(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with plain_text, job_id and storage_path, and the others."""
    ok = F.lit(True)
    for c in ("plain_text", "job_id", "storage_path"):
        ok = ok & (F.coalesce(F.trim(c), F.lit("")) != "")
    return df.filter(ok), df.filter(~ok)


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as w:
        width, ch, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 3:  # the upper three bytes of 32-bit values
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        raw, width = wide.tobytes(), 4
    x = np.frombuffer(raw, dtype={1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return sr, x.reshape(-1, ch).mean(axis=1)


def encode_wav(samples: np.ndarray, sr: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(np.clip(np.round(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_clips(spark: SparkSession, glob: str) -> DataFrame:
    """WAV files (PCM of 8, 16, 24 or 32 bits) as mono float vectors; a file that can't be read has null samples and an ``error``."""
    return decoded(spark.read.format("binaryFile").load(glob), "path string", "content")


def write_clips(df: DataFrame, path: str) -> None:
    """``df(job_id, sr, samples)`` as 16-bit PCM WAV bytes in Parquet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["job_id"]].assign(wav=[encode_wav(x, int(sr)) for x, sr in zip(pdf["samples"], pdf["sr"], strict=True)])

    df.select("job_id", "sr", "samples").mapInPandas(run, "job_id string, wav binary").write.mode("overwrite").parquet(path)


def decoded(df: DataFrame, kept: str, content: str = "wav") -> DataFrame:
    """The columns ``kept`` (as DDL) with ``sr`` and ``samples`` of WAV bytes, or else an ``error``."""
    names = [c.split()[0] for c in kept.split(", ")]

    def read(x) -> tuple:
        try:
            return (*decode_wav(bytes(x)), None)
        except (wave.Error, EOFError, KeyError, ValueError, TypeError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([read(x) for x in pdf[content]], columns=["sr", "samples", "error"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[names], found], axis=1)

    return df.select(*names, content).mapInPandas(run, f"{kept}, sr int, samples array<float>, error string")


def notifications(events: DataFrame) -> DataFrame:
    """The outbox: one JSON payload for each completed or failed job event."""
    payload = F.struct("job_id", "status", F.col("audio_uri"), F.col("audio_uri").alias("gcs_uri"), F.substring("error", 1, 500).alias("error"))
    return events.filter(F.col("status").isin("completed", "failed")).select("job_id", "ts", F.to_json(payload).alias("payload"))


def metrics_table(counters: DataFrame, histogram: DataFrame, name: str) -> DataFrame:
    """One row per series: (metric, le, value) and its text line."""
    wide = counters.columns
    stacked = counters.select(F.inline(F.array(*[F.struct(F.lit(f"jobs_{c}").alias("metric"), F.lit(None).cast("double").alias("le"), F.col(c).cast("double").alias("value")) for c in wide])))
    buckets = histogram.select(F.lit(f"{name}_bucket").alias("metric"), "le", F.col("n").cast("double").alias("value"))
    out = stacked.unionByName(buckets)
    label = F.when(F.col("le").isNull(), F.lit("")).otherwise(F.concat(F.lit('{le="'), F.col("le").cast("string"), F.lit('"}')))
    return out.withColumn("line", F.concat(F.col("metric"), label, F.lit(" "), F.col("value").cast("string")))


def expired(df: DataFrame, ts: str, ttl_s: int, now: Column) -> DataFrame:
    return df.filter(F.col(ts) < now - F.make_interval(secs=F.lit(ttl_s)))


def live(df: DataFrame, ts: str, ttl_s: int, now: Column) -> DataFrame:
    return df.filter(F.col(ts) >= now - F.make_interval(secs=F.lit(ttl_s)))


# retention by partition: a folder a day


def write_dated(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """``df`` in folders ``date=...`` by the day of ``ts``; a day with many rows is written by several tasks."""
    df.withColumn("date", F.to_date(ts)).hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_by_site(df: DataFrame, path: str, mode: str = "append") -> None:
    """``df`` in folders ``site_slug=...``; a site with many rows is written by several tasks."""
    df.hint("rebalance", "site_slug").write.mode(mode).partitionBy("site_slug").parquet(path)


def read_by_site(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of ``write_by_site`` in their ``schema``, so that a slug like ``007`` stays text; a filter on ``site_slug`` reads its folder alone."""
    return spark.read.schema(schema).parquet(path).select(schema.names)


def expired_days(spark: SparkSession, path: str, ttl_s: int, now: dt.datetime) -> list[str]:
    """Folders of days that ended ``ttl_s`` or longer before ``now`` (UTC), from the folder's listing alone; rows without a time never expire."""
    out = []
    for name, _ in listed(spark, path):
        day = re.fullmatch(r"date=(\d{4}-\d{2}-\d{2})", name)
        if day and dt.datetime.fromisoformat(day[1]) + dt.timedelta(days=1, seconds=ttl_s) <= now:
            out.append(name)
    return sorted(out)


def drop_expired(spark: SparkSession, path: str, ttl_s: int, now: dt.datetime, dry_run: bool = True) -> list[str]:
    """Remove whole days past their time; what lives isn't rewritten.  With ``dry_run`` it only says which."""
    days = expired_days(spark, path, ttl_s, now)
    for name in [] if dry_run else days:
        removed(spark, f"{path}/{name}")
    return days
