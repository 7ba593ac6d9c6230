"""Filters, gates and validations that keep a reason beside the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechprep.functions import values as V
from speechprep.functions.text import has_audio, speakable, word_count

#: Statuses that may be published, names that a log leaves out.
PUBLISHABLE = ("published", "updated")
QUIET_PATHS = ("/health", "/metrics", "/ready")


def _listed(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in tests]))


def validate_requests(df: DataFrame) -> DataFrame:
    """``violations``: what is wrong with text, job_id, site_slug and storage_path; a blank path counts as none."""
    path = F.nullif(F.trim("storage_path"), F.lit(""))
    return df.withColumn(
        "violations",
        _listed(
            (F.coalesce(F.trim("text"), F.lit("")) == "", "text is blank"),
            (F.length("text") > 100_000, "text is too long"),
            (F.col("job_id").isNotNull() & (~F.col("job_id").rlike("^[a-zA-Z0-9_-]+$") | (F.length("job_id") > 200)), "bad job_id"),
            (~F.col("site_slug").rlike("^[a-zA-Z0-9_-]+$") | (F.length("site_slug") > 100), "bad site_slug"),
            (path.contains(".."), "path climbs"),
            (path.startswith("/"), "path is absolute"),
        ),
    )


def sanitize_job_id(job: Column, fallback: Column) -> Column:
    """Trimmed, blanks to dashes, lower case, at most 200; null if it has other signs; without one, a hash of ``fallback``."""
    made = F.substring(F.lower(F.replace(F.trim(job), F.lit(" "), F.lit("-"))), 1, 200)
    return F.when(F.coalesce(F.trim(job), F.lit("")) == "", F.substring(F.sha2(fallback.cast("binary"), 256), 1, 32)).when(made.rlike("^[a-zA-Z0-9_-]+$"), made)


def publishable(df: DataFrame) -> DataFrame:
    s = F.col("status")
    return df.withColumn("skip_reason", F.when(s.isNotNull() & ~F.lower(s).isin(*PUBLISHABLE), F.concat(F.lit("status is "), F.lower(s))))


def min_words(df: DataFrame, n: int = 50) -> DataFrame:
    """``words`` and ``skip_reason`` for texts under ``n`` words, runs of newlines collapsed first."""
    t = F.regexp_replace("text", r"\n{3,}", "\n\n")
    return df.withColumn("words", word_count(t)).withColumn("skip_reason", F.when(F.col("words") < n, F.concat(F.lit("only "), F.col("words").cast("string"), F.lit(" words"))))


def split_has_audio(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With and without an audio element; a null html is in neither."""
    has = has_audio(F.col("html"))
    return df.filter(has), df.filter(~has)


def speakable_only(df: DataFrame, text: str = "text") -> DataFrame:
    s = speakable(F.col(text))
    return df.withColumn("ok", s["ok"]).withColumn("reason", s["reason"])


def validate_params(df: DataFrame) -> DataFrame:
    return df.withColumn("violations", _listed(*[(~F.col(c).between(lo, hi), f"{c} out of range") for c, (lo, hi) in V.PARAM_RANGES.items()]))


def validate_voices(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "violations",
        _listed(
            (~F.col("name").rlike("^[a-zA-Z0-9_-]+$"), "bad name"),
            (F.lower("name") == "default", "reserved name"),
            (~F.lower("path").endswith(".wav"), "not a wav file"),
            (F.col("duration_s") < 5, "too short"),
            (F.col("duration_s") > 120, "too long"),
            (F.col("sr") < 16_000, "sample rate too low"),
        ),
    )


def final_gate(df: DataFrame) -> DataFrame:
    """``passed`` and the first ``reason``; a null measure skips its test."""
    reason = (
        F.when(F.col("true_peak_dbfs") > -1.0, "true peak")
        .when(F.abs(F.col("integrated_lufs") - F.col("target_lufs")) > 3.0, "loudness")
        .when(F.col("long_silence_gaps") > 3, "silence gaps")
    )
    return df.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def final_warnings(df: DataFrame) -> DataFrame:
    return df.withColumn("warnings", _listed((F.abs(F.col("integrated_lufs") - F.col("target_lufs")) > 2.0, "loudness"), (F.col("true_peak_dbfs") > -1.0, "true peak"), (F.col("long_silence_gaps") > 0, "silence gap")))


def choose_path(df: DataFrame) -> DataFrame:
    """``pieces``: one or segments; ``strategy``: chunked above min(8000, num_ctx / 6) words, else single."""
    return df.withColumn("pieces", F.when(F.col("words") <= F.col("seg_words"), "one").otherwise("segments")).withColumn("strategy", F.when(F.col("words") > F.least(F.lit(8000), F.floor(F.col("num_ctx") / 6)), "chunked").otherwise("single"))


def oversized(segs: DataFrame, n: int, strict: bool = False) -> DataFrame:
    """Per document, (index, words) of segments over floor(1.3 n) words; ``strict`` raises instead."""
    found = segs.filter(F.col("word_count") > int(1.3 * n)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "word_count"))).alias("oversized"))
    return found.select("doc_id", F.raise_error(F.concat(F.lit("oversized segments in "), F.col("doc_id").cast("string"))).alias("oversized")) if strict else found


def verify_hmac(body: Column, signature: Column, key: bytes) -> Column:
    return F.lower(F.regexp_replace(signature, r"^sha256=|,.*$", "")) == V.hmac_sha256(body, key)


def client_ip(xff: Column, peer: Column, trusted: int) -> Column:
    """The address left of ``trusted`` proxies in the forwarding list; the peer without a list or trust."""
    ips = F.transform(F.split(xff, ","), lambda x: F.trim(x))
    return F.when(xff.isNull() | F.lit(trusted <= 0), peer).otherwise(F.element_at(ips, F.greatest(F.lit(0), F.size(ips) - trusted - 1) + 1))


def drop_health(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("path").isin(*QUIET_PATHS))


def download_check(df: DataFrame) -> DataFrame:
    """``code`` of a download: 404 no job, 409 not completed, 404 no path, 400 outside the root, 410 file gone, 500 empty, 200."""
    return df.withColumn(
        "code",
        F.when(F.col("status").isNull(), 404)
        .when(F.col("status") != "completed", 409)
        .when(F.col("audio_uri").isNull(), 404)
        .when(F.col("audio_uri").contains("..") | ~F.col("audio_uri").startswith("local://"), 400)
        .when(F.col("file_size").isNull(), 410)
        .when(F.col("file_size") == 0, 500)
        .otherwise(200),
    )


def clamp_config(df: DataFrame) -> DataFrame:
    """chunk words 10..1000 (400), workers 1..32 (4), TTL 60..604800 (86400); what is no number takes the default."""
    out = df
    for name, lo, hi, default in (("chunk_words", 10, 1000, 400), ("workers", 1, 32, 4), ("job_ttl", 60, 604_800, 86_400)):
        out = out.withColumn(name, F.least(F.lit(hi), F.greatest(F.lit(lo), F.coalesce(F.expr(f"try_cast({name} as int)"), F.lit(default)))))
    return out
