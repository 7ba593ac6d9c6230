"""Numbers, paths, prompts and JSON of the speech job: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sampling parameters, their ranges and defaults.
PARAM_RANGES = {"temperature": (0.0, 2.0), "repetition_penalty": (1.0, 2.0), "top_k": (1, 200), "top_p": (0.0, 1.0), "temperature_sub_talker": (0.0, 2.0), "top_k_sub_talker": (1, 200), "max_new_tokens": (100, 8192)}
SEED_STEPS = (7919, 15838, 23757)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, made to differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (name + "-" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def object_path(prefix: Column, site: Column, job: Column, explicit: Column) -> Column:
    """The explicit path without outer slashes and with ``.mp3``, else ``prefix/site/job.mp3``."""
    own = F.regexp_replace(explicit, "^/+|/+$", "")
    own = F.when(F.endswith(own, F.lit(".mp3")), own).otherwise(F.concat(own, F.lit(".mp3")))
    return F.when(F.coalesce(F.trim(explicit), F.lit("")) != "", own).otherwise(F.concat_ws("/", prefix, site, F.concat(job, F.lit(".mp3"))))


def public_url(uri: Column, region: str = "us-east-1", base: str = "http://localhost:8000") -> Column:
    """``struct<url, reason>`` of a gs://, s3:// or local:// URI."""
    rest = F.regexp_replace(uri, "^[a-z0-9]+://", "")
    bucket, key = F.split_part(rest, F.lit("/"), F.lit(1)), F.regexp_replace(rest, "^[^/]*/", "")
    url = F.when(uri.startswith("gs://"), F.concat(F.lit("https://storage.googleapis.com/"), rest)).when(uri.startswith("s3://"), F.concat(F.lit("https://"), bucket, F.lit(f".s3.{region}.amazonaws.com/"), key)).when(uri.startswith("local://"), F.concat(F.lit(base.rstrip("/") + "/"), rest))
    return F.struct(url.alias("url"), F.when(url.isNull(), F.concat(F.lit("unknown scheme: "), F.coalesce(F.regexp_extract(uri, "^([^:]*):", 1), F.lit("")))).alias("reason"))


def token_bound(words: Column, given: Column | None = None) -> Column:
    """ceil(words * 0.42 * 12 * 1.3), at least 300, at most a given bound."""
    bound = F.greatest(F.ceil(F.round(words * 0.42 * 12 * 1.3, 6)), F.lit(300)).cast("long")
    return bound if given is None else F.least(bound, given)


def job_seed(job: Column) -> Column:
    return F.conv(F.substring(F.sha2(job.cast("binary"), 256), 1, 8), 16, 10).cast("long") % (1 << 31)


def retry_seeds(seed: Column) -> Column:
    return F.array(*[(seed + k) % (1 << 31) for k in SEED_STEPS])


def semitones(a: Column, b: Column) -> Column:
    return F.abs(12 * F.log2(a / b))


def dbfs(rms: Column) -> Column:
    """20 log10 of an RMS; null for silence."""
    return F.when(rms > 0, 20 * F.log10(rms))


def segment_budget(free_mib: Column, model: Column, override: Column | None = None) -> Column:
    """Words of a segment that fit into free memory; an override is held within 100..700, unknown memory gives 400."""
    ceiling = F.when(model.contains("1.7B"), 400).when(model.contains("0.6B"), 300).otherwise(400)
    fit = F.floor((free_mib - 512) * 1048576 / 150000 / 5.54)
    own = F.greatest(F.lit(200), F.least(ceiling, fit))
    out = F.when(free_mib.isNull(), 400).otherwise(own)
    return (out if override is None else F.coalesce(F.greatest(F.lit(100), F.least(F.lit(700), override)), out)).cast("long")


def expected_seconds(words: Column) -> Column:
    return words * 0.40


def length_verdict(seconds: Column, words: Column) -> Column:
    want = expected_seconds(words)
    return F.when(seconds > want * 1.6, "too long").when(seconds < want * 0.4, "too short").otherwise("ok")


def backoff(base: Column, most: Column, attempts: Column) -> Column:
    """Delays before the second to the last attempt: base * 2**k, capped."""
    return F.when(attempts <= 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(attempts - 2, F.lit(0))), lambda k: F.least(base * F.pow(F.lit(2.0), k), most)))


def quote_params(temperature: Column, penalty: Column) -> Column:
    """A quote's voice: 0 counts as missing."""
    return F.struct(F.least(F.coalesce(F.nullif(temperature, F.lit(0.0)), F.lit(0.3)) + 0.15, F.lit(0.55)).alias("temperature"), F.least(F.coalesce(F.nullif(penalty, F.lit(0.0)), F.lit(0.85)) + 0.05, F.lit(0.92)).alias("top_p"))


def parallel_slots(tier: Column, vram: Column, llm: Column, tts: Column, safety: Column, kv: Column) -> Column:
    """Requests that fit beside the models: 1 on a CPU, 0 (left to the server) on the two large tiers, else 1 to 4."""
    return F.when(tier == "cpu_only", 1).when(tier.isin("mid_vram", "high_vram"), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.floor((vram - llm - tts - safety) / kv)))).cast("int")


def json_items(answer: Column) -> Column:
    """The strings of a JSON array in a model's answer, code fences dropped; null if it is none."""
    bare = F.trim(F.regexp_replace(answer, r"^\s*```[a-z]*\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("["), F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"}))


def error_text(kind: Column, message: Column, most: int = 450) -> Column:
    return F.substring(F.concat_ws(": ", kind, message), 1, most)


def json_safe(value: Column) -> Column:
    """Any column as JSON text."""
    return F.to_json(F.struct(value.alias("value")))


def prompt(base: Column, tier: Column, sections: Column, position: Column, tail: Column, text: Column, direct: bool = False) -> Column:
    """``array<struct<role, content>>`` for a rewrite; parts that are null or empty are left out."""
    pacing = F.when(tier.isin("mid_vram", "high_vram"), F.lit("Mark breaths with [PAUSE] and changes of topic with [LONG_PAUSE]."))
    kept = [F.when(F.coalesce(c, F.lit("")) != "", c) for c in (base, pacing, sections, position, F.when(tail != "", F.concat(F.lit("Go on from: "), tail)))]
    user = F.concat(F.lit("/no_think\n"), text) if direct else text
    return F.array(F.struct(F.lit("system").alias("role"), F.concat_ws("\n\n", *kept).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def top_missing(missing: Column, n: int = 5) -> Column:
    """The first ``n`` missing items; markers in brackets don't count."""
    return F.slice(F.filter(missing, lambda m: ~m.startswith("[")), 1, n)


def retry_prompt(ratio: Column, missing: Column, source: Column, n_words: Column) -> Column:
    """By severity: far too short, short without named items, short with up to five of them."""
    items = top_missing(missing)
    return (
        F.when(ratio < 0.25, F.format_string("Far too short (%d%%). Tell all of the %d words again:\n\n%s", F.floor(ratio * 100), n_words, source))
        .when(F.size(items) == 0, F.format_string("Too short (%d%%). Tell it in full, about %d words:\n\n%s", F.floor(ratio * 100), n_words, source))
        .otherwise(F.format_string("Left out:\n- %s\n\nTell it in full, about %d words:\n\n%s", F.array_join(items, "\n- "), n_words, source))
    )


def hmac_sha256(body: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal by two nested hashes over padded keys."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)
