"""Sharding by a two-pass external shuffle of whole records, in DataFrame functions only.

Pass one scatters records over buckets of about ``BUCKET_BYTES`` by a seeded hash of doc_id and text,
one task each.  Pass two gathers a task's bucket, sorts it so that its order doesn't hang on the
shuffle, and shuffles it with Spark's seeded array ``shuffle``, which is a Fisher-Yates shuffle; its draws
hang on the seed and the task's number alone, which is the bucket's.  So the result hangs on the
rows and the seed, not on the cluster.  Buckets in order make one random order of all records,
which is cut into the shards: record i of N goes to shard i * n div N.  So shards differ by at most
one row (law ``rows``), slots have no gaps, and a bucket writes to one or two shards, whatever their
number.  ``assign`` describes what was written.

Rows that fill more than ``CROWDED`` of a bucket by themselves (the same record again and again) are
counted before they are scattered, and their copies get numbers and so buckets of their own.

Edge cases: a null text has no bytes and counts as empty for the checksum; rows with equal doc_id and
text are told apart by their other columns, if at all; a null doc_id is hashed as null; an empty table
gives no rows; other columns are written with their records, whatever their names (the columns for shard and
slot get other names if the records have such).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.store import fresh, new_folder

SHARDS, SEED, BUCKET_BYTES, CROWDED, ROW_BYTES = 24, 20240613, 64 << 20, 0.25, 8
#: Rows up to which a table of buckets or of crowded keys (about 24 bytes a row) is broadcast, and buckets summed in one task.
MOST_BROADCAST, SUMMED = 100_000, 1024


def measured(docs: DataFrame, *kept: Column) -> DataFrame:
    """doc_id, size, text_crc32 of each row, and the columns ``kept``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), *kept)


def small(df: DataFrame) -> DataFrame:
    """``df`` under a join hint: broadcast behind a check of its size."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df.hint("merge")


def _spread(rows: DataFrame, key: list[str], size: str, copy: str) -> DataFrame:
    """``rows`` with ``copy``: 0, but for crowded keys the number of the copy of that very row."""
    least = int(BUCKET_BYTES * CROWDED)
    crowded = rows.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.sum(size).alias(size)).filter(F.col(size) > least).drop(size)
    if crowded.isEmpty():
        return rows.withColumn(copy, F.lit(0).cast("long"))
    names = fresh(rows.columns, *[f"#crowded{i}" for i in range(len(key))])
    side = small(crowded.select(*[F.col(f"`{k}`").alias(c) for k, c in zip(key, names, strict=True)]))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{c}`")) for k, c in zip(key, names, strict=True)]
    many, few = rows.join(side, on, "left_semi"), rows.join(side, on, "left_anti")
    n = fresh([*rows.columns, copy], "#n")[0]
    numbered = many.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias(n)).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n)
    return few.withColumn(copy, F.lit(0).cast("long")).unionByName(numbered)


def shuffled(rows: DataFrame, key: list[str], size: str, index: str, count: str, seed: int = SEED) -> DataFrame:
    """``rows``, all columns, with ``index``, their place in one seeded random order from 0 without gaps, and ``count``, the number of rows."""
    total, n = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // BUCKET_BYTES))
    copy, bucket, record, of, offset, at = fresh([*rows.columns, index, count], "#copy", "#bucket", "#record", "#of", "#offset", "#at")
    names = rows.columns
    spread = _spread(rows, key, size, copy)
    whole = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate([*key, copy])], F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    scattered = spread.select(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in (*key, copy)]), F.lit(buckets)).cast("int").alias(bucket), whole.alias(record))
    filled = scattered.repartitionById(buckets, F.col(bucket)).groupBy(bucket).agg(F.sort_array(F.collect_list(record)).alias(record))
    dealt = filled.select(bucket, F.shuffle(record, seed).alias(record))
    counts = scattered.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col(bucket) / SUMMED))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("all")).select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy(bucket)) - F.col("n")
    offsets = counts.join(F.broadcast(blocks), "block").select(F.col(bucket).alias(of), (within + F.col("before")).alias(offset))
    offsets = F.broadcast(offsets) if buckets <= MOST_BROADCAST else offsets.hint("merge")
    placed = dealt.select(bucket, F.posexplode(record).alias(at, record)).join(offsets, F.col(bucket) == F.col(of))
    return placed.select(*[F.col(f"`{record}`.row.`{c}`") for c in names], (F.col(offset) + F.col(at)).alias(index), F.lit(n).cast("long").alias(count))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row's size, checksum, law, shard and slot, taken from the records that ``write`` put into the shared folder."""
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "shards")
    shard, slot = write(docs, path, shards, seed)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text", T.StringType()), T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())]
    written = spark.read.schema(T.StructType(fields)).parquet(path)
    return measured(written, F.lit("rows").alias("law"), F.col(f"`{shard}`").alias("shard"), F.col(f"`{slot}`").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> tuple[str, str]:
    """Whole records to ``path/shard=k``, whose files in order of their names are in slot order; returns the names of the two columns."""
    names = docs.columns
    shard, slot = fresh(names, "shard", "slot")
    size, crc, index, count = fresh([*names, shard, slot], "#size", "#crc", "#index", "#count")
    sized = docs.withColumn(size, F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).withColumn(crc, F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    placed = shuffled(sized, ["doc_id", crc], size, index, count, seed)
    out = placed.select(*[F.col(f"`{c}`") for c in names], index, count, F.expr(f"cast(`{index}` * {shards} div `{count}` as int)").alias(shard))
    out = out.withColumn(slot, F.expr(f"`{index}` - (cast(`{shard}` as bigint) * `{count}` + {shards - 1}) div {shards}"))
    out.drop(index, count).sortWithinPartitions(F.col(f"`{shard}`"), F.col(f"`{slot}`")).write.partitionBy(shard).parquet(path)
    return shard, slot
