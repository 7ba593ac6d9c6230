"""A table of posts in versions, for writers that may fail, repeat themselves or meet.

Data lie in ``<table>/data/<name>/part=k`` under names that never recur; a version of the table is a
file ``<table>/commits/<number>`` that says for each part which data it has, and up to which epoch each stream
has been applied.  A commit is written beside and then renamed to its number, which fails if that number is
taken.  So readers see whole versions only, a writer that dies before the rename has changed
nothing, and one that loses the race looks again: if the parts that it rewrote are still as it has read them,
its data go on top of the newer version, else it starts over.  ``vacuum`` removes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.sources.shared import hadoop, listed, removed

PARTS = 64


@dataclass
class Version:
    """A commit: where each part's rows lie, and each stream's last epoch."""

    number: int = -1
    parts: dict[int, str] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)


def part_of(post_id: Column) -> Column:
    return F.pmod(F.xxhash64(post_id), F.lit(PARTS)).cast("int")


def _numbers(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(name) for name, _ in listed(spark, f"{table}/commits") if name.isdigit())


def version(spark: SparkSession, table: str, number: int | None = None) -> Version:
    """A version of the table, the newest by default."""
    if number is None:
        found = _numbers(spark, table)
        if not found:
            raise FileNotFoundError(f"{table} has no version")
        number = found[-1]
    raw = json.loads(spark.read.text(f"{table}/commits/{number:012d}", wholetext=True).first()[0])
    return Version(number, {int(k): v for k, v in raw["parts"].items()}, raw["epochs"])


def commit(spark: SparkSession, table: str, new: Version) -> bool:
    """Publish ``new`` under its number; false if another writer has taken that."""
    draft, files = hadoop(spark, f"{table}/commits/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"parts": new.parts, "epochs": new.epochs}).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark._sc._gateway.new_array(options, 1)
    none[0] = options.NONE
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/commits/{new.number:012d}")
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as e:
        files.delete(draft, False)
        if not _taken(spark, table, new.number):
            raise e
        return False
    return True


def _taken(spark: SparkSession, table: str, number: int) -> bool:
    return number in _numbers(spark, table)


def _written(rows: DataFrame, table: str) -> str:
    name = uuid.uuid4().hex
    rows.withColumn("part", part_of(F.col("post_id"))).repartition("part").write.partitionBy("part").parquet(f"{table}/data/{name}")
    return name


def create(posts: DataFrame, table: str) -> None:
    """``posts(post_id, ...)`` as version 0 of a new table."""
    name = _written(posts, table)
    parts = [r.part for r in posts.sparkSession.read.parquet(f"{table}/data/{name}").select("part").distinct().collect()]  # PARTS at most
    if not commit(posts.sparkSession, table, Version(0, dict.fromkeys(parts, name))):
        raise FileExistsError(f"{table} exists")


def read(spark: SparkSession, table: str, number: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """All posts of a version, the newest by default, or those of some parts."""
    found = version(spark, table, number).parts
    paths = [f"{table}/data/{name}/part={k}" for k, name in found.items() if parts is None or k in parts]
    return spark.read.parquet(*paths)


def update(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame], touched: list[int], stream: str = "", epoch: int = -1, tries: int = 20) -> bool:
    """Rewrite the ``touched`` parts by ``change``; false if they aren't there or ``stream`` has this epoch behind it."""
    for _ in range(tries):
        old = version(spark, table)
        mine = [k for k in touched if k in old.parts]
        if not mine or old.epochs.get(stream, -1) >= epoch >= 0:
            return False
        name = _written(change(read(spark, table, old.number, mine)), table)
        now = old
        while all(now.parts.get(k) == old.parts[k] for k in mine) and not now.epochs.get(stream, -1) >= epoch >= 0:
            epochs = now.epochs | ({stream: epoch} if epoch >= 0 else {})
            if commit(spark, table, Version(now.number + 1, now.parts | dict.fromkeys(mine, name), epochs)):
                return True
            now = version(spark, table)
    raise RuntimeError(f"{table} has changed {tries} times under this update")


def vacuum(spark: SparkSession, table: str, versions: int = 2, older_s: float = 3600, dry_run: bool = False) -> list[str]:
    """Remove data that none of the last ``versions`` names and commits before these, if older than ``older_s``; returns their names.

    The age protects writers that haven't committed yet and readers of earlier versions.
    """
    numbers = _numbers(spark, table)
    kept = numbers[-versions:]
    named = {name for n in kept for name in version(spark, table, n).parts.values()}
    before = (time.time() - older_s) * 1000
    gone = [f"data/{name}" for name, at in listed(spark, f"{table}/data") if name not in named and at <= before]
    gone += [f"commits/{name}" for name, at in listed(spark, f"{table}/commits") if (name.startswith("_") or name.isdigit() and int(name) not in kept) and at <= before]
    for name in [] if dry_run else gone:
        removed(spark, f"{table}/{name}")
    return sorted(gone)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint when it began, so a new checkpoint is another stream even in the same place."""
    try:
        return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
    except (PySparkException, TypeError, KeyError) as e:
        raise FileNotFoundError(f"{checkpoint} has no stream's metadata") from e
