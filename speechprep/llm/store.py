"""Names that don't clash, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from speechprep.sources.shared import new_folder


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many dashes after it as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "-"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
