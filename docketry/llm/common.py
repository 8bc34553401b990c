"""Reading tables and cutting lineage, shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.tables import written

__all__ = ["fresh", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a name made of it that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"{name}{i or ''}" for i in range(len(taken) + 1)) if x not in taken)
