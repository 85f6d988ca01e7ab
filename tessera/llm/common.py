"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import cut, ship, shared_dir

__all__ = ["SPACES", "cut", "documents", "fresh", "quoted", "shared_dir", "ship", "text_or_empty"]

#: Characters that separate words everywhere in this subpackage: space, \t, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever the letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"_t_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: str) -> Column:
    return F.coalesce(quoted(text).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
