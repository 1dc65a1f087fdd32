"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(name: str) -> None:
    """Send the functions of module ``name`` to Python workers by value, so workers need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only; a null text counts as empty. Other columns, of whatever name, stay outside."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Words between white space, A-Z in lower case; an empty array where there are none."""
    lowered = F.translate(text, UPPER, UPPER.lower())
    return F.filter(F.split(lowered, SPACE), lambda w: w != "")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))
