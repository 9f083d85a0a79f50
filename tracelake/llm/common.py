"""What the text operators share: reading tables, scratch tables, and column expressions.

Patterns are written once, as Java regular expressions that other engines read the same way.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bound_to(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often the expression reads it."""
    return F.transform(F.array(value), f)[0]


LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


def bits_for(n: int, each: int = 128) -> int:
    """A power of two of at least ``each`` bits for each of ``n`` things, within bounds (4 MB at most)."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (each * n).bit_length()))


def bit_set(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: ``bits``, an array of longs that has the bit of each number in the column ``hash``."""
    slots = hashes.select(F.pmod("hash", F.lit(bits)).alias("slot"))
    ones = slots.select(F.shiftright("slot", 6).alias("id"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
    zeros = hashes.sparkSession.range(0, bits // 64, 1, 1).select("id", F.lit(0).cast("long").alias("bits"))
    dense = ones.union(zeros).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def has_bit(packed: Column, slot: Column) -> Column:
    return F.getbit(F.get(packed, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
