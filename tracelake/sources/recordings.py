"""Recordings on disk: one wide table per recording with a JSON sidecar, in a tree dataset/source/folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.scalars import clean_number

#: The fields that a sidecar may have.
META = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("plumes", "diameter_mm", "umbrella_angle_deg", "fps", "chamber_pressure_bar", "injection_duration_us", "injection_pressure_bar", "control_backpressure_bar", "mm_per_px_scale")],
    T.StructField("occupied_angle_total_deg", T.DoubleType()),
    T.StructField("occupied_angle_segment_count", T.IntegerType()),
    T.StructField("occupied_angle_segment_widths_deg", T.ArrayType(T.DoubleType())),
])
LONG = ["dataset", "source", "folder", "file_stem", "plume_idx", "frame_idx", "metric", "value"]


def path_part(path: Column, back: int) -> Column:
    """The part of a path that is ``back`` places before its end: 1 is the file name."""
    return F.element_at(F.split(path, "/"), -back)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a temporary one under a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tracelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_wide(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.csv`` under root/dataset/source/folder with its place; values as text. All files must have one header: see ``trees.read_rows`` for others."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    path = F.col("_metadata.file_path")
    return df.select("*", path_part(path, 4).alias("dataset"), path_part(path, 3).alias("source"), path_part(path, 2).alias("folder"), F.regexp_replace(path_part(path, 1), r"\.csv$", "").alias("file_stem"))


def to_long(wide: DataFrame, frame_col: str = "frame_idx") -> DataFrame:
    """Rows of (place, plume, frame, metric, value) from ``<metric>_plume_<n>`` columns; values that are no numbers are left out."""
    place = ["dataset", "source", "folder", "file_stem", frame_col]
    cols = [c for c in wide.columns if c.rpartition("_plume_")[2].isdigit()]
    long = wide.select(*place, *[clean_number(F.col(f"`{c}`")).alias(c) for c in cols]).unpivot(place, cols, "_name", "value").filter("value is not null")
    return long.select("dataset", "source", "folder", "file_stem", F.regexp_extract("_name", r"_plume_(\d+)$", 1).cast("int").alias("plume_idx"), F.col(frame_col).cast("int").alias("frame_idx"), F.regexp_extract("_name", r"^(.*)_plume_\d+$", 1).alias("metric"), "value")


def write_points(points: DataFrame, path: str, by: list[str] = [], mode: str = "errorifexists") -> None:  # noqa: B006
    out = points.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, by: list[str]) -> None:
    """One partitioned table per name."""
    for name, df in tables.items():
        write_points(df, f"{root}/{name}", by)


def append_master(rows: DataFrame, path: str) -> DataFrame:
    """Append to a master table and return it."""
    write_points(rows, path, mode="append")
    return rows.sparkSession.read.parquet(path)


def inventory(spark: SparkSession, root: str, glob: str, back: int) -> DataFrame:
    """Files and bytes by the folder that is ``back`` places before the file's name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    return files.groupBy(path_part(F.col("path"), back + 1).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
