"""Trees of files dataset/source/folder: what lies where, CSV by each file's own header, JSON sidecars, and audits of them.

A recording is ``<stem>.csv`` with ``<stem>.meta.json`` beside it; both are known by their path without the suffix. Listings read
names and sizes only. Folders are listed and files are read in the tasks, through Arrow's file systems: Spark's own readers hold
the names of all files in the driver. Whole files are rows: a file is one recording, bounded by its frames.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.scalars import clean_number
from tracelake.operators.select import stored
from tracelake.sources.recordings import META

#: a comma outside of quotes
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
SUFFIX = r"(\.meta\.json|\.csv)$"
CONDITIONS = ("injection_pressure_bar", "chamber_pressure_bar", "control_backpressure_bar")
#: What a task reads at least, in files and bytes, and what it sends at once.
FILES, BYTES, SENT = 4000, 64 << 20, 8 << 20


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    made = set()
    for batch in batches:
        names, contents = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for name, content in zip(names, contents):
            path = f"{base}/{name}"
            folder = path.rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            #: under a name of its own first, so that a task that runs again leaves no half file
            draft = f"{base}/_drafts-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(content)
            system.move(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([len(c) for c in contents], pa.int64())], names=["name", "n_bytes"])


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row (name, content) as a file under ``root``, from the tasks; (name, n_bytes) of what was written."""
    files.sparkSession._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).mkdirs(files.sparkSession._jvm.org.apache.hadoop.fs.Path(root))
    done = files.select("name", "content").mapInArrow(partial(_write, root=root), "name string, n_bytes long")
    return stored(done, "written")


def _place(root: str) -> tuple:
    """(file system, the root's path in it, what stands before such a path in a URI)."""
    from pyarrow import fs

    root = root.rstrip("/")
    system, base = fs.FileSystem.from_uri(root)
    return system, base, root[: -len(base)] if root.endswith(base) else ""


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder; folders have no size."""
    from pyarrow import fs

    system, _, before = _place(root)
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = [x for x in system.get_file_info(fs.FileSelector(folder.removeprefix(before))) if not _hidden(x.base_name)]
            for k in range(0, len(found), 10_000):
                some = found[k : k + 10_000]
                sizes = [None if x.type == fs.FileType.Directory else x.size for x in some]
                yield pa.RecordBatch.from_arrays([pa.array([before + x.path for x in some], pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])


def file_table(spark: SparkSession, root: str) -> DataFrame:
    """(path, n_bytes, dataset, source, folder, name, recording, kind) of each file under root/dataset/source/folder; contents aren't read.

    One round for each level of folders, a task for some folders; the driver gets the number of folders only.
    """
    _, base, before = _place(root)
    folders, levels, n = spark.range(1).select(F.lit(before + base).alias("path")), [], 1
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        found = stored(folders.repartition(tasks).mapInArrow(partial(_list, root=root), "path string, n_bytes long"), "listing")
        levels.append(found.filter("n_bytes is not null"))
        folders = found.filter("n_bytes is null").select("path")
        n = folders.count()
    files = reduce(DataFrame.unionByName, levels)
    return placed(files, F.col("path"))


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    system, _, before = _place(root)
    for batch in batches:
        first, contents, size = 0, [], 0
        paths = batch.column("path").to_pylist()
        for k, path in enumerate(paths):
            with system.open_input_stream(path.removeprefix(before), compression=None) as file:
                contents.append(file.read())
            size += len(contents[-1])
            if size >= SENT or k + 1 == len(paths):
                columns = [*batch.slice(first, len(contents)).columns, pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "value"])
                first, contents, size = k + 1, [], 0


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` (of :func:`file_table` of ``root``) with their contents as the text ``value``."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    tasks = max(1, min(total["n"], files.sparkSession.sparkContext.defaultParallelism), total["n"] // FILES, total["b"] // BYTES)
    known = files.select("dataset", "source", "folder", "recording", "path").repartition(tasks, "path")
    read = known.mapInArrow(partial(_read, root=root), known.withColumn("value", F.lit(b"")).schema)
    return read.drop("path").withColumn("value", F.col("value").cast("string"))


def placed(df: DataFrame, path: Column) -> DataFrame:
    """``df`` with the places that a path names."""
    parts = F.split(path, "/")
    part = lambda k: F.try_element_at(parts, F.lit(-k))
    kind = F.when(part(1).endswith(".meta.json"), "meta").when(part(1).endswith(".csv"), "csv").otherwise("other")
    return df.select("*", part(4).alias("dataset"), part(3).alias("source"), part(2).alias("folder"), part(1).alias("name"), F.regexp_replace(path, SUFFIX, "").alias("recording"), kind.alias("kind"))


def read_rows(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(place, recording, line, cells): the lines of every ``*.csv`` as a map from the names in that file's own header.

    ``files``: the tree's listing or a part of it, if it is at hand. Files need not agree in their columns. Names and values are
    text; quotes around them are taken off; an empty cell is null. Lines may not hold line breaks within quotes.
    """
    files = read_files((file_table(spark, root) if files is None else files).filter("kind = 'csv'"), root)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    split = lambda c: F.transform(F.split(c, _COMMA), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    rows = files.select("dataset", "source", "folder", "recording", split(lines[0]).alias("head"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line", "row"))
    cells = F.zip_with("head", split("row"), lambda k, v: F.struct(k.alias("k"), F.when(v != "", v).alias("v")))
    #: of columns that share a name the first
    named = F.filter(cells, lambda x, i: x["k"].isNotNull() & (F.array_position("head", x["k"]) == i + 1))
    return rows.select("dataset", "source", "folder", "recording", "line", F.map_from_entries(named).alias("cells"))


def read_sidecars(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(place, recording, keys, meta): one row for each ``*.meta.json``; ``keys`` is null where it isn't a JSON object."""
    files = read_files((file_table(spark, root) if files is None else files).filter("kind = 'meta'"), root)
    known = F.try_parse_json("value").isNotNull()
    keys = F.when(known, F.array_sort(F.json_object_keys("value")))
    return files.select("dataset", "source", "folder", "recording", keys.alias("keys"), F.when(keys.isNotNull(), F.from_json("value", META)).alias("meta"))


def with_sidecars(rows: DataFrame, sidecars: DataFrame, cols: list[str], order: str) -> DataFrame:
    """Rows of recordings with each of ``cols`` the same on every row: the sidecar's value, else the first in ``order`` that a row has.

    ``rows`` has ``recording``, ``cells`` and the number ``order``. Missing, null and broken sidecars leave the choice to the rows;
    a column that neither has is null.
    """
    own = lambda c: clean_number(F.try_element_at("cells", F.lit(c)))
    at = F.col(order)
    first = rows.groupBy("recording").agg(*[F.min_by(own(c), F.when(own(c).isNotNull(), at)).alias(f"_own_{c}") for c in cols])
    #: what tasks read from files is larger than their listing, by which Spark would take it for small and send it through the driver
    both = first.join(sidecars.select("recording", "meta").hint("merge"), "recording", "left")
    fixed = both.select("recording", *[F.coalesce(F.nanvl(F.col("meta")[c].cast("double"), F.lit(None)), F.col(f"_own_{c}")).alias(c) for c in cols])
    return rows.join(fixed, "recording", "left")


def chosen_folders(files: DataFrame, source: str, wide: str, long: str) -> DataFrame:
    """(dataset, folder): for each dataset its wide folder if that has a CSV, else its long one. Decided from the listing."""
    there = files.filter((F.col("source") == source) & (F.col("kind") == "csv") & F.col("folder").isin(wide, long))
    return there.groupBy("dataset").agg(F.max(F.col("folder") == wide).alias("w")).select("dataset", F.when(F.col("w"), wide).otherwise(long).alias("folder"))


def read_source(spark: SparkSession, root: str, source: str, wide: str, long: str, keys: list[str], position: str, value: str) -> DataFrame:
    """(experiment_name, keys, cells): the rows of one source over all datasets, each from its wide files or else from its long ones.

    Only the chosen folders are read. Long rows (keys, position, value) become cells ``value_<position>`` of one row for each key.
    """
    files = file_table(spark, root)
    chosen = stored(chosen_folders(files, source, wide, long), "chosen")
    files = files.filter(F.col("source") == source).join(chosen, ["dataset", "folder"], "left_semi")
    kinds = {r["folder"] for r in chosen.select("folder").distinct().collect()}
    cell = lambda c: F.try_element_at("cells", F.lit(c))
    parts = []
    if wide in kinds:
        rows = read_rows(spark, root, files.filter(F.col("folder") == wide))
        parts.append(rows.select(F.col("dataset").alias("experiment_name"), *[cell(k).alias(k) for k in keys], F.map_filter("cells", lambda k, v: ~k.isin(keys)).alias("cells")))
    if long in kinds:
        rows = read_rows(spark, root, files.filter(F.col("folder") == long)).select(F.col("dataset").alias("experiment_name"), *[cell(k).alias(k) for k in keys], cell(position).alias("_p"), cell(value).alias("_v")).filter("_p is not null")
        #: one entry for each position, the least value among equals
        rows = rows.groupBy("experiment_name", *keys, "_p").agg(F.min("_v").alias("_v"))
        parts.append(rows.groupBy("experiment_name", *keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(f"{value}_"), "_p"), "_v"))).alias("cells")))
    if not parts:
        raise FileNotFoundError(f"no CSV of source {source} under {root}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def inventory(spark: SparkSession, root: str, skip: str = "boundary_points") -> DataFrame:
    """By dataset: folders, CSV files (outside of ``skip`` folders), sidecars, bytes, and the distinct conditions that sidecars name.

    Conditions that are missing or zero aren't counted; broken sidecars count as files only.
    """
    files = file_table(spark, root)
    counted = files.filter((F.col("kind") == "meta") | ((F.col("kind") == "csv") & (F.col("folder") != skip)))
    sizes = counted.groupBy("dataset").agg(F.countDistinct("source", "folder").alias("n_folders"), F.count_if(F.col("kind") == "csv").alias("n_csv"), F.count_if(F.col("kind") == "meta").alias("n_meta"), F.sum("n_bytes").alias("n_bytes"))
    meta = read_sidecars(spark, root, files).select("dataset", *[F.when(F.col("meta")[c] != 0, F.col("meta")[c]).alias(c) for c in (*CONDITIONS, "injection_duration_us")])
    ends = [F.min("injection_duration_us").alias("duration_min_us"), F.max("injection_duration_us").alias("duration_max_us")]
    named = meta.groupBy("dataset").agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in CONDITIONS], *ends)
    return sizes.join(named, "dataset", "left")


def parity(sidecars: DataFrame, slack: float = 1.0) -> DataFrame:
    """(place, recording, breach): each way in which a sidecar departs.

    ``broken``: no JSON object. ``keys``: not the key set that most sidecars of the tree have (the first in order among equals).
    ``count``: as many widths as the count says are not there, or no count. ``total``: the widths don't add up to the total.
    """
    place = ["dataset", "source", "folder", "recording"]
    sets = sidecars.filter("keys is not null").groupBy("keys").agg(F.count("*").alias("n"))
    usual = stored(sets.agg(F.max_by("keys", F.struct("n", F.hash("keys"))).alias("usual")), "usual-keys")
    widths = F.coalesce(F.col("meta")["occupied_angle_segment_widths_deg"], F.array().cast("array<double>"))
    total = F.aggregate(widths, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    fine = {
        "broken": F.col("keys").isNotNull(),
        "keys": F.col("keys").isNull() | (F.col("keys") == F.col("usual")),
        "count": F.col("keys").isNull() | F.coalesce(F.size(widths) == F.col("meta")["occupied_angle_segment_count"], F.lit(False)),
        "total": F.col("keys").isNull() | F.coalesce(F.abs(total - F.col("meta")["occupied_angle_total_deg"]) < slack, F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(~ok, name) for name, ok in fine.items()]), lambda x: x.isNotNull())
    return sidecars.withColumn("usual", usual.scalar()).select(*place, F.explode(found).alias("breach"))
