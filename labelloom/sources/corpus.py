"""Reading corpora and item feeds, writing stage tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, types as T, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..operators.tables import union_rows
from ..schemas import RAW_TEXTS


def _open(path: str):
    filesystem, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return filesystem.open_input_file(name)


def read_feather(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Feather (Arrow IPC) files on storage that the executors can reach.

    The driver reads the footers only; the record batches are the units of work.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    work, schema = [], None
    for p in paths:
        with _open(p) as f:
            reader = ipc.open_file(f)
            schema = schema or reader.schema
            work += [(p, i) for i in range(reader.num_record_batches)]
    names = schema.names

    def run(batches):
        for batch in batches:
            for p, i in zip(batch["path"].to_pylist(), batch["batch"].to_pylist()):
                with _open(p) as f:
                    yield ipc.open_file(f).get_batch(i).select(names)

    todo = spark.createDataFrame(work, "path string, batch int").repartition(max(1, len(work)), "path", "batch")
    return todo.mapInArrow(run, from_arrow_schema(pa.schema([f.remove_metadata() for f in schema])))


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a corpus by its suffix: parquet, csv, json or feather. Workbooks must be exported to csv first."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "feather":
        return read_feather(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if suffix == "json":
        return reader.json(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown corpus format {suffix!r}: use parquet, csv, json or feather")


_BROKEN = "_corrupt_record"


def _item_feeds(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``item`` of every item of the feeds, and in ``record`` what could not be read as one."""
    full = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"columnNameOfCorruptRecord": _BROKEN}
    lines = spark.read.text(path)
    begins = lines.filter(F.ltrim("value").startswith("[")).select(F.input_file_name().alias("f")).distinct()
    arrays = {r["f"] for r in begins.collect()}  # names of files, which the driver lists anyway
    others = [f for f in lines.inputFiles() if f not in arrays]
    parts = []
    if others:
        given = spark.read.text(others).filter(F.trim("value") != "")
        parts.append(given.select(F.from_json("value", full, options).alias("item")).select("item", F.col(f"item.{_BROKEN}").alias("record")))
    if arrays:
        # items of an array may stand on one line or on many: such a file is read as a whole
        given = spark.read.text(sorted(arrays), wholetext=True)
        items = given.select("value", F.from_json("value", T.ArrayType(full), options).alias("items"))
        parts.append(items.select(F.explode_outer("items").alias("item"), F.when(F.col("items").isNull(), F.col("value")).alias("record")).filter("item IS NOT NULL OR record IS NOT NULL"))
    return union_rows(*parts) if len(parts) > 1 else parts[0] if parts else spark.createDataFrame([], T.StructType([T.StructField("item", full), T.StructField("record", T.StringType())]))


def read_items_json(spark: SparkSession, path: str, schema: T.StructType = RAW_TEXTS) -> DataFrame:
    """Crawl items from feeds of JSON lines, one item each, or of JSON arrays, on any lines.

    JSON lines stay splittable. What is no item is left out here and reported by ``broken_items``.
    """
    return _item_feeds(spark, path, schema).filter("record IS NULL").select(*[F.col("item").getField(n).alias(n) for n in schema.names])


def broken_items(spark: SparkSession, path: str, schema: T.StructType = RAW_TEXTS) -> DataFrame:
    """``record``: the lines or files that ``read_items_json`` leaves out."""
    return _item_feeds(spark, path, schema).filter("record IS NOT NULL").select("record")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a stage table. An overwrite is staged next to the target and swapped in, as it may read the target."""
    if mode == "append":
        df.write.mode("append").parquet(path)
        return
    if mode != "overwrite":
        raise ValueError(f"unknown mode {mode!r}")
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex[:8]
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{tag}", f"{path}.old-{tag}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(staged.toString())
    existed = files.exists(target)
    if existed and not files.rename(target, old):
        raise OSError(f"could not move the table at {path} away; the new one is at {staged}")
    if not files.rename(staged, target):
        back = not existed or files.rename(old, target)
        raise OSError(f"could not move the staged table to {path}; the old one is {'in place' if back else f'at {old}'}")
    if existed:
        files.delete(old, True)


def dataset_profile(stages: dict[str, DataFrame], class_col: str, url_col: str) -> DataFrame:
    """``(stage, n_rows, n_classes, n_duplicates, classes)`` for every stage table.

    Rows are counted per URL first, which combines copies before the shuffle.
    """
    parts = [d.select(F.lit(name).alias("stage"), F.col(class_col).alias("c"), F.col(url_col).alias("u")) for name, d in stages.items()]
    union = union_rows(*parts)
    per_url = union.groupBy("stage", "u").agg(F.count(F.lit(1)).alias("n"), F.collect_set("c").alias("cs"))
    classes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("cs"))))
    return (
        per_url.groupBy("stage")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_urls"), classes.alias("cs"))
        .select(
            "stage", "n_rows", F.size("cs").cast("bigint").alias("n_classes"),
            (F.col("n_rows") - F.col("n_urls")).alias("n_duplicates"), F.array_join("cs", ",").alias("classes"),
        )
    )
