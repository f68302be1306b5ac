"""Scans of files and tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc", "text")
RESCUED = "_rescued_data"
_DEFAULTS = {"csv": {"header": "true", "inferSchema": "true"}, "json": {}, "parquet": {}, "orc": {}, "text": {}}

TAXI = T.StructType(
    [T.StructField("vendor", T.StringType()), T.StructField("pickup_datetime", T.TimestampType()), T.StructField("dropoff_datetime", T.TimestampType()), T.StructField("passenger_count", T.IntegerType()), T.StructField("trip_distance", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("pickup_longitude", "pickup_latitude")]
    + [T.StructField("rate_code", T.StringType()), T.StructField("store_and_fwd_flag", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("dropoff_longitude", "dropoff_latitude")]
    + [T.StructField("payment_type", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("fare_amount", "surcharge", "mta_tax", "tip_amount", "tolls_amount", "total_amount")]
)


def detect_format(spark: SparkSession, path: str) -> str:
    """By extension, of the path or of the first file under it; parquet otherwise."""
    def by_name(name: str) -> str | None:
        stem = name.lower().removesuffix(".gz").removesuffix(".snappy").rstrip("/")
        return next((f for f in FORMATS if stem.endswith(f".{f}")), "text" if stem.endswith(".txt") else "json" if stem.endswith((".jsonl", ".ndjson")) else None)

    if found := by_name(path):
        return found
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(where, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if name[0] not in "_." and (found := by_name(name)):
            return found
    return "parquet"


def read_any(spark: SparkSession, source: str, fmt: str | None = None, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table by name, or files by path; the format is sniffed, not tried."""
    if fmt is None and "/" not in source and not any(source.endswith(f".{f}") for f in FORMATS):
        return spark.table(source)
    fmt = fmt or detect_format(spark, source)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    chosen = _DEFAULTS[fmt] | ({"inferSchema": "false"} if schema is not None and fmt == "csv" else {}) | options
    reader = spark.read.format(fmt).options(**chosen)
    return (reader.schema(schema) if schema is not None else reader).load(source)


def read_files(spark: SparkSession, path: str, fmt: str, schema: str | T.StructType | None = None, mode: str = "PERMISSIVE", rescue: bool = False, **options: str) -> DataFrame:
    """Reads with a parse mode. With ``rescue``, malformed rows keep their text in ``_rescued_data``."""
    if rescue:
        if schema is None:
            schema = read_any(spark, path, fmt, **options).schema
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        schema = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
        options = options | {"columnNameOfCorruptRecord": RESCUED}
    return read_any(spark, path, fmt, schema, mode=mode, **options)


def query_file(spark: SparkSession, path: str, fmt: str, limit: int | None = None) -> DataFrame:
    """SELECT * on files in place."""
    if fmt not in FORMATS[:4]:
        raise ValueError(f"unsupported format: {fmt}")
    out = spark.sql(f"SELECT * FROM {fmt}.`{path}`")
    return out if limit is None else out.limit(limit)


def preview(spark: SparkSession, path: str, fmt: str | None = None, limit: int = 10, **options: str) -> DataFrame:
    return read_any(spark, path, fmt, **options).limit(limit)


def with_file_metadata(df: DataFrame) -> DataFrame:
    """Adds the file's name, size and modification time to each row of a file scan."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("file_modification_time"))


def with_input_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.input_file_name())


def read_taxi(spark: SparkSession, *paths: str) -> DataFrame:
    """Taxi CSV files with their fixed schema, one after the other."""
    return reduce(DataFrame.unionAll, [spark.read.schema(TAXI).option("header", "true").csv(p) for p in paths])


def ingest_labelled(spark: SparkSession, paths: dict[str, str], fmt: str = "csv", columns: dict[str, str] | None = None) -> DataFrame:
    """Reads each labelled path, adds ``source``, renames, and unions by name; missing columns become null."""
    frames = [read_any(spark, p, fmt).withColumnsRenamed(columns or {}).withColumn("source", F.lit(label)) for label, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def external_csv_table(spark: SparkSession, name: str, path: str, columns: str, delimiter: str = "|", header: bool = True) -> DataFrame:
    """A table over CSV files that stay where they are."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING csv OPTIONS (header '{str(header).lower()}', delimiter '{delimiter}') LOCATION '{path}'")
    return spark.table(name)


def stream_files(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, max_files: int | None = None, clean_source: str | None = None, archive: str | None = None, schema_location: str | None = None, infer_types: bool = True, metadata: bool = False, **options: str) -> DataFrame:
    """An incremental file source.

    Without a schema, that of the files present is taken; with
    ``schema_location``, it is kept there, and later runs take it from there.
    Without ``infer_types`` all columns are strings. With ``metadata``, the
    files' names, sizes and times come as a struct ``_metadata``.
    """
    fmt = fmt or detect_format(spark, path)
    if schema is None and schema_location:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{schema_location}/schema.json")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(where):
            schema = T.StructType.fromJson(json.loads(spark.read.text(f"{schema_location}/schema.json", wholetext=True).first()[0]))
        else:
            schema = _inferred(spark, path, fmt, infer_types, options)
            out = fs.create(where, False)
            out.write(bytearray(schema.json().encode()))
            out.close()
    elif schema is None:
        schema = _inferred(spark, path, fmt, infer_types, options)
    reader = spark.readStream.format(fmt).schema(schema).options(**(({"header": "true"} if fmt == "csv" else {}) | options))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    out = reader.load(path)
    return out.select("*", "_metadata") if metadata else out


def _inferred(spark: SparkSession, path: str, fmt: str, types: bool, options: dict) -> T.StructType:
    found = read_any(spark, path, fmt, **options).schema
    return found if types else T.StructType([T.StructField(f.name, T.StringType()) for f in found])


def list_datasets(spark: SparkSession, root: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a folder's entries: name, path, is_dir, size."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()) for s in fs.listStatus(where))
    return spark.createDataFrame(entries[offset : offset + limit], "name string, path string, is_dir boolean, size long")


def select_all_sql(path: str, fmt: str, limit: int | None = None, options: dict[str, str] | None = None, name: str = "all_rows") -> list[str]:
    """SQL statements that select all rows of files; reader options need a view of their own."""
    end = f" LIMIT {int(limit)}" if limit is not None else ""
    if not options:
        return [f"SELECT * FROM {fmt}.`{path}`{end}"]
    chosen = ", ".join(f"{k} '{v}'" for k, v in sorted(options.items()))
    return [f"CREATE OR REPLACE TEMPORARY VIEW {name} USING {fmt} OPTIONS (path '{path}', {chosen})", f"SELECT * FROM {name}{end}"]
