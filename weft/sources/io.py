"""Readers and writers with explicit schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, renames: dict[str, str] | None = None,
             dates: tuple[str, ...] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with quotes and embedded line breaks; listed columns become dates, null where they don't parse."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.withColumnsRenamed(renames or {})
    return df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(date_format)).cast("date") for c in dates})


def trim_headers(df: DataFrame, mark: str = " (") -> DataFrame:
    """Column names without their unit."""
    return df.toDF(*[c.split(mark)[0] for c in df.columns])


def read_jsonl_first(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """First row of each key by file and position, and the keys met more than once."""
    df = spark.read.schema(schema).json(path).withColumn("_f", F.col("_metadata.file_path"))
    df = df.withColumn("_at", F.monotonically_increasing_id())
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_f", "_at"))).where("_k = 1")
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return first.drop("_f", "_at", "_k"), twice


def read_checked_csv(spark: SparkSession, path: str, schema: str, rows: int, domains: dict[str, Column]) -> DataFrame:
    """CSV whose header, number of rows and values have to be as stated; all faults are raised at once."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    faults = [] if raw.columns == df.columns else [f"columns {raw.columns} instead of {df.columns}"]
    if not faults:
        broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in domains.items()]
        found = df.agg(F.count(F.lit(1)).alias("_rows"), *broken).collect()[0].asDict()
        if (n := found.pop("_rows")) != rows:
            faults.append(f"{n} rows instead of {rows}")
        faults += [f"{name}: {k} rows out of its domain" for name, k in found.items() if k]
    gate(faults)
    return df


def gate(faults: list[str]) -> None:
    """Raises all faults in one message."""
    if faults:
        raise ValueError("; ".join(faults))


def write_csv(df: DataFrame, path: str, sep: str = ",", mark: bool = False) -> None:
    """CSV files with a header; `mark` puts a byte order mark before each file's header, as spreadsheets want it."""
    if not mark:
        df.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
        return
    names = [f"\ufeff{c}" if i == 0 else c for i, c in enumerate(df.columns)]
    df.toDF(*names).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file or array element, with `page`, the number at the end of the file's name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.col("_metadata.file_name")
    return df.withColumn("page", F.regexp_extract(name, r"(\d+)\.json$", 1).try_cast("int"))


def payload(df: DataFrame, key: str) -> DataFrame:
    """key, payload: the rows of a key as one JSON array, sorted, for a site's denormalised files."""
    rows = F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key])))
    return df.groupBy(key).agg(F.to_json(rows).alias("payload"))


def decoded(raw: Column) -> Column:
    """Text of bytes: UTF-8 without a byte order mark, else Windows-1252 (bytes that it lacks become U+FFFD)."""

    @F.arrow_udf("string")
    def western(values: pa.Array) -> pa.Array:
        return pa.array([None if v.as_py() is None else v.as_py().decode("cp1252", "replace") for v in values], pa.string())

    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(western(raw))
    return F.regexp_replace(text, "^\ufeff", "")


def config_key(*parts: Column) -> Column:
    """The name of a cached result: a digest of what it was made of."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 of each file, found recursively."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
