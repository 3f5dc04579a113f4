"""Readers and writers of the tables. Schemas are given, so no reader scans a file to infer one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTS = "trajectory_id string, MMSI bigint, timestamp timestamp, latitude double, longitude double, SOG double, COG double"
SPLITS = "trajectory_id string, split string"
STEPS = "sample_id string, trajectory_id string, gap_steps int, gap_step int, pred_lat double, pred_lon double, true_lat double, true_lon double"
SFT = "sample_id string, trajectory_id string, gap_steps int, messages array<struct<role:string,content:string>>"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points from Parquet; timestamps may be text or without zone, and NaN becomes null."""
    raw = spark.read.parquet(path)
    columns = []
    for name, kind in (part.rsplit(" ", 1) for part in POINTS.split(", ")):
        c = F.col(name)
        if kind == "timestamp":
            c = F.to_timestamp(c) if dict(raw.dtypes)[name] == "string" else c.cast("timestamp")
        elif kind == "double":
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        else:
            c = c.cast(kind)
        columns.append(c.alias(name))
    return raw.select(*columns)


CORRUPT = "_corrupt_record"


def _separated(raw: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a table read with a corrupt-record column.

    The hash is there for every row: it keeps the other columns in the scan, without which Spark does not tell which
    records are corrupt.
    """
    read = F.xxhash64(*columns) >= F.lit(-(1 << 63))
    rows = raw.where(read & F.col(CORRUPT).isNull()).select(*columns)
    bad = raw.where(read & F.col(CORRUPT).isNotNull()).select(F.col("_metadata.file_name").alias("file"), F.col(CORRUPT).alias("record"))
    return rows, bad


def _names(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema).fields]


def read_table_csv_checked(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): as ``read_table_csv``, but a line with a cell that is not of its type, or with too few or too many
    cells, is no row: it is a violation (file, record), whole as it stands."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("header", header).option("nanValue", "nan").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    return _separated(raw, _names(schema))


def read_sft_jsonl_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): lines that are no JSON object or hold a value of another type are violations (file, record)."""
    raw = spark.read.schema(f"{SFT}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return _separated(raw, _names(SFT))


def read_points_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): points whose cells can all be read, and (file, column_name, value) of each cell that cannot.

    Columns of the files may be text; null and NaN cells are no violations.
    """
    raw = spark.read.parquet(path)
    cells, bad = [], []
    for name, kind in ((f.name, f.dataType.simpleString()) for f in StructType.fromDDL(POINTS).fields):
        c = F.col(name)
        parsed = F.try_to_timestamp(c) if kind == "timestamp" and dict(raw.dtypes)[name] == "string" else c.try_cast(kind)
        cells.append((F.nanvl(parsed, F.lit(None).cast("double")) if kind == "double" else parsed).alias(name))
        bad.append(F.when(c.isNotNull() & parsed.isNull(), F.struct(F.lit(name).alias("column_name"), c.cast("string").alias("value"))))
    marked = raw.withColumn("_bad", F.array_compact(F.array(*bad)))
    rows = marked.where(F.size("_bad") == 0).select(*cells)
    return rows, marked.where(F.size("_bad") > 0).select(F.col("_metadata.file_name").alias("file"), F.inline("_bad"))


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; ``nan`` counts as NaN, empty cells as null."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


def read_sft_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SFT).json(path)


def read_metrics_json(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(model, gap, metrics map<string,double>) from one JSON object, or none where it holds plain strings.

    Two layouts: gap -> metrics (``overall``, ``gap_5``; needs ``model``), or model -> gap (``overall``, ``5``) -> metrics.
    Missing and NaN values are null.
    """
    text = spark.read.option("wholetext", True).text(path)
    text = text.select(F.regexp_replace("value", r"(?<=[:\[,\s])(NaN|-?Infinity)(?=\s*[,}\]])", "null").alias("value"))
    outer = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    if model is not None:
        rows = outer.select(F.lit(model).alias("model"), F.col("k").alias("gap"), "v")
    else:
        rows = outer.select(F.col("k").alias("model"), F.explode(F.from_json("v", "map<string,string>")).alias("gap", "v"))
    rows = rows.where(F.col("v").startswith("{"))
    return rows.select("model", F.regexp_replace("gap", "^gap_", "").alias("gap"), F.from_json("v", "map<string,double>").alias("metrics"))


def write_gap_examples(rows: DataFrame, path: str) -> None:
    """Windows as Parquet, partitioned for readers that want one split and gap size."""
    rows.write.mode("overwrite").partitionBy("split", "gap_steps").parquet(path)


def write_gap_examples_by_track(rows: DataFrame, table: str, path: str, buckets: int = 16, rows_per_file: int | None = None) -> DataFrame:
    """Windows as a table of ``buckets`` buckets by track, each sorted by track, sample and row; gives the table back.

    Rows are dealt out as the buckets are, so each bucket is one file (more with ``rows_per_file``), whatever the number of tasks,
    splits and gap sizes. Grouping the table by track, or joining two of as many buckets, shuffles nothing.
    """
    writer = rows.repartition(buckets, "trajectory_id").write.mode("overwrite").bucketBy(buckets, "trajectory_id").sortBy("trajectory_id", "sample_id", "global_row_index")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_predictions(steps: DataFrame, paths: dict[tuple[str, str], str]) -> None:
    """A CSV table of steps for each (configuration, model)."""
    columns = _names(STEPS)
    for (config, model), path in paths.items():
        write_table_csv(steps.where((F.col("config") == config) & (F.col("model") == model)).select(*columns), path)


def read_predictions(spark: SparkSession, paths: dict[tuple[str, str], str]) -> DataFrame:
    """Step rows with config and model of all prediction files of several models and configurations, by (configuration, model)."""
    label = lambda config, model: {"config": F.lit(config), "model": F.lit(model)}
    return reduce(DataFrame.unionByName, (read_table_csv(spark, path, STEPS).withColumns(label(*key)) for key, path in paths.items()))


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nanValue", "nan").csv(path)


def write_metrics_json(df: DataFrame, path: str, gap_col: str = "gap", model_col: str | None = None) -> None:
    """Metrics of each gap as one JSON object; with ``model_col`` as an object of such objects by model.

    ``df`` has one row for each gap (and model), few in all."""
    values = F.struct(*(c for c in df.columns if c not in (gap_col, model_col)))
    if model_col:
        per = df.groupBy(model_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(gap_col), values)))).alias("gaps"))
        one = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(model_col), F.col("gaps"))))).alias("value"))
        one.write.mode("overwrite").text(path)
        return
    one = df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(gap_col), values))))).alias("value"))
    one.write.mode("overwrite").text(path)
