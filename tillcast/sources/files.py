"""File sources and sinks (IO1-IO12).

Schemas are declared, never inferred (inference costs a pass over the data
and mis-types codes such as "0"/0).  Multi-file inputs are one glob scan; the
key comes from each row's file name (``_metadata.file_name``), so there is no
driver loop over files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import reshape

# Fixed schemas of the reference's inputs.
TRAIN_SCHEMA = ("Store INT, DayOfWeek INT, Date DATE, Sales DOUBLE, Customers INT, Open INT, Promo INT, "
                "StateHoliday STRING, SchoolHoliday INT")
TEST_SCHEMA = ("Id INT, Store INT, DayOfWeek INT, Date DATE, Open INT, Promo INT, StateHoliday STRING, "
               "SchoolHoliday INT")
STORE_SCHEMA = ("Store INT, StoreType STRING, Assortment STRING, CompetitionDistance DOUBLE, "
                "CompetitionOpenSinceMonth INT, CompetitionOpenSinceYear INT, Promo2 INT, Promo2SinceWeek INT, "
                "Promo2SinceYear INT, PromoInterval STRING")
STATES_SCHEMA = "Store INT, State STRING"
TREND_SCHEMA = "Date DATE, Goog_trend INT"  # country file
STATE_TREND_SCHEMA = "Date DATE, State STRING, Goog_trend INT"  # one file per state
INDICATOR_SCHEMA = ("LOCATION STRING, INDICATOR STRING, SUBJECT STRING, MEASURE STRING, FREQUENCY STRING, "
                    "TIME STRING, Value DOUBLE, `Flag Codes` STRING")
RELEASE_SCHEMA = "DateTime STRING, Actual DOUBLE, Consensus DOUBLE, Previous DOUBLE, Revised DOUBLE"
# Stray index columns left by earlier writers.
INDEX_COLUMNS = ("Unnamed: 0", "V1", "_c0")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",",
             header: bool = True) -> DataFrame:
    """Header CSV with a declared schema; empty fields are NULL (IO1, IO2, IO4).

    Fails on a header that differs from the schema and on rows that do not
    fit it, instead of turning them into NULLs.
    """
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("enforceSchema", not header).option("mode", "FAILFAST").csv(path))


def read_keyed_files(spark: SparkSession, pattern: str, schema: str, key: str = "State", sep: str = ";",
                     restore: Mapping[str, str] | None = None) -> DataFrame:
    """One scan of many files; ``key`` = file name without extension (IO3).

    ``restore`` maps a file key back to the code used in the data (a
    compound code stored under one of its parts).  Files that carry the key
    as a column of ``schema`` keep that column instead.
    """
    df = read_csv(spark, pattern, schema, sep=sep)
    if key in df.columns:
        return df
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    out = df.withColumn(key, name)
    for file_key, code in (restore or {}).items():
        out = out.withColumn(key, F.when(F.col(key) == file_key, code).otherwise(F.col(key)))
    return out


def read_weekly_report(spark: SparkSession, path: str) -> DataFrame:
    """Multi-section text report: keep 'yyyy-MM-dd - yyyy-MM-dd,value' lines (IO5)."""
    lines = spark.read.text(path)
    rx = r"^(\d{4}-\d{2}-\d{2} - \d{4}-\d{2}-\d{2}),\s*(\d+)\s*$"
    keep = lines.filter(F.col("value").rlike(rx))
    rng = F.regexp_extract("value", rx, 1)
    start, end = reshape.parse_week_range(rng)
    return keep.select(start.alias("week_start"), end.alias("week_end"),
                       F.regexp_extract("value", rx, 2).cast("int").alias("value"))


def read_wide_indicators(spark: SparkSession, path: str, id_cols: Sequence[str] = ("Country Name", "Country Code",
                                                                                      "Series Name", "Series Code")
                         ) -> DataFrame:
    """Wide year table with blank and footer lines: keep coded rows, '..' -> NULL, long form (IO6, RS4)."""
    raw = spark.read.option("header", True).csv(path)
    coded = raw.filter(F.col("`Series Code`").isNotNull() & (F.trim(F.col("`Series Code`")) != ""))
    years = [c for c in raw.columns if c not in set(id_cols)]
    return reshape.unpivot_years(coded, list(id_cols), years)


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Release table, newest first in the file; timestamps 'MM/dd/yyyy HH:mm:ss' (DT12)."""
    df = read_csv(spark, path, RELEASE_SCHEMA)
    return df.select(F.try_to_timestamp("DateTime", F.lit("MM/dd/yyyy HH:mm:ss")).alias("Released"),
                     "Actual", "Consensus", "Previous", "Revised")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header CSV, no index column (IO7)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_by_tag(df: DataFrame, path: str, tag: str = "type", fmt: str = "csv") -> None:
    """One folder per tag value in a single write (IO8)."""
    df.write.mode("overwrite").partitionBy(tag).option("header", True).format(fmt).save(path)


def write_submission(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Id, Sales ordered by Id (IO9).  ``single_file`` funnels through one task:
    only for the small, final submission table."""
    out = df.select("Id", "Sales").orderBy("Id")
    if single_file:
        out = out.coalesce(1)
    write_csv(out, path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def read_feature_list(spark: SparkSession, path: str, column: str = "variable", limit: int | None = None) -> list[str]:
    """Names from a saved importance table, in file order (IO11): one per feature of a model."""
    df = spark.read.option("header", True).csv(path).select(column, F.monotonically_increasing_id().alias("__i"))
    df = df.orderBy("__i")
    return [r[0] for r in (df if limit is None else df.limit(limit)).collect()]


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Ignore a stray row-index column written by another tool (IO12)."""
    return df.drop(*[c for c in INDEX_COLUMNS if c in df.columns])
