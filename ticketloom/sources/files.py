"""CSV and JSON edges: labelled tickets, uploads, exports, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ticketloom.functions.text import is_blank, strip
from ticketloom.sources.synthetic import generate

LABELLED_SCHEMA = (
    "id string, text string, department string, urgency string, language string, channel string, timestamp timestamp"
)
METRIC_SCHEMA = "split string, target string, class string, metric string, value double"
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CSV_OPTIONS = {"header": True, "quote": "\"", "escape": "\"", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EXTRA_FIELDS = ["department_top3", "urgency_top3", "rationale", "similar", "explain"]


def read_labelled_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Labelled tickets with a declared schema; a missing text is the empty string.

    Large files are split and read by many tasks. Set ``multi_line`` for sources with line breaks
    inside cells, which one task must read per file. Timestamps are ISO 8601, with any fraction.
    """
    rows = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).schema(LABELLED_SCHEMA).csv(path)
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def read_upload_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """An uploaded file: ``text`` is the column of that name or else the first one.

    Only the header is read for the names; every column is a string. ``id`` and ``channel`` are kept.
    ``multi_line`` as for labelled files.
    """
    rows = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path)
    text_col = "text" if "text" in rows.columns else rows.columns[0]
    optional = [F.col(c) for c in ("id", "channel") if c in rows.columns]
    return rows.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *optional)


def read_upload_with_rejects(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records of uploaded files with the given columns.

    ``text`` is the column of that name or else the first one. Rejected are records that have more or
    fewer cells than columns (``malformed``) and those whose text is blank (``blank``): their columns, the
    reason, and the record as it stands in the file or the blank text. Accepted texts are stripped.
    """
    schema = StructType([StructField(c, StringType()) for c in [*columns, "_corrupt"]])
    # with column pruning a query of few columns would not see that a record has too many cells
    options = CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "columnPruning": False}
    rows = spark.read.options(**options).schema(schema).csv(path)
    text = F.coalesce(F.col("text" if "text" in columns else columns[0]), F.lit(""))
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(is_blank(text), "blank")
    rows = rows.withColumns({"text": text, "reason": reason, "record": F.coalesce("_corrupt", text)}).drop("_corrupt")
    accepted = rows.filter("reason IS NULL").withColumn("text", strip(F.col("text"))).drop("reason", "record")
    rejected = rows.filter("reason IS NOT NULL")
    none = {c: F.when(F.col("reason") == "blank", F.col(c)) for c in columns}
    return accepted, rejected.withColumns(none)


def _flat(df: DataFrame) -> DataFrame:
    nested = (ArrayType, MapType, StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Export predictions; nested columns become JSON text, timestamps keep their microseconds."""
    _flat(df).write.mode("overwrite").options(**CSV_OPTIONS, timestampFormat=MICROSECONDS).csv(path)


def write_labelled_csv(spark: SparkSession, path: str, n: int = 1200, seed: int = 42) -> str:
    write_csv(generate(spark, n, seed), path)
    return path


def pack_extra(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The explanatory fields as one JSON text column ``extra``, for text-only sinks."""
    present = [f for f in fields or EXTRA_FIELDS if f in df.columns]
    return df.withColumn("extra", F.to_json(F.struct(*present)))


def unpack_extra(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("extra", F.from_json("extra", schema))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metric table has a few hundred rows, hence one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)
