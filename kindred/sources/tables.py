"""Readers with explicit schemas and writers that never overwrite by accident."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# What counts as missing in delivered CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

PAIRS = StructType([
    StructField("row_id", LongType()), StructField("qid1", StringType()), StructField("qid2", StringType()), StructField("question1", StringType()),
    StructField("question2", StringType()), StructField("is_duplicate", IntegerType()),
])
CATALOG = StructType([StructField("question_id", StringType()), StructField("question", StringType())])
QRELS = StructType([StructField("query", StringType()), StructField("question_id", StringType()), StructField("relevance", DoubleType())])
NUMBERS = {"is_duplicate": "int", "relevance": "double", "row_id": "long"}


def read_csv(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """All columns of a CSV file with header as text, header names stripped; the required ones must be there.

    Quoted fields may hold line breaks and doubled quotes. Ids stay text; ``NUMBERS`` are cast, what can't be cast becomes null. The
    usual words for missing values become null.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; found {raw.columns}")
    out = raw.select([F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return out.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in NUMBERS.items() if c in out.columns})


def read_pairs(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Labelled pairs; a ``row_id`` in file order is added where the file has none. ``max_rows`` keeps the rows of the smallest row_ids."""
    df = read_csv(spark, path, ["question1", "question2", "is_duplicate"])
    df = df if "row_id" in df.columns else with_row_id(df)
    if max_rows is None:
        return df
    if max_rows < 1:
        raise ValueError("max_rows must be at least 1")
    return df.orderBy("row_id").limit(max_rows)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in the order of partitions and rows, without moving rows: counts per partition, then offsets."""
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one per partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    numbered = tagged.withColumn("_p", part).join(F.broadcast(table), "_p")
    return numbered.withColumn(name, F.col("_o") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_o")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ["question_id", "question"])


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments; without a relevance column every row has gain 1."""
    df = read_csv(spark, path, ["query", "question_id"])
    return df if "relevance" in df.columns else df.withColumn("relevance", F.lit(1.0))


def batches(df: DataFrame, rows: int = 50_000) -> Iterator[list[Row]]:
    """The table in lists of at most ``rows`` rows, one partition at a time on the driver."""
    if rows < 1:
        raise ValueError("rows must be at least 1")
    batch: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == rows:
            yield batch
            batch = []
    if batch:
        yield batch


def write_roles(assigned: DataFrame, rows: DataFrame, key: str, path: str) -> None:
    """One folder of CSV per role, rows in the order of the key; refuses to overwrite."""
    joined = rows.join(assigned, key).repartitionByRange(F.col("role"), F.col(key)).sortWithinPartitions("role", key)
    joined.write.partitionBy("role").option("header", True).option("lineSep", "\n").option("quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def read_stream(spark: SparkSession, folder: str, schema: StructType = PAIRS, files_per_trigger: int = 8) -> DataFrame:
    """CSV files of a folder as a stream, quoted as ``read_csv`` takes them: line breaks and doubled quotes in quoted fields."""
    reader = spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=files_per_trigger)
    return reader.csv(folder)
