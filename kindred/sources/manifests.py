"""Digests and manifests of files, JSON documents, the registry of runs, Markdown tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files below a path; names are relative, so no local folder shows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    base = path.rstrip("/").split("://")[-1].replace("file:", "")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^.*?\\Q{base}\\E/?", "")
    last = F.element_at(F.split("path", "/"), -1)
    return files.select(F.when(name == "", last).otherwise(name).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_digest(manifest: DataFrame) -> str:
    """One digest over the sorted (name, bytes, sha256) lines, which come to the driver one partition at a time."""
    whole = hashlib.sha256()
    for r in manifest.orderBy("name").toLocalIterator():
        whole.update(f"{r['name']}\x00{r['bytes']}\x00{r['sha256']}\n".encode())
    return whole.hexdigest()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: two sums of row hashes and the count."""
    cols = sorted(df.columns)
    half = lambda seed: F.sum(F.xxhash64(*cols, F.lit(seed)).cast("decimal(38,0)"))
    row = df.agg(half(1).alias("a"), half(2).alias("b"), F.count("*").alias("n")).first()
    return f"{row['n']}:{row['a'] or 0}:{row['b'] or 0}"


def to_json(document: dict) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"


def register(spark: SparkSession, registry: str, record: dict) -> None:
    """Appends a record with the time to a JSON-lines registry."""
    stamped = record | {"registered_at": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(stamped, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(registry)


def registered(spark: SparkSession, registry: str) -> list[dict]:
    """The records in the order of their time; none if there is no registry. Blank lines are skipped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(registry)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return []
    records = [json.loads(r["value"]) for r in spark.read.text(registry).where("trim(value) <> ''").toLocalIterator()]
    return sorted(records, key=lambda r: r.get("registered_at", ""))


def model_card(title: str, meta: dict, tables: dict[str, DataFrame]) -> str:
    """A model card in Markdown: what is known of the model, then each table under its name."""
    known = "\n".join(f"- {k}: {json.dumps(v, default=str)}" for k, v in sorted(meta.items()))
    return "\n\n".join([f"# {title}", known, *[f"## {name}\n\n{markdown_table(df)}" for name, df in tables.items()]]).rstrip() + "\n"


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1000) -> str:
    """A small result table in Markdown: floats with 4 digits, null as empty; raises beyond ``most`` rows."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, float):
            return f"{v:.4f}"
        return str(v) if isinstance(v, (int, str)) else json.dumps(v, default=str)

    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(v).replace("|", "\\|") for v in row) + " |" for row in rows]) + "\n"
