"""Writing results: JSON lines, Parquet, CSV with a fixed header, one document, Markdown; and publishing them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """The header's columns in its order; those that are missing stay empty. White space at the ends of a value stays."""
    df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in header]).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_labelling_sheet(sample: DataFrame, path: str, predicted: list[str], judged: list[str]) -> None:
    """A bounded sample for people, as ``csv`` and ``json`` in a folder: pred_* as given, human_* to be filled in."""
    sheet = sample.select(*[c for c in sample.columns if c not in predicted], *[F.col(c).alias(f"pred_{c}") for c in predicted], *[F.lit("").alias(f"human_{c}") for c in judged])
    write_csv(sheet, f"{path}/csv", sheet.columns)
    write_jsonl(sheet, f"{path}/json")


def write_progress(spark: SparkSession, path: str, stage: str, detail: str, done: int | None = None, total: int | None = None) -> str:
    """Write where a run stands as one document, and return the line to print."""
    write_jsonl(spark.createDataFrame([(stage, detail, done, total)], "stage string, detail string, done long, total long").coalesce(1), path)
    return f"[progress] {stage}: {detail}" + (f" ({done}/{total}, {100 * done / total:.2f}%)" if done is not None and total else "")


def document(df: DataFrame) -> dict:
    """A one-row result as a document."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document needs exactly one row")
    return json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows of a small result."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |\n" for r in rows)


def repaired(rows: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank values of ``columns`` filled from a lookup by key."""
    other = lookup.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(other, F.col(key) == F.col("__k"), "left").select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def publish(spark: SparkSession, folder: str, target: str, required: list[str], optional: list[str] | None = None) -> list[str]:
    """Copy finished outputs; a required one that is missing stops it before anything is copied."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    at = lambda base, name: hadoop.Path(f"{base.rstrip('/')}/{name}")
    there = lambda name: at(folder, name).getFileSystem(conf).exists(at(folder, name))
    missing = [n for n in required if not there(n)]
    if missing:
        raise FileNotFoundError(f"required outputs are missing: {missing}")
    names = [*required, *[n for n in optional or [] if there(n)]]
    for n in names:
        a, b = at(folder, n), at(target, n)
        hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return names


def hashed(rows: DataFrame, name: str, content: str) -> DataFrame:
    """An index of evidence: name, length in bytes and SHA-256 of a content column."""
    return rows.select(name, F.octet_length(content).cast("long").alias("length"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
