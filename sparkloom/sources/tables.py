"""Readers and writers of tables and logs, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_LIMIT = 5000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object per line that isn't blank, as ``record``; a corrupt line is skipped, or with strict fails the query."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return parse_lines(lines, schema, strict)


def parse_lines(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """lines(value) parsed as ``record``."""
    parsed = lines.withColumn("record", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    if strict:
        return parsed.withColumn("record", F.when(bad, F.raise_error(F.lit("corrupt line"))).otherwise(F.col("record")))
    return parsed.where(~bad)


def capture(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and sha256 of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_capture(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of a manifest(path, sha256) whose file is missing or differs."""
    current = found.select("path", F.col("sha256").alias("now"))
    return manifest.join(current, "path", "left").where("now IS NULL OR now <> sha256").select("path", "sha256", "now")


def export(df: DataFrame, kind: str, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The first rows as text lines: jsonl, or csv without a header."""
    limited = df.limit(min(limit, EXPORT_LIMIT))
    row = F.struct(*[F.col(c) for c in df.columns])
    return limited.select((F.to_json(row) if kind == "jsonl" else F.to_csv(row)).alias("value"))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert or ignore: the incoming rows whose key is not there yet, one per key."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def select_fields(df: DataFrame, fields: str | list[str], allowed: list[str]) -> DataFrame:
    """Columns named in a list or a comma-separated text, in order, each once; unknown names are an error."""
    names = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else fields
    names = list(dict.fromkeys(f for f in names if f))
    if unknown := [f for f in names if f not in allowed]:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return df.select(*names)


def clamp(value: object, least: int, most: int, default: int) -> int:
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def filtered(df: DataFrame, equal: dict[str, object] | None = None, contains: dict[str, str] | None = None, between: tuple[str, object, object] | None = None,
    keyword: tuple[str, list[str]] | None = None) -> DataFrame:
    """Equality, case-insensitive containment, an inclusive range, and one keyword over several columns."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.lower(c), F.lit(v.lower())))
    if between:
        df = df.where(F.col(between[0]).between(F.lit(between[1]), F.lit(between[2])))
    if keyword:
        anywhere: Column = F.lit(False)
        for c in keyword[1]:
            anywhere = anywhere | F.coalesce(F.contains(F.lower(c), F.lit(keyword[0].lower())), F.lit(False))
        df = df.where(anywhere)
    return df
