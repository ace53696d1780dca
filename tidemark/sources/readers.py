"""Sources. Schemas are given, broken input is kept and flagged, listings are one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import variant_rows

CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; what does not parse is a row with CORRUPT set."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def read_texts(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Whole files: path, value, bytes, modified."""
    r = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.format("binaryFile").load(path)
    return files.select("path", F.col("content").cast("string").alias("value"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def document_state(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Wanted paths with exists, valid_json, bytes and the text (an empty object where it is bad)."""
    out = wanted.select("path").join(texts, "path", "left")
    valid = F.try_parse_json("value").isNotNull()
    return out.select("path", F.col("bytes").isNotNull().alias("exists"), valid.alias("valid_json"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.when(valid, F.col("value")).otherwise("{}").alias("value"))


def preferred(texts: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Of several files of a key the first by preference, with the winner's name."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
    rest = [c for c in texts.columns if c not in keys]
    out = texts.filter(rank > 0).groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_w"))
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def container_rows(texts: DataFrame, schema: str, *keys: str, column: str = "value") -> DataFrame:
    """Rows of a document that is a list, or holds one under a key, or is a single row."""
    other = [c for c in texts.columns if c != column]
    out = texts.select(*other, F.posexplode(variant_rows(F.col(column), *keys)).alias("ordinal", "_v"))
    return out.select(*other, "ordinal", F.from_json(F.to_json("_v"), schema).alias("row"))


def video_documents(texts: DataFrame, schema: str) -> DataFrame:
    """Per-video documents by file name ``omni_<id>.json``; the summary is none."""
    name = F.regexp_extract("path", r"omni_([^/]+)\.json$", 1)
    out = texts.withColumn("_n", name).filter("_n <> '' AND _n <> 'summary'")
    return out.select("path", "_n", F.from_json("value", schema).alias("d")).select("path", "d.*", F.coalesce("d.id", "_n").alias("video_id"))


def fingerprints(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("mp4", "mov", "mkv", "webm"), most: int | None = None) -> DataFrame:
    """Media files with the SHA-256 of their bytes; in path order, the first ``most``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    out = files.select(
        F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("source_fingerprint"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    ).withColumn("suffix", F.lower(F.element_at(F.split("filename", r"\."), -1)))
    return out.orderBy("source_path").limit(most) if most else out


def tree_hashes(files: DataFrame, folder: str, relative: str, digest: str) -> DataFrame:
    """One hash of each folder, from its files' names and hashes in order."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", relative, digest)))
    return files.groupBy(folder).agg(F.sha2(F.array_join(lines, "|"), 256).alias("tree_hash"), F.count("*").alias("n_files"))


def events_from_stream_text(lines: DataFrame, column: str = "value", order: str = "n") -> DataFrame:
    """Payloads of ``data:`` lines up to ``[DONE]``."""
    body = F.trim(F.regexp_extract(column, r"^\s*data:(.*)$", 1))
    out = lines.withColumn("_b", body).filter("_b <> ''")
    end = out.filter("_b = '[DONE]'").agg(F.min(order).alias("_end"))
    out = out.crossJoin(F.broadcast(end)).filter(F.col("_end").isNull() | (F.col(order) < F.col("_end")))  # one row
    return out.filter(F.try_parse_json("_b").isNotNull()).select(order, F.col("_b").alias("payload"))


def tails(texts: DataFrame, most: int = 20_000, column: str = "value") -> DataFrame:
    return texts.withColumn(column, F.right(column, F.lit(most)))


def settings(texts: DataFrame, column: str = "value") -> DataFrame:
    """``KEY=VALUE`` lines; comments are passed over and the first of a key wins."""
    out = texts.select(F.posexplode(F.split(column, "\n")).alias("n", "line")).filter(~F.col("line").rlike(r"^\s*(#|$)"))
    out = out.select("n", F.trim(F.regexp_extract("line", r"^\s*(?:export\s+)?([^=\s]+)\s*=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract("line", r"=(.*)$", 1)), r"^[\"']|[\"']$", "").alias("value"))
    return out.filter("key <> ''").groupBy("key").agg(F.min_by("value", "n").alias("value"))


def manifests(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """All manifests under a folder in one scan, with where they were found."""
    texts = read_texts(spark, path, glob)
    out = texts.select("path", "modified", F.from_json("value", schema).alias("d")).filter("d IS NOT NULL")
    return out.select("path", "modified", "d.*").dropDuplicates(["path"])
