"""Saved neighbour indexes: versions under a key, each with a record of what it holds.

An index lies in `<folder>/<key>/v<n>/rows`. Its record, `<folder>/<key>/v<n>/record`, is written after the rows, so a
version that was cut off has none and is passed over. A record counts the rows and adds up their hashes; a version whose
rows do not agree with it is corrupt and not given out.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.stores import files

RECORD_SCHEMA = "key string, version int, dataset string, language string, model string, terms_count long, dimension int, fingerprint long, created_at timestamp"


def term_hash(terms: DataFrame, column: str = "term") -> int:
    """A hash of the distinct terms, whatever their order, by one aggregate."""
    found = terms.select(F.col(column).cast("string").alias("t")).distinct().agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("t")).alias("x")).first()
    return ((found["x"] or 0) ^ (found["n"] * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF


def index_key(dataset: str, language: str, terms: DataFrame, column: str = "term") -> str:
    """The key of an index: data set, language and the terms it is for. Other terms make another key, so an index that
    does not fit the terms any more is never found."""
    plain = lambda s: re.sub(r"[^A-Za-z0-9.-]", "-", s)
    return f"{plain(dataset)}_{plain(language)}_{term_hash(terms, column):016x}"


def described(rows: DataFrame) -> DataFrame:
    """`terms_count, dimension, fingerprint` of an index, by one aggregate. The dimension is null where vectors differ in
    length."""
    size = F.size("vector")
    return rows.agg(F.count("*").alias("terms_count"), F.when(F.min(size) == F.max(size), F.max(size)).alias("dimension"), F.coalesce(F.bit_xor(F.xxhash64("term", "vector")), F.lit(0)).alias("fingerprint"))


def save_index(index: DataFrame, folder: str, key: str, dataset: str = "", language: str = "", model: str = "") -> int:
    """Store `term, vector` rows as the next version under a key, and return its number. An index without rows, or with
    vectors of several lengths, is an error, and nothing is left of it."""
    spark = index.sparkSession
    version = max(files.versions(spark, f"{folder}/{key}"), default=0) + 1
    place = f"{folder}/{key}/v{version}"
    index.select("term", "vector").write.parquet(f"{place}/rows")
    record = described(spark.read.parquet(f"{place}/rows")).first()
    if not record["terms_count"] or record["dimension"] is None:
        files.remove(spark, place)
        raise ValueError("an index needs rows, and vectors of one length")
    row = [(key, version, dataset, language, model, record["terms_count"], record["dimension"], record["fingerprint"])]
    named = spark.createDataFrame(row, RECORD_SCHEMA.rsplit(",", 1)[0]).withColumn("created_at", F.current_timestamp())
    named.coalesce(1).write.parquet(f"{place}/record")
    return version


def record_of(spark: SparkSession, place: str) -> DataFrame | None:
    """A version's record; none where it is missing or cannot be read."""
    if not files.exists(spark, f"{place}/record/_SUCCESS"):
        return None
    try:
        return spark.read.schema(RECORD_SCHEMA).parquet(f"{place}/record")
    except AnalysisException:
        return None


def load_index(spark: SparkSession, folder: str, key: str, model: str | None = None) -> DataFrame | None:
    """`term, vector` of the newest whole version under a key; none where there is none, where it is of another `model`
    than the one asked for, or where its rows do not agree with its record."""
    for version in reversed(files.versions(spark, f"{folder}/{key}")):
        place = f"{folder}/{key}/v{version}"
        record = record_of(spark, place)
        wanted = record.first() if record is not None else None
        if wanted is None or wanted["key"] != key or (model is not None and wanted["model"] != model):
            continue
        try:
            rows = spark.read.parquet(f"{place}/rows").select("term", "vector")
            found = described(rows).first()
        except Exception:  # files that are gone or broken: this version is none
            continue
        if all(found[c] == wanted[c] for c in ("terms_count", "dimension", "fingerprint")):
            return rows
    return None


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all indexes in a folder, one for each key and version."""
    out = spark.createDataFrame([], RECORD_SCHEMA)
    for key in files.names(spark, folder):
        for version in files.versions(spark, f"{folder}/{key}"):
            record = record_of(spark, f"{folder}/{key}/v{version}")
            out = out if record is None else out.unionByName(record)
    return out


def forget_index(spark: SparkSession, folder: str, key: str, keep: int = 0) -> int:
    """Remove the versions under a key but for the newest `keep`; returns how many went."""
    old = files.versions(spark, f"{folder}/{key}")
    old = old[: len(old) - keep] if keep else old
    for version in old:
        files.remove(spark, f"{folder}/{key}/v{version}")
    return len(old)


def index_for(vectors: DataFrame, folder: str, dataset: str, language: str, build, model: str = "") -> DataFrame:
    """The stored index for the terms of `vectors`, or `build(vectors)`, stored under their key first."""
    spark, key = vectors.sparkSession, index_key(dataset, language, vectors)
    found = load_index(spark, folder, key, model)
    if found is None:
        save_index(build(vectors), folder, key, dataset, language, model)
        found = load_index(spark, folder, key, model)
    return found
