"""A corpus pipeline of five stages, each an operator of `kindred.llm`.

Each stage takes the session, the documents that its predecessor left, and the folder of the tables, and its decisions
take effect on what it returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import common, components, exact_dedup, langid, packing, shingles, simhash, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a packing worker remembers; few, as the workers of the stages before still hold memory.
PACK_MEMORY = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or a letter go."""
    return langid.predict(docs.select(*COLUMNS), langid.fit(docs)).filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def with_keys(docs: DataFrame) -> DataFrame:
    """The documents with `_key`, a number of each row's own: its doc_id, or one beyond all ids for rows without an id
    and for those whose id is repeated."""
    own = docs.select(*COLUMNS)
    repeated = common.checkpointed(own.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    odd = own.filter("doc_id IS NULL").unionByName(own.join(repeated, "doc_id", "left_semi").select(*COLUMNS))
    odd = common.checkpointed(odd.withColumn("_key", F.monotonically_increasing_id()))
    if odd.isEmpty():
        return own.withColumn("_key", F.col("doc_id"))
    most = own.agg(F.max("doc_id")).first()[0] or 0
    plain = own.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").alias("_key"))
    return plain.unionByName(odd.withColumn("_key", F.col("_key") + 1 + most))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts. Rows without an id and rows with repeated ids are judged
    each by itself."""
    keyed = with_keys(docs)
    kept = common.checkpointed(exact_dedup.exact_duplicates(keyed, key_col="_key").filter("kept").select(F.col("key").alias("_key")))
    common.forget(spark)
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, over shingles of five words: fingerprints of
    whole texts at most two bits apart, or a cosine, which the fingerprints estimate, of 0.8 or more between the sets of
    shingles. Rows without an id and rows with repeated ids are judged each by itself, after all others."""
    keyed = with_keys(docs)
    whole = simhash.near_duplicates(keyed, words=5, id_col="_key").filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    whole = common.checkpointed(whole)
    common.forget(spark)
    labels = components.smallest_reachable(whole.union(shingles.similar_pairs(keyed.select(F.col("_key").alias("doc_id"), "text"))))
    gone = common.checkpointed(labels.filter("node <> label").select(F.col("node").alias("_key")))
    common.forget(spark)
    return keyed.join(gone, "_key", "left_anti").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids have; documents that lose all their text go.

    Bytes that removal leaves of a character are no text and go too."""
    found = suffix_dedup.without_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(F.try_validate_utf8(F.col("kept").cast("string")))
    whole = F.coalesce(text, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    cut = found.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0)).select(
        "row.doc_id", whole.alias("text"), "row.lang", "row.source", F.when(F.col("n_removed") == 0, F.col("row.n_chars")).alias("n_chars")
    )
    return cut.select("doc_id", "text", "lang", "source", F.coalesce("n_chars", F.length("text").cast("long")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed_pieces(docs, packing.tokenizer_path(), keep_ids=False, memory=PACK_MEMORY, share=False)


STAGES = [("language ID", language_id), ("exact dedup", drop_exact), ("SimHash near-dedup", drop_near), ("suffix-array dedup", drop_repeats), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`. Each stage but the last is written to the shared folder and read again;
    what is written goes once the last stage's rows are computed."""
    docs = common.read_table(spark, sf_dir, "documents")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    packed = common.checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    suffix_dedup.drop_tables()
    common.remove_folder(spark, folder)
    return packed
