r"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of a fixed number of characters. Equal blocks, and only those, get one integer
name: the distinct blocks of each shuffle partition are sorted and numbered. Adjacent names are then paired and the
distinct pairs sorted and numbered in turn, until each document has one name. A document's identity is that name with
its round; two documents share it exactly when their normalised texts are equal, as names stand for contents, not
for hash values.

Distinct blocks are aggregated in the map tasks first, so one that a third of the documents hold costs one content row
for each map task. Occurrences get their names by a 64-bit digest of the block; where one digest stands for several
blocks, by the block itself. After that a document's row is a few numbers, and names of hot blocks, pairs and groups
meet their rows by a broadcast of bounded size (`attached`).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import attached, checkpoint_dir, checkpointed, forget, read_table, remove_folder

#: Characters of a block.
BLOCK = 256
#: The characters that normalising deletes: space and the five from tab to carriage return.
BLANKS = " \t\n\x0b\f\r"


def named(distinct: DataFrame, *by: str) -> DataFrame:
    """The frame with an integer `name` for each row: rows are sorted within their shuffle partition and numbered."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def stored(df: DataFrame, path: str) -> DataFrame:
    """The frame as Parquet files: computed once, compressed, and read by column."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(norm: Column, block: int) -> Column:
    """The blocks of a normalised text; an empty one has one, which is empty."""
    return F.when(F.length(norm) <= block, F.array(norm)).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def block_names(blocks: DataFrame, occurrences: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """The rows of `occurrences` (`row, at, left, digest`) with the name of their block. `blocks` are all `digest,
    block`; `texts` are `row, at, digest, block` and read only where one digest stands for several blocks."""
    kinds = named(blocks.groupBy("digest", "block").agg(F.count("*").alias("n")), "block", "digest")
    names = stored(kinds.drop("block"), f"{folder}/names")
    forget(blocks.sparkSession)
    if names.groupBy("digest").agg(F.count("*").alias("kinds")).filter("kinds > 1").isEmpty():
        return attached(occurrences, names, "digest", count="n").drop("digest", "n")
    names = stored(kinds, f"{folder}/kinds")  # with the blocks
    shared = checkpointed(names.groupBy("digest").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("digest"))
    single = attached(occurrences, names.join(shared, "digest", "left_anti").select("digest", "name", "n"), "digest", count="n").drop("n")
    by_text = texts.join(names.select("digest", "block", "name").join(shared, "digest", "left_semi"), ["digest", "block"]).select("row", "at", "name")
    return single.unionByName(occurrences.join(by_text, ["row", "at"])).drop("digest")


def identities(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """`row, doc_id, key, n_points, text_sha256, round, name`: a row for each row of `docs`. n_points: code points of
    the original text; text_sha256: of the normalised one; key: `key_col` as it is, null without one. `folder`: a
    new one that all executors share; its files are needed until the result is computed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.col(key_col) if key_col else F.lit(None).cast("long")).alias("key"), F.length(text).cast("long").alias("n_points"),
        F.explode(F.array(F.regexp_replace(text, f"[{BLANKS}]+", ""))).alias("norm"),  # exploded so as to be computed once
    )
    digests = F.transform(cut(F.col("norm"), block), lambda b: F.xxhash64(b))
    rows = stored(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "n_points", F.sha2("norm", 256).alias("text_sha256"), digests.alias("digests")), f"{folder}/rows")
    blocks = own.select(F.explode(cut(F.col("norm"), block)).alias("block")).select(F.xxhash64("block").alias("digest"), "block")
    occurrences = rows.select("row", F.size("digests").alias("left"), F.posexplode("digests").alias("at", "digest"))
    level = checkpointed(block_names(blocks, occurrences, texts_of(rows, docs, text, block), folder))
    step, done = 0, []
    while True:
        # levels are left behind, so that their files can go
        done.append(checkpointed(level.filter("left = 1").select("row", F.lit(step).alias("round"), "name")))
        level = level.filter("left > 1")
        if level.isEmpty():
            break
        step += 1
        even = F.col("at") % 2 == 0
        paired = level.groupBy("row", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b")
        )
        paired = checkpointed(paired)
        names = checkpointed(named(paired.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b"))
        level = checkpointed(attached(paired, names, "a", "b", count="n").select("row", "left", "at", "name"))
        forget(docs.sparkSession)
    found = reduce(DataFrame.unionByName, done)
    return rows.drop("digests").join(found, "row")


def texts_of(rows: DataFrame, docs: DataFrame, text: Column, block: int) -> DataFrame:
    """`row, at, digest, block` of all blocks; documents are found again by their digests."""
    norm = docs.select(F.explode(F.array(F.regexp_replace(text, f"[{BLANKS}]+", ""))).alias("norm")).select(F.sha2("norm", 256).alias("text_sha256"), "norm").dropDuplicates(["text_sha256"])
    found = rows.select("row", "text_sha256").join(norm, "text_sha256").select("row", F.posexplode(cut(F.col("norm"), block)).alias("at", "block"))
    return found.withColumn("digest", F.xxhash64("block"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256`: a row for each row of `docs`, dropped ones too; with `key_col`
    also `key`, that column of the row.

    Texts are equal when identical after deleting `BLANKS`; null counts as empty. Of equal texts the row with the most
    code points in the original text stays, then the smallest doc_id (null ids last). Of rows that tie in both, one
    stays. An empty table gives an empty result; other columns are ignored.
    """
    folder = f"{checkpoint_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    known = checkpointed(identities(docs, folder, id_col, text_col, key_col))
    remove_folder(docs.sparkSession, folder)
    order = F.struct("n_points", F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long") - F.col("doc_id")).alias("least"), (-F.col("row")).alias("first"), "doc_id")
    groups = checkpointed(known.groupBy("round", "name").agg(F.count("*").alias("group_size"), F.max(order).alias("best")))
    out = attached(known, groups, "round", "name", count="group_size").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.first")).alias("kept"), "text_sha256", "key"
    )
    return out if key_col else out.drop("key")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
