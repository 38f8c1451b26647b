"""Loaders for term lists, benchmark pairs, matrices and harvested records. Frames are checked by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions import text as X

TERM_SCHEMA = "term string, domain string, frequency int"
DOMAINS_SCHEMA = "domains array<struct<name:string, terms:array<struct<name:string, frequency:int>>>>"
ARTICLE_SCHEMA = "id string, title string, summary string, tags array<string>, authors array<string>, published string"
PAGE_SCHEMA = "pageid long, title string, links array<string>, categories array<string>"
# The score columns a pair file may have, in order of preference, and the one that is a distance.
SCORE_COLUMNS, DISTANCE_COLUMN = ("sim", "distance", "distanceij", "similarity"), "distance"


#: Rows that an error names.
NAMED_ROWS = 5


class LoadError(ValueError):
    """A file that lacks what it must have."""


def with_rows(read: DataFrame, first: int = 1) -> DataFrame:
    """The rows of a frame just read from files, with `_file` and `_row`: the number of the row in its file, from `first`.

    A file may be read in several splits. Each split counts its own rows, the counts of the splits before it are added
    up (a row for each split), and a row adds its place in its split."""
    own = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = own.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row for each split of a file
    starts = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = own.join(starts, ["_file", "_block"]).withColumn("_row", F.col("_before") + F.col("_id") - F.col("_first") + first)
    return placed.drop("_block", "_id", "_first", "_before")


def checked(rows: DataFrame, *keep: str) -> DataFrame:
    """`term, domain, frequency`, trimmed, and the columns to keep."""
    missing = sorted({"term", "domain"} - set(rows.columns))
    if missing:
        raise LoadError(f"missing columns: {', '.join(missing)}")
    frequency = F.expr("try_cast(frequency AS int)") if "frequency" in rows.columns else F.lit(None).cast("int")
    return rows.select(F.trim(F.col("term").cast("string")).alias("term"), F.trim(F.col("domain").cast("string")).alias("domain"), F.coalesce(frequency, F.lit(1)).alias("frequency"), *keep)


def is_empty(column: str) -> Column:
    return F.coalesce(F.length(column), F.lit(0)) == 0


def clean_terms(rows: DataFrame, in_files: bool = False) -> DataFrame:
    """`term, domain, frequency`: trimmed; a missing or unreadable frequency is 1. Empty terms or domains are an
    error that counts them and, for rows just read from files, names the first of them by file and row; the header is
    row 1 there. Rows are numbered only if there is an error."""
    out = checked(rows)
    bad = out.agg(F.count_if(is_empty("term")).alias("terms"), F.count_if(is_empty("domain")).alias("domains")).first()
    if bad["terms"] or bad["domains"]:
        text = f"{bad['terms']} rows without a term, {bad['domains']} without a domain"
        if in_files:
            first = checked(with_rows(rows, 2), "_file", "_row").filter(is_empty("term") | is_empty("domain")).orderBy("_file", "_row").limit(NAMED_ROWS).collect()
            text += ": " + "; ".join(f"row {r['_row']} of {r['_file'].rsplit('/', 1)[-1]} has no {'domain' if r['term'] else 'term'}" for r in first)
        raise LoadError(text)
    return out


def read_terms_csv(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Terms of CSV files with a header. With `lines` each record is a line, and large files are read in splits; without,
    a quoted field may run over several lines, and a file is read by one task."""
    return clean_terms(spark.read.csv(path, header=True, multiLine=not lines, escape='"'), in_files=True)


def from_domains(rows: DataFrame) -> DataFrame:
    """Terms of rows with a `domains` array (name, terms)."""
    domain = rows.select(F.explode("domains").alias("d"))
    term = domain.select(F.col("d.name").alias("domain"), F.explode("d.terms").alias("t"))
    if rows.filter(F.col("domains").isNull() | (F.size("domains") == 0)).limit(1).count():
        raise LoadError("a record needs a list of domains that is not empty")
    return clean_terms(term.select(F.col("t.name").alias("term"), "domain", F.col("t.frequency").alias("frequency")))


def read_terms_json(spark: SparkSession, path: str) -> DataFrame:
    return from_domains(spark.read.json(path, schema=DOMAINS_SCHEMA, multiLine=True))


READERS = {"csv": read_terms_csv, "json": read_terms_json}


def reader(kind: str):
    """The term reader for a format, whatever its case."""
    if kind.lower() not in READERS:
        raise LoadError(f"unknown format {kind!r}; use one of {sorted(READERS)}")
    return READERS[kind.lower()]


def terms_of(spark: SparkSession, rows: list[tuple[str, str, int | None]]) -> DataFrame:
    """A term frame from rows that are already at hand, checked like a file's."""
    return clean_terms(spark.createDataFrame(rows, TERM_SCHEMA))


def domains_of(terms: DataFrame) -> DataFrame:
    """`domain, n_terms` in order of name."""
    return terms.groupBy("domain").agg(F.count("*").alias("n_terms")).orderBy("domain")


def require_domains(terms: DataFrame, *wanted: str) -> None:
    """Raise if there are no terms, a domain is not known, or one is compared with itself."""
    if len(set(wanted)) < len(wanted):
        raise LoadError("the domains must differ")
    known = {r["domain"] for r in terms.filter(F.col("domain").isin(*wanted)).select("domain").distinct().collect()}
    if not known and terms.limit(1).count() == 0:
        raise LoadError("no terms are loaded")
    if missing := sorted(set(wanted) - known):
        raise LoadError(f"unknown domains: {', '.join(missing)}")


def with_human_score(pairs: DataFrame, max_distance: float | None = None) -> DataFrame:
    """`word1, word2, human_score`: the first score column there is. A distance becomes the largest one (or
    `max_distance`) minus itself; other columns stay as they are."""
    found = next((c for c in SCORE_COLUMNS if c in pairs.columns), None)
    if found is None:
        raise LoadError(f"no score column; one of {', '.join(SCORE_COLUMNS)} is needed")
    score: Column = F.col(found).cast("double")
    out = pairs.select("word1", "word2", score.alias("human_score"))
    if found != DISTANCE_COLUMN:
        return out
    if max_distance is not None:
        return out.withColumn("human_score", F.lit(float(max_distance)) - F.col("human_score"))
    most = out.agg(F.max("human_score").alias("most"))
    return out.join(F.broadcast(most)).select("word1", "word2", (F.col("most") - F.col("human_score")).alias("human_score"))  # of one row


def read_pairs_csv(spark: SparkSession, path: str, max_distance: float | None = None) -> DataFrame:
    return with_human_score(spark.read.csv(path, header=True), max_distance)


def auxiliary_terms(*frames: DataFrame) -> DataFrame:
    """Distinct trimmed terms of more than one character from the `term` column, else the first, of each frame."""
    out = None
    for f in frames:
        own = f.select(F.trim(F.col("term" if "term" in f.columns else f.columns[0]).cast("string")).alias("term"))
        out = own if out is None else out.unionByName(own)
    return out.filter(F.length("term") > 1).distinct()


def unpivoted(matrix: DataFrame, id_col: str) -> DataFrame:
    """`d1, d2, score` of a labelled square matrix."""
    columns = [c for c in matrix.columns if c != id_col]
    typed = matrix.select(F.col(f"`{id_col}`").cast("string").alias("d1"), *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    return typed.unpivot(["d1"], columns, "d2", "score")


def article_records(feed: DataFrame) -> DataFrame:
    """`id, title, abstract, categories, authors, published` of feed entries: the id's last segment, one-line texts."""
    line = lambda c: F.trim(F.regexp_replace(c, r"\n", " "))
    return feed.select(X.last_segment(F.col("id")).alias("id"), line(F.col("title")).alias("title"), line(F.col("summary")).alias("abstract"), F.col("tags").alias("categories"), "authors", "published")


def article_documents(articles: DataFrame, domain: Column) -> DataFrame:
    return articles.select(F.col("id").alias("doc_id"), domain.alias("domain"), F.concat_ws(" ", "title", "abstract").alias("text"))


def resumed_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an earlier harvest: each line of three fields or more is cut at its first two commas; an unreadable
    frequency is 1; of lines with one term the last one counts, by file name and line number."""
    parts = F.split("value", ",", 3)
    lines = with_rows(spark.read.text(path)).filter(F.size(parts) == 3)
    rows = lines.select(F.struct("_file", "_row").alias("_at"), F.trim(parts[0]).alias("term"), F.trim(parts[1]).alias("domain"), F.coalesce(F.expr("try_cast(trim(get(split(value, ',', 3), 2)) AS int)"), F.lit(1)).alias("frequency"))
    return rows.filter((F.col("term") != "term") & (F.col("term") != "")).groupBy("term").agg(F.max_by("domain", "_at").alias("domain"), F.max_by("frequency", "_at").alias("frequency"))


def dataset_catalogue(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """`dataset, n_rows` of the data sets whose files can be read."""
    from pyspark.errors import AnalysisException

    rows = []
    for name, path in sorted(paths.items()):
        try:
            rows.append((name, spark.read.csv(path, header=True).count()))
        except AnalysisException:
            continue
    return spark.createDataFrame(rows, "dataset string, n_rows long")
