"""Stored tables as frames and Parquet: pair scores by method, results with history, harvested terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.stores.lineage import kept

# The methods whose scores are stored.
METHODS = ("sbert", "rag", "wordnet", "bert", "tfidf", "ensemble")
PAIR_SCHEMA = "domain1 string, domain2 string, method string, metric string, score double, ts timestamp"


def pair_key(a: Column, b: Column) -> Column:
    """The two names in order of their lower-cased forms, as they are written."""
    return F.when(F.lower(a) <= F.lower(b), F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))


def newest_pairs(scores: DataFrame) -> DataFrame:
    """`a, b, method, metric, score, ts`: the last score of each unordered, case-blind pair."""
    own = scores.select(pair_key(F.col("domain1"), F.col("domain2")).alias("_k"), "method", "metric", "score", "ts")
    own = own.select(F.lower("_k.a").alias("a"), F.lower("_k.b").alias("b"), "method", "metric", "score", "ts")
    return own.groupBy("a", "b", "method", "metric").agg(F.max_by("score", F.struct("ts", "score")).alias("score"), F.max("ts").alias("ts"))


def write_pairs(scores: DataFrame, path: str) -> None:
    """Append scores to a Parquet table partitioned by method and metric."""
    scores.write.mode("append").partitionBy("method", "metric").parquet(path)


def read_pairs(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """Newest scores; a method reads its own partitions only."""
    rows = spark.read.schema(PAIR_SCHEMA).parquet(path)
    return newest_pairs(rows if method is None else rows.filter(F.col("method") == method))


def clear_pairs(spark: SparkSession, path: str, method: str | None = None) -> int:
    """Delete one method's scores, or all, by the folders they lie in; returns how many rows went."""
    rows = spark.read.schema(PAIR_SCHEMA).parquet(path)
    gone = rows if method is None else rows.filter(F.col("method") == method)
    count = gone.count()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path if method is None else f"{path}/method={method}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return count


def cached_or(computed: DataFrame, cached: DataFrame, method: str, metric: str) -> DataFrame:
    """`domain1, domain2, score, hit`: the stored score of each pair where there is one, the computed one elsewhere."""
    own = cached.filter((F.col("method") == method) & (F.col("metric") == metric)).select("a", "b", F.col("score").alias("_s"))
    key = pair_key(F.col("domain1"), F.col("domain2"))
    keyed = computed.withColumns({"a": F.lower(key["a"]), "b": F.lower(key["b"])})
    return keyed.join(own, ["a", "b"], "left").select("domain1", "domain2", F.coalesce("_s", "score").alias("score"), F.col("_s").isNotNull().alias("hit"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each pair and its mirror image, for stores that look up by direction."""
    rest = [c for c in pairs.columns if c not in ("domain1", "domain2")]
    mirror = pairs.select(F.col("domain2").alias("domain1"), F.col("domain1").alias("domain2"), *rest)
    return pairs.select("domain1", "domain2", *rest).unionByName(mirror)


def method_counts(scores: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """`method, n`: stored pairs of each method, 0 for those without."""
    known = scores.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    counts = scores.groupBy("method").agg(F.count("*").alias("n"))
    return known.join(counts, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_counts(keys: DataFrame, key: str = "key") -> DataFrame:
    """`prefix, n`: keys by what stands before their first colon."""
    return keys.groupBy(F.split_part(F.col(key), F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


def fresh(rows: DataFrame, now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """Rows younger than a number of seconds."""
    return rows.filter(F.col(ts) > now - F.make_dt_interval(secs=F.lit(float(seconds))))


def current_results(history: DataFrame, dataset: str = "dataset", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest row of each data set, with `created_at` of its first one."""
    rest = [c for c in history.columns if c != dataset]
    latest = history.groupBy(dataset).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"), F.min(ts).alias("created_at"))
    return latest.select(dataset, "_r.*", "created_at")


def history_of(history: DataFrame, n: int = 10, dataset: str = "dataset", ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest n rows of each data set, with their `place`."""
    place = F.row_number().over(W.partitionBy(dataset).orderBy(F.desc(ts), F.desc(tie)))
    return history.withColumn("place", place).filter(F.col("place") <= n)


def datasets_by_age(history: DataFrame, dataset: str = "dataset", ts: str = "ts") -> DataFrame:
    """`dataset, updated_at`, the newest first."""
    return history.groupBy(dataset).agg(F.max(ts).alias("updated_at")).orderBy(F.desc("updated_at"), dataset)


def results_json(results: DataFrame, by: str = "dataset") -> DataFrame:
    """`dataset, results_json`: the results of a data set (a few methods) as one JSON text."""
    rest = sorted(c for c in results.columns if c != by)
    return results.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct("method", *[c for c in rest if c != "method"])))).alias("results_json"))


def parsed_results(rows: DataFrame, schema: str) -> DataFrame:
    """The rows of stored JSON texts."""
    return rows.select("dataset", F.explode(F.from_json("results_json", f"array<struct<{schema}>>")).alias("_r")).select("dataset", "_r.*")


def write_terms(terms: DataFrame, path: str) -> None:
    """Terms as CSV; `tfidf_score` is written only if some term has one, missing ones as 0."""
    out = terms
    if "tfidf_score" in terms.columns:
        some = terms.filter(F.col("tfidf_score").isNotNull()).limit(1).count()
        out = terms.withColumn("tfidf_score", F.coalesce("tfidf_score", F.lit(0.0))) if some else terms.drop("tfidf_score")
    out.write.mode("overwrite").csv(path, header=True)


def write_domain_terms(terms: DataFrame, path: str) -> None:
    """All columns as JSON and term, domain and frequency as CSV, a folder for each domain, most frequent terms first.

    Rows are dealt by ranges of domain, frequency and term, so a large domain is several files, which follow each other by
    name, and is never in one task. The ranges are drawn once for both."""
    own = kept(terms.withColumn("_domain", F.col("domain")).repartitionByRange("_domain", F.desc("frequency"), "term").sortWithinPartitions("_domain", F.desc("frequency"), "term"))
    own.write.mode("overwrite").partitionBy("_domain").json(f"{path}/full")
    own.select("term", "domain", "frequency", "_domain").write.mode("overwrite").partitionBy("_domain").csv(f"{path}/minimal", header=True)


def write_combined(harvests: list[DataFrame], path: str) -> None:
    """The terms of all harvests: every row as JSON, and as CSV one row for each term and domain, of the earliest harvest;
    both by domain, most frequent terms first."""
    order = ["domain", F.desc("frequency"), "term"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), harvests)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path}/full")
    combined_terms(*harvests).select("term", "domain", "frequency").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(f"{path}/minimal", header=True)


def extended_corpus(terms: DataFrame, more: DataFrame, least: int = 100, force: bool = False) -> DataFrame:
    """`term, place`: the distinct terms of `terms` (`term, place`) in their order, then terms of `more` that are not
    among them: up to `least` in all, or every one with `force`. The limit is the operation's own."""
    own = terms.groupBy("term").agg(F.min("place").cast("long").alias("place"))
    n, last = own.agg(F.count("*"), F.max("place")).first()
    if n >= least and not force:
        return own
    unseen = more.groupBy("term").agg(F.min("place").cast("long").alias("place")).join(own, "term", "left_anti")
    added = unseen if force else unseen.orderBy("place", "term").limit(least - n)
    return own.unionByName(added.withColumn("place", F.col("place") + ((last or 0) + 1)))


def combined_terms(*harvests: DataFrame) -> DataFrame:
    """The harvests' terms, one row for each term and domain: of the earliest harvest, there the most frequent."""
    out = None
    for k, h in enumerate(harvests):
        own = h.select("term", "domain", "frequency", F.lit(k).alias("_k"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("term", "domain").agg(F.min_by("frequency", F.struct("_k", -F.col("frequency"))).alias("frequency"))


def result_table(results: DataFrame) -> DataFrame:
    """`line`: the results as rows of a Markdown table, four decimals."""
    return results.orderBy("method").select(F.format_string("| %s | %.4f | %.4f | %.4f | %d |", "method", "spearman", "pearson", "mse", "missing").alias("line"))


def result_report(results: DataFrame, dataset: str, size: int, seconds: float) -> str:
    """The results of a data set, a row for each method, as Markdown with its header."""
    head = [f"## Results: {dataset}", f"(n={size}, time={seconds:.1f}s)", "", "| Method | Spearman | Pearson | MSE | Missing |", "|-|-|-|-|-|"]
    return "\n".join([*head, *(r["line"] for r in result_table(results).collect())])
