"""The test tables as terms, vectors, documents, pairs, a taxonomy and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(F.col("vec_id").alias("term"), F.col("label").alias("domain"), "embedding")


def terms(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").groupBy(F.col("p_name").alias("term"), F.col("p_type").alias("domain")).agg(F.count("*").cast("int").alias("frequency"))


def term_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Terms as often as they come."""
    return read(spark, folder, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("domain"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.col("lang").alias("domain"), "text")


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the next one; human scores are 10 within a domain, else made up of the id."""
    own = vectors(spark, folder).select("term", "domain")
    sides = own.select(F.explode(F.array(F.struct("term", F.col("domain").alias("a"), F.lit(None).alias("b")), F.struct((F.col("term") - 1).alias("term"), F.lit(None).alias("a"), F.col("domain").alias("b")))).alias("s"))
    met = sides.select("s.*").groupBy("term").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    score = F.when(F.col("a") == F.col("b"), 10.0).otherwise((F.col("term") * 7 % 10).cast("double"))
    return met.select(F.col("term").alias("word1"), (F.col("term") + 1).alias("word2"), score.alias("human_score"))


def term_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of part names whose first words agree or whose second words do."""
    own = read(spark, folder, "part").select(F.col("p_name").alias("n")).distinct()
    a = own.select(F.col("n").alias("word1"), F.split("n", " ")[0].alias("k"))
    b = own.select(F.col("n").alias("word2"), F.split("n", " ")[0].alias("k"))
    return a.join(b, "k").filter("word1 < word2").select("word1", "word2")


def hypernyms(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers below nations below regions below one root."""
    edge = lambda child, parent: [child.alias("child"), parent.alias("parent"), F.lit(0).alias("ord")]
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    s = read(spark, folder, "supplier").select(*edge(name("S", "s_suppkey"), name("N", "s_nationkey")))
    n = read(spark, folder, "nation").select(*edge(name("N", "n_nationkey"), name("R", "n_regionkey")))
    r = read(spark, folder, "region").select(*edge(name("R", "r_regionkey"), F.lit("WORLD")))
    return s.unionByName(n).unionByName(r)


def synsets(spark: SparkSession, folder: str) -> DataFrame:
    h = hypernyms(spark, folder)
    return h.select(F.col("child").alias("synset_id")).union(h.select("parent")).distinct()


def senses(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(F.col("s_name").alias("term"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("synset_id"), F.lit(0).alias("ord"))


def sense_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier with the next and the one after."""
    s = read(spark, folder, "supplier").select("s_suppkey", "s_name")
    after = s.select(F.explode(F.array(F.col("s_suppkey") - 1, F.col("s_suppkey") - 2)).alias("s_suppkey"), F.col("s_name").alias("word2"))
    return s.join(after, "s_suppkey").select(F.col("s_name").alias("word1"), "word2")


def supplier_pairs(spark: SparkSession, folder: str, *after: int) -> DataFrame:
    """Each supplier with the ones that many numbers on; human scores are 10 within a nation, 6 within a region, else made
    up of the number."""
    s, n = read(spark, folder, "supplier"), read(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    own = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.struct("s_nationkey", "n_regionkey").alias("at"))  # 25 nations
    there = own.select(F.explode(F.array(*(F.col("s_suppkey") - k for k in after))).alias("s_suppkey"), F.col("s_name").alias("word2"), F.col("at").alias("_at"))
    score = F.when(F.col("at.s_nationkey") == F.col("_at.s_nationkey"), 10.0).when(F.col("at.n_regionkey") == F.col("_at.n_regionkey"), 6.0).otherwise((F.col("s_suppkey") * 7 % 5).cast("double"))
    return own.join(there, "s_suppkey").select(F.col("s_name").alias("word1"), "word2", score.alias("human_score"))


def supplier_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that have a supplier's number, as the suppliers' own; their region's number is their domain."""
    n = read(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("domain"))
    s = read(spark, folder, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").cast("long").alias("vec_id"), F.col("s_name").alias("term"), "domain")  # 25 nations
    return s.join(read(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id").drop("vec_id")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("event_id", "ts", F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("value").alias("progress"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dataset"), F.col("value").alias("spearman"), "ts")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """`method, dataset, spearman`: order statuses by priorities."""
    o = read(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("dataset")).agg((F.avg("o_totalprice") / 500000).alias("spearman"))
