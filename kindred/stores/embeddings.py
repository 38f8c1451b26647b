"""Text encoders by name, and a store of what they have encoded.

A vector is stored under a digest of the encoder's name and the text, in a folder of that encoder. Encoding asks the store
first, by an anti-join, and only texts that it lacks reach the encoder, each distinct text once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.stores import files
from kindred.stores.lineage import kept

#: Makes an encoder in a worker, where it is used; the encoder gets a list of texts and returns a vector for each.
Factory = Callable[[], Callable[[list[str]], list[list[float]]]]
STORE_SCHEMA = "digest string, term string, embedding array<float>"


def digest(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0"), text), 256)


class Encoders:
    """Encoders by name, one of them current. `switch` goes to another one if it can be made; `restore` goes back."""

    def __init__(self, default: str, fallback: str | None = None):
        self.default, self.fallback, self.current = default, fallback, default
        self.factories: dict[str, Factory] = {}

    def register(self, name: str, factory: Factory) -> None:
        self.factories[name] = factory

    def works(self, name: str) -> bool:
        try:
            self.factories[name]()
        except Exception:  # a model that cannot be made, for whatever reason, is one that does not work
            return False
        return True

    def ready(self) -> str:
        """The current encoder's name, the fallback's if the current one cannot be made; if neither can, an error."""
        for name in dict.fromkeys(filter(None, (self.current, self.fallback))):
            if self.works(name):
                self.current = name
                return name
        raise RuntimeError("neither the encoder nor its fallback can be made")

    def switch(self, name: str) -> bool:
        """Make another encoder current; if it cannot be made the current one stays, and the answer is no."""
        if not self.works(name):
            return False
        self.current = name
        return True

    def restore(self) -> bool:
        return self.switch(self.default)

    def encode(self, texts: DataFrame, column: str = "term") -> DataFrame:
        """`texts` with `embedding`, in Arrow batches; the encoder is made once for each task."""
        factory = self.factories[self.ready()]

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = factory()
            for batch in batches:
                yield pd.Series([[float(x) for x in v] for v in encoder(batch.tolist())])

        return texts.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(column)))  # type: ignore[call-overload]


def store_path(folder: str, model: str) -> str:
    return f"{folder}/model={''.join(c if c.isalnum() or c in '.-' else '-' for c in model)}"


def stored(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """`digest, term, embedding` of an encoder's stored vectors, as they are now: each run has a folder of its own, and the
    frame reads those that are there. Texts that two runs encoded at once are given once."""
    path = store_path(folder, model)
    runs = [f"{path}/{n}" for n in files.names(spark, path) if files.exists(spark, f"{path}/{n}/_SUCCESS")]
    if not runs:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(*runs).groupBy("digest").agg(F.min_by(F.struct("term", "embedding"), F.col("embedding")).alias("_r")).select("digest", "_r.*")


def embedded(texts: DataFrame, encoders: Encoders, folder: str, column: str = "term") -> tuple[DataFrame, int]:
    """The rows of `texts` with `embedding` from the current encoder, and how many texts it had to encode. A null text has
    a null embedding."""
    spark, model = texts.sparkSession, encoders.ready()
    own = texts.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("digest", digest(model, F.col(column)))
    new = kept(own.join(stored(spark, folder, model).select("digest"), "digest", "left_anti"))
    count = new.count()
    if count:
        fresh = encoders.encode(new, column).select("digest", F.col(column).alias("term"), "embedding")
        fresh.write.parquet(f"{store_path(folder, model)}/run-{uuid.uuid4().hex}")
    known = stored(spark, folder, model).select("digest", "embedding")
    return texts.withColumn("digest", digest(model, F.col(column))).join(known, "digest", "left").drop("digest"), count


def clear(spark: SparkSession, folder: str, model: str | None = None) -> None:
    """Remove what is stored of an encoder, or of all."""
    files.remove(spark, folder if model is None else store_path(folder, model))
