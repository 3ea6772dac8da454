"""Vector table, text features and exact nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import clean_for_vectors
from ledgerlens.operators import vector_cells
from ledgerlens.operators.search import ranked_first
from ledgerlens.operators.vector_cells import task_functions
from ledgerlens.sources.storage import materialise

# Most bytes of query vectors sent to every executor; more are searched by cells.
BROADCAST_BYTES = 64 << 20
TEXT_DIMENSIONS = 512
WORD = "[\\p{L}\\p{N}]+"


def vector_text(tagged: DataFrame, record_id: str = "transaction_id") -> DataFrame:
    """``id, text`` to be embedded: masked narrative if the table has one, blanks dropped."""
    column = "masked_narrative" if "masked_narrative" in tagged.columns else "original_narrative"
    return tagged.select(F.col(record_id).alias("id"),
                         clean_for_vectors(F.col(column)).alias("text")) \
        .where(F.length("text") > 0)


def word_buckets(text: Column, dimensions: int) -> Column:
    """The feature number of each word: the first half of its MD5, by remainder."""
    def bucket(word: Column) -> Column:
        head = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")
        return F.pmod(head, F.lit(dimensions)).cast("int")

    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), bucket)


@dataclass(frozen=True)
class TextModel:
    """The weight of each word feature: the rarer among the texts, the heavier."""

    weights: tuple[float, ...]

    @property
    def dimensions(self) -> int:
        return len(self.weights)

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(list(enumerate(self.weights)), "bucket int, weight double") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextModel:
        rows = spark.read.parquet(path).collect()
        return TextModel(tuple(r["weight"] for r in sorted(rows)))


def fit_text_model(texts: DataFrame, dimensions: int = TEXT_DIMENSIONS) -> TextModel:
    """Weights from all texts; one count for each feature reaches the driver.

    The words of equal texts are read once.
    """
    buckets = F.array_distinct(word_buckets(F.col("text"), dimensions))
    # A mark that no feature has counts the texts in the same pass.
    seen = texts.groupBy("text").agg(F.count("*").alias("times")) \
        .select("times", F.explode(F.concat(buckets, F.array(F.lit(-1)))).alias("bucket")) \
        .groupBy("bucket").agg(F.sum("times").alias("texts")).collect()
    counts = {r["bucket"]: r["texts"] for r in seen}
    n = counts.get(-1, 0)
    return TextModel(tuple(math.log((n + 1) / (counts.get(b, 0) + 1)) for b in range(dimensions)))


def embed_texts(texts: DataFrame, model: TextModel) -> DataFrame:
    """``id, vector``: weighted word counts of unit length, in one projection.

    A text without words has nothing to embed and is dropped; one whose words all have no
    weight is the zero vector.
    """
    weights = F.array(*[F.lit(w) for w in model.weights])
    table = texts.select("id", word_buckets(F.col("text"), model.dimensions).alias("words")) \
        .where(F.size("words") > 0)
    entries = F.transform(F.array_sort(F.array_distinct("words")), lambda b: F.struct(
        b.alias("b"), (F.size(F.filter("words", lambda x: x == b)) * F.get(F.col("weights"), b))
        .alias("w")))
    table = table.select("id", "words", weights.alias("weights")) \
        .select("id", entries.alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    def piece(entry: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("e"), i - 1)["b"])
        value = F.when(F.col("length") > 0, entry["w"] / F.col("length")).otherwise(0.0)
        return F.concat(zeros(entry["b"] - before - 1), F.array(value.cast("float")))

    last = F.element_at("e", -1)["b"]
    return table.withColumn("length", length).select("id", F.concat(
        F.flatten(F.transform("e", piece)), zeros(F.lit(model.dimensions) - 1 - last))
        .alias("vector"))


def embed_distinct(texts: DataFrame, model: TextModel) -> DataFrame:
    """``text, vector`` of each distinct text: equal texts are embedded once."""
    each = texts.select("text").distinct().select(F.col("text").alias("id"), "text")
    return embed_texts(each, model).withColumnRenamed("id", "text")


def vector_table(df: DataFrame, record_id: str, vector: str,
                 dimensions: int | None = None) -> DataFrame:
    """``id, vector`` of the usable rows: not null and, if given, of the right size."""
    table = df.select(F.col(record_id).alias("id"), F.col(vector).alias("vector")) \
        .where("vector is not null")
    return table if dimensions is None else table.where(F.size("vector") == dimensions)


def vector_stats(vectors: DataFrame) -> DataFrame:
    size = F.size("vector")
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.min(size).alias("min_dimensions"),
        F.max(size).alias("max_dimensions"),
    )


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group as ``id, vector``."""
    sums = vectors.select(F.col(group).alias("id"), F.posexplode("vector").alias("pos", "x")) \
        .groupBy("id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per dimension: bounded by the vector size.
    return sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")) \
        .select("id", F.col("v.x").alias("vector"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K.NEIGHBOURS, *,
                       broadcast_bytes: int = BROADCAST_BYTES, **cells) -> DataFrame:
    """Exact k nearest vectors per query: ``query_id, id, distance, rank``.

    Distance is the square of the Euclidean one; ties go to the smaller id.  Query vectors
    of ``broadcast_bytes`` together at most are sent to every task, each task keeps its own
    best k per query and only those are shuffled.  More are searched through cells around
    trained centres, where most pairs of blocks are skipped unread; ``cells`` are options of
    ``vector_cells.build``.  Query ids are distinct.
    """
    k_type = vectors.schema["id"].dataType.simpleString()
    q_type = queries.schema["id"].dataType.simpleString()
    found = f"query_id {q_type}, id {k_type}, distance double"
    queries = materialise(queries.select("id", "vector"), "query-vectors")
    size = queries.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    if size <= broadcast_bytes:
        few = queries.toPandas()
        local = _neighbours_by_broadcast(vectors, few, k, found)
        best = ranked_first(local, "query_id", [F.asc("distance"), F.asc("id")], k)
        return best.select("query_id", "id", "distance", "rank")
    return vector_cells.search(vector_cells.build(vectors, **cells), queries, k, written=True)


def nearest_texts(texts: DataFrame, asked: DataFrame, model: TextModel,
                  k: int = K.NEIGHBOURS, **options) -> DataFrame:
    """``nearest_neighbours`` of the embedded texts, each distinct text searched once.

    ``texts`` and ``asked`` have ``id, text``.  A text is searched under the first id that has
    it: no row before the k-th can lie behind more than k texts ranked by distance and first
    id, so the first k rows of the k nearest texts hold the k nearest rows.  ``options`` are
    those of ``nearest_neighbours``.
    """
    first = materialise(ranked_first(texts, "text", [F.asc("id")], k, "nth"), "first-of-texts")
    # Numbers in the order of the first ids; an id may stand for several texts.
    known = materialise(first.where("nth = 1").select("id", "text").orderBy("id", "text").select(
        "text", F.monotonically_increasing_id().alias("number")), "numbered-texts")
    vectors = embed_texts(known.select(F.col("number").alias("id"), "text"), model)
    each = embed_distinct(asked, model).withColumnRenamed("text", "id")
    near = nearest_neighbours(materialise(vectors, "text-vectors"), each, k, **options) \
        .select(F.col("query_id").alias("asked"), F.col("id").alias("number"), "distance")
    order = [F.asc("distance"), F.asc("id")]
    rows = near.join(known, "number").join(first.select("text", "id"), "text") \
        .select("asked", "id", "distance")
    # k rows for each distinct text asked; written, so that the join can be split.
    answers = materialise(ranked_first(rows, "asked", order, k).drop("rank"), "text-neighbours")
    given = asked.select(F.col("id").alias("query_id"), F.col("text").alias("asked")) \
        .join(answers, "asked").select("query_id", "id", "distance")
    return ranked_first(given, "query_id", order, k).select("query_id", "id", "distance", "rank")


def _neighbours_by_broadcast(vectors: DataFrame, queries: pd.DataFrame, k: int,
                             found: str) -> DataFrame:
    matrix, _, nearest = task_functions(k)
    shared = vectors.sparkSession.sparkContext.broadcast((
        queries["id"].to_numpy(),
        matrix(queries["vector"]) if len(queries) else np.zeros((0, 0))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_matrix = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(query_ids)
        for batch in batches:
            if batch.empty:
                continue
            ids, rows = batch["id"].to_numpy(), matrix(batch["vector"])
            for number, (near, squared) in enumerate(nearest(ids, rows, query_matrix)):
                if best[number] is not None:
                    near = np.concatenate([best[number][0], near])
                    squared = np.concatenate([best[number][1], squared])
                    order = np.lexsort((near, squared))[:k]
                    near, squared = near[order], squared[order]
                best[number] = (near, squared)
        for query_id, result in zip(query_ids, best):
            if result is not None:
                yield pd.DataFrame({"query_id": query_id, "id": result[0], "distance": result[1]})

    return vectors.select("id", "vector").mapInPandas(search, found)


def neighbours_with_record(neighbours: DataFrame, records: DataFrame, record_id: str) -> DataFrame:
    """Attach the record behind each neighbour, by id."""
    return neighbours.join(records.withColumnRenamed(record_id, "id"), "id")
