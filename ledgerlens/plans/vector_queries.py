"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators import vector_cells, vectors as V
from ledgerlens.plans import sql_views as Q
from ledgerlens.plans.registry import query
from ledgerlens.sources import views
from ledgerlens.sources.storage import materialise


@query("""SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dimensions,
    CAST(max(len(embedding)) AS INTEGER) AS max_dimensions
FROM embeddings WHERE embedding IS NOT NULL""")
def vec_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = V.vector_table(views.vectors(spark, sf_dir), "id", "vector")
    return V.vector_stats(table)


def _nearest_to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typical vector of each label is the question; every vector can be an answer."""
    vectors = views.vectors(spark, sf_dir)
    return V.nearest_neighbours(vectors, V.centroids(vectors, "label"))


_TOPK = Q.views("centroids", "distances") + """,
best AS (SELECT query_id, id, label, round(distance, 4) AS distance,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
    FROM distances QUALIFY rank <= 3)"""


@query(_TOPK + "SELECT query_id, id, distance, rank FROM best")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_to_centroids(spark, sf_dir).withColumn("distance", F.round("distance", 4))


@query(_TOPK + "SELECT query_id, id, distance, rank, label FROM best")
def vec_topk_with_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _nearest_to_centroids(spark, sf_dir).withColumn("distance", F.round("distance", 4))
    records = views.vectors(spark, sf_dir).select("id", "label")
    return V.neighbours_with_record(near, records, "id")


# Sparse word features of each distinct narrative, as ``text, bucket, x`` in single precision.
_FEATURES = Q.views("txn") + f""",
texts AS (SELECT narrative AS text, count(*) AS times FROM txn GROUP BY narrative),
words AS (SELECT text, times, unnest(regexp_extract_all(lower(text), '{V.WORD}')) AS word FROM texts),
counts AS (SELECT text, times, ('0x' || substr(md5(word), 1, 8))::BIGINT % {V.TEXT_DIMENSIONS}
    AS bucket, count(*) AS n FROM words GROUP BY ALL),
seen AS (SELECT bucket, ln(((SELECT count(*) FROM txn) + 1) / (sum(times) + 1)) AS weight
    FROM counts GROUP BY bucket),
weighted AS (SELECT text, bucket, n * weight AS w FROM counts JOIN seen USING (bucket)),
features AS (SELECT text, bucket, CAST(w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS FLOAT)
    AS x FROM weighted)"""


@query(_FEATURES + """,
spelled AS (SELECT text, string_agg(printf('%d:%.4f', bucket, x::DOUBLE), ' ' ORDER BY bucket)
    AS vector FROM features WHERE x <> 0 GROUP BY text)
SELECT transaction_id AS id, vector FROM txn JOIN spelled ON narrative = text""")
def vec_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed word features of every narrative, spelled as ``place:value``."""
    texts = V.vector_text(views.tagged_transactions(spark, sf_dir))
    vectors = V.embed_distinct(texts, V.fit_text_model(texts))
    entries = F.filter(F.transform("vector", lambda x, i: F.when(x != 0, F.format_string(
        "%d:%.4f", i, x.cast("double")))), lambda e: e.isNotNull())
    # Written, so that few are broadcast and a text that very many rows have can be split.
    spelled = materialise(vectors.select("text", F.array_join(entries, " ").alias("vector")),
                          "spelled-vectors")
    return texts.join(spelled, "text").select("id", "vector")


def _narratives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts of all narratives and of the report requests.

    The requests are those of ``views.questions``: the narrative of every error event.
    """
    tagged = views.tagged_transactions(spark, sf_dir)
    asked = tagged.where(F.get("aml_tags", F.lit(0)) == "error")
    return V.vector_text(tagged), V.vector_text(asked)


@query(_FEATURES + """,
asked AS (SELECT DISTINCT narrative FROM txn WHERE narrative LIKE 'error %'),
sides AS (SELECT a.text AS one, b.text AS other, a.bucket, a.x AS p, 0.0 AS q FROM features a
        JOIN asked ON narrative = a.text, texts b
    UNION ALL SELECT narrative, b.text, b.bucket, 0.0, b.x FROM asked, features b),
gaps AS (SELECT one, other, bucket, sum(p::DOUBLE) - sum(q::DOUBLE) AS gap FROM sides GROUP BY ALL),
distances AS (SELECT one, other, round(sum(gap * gap), 10) AS distance FROM gaps GROUP BY ALL),
best AS (SELECT one, transaction_id AS id, distance, row_number() OVER (PARTITION BY one
    ORDER BY distance, transaction_id) AS rank FROM distances JOIN txn ON narrative = other
    QUALIFY rank <= 3)
SELECT t.transaction_id AS query_id, id, round(distance, 4) AS distance,
    CAST(rank AS INTEGER) AS rank FROM txn t JOIN best ON t.narrative = one""")
def vec_question_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three narratives closest to each report request, by text features."""
    texts, requests = _narratives(spark, sf_dir)
    near = V.nearest_texts(texts, requests, V.fit_text_model(texts))
    return near.withColumn("distance", F.round("distance", 4))


@query(_TOPK + "SELECT query_id, id, distance, rank FROM best")
def vec_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search through cells, for the same questions as ``vec_topk``."""
    vectors = views.vectors(spark, sf_dir).select("id", "vector")
    index = vector_cells.build(vectors, cell_rows=250)
    found = vector_cells.search(index, V.centroids(views.vectors(spark, sf_dir), "label"), 3)
    return found.withColumn("distance", F.round("distance", 4))


@query()
def vec_topk_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 100, from eight cells each."""
    vectors = views.vectors(spark, sf_dir).select("id", "vector")
    index = vector_cells.build(vectors, cell_rows=250)
    return vector_cells.search(index, vectors.where("id % 100 = 0"), 3, probes=8)
