import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import vector_cells as C, vectors as V
from ledgerlens.operators.tagging import tag_transactions
from ledgerlens.plans import vector_queries
from ledgerlens.sources import views
from tests import fixtures as X


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 6))
                  for r in df.collect())


def brute(rows, queries, k):
    out = []
    for q, target in queries:
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(v, target)), i) for i, v in rows)[:k]
        out += [(q, n, i, round(d, 6)) for n, (d, i) in enumerate(ranked, start=1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "cell_rows": 20, "block_bytes": 300}, {"broadcast_bytes": 0}])
def test_neighbours_match_brute_force(spark, options):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(150)]
    queries = [(1000 + i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(40)]
    got = V.nearest_neighbours(vectors(spark, rows).repartition(5), vectors(spark, queries),
                               **options)
    assert found(got) == brute(rows, queries, 3)


def test_ties_go_to_the_smaller_id_and_few_rows_are_all_returned(spark):
    rows = [(9, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [1.0, 0.0])]
    query = vectors(spark, [(0, [0.0, 0.0])])
    assert [r[2] for r in found(V.nearest_neighbours(vectors(spark, rows), query, 2))] == [4, 7]
    assert V.nearest_neighbours(vectors(spark, rows), query, 5).count() == 3


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_empty_index_or_no_query_gives_nothing(spark, options):
    some, none = vectors(spark, [(1, [1.0])]), vectors(spark, [])
    assert V.nearest_neighbours(none, some, **options).count() == 0
    assert V.nearest_neighbours(some, none, **options).count() == 0


def test_vector_table_and_stats(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0])],
                               "k string, e array<float>")
    table = V.vector_table(df, "k", "e")
    assert V.vector_stats(table).first().asDict() == {
        "vectors": 2, "min_dimensions": 1, "max_dimensions": 2}
    assert X.column(V.vector_table(df, "k", "e", 2), "id") == ["a"]


def test_centroids(spark):
    df = spark.createDataFrame([("x", [1.0, 3.0]), ("x", [3.0, 5.0]), ("y", [0.0, 1.0])],
                               "g string, vector array<float>")
    assert {r["id"]: r["vector"] for r in V.centroids(df, "g").collect()} == {
        "x": [2.0, 4.0], "y": [0.0, 1.0]}


def test_vector_text_prefers_masked_and_drops_blanks(spark):
    df = spark.createDataFrame([("1", "m", "o"), ("2", " \x00 ", "o"), ("3", None, "o")],
                               "transaction_id string, masked_narrative string, "
                               "original_narrative string")
    assert [tuple(r) for r in V.vector_text(df).collect()] == [("1", "m")]
    assert X.column(V.vector_text(df.drop("masked_narrative")), "text") == ["o", "o", "o"]


def test_text_features_find_the_same_narrative(spark):
    texts = V.vector_text(tag_transactions(X.transactions(spark)))
    model = V.fit_text_model(texts, 256)
    table = V.embed_texts(texts, model)
    assert table.count() == texts.count()
    near = V.nearest_neighbours(table, table, 1)
    rows = {r["query_id"]: r for r in near.collect()}
    assert rows["T003"]["id"] == "T003" and rows["T003"]["distance"] < 1e-9
    assert rows["T005"]["id"] == "T001"
    nothing = spark.createDataFrame([("x", "...")], "id string, text string")
    assert V.embed_texts(nothing, model).count() == 0


def test_record_behind_the_neighbour(spark):
    near = V.nearest_neighbours(vectors(spark, [(1, [0.0]), (2, [5.0])]),
                                vectors(spark, [(0, [4.0])]), 1)
    records = spark.createDataFrame([(1, "one"), (2, "two")], "n long, name string")
    assert V.neighbours_with_record(near, records, "n").first()["name"] == "two"


def test_only_the_best_of_each_task_are_shuffled(spark):
    near = V.nearest_neighbours(vectors(spark, [(1, [0.0])]), vectors(spark, [(0, [4.0])]))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Nested" not in plan and "Cartesian" not in plan


def test_every_report_request_is_asked(spark):
    sf_dir = "/root/testdata/sf0.001"
    events = views.table(spark, sf_dir, "events").where("event_type = 'error'")
    asked = {f"T{r['event_id']}" for r in events.select("event_id").collect()}
    rows = vector_queries.vec_question_neighbours(spark, sf_dir).collect()
    assert {r["query_id"] for r in rows} == asked
    assert len(rows) == 3 * len(asked)


def clustered(seed, n, dims=8, clusters=12):
    rng = random.Random(seed)
    centres = [[rng.uniform(-20, 20) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, 1) for x in centres[i % clusters]]) for i in range(n)]


def test_cells_are_exact_and_most_are_skipped(spark):
    rows = [(i, [round(x, 3) for x in v]) for i, v in clustered(4, 1200)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    queries = [(10_000 + i, v) for i, v in rows[::40]]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame(queries, "id long, vector array<double>")
    index = C.build(table, cell_rows=40, block_bytes=2_000)
    assert len(index.known) >= 20 and index.known["rows"].sum() == len(rows)
    assert found(C.search(index, asked, 3)) == brute(rows, queries, 3)
    reach = C.search(index, asked, 3).where("rank = 3").select("query_id", "distance")
    first = C.first_cells(asked, index, 3).count()
    more = C.further_cells(asked.join(reach.withColumnsRenamed(
        {"query_id": "id", "distance": "reach"}), "id"), index, 3).count()
    assert (first + more) / (len(queries) * len(index.known)) < 0.25


def test_cells_of_scattered_and_equal_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)] \
        + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(100)]
    queries = [(5000 + i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(25)] \
        + [(6000, [0.5, 0.5, 0.5])]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = spark.createDataFrame(queries, "id long, vector array<double>")
    for options in ({"cell_rows": 10}, {"cell_rows": 10, "block_bytes": 100}, {"most_cells": 1},
                    {"cell_rows": 5, "sample_bytes": 24 * 50}):
        assert found(C.search(C.build(table, **options), asked, 4)) == brute(rows, queries, 4)


def test_recall_of_probes(spark):
    rows = clustered(7, 1500, dims=16, clusters=40)
    queries = [(10_000 + i, v) for i, v in rows[::10]]
    index = C.build(spark.createDataFrame(rows, "id long, vector array<double>"), cell_rows=30)
    got = C.search(index, spark.createDataFrame(queries, "id long, vector array<double>"), 5,
                   probes=6)
    want = {(q, i) for q, _, i, _ in brute(rows, queries, 5)}
    assert len(want & {(r["query_id"], r["id"]) for r in got.collect()}) / len(want) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_registered_probes(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    vectors = views.vectors(spark, sf_dir).select("id", "vector")
    exact = V.nearest_neighbours(vectors, vectors.where("id % 100 = 0"), 3).collect()
    got = vector_queries.vec_topk_probes(spark, sf_dir).collect()
    want = {(r["query_id"], r["id"]) for r in exact}
    assert len(want & {(r["query_id"], r["id"]) for r in got}) / len(want) >= 0.9


def test_text_model_is_stored(spark, tmp_path):
    texts = V.vector_text(tag_transactions(X.transactions(spark)))
    model = V.fit_text_model(texts, 64)
    model.write(spark, str(tmp_path / "model"))
    assert V.TextModel.read(spark, str(tmp_path / "model")) == model


def test_embedding_by_hand(spark):
    import hashlib
    import math
    texts = spark.createDataFrame([("1", "Red fox, red"), ("2", "fox é9"), ("3", "...")],
                                  "id string, text string")
    model = V.fit_text_model(texts, 16)
    bucket = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in ("red", "fox", "é9")}
    sets = [{bucket["red"], bucket["fox"]}, {bucket["fox"], bucket["é9"]}, set()]
    weights = [math.log(4 / (sum(b in s for s in sets) + 1)) for b in range(16)]
    assert model.weights == tuple(weights)
    plain = [0.0] * 16
    for w in ("red", "fox", "red"):
        plain[bucket[w]] += weights[bucket[w]]
    norm = math.sqrt(sum(x * x for x in plain))
    got = {r["id"]: r["vector"] for r in V.embed_texts(texts, model).collect()}
    assert set(got) == {"1", "2"} and all(len(v) == 16 for v in got.values())
    assert max(abs(a - b / norm) for a, b in zip(got["1"], plain)) < 1e-6


def events(spark, folder, narratives):
    """A folder with an events table of these narratives, ``event_type props``."""
    rows = [(i, 20.0, *n.split(" ", 1)) for i, n in enumerate(narratives)]
    spark.createDataFrame(rows, "event_id long, value double, event_type string, props string") \
        .withColumn("ts", F.lit("2024-01-01").cast("timestamp")) \
        .write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_equal_texts_are_embedded_and_searched_once(spark, tmp_path, monkeypatch):
    words = ["red fox", "red cat", "blue fox", "green owl", "red red fox"]
    texts = [("error " if i % 3 == 0 else "view ") + words[i % 5] for i in range(90)]
    sf_dir = events(spark, tmp_path, texts)
    embedded, searched = [], []
    embed, nearest = V.embed_texts, V.nearest_neighbours
    monkeypatch.setattr(V, "embed_texts", lambda t, m: embedded.append(t.count()) or embed(t, m))
    monkeypatch.setattr(V, "nearest_neighbours", lambda v, q, *a, **o: searched.append(
        (v.count(), q.count())) or nearest(v, q, *a, **o))
    got = vector_queries.vec_question_neighbours(spark, sf_dir).collect()
    assert max(embedded) == 10 and searched == [(10, 5)]
    embedded.clear()
    features = vector_queries.vec_text_features(spark, sf_dir).collect()
    assert embedded == [10]

    vector = {r["id"]: [tuple(e.split(":")) for e in r["vector"].split()] for r in features}
    assert len(vector) == 90

    def gap(a, b):
        a, b = (dict((int(p), float(x)) for p, x in vector[i]) for i in (a, b))
        return sum((a.get(p, 0) - b.get(p, 0)) ** 2 for p in {*a, *b})

    found_rows = {(r["query_id"], r["rank"]): r for r in got}
    asked = [f"T{i}" for i, t in enumerate(texts) if t.startswith("error")]
    assert len(got) == 3 * len(asked) == len(found_rows)
    for q in asked:
        best = sorted((round(gap(q, i), 3), i) for i in vector)[:3]
        assert [(found_rows[q, n]["id"]) for n in (1, 2, 3)] == [i for _, i in best]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "cell_rows": 2}])
def test_nearest_texts_match_the_search_of_all_rows(spark, options):
    rng = random.Random(5)
    rows = [(rng.randrange(400), " ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 3))))
            for _ in range(120)]  # some ids stand for several texts
    texts = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1000 + i, t) for i, (_, t) in enumerate(rows[:30])]
                                  + [(2000, "..."), (2001, "e")], "id long, text string")
    model = V.fit_text_model(texts, 32)
    plain = V.nearest_neighbours(V.embed_texts(texts, model), V.embed_texts(asked, model), 4)
    assert found(V.nearest_texts(texts, asked, model, 4, **options)) == found(plain)
