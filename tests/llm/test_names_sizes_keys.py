"""Clashing names, ids of other types, sizes near a limit, keys with nearly all rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    decontaminate as D, digests as G, filter_audit as A, line_quality as Q, mixing as M,
    ngram_join as N, personal_data as P, piece_coding as C, quote_threads as T,
    secret_ledger as S, sharding as H, spelling as W, token_counts as K)
from ledgerlens.sources.storage import materialise
from tests.llm.tables import collect, documents, words

CLASHING = (
    "__key", "__copies", "__row", "__index", "__take", "__score", "__hit", "__n_hit", "__items",
    "__dirty", "found_hit", "found_items", "found_contaminated", "_score", "__first", "__bucket",
    "digest", "failed", "ids", "decoded", "word", "n", "blob_id", "spans", "base", "extra")


def rows():
    return [(i, " ".join(words(i // 3, 40 + i % 7)), f"s{i % 3}") for i in range(30)]


def clashing(spark):
    return documents(spark, rows()).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def own_values(got):
    return all(r[name] == f"own {name}" for r in got for name in CLASHING if name in r)


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, " ".join(words(0, 40)[:20]))], "item_id long, text string")
    model = Q.fit(documents(spark, rows()), labels)
    return {
        "good": lambda d: Q.good_documents(d, model, 0.0),
        "first": N.first_of_each_class,
        "clean": lambda d: D.clean_documents(d, benchmark),
        "hits": lambda d: D.benchmark_hits(d, benchmark),
        "mixed": M.mixed_rows,
        "sharded": H.sharded_documents,
        "scored": lambda d: Q.scored(d, model),
    }


@pytest.mark.parametrize("name", ["good", "first", "clean", "hits", "mixed", "sharded", "scored"])
def test_own_columns_survive(spark, name):
    operator = operators(spark)[name]
    docs = clashing(spark)
    got = collect(operator(docs))
    assert got and own_values(got) and set(CLASHING) <= set(got[0])
    plain = collect(operator(documents(spark, rows())))
    assert sorted(r["doc_id"] for r in got if name != "mixed") == sorted(
        r["doc_id"] for r in plain if name != "mixed")


def test_operators_with_results_of_their_own_ignore_other_columns(spark):
    docs, plain = clashing(spark), documents(spark, rows())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for operator in (M.mixed_sizes, H.shard_rows, G.edit_fingerprints, P.personal_data,
                     K.token_counts, N.similar_documents, W.word_counts,
                     lambda d: A.filter_audit(d, labels),
                     lambda d: S.secrets_by_path(d, S.new_ledger(spark)),
                     lambda d: C.encoded(d.drop("ids")).select("doc_id", "ids")):
        assert sorted(map(str, collect(operator(docs)))) == sorted(map(str, collect(operator(plain))))


def test_ids_may_be_texts(spark):
    texts = [(f"d{i:02}", t, s) for i, t, s in rows()] + [(None, "no id", None)]
    docs = spark.createDataFrame(texts, "doc_id string, text string, source string")
    labels = spark.createDataFrame([("d01", 1, 0)], "doc_id string, quality int, toxic int")
    for operator in (M.mixed_sizes, H.shard_rows, G.edit_fingerprints, P.personal_data,
                     K.token_counts, N.similar_documents, N.first_of_each_class, M.mixed_rows,
                     lambda d: S.secrets_by_path(d, S.new_ledger(spark)), C.encoded):
        got = collect(operator(docs))
        assert {r["doc_id"] for r in got} <= {i for i, _, _ in texts} and got
    assert collect(A.filter_audit(docs, labels)) and collect(W.word_counts(docs)) is not None
    prints = {r["doc_id"]: r for r in collect(G.edit_fingerprints(docs))}
    numbers = {i: r for r in collect(G.edit_fingerprints(spark.createDataFrame(
        [(None if i is None else int(i[1:]), t, s) for i, t, s in texts],
        "doc_id long, text string, source string")))
        for i in [None if r["doc_id"] is None else f"d{r['doc_id']:02}"]}
    assert all({**numbers[i], "doc_id": i} == r for i, r in prints.items())


@pytest.mark.parametrize("one, other", [(98, 94), (97, 95), (120, 112), (94, 88), (260, 250),
                                        (256, 255), (64, 62), (255, 80), (70, 62)])
def test_near_copies_on_both_sides_of_a_size(one, other):
    text = " ".join(words(3, 100)).encode()
    a, b = G.digests([text[:one], text[:other]], G.rarity({}))
    assert G.likeness(a, b) > 0.8 and G.likeness(b, a) == G.likeness(a, b)


def test_other_texts_of_all_sizes_are_unlike():
    sizes = [1, 8, 40, 63, 95, 96, 255, 256, 400, 5000]
    texts = [(" ".join(words(100 + n, 2000, 10**9)) * 2).encode()[:n] for n in sizes]
    marks = G.digests(texts, G.rarity({}))
    for i, a in enumerate(marks):
        assert len(a) and G.likeness(a, a) == 1
        for n, b in zip(sizes[i + 1:], marks[i + 1:]):
            assert G.likeness(a, b) < 0.35


def test_a_benchmark_of_many_portions(spark, monkeypatch):
    docs = documents(spark, rows())
    items = [(i, " ".join(words(i, 40)[i % 20:i % 20 + 15])) for i in range(9)] + [(90, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["n_hit"], r["items"]) for r in collect(df))
    whole = key(D.benchmark_hits(docs, benchmark))
    assert any(n for _, n, _ in whole)
    monkeypatch.setattr(D, "PORTIONS_AT_ONCE", 2)
    assert key(D.benchmark_hits(docs, benchmark, portion_bytes=200)) == whole


SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture()
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def was_split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_paths_of_one_content_are_split(spark, splitting):
    docs = materialise(spark.range(40_000).repartition(8).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 100 < 95, "password=abcdefg").otherwise(
            F.concat(F.lit("secret=abcdefg"), F.col("id") % 300)).alias("text")), "docs")
    found = S.secrets_by_path(docs, S.new_ledger(spark))
    assert was_split(found) and found.where("size(spans) = 1").count() == 40_000


def test_a_hot_class_is_split(spark, splitting):
    each = materialise(spark.range(40_000).repartition(8).select(
        F.col("id").alias("doc_id"), F.col("id").alias("node"), F.lit(3).alias("n_shingles")), "each")
    labels = materialise(each.select("node", F.when(F.col("node") % 100 < 95, 0).otherwise(
        F.col("node") % 300).cast("long").alias("label")), "labels")
    tops = N._classes(each, labels, F.col("doc_id"))
    assert was_split(tops) and tops.count() == 40_000


def test_a_star_of_links_is_split(spark, splitting):
    """All links of one node; the joins of the steps write tables, so their plans are read."""
    plans = []
    keep, N.materialise = N.materialise, lambda df, name: (plans.append(df), materialise(df, name))[1]
    try:
        edges = materialise(spark.range(1, 20_000).repartition(8)
                            .select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), "star")
        assert N.components(edges).where("label = 0").count() == 19_999
    finally:
        N.materialise = keep
    assert any(was_split(df) for df in plans[1:3])


def test_quotes_of_one_line_are_split(spark, splitting):
    mail = materialise(spark.range(20_000).repartition(8).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "hello you")
        .otherwise(F.concat(F.lit("> hello you\nown "), F.col("id"))).alias("text")), "mail")
    plans = []
    keep, T.materialise = T.materialise, lambda df, name: (plans.append(df), materialise(df, name))[1]
    try:
        linked = T.link_quotes(mail)
        assert was_split(linked)
        assert linked.where("parent = 0").count() == 19_999
    finally:
        T.materialise = keep
