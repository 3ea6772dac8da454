"""The n-gram join, quotations and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import ngram_join as N
from ledgerlens.llm import quote_threads as T
from ledgerlens.llm.queries import QUERIES, SQL
from tests.compare import connect, difference
from tests.llm.tables import awkward, collect, documents, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i:i + 4]) for i in range(len(w) - 3)])


def slow_components(rows, percent=85):
    sets = [shingles(t) for _, t, _ in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(str((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc))
                  for i, (doc, _, _) in enumerate(rows))


def near_copies():
    """Chains of edits, a common passage, exact copies and unrelated texts."""
    rows, passage = [], words(50, 30)
    for group in range(6):
        text = words(100 + group, 60 + 40 * group)
        for k in range(25):
            copy = list(text)
            for e in range(k % 6):
                copy[(k * 13 + e * 29) % len(copy)] = f"e{group}{k}{e}"
            rows.append((len(rows) + 1, " ".join(copy), "s"))
            if k % 8 == 7:
                text = copy
    for k in range(60):
        rows.append((len(rows) + 1, " ".join(passage + words(300 + k, 3 + k % 20)), "s"))
    rows += [(len(rows) + 1 + k, " ".join(words(900, 50)), "s") for k in range(30)]
    rows += [(1000 + k, f"tiny {k % 3}", "s") for k in range(9)]
    return rows


@pytest.mark.parametrize("leaders,frequent,part_bits", [
    (N.LEADERS, N.FREQUENT, N.PART_BITS), (0, 1 << 30, N.PART_BITS), (2, 4, 2)])
def test_components_like_brute_force(spark, monkeypatch, leaders, frequent, part_bits):
    monkeypatch.setattr(N, "LEADERS", leaders)
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "PART_BITS", part_bits)
    monkeypatch.setattr(N, "SLOT_BYTES", 20_000)
    rows = near_copies() + [(2000 + i if d is not None else None, t, s)
                            for i, (d, t, s) in enumerate(awkward())]
    got = collect(N.similar_documents(documents(spark, rows)))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) \
        == slow_components(rows)


def test_index_entries_are_dealt_evenly():
    rng = np.random.default_rng(5)
    node = rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64)
    small = rng.integers(0, 1 << 60, 1 << 16).astype(np.uint64)  # as first shingles are
    key = N.list_key(small, node, np.zeros(1 << 16, np.uint8), 16)
    assert np.bincount(key, minlength=16).min() > (1 << 16) / 16 / 2
    assert len(np.bincount(key)) == 16
    hot = N.list_key(np.full(1 << 16, small[0]), node, np.full(1 << 16, 16, np.uint8), 16)
    parts, sizes = np.unique(hot, return_counts=True)
    assert len(parts) == 16 and (parts >= 16).all() and sizes.max() < (1 << 16) / 8
    assert len(set((hot % 16).tolist())) == 1
    again = N.list_key(np.full(1 << 16, small[0]), node, np.full(1 << 16, 16, np.uint8), 16)
    assert (again == hot).all()


def test_blocks_hold_every_possible_pair_once_and_skip_others(spark):
    rng = random.Random(6)
    entries = []
    for i in range(400):
        n = rng.randint(1, 400)
        entries.append((i, n, rng.randrange(n - (85 * n + 99) // 100 + 1)))
    df = spark.createDataFrame(entries, "node long, n long, pos long")
    n, pos = F.col("n"), F.col("pos")

    def side(end, own, other):
        return df.withColumn(own, N.size_block(n)).withColumn(
            other, F.explode(N.partner_blocks(n, pos, end == "_a"))).select(
            "block_a", "block_b", *[F.col(c).alias(c + end) for c in ("node", "n", "pos")])

    met = collect(side("_a", "block_a", "block_b").join(
        side("_b", "block_b", "block_a"), ["block_a", "block_b"]).where("n_a <= n_b"))
    times = Counter((r["node_a"], r["node_b"]) for r in met)
    assert max(times.values()) == 1
    wanted = {(a, b) for a, n_a, p_a in entries for b, n_b, p_b in entries
              if n_a <= n_b and 100 * n_a >= 85 * n_b
              and 185 * min(n_a - p_a, n_b - p_b) >= 85 * (n_a + n_b)}
    by_size = sum(n_a <= n_b and 2 * n_a >= n_b for _, n_a, _ in entries for _, n_b, _ in entries)
    assert wanted and wanted <= set(times)
    assert len(times) < by_size / 3


def test_rows_with_equal_ids(spark):
    rows = awkward()
    got = collect(N.similar_documents(documents(spark, rows)))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) \
        == slow_components(rows)
    assert N.similar_documents(documents(spark, [])).count() == 0


def test_one_row_of_each_class_stays(spark):
    rows = near_copies() + awkward()
    docs = documents(spark, rows)
    got = collect(N.first_of_each_class(docs))
    sets = [shingles(t) for _, t, _ in rows]
    kept = [shingles(r["text"]) for r in got]
    assert sum(not s for s in kept) == sum(not s for s in sets)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert not a or not b or 100 * len(a & b) < 85 * len(a | b)
    assert {r["doc_id"] for r in collect(N.similar_documents(docs)) if r["component_id"] == r["doc_id"]
            and r["n_shingles"]} >= {r["doc_id"] for r in got if shingles(r["text"])} - {None}
    assert set(got[0]) == set(docs.columns)
    assert N.first_of_each_class(documents(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 200)]
    edges += [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["label"] for r in collect(
        N.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 1 for i in range(2, 61)}, **{100 + i: 100 for i in range(1, 200)}, 301: 300}


def test_marks_never_overstate_the_difference():
    import numpy as np
    texts = [" ".join(words(k, 20 + k)).encode() for k in range(40)]
    owner, h, sizes, _ = N.shingle_sets(texts)
    marks = N._marks(owner, h, len(texts))
    sets = [set(h[owner == i].tolist()) for i in range(len(texts))]
    for i in range(40):
        for j in range(i):
            bits = int(np.bitwise_count((marks[i] ^ marks[j]).view(np.uint64)).sum())
            assert bits <= len(sets[i] ^ sets[j])


# Quotations

def mail(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, text string, size long, place long") \
        if rows and len(rows[0]) == 5 else spark.createDataFrame(
            [(*r, 1, 2) for r in rows], "conv_id long, turn long, text string, size long, place long")


def test_quotes_link_nested_and_reformatted_passages(spark):
    rows = [
        (1, 0, "First  question\nin two lines"), (1, 1, "> first question in\n>two lines\nAn answer"),
        (1, 2, ">> First question in two lines\n> An   ANSWER\n\nThanks"),
        (1, 3, "> never said\n> > an answer\nlate"), (1, 4, "no quote"), (1, 5, "> thanks\n"),
        (1, 6, "> later words\nx"), (1, 7, "later words"), (2, 0, "> an answer\nother talk"),
        (3, 0, None), (3, 1, ""), (3, 1, "same place, larger text"), (None, 0, "lost"), (4, None, "> lost"),
    ]
    got = {(r["scope"], r["place"]): r for r in collect(T.threads(mail(spark, rows)))}
    link = {k: (r["parent"], r["matched"], r["n_levels"], r["root"], r["depth"]) for k, r in got.items()}
    assert link[1, 0] == (None, None, 0, 0, 0)
    assert link[1, 1] == (0, 1, 1, 0, 1)
    assert link[1, 2] == (1, 1, 2, 0, 2)
    assert link[1, 3] == (1, 2, 2, 0, 2)
    assert link[1, 4] == (None, None, 0, 4, 0)
    assert link[1, 5] == (2, 1, 1, 0, 3)
    assert link[1, 6] == (None, None, 1, 6, 0)  # said only later
    assert link[2, 0] == (None, None, 1, 0, 0)  # said in another conversation
    assert link[None, 0][0] is None and link[4, None][0] is None
    assert got[1, 2]["reply"] == "Thanks" and got[1, 1]["reply"] == "An answer"
    assert got[3, 1]["reply"] == "" and got[3, 0]["reply"] == ""
    assert len(got) == len(rows) - 1
    assert T.threads(mail(spark, [])).count() == 0


def test_long_conversation_of_equal_first_words(spark):
    rows = [(1, k, f"answer {k}") for k in range(300)] + [(k, 0, "hello") for k in range(2, 200)]
    got = collect(T.threads(T.as_mail(mail(spark, rows))))
    depth = {r["place"]: r["depth"] for r in got if r["scope"] == 1}
    assert depth == {k: k for k in range(300)}


# Registered queries and the pipeline

@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) is None


def test_stages_in_order_and_each_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near copies", "decontamination", "mixing", "sharding"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF_DIR))
    columns = docs.columns
    assert all(df.columns == columns for df in seen[1:-1])
    ids = [[r[0] for r in df.select("doc_id").collect()] for df in seen]
    labels = {r["doc_id"]: r["quality"] for r in collect(
        spark.read.parquet(f"{SF_DIR}/labels.parquet"))}
    assert set(ids[1]) < set(ids[0])
    good, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert len(set(good) & set(ids[1])) >= 0.95 * len(good)
    assert len(set(bad) & set(ids[1])) <= 0.3 * len(bad)
    kept = collect(seen[1])
    components = {}
    for line in slow_components([(r["doc_id"], r["text"], "") for r in kept]):
        doc, n, top = eval(line)
        components[doc] = top
    assert sorted(ids[2]) == sorted(set(components.values()))
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) == len(set(ids[3]))
    assert set(ids[4]) <= set(ids[3])
    assert sorted(ids[5]) == sorted(ids[4])
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == [*columns, "shard", "slot"]
    assert sorted(r[0] for r in run.select("doc_id").collect()) == sorted(ids[5])
    counts = [r["n"] for r in collect(run.groupBy("shard").agg(F.count("*").alias("n")))]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("name", ["quality", "near copies", "decontamination", "mixing", "sharding"])
def test_stages_take_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = documents(spark, awkward())
    for docs in (rows, rows.limit(0)):
        got = stage(spark, docs, SF_DIR)
        assert got.columns[:1] == docs.columns[:1] and got.count() >= 0


def test_components_without_edges_run_no_rounds(spark, monkeypatch):
    names, write = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: names.append(name) or write(df, name))
    loops = spark.createDataFrame([(1, 1), (2, 2)], "a long, b long")
    assert N.components(loops).count() == 0 and names == ["edges"]
