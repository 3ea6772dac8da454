"""Tables with other column names, small text rules, storage checks, malformed questions."""

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions.text import excerpt, plain_number
from ledgerlens.operators import answers as A, reports as R, search as S
from ledgerlens.sources import schemas, storage
from tests import fixtures as X


def test_tables_under_other_names(spark):
    tagged = spark.createDataFrame(
        [("m1", ["Phone Number"], "High", "call me")],
        "id string, entities array<string>, risk_level string, text string")
    hit = S.search_messages(tagged, "which phone numbers?").first()
    assert (hit["message_id"], hit["risk_flag"], hit["original_text"]) == ("m1", "High", "call me")
    keys = S.message_keys(X.questions(spark, "call me"))
    assert [r["message_id"] for r in S.match_messages(tagged, keys).collect()] == ["m1"]
    moved = spark.createDataFrame(
        [("T1", 5.0, 9.0, ["Crypto"], "x")],
        "tx_id string, amount double, risk double, typology array<string>, narrative string")
    hit = S.search_transactions(moved, "crypto").first()
    assert (hit["transaction_id"], hit["amount_sgd"], hit["risk_score"]) == ("T1", 5.0, 9.0)


def test_assigned_to_is_the_last_owner(spark):
    rows = [("1", "A", "U", "Z"), ("2", "", "U", "Z"), ("3", None, " ", "Z"), ("4", None, None, "")]
    hits = spark.createDataFrame(
        rows, "p string, owner string, business_unit string, assigned_to string")
    owners = hits.select("p", R.owner_or_units(hits, "none").alias("o")).orderBy("p").collect()
    assert [r["o"] for r in owners] == ["A", "U", "Z", "none"]


def test_excerpt_is_trimmed_at_any_blank(spark):
    text = spark.createDataFrame([("x" * 5 + "\t" + "y" * 20,), ("x" * 4 + "\r\x0b" + "y" * 20,)],
                                 "t string")
    assert [r[0] for r in text.select(excerpt(F.col("t"), 9)).collect()] == ["xxxxx...", "xxxx..."]


@pytest.mark.parametrize("value, text", [(3.0, "3"), (0.75, "0.75"), (12, "12"), (1234.5, "1234.5")])
def test_snapshot_numbers(spark, value, text):
    df = spark.createDataFrame([(float(value),)], "v double")
    assert df.select(plain_number(F.col("v"))).first()[0] == text


def test_snapshot_keeps_fractions(spark):
    metrics = spark.createDataFrame([("reg_share", "", 0.75), ("reg_total", "", 4.0)],
                                    "metric string, label string, value double")
    lines = [r["line"] for r in R.snapshot_report(metrics).collect()]
    assert "- Share: 0.75" in lines and "- Total: 4" in lines


def test_files_with_other_headers_raise(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    (folder / "a.csv").write_text("message_id,channel,text\nM1,C1,hi\n")
    (folder / "b.csv").write_text("channel,message_id,text\nC2,M2,bye\n")
    for multi_line in (True, False):
        with pytest.raises(Exception):
            storage.read_csv(spark, str(folder), schemas.RAW_MESSAGES, multi_line=multi_line).collect()
    (folder / "b.csv").write_text("message_id,channel,text\nM2,C2,bye\n")
    for multi_line in (True, False):
        got = storage.read_csv(spark, str(folder), schemas.RAW_MESSAGES, multi_line=multi_line)
        assert {r["message_id"]: r["text"] for r in got.collect()} == {"M1": "hi", "M2": "bye"}


def test_half_written_vectors_are_built_again(spark, tmp_path):
    path = str(tmp_path / "vectors")
    (tmp_path / "vectors" / "_temporary").mkdir(parents=True)
    vectors = spark.createDataFrame([("a", [1.0])], schemas.VECTORS)
    assert storage.ensure_vectors(spark, path, lambda: vectors).count() == 1
    assert storage.is_written(spark, path)
    assert storage.ensure_vectors(spark, path, lambda: vectors.limit(0)).count() == 1


BAD = ("show messages???+", "messages (urgent", "*suspicious transactions")


@pytest.mark.parametrize("fillers", [0, 80])
def test_a_malformed_question_gets_its_own_answer(spark, fillers):
    corpus = X.corpus(spark)
    more = [f"messages of kind {i}" for i in range(fillers)]
    asked = X.questions(spark, *BAD, "messages", *more)
    results = A.search_all(asked, corpus, K.MODE_RAW)
    lines = {}
    for r in A.answer_lines(results).collect():
        lines.setdefault(r["question_id"], []).append(r["line"])
    assert all(lines[f"q{i}"] == [K.MALFORMED_TEXT] for i in (1, 2, 3))
    assert len(lines) == 4 + fillers
    trace = {r["question_id"]: r for r in A.answer_trace(results).collect()}
    assert len(trace) == 4 + fillers and trace["q2"]["no_results"]
    counts = {r["question_id"]: r["hit_count"] for r in A.search_counts(results).collect()}
    assert len(counts) == 4 + fillers and counts["q1"] == 0


def test_the_raw_limit_is_passed_on(spark):
    corpus = X.corpus(spark)
    found = A.search_all(X.questions(spark, "messages|a"), corpus, K.MODE_RAW, raw_limit=1)
    assert found.found[K.PII_SEARCH].hits.count() <= 1
