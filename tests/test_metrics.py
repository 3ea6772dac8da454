import pytest

from ledgerlens.operators import metrics as M
from ledgerlens.operators.reports import snapshot_report
from tests import fixtures as X


def values(df):
    return {(r["metric"], r["label"]): r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(
        [("T1", 8.0), ("T2", 8.5), ("T3", None), ("T4", 0.0), ("T5", 10.0)],
        "transaction_id string, risk_score double")


def test_transaction_metrics_exclude_the_threshold(scored):
    assert values(M.transaction_metrics(scored)) == {
        ("aml_high_risk_count", ""): 2.0, ("avg_risk_score", ""): 26.5 / 4}
    assert M.transaction_log(scored).first().asDict() == {"records": 5, "high_risk": 3}


def test_message_metrics_ignore_case(spark):
    df = spark.createDataFrame([("critical",), ("CRITICAL",), ("High",), (None,)],
                               "risk_flag string")
    assert values(M.message_metrics(df)) == {("pii_critical_count", ""): 2.0}
    assert {r["risk_flag"]: r["n"] for r in M.value_counts(df, "risk_flag").collect()} == {
        "critical": 1, "CRITICAL": 1, "High": 1}


def test_breakdowns_keep_null_as_a_label(spark):
    got = values(M.obligation_breakdowns(X.obligations(spark)))
    assert got["reg_owner_breakdown", "(missing)"] == 1.0
    assert got["reg_owner_breakdown", ""] == 1.0
    assert got["reg_doc_breakdown", "MAS Notice 610 (2024)"] == 3.0
    assert got["reg_risk_type_breakdown", "(missing)"] == 1.0


def test_semantic_metrics_skip_absent_and_empty_domains(spark, scored):
    got = values(M.semantic_metrics(transactions=scored.limit(0), messages=None,
                                    obligations=X.obligations(spark).select("owner")))
    assert set(m for m, _ in got) == {"reg_total_paragraphs", "reg_owner_breakdown"}
    assert got["reg_total_paragraphs", ""] == 5.0
    with pytest.raises(ValueError):
        M.semantic_metrics()


def test_hybrid_metrics_count_vectors(spark, scored):
    vectors = spark.createDataFrame([(1,), (2,)], "id int")
    got = values(M.hybrid_metrics(vectors, transactions=scored))
    assert got["vector_count", ""] == 2.0 and ("avg_risk_score", "") in got


def test_extended_metrics_and_snapshot(spark):
    metrics = M.extended_obligation_metrics(X.obligations(spark), "2025-06-01")
    assert {m: v for (m, _), v in values(metrics).items()} == {
        "reg_total_obligations": 5.0, "reg_unique_documents": 3.0, "reg_unique_owners": 3.0,
        "reg_with_deadline": 3.0, "reg_overdue_obligations": 1.0, "reg_missing_owner": 2.0}
    extra = spark.createDataFrame([("reg_zero", "", 0.0), ("reg_other", "", 4.0),
                                   ("aml_high_risk_count", "", 9.0)], metrics.schema)
    assert X.text_of(snapshot_report(metrics.unionByName(extra))) == (
        "Regulatory semantic-layer snapshot:\n- Total obligations: 5\n- Unique documents: 3\n"
        "- Unique owners: 3\n- With deadline: 3\n- Overdue obligations: 1\n- Missing owner: 2\n"
        "- Other: 4")
    assert snapshot_report(extra.where("value = 0")).count() == 0


def test_coverage_and_split_treat_blank_as_missing(spark):
    rows = X.obligations(spark).where("paragraph_id <= 'P3'")
    assert M.deadline_coverage(rows).first().asDict() == {
        "total": 3, "with_deadline": 1, "without_deadline": 2}
    assert M.missing_split(rows).first().asDict() == {
        "total": 3, "missing_count": 2, "complete_count": 1}


def test_label_counts_of_lists_and_text(spark):
    lists = spark.createDataFrame([(["a", "'b'"],), (["a", " "],), (None,)], "tags array<string>")
    assert [(r["label"], r["n"]) for r in M.label_counts(lists, "tags").collect()] == [
        ("a", 2), ("b", 1)]
    text = spark.createDataFrame([("['a', 'b']",), ("a, b",), (None,)], "tags string")
    assert [(r["label"], r["n"]) for r in M.label_counts(text, "tags").collect()] == [
        ("a", 1), ("a, b", 1), ("b", 1)]
    assert M.label_counts(text, "absent").count() == 0
    many = spark.createDataFrame([([f"t{i:02d}" for i in range(20)],)], "tags array<string>")
    assert M.label_counts(many, "tags").count() == 15


def test_histogram_folds_the_top_edge(scored):
    got = {r["bin"]: (r["bin_start"], r["n"]) for r in M.score_histogram(scored).collect()}
    assert got == {0: (0.0, 1), 8: (8.0, 2), 9: (9.0, 1)}


def test_breakdown_parsing(spark):
    df = spark.createDataFrame([("{'a': 2, 'b': 1}",), ('{"a": 3}',), ("[1]",), ("{bad",), (None,)],
                               "s string")
    parsed = M.parse_breakdown(df, "s")
    assert [(r["label"], r["n"]) for r in M.merge_breakdowns(parsed).collect()] == [
        ("a", 5), ("b", 1)]


def test_risk_summary_and_quality(spark):
    hits = spark.createDataFrame([("q", "critical"), ("q", "Low"), ("q", None), ("r", "HIGH")],
                                 "question_id string, risk_flag string")
    rows = {r["question_id"]: r for r in M.risk_summary(hits).collect()}
    assert rows["q"].asDict() == {"question_id": "q", "total": 3, "critical": 1, "high": 0,
                                  "medium": 0, "low": 1}
    texts = spark.createDataFrame([(None,), ("a",), ("",), ("long",)], "masked_narrative string")
    assert M.narrative_quality(texts).first().asDict() == {
        "records": 4, "null_narratives": 1, "short_narratives": 2}


def test_readiness(spark):
    some = spark.createDataFrame([("a",), (None,)], "x string")
    rows = {r["table_name"]: r for r in M.readiness(
        {"some": (some, "x"), "none": (some.limit(0), "x")}).collect()}
    assert rows["some"].asDict() == {"table_name": "some", "records": 2, "usable": 1,
                                     "unusable": 1, "ready": True}
    assert rows["none"]["ready"] is False


def test_breakdowns_take_one_pass(spark):
    plan = M.obligation_breakdowns(X.obligations(spark))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange") == 1
