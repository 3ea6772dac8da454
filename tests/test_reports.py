import json

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators import answers as A, reports as R, search as S, validation as V
from tests import fixtures as X


@pytest.fixture(scope="module")
def corpus(spark):
    return X.corpus(spark)


def answer(corpus, question, mode=K.MODE_TAGGED, **options):
    return "\n".join(r["line"] for r in A.ask(question, corpus, mode, **options).collect())


def test_message_report(corpus):
    assert answer(corpus, "Show me any messages with NRIC leaks.") == (
        "🚨 **PII Matches Found:**\n"
        "Total: 1 hits (Critical: 1, High: 0, Medium: 0, Low: 0)\n"
        "\n• ID: `M01` | Risk: **Critical** | Entities: NRIC, Account Number\n"
        "  _Excerpt (masked):_ My NRIC <NRIC> and account <ACCOUNT>, please call")


def test_message_report_lists_every_hit(spark):
    rows = [(f"M{i:03d}", "x " * 100, ["Phone"], "Low", "o") for i in range(30)]
    tagged = spark.createDataFrame(rows, "message_id string, masked_text string, "
                                         "pii_entities array<string>, risk_flag string, "
                                         "original_text string")
    keys = S.message_keys(X.questions(spark, "phone"))
    lines = R.message_report(keys, R.shown_messages(S.match_messages(tagged, keys)))
    assert lines.where("section = 2").count() == 30
    text = X.text_of(lines, "q1")
    assert "Total: 30 hits (Critical: 0, High: 0, Medium: 0, Low: 30)" in text
    assert text.splitlines()[4].endswith(" x...") and len(text.splitlines()[4]) <= 22 + 140


def test_transaction_report(corpus):
    assert answer(corpus, "Show me examples of structuring.") == (
        "**High-Risk Transactions:**\nTotal: 2 transactions (showing up to first 2).\n"
        "\n• **T001** | SGD 9500.0 | Risk: **4.0/10**\n  Tags: structuring\n"
        "  _Narrative:_ Cash deposit at counter\n"
        "\n• **T006** | SGD 120.5 | Risk: **4.0/10**\n  Tags: structuring\n"
        "  _Narrative:_ Suspected structuring below threshold")


def test_transaction_report_shows_twenty_and_a_zero_score(spark):
    rows = [(f"T{i:03d}", 10.0, None if i else 0.0, "crypto") for i in range(25)]
    tagged = spark.createDataFrame(
        rows, "transaction_id string, amount_sgd double, risk_score double, "
              "original_narrative string").withColumn("aml_tags", F.array().cast("array<string>"))
    keys = S.transaction_keys(X.questions(spark, "crypto"))
    hits = R.shown_transactions(S.match_transactions(tagged, keys))
    text = X.text_of(R.transaction_report(keys, hits), "q1")
    assert "Total: 25 transactions (showing up to first 20)." in text
    assert text.count("•") == 20
    assert "• **T000** | SGD 10.0 | Risk: **0.0/10**\n  Tags: (not provided)" in text
    assert "• **T001** | SGD 10.0 | Risk: **(not provided)**" in text


def test_obligation_report(corpus):
    text = answer(corpus, "What are the MAS 610 rules on suspicious transactions?")
    assert text.startswith("**Regulatory Obligations:**\n"
                           "Total: 4 obligations (showing up to first 4).\n")
    assert "\n• [MAS Notice 610] Escalate suspicious activity at once.\n" \
           "  Owner: **Compliance, Operations**" in text


def test_sar(corpus):
    assert answer(corpus, "Draft a SAR for transaction T028") == (
        "**SAR Drafted for T028**\nAmount: SGD 60000.0\n"
        "Typology: smurfing, funnel, trade_based, layering\nRisk: 10.0/10\n"
        "Narrative: Smurfing ring, funnel and layering, goods invoiced")
    assert answer(corpus, "SAR for T404") == f"**SAR Drafted for T404**\n{K.NO_SAR}"
    assert answer(corpus, "SAR for T005", strict=True) == K.OUT_OF_SCOPE_TEXT
    assert answer(corpus, "Draft a SAR for transaction T028", K.MODE_RAW) == (
        f"**SAR Drafted for T028**\n{K.NO_SAR_RAW}")


def test_sar_defaults_to_the_fixed_id(spark, corpus):
    requests = R.draft_requests(X.questions(spark, "draft it"))
    row = R.sar_drafts(requests, corpus.tagged_transactions).first()
    assert row["transaction_id"] == "T028" and row["sar_draft"].startswith("Amount: SGD 60000.0")


def test_structured_answers(corpus):
    assert answer(corpus, K.GOLDEN_QUESTIONS[6][1]) == (
        "Under MAS Notice 610, the tagged regulatory data shows **3** suspicious-transaction "
        "obligations.\n\n- **With deadlines captured:** 1\n- **Missing/blank deadlines:** 2\n"
        "\n**Examples (first few paragraphs):**\n"
        "- P1: MAS Notice 610\n- P2: MAS Notice 610\n- P3: MAS Notice 610")
    assert answer(corpus, K.GOLDEN_QUESTIONS[7][1]) == (
        "From **MAS Notice 610**, there are **3** tagged suspicious-transaction obligations.\n"
        "Out of these, **2** have a missing owner and/or deadline.\n"
        "\n**Obligations with missing owner/deadline (first few):**\n"
        "- P2: MAS Notice 610 … | owner=(missing), deadline=(missing)\n"
        "- P3: MAS Notice 610 … | owner=Compliance, deadline=(missing)")
    raw = answer(corpus, K.GOLDEN_QUESTIONS[6][1], K.MODE_RAW)
    assert raw == K.NO_RESULTS


def test_structured_answers_without_rows(spark, corpus):
    none = X.obligations(spark).limit(0)
    assert R.coverage_answer(none).first()["line"] == K.TOPIC_NONE
    assert R.missing_answer(none).first()["line"] == K.TOPIC_NONE
    complete = X.obligations(spark).where("paragraph_id = 'P1'")
    assert "Obligations with missing" not in R.missing_answer(complete).first()["line"]


def test_no_results_and_out_of_scope(corpus):
    assert answer(corpus, "messages about zebras") == K.NO_RESULTS
    assert answer(corpus, "Tell me a joke.") == K.OUT_OF_SCOPE_TEXT


def test_raw_mode(corpus):
    text = answer(corpus, "messages|nothing to see", K.MODE_RAW)
    assert text.startswith("🚨 **PII Matches Found:**\nTotal: 1 hits (Critical: 0, High: 0, "
                           "Medium: 0, Low: 1)\n\n• ID: `M06` | Risk: **Low** | "
                           "Entities: messages|nothing to see\n")
    text = answer(corpus, "suspicious transactions|liquid", K.MODE_RAW)
    assert "• [Hold liquid assets.] Hold liquid assets.\n  Owner: **(not tagged)**" in text
    text = answer(corpus, "crypto|high-risk", K.MODE_RAW)
    assert "Risk: **(not provided)**\n  Tags: Crypto" in text


GOLDEN_HEADLINES = {
    "q1": K.PII_HEADLINE, "q2": K.PII_HEADLINE, "q3": K.AML_HEADLINE, "q4": K.AML_HEADLINE,
    "q5": K.REG_HEADLINE, "q6": "**SAR Drafted for T028**"}


def golden(spark):
    return spark.createDataFrame(list(K.GOLDEN_QUESTIONS), "question_id string, text string")


def test_golden_headlines(spark, corpus):
    lines = A.answer_lines(A.search_all(golden(spark), corpus, K.MODE_TAGGED))
    first = {r["question_id"]: r["line"] for r in lines.where("section = 0").collect()}
    assert {q: first[q] for q in GOLDEN_HEADLINES} == GOLDEN_HEADLINES


def test_trace(spark, corpus):
    rows = {r["question_id"]: r for r in A.answer_trace(
        A.search_all(golden(spark), corpus, K.MODE_TAGGED)).collect()}
    assert len(rows) == len(K.GOLDEN_QUESTIONS)
    assert rows["q1"]["tool_name"] == "search_pii_tool" and [p["id"] for p in rows["q1"]["preview"]] == ["M01"]
    assert rows["q5"]["hit_count"] == 4 and [p["id"] for p in rows["q5"]["preview"]] == [
        "P1", "P2", "P3"]
    assert json.loads(rows["q1"]["preview"][0]["record"])["risk_flag"] == "Critical"
    assert json.loads(rows["q6"]["preview"][0]["record"])["sar_draft"].startswith("Amount")
    assert [p["id"] for p in rows["q7"]["preview"]] == ["P1", "P2", "P3"]
    assert rows["q6"]["tool_name"] == "draft_sar_tool" and rows["q6"]["hit_count"] == 1
    assert rows["q7"]["tool_name"] == "query_regulations" and rows["q7"]["hit_count"] == 3
    assert rows["q10"]["intent"] == "OUT_OF_SCOPE" and rows["q10"]["no_results"]


def test_compare_modes(spark, corpus):
    rows = {r["question_id"]: r for r in A.compare_modes(golden(spark), corpus).collect()}
    one = rows["q1"]
    assert one["raw_no_results"] and not one["tagged_no_results"]
    assert one["raw_answer_length"] == len(K.NO_RESULTS)
    assert one["tagged_answer_length"] == len(answer(corpus, K.GOLDEN_QUESTIONS[0][1]))
    assert rows["q6"]["raw_tool"] == "none" and rows["q6"]["tagged_tool"] == "draft_sar_tool"


def test_fan_out(spark, corpus):
    asked = X.questions(spark, "crypto and NRIC", "Tell me a joke.", "Draft SAR for T001")
    rows = {(r["question_id"], r["intent"]): r["hit_count"]
            for r in A.fan_out(asked, corpus).collect()}
    assert rows == {("q1", "PII_SEARCH"): 1, ("q1", "AML_SEARCH"): 1, ("q2", "OUT_OF_SCOPE"): 0,
                    ("q3", "SAR_DRAFT"): 0}


def test_rankings(spark, corpus):
    top = [r["message_id"] for r in R.top_messages_by_risk(corpus.tagged_messages, 4).collect()]
    assert top == ["M01", "M03", "M04", "M05"]
    best = [r["transaction_id"] for r in R.top_transactions(corpus.tagged_transactions, 3).collect()]
    assert best == ["T028", "T003", "T002"]


# --- validation ------------------------------------------------------------

@pytest.fixture(scope="module")
def checked(spark, corpus):
    asked = X.questions(spark, "messages with NRIC", "crypto and structuring")
    results = A.search_all(asked, corpus, K.MODE_TAGGED)
    out = {}
    for intent, found in results.found.items():
        out[intent] = tuple(found.spread(df) for df in (
            A.report(intent, found), S.per_question(found.keys, found.hits),
            S.counts_per_question(found.keys, found.hits)))
    return out


def verdicts(df):
    return {r["question_id"]: r["ok"] for r in df.collect()}


def test_reports_pass_their_checks(checked, corpus):
    lines, hits, counts = checked[K.PII_SEARCH]
    assert verdicts(V.check_ids(lines, hits, "message_id", V.MESSAGE_ID)) == {"q1": True}
    assert verdicts(V.check_masking(lines, corpus.tagged_messages)) == {"q1": True}
    assert verdicts(V.check_counts(lines, counts)) == {"q1": True}
    lines, hits, counts = checked[K.AML_SEARCH]
    assert verdicts(V.check_ids(lines, hits, "transaction_id", V.TRANSACTION_ID)) == {"q2": True}
    assert verdicts(V.check_numbers(lines, corpus.tagged_transactions)) == {"q2": True}


def test_altered_reports_fail(checked, corpus):
    lines, hits, counts = checked[K.PII_SEARCH]
    other = lines.withColumn("line", F.replace("line", F.lit("M01"), F.lit("M99")))
    assert verdicts(V.check_ids(other, hits, "message_id", V.MESSAGE_ID)) == {"q1": False}
    assert V.unknown_ids(other, hits, "message_id", V.MESSAGE_ID).first()["cited_id"] == "M99"
    open_text = lines.withColumn("line", F.replace("line", F.lit("<NRIC>"), F.lit("S1")))
    assert verdicts(V.check_masking(open_text, corpus.tagged_messages)) == {"q1": False}
    claimed = lines.withColumn("line", F.replace("line", F.lit("Total: 1"), F.lit("Total: 2")))
    bad = V.check_counts(claimed, counts)
    assert verdicts(bad) == {"q1": False}
    assert [r["line"] for r in V.final_lines(claimed, bad).collect()] == [K.VALIDATION_FALLBACK]
    lines, hits, _ = checked[K.AML_SEARCH]
    dearer = lines.withColumn("line", F.replace("line", F.lit("SGD 4"), F.lit("SGD 9")))
    assert verdicts(V.check_numbers(dearer, corpus.tagged_transactions)) == {"q2": False}


def test_answers_are_stored_once(spark, corpus):
    asked = [("a", "Show me any messages with NRIC leaks."), ("b", "messages with nric please"),
             ("c", "Show me examples of structuring."), ("d", "more structuring"), ("e", "hello"),
             ("f", "good day"), ("g", "Draft a SAR for transaction T028"), ("h", "messages (urgent"),
             ("i", "How many MAS 610 suspicious transactions rules have a deadline?"),
             ("j", "What are the MAS 610 rules on suspicious transactions?")]
    questions = spark.createDataFrame(asked, "question_id string, text string")
    for mode in (K.MODE_RAW, K.MODE_TAGGED):
        results = A.search_all(questions, corpus, mode)
        lines, members = A.answer_tables(results)
        joined = members.join(lines, ["answer_id", "mode"]).drop("answer_id")
        whole = A.answer_lines(results)
        key = lambda df: sorted(tuple(r[c] for c in whole.columns) for r in df.collect())
        assert key(joined) == key(whole)
        names = {r["question_id"]: r["answer_id"] for r in members.collect()}
        assert set(names) == {i for i, _ in asked} and names["f"] == "e" and names["g"] == "g"
        assert (names["b"] == "a") == (names["d"] == "c") == (mode == K.MODE_TAGGED)
        assert {r["answer_id"] for r in lines.collect()} == set(names.values())
