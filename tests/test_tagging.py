from pyspark.sql import functions as F

from ledgerlens.operators.tagging import (
    tag_messages, tag_obligations, tag_transactions, upgrade_risk)
from tests import fixtures as X


def by_id(df, key):
    return {r[key]: r for r in df.collect()}


def test_tag_messages(spark):
    rows = by_id(tag_messages(X.messages(spark)), "message_id")
    assert rows["M01"]["pii_entities"] == ["NRIC", "Account Number"]
    assert rows["M01"]["masked_text"] == "My NRIC <NRIC> and account <ACCOUNT>, please call"
    assert {k: r["risk_flag"] for k, r in rows.items()} == {
        "M01": "Critical", "M02": "Medium", "M03": "High", "M04": "Medium", "M05": "High",
        "M06": "Low", "M07": "Medium"}
    assert rows["M06"]["pii_entities"] == []
    assert rows["M04"]["original_text"] == X.MESSAGES[3][3]


def test_passport_is_not_counted_as_nric(spark):
    rows = by_id(tag_messages(X.messages(spark)), "message_id")
    assert rows["M03"]["pii_entities"] == ["Passport", "Account Number"]


def test_upgrade_only_raises(spark):
    rows = by_id(upgrade_risk(tag_messages(X.messages(spark))), "message_id")
    assert rows["M03"]["risk_flag"] == "Critical"
    assert rows["M04"]["risk_flag"] == "High"
    assert rows["M05"]["risk_flag"] == "High"
    assert rows["M06"]["risk_flag"] == "Low"


def test_upgrade_guards(spark):
    plain = spark.createDataFrame([("a",)], "message_id string")
    assert upgrade_risk(plain).columns == ["message_id"]
    unflagged = spark.createDataFrame([(["address"],), (["nric"],)], "pii_entities array<string>")
    assert X.column(upgrade_risk(unflagged), "risk_flag") == ["High", "Low"]


def test_tag_transactions(spark):
    rows = by_id(tag_transactions(X.transactions(spark)), "transaction_id")
    tags = {k: r["aml_tags"] for k, r in rows.items()}
    assert tags["T001"] == ["structuring"]
    assert tags["T005"] == [] and tags["T004"] == []
    assert tags["T002"] == ["crypto"]
    assert tags["T003"] == ["trade_based", "jurisdiction"]
    assert tags["T028"] == ["smurfing", "funnel", "trade_based", "layering"]
    scores = {k: r["risk_score"] for k, r in rows.items()}
    assert scores == {"T001": 4.0, "T002": 4.0, "T003": 8.0, "T004": 1.0, "T005": 1.0,
                      "T006": 4.0, "T028": 10.0}
    assert rows["T002"]["masked_narrative"].endswith("to <PHONE>")
    assert rows["T002"]["pii_found"] == ["Phone"]
    assert rows["T002"]["explanation"] == "crypto +2, amount +1"
    assert rows["T004"]["explanation"] == "no typology found"


def test_tag_obligations(spark):
    texts = [
        ("A", "MAS Notice 610 (Feb 2024)", "Report suspicious cases within 5 business days."),
        ("B", "Basel III NSFR (2024)", "Keep stable funding at all times."),
        ("C", "HKMA X", "Plans shall be tested at least annually. Appoint a MLRO."),
        ("D", "HKMA X", "No later than 15 calendar days, and annually."),
        ("E", "HKMA X", "Good conduct."),
    ]
    df = spark.createDataFrame(texts, "paragraph_id string, source_document string, "
                                      "paragraph_text string")
    rows = by_id(tag_obligations(df), "paragraph_id")
    assert [rows[k]["deadline"] for k in "ABCDE"] == [
        "5 business days", "Ongoing", "Annual", "15 calendar days", None]
    assert (rows["A"]["regulation"], rows["A"]["article"]) == ("MAS Notice 610", None)
    assert (rows["B"]["regulation"], rows["B"]["article"]) == ("Basel III", "NSFR")
    assert rows["C"]["owner"] == "MLRO" and rows["A"]["owner"] == "Compliance"
    assert rows["A"]["risk_type"] == "AML/CFT" and rows["B"]["risk_type"] == "Liquidity Risk"
    assert rows["E"]["business_unit"] == [] and "Compliance" in rows["A"]["business_unit"]


def test_filter_on_tags_does_not_repeat_the_patterns(spark):
    tagged = tag_messages(X.messages(spark)).where(F.array_contains("pii_entities", "NRIC"))
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<SALARY>") == 1
