import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.functions import intents, risk, text as T
from ledgerlens.functions.detectors import BANKING, mask_text
from ledgerlens.functions.lists import compact, parse_list
from ledgerlens.operators.reports import owner_or_units
from tests import fixtures as X


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [("",)],
                                ", ".join(f"{n} string" for n in values) or "x string")
    return row.select(expression.alias("out")).first()["out"]


@pytest.mark.parametrize("stored, expected", [
    ("['NRIC', 'Account Number']", ["NRIC", "Account Number"]),
    ('["a", " b "]', ["a", "b"]),
    ("a, b ,, c", ["a", "b", "c"]),
    ("single", ["single"]),
    ("  ", []),
    ("[]", []),
    (None, []),
    ("['it's', 'b']", ["['it's'", "'b']"]),
    ("['', 'x']", ["x"]),
])
def test_parse_list(spark, stored, expected):
    assert one(spark, parse_list(F.col("s")), s=stored) == expected


def test_parse_list_variants(spark):
    broken = "['it's', 'b']"
    assert one(spark, parse_list(F.col("s"), strip_quotes=True), s="'a', \"b\"") == ["a", "b"]
    assert one(spark, parse_list(F.col("s"), split_commas=False), s="a, b") == ["a, b"]
    assert one(spark, parse_list(F.col("s"), split_commas=False), s=broken) == [broken]


def test_compact_keeps_order(spark):
    out = one(spark, compact([(F.lit(True), "b"), (F.lit(False), "x"), (F.lit(True), "a")]))
    assert out == ["b", "a"]
    assert one(spark, compact([(F.lit(False), "x")])) == []


def test_excerpt(spark):
    assert one(spark, T.excerpt(F.col("s"), 10), s=" a\nb ") == "a b"
    assert one(spark, T.excerpt(F.col("s"), 10), s="0123456789") == "0123456789"
    assert one(spark, T.excerpt(F.col("s"), 10), s="012345 789x") == "012345..."
    assert one(spark, T.excerpt(F.col("s"), 10), s=None) == ""


@pytest.mark.parametrize("number, shown", [
    (60000.0, "60000.0"), (9999.99, "9999.99"), (0.0, "0.0"), (12345678.5, "12345678.5"),
    (9.0, "9.0"), (1e9, "1000000000.0")])
def test_number_text(spark, number, shown):
    assert one(spark, T.number_text(F.lit(number))) == shown


def test_small_text_functions(spark):
    assert one(spark, T.metric_label(F.lit("reg_with_deadline"))) == "With deadline"
    assert one(spark, T.html_lines(F.lit("a\nb"))) == "a<br>b"
    assert one(spark, T.clean_for_vectors(F.lit("\x00 a\x00b\t"))) == "a b"
    assert one(spark, T.title_case(F.lit("hIGH"))) == "High"
    assert one(spark, T.first_present(F.lit(""), F.lit(None), F.lit("x"))) == "x"
    assert one(spark, T.joined_or_default(F.array(F.lit(" a"), F.lit("b'")), "-")) == "a, b"
    assert one(spark, T.joined_or_default(F.array().cast("array<string>"), "-")) == "-"
    assert one(spark, T.is_missing(F.lit(" \t"))) is True
    assert one(spark, T.is_missing(F.lit("nan"))) is False


@pytest.mark.parametrize("units, owner, expected", [
    (["A", "B"], None, "A, B"), (["A"], "Me", "Me"), (None, " ", "Unassigned"),
    ([], None, "Unassigned")])
def test_owner_fallback(spark, units, owner, expected):
    df = spark.createDataFrame([(units, owner)], "business_unit array<string>, owner string")
    assert df.select(owner_or_units(df, K.UNASSIGNED)).first()[0] == expected


# --- detectors -------------------------------------------------------------

@pytest.mark.parametrize("text, masked", [
    ("mail a.b+c@mail.example.com now", "mail <EMAIL> now"),
    ("passport K7654321Z", "passport <PASSPORT>"),
    ("id S7654321A", "id <NRIC>"),
    ("staff SG123123123", "staff <EMP_ID>"),
    ("card 1111-2222-3333-4444", "card <ACCOUNT>"),
    ("acc 123-456789-012", "acc <ACCOUNT>"),
    ("iban GB12ABCD1234567890", "iban <ACCOUNT>"),
    ("call +65 8123 4567", "call <PHONE>"),
    ("call 9123 4567", "call <PHONE>"),
    ("at Blk 7 Fir Lane 2 #01-234 S(654321)", "at <ADDRESS>"),
    ("salary is 7,500 a month", "salary is <SALARY> a month"),
    ("payroll credited 8400", "payroll credited <SALARY>"),
    ("nothing", "nothing"),
    (None, None),
])
def test_banking_masks(spark, text, masked):
    df = spark.createDataFrame([(text,)], "text string")
    assert mask_text(df, "text", BANKING).first()["masked_text"] == masked


# --- risk ------------------------------------------------------------------

@pytest.mark.parametrize("labels, types", [
    (["nric no"], ["NRIC"]), (["Passport Number"], ["Passport"]),
    (["Bank Account"], ["Account"]), (["payroll account"], ["Salary"]),
    (["payroll number"], ["Salary", "EmployeeID"]),
    (["account", "payroll"], ["Account", "Salary"]),
    (["income"], ["Salary"]), (["compensation"], ["Salary"]), (["home address"], ["Address"]),
    (["mobile"], ["Phone"]), (["Email"], ["Email"]), (["temp id"], ["EmployeeID"]),
    (["staff id"], ["EmployeeID"]), (["PayNow ID"], ["PayNow"]), (["other"], []), ([], []),
])
def test_canonical_types(spark, labels, types):
    df = spark.createDataFrame([(labels,)], "l array<string>")
    assert df.select(risk.canonical_types(F.col("l"))).first()[0] == types


@pytest.mark.parametrize("types, level", [
    (["NRIC", "Account"], "Critical"), (["NRIC", "Salary"], "Critical"),
    (["NRIC", "Address"], "Critical"), (["Phone", "Email", "EmployeeID"], "Critical"),
    (["NRIC"], "High"), (["Passport"], "High"), (["Account"], "High"), (["Address"], "High"),
    (["NRIC", "Phone"], "High"), (["Passport", "Phone"], "High"), (["Salary"], "Medium"),
    (["Phone"], "Medium"), (["Email"], "Medium"), (["EmployeeID"], "Medium"),
    (["PayNow"], "Medium"), ([], "Low")])
def test_initial_risk(spark, types, level):
    flags = {name: F.lit(name in types) for name in K.ENTITY_TYPE_WORDS}
    assert one(spark, risk.initial_risk(flags)) == level


@pytest.mark.parametrize("labels, current, expected", [
    (["nric", "account"], "Low", "Critical"), (["nric", "salary"], "Low", "Critical"),
    (["nric", "address"], "Low", "Critical"), (["nric", "paynow"], "Low", "Critical"),
    (["passport", "account"], "High", "Critical"),
    (["salary", "phone", "email"], "Low", "Critical"),
    (["address", "phone", "email"], "Low", "Medium"),
    (["nric"], "Low", "High"), (["passport"], "Low", "High"), (["account"], "Low", "High"),
    (["paynow id"], "Medium", "High"), (["salary", "phone"], "Low", "High"),
    (["salary", "email"], "Low", "High"), (["salary"], "Low", "Medium"),
    (["phone"], "Low", "Medium"), (["temp id"], "Low", "Medium"),
    (["address"], "High", "High"), (["address"], "Low", "Low"),
    (["phone"], "Critical", "Critical"), (["nric"], None, "High"), (["nric"], "odd", "High"),
    (["address"], "odd", "odd"), (["address"], None, None), ([], "medium", "medium"),
    (["phone"], "high", "High"), (["other"], "Low", "Low")])
def test_upgraded_risk(spark, labels, current, expected):
    df = spark.createDataFrame([(labels, current)], "l array<string>, r string")
    assert df.select(risk.upgraded_risk(risk.label_types(F.col("l")), F.col("r"))).first()[0] == expected


def test_rank_round_trip(spark):
    for number, name in enumerate(K.RISK_LEVELS):
        assert one(spark, risk.rank_of(F.lit(name.upper()))) == number
        assert one(spark, risk.level_of(F.lit(number))) == name
    assert one(spark, risk.rank_of(F.lit("?"))) == -1
    assert one(spark, risk.level_of(F.lit(9))) == "Low"
    assert one(spark, risk.is_highlighted(F.lit("CRITICAL"))) is True
    assert one(spark, risk.is_highlighted(F.lit(None).cast("string"))) is False


# --- intents ---------------------------------------------------------------

@pytest.mark.parametrize("question, intent", [
    (K.GOLDEN_QUESTIONS[0][1], "PII_SEARCH"), (K.GOLDEN_QUESTIONS[1][1], "PII_SEARCH"),
    (K.GOLDEN_QUESTIONS[2][1], "AML_SEARCH"), (K.GOLDEN_QUESTIONS[3][1], "AML_SEARCH"),
    (K.GOLDEN_QUESTIONS[4][1], "REG_SEARCH"), (K.GOLDEN_QUESTIONS[5][1], "SAR_DRAFT"),
    ("transactions by risk", "AML_SEARCH"), ("HIGH RISK wires", "AML_SEARCH"),
    ("notice 610 of the MAS", "REG_SEARCH"), ("suspicious transactions", "REG_SEARCH"),
    ("nric and crypto", "PII_SEARCH"), ("Tell me a joke.", "OUT_OF_SCOPE"),
    ("draft a sar", "OUT_OF_SCOPE")])
def test_route(spark, question, intent):
    assert one(spark, intents.route(F.col("q")), q=question) == intent
    assert one(spark, intents.route(F.col("q"), strict=True), q=question) == intent


def test_route_any_transaction_or_only_the_fixed_one(spark):
    assert one(spark, intents.route(F.col("q")), q="SAR for T005") == "SAR_DRAFT"
    assert one(spark, intents.route(F.col("q"), strict=True), q="SAR for T005") == "OUT_OF_SCOPE"


@pytest.mark.parametrize("question, found", [
    ("sar for t12 or T13", "T12"), ("xT9", ""), ("T9.", "T9"), ("T", ""), ("", "")])
def test_transaction_id(spark, question, found):
    assert one(spark, intents.transaction_id(F.col("q")), q=question) == found


@pytest.mark.parametrize("question, found", [
    ("Did an NRIC holder split deposits, that is structuring?", ["PII_SEARCH", "AML_SEARCH"]),
    ("A SAR about T77, please", ["SAR_DRAFT"]),
    ("Anything in crypto next to T31?", ["AML_SEARCH"]),
    ("Which obligations name a deadline for reports?", ["REG_SEARCH"]),
    ("List obligations of the branch offices", ["REG_SEARCH"]),
    ("Tell me a joke.", ["OUT_OF_SCOPE"])])
def test_all_intents(spark, question, found):
    assert one(spark, intents.all_intents(F.col("q")), q=question) == found


@pytest.mark.parametrize("question, kind", [
    (K.GOLDEN_QUESTIONS[6][1], "coverage"), (K.GOLDEN_QUESTIONS[7][1], "missing"),
    (K.GOLDEN_QUESTIONS[4][1], None), ("count deadlines of MAS 610", None),
    ("list missing deadlines, MAS Notice 610, suspicious", "missing")])
def test_report_kind(spark, question, kind):
    assert one(spark, intents.report_kind(F.col("q")), q=question) == kind


def test_fixture_tables_are_readable(spark):
    assert X.messages(spark).count() == len(X.MESSAGES)
