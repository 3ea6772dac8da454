import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as K
from ledgerlens.operators import search as S
from ledgerlens.operators.phrase_join import phrase_join, phrase_keys
from ledgerlens.operators.tagging import tag_messages, tag_transactions, upgrade_risk
from tests import fixtures as X


@pytest.fixture(scope="module")
def tagged(spark):
    return {
        "messages": upgrade_risk(tag_messages(X.messages(spark))),
        "transactions": tag_transactions(X.transactions(spark)),
        "obligations": X.obligations(spark),
    }


# --- raw -------------------------------------------------------------------

def test_raw_search_is_a_pattern_in_id_order(spark):
    hits = S.search_raw_messages(X.messages(spark), "NRIC|PASSPORT")
    assert [r["message_id"] for r in hits.collect()] == ["M01", "M03"]
    assert hits.columns == ["message_id", "channel", "text"]


def test_raw_search_literal_and_limit(spark):
    messages = X.messages(spark)
    assert S.search_raw_messages(messages, "NRIC|PASSPORT", literal=True).count() == 0
    assert S.search_raw_messages(messages, "my (nric", literal=True).count() == 0
    assert S.search_raw_messages(messages, "m", limit=2).count() == 2


def test_raw_search_rejects_a_bad_pattern(spark):
    with pytest.raises(Exception):
        S.search_raw_messages(X.messages(spark), "what (nric")


def test_raw_search_null_text_and_missing_columns(spark):
    df = spark.createDataFrame([("P1", None), ("P2", "Annual review")],
                               "paragraph_id string, paragraph_text string")
    row = S.search_raw_paragraphs(df, "annual").first()
    assert (row["paragraph_id"], row["regulation"], row["article"]) == ("P2", None, None)


# --- tagged, one question --------------------------------------------------

@pytest.mark.parametrize("query, ids", [
    ("any NRIC leaks", ["M01"]), ("income in chats", ["M04"]), ("payments", ["M04"]),
    ("phone numbers", ["M02"]), ("Nothing To See", ["M06"]), ("<EMAIL>", ["M04"]),
    ("absent words", [])])
def test_search_messages(tagged, query, ids):
    assert X.column(S.search_messages(tagged["messages"], query), "message_id") == ids


@pytest.mark.parametrize("query, ids", [
    ("t002", ["T002"]), ("T028 ", ["T028"]), ("crypto and structuring", ["T002"]),
    ("show structuring", ["T001", "T006"]), ("rent", ["T004"]), ("funnel", ["T028"]),
    ("T999", [])])
def test_search_transactions(tagged, query, ids):
    assert X.column(S.search_transactions(tagged["transactions"], query), "transaction_id") == ids


def test_unknown_id_falls_through_to_text(spark, tagged):
    extra = tagged["transactions"].withColumn(
        "original_narrative", F.when(F.col("transaction_id") == "T004", "see t777")
        .otherwise(F.col("original_narrative")))
    assert X.column(S.search_transactions(extra, "T777"), "transaction_id") == ["T004"]
    assert X.column(S.search_transactions(extra, "T001"), "transaction_id") == ["T001"]


def test_transactions_are_ranked(spark):
    df = spark.createDataFrame(
        [("T1", None, 1.0), ("T2", 5.0, 1.0), ("T3", 5.0, 9.0), ("T4", 5.0, 9.0), ("T5", 7.0, 1.0)],
        "transaction_id string, risk_score double, amount_sgd double") \
        .withColumn("original_narrative", F.lit("cash"))
    ids = [r["transaction_id"] for r in S.search_transactions(df, "cash").collect()]
    assert ids == ["T5", "T3", "T4", "T2", "T1"]


@pytest.mark.parametrize("query, ids", [
    (K.GOLDEN_QUESTIONS[4][1], ["P1", "P2", "P3", "P4"]),
    ("MAS rule 610: str", ["P1", "P2", "P3", "P4"]),
    ("mas 610", ["P4"]), ("liquid assets", ["P5"]), ("basel iii", ["P5"]), ("none", [])])
def test_search_obligations(tagged, query, ids):
    assert X.column(S.search_obligations(tagged["obligations"], query), "paragraph_id") == ids


@pytest.mark.parametrize("filters, ids", [
    ({}, ["P1", "P2", "P3", "P4", "P5"]),
    ({"source_document": "mas notice 610"}, ["P1", "P2", "P3"]),
    ({"risk_type": "suspicious"}, ["P1", "P2", "P3"]),
    ({"risk_type": "."}, ["P1", "P2", "P3", "P4"]),
    ({"missing_deadline": True}, ["P2", "P3"]),
    ({"missing_owner": True}, ["P2", "P5"]),
    ({"source_document": "610", "missing_deadline": True, "missing_owner": True}, ["P2"])])
def test_filter_obligations(tagged, filters, ids):
    assert X.column(S.filter_obligations(tagged["obligations"], **filters), "paragraph_id") == ids


# --- batch equals one by one -----------------------------------------------

MESSAGE_QUESTIONS = ["any NRIC leaks", "NRIC again", "income in chats", "phone", "about my loan",
                     "Nothing To See", "absent"]


def pairs(df, record_id):
    return sorted((r["question_id"], r[record_id]) for r in df.collect())


def test_batch_messages(spark, tagged):
    keys = S.message_keys(X.questions(spark, *MESSAGE_QUESTIONS))
    hits = S.match_messages(tagged["messages"], keys)
    expected = sorted((f"q{i}", m) for i, q in enumerate(MESSAGE_QUESTIONS, start=1)
                      for m in X.column(S.search_messages(tagged["messages"], q), "message_id"))
    assert pairs(S.per_question(keys, hits), "message_id") == expected
    counts = {r["question_id"]: r["hit_count"]
              for r in S.counts_per_question(keys, hits).collect()}
    assert counts == {"q1": 1, "q2": 1, "q3": 1, "q4": 1, "q5": 1, "q6": 1, "q7": 0}


def test_batch_transactions(spark, tagged):
    asked = ["t002", "T999", "crypto and structuring", "structuring", "rent", "FUNNEL", "t0"]
    keys = S.transaction_keys(X.questions(spark, *asked))
    hits = S.match_transactions(tagged["transactions"], keys)
    expected = sorted(
        (f"q{i}", t) for i, q in enumerate(asked, start=1)
        for t in X.column(S.search_transactions(tagged["transactions"], q), "transaction_id"))
    assert pairs(S.per_question(keys, hits), "transaction_id") == expected


def test_batch_obligations(spark, tagged):
    asked = [K.GOLDEN_QUESTIONS[4][1], "MAS rule 610: str", "mas 610", "Liquid Assets", "none",
             "see mas 610 on strict reporting"]
    keys = S.obligation_keys(X.questions(spark, *asked))
    hits = S.match_obligations(tagged["obligations"], keys)
    expected = sorted(
        (f"q{i}", p) for i, q in enumerate(asked, start=1)
        for p in X.column(S.search_obligations(tagged["obligations"], q), "paragraph_id"))
    assert pairs(S.per_question(keys, hits), "paragraph_id") == expected


def test_batch_raw_and_weak_tags(spark):
    asked = ["account|salary", "nothing to see.", "m"]
    keys = S.raw_keys(X.questions(spark, *asked))
    hits = S.first_hits(S.match_raw(X.messages(spark), "message_id", "text", keys,
                                    S.RAW_MESSAGE_FIELDS), "message_id", 2)
    weak = S.per_question(keys, S.weak_message_tags(hits))
    rows = {(r["question_id"], r["message_id"]): r for r in weak.collect()}
    assert sorted(rows) == [("q1", "M01"), ("q1", "M03"), ("q2", "M06"), ("q3", "M01"),
                            ("q3", "M02")]
    assert rows["q1", "M01"]["pii_entities"] == ["NRIC", "Account"]
    assert rows["q1", "M01"]["risk_flag"] == "High"
    assert rows["q2", "M06"]["pii_entities"] == ["nothing to see."]
    assert rows["q2", "M06"]["risk_flag"] == "Low"


def test_weak_transaction_tags(spark):
    keys = S.raw_keys(X.questions(spark, "structured|cash", "crypto"))
    hits = S.match_raw(X.transactions(spark), "transaction_id", "narrative", keys,
                       S.RAW_TRANSACTION_FIELDS)
    rows = {(r["question_id"], r["transaction_id"]): r
            for r in S.per_question(keys, S.weak_transaction_tags(hits)).collect()}
    assert rows["q1", "T001"]["aml_tags"] == ["Structuring"]
    assert rows["q2", "T002"]["aml_tags"] == ["Crypto"]
    assert rows["q2", "T002"]["risk_score"] is None


def test_top_per_question_merges_keys(spark, tagged):
    keys = S.obligation_keys(X.questions(spark, K.GOLDEN_QUESTIONS[4][1]))
    hits = S.match_obligations(tagged["obligations"], keys)
    top = S.top_per_question(keys, hits, [F.asc("paragraph_id")], 3)
    assert [r["paragraph_id"] for r in top.orderBy("rank").collect()] == ["P1", "P2", "P3"]


# --- containment join ------------------------------------------------------

RECORDS = [
    ("1", "The quick brown fox jumps over the lazy dog"),
    ("2", "quick brown foxes; a LAZY DOG sleeps (a lot)"),
    ("3", "ab"), ("4", ""), ("5", None), ("6", "ÉTÉ à la plage, brown fox"),
    ("7", "line one\nline two of the quick brown story"),
]
PHRASES = ["quick brown", "Lazy Dog", "fox", "ab", "b", "été", "two of the quick", "nowhere", "o",
           "quick brown fox jumps", "one\nline", "(a lot)", "", "brown fox"]
PATTERNS = ["quick.brown", "fox(es)?", "dogs?", "^the", "b|story", "qu[ai]ck brown", "laz+y",
            "fox.*over", "brown{1,2} fox", "\\bab\\b", "line one.line", "x*", "quick brown f",
            "(the )?lazy (dog|cat)", "quick brown fox|of the quick", "jumps over|lazy dog|nowhere",
            "plage, (brown|red) fox", "the [qz]uick brown", "(?:two|three) of the quick",
            "lot\\)", "\\x6cazy", "(a(b)?)", "quick brown||", "brown foxes?; a", "(?i)THE LAZY",
            "lazy\\s+dog|quick\\s+brown fox"]
MALFORMED = ["*lazy dog", "lazy (dog", "[quick", "quick brown???+", "fox{2", "a)"]


def brute(phrases, match):
    return sorted((i, p) for i, t in RECORDS for p in phrases if match(p, t or ""))


@pytest.mark.parametrize("options", [
    {}, {"literal_phrases": 0}, {"literal_phrases": 0, "broadcast_bytes": 40},
    {"literal_phrases": 9}])
def test_phrase_join_matches_brute_force(spark, options):
    records = spark.createDataFrame(RECORDS, "id string, text string")
    phrases = spark.createDataFrame([(p,) for p in [*PHRASES, "fox"]], "p string")
    got = phrase_join(records, "id", "text", phrases, "p", **options)
    assert got.columns == ["id", "text", "phrase"]
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == brute(
        PHRASES, lambda p, t: p.lower() in t.lower())


@pytest.mark.parametrize("options", [
    {}, {"literal_phrases": 0}, {"literal_phrases": 0, "broadcast_bytes": 40}])
def test_pattern_join_matches_brute_force(spark, options):
    import re
    records = spark.createDataFrame(RECORDS, "id string, text string")
    phrases = spark.createDataFrame([(p,) for p in PATTERNS], "p string")
    got = phrase_join(records, "id", "text", phrases, "p", regex=True, **options)
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == brute(
        PATTERNS, lambda p, t: re.search(p, t, re.IGNORECASE) is not None)


@pytest.mark.parametrize("fillers", [0, 57, 58, 194])
def test_malformed_patterns_are_skipped_at_every_size(spark, fillers):
    records = spark.createDataFrame(RECORDS, "id string, text string")
    phrases = spark.createDataFrame(
        [(p,) for p in [*MALFORMED, "lazy dog", *(f"filler {i}" for i in range(fillers))]], "p string")
    got = phrase_join(records, "id", "text", phrases, "p", regex=True)
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == [
        ("1", "lazy dog"), ("2", "lazy dog")]


def test_alternatives_and_groups_have_pieces(spark):
    patterns = spark.createDataFrame([("messages (urgent) please",), ("payments|transfers today",),
                                      ("see the [abc] of every account",)], "phrase string")
    keys = phrase_keys(patterns, regex=True).collect()
    assert all(r["piece"] for r in keys) and {r["kind"] for r in keys} <= {"word", "long"}
    assert sorted(r["phrase"] for r in keys).count("payments|transfers today") == 2


@pytest.mark.parametrize("options", [
    {}, {"literal_phrases": 0}, {"literal_phrases": 0, "broadcast_bytes": 40}])
def test_pattern_join_folds_letters_like_the_pattern_does(spark, options):
    records = spark.createDataFrame(
        [("1", "a mi\u017fsed letter"), ("2", "273 \u212aelvin"), ("3", "ΟΔΟΣΑ"),
         ("4", "\u0130stanbul")],
        "id string, text string")
    phrases = spark.createDataFrame([("missed letter",), ("kelvin",), ("οδος",), ("istanbul",)],
                                    "p string")
    got = phrase_join(records, "id", "text", phrases, "p", regex=True, **options)
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == [
        ("1", "missed letter"), ("2", "kelvin"), ("3", "οδος"), ("4", "istanbul")]


def test_phrase_join_without_phrases(spark):
    records = spark.createDataFrame(RECORDS, "id string, text string")
    none = spark.createDataFrame([], "p string")
    assert phrase_join(records, "id", "text", none, "p").count() == 0


def test_phrase_keys_avoid_shared_pieces(spark):
    phrases = spark.createDataFrame(
        [(f"please show me all about {w}",) for w in ("elephants", "crocodiles", "sparrows")],
        "phrase string")
    rows = phrase_keys(phrases).collect()
    assert len({r["piece"] for r in rows}) == 3
    assert {r["kind"] for r in rows} == {"word"}


def test_phrase_keys_avoid_pieces_of_many_texts(spark):
    texts = [(str(i), f"number {i} about elephants") for i in range(3000)]
    records = spark.createDataFrame([*texts, ("x", "some crocodiles")], "id string, text string")
    phrases = spark.createDataFrame([("about elephants and zebrafish",)], "phrase string")
    keys = phrase_keys(phrases, records=records).collect()
    assert [r["piece"] for r in keys] not in ([["elephant"]], [["about el"]])


def test_texts_do_not_take_part_in_the_join_of_pieces(spark):
    records = spark.createDataFrame(RECORDS, "id string, text string")
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "p string")
    got = phrase_join(records, "id", "text", phrases, "p", literal_phrases=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1


def test_many_random_phrases(spark):
    """Phrases cut out of the texts at random places, all ways against each other."""
    import random
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "io"]
    texts = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))))
             for i in range(60)]
    phrases = set()
    for _, t in texts:
        start = rng.randrange(len(t))
        phrases.add(t[start:start + rng.randint(1, 30)])
    records = spark.createDataFrame(texts, "id string, text string")
    frame = spark.createDataFrame([(p,) for p in phrases], "p string")
    expected = sorted((i, p) for i, t in texts for p in phrases if p in t)
    for options in ({"literal_phrases": 5}, {"literal_phrases": 0, "broadcast_bytes": 40},
                    {"literal_phrases": 1000}):
        got = phrase_join(records, "id", "text", frame, "p", **options)
        assert sorted((r["id"], r["phrase"]) for r in got.collect()) == expected


def test_a_short_alternative_leaves_the_others_their_pieces(spark):
    patterns = spark.createDataFrame([("pii|every account of the town",), ("x|",)], "phrase string")
    keys = sorted((r["phrase"], r["kind"]) for r in phrase_keys(patterns, regex=True).collect())
    assert keys == [("pii|every account of the town", "short"),
                    ("pii|every account of the town", "word"), ("x|", "none")]


@pytest.mark.parametrize("literal_phrases", [0, 5, 40])
def test_patterns_with_one_short_alternative(spark, literal_phrases):
    import re
    texts = [("1", "Some PII here"), ("2", "passage number 7 of the book"), ("3", "p, i and i"),
             ("4", None), ("5", "passage number 17 of the book with pii"), ("6", "passage")]
    patterns = [f"{'pii' if i % 2 else 'i and i'}|passage number {i} of the book" for i in range(20)]
    got = phrase_join(spark.createDataFrame(texts, "id string, text string"), "id", "text",
                      spark.createDataFrame([(p,) for p in [*patterns, "p|q"]], "p string"), "p",
                      regex=True, literal_phrases=literal_phrases)
    assert sorted((r["id"], r["phrase"]) for r in got.collect()) == sorted(
        (i, p) for i, t in texts for p in [*patterns, "p|q"] if re.search(p, t or "", re.I))
