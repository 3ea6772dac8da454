"""Small hand-written tables with the schemas of the real ones."""

from ledgerlens.operators.answers import Corpus
from ledgerlens.operators.tagging import tag_messages, tag_transactions, upgrade_risk
from ledgerlens.sources import schemas

MESSAGES = [
    ("M01", "email", "01-02-2025", "My NRIC S7654321A and account 321-654987-111, please call"),
    ("M02", "app_chat", "02-02-2025", "Call me on 81112222 about my loan"),
    ("M03", "email", "03-02-2025", "passport K7654321Z attached, account 222-111333-444"),
    ("M04", "app_chat", "04-02-2025", "net salary 7,250 last month, mail me at ann@example.org"),
    ("M05", "call_transcript", "05-02-2025", "Moved to Blk 9 Palm Road 3 #02-11 S(123456)"),
    ("M06", "email", "06-02-2025", "nothing to see here"),
    ("M07", "email", "07-02-2025", "staff SG123123123 asks about crypto wallets"),
]

TRANSACTIONS = [
    ("T001", "01-03-2025", 9500.0, "SGD", "Cash deposit at counter"),
    ("T002", "02-03-2025", 45000.0, "SGD", "Crypto exchange payout, wallet to 91234567"),
    ("T003", "03-03-2025", 150000.0, "SGD", "Invoice for goods via offshore company"),
    ("T004", "04-03-2025", 8000.0, "SGD", "Monthly rent"),
    ("T005", "05-03-2025", 10000.0, "SGD", "Cash deposit at counter"),
    ("T006", "06-03-2025", 120.5, "SGD", "Suspected structuring below threshold"),
    ("T028", "07-03-2025", 60000.0, "SGD", "Smurfing ring, funnel and layering, goods invoiced"),
]

OBLIGATIONS = [
    ("P1", "MAS Notice 610 (2024)", "MAS Notice 610", None, "Suspicious Transactions",
     ["Compliance"], "MLRO", "15 business days", "File suspicious reports within the deadline."),
    ("P2", "MAS Notice 610 (2024)", "MAS Notice 610", None, "Suspicious Transactions",
     ["Compliance", "Operations"], None, None, "Escalate suspicious activity at once."),
    ("P3", "MAS Notice 610 (2024)", "MAS Notice 610", None, "Suspicious Transactions",
     [], "Compliance", "  ", "Keep records of suspicious cases."),
    ("P4", "MAS Notice 626 (2023)", "MAS Notice 626", None, "Outsourcing",
     ["Board"], "Board", "Annual", "Material contracts need approval; see MAS 610 on strict reporting."),
    ("P5", "Basel III LCR (2024)", "Basel III", "LCR", None,
     ["Treasury"], "", "2025-01-31", "Hold liquid assets."),
]

PARAGRAPHS = [(p[0], p[1], p[8]) for p in OBLIGATIONS]


def messages(spark):
    return spark.createDataFrame(MESSAGES, schemas.RAW_MESSAGES)


def transactions(spark):
    return spark.createDataFrame(TRANSACTIONS, schemas.RAW_TRANSACTIONS)


def paragraphs(spark):
    return spark.createDataFrame(PARAGRAPHS, schemas.RAW_PARAGRAPHS)


def obligations(spark):
    return spark.createDataFrame(OBLIGATIONS, schemas.TAGGED_OBLIGATIONS)


def questions(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, start=1)],
                                 "question_id string, text string")


def corpus(spark):
    return Corpus(
        messages=messages(spark), transactions=transactions(spark), paragraphs=paragraphs(spark),
        tagged_messages=upgrade_risk(tag_messages(messages(spark))),
        tagged_transactions=tag_transactions(transactions(spark)),
        tagged_obligations=obligations(spark))


def text_of(lines, question_id=None):
    """Report lines of one question as one text."""
    rows = lines.where(f"question_id = '{question_id}'") if question_id else lines
    return "\n".join(r["line"] for r in rows.orderBy("section", "ord").collect())


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())
