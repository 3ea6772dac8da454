"""The domain tables as views over the generated test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.detectors import TABLES
from ledgerlens.functions.lists import compact
from ledgerlens.operators.answers import SEARCHES, Corpus
from ledgerlens.operators.reports import Topic
from ledgerlens.operators.tagging import tag_messages, upgrade_risk
from ledgerlens.sources.storage import materialise, path_exists, snapshot, write_shared

# The part of the obligations that plays the structured topic in the test tables.
TABLE_TOPIC = Topic(source_document="src1", risk_type="en")
TABLE_SOURCE_TOKEN = "src1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"), F.col("source").alias("channel"),
        "text")


def tagged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_messages(messages(spark, sf_dir), TABLES)


def tagged_messages_upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upgrade_risk(tagged_messages(spark, sf_dir))


def prior_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_id, prior``: toxic reads High, low quality Medium, the rest Low."""
    prior = F.when(F.col("toxic") == 1, "High").when(F.col("quality") == 0, "Medium") \
        .otherwise("Low")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("message_id"), prior.alias("prior"))


def messages_with_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each message with its prior risk, null without a label.

    Entities are found before the join, so no text is shuffled.
    """
    entities = tagged_messages(spark, sf_dir).select("message_id", "pii_entities")
    return entities.join(prior_risk(spark, sf_dir), "message_id", "left") \
        .withColumnRenamed("prior", "risk_flag")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("value").alias("amount_sgd"),
        F.concat_ws(" ", "event_type", "props").alias("narrative"),
    )


def tagged_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score from the amount; tags from the event type and the amount."""
    amount, kind = F.col("amount_sgd"), F.element_at(F.split("narrative", " "), 1)
    tags = compact([
        (F.lit(True), kind),
        (amount > 80, "high_value"),
        ((kind == "error") & (amount > 50), "crypto"),
        ((kind == "purchase") & (amount >= 9) & (amount < 10), "structuring"),
    ])
    return transactions(spark, sf_dir).select(
        "transaction_id",
        F.col("narrative").alias("masked_narrative"),
        tags.alias("aml_tags"),
        F.least(F.lit(10.0), amount / 10).alias("risk_score"),
        F.col("narrative").alias("original_narrative"),
        "amount_sgd", "date",
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("paragraph_id"),
        F.col("source").alias("source_document"), F.col("text").alias("paragraph_text"))


def obligations(spark: SparkSession, sf_dir: str, *, with_text: bool = True) -> DataFrame:
    """Owner and deadline from the labels; unlabelled documents have neither.

    Leave the text out where only the metadata is measured: the join with the
    labels then moves a few short columns instead of whole documents.
    """
    documents, details = obligation_parts(spark, sf_dir)
    return documents.join(details, "paragraph_id", "left").select(
        "paragraph_id", "source_document", "regulation", "risk_type", "owner", "deadline",
        *(["original_text"] if with_text else []))


def obligation_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as obligations, and owner and deadline of the labelled ones by their id."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("paragraph_id"),
        F.col("source").alias("source_document"), F.col("source").alias("regulation"),
        F.col("lang").alias("risk_type"), F.col("text").alias("original_text"))
    labels = table(spark, sf_dir, "labels")
    owner = F.when(F.col("quality") == 1, "Compliance").when(F.col("quality") == 0, "Operations")
    deadline = F.when(F.col("toxic") == 1, "Annual").when(F.col("toxic") == 0, "")
    return documents, labels.select(F.col("doc_id").cast("string").alias("paragraph_id"),
                                    owner.alias("owner"), deadline.alias("deadline"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


# Questions are patterns in raw mode; these use it.
PATTERN_QUESTIONS = (
    ("p1", "messages|token = "),
    ("p2", "structuring|error .*7"),
    ("p3", "suspicious transactions|licensed under"),
)

# No patterns: raw mode answers these without a search.
MALFORMED_QUESTIONS = (
    ("x1", "messages (urgent"),
    ("x2", "suspicious transactions *?+"),
    ("x3", "[regulations of mas 610"),
)


def golden_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*K.GOLDEN_QUESTIONS, *PATTERN_QUESTIONS,
                                  *MALFORMED_QUESTIONS],
                                 "question_id string, text string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions, what users say in conversations, and one report request per
    error event."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws("-", F.lit("u"), F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("question_id"), "text")
    requests = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("question_id"),
        F.concat(F.lit("Draft a SAR for transaction t"), F.col("event_id").cast("string"))
        .alias("text"))
    return golden_questions(spark).unionByName(said).unionByName(requests)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions: each asks which messages quote it."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b-"), F.col("item_id").cast("string")).alias("question_id"), "text")


def passage_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of messages and one of paragraphs for each benchmark passage.

    In raw mode each is a pattern of its own: the words that route it, or the passage.
    """
    said = passages(spark, sf_dir)
    return said.select(F.concat(F.lit("m"), "question_id").alias("question_id"),
                       F.concat(F.lit("pii|"), "text").alias("text")).unionByName(
        said.select(F.concat(F.lit("r"), "question_id").alias("question_id"),
                    F.concat(F.lit("suspicious transactions|"), "text").alias("text")))


# Questions whose reports get faults, so that the checks have something to find.
CHECKED_QUESTIONS = (
    ("v1", "Which messages show a phone number?"),
    ("v2", "Show messages with phone contacts."),
    ("v3", "Messages that give a phone number"),
    ("v5", "pii: phone"),
)


def checked_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*K.GOLDEN_QUESTIONS, *CHECKED_QUESTIONS],
                                 "question_id string, text string")


# Paths of the tagged tables this session has written.
_stored: dict[tuple[str, ...], str] = {}


def stored(df: DataFrame, sf_dir: str, name: str, inputs: Sequence[str],
           copied: tuple[str, str] | None = None) -> DataFrame:
    """A tagged table as a deployment has it: written once, read by every question.

    It is written anew when a file of its inputs has changed.  The first column of
    ``copied`` is written only where it differs from the second.
    """
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, sf_dir, name,
           *[snapshot(spark, f"{sf_dir}/{table}.parquet") for table in inputs])
    written = df
    if copied is not None:
        copy, of = (F.col(c) for c in copied)
        written = df.withColumn("__same", copy.eqNullSafe(of)) \
            .withColumn(copied[0], F.when(~F.col("__same"), copy))
    if key not in _stored or not path_exists(spark, _stored[key]):
        _stored[key] = write_shared(written, name)
    written_table = spark.read.schema(written.schema).parquet(_stored[key])
    if copied is not None:
        written_table = written_table.withColumn(copied[0], F.when(F.col("__same"), of).otherwise(copy))
    return written_table.select(*df.columns)


def corpus(spark: SparkSession, sf_dir: str, intents: Sequence[str] = SEARCHES) -> Corpus:
    """All tables; tagged messages are stored if the intents search them.

    Transactions and obligations are left as they are: the tags of the first are a cheap
    projection, the texts of the second are searched where they lie.
    """
    tagged = tagged_messages_upgraded(spark, sf_dir)
    return Corpus(
        messages=messages(spark, sf_dir),
        transactions=transactions(spark, sf_dir),
        paragraphs=paragraphs(spark, sf_dir),
        tagged_messages=stored(tagged, sf_dir, "tagged-messages", ["documents"],
                               ("masked_text", "original_text"))
        if K.PII_SEARCH in intents else tagged,
        tagged_transactions=tagged_transactions(spark, sf_dir),
        tagged_obligations=obligations(spark, sf_dir),
        obligation_parts=obligation_parts(spark, sf_dir),
        topic=TABLE_TOPIC,
        source_token=TABLE_SOURCE_TOKEN,
        keep=materialise,
    )
