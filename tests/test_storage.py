import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.tagging import tag_messages, tag_obligations, tag_transactions
from ledgerlens.operators.vectors import nearest_neighbours
from ledgerlens.sources import schemas, storage
from ledgerlens.streaming.tagging import read_tagged_stream, tag_stream
from tests import fixtures as X

CSV = ('﻿message_id,channel,date,text\r\n'
       'M1,email,15-10-2025,"He said ""hi"", then left"\r\n'
       'M2,app_chat,31-12-2025,"two\nlines, é"\r\n')


@pytest.fixture()
def raw_csv(tmp_path):
    path = tmp_path / "data" / "messages.csv"
    path.parent.mkdir()
    path.write_bytes(CSV.encode("utf-8"))
    return path


def test_csv_with_bom_quotes_and_line_breaks(spark, raw_csv):
    df = storage.read_messages(spark, str(raw_csv))
    rows = {r["message_id"]: r for r in df.collect()}
    assert df.schema == schemas.RAW_MESSAGES
    assert rows["M1"]["text"] == 'He said "hi", then left'
    assert rows["M2"]["text"].replace("\r", "") == "two\nlines, é"
    dates = {r["message_id"]: str(r["date"]) for r in storage.with_date(df).collect()}
    assert dates == {"M1": "2025-10-15", "M2": "2025-12-31"}


def test_first_existing_candidate(spark, raw_csv, tmp_path):
    paths = storage.candidates(str(tmp_path), "messages.csv")
    assert storage.first_existing(spark, paths) == str(raw_csv)
    assert storage.first_existing(spark, [str(tmp_path / "no")]) is None
    assert storage.read_messages(spark, *paths).count() == 2


def test_missing_files_read_as_empty_tables(spark, tmp_path):
    absent = str(tmp_path / "absent.csv")
    assert storage.read_transactions(spark, absent).schema == schemas.RAW_TRANSACTIONS
    paragraphs = storage.read_paragraphs(spark, absent)
    assert paragraphs.count() == 0 and "article" in paragraphs.columns
    assert storage.read_tagged(spark, absent, schemas.TAGGED_MESSAGES).count() == 0
    assert storage.read_vectors(spark, absent).count() == 0


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("narrative,transaction_id,extra\nrent,T1,x\n")
    row = storage.read_transactions(spark, str(path)).first()
    assert (row["transaction_id"], row["narrative"], row["amount_sgd"]) == ("T1", "rent", None)


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_tagged_tables_round_trip(spark, tmp_path, file_format):
    tables = [
        (tag_messages(X.messages(spark)), schemas.TAGGED_MESSAGES),
        (tag_transactions(X.transactions(spark)), schemas.TAGGED_TRANSACTIONS),
        (tag_obligations(X.paragraphs(spark)), schemas.TAGGED_OBLIGATIONS),
    ]
    for number, (df, schema) in enumerate(tables):
        path = str(tmp_path / f"t{number}")
        storage.write_tagged(df, path, file_format)
        back = storage.read_tagged(spark, path, schema, file_format)
        assert back.columns == [f.name for f in schema.fields]
        key = back.columns[0]
        assert sorted(map(tuple, back.select(df.columns).collect()), key=lambda r: r[0]) == \
            sorted(map(tuple, df.collect()), key=lambda r: r[0]), key


def test_partitioned_tables_prune(spark, tmp_path):
    path = str(tmp_path / "by_risk")
    storage.write_tagged(tag_messages(X.messages(spark)), path, partition_by=["risk_flag"])
    high = storage.read_tagged(spark, path, schemas.TAGGED_MESSAGES).where("risk_flag = 'High'")
    assert X.column(high, "message_id") == ["M03", "M05"]
    assert "PartitionFilters: [isnotnull(risk_flag" in \
        high._jdf.queryExecution().executedPlan().toString()


def test_stored_lists_of_another_program(spark, tmp_path):
    path = tmp_path / "tagged.csv"
    path.write_text("message_id,masked_text,pii_entities,risk_flag,original_text\n"
                    "M1,m,\"['NRIC', 'Account Number']\",High,o\nM2,m,,Low,o\n")
    rows = {r["message_id"]: r["pii_entities"] for r in storage.read_tagged(
        spark, str(path), schemas.TAGGED_MESSAGES, "csv").collect()}
    assert rows == {"M1": ["NRIC", "Account Number"], "M2": []}


def test_master_export(spark, tmp_path):
    export = storage.master_export({
        "tagged_pii": (tag_messages(X.messages(spark)), "message_id"),
        "tagged_aml": (tag_transactions(X.transactions(spark)), "transaction_id")})
    payload = json.loads(export.where("record_id = 'M01'").first()["payload"])
    assert payload["pii_entities"] == ["NRIC", "Account Number"]
    path = str(tmp_path / "export")
    storage.write_master_export(export, path)
    back = spark.read.json(path)
    assert back.count() == len(X.MESSAGES) + len(X.TRANSACTIONS)
    assert {"table_name", "record_id", "payload", "generated_at"} == set(back.columns)


def test_vectors_are_built_once(spark, tmp_path):
    path, built = str(tmp_path / "vectors"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], schemas.VECTORS)

    for _ in range(2):
        table = storage.ensure_vectors(spark, path, build)
    assert len(built) == 1
    query = spark.createDataFrame([("q", [0.9, 0.0])], schemas.VECTORS)
    assert nearest_neighbours(table, query, 1).first()["id"] == "a"


def test_materialise_reads_back_the_same_rows(spark):
    df = tag_messages(X.messages(spark))
    kept = storage.materialise(df, "test")
    assert kept.schema.names == df.schema.names
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert "<SALARY>" not in kept._jdf.queryExecution().optimizedPlan().toString()


# The second file has its columns in another order, one more, and a line break in a field.
FIRST = 'message_id,channel,date,text\nM1,email,15-10-2025,"NRIC S1234567A, call 91234567"\n'
SECOND = ('date,text,note,message_id,channel\n'
          '16-10-2025,"line one\nline two, salary 5000",x,M2,app_chat\n'
          '17-10-2025,"said ""hi""",,M3,email\n')


class Stream:
    def __init__(self, spark, folder):
        self.spark = spark
        self.source, self.target, self.checkpoint = (
            str(folder / n) for n in ("in", "out", "checkpoint"))
        os.makedirs(self.source)
        self.schema = tag_messages(X.messages(spark)).schema

    def add(self, name, content):
        with open(f"{self.source}/{name}", "w", newline="") as file:
            file.write(content)

    def run(self, **options):
        tag_stream(self.spark, self.source, schemas.RAW_MESSAGES, tag_messages, self.target,
                   self.checkpoint, **options).awaitTermination()
        rows = read_tagged_stream(self.spark, self.target, self.schema)
        assert rows.schema.names == self.schema.names
        return sorted(tuple(map(str, r)) for r in rows.collect())

    def batch(self, *names):
        parts = [tag_messages(storage.read_messages(self.spark, f"{self.source}/{n}"))
                 for n in names]
        return sorted(tuple(map(str, r)) for part in parts for r in part.collect())


@pytest.mark.parametrize("options", [{}, {"files_at_once": 1}])
def test_stream_equals_batch(spark, tmp_path, options):
    stream = Stream(spark, tmp_path)
    stream.add("a.csv", FIRST)
    assert stream.run(**options) == stream.batch("a.csv")
    assert stream.run(**options) == stream.batch("a.csv")  # nothing new
    stream.add("b.csv", SECOND)
    stream.add("c.csv", FIRST.replace("M1", "M4"))
    stream.add("empty.csv", "")
    got = stream.run(**options)
    assert got == stream.batch("a.csv", "b.csv", "c.csv") and len(got) == 4


def test_replayed_batch_gives_its_rows_once(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.add("a.csv", FIRST)
    stream.run()
    stream.add("b.csv", SECOND)
    before = stream.run()
    # As after a failure between writing the rows and recording that the batch is done.
    for name in ("1", ".1.crc"):
        os.remove(f"{stream.checkpoint}/commits/{name}")
    assert stream.run() == before == stream.batch("a.csv", "b.csv")


def test_stream_of_tagged_fixture_rows(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    X.messages(spark).write.mode("overwrite").option("header", True).option("escape", '"') \
        .csv(stream.source)
    want = sorted(tuple(map(str, r)) for r in tag_messages(X.messages(spark)).collect())
    assert stream.run() == want


def test_tagged_stream_before_its_first_batch(spark, tmp_path):
    assert read_tagged_stream(spark, str(tmp_path / "none"), schemas.RAW_MESSAGES).count() == 0


def test_stored_table_follows_its_input(spark, tmp_path):
    from ledgerlens.sources import views
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")

    def stored():
        documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
        return sorted(tuple(r) for r in views.stored(
            documents.withColumn("n", F.col("doc_id") * 2), str(tmp_path), "test",
            ["documents"]).collect())

    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert stored() == [(1, "a", 2)]
    paths = set(views._stored.values())
    assert stored() == [(1, "a", 2)] and set(views._stored.values()) == paths
    rows.withColumn("doc_id", F.lit(5).cast("long")).write.mode("overwrite") \
        .parquet(f"{tmp_path}/documents.parquet")
    assert stored() == [(5, "a", 10)]


def test_snapshot_sees_files_of_inner_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    first = storage.snapshot(spark, path)
    assert storage.snapshot(spark, path) == first
    spark.range(1).withColumn("p", F.lit(1)).write.mode("append").partitionBy("p").parquet(path)
    assert storage.snapshot(spark, path) != first


def test_a_copied_column_is_written_only_where_it_differs(spark, tmp_path):
    from ledgerlens.sources import views
    rows = [(1, "a", "a"), (2, "b", "x"), (3, None, None), (4, "c", None), (5, None, "d")]
    spark.range(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.createDataFrame(rows, "id long, original string, masked string")
    got = views.stored(df, str(tmp_path), "copied", ["documents"], ("masked", "original"))
    assert sorted(tuple(r) for r in got.collect()) == rows and got.schema == df.schema
    path = next(p for k, p in views._stored.items() if k[1:3] == (str(tmp_path), "copied"))
    assert {r["id"]: r["masked"] for r in spark.read.parquet(path).collect()} == {
        1: None, 2: "x", 3: None, 4: None, 5: "d"}


def test_texts_of_obligations_are_not_written(spark, tmp_path):
    from ledgerlens import constants as K
    from ledgerlens.operators import answers as A
    from ledgerlens.sources import views
    texts = ["licensed under the law", "regulations say: suspicious matters", None]
    spark.createDataFrame([(i, t, "src1", "en") for i, t in enumerate(texts)],
                          "doc_id long, text string, source string, lang string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)],
                          "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "event_id long, ts timestamp, event_type string, value double, "
                          "props string").write.parquet(f"{tmp_path}/events.parquet")
    corpus = views.corpus(spark, str(tmp_path), [K.REG_SEARCH])
    questions = spark.createDataFrame([("q", "regulations say: suspicious")],
                                      "question_id string, text string")
    found = A.find(questions, corpus, K.REG_SEARCH, K.MODE_TAGGED)
    assert sorted((r["paragraph_id"], r["owner"]) for r in found.hits.collect()) == [
        ("1", "Compliance"), ("1", "Operations")]  # one for each label
    assert not [k for k in views._stored if k[1] == str(tmp_path)]
    whole = sorted(map(str, views.obligations(spark, str(tmp_path)).collect()))
    assert len(whole) == 4
