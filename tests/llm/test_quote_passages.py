"""Quotations that repeat a part of a message, and messages at the same place."""

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerlens.llm import quote_threads as T
from ledgerlens.llm.queries import QUERIES
from tests.compare import connect, difference
from tests.llm.tables import collect

SCHEMA = "conv_id long, turn long, text string"


def test_partial_and_interleaved_quotes_find_their_originals(spark):
    rows = [
        (1, 0, "Para one here\n\nPara two\nis here\n\nPara three here"),
        (1, 1, "> Para one here\n\nanswer one\n\n> Para three here\n\nanswer three"),
        (1, 2, "> para two is here\nok two"),  # one paragraph, other line breaks
        (1, 3, "a quite different original"),
        (1, 4, "> Para three here\n>\n> a quite different original\nboth"),
        (1, 5, "> > Para one here\n> answer one\ndeeper"),
        (1, 6, "> answer three\nfine"),
        (1, 7, "> ok two\n> a quite different original\nno blank line between"),
        (1, 8, "> Para one here\n>\n> Para two\n> is here\ntwo paragraphs of three"),
        (1, 9, "> is here\none line of a paragraph"),
        (1, 10, "> never said\n> > fine\nonly the deeper level is known"),
        (1, 11, "> is nowhere\nnothing"), (2, 1, "> Para one here\nother conversation"),
    ]
    linked = collect(T.threads(spark.createDataFrame(rows, SCHEMA)))
    got = {(r["scope"], r["place"]): (r["parent"], r["matched"], r["n_levels"]) for r in linked}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {
        0: (None, None, 0), 1: (0, 1, 1), 2: (0, 1, 1), 3: (None, None, 0), 4: (3, 1, 1),
        5: (1, 1, 2), 6: (1, 1, 1), 7: (3, 1, 1), 8: (0, 1, 1), 9: (0, 1, 1), 10: (6, 2, 2),
        11: (None, None, 1)}
    assert got[2, 1] == (None, None, 1)
    assert {r["place"]: r["root"] for r in linked if r["scope"] == 1}[5] == 0


def test_every_message_stays(spark):
    rows = [
        (1, 0, "hello"), (1, 0, "hello"), (1, 0, "another hello"), (1, 1, "> another hello\nyes"),
        (1, 1, "> hello\nno"), (1, 2, ">> hello\n> no\nwhy"), (1, 2, None), (1, 2, None),
        (None, 0, "a"), (None, 0, "b"), (None, 0, "> a\nc"), (None, 0, "b"), (None, None, "a"),
        (1, None, "> hello\nx"), (1, None, "> hello\ny"),
    ]
    got = [(r["scope"], r["place"], r["reply"], r["parent"], r["root"], r["depth"])
           for r in collect(T.threads(spark.createDataFrame(rows, SCHEMA)))]
    assert sorted(got, key=str) == sorted([
        (1, 0, "hello", None, 0, 0), (1, 0, "hello", None, 0, 0),
        (1, 0, "another hello", None, 0, 0), (1, 1, "yes", 0, 0, 1), (1, 1, "no", 0, 0, 1),
        (1, 2, "why", 1, 0, 2), (1, 2, "", None, 2, 0), (1, 2, "", None, 2, 0),
        (None, 0, "a", None, 0, 0), (None, 0, "b", None, 0, 0), (None, 0, "b", None, 0, 0),
        (None, 0, "c", None, 0, 0), (None, None, "a", None, None, 0),
        (1, None, "x", None, None, 0), (1, None, "y", None, None, 0)], key=str)


# The registered SQL keeps one row per place; this one keeps all.
KEEPS_ALL = r"""WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(text, '') AS text,
    trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS own FROM conversations),
once AS (SELECT conv_id, turn, trim(regexp_replace(lower(min(text)), '\s+', ' ', 'g')) AS own
    FROM conversations GROUP BY conv_id, turn),
said AS (SELECT conv_id, own, min(turn) AS original FROM m WHERE own <> '' GROUP BY ALL),
asked AS (SELECT a.conv_id, a.turn, k.level, b.own FROM once AS a
    CROSS JOIN (VALUES (1), (2)) AS k(level)
    JOIN once AS b ON b.conv_id = a.conv_id AND b.turn = a.turn - k.level WHERE b.own <> ''),
found AS (SELECT conv_id, turn, min(level) AS matched, min_by(original, level) AS parent
    FROM asked JOIN said USING (conv_id, own) WHERE original < turn GROUP BY ALL),
levels AS (SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n_levels FROM asked GROUP BY ALL),
tree AS (SELECT conv_id, turn, turn AS root, 0 AS depth
    FROM once LEFT JOIN found USING (conv_id, turn)
    WHERE parent IS NULL AND conv_id IS NOT NULL AND turn IS NOT NULL
    UNION ALL SELECT f.conv_id, f.turn, t.root, t.depth + 1 FROM tree AS t
    JOIN found AS f ON f.conv_id = t.conv_id AND f.parent = t.turn)
SELECT conv_id, turn, coalesce(root, turn) AS root, coalesce(depth, 0) AS depth, parent,
    CAST(matched AS INTEGER) AS matched, coalesce(n_levels, 0) AS n_levels,
    sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS reply_sha256
FROM m LEFT JOIN tree USING (conv_id, turn) LEFT JOIN found USING (conv_id, turn)
LEFT JOIN levels USING (conv_id, turn)"""


def test_registered_query_keeps_all_rows_of_the_table(spark, tmp_path):
    rows = [(c, t, f"words {c} {(t or 0) % 3} {k}\nand {t}") for c in (1, 2, None)
            for t in (0, 1, 2, 3, None) for k in (0, 1, 1)]
    rows += [(3, 0, None), (3, 0, ""), (3, 1, "after nothing"), (3, 2, "AFTER  nothing"), (3, 3, "x")]
    pq.write_table(pa.table({"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows],
                             "text": [r[2] for r in rows]}), tmp_path / "conversations.parquet")
    query = QUERIES["op9_quote_threads"]
    assert query(spark, str(tmp_path)).count() == len(rows)
    assert difference(spark, connect(str(tmp_path)), query, KEEPS_ALL, str(tmp_path)) is None
