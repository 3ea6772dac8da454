"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import (
    decontaminate, digests, filter_audit, line_quality, mixing, ngram_join, personal_data,
    piece_coding, quote_threads, secret_ledger, sharding, spelling, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


@query()
def op2_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document, of its edited form, and their likeness."""
    return digests.edit_fingerprints(_table(spark, sf_dir, "documents"))


_SPLIT = """list_transform(range(1, len({k}_m) + 1), lambda i: {{'kind': '{k}', 'place': {n},
    'start': CAST(list_sum({k}_p[1:i]) + coalesce(list_sum(list_transform({k}_m[1:i - 1],
        lambda x: length(x))), 0) AS BIGINT), 'match': {k}_m[i]}})"""


def _secret_sql() -> str:
    quoted = {r.kind: r.pattern.replace("'", "''") for r in secret_ledger.RULES}
    parts = ", ".join(
        f"regexp_extract_all(t, '{p}') AS {k}_m, list_transform("
        f"string_split_regex(t, '{p}'), lambda x: length(x)) AS {k}_p" for k, p in quoted.items())
    lists = " || ".join(_SPLIT.format(k=k, n=i) for i, k in enumerate(quoted))
    long_enough = " AND ".join(
        f"(s.kind <> '{r.kind}' OR length(regexp_extract(s.match, '{quoted[r.kind]}', {r.group}))"
        f" >= {r.least})" for r in secret_ledger.RULES)
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda s: s.kind = '{k}')) AS BIGINT) AS n_{k}"
                       for k in quoted)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {parts} FROM d),
a AS (SELECT doc_id, list_filter({lists}, lambda s: {long_enough}) AS found FROM m),
b AS (SELECT doc_id, list_sort(list_transform(found, lambda s: {{'start': s.start,
    'place': s.place, 'kind': s.kind, 'stop': s.start + length(s.match)}})) AS spans FROM a),
c AS (SELECT *, array_to_string(list_transform(spans, lambda s: s.kind || ':' || s.start || ':'
    || s.stop), ',') AS spelled FROM b)
SELECT doc_id, {counts}, sha256(coalesce(spelled, '')) AS base_sha256,
    coalesce(spelled, '') AS spans FROM c"""


@query(_secret_sql())
def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, found once per content."""
    found = secret_ledger.secrets_by_path(
        _table(spark, sf_dir, "documents"), secret_ledger.new_ledger(spark))
    spelled = secret_ledger.spelled(F.col("spans"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, r.kind))).cast("long")
              .alias(f"n_{r.kind}") for r in secret_ledger.RULES]
    return found.select("doc_id", *counts, F.sha2(spelled, 256).alias("base_sha256"),
                        spelled.alias("spans"))


@query()
def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in each document."""
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    found = personal_data.personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("base_spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
              for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query()
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit(docs, _table(spark, sf_dir, "labels"))
    return line_quality.scored(docs, model).select(
        "doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= line_quality.THRESHOLD).cast("int").alias("predicted"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


@query()
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard_rows(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


_OWN = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(rf"""WITH RECURSIVE once AS (
    SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
m AS (SELECT conv_id, turn, {_OWN} AS own, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS reply
    FROM once),
said AS (SELECT conv_id, own, min(turn) AS original FROM m WHERE own <> '' GROUP BY ALL),
asked AS (SELECT a.conv_id, a.turn, k.level, b.own FROM m AS a
    CROSS JOIN (VALUES (1), (2)) AS k(level)
    JOIN m AS b ON b.conv_id = a.conv_id AND b.turn = a.turn - k.level WHERE b.own <> ''),
found AS (SELECT conv_id, turn, min(level) AS matched, min_by(original, level) AS parent
    FROM asked JOIN said USING (conv_id, own) WHERE original < turn GROUP BY ALL),
levels AS (SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n_levels FROM asked GROUP BY ALL),
tree AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM m LEFT JOIN found USING (conv_id, turn)
    WHERE parent IS NULL
    UNION ALL SELECT f.conv_id, f.turn, t.root, t.depth + 1 FROM tree AS t
    JOIN found AS f ON f.conv_id = t.conv_id AND f.parent = t.turn)
SELECT conv_id, turn, root, depth, parent, CAST(matched AS INTEGER) AS matched,
    coalesce(n_levels, 0) AS n_levels, sha256(reply) AS reply_sha256
FROM m JOIN tree USING (conv_id, turn) LEFT JOIN found USING (conv_id, turn)
LEFT JOIN levels USING (conv_id, turn)""")
def op9_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which message each message answers, found by what it quotes.

    The table has no quotes, so its turns are first written as mail that quotes the two
    turns before.
    """
    mail = quote_threads.as_mail(_table(spark, sf_dir, "conversations"))
    return quote_threads.threads(mail).select(
        F.col("scope").alias("conv_id"), F.col("place").alias("turn"), "root", "depth", "parent",
        "matched", "n_levels", F.sha2("reply", 256).alias("reply_sha256"))


@query()
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of each document."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def _audit_sql() -> str:
    letters = filter_audit.FILTERS
    orders = ", ".join(f"('{o}')" for o in filter_audit.orders())
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t
    FROM documents),
f AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)
        THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed FROM f),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good,
    count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT col0 AS filter_order, CAST(s AS INTEGER) AS step, substr(col0, CAST(s AS INTEGER), 1)
    AS letter FROM (VALUES {orders}), range(1, {len(letters) + 1}) AS r(s)),
p AS (SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (step = gone), 0) AS removed,
    coalesce(sum(n) FILTER (gone > step), 0) AS kept,
    coalesce(sum(n) FILTER (gone < step AND contains(failed, letter)), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (step = gone), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (step = gone), 0) AS toxic_lost
    FROM (SELECT *, CASE WHEN failed = '' THEN {len(letters) + 1} ELSE list_min(list_transform(
        string_split(failed, ''), lambda x: strpos(filter_order, x))) END AS gone
        FROM c, o) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM p"""


@query(_audit_sql())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, for each source."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"),
                                     _table(spark, sf_dir, "labels"))


@query()
def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    coded = piece_coding.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = piece_coding.decoded(coded.select("doc_id", "ids"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely right form of each word of the documents."""
    words = spelling.word_counts(_table(spark, sf_dir, "documents"))
    return spelling.spelling_forms(words)
