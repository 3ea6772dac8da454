"""Answer a table of questions end to end: route, search, report, trace, compare."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens import constants as K
from ledgerlens.functions.intents import all_intents, report_kind, route
from ledgerlens.operators import reports as R, search as S
from ledgerlens.operators.phrase_join import valid_pattern
from ledgerlens.sources.storage import regrouped


SEARCHES = (K.PII_SEARCH, K.AML_SEARCH, K.REG_SEARCH)


@dataclass(frozen=True)
class Corpus:
    """Raw and tagged tables the questions are asked of."""

    messages: DataFrame
    transactions: DataFrame
    paragraphs: DataFrame
    tagged_messages: DataFrame
    tagged_transactions: DataFrame
    tagged_obligations: DataFrame
    topic: R.Topic = field(default_factory=R.Topic)
    source_token: str = "610"
    # The obligations in two parts, if their texts are kept apart from the rest: what is
    # searched, and ``paragraph_id`` with the columns that only hits need.
    obligation_parts: tuple[DataFrame, DataFrame] | None = None
    # How to keep hits that several results read: (frame, name) -> frame.
    keep: Callable[[DataFrame, str], DataFrame] = lambda hits, name: hits


@dataclass(frozen=True)
class Found:
    """Hits of one domain as shown, for each distinct set of search keys.

    Questions that use the same keys have the same answer.  ``keys`` names each such set
    once, in place of a question, so counts, previews, reports and checks are computed per
    set; ``members`` tells which question has which set, and ``spread`` gives each question
    the result of its set.
    """

    keys: DataFrame
    members: DataFrame
    hits: DataFrame
    record_id: str
    order: Sequence[Column]

    def spread(self, per_set: DataFrame) -> DataFrame:
        """Rows per set of keys as rows per question.

        ``per_set`` is mostly an aggregate by set; it is shuffled anew, so that Spark can split
        a set that very many questions share.
        """
        named = regrouped(per_set.withColumnRenamed("question_id", "set_id"), "set_id")
        return self.members.join(named, "set_id").select(
            *[F.col(c) for c in per_set.columns])


def key_sets(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys of each distinct set, under the set's id, and ``question_id, set_id``."""
    members = keys.groupBy("question_id").agg(F.sha2(F.array_join(
        F.array_sort(F.collect_set("search_key")), "\x02"), 256).alias("set_id"))
    named = keys.join(members, "question_id").drop("question_id") \
        .withColumnRenamed("set_id", "question_id").dropDuplicates(["question_id", "search_key"])
    return named, members


def _find_raw(questions: DataFrame, corpus: Corpus, intent: str, limit: int) -> Found:
    """The first ``limit`` raw hits per question, weakly tagged."""
    keys, members = key_sets(S.raw_keys(questions))
    if intent == K.PII_SEARCH:
        record_id = "message_id"
        hits = S.match_raw(corpus.messages, record_id, "text", keys, S.RAW_MESSAGE_FIELDS)
        first = S.first_hits(R.shown_messages(S.weak_message_tags(hits)), record_id, limit)
    elif intent == K.AML_SEARCH:
        record_id = "transaction_id"
        hits = S.match_raw(corpus.transactions, record_id, "narrative", keys,
                           S.RAW_TRANSACTION_FIELDS)
        first = S.first_hits(R.shown_transactions(S.weak_transaction_tags(hits)), record_id, limit)
    else:
        # Without tags the whole paragraph stands in for the regulation.
        record_id = "paragraph_id"
        hits = S.match_raw(corpus.paragraphs, record_id, "paragraph_text", keys,
                           S.RAW_PARAGRAPH_FIELDS)
        first = S.first_hits(R.shown_obligations(S.raw_obligation_shape(hits)), record_id, limit)
    return Found(keys, members, first, record_id, [F.asc(record_id)])


def find(questions: DataFrame, corpus: Corpus, intent: str, mode: str,
         raw_limit: int = K.RAW_HIT_LIMIT) -> Found:
    """Search one domain for all questions."""
    if mode == K.MODE_RAW:
        return _find_raw(questions, corpus, intent, raw_limit)
    if intent == K.PII_SEARCH:
        keys, members = key_sets(S.message_keys(questions))
        hits = R.shown_messages(S.match_messages(corpus.tagged_messages, keys))
        return Found(keys, members, hits, "message_id", [F.asc("message_id")])
    if intent == K.AML_SEARCH:
        keys, members = key_sets(S.transaction_keys(questions))
        hits = R.shown_transactions(S.match_transactions(corpus.tagged_transactions, keys))
        return Found(keys, members, hits, "transaction_id", S.transaction_order())
    keys, members = key_sets(S.obligation_keys(questions))
    searched, details = corpus.obligation_parts or (corpus.tagged_obligations, None)
    hits = S.match_obligations(searched, keys, source_token=corpus.source_token)
    return Found(keys, members, R.shown_obligations(hits, details), "paragraph_id",
                 [F.asc("paragraph_id")])


def routed(questions: DataFrame, mode: str, strict: bool = False) -> DataFrame:
    """Questions with intent; structured obligation questions are marked in tagged mode.

    Raw mode reads a question as a pattern; one that is no pattern is marked as malformed.
    """
    kind = report_kind(F.col("text")) if mode == K.MODE_TAGGED else F.lit(None).cast("string")
    intent = route(F.col("text"), strict=strict)
    malformed = ~valid_pattern(F.col("text")) if mode == K.MODE_RAW else F.lit(False)
    return questions.select("question_id", "text", intent.alias("intent")).withColumns({
        "structured": (F.col("intent") == K.REG_SEARCH) & kind.isNotNull(),
        "malformed": F.col("intent").isin(*SEARCHES) & malformed})


def searching(asked: DataFrame, intent: str) -> DataFrame:
    """The questions of one intent that search (structured and malformed ones do not)."""
    return asked.where((F.col("intent") == intent) & ~F.col("structured")
                       & ~F.col("malformed")) \
        .select("question_id", "text")


@dataclass(frozen=True)
class Results:
    """Everything found for a table of questions in one mode."""

    mode: str
    routed: DataFrame
    intents: frozenset[str]
    found: dict[str, Found]
    corpus: Corpus

    def with_intent(self, intent: str) -> DataFrame:
        return self.routed.where(F.col("intent") == intent)

    @property
    def structured(self) -> DataFrame:
        return self.routed.where("structured")

    @property
    def malformed(self) -> DataFrame:
        return self.routed.where("malformed")

    @property
    def may_be_structured(self) -> bool:
        return self.mode == K.MODE_TAGGED and K.REG_SEARCH in self.intents


def _present(routed_questions: DataFrame) -> frozenset[str]:
    """The intents that occur; at most five values."""
    return frozenset(r["intent"] for r in routed_questions.select("intent").distinct().collect())


def together(*tasks: Callable) -> list:
    """What the tasks return.  They run at the same time, so that the small jobs of one do not
    wait for those of another."""
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [one.result() for one in [pool.submit(task) for task in tasks]]


def search_all(questions: DataFrame, corpus: Corpus, mode: str, *, strict: bool = False,
               intents: Sequence[str] = SEARCHES, raw_limit: int = K.RAW_HIT_LIMIT) -> Results:
    """Route the questions and search once every domain that someone asks about.

    Counts, reports, previews and traces all read the routed questions and the
    hits, so both are kept.
    """
    asked = corpus.keep(routed(questions, mode, strict), f"{mode}-questions")
    present = _present(asked)

    def search(intent: str) -> Found:
        one = find(searching(asked, intent), corpus, intent, mode, raw_limit)
        name = f"{mode}-{intent}".lower()
        hits, keys, members = together(
            lambda: corpus.keep(one.hits, name), lambda: corpus.keep(one.keys, f"{name}-keys"),
            lambda: corpus.keep(one.members, f"{name}-members"))
        return replace(one, hits=hits, keys=keys, members=members)

    wanted = [intent for intent in intents if intent in present]
    found = together(*[lambda intent=intent: search(intent) for intent in wanted])
    return Results(mode, asked, present, dict(zip(wanted, found)), corpus)


def search_both(questions: DataFrame, corpus: Corpus, **options) -> tuple[Results, Results]:
    """The questions searched in raw and in tagged mode."""
    return tuple(together(*[lambda mode=mode: search_all(questions, corpus, mode, **options)
                            for mode in (K.MODE_RAW, K.MODE_TAGGED)]))


def search_counts(results: Results) -> DataFrame:
    """``question_id, mode, intent, hit_count`` for the questions that search."""
    parts = [results.malformed.select(
        "question_id", F.lit(results.mode).alias("mode"), "intent",
        F.lit(0).cast("bigint").alias("hit_count"))]
    parts += [found.spread(S.counts_per_question(found.keys, found.hits)).select(
        "question_id", F.lit(results.mode).alias("mode"), F.lit(intent).alias("intent"),
        "hit_count") for intent, found in results.found.items()]
    return reduce(DataFrame.unionByName, parts)


def report(intent: str, found: Found) -> DataFrame:
    """Report lines of one domain, one report for each set of keys."""
    if intent == K.PII_SEARCH:
        return R.message_report(found.keys, found.hits)
    if intent == K.AML_SEARCH:
        return R.transaction_report(found.keys, found.hits, found.order)
    return R.obligation_report(found.keys, found.hits)


def _short_lines(results: Results) -> DataFrame:
    """Answers that are no search report: ``question_id, section, ord, line``."""
    first = [F.lit(0).alias("section"), F.lit("").alias("ord")]
    parts = [results.with_intent(K.OUT_OF_SCOPE).select(
        "question_id", *first, F.lit(K.OUT_OF_SCOPE_TEXT).alias("line")),
        results.malformed.select("question_id", *first, F.lit(K.MALFORMED_TEXT).alias("line"))]
    if results.may_be_structured:
        parts.append(_structured(results).select("question_id", *first, "line"))
    if K.SAR_DRAFT in results.intents:
        parts.append(R.sar_report(_drafts(results)))
    return reduce(DataFrame.unionByName, parts)


def answer_lines(results: Results) -> DataFrame:
    """The answer to every question as ``question_id, mode, section, ord, line``."""
    parts = [_short_lines(results)]
    parts += [found.spread(report(intent, found)) for intent, found in results.found.items()]
    return reduce(DataFrame.unionByName, parts).select(
        "question_id", F.lit(results.mode).alias("mode"), "section", "ord", "line")


def answer_tables(results: Results) -> tuple[DataFrame, DataFrame]:
    """Each answer once, and who has it.

    ``answer_id, mode, section, ord, line`` and ``question_id, mode, answer_id``.  An answer
    has the smallest id of the questions that share it.  However many questions ask for the
    same hits, their lines are stored once; joined on ``answer_id`` the tables are
    ``answer_lines``.
    """
    shared, own = [], []
    lines, members = [], []
    for fixed, line in ((results.with_intent(K.OUT_OF_SCOPE), K.OUT_OF_SCOPE_TEXT),
                        (results.malformed, K.MALFORMED_TEXT)):
        # One row: all of these questions have the same sentence.
        first = fixed.agg(F.min("question_id").alias("answer_id")).where("answer_id is not null")
        shared.append(first.select("answer_id", F.lit(0).alias("section"), F.lit("").alias("ord"),
                                   F.lit(line).alias("line")))
        members.append(fixed.select("question_id", F.lit(1).alias("one")).join(
            F.broadcast(first.withColumn("one", F.lit(1))), "one").drop("one"))
    if results.may_be_structured:
        own.append(_structured(results).select(
            "question_id", F.lit(0).alias("section"), F.lit("").alias("ord"), "line"))
    if K.SAR_DRAFT in results.intents:
        own.append(R.sar_report(_drafts(results)))
    for part in own:
        lines.append(part.withColumnRenamed("question_id", "answer_id"))
    alone = results.routed.where(F.col("structured") | (F.col("intent") == K.SAR_DRAFT))
    members.append(alone.select("question_id", F.col("question_id").alias("answer_id")))
    for intent, found in results.found.items():
        named = results.corpus.keep(found.members.groupBy("set_id").agg(
            F.min("question_id").alias("answer_id")), "answer-names")
        lines.append(report(intent, found).withColumnRenamed("question_id", "set_id")
                     .join(named, "set_id").select("answer_id", "section", "ord", "line"))
        members.append(found.members.join(named, "set_id").select("question_id", "answer_id"))
    mode = F.lit(results.mode).alias("mode")
    return (reduce(DataFrame.unionByName, shared + lines).select(
                "answer_id", mode, "section", "ord", "line"),
            reduce(DataFrame.unionByName, members).select("question_id", mode, "answer_id"))


def lengths_per_question(results: Results) -> DataFrame:
    """``question_id, answer_length``; a report is measured once for each set of keys."""
    parts = [answer_lengths(_short_lines(results))]
    parts += [found.spread(answer_lengths(report(intent, found)))
              for intent, found in results.found.items()]
    return reduce(DataFrame.unionByName, parts)


def _structured(results: Results) -> DataFrame:
    return R.structured_answers(results.structured, results.corpus.tagged_obligations,
                                results.corpus.topic)


def _drafts(results: Results) -> DataFrame:
    requests = R.draft_requests(results.with_intent(K.SAR_DRAFT))
    if results.mode == K.MODE_RAW:
        return R.raw_sar_drafts(requests)
    return R.sar_drafts(requests, results.corpus.tagged_transactions)


def _preview_list(entries: DataFrame) -> DataFrame:
    """``question_id, preview`` from ``question_id, rank, id, record``; a few per question."""
    entry = F.struct("rank", "id", "record")
    ordered = F.array_sort(F.collect_list(entry))
    return entries.groupBy("question_id").agg(F.transform(
        ordered, lambda e: F.struct(e["id"].alias("id"), e["record"].alias("record")))
        .alias("preview"))


PREVIEW_TYPE = "array<struct<id:string,record:string>>"


def previews(found: Found, n: int = K.PREVIEW_ROWS) -> DataFrame:
    """``question_id, preview`` of each set of keys: id and JSON record of its first hits."""
    shown = [c for c in found.hits.columns if c != "search_key"]
    top = S.top_per_question(found.keys, found.hits, found.order, n)
    return _preview_list(top.select(
        "question_id", "rank", F.col(found.record_id).alias("id"),
        F.to_json(F.struct(*shown)).alias("record")))


def _structured_trace(results: Results) -> DataFrame:
    """Trace of the structured obligation questions; the preview is the same for all."""
    rows = results.corpus.topic.rows(results.corpus.tagged_obligations)
    examples = R.obligation_examples(rows, K.PREVIEW_ROWS)
    first = _preview_list(examples.select(
        F.lit(1).alias("question_id"), F.col("paragraph_id").alias("rank"),
        F.col("paragraph_id").alias("id"), F.to_json(F.struct("*")).alias("record")))
    # One row at most.
    return _structured(results).withColumn("one", F.lit(1)).join(
        F.broadcast(first.withColumnRenamed("question_id", "one")), "one", "left").select(
        "question_id", F.lit(K.REG_SEARCH).alias("intent"),
        F.lit(K.TOOL_STRUCTURED_REG).alias("tool_name"), "hit_count", "preview")


def answer_trace(results: Results) -> DataFrame:
    """Intent, tool, hit count, no-result flag and preview per question."""
    mode = results.mode
    parts = [results.with_intent(K.OUT_OF_SCOPE).select(
        "question_id", F.lit(K.OUT_OF_SCOPE).alias("intent"),
        F.lit(None).cast("string").alias("tool_name"), F.lit(0).cast("bigint").alias("hit_count"),
        F.lit(None).cast(PREVIEW_TYPE).alias("preview"))]
    tools = F.create_map(*[F.lit(x) for intent in SEARCHES
                           for x in (intent, K.TOOL_NAMES[intent, mode])])
    parts.append(results.malformed.select(
        "question_id", "intent", tools[F.col("intent")].alias("tool_name"),
        F.lit(0).cast("bigint").alias("hit_count"),
        F.lit(None).cast(PREVIEW_TYPE).alias("preview")))
    for intent, found in results.found.items():
        counts = S.counts_per_question(found.keys, found.hits)
        parts.append(found.spread(counts.join(previews(found), "question_id", "left")).select(
            "question_id", F.lit(intent).alias("intent"),
            F.lit(K.TOOL_NAMES[intent, mode]).alias("tool_name"), "hit_count", "preview"))
    if results.may_be_structured:
        parts.append(_structured_trace(results))
    if K.SAR_DRAFT in results.intents:
        record = F.to_json(F.struct("transaction_id", "sar_draft"))
        parts.append(_drafts(results).select(
            "question_id", F.lit(K.SAR_DRAFT).alias("intent"),
            F.lit(K.TOOL_NAMES[K.SAR_DRAFT, mode]).alias("tool_name"),
            F.lit(1).cast("bigint").alias("hit_count"),
            F.array(F.struct(F.col("transaction_id").alias("id"), record.alias("record")))
            .alias("preview")))
    return reduce(DataFrame.unionByName, parts).select(
        "question_id", F.lit(mode).alias("mode"), "intent", "tool_name", "hit_count",
        (F.col("hit_count") == 0).alias("no_results"),
        F.coalesce("preview", F.array().cast(PREVIEW_TYPE)).alias("preview"))


def ask(question: str, corpus: Corpus, mode: str = K.MODE_TAGGED, *,
        strict: bool = False) -> DataFrame:
    """Answer one question: its lines in reading order."""
    spark = corpus.messages.sparkSession
    questions = spark.createDataFrame([("question", question)], "question_id string, text string")
    return answer_lines(search_all(questions, corpus, mode, strict=strict)) \
        .orderBy("section", "ord").select("line")


def answer_lengths(lines: DataFrame) -> DataFrame:
    """Characters of each answer as one text, newlines between lines included."""
    return lines.groupBy("question_id").agg(
        (F.sum(F.length("line")) + F.count("*") - 1).alias("answer_length"))


def compare_modes(questions: DataFrame, corpus: Corpus, *, strict: bool = False) -> DataFrame:
    """Raw against tagged mode, one row per question."""
    sides = []
    both = search_both(questions, corpus, strict=strict)
    for results, prefix in zip(both, ("raw", "tagged")):
        trace, lengths = answer_trace(results), lengths_per_question(results)
        sides.append(trace.join(lengths, "question_id", "left").select(
            "question_id",
            F.col("intent").alias(f"{prefix}_intent"),
            F.col("tool_name").alias(f"{prefix}_tool"),
            F.col("hit_count").alias(f"{prefix}_hits"),
            F.col("no_results").alias(f"{prefix}_no_results"),
            F.col("answer_length").alias(f"{prefix}_answer_length")))
    return sides[0].join(sides[1], "question_id", "full_outer")


def fan_out(questions: DataFrame, corpus: Corpus) -> DataFrame:
    """Hits per question and intent, with every intent the question mentions."""
    spread = questions.select("question_id", "text",
                              F.explode(all_intents(F.col("text"))).alias("intent"))
    spread = corpus.keep(spread, "spread-questions")
    parts = [spread.where(~F.col("intent").isin(*SEARCHES)).select(
        "question_id", F.lit(0).cast("bigint").alias("hit_count"), "intent")]
    for intent in sorted(_present(spread) & set(SEARCHES)):
        found = find(spread.where(F.col("intent") == intent), corpus, intent, K.MODE_TAGGED)
        parts.append(found.spread(S.counts_per_question(found.keys, found.hits))
                     .withColumn("intent", F.lit(intent)))
    return reduce(DataFrame.unionByName, parts)
