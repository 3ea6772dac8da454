"""Conversations from quotations: who answers what, without the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.rows import repeated
from ledgerlens.sources.storage import materialise, regrouped

QUOTE = r"^((?:[ \t]*>)+)"  # a line's quote marks
OTHER = "\x00"  # stands for a line of another level
RUN = r"\n?(?:\x00\n?)+"  # what parts the runs of a level, their paragraphs and lines
PARAGRAPH = RUN + r"|\n(?:[ \t]*\n)+"
LINE = r"[\n\x00]+"


def lines(text: Column) -> Column:
    """The lines of a text with ``level`` (number of quote marks) and what follows them."""
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"),
                       lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(line, QUOTE, "").alias("line")))


def normal(text: Column) -> Column:
    """Lower case, single blanks, no blanks around."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """The messages with ``reply`` (their own text), ``said``, ``quoted`` and ``n_levels``.

    What a message says, and what it quotes on one level, is cut into passages: all lines of
    that level in order, each run of lines that no other level interrupts, each paragraph of
    a run, and (``loose``) each line.  ``said`` has ``hash, whole`` of the message's own
    passages, ``quoted`` has ``level, loose, size, hash`` of those of each quote level; a
    hash is one of words that line breaks, blanks and case don't change.  The text that a
    level answers is one level deeper.  ``n_levels`` counts the quote levels that hold words.
    """
    parsed = messages.withColumn("__lines", lines(F.col("text")))

    def level_text(level: Column | int) -> Column:
        return F.array_join(F.transform(
            F.filter("__lines", lambda x: x["level"] == level), lambda x: x["line"]), "\n")

    def interrupted(level: Column | int) -> Column:
        return F.array_join(F.transform("__lines", lambda x: F.when(
            x["level"] == level, x["line"]).otherwise(OTHER)), "\n")

    def words(texts: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(texts, normal), lambda x: x != ""))

    def hashed(level: Column, text: Column, broken: Column) -> Column:
        blocks = words(F.concat(F.array(text), F.split(broken, RUN), F.split(broken, PARAGRAPH)))
        alone = F.instr(text, "\n") == 0
        tight = F.when(alone, words(F.array(text))).otherwise(blocks)
        loose = F.when(alone, F.array().cast("array<string>")).otherwise(
            F.array_except(words(F.split(broken, LINE)), blocks))

        def marked(which: Column, is_loose: bool) -> Column:
            return F.transform(which, lambda x: F.struct(
                level.alias("level"), F.lit(is_loose).alias("loose"),
                F.length(x).alias("size"), (x == normal(text)).alias("whole"),
                F.sha2(x, 256).alias("hash")))

        return F.concat(marked(tight, False), marked(loose, True))

    levels = F.array_sort(F.array_distinct(F.filter(
        F.transform("__lines", lambda x: x["level"]), lambda level: level > 0)))
    texts = F.transform(F.concat(F.array(F.lit(0)), levels), lambda level: F.struct(
        level.alias("level"), level_text(level).alias("text"), interrupted(level).alias("broken")))
    return parsed.withColumn("__texts", texts) \
        .withColumn("__all", F.flatten(F.transform(
            "__texts", lambda x: hashed(x["level"], x["text"], x["broken"])))) \
        .withColumn("reply", F.trim(F.regexp_replace(
            F.col("__texts")[0]["text"], r"(^\s+)|(\s+$)", ""))) \
        .withColumn("said", F.filter("__all", lambda x: x["level"] == 0)) \
        .withColumn("quoted", F.filter("__all", lambda x: x["level"] > 0)) \
        .withColumn("n_levels", F.size(F.array_distinct(F.col("quoted.level")))) \
        .drop("__lines", "__texts", "__all")


def link_quotes(messages: DataFrame, *, scope: str = "conv_id", order: str = "turn",
                text_column: str = "text") -> DataFrame:
    """``id, copies, scope, place, reply, n_levels, above, parent, matched`` of each message.

    Every message stays: equal ones (scope, order and text) are one row with their number in
    ``copies``, others at the same place are rows of their own.  ``id`` is a number that
    this call gives; ``above`` is the id of the original and ``parent`` its place.

    The passages of the quote levels are looked up by their hashes among the messages of the
    same scope.  The original of a passage is the first message whose whole reply it is, if
    that comes before, or else the first one that says it among other things; of several at
    one place the one whose text hashes lowest.  Of the passages that are found the
    outermost level counts, there the longest passage, then the earliest original; single
    lines of a passage count only if nothing larger is found.  ``matched`` is the level.  The
    originals are reduced to one row per scope and hash before the join, so a passage that
    many messages say or quote makes no pairs, and are shuffled anew, so that Spark can split
    one that very many quote.  Messages without a scope or an order never
    link.
    """
    once = messages.select(F.col(scope).alias("scope"), F.col(order).alias("place"),
                           F.col(text_column).alias("text")) \
        .groupBy("scope", "place", "text").agg(F.count(F.lit(1)).alias("copies"))
    parsed = materialise(
        passages(once).withColumn("tie", F.xxhash64("text")).drop("text")
        .withColumn("id", F.monotonically_increasing_id()), "passages")
    seat = F.struct("place", "tie", "id")
    said = parsed.where("scope is not null and place is not null") \
        .select("scope", "place", "tie", "id", F.explode("said").alias("s")) \
        .groupBy("scope", F.col("s.hash").alias("hash")) \
        .agg(F.min(F.when(F.col("s.whole"), seat)).alias("whole"), F.min(seat).alias("part"))
    asked = parsed.where("scope is not null and place is not null") \
        .select("scope", "place", "id", F.explode("quoted").alias("q")) \
        .select("scope", "place", "id", "q.level", "q.loose", "q.size", "q.hash")
    original = F.when(F.col("whole.place") < F.col("place"), F.col("whole")) \
        .when(F.col("part.place") < F.col("place"), F.col("part"))
    found = asked.join(regrouped(said, "scope", "hash"), ["scope", "hash"]).withColumn("original", original) \
        .where("original is not null").groupBy("id").agg(F.min(F.struct(
            "loose", "level", (-F.col("size")).alias("size"), "original")).alias("m"))
    return parsed.join(found, "id", "left").select(
        "id", "copies", "scope", "place", "reply", "n_levels", F.col("m.original.id").alias("above"),
        F.col("m.original.place").alias("parent"), F.col("m.level").alias("matched"))


def reply_trees(linked: DataFrame) -> DataFrame:
    """Add ``root`` (the place that a reply goes back to) and ``depth`` (replies on the way).

    Each step doubles how far a message looks up; only ids and numbers are joined, and only
    for messages that have not arrived.  Parents come before their replies, so the walk ends.
    """
    linked = materialise(linked, "links")
    up = materialise(linked.select(
        "id", F.coalesce("above", "id").alias("top"), F.coalesce("parent", "place").alias("root"),
        F.col("above").isNotNull().cast("int").alias("depth"),
        F.col("above").isNotNull().alias("open")), "replies")
    while up.where("open").limit(1).count():
        ahead = up.select(F.col("id").alias("top"), F.col("top").alias("higher"),
                          F.col("root").alias("above"), F.col("depth").alias("more"),
                          F.col("open").alias("further"))
        jumped = up.where("open").join(ahead, "top").select(
            "id", F.col("higher").alias("top"), F.col("above").alias("root"),
            (F.col("depth") + F.col("more")).alias("depth"), F.col("further").alias("open"))
        up = materialise(up.where("not open").unionByName(jumped), "replies")
    return linked.join(up.select("id", "root", "depth"), "id")


def threads(messages: DataFrame, *, scope: str = "conv_id", order: str = "turn",
            text_column: str = "text") -> DataFrame:
    """Messages without quotes in reply order, one row for each message.

    ``scope, place, root, depth, parent, n_levels, matched, reply``; reading by scope, root,
    depth and place gives each conversation, originals before their replies.  A message
    whose quotes match nothing starts a conversation of its own.  A null text is an empty
    message; a null scope or place never links; an empty table gives an empty result; other
    columns are ignored.
    """
    trees = reply_trees(link_quotes(messages, scope=scope, order=order, text_column=text_column))
    return repeated(trees, F.col("copies"), "copy") \
        .select("scope", "place", "root", "depth", "parent", "n_levels", "matched", "reply")


def as_mail(turns: DataFrame, *, scope: str = "conv_id", order: str = "turn",
            text_column: str = "text") -> DataFrame:
    """Turns as mail: each quotes the turn before it, and that one's own quote, nested.

    For tables without quotes.  Every turn becomes a mail; of several turns at one place the
    one with the smallest text is quoted.  Joins on scope and order, so one very long
    conversation is spread like many short ones.
    """
    every = turns.select(F.col(scope).alias("scope"), F.col(order).alias("place"),
                         F.col(text_column).alias("text"))
    once = every.where("scope is not null and place is not null") \
        .groupBy("scope", "place").agg(F.min("text").alias("text"))

    def earlier(by: int, name: str) -> DataFrame:
        return once.select("scope", (F.col("place") + by).alias("place"),
                           F.col("text").alias(name))

    def quoted(text: Column, marks: str) -> Column:
        return F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks), F.lit("\n"))

    both = every.join(earlier(1, "one"), ["scope", "place"], "left") \
        .join(earlier(2, "two"), ["scope", "place"], "left")
    return both.select(F.col("scope").alias(scope), F.col("place").alias(order), F.concat(
        F.coalesce(quoted(F.col("two"), "> > "), F.lit("")),
        F.coalesce(quoted(F.col("one"), "> "), F.lit("")),
        F.coalesce("text", F.lit(""))).alias(text_column))
