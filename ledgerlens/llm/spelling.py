"""Words one letter apart, by permuterm rotations.

A word is closed by a terminator and turned in all ways.  Two words that differ in one
replaced letter have rotations that differ in the last letter alone; if a word lacks a letter
of another, one of its whole rotations is a rotation of the other without the last letter.
So sorted rotations bring all words that are near each other together under one prefix, and a
prefix has no more words than there are letters to follow it, and one.

A rotation's prefix is written as two 64-bit fingerprints, so that a word of n letters costs
2n + 1 short rows and not as many copies of itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlens.llm.batches import STEP
from ledgerlens.llm.hashing import mixed
from ledgerlens.llm.ngram_join import rooted
from ledgerlens.llm.rows import ranked
from ledgerlens.sources.storage import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGED = 97  # one run in so many loses a letter
LEAST_LETTERS = 5
LEAST_TIMES = 3
AHEAD = 2  # a form occurs at least so many times as often
HELD = 1 << 17  # distinct words that a task counts before it passes them on
BLOCK = 1 << 20  # code points of a text that are searched for runs at once
LETTERS_AT_ONCE = 1 << 16  # letters of the words that are turned at once
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
WHOLE, FIRST, AGAIN = 0, 1, 2  # a whole rotation; one without its last letter, ...


def runs(text: str, block: int = BLOCK) -> Counter[str]:
    """How often a text has each run of letters, in lower case."""
    found: Counter[str] = Counter()
    start = 0
    while start < len(text):
        end = min(start + block, len(text))
        while end < len(text) and RUN.match(text, end):
            end = RUN.match(text, end).end()
        found.update(RUN.findall(text, start, end))
        start = end
    lower: Counter[str] = Counter()
    for run, n in found.items():
        lower[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return lower


def seen_word(prefix: int, run: str) -> str:
    """A lower-case run as it counts: in one of ``DAMAGED`` cases it loses a letter.

    ``prefix`` is the checksum of what stands before the run, its document's id and a colon.
    """
    h = zlib.crc32(run.encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """``word, n`` of all words of enough ``letters`` that occur often enough.

    Each task adds up its own counts before they are shuffled.  A null text has no words; a
    null id is spelled as nothing; rows that repeat count each time; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc_id"),
                       F.col(text_column).alias("text")).where(F.col("text").isNotNull())

    def flushed(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
            names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for found, n in runs(text).items():
                    word = seen_word(prefix, found)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) > HELD:
                    yield flushed(held)
                    held = Counter()
        yield flushed(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word") \
        .agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def rotations(words: list[str]) -> tuple[np.ndarray, ...]:
    """The rotations of all words: word number, kind and two fingerprints of each.

    Kind ``WHOLE`` is a whole rotation.  The others are rotations without their last letter,
    ``FIRST`` if it differs from the letter before it in the word and ``AGAIN`` if not: taking
    off either of two equal neighbours gives the same shorter word, which is counted once.
    """
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    points = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    place = np.arange(len(points)) - first
    letter = np.flatnonzero(place < size - 1)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == points[:-1]) & (place[1:] > 0)
    whole, part = [], []
    for base in _BASES:
        power = np.full(int(sizes.max(initial=1)) + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        value = mixed(points.astype(np.uint64) + np.uint64(base & 0xFFFF))
        # Sum of value * power of the place in the word, before each place.
        weighted = value * power[place]
        before = np.cumsum(weighted) - weighted
        head = before - before[first]
        total = np.add.reduceat(weighted, np.cumsum(sizes) - sizes)[word] if len(words) else head
        inverse = np.full(len(power), pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)

        def turned(start: np.ndarray, tail: np.ndarray, front: np.ndarray) -> np.ndarray:
            """Fingerprint of what follows ``start`` (``tail``), then the word's front."""
            return tail * inverse[start] + front * power[size_of - start]

        size_of = size
        whole.append(mixed(turned(place, total - head, head)))
        size_of = size[letter]
        after = place[letter] + 1
        part.append(mixed(turned(after, total[letter] - head[letter] - weighted[letter],
                                 head[letter])))
    return (np.concatenate([word, word[letter]]),
            np.concatenate([np.full(len(points), WHOLE), np.where(again[letter], AGAIN, FIRST)]),
            *[np.concatenate([w, p]) for w, p in zip(whole, part)])


def _rotated(words: DataFrame) -> DataFrame:
    """``high, low, kind, id`` of all rotations of ``id, word``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            for at in np.split(np.arange(len(texts)), np.flatnonzero(
                    np.diff(ends // LETTERS_AT_ONCE)) + 1) if texts else ():
                number, kind, high, low = rotations([texts[i] for i in at.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                     pa.array(kind.astype(np.int32)), pa.array(ids[at][number])],
                    names=["high", "low", "kind", "id"])

    return words.select("id", "word").mapInArrow(run, "high long, low long, kind int, id long")


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: for words that have near ones, their number and the least id.

    ``words`` has ``id, word``, all distinct.  Rotations are sorted by fingerprint; a group
    holds at most one whole rotation and one word for each letter, whatever the data.  Each
    row of a group gets the number of its neighbours and the least of them from sums and
    minima over the group; no pairs are made.
    """
    group = Window.partitionBy("high", "low").orderBy("id") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part, first = F.col("kind") != WHOLE, F.col("kind") == FIRST
    grouped = _rotated(words).withColumns({
        "parts": F.count(F.when(part, 1)).over(group),
        "firsts": F.count(F.when(first, 1)).over(group),
        "whole": F.min(F.when(~part, F.col("id"))).over(group),
        "best": F.first(F.when(part, F.col("id")), ignorenulls=True).over(group),
        "second": F.nth_value(F.when(part, F.col("id")), 2, ignoreNulls=True).over(group),
        "best_first": F.min(F.when(first, F.col("id"))).over(group)})
    # A whole rotation is near all whose last letter is the first of its kind; a rotation
    # without its letter is near all others alike and, in that case, the whole one.
    other = F.when(F.col("best") == F.col("id"), F.col("second")).otherwise(F.col("best"))
    longer = F.when(first, F.col("whole"))
    return grouped.select(
        "id",
        F.when(part, F.col("parts") - 1 + longer.isNotNull().cast("int"))
        .otherwise(F.col("firsts")).alias("near"),
        F.when(part, F.least(other, longer)).otherwise(F.col("best_first")).alias("best")) \
        .where("near > 0").groupBy("id") \
        .agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def spelling_forms(words: DataFrame, *, ahead: int = AHEAD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word in ``word, n``.

    ``words`` are distinct.  Words get numbers by falling n, then by code points, so the near
    word with the smallest number is the one that occurs most often.  It is the word's form
    if it occurs ``ahead`` times as often or more; a form has a smaller number, so following
    forms ends at a root.  An empty table gives an empty result.
    """
    order = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    listed = materialise(ranked(words.withColumn("order", order), "order", "id")
                         .select("id", "word", "n"), "words")
    near = materialise(near_words(listed), "near")
    other = listed.select(F.col("id").alias("best"), F.col("word").alias("form"),
                          F.col("n").alias("form_n"))
    found = materialise(
        listed.join(near, "id", "left").join(other, "best", "left")
        .withColumn("good", F.coalesce(F.col("form_n") >= ahead * F.col("n"), F.lit(False)))
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("best", "form", "form_n")]),
        "forms")
    tops = rooted(found.where("best is not null")
                  .select(F.col("id").alias("node"), F.col("best").alias("label")))
    roots = materialise(
        tops.join(listed.select(F.col("id").alias("label"), F.col("word").alias("root")), "label")
        .select(F.col("node").alias("id"), "root"), "roots")
    return found.join(roots, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
