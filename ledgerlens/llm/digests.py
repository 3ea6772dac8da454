"""Similarity digests of improbable byte windows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ledgerlens.llm.batches import slices
from ledgerlens.llm.rows import ranked
from ledgerlens.sources.storage import materialise

WIDTH = 32  # bytes of a window
NEIGHBOURS = 32  # windows among which the most improbable one gets a vote
VOTES = 8  # that make a window a feature
SHORT = 256  # texts of fewer bytes also give all windows of SHORT_WIDTH
SHORT_WIDTH = 8
LEVELS = 1000  # of entropy
WEAK = 100  # windows below this level say nothing; they are chosen last
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5  # of 11 bits each
CHANCE = 0.3  # part of the overlap beyond the expected one that still counts as chance
SLICE_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 100_000

_COUNT = np.arange(WIDTH + 1)
_TERMS = np.round(_COUNT * np.log2(np.maximum(_COUNT, 1)) * 4096).astype(np.int64)
_GAIN = np.diff(_TERMS)  # what one more equal byte adds


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of ``WIDTH`` bytes, 0 to ``LEVELS``, by where it starts.

    A byte that enters a window adds what its equals inside imply, one that leaves takes
    that back; so two running sums give all windows.
    """
    if len(data) < WIDTH:
        return np.empty(0, np.int64)
    before = np.zeros(len(data), np.uint8)
    after = np.zeros(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    gained, lost = np.cumsum(_GAIN[before]), np.cumsum(_GAIN[after])
    terms = gained[WIDTH - 1:].copy()
    terms[1:] -= lost[:len(terms) - 1]
    return LEVELS - terms * LEVELS // int(_TERMS[WIDTH])


def rarity(counts: dict[int, int]) -> np.ndarray:
    """Rank of each entropy level: the rarer among all windows, the earlier; weak ones last."""
    seen = np.zeros(LEVELS + 1, np.int64)
    for level, n in counts.items():
        seen[level] = n
    weak = np.arange(LEVELS + 1) < WEAK
    order = np.lexsort((np.arange(LEVELS + 1), seen, weak))
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(LEVELS + 1)
    return rank


def _votes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray
           ) -> np.ndarray:
    """Votes of each window start; texts lie at ``data[start:end]``."""
    levels = entropy_levels(data)
    key = (rank[levels] << 32) | np.arange(len(levels))
    best, span = key, 1
    while span < NEIGHBOURS:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    inside = np.zeros(len(data) + 1, np.int64)
    last = ends - WIDTH - NEIGHBOURS + 2  # one past the last run of neighbours
    whole = last > starts
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, last[whole], -1)
    chosen = best[np.cumsum(inside)[:len(best)] > 0] & 0xFFFFFFFF
    return np.bincount(chosen, minlength=len(data))


def _pooled(data: np.ndarray, votes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Votes where equal windows of a stretch that repeats its bytes share theirs.

    Ties go to the leftmost window, so with a period under ``VOTES`` none gets enough by
    itself.  The first window of each kind in a stretch gets the votes of its equals.
    """
    votes = votes.copy()
    for period in range(1, VOTES):
        same = data[period:] == data[:-period]
        for k in range(1, period + 1):  # a stretch lies within one text
            at = ends - k
            same[at[(at >= 0) & (at < len(same))]] = False
        turns = np.flatnonzero(np.concatenate((same[:1], same[1:] != same[:-1], same[-1:])))
        begin, stop = turns[::2], turns[1::2]
        wide = stop - begin >= WIDTH
        for a, b in zip(begin[wide].tolist(), stop[wide].tolist()):
            part = votes[a:b - WIDTH + period + 1]
            for k in range(min(period, len(part))):
                total = min(255, int(part[k::period].sum()))  # more than enough, fits a byte
                part[k::period] = 0
                part[k] = total
    return votes


def _enough(votes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the features: ``VOTES`` votes, or the most of a text that has no such window."""
    places = np.flatnonzero(votes)
    least = np.minimum(VOTES, np.maximum.reduceat(votes, starts))
    return places[votes[places] >= least[np.searchsorted(starts, places, "right") - 1]]


def _hashes(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    parts = data[places[:, None] + np.arange(width)].view("<u8")
    h = np.full(len(places), width, np.uint64)
    for column in parts.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _once(text: np.ndarray, place: np.ndarray, value: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """Features in order of text and place, each hash once per text."""
    order = np.lexsort((place, value, text))
    text, place, value = text[order], place[order], value[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, place, value = text[first], place[first], value[first]
    order = np.lexsort((place, text))
    return text[order], value[order]


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each feature, in order, each hash once per text.

    A text of fewer bytes than a window and its neighbours has none.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    long = sizes >= WIDTH + NEIGHBOURS - 1
    if not long.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    votes = _pooled(data, _votes(data, starts[long], ends[long], rank), ends)
    places = _enough(votes, starts[long])
    return _once(np.searchsorted(ends, places, "right"), places, _hashes(data, places, WIDTH))


def short_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ``SHORT_WIDTH`` bytes of the texts under ``SHORT`` bytes."""
    found = []
    for i, text in enumerate(texts):
        if 0 < len(text) < SHORT:
            padded = text.ljust(SHORT_WIDTH, b"\0")
            places = np.arange(len(padded) - SHORT_WIDTH + 1)
            found.append((np.full(len(places), i), places,
                          _hashes(np.frombuffer(padded, np.uint8), places, SHORT_WIDTH)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return _once(*(np.concatenate(x) for x in zip(*found)))


def _segments(text: bytes) -> list[tuple[int, int]]:
    """A very long text in parts; each run of neighbours lies whole in one of them."""
    step, reach = SLICE_BYTES, WIDTH + NEIGHBOURS - 2
    return [(a, min(len(text), a + step + reach)) for a in range(0, len(text) - reach, step)]


def _long_features(text: bytes, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of one very long text in memory bounded but for a vote per byte."""
    data = np.frombuffer(text, np.uint8)
    votes = np.zeros(len(text), np.uint8)
    for a, b in _segments(text):
        part = _votes(data[a:b], np.array([0]), np.array([b - a]), rank)
        votes[a:b] += part.astype(np.uint8)
    places = _enough(_pooled(data, votes, np.array([len(data)])), np.array([0]))
    value = np.concatenate([_hashes(data, places[i:i + SLICE_BYTES // WIDTH], WIDTH)
                            for i in range(0, len(places), SLICE_BYTES // WIDTH)]
                           or [np.empty(0, np.uint64)])
    value = value[np.sort(np.unique(value, return_index=True)[1])]
    return np.zeros(len(value), np.int64), value


def _filters(text: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    counts = np.bincount(text, minlength=n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = -(-counts // FILTER_FEATURES)
    row = (np.cumsum(chains) - chains)[text] + nth // FILTER_FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        bits[row, ((value >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(int)] = 1
    packed = np.packbits(bits, axis=1).view("<u8")
    return np.split(packed, np.cumsum(chains)[:-1])


class Digest(NamedTuple):
    """Chains of filters, 32 words of 64 bits each: of improbable windows, of small ones.

    A text under ``SHORT`` bytes has the second, one of ``WIDTH + NEIGHBOURS - 1`` or more the
    first, an empty one none; so texts whose sizes don't differ fourfold share a kind.
    """

    windows: np.ndarray
    small: np.ndarray

    def __len__(self) -> int:
        return len(self.windows) + len(self.small)


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """The digest of each text."""
    out: list[Digest] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            windows = _filters(*features(group, rank), len(group))
            out.extend(map(Digest, windows, _filters(*short_features(group), len(group))))
            group.clear()

    size = 0
    for text in texts:
        if len(text) > 2 * SLICE_BYTES:
            flush()
            out.append(Digest(_filters(*_long_features(text, rank), 1)[0],
                              np.empty((0, FILTER_BITS // 64), np.uint64)))
            size = 0
            continue
        if size + len(text) > SLICE_BYTES:
            flush()
            size = 0
        group.append(text)
        size += len(text)
    flush()
    return out


def likeness(one: Digest, other: Digest) -> float:
    """Overlap of two digests, 0 to 1, beyond what chance explains.

    Small windows are compared if both digests have them, improbable ones otherwise.  Each
    filter of the shorter chain is held against its best partner; the overlap is scaled
    from the expected one (plus a margin) to the greatest possible one, and filters count by
    their bits.  Two empty digests are equal; an empty one is like no other, and neither are
    two without a kind in common.
    """
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    if len(one.small) and len(other.small):
        return _overlap(one.small, other.small)
    if len(one.windows) and len(other.windows):
        return _overlap(one.windows, other.windows)
    return 0.0


def _overlap(one: np.ndarray, other: np.ndarray) -> float:
    if len(one) > len(other):
        one, other = other, one
    ours, theirs = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (one, other))
    total = 0.0
    for bits, n in zip(one, ours.tolist()):
        shared = np.bitwise_count(bits & other).sum(axis=1, dtype=np.int64)
        most = np.minimum(n, theirs)
        chance = n * theirs / FILTER_BITS
        least = chance + CHANCE * (most - chance)
        total += n * float(np.clip((shared - least) / np.maximum(most - least, 1e-9), 0, 1).max())
    return min(1.0, total / int(ours.sum()))


def spelled(digest: Digest) -> str:
    """Both chains as text; the empty digest is the empty text."""
    return ".".join(base64.b64encode(x.tobytes()).decode() for x in digest) if len(digest) else ""


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of another one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def fit_rarity(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Ranks of the entropy levels from all windows of all texts.

    Each task counts its own windows; at most ``LEVELS + 1`` sums reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS + 1, np.int64)
        for _, texts in slices(batches, "text", SLICE_BYTES):
            data = np.frombuffer(b"".join(texts), np.uint8)
            for a, b in [(i, min(len(data), i + SLICE_BYTES + WIDTH - 1))
                         for i in range(0, max(1, len(data) - WIDTH + 1), SLICE_BYTES)]:
                levels = entropy_levels(data[a:b])
                ends = np.cumsum([len(t) for t in texts])[:-1] - a
                crosses = np.zeros(len(levels) + 1, np.int64)
                np.add.at(crosses, np.clip(ends - WIDTH + 1, 0, len(levels)), 1)
                np.add.at(crosses, np.clip(ends, 0, len(levels)), -1)
                seen += np.bincount(levels[np.cumsum(crosses[:-1]) == 0], minlength=LEVELS + 1)
        level = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(seen[level])],
                                         names=["level", "n"])

    counts = docs.select(F.col(text_column).alias("text")) \
        .mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    return rarity({r["level"]: r["n"] for r in counts.collect()})


RESULT = (("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()),
          ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()),
          ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()))


def _numbered(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``number``, a long that sorts like the id; null stays null."""
    if isinstance(rows.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return rows.withColumn("number", F.col("doc_id").cast("long"))
    ids = ranked(rows.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "number")
    return rows.join(materialise(ids, "ids"), "doc_id", "left")


def edit_fingerprints(docs: DataFrame, rank: np.ndarray | None = None, *,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digest of each text, of its edited form, and how alike they and the next text are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The next text follows by id, then by text; after the last comes the
    first.  Ids are cut into ranges of about ``BUCKET_BYTES``; each range is sorted and read
    as a stream, and the first text of the next range is sent along with it, so no task
    needs another's rows.  Ids that are no whole numbers are numbered in their order first.  A
    null text is empty; null ids come first; a single row is its
    own successor; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rank = fit_rarity(docs, text_column) if rank is None else rank
    rows = _numbered(docs.select(F.col(id_column).alias("doc_id"),
                                 F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    size, low, nulls = rows.agg(F.sum(F.octet_length("text")), F.min("number"),
                                F.count_if(F.col("number").isNull())).first()
    buckets = min(MOST_BUCKETS, max(1, -(-(size or 0) // BUCKET_BYTES)))
    cuts = rows.agg(F.percentile_approx("number", [i / buckets for i in range(1, buckets)],
                                        max(10_000, 4 * buckets))).first()[0] \
        if buckets > 1 else None
    bounds = np.array(sorted({c for c in cuts or () if c > low or nulls}), np.int64)
    held = spark.sparkContext.broadcast((bounds, rank))

    @F.pandas_udf("long")
    def range_of(ids: pd.Series) -> pd.Series:
        """Twice the number of the id's range, plus 1 for the id that opens it."""
        cuts = held.value[0]
        known = ids.fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        at = np.searchsorted(cuts, known, "right")
        opens = np.zeros(len(at), bool)
        opens[at > 0] = cuts[at[at > 0] - 1] == known[at > 0]
        return pd.Series(2 * at + opens)

    first = F.col("number").isNull() if nulls else F.col("number") == F.lit(low)
    own = F.floor(F.col("r") / 2).cast("int")
    seats = F.array_compact(F.array(
        F.struct(own.alias("bucket"), F.lit(False).alias("after")),
        F.when(F.col("r") % 2 == 1, F.struct((own - 1).alias("bucket"), F.lit(True).alias("after"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("after")))))
    dealt = rows.withColumn("r", range_of("number")).withColumn("seat", F.explode(seats)) \
        .select("seat.bucket", "seat.after", "number", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, waiting = held.value[1], []
        for batch, _ in slices(batches, "text", SLICE_BYTES):
            lines = waiting + list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names)))
            waiting = [] if lines[-1][1] else [lines[-1]]
            out = _answers(lines, ranks)
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("doc_id", batch.schema.field("doc_id").type),
                    *[(name, arrow) for name, _, arrow in RESULT]]))

    return dealt.repartition("bucket") \
        .sortWithinPartitions("bucket", "after", F.col("number").asc_nulls_first(), "text") \
        .mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} {t}" for n, t, _ in RESULT]]))


def _answers(lines: list[tuple], rank: np.ndarray) -> list[dict]:
    """Result rows of all lines (bucket, after, number, id, text) but the last, from their
    successors."""
    marks = digests([text.encode() for *_, text in lines], rank)
    todo = [i for i in range(len(lines) - 1) if not lines[i][1]]
    changed = [edited(lines[i][4], lines[i + 1][4]).encode() for i in todo]
    out = []
    for i, data, mark in zip(todo, changed, digests(changed, rank)):
        out.append({
            "doc_id": lines[i][3], "n_chars": len(lines[i][4]),
            "edited_sha256": hashlib.sha256(data).hexdigest(),
            "fingerprint": spelled(marks[i]), "edited_fingerprint": spelled(mark),
            "near_edited": likeness(marks[i], mark),
            "near_next": likeness(marks[i], marks[i + 1])})
    return out
