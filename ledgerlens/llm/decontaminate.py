"""Benchmark passages in documents, by Wu-Manber search for many strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ledgerlens.llm.batches import slices
from ledgerlens.llm.rows import unused
from ledgerlens.sources.storage import materialise

WINDOW = 13
PORTION_BYTES = 4 << 20  # benchmark text of one search
PORTIONS_AT_ONCE = 4  # searches that are held in memory together
DIRTY = 20  # contaminated from one hit word in so many
LANE = 2048  # window starts that one pointer walks over
BLOCK = 8
MARK = 0xFF  # between documents; never part of UTF-8
SPACE = 0x20

RESULTS = ("n_words", "n_hit", "items", "contaminated")
STATE = (("n_words", LongType()), ("n_hit", LongType()), ("items", ArrayType(StringType())),
         ("hit", BinaryType()))


def _fold_table() -> np.ndarray:
    """Words keep their bytes in lower case, all else is a space."""
    table = np.full(256, SPACE, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low:high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


FOLD = _fold_table()


def normal_words(texts: list[bytes]) -> np.ndarray:
    """All texts as `` w1 w2 ... `` between marks, single spaces around every word."""
    joined = FOLD[np.frombuffer(b" \xff " + b" \xff ".join(texts) + b" \xff ", np.uint8)]
    blank = joined == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return joined[keep]


def windows(texts: list[str | None], width: int = WINDOW) -> list[list[bytes]]:
    """The distinct windows of each item as searched strings."""
    out = []
    for text in texts:
        words = normal_words([(text or "").encode()]).tobytes().replace(b"\xff", b"").split()
        spans = [words] if 0 < len(words) < width else \
            [words[i:i + width] for i in range(len(words) - width + 1)]
        out.append(sorted({b" " + b" ".join(w) + b" " for w in spans}))
    return out


class Search:
    """Wu-Manber tables for strings of similar length.

    All strings are seen through their first ``m`` bytes, the length of the shortest.
    ``shift`` tells for the last block of a window of ``m`` bytes how far the window can
    move without missing a string; 0 means that some string may lie here, and the bucket of
    that block names the strings to compare.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = min(map(len, strings))
        self.block = min(BLOCK, self.m)
        heads = np.frombuffer(b"".join(s[:self.m] for s in strings), np.uint8) \
            .reshape(len(strings), self.m)
        places = self.m - self.block + 1
        bits = min(22, max(10, (8 * len(strings) * places).bit_length()))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, places, np.int32)
        for j in range(places):  # later blocks allow smaller moves and so overwrite
            keys = self._hash(self._keys(heads[:, j:j + self.block]))
            self.shift[keys] = places - 1 - j
        order = np.argsort(keys, kind="stable")
        self.bucket, self.member = keys[order], order
        self.head = self._keys(heads[:, :self.block])

    def _keys(self, blocks: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(blocks), 8), np.uint8)
        wide[:, :self.block] = blocks
        return wide.view("<u8").ravel()

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.down).astype(np.int64)

    def occurrences(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the strings that occur in ``text[start:end]`` of each range."""
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.ndarray((len(text),), "<u8", padded.tobytes(), strides=(1,))
        mask = np.uint64((1 << (8 * self.block)) - 1)
        last = ends - self.m + 1  # one past the last window of the range
        lanes = np.maximum(0, -(-(last - starts) // LANE))
        owner = np.repeat(np.arange(len(starts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = starts[owner] + nth * LANE
        stop = np.minimum(at + LANE, last[owner])
        hits = []
        offset = self.m - self.block
        while len(at):
            move = self.shift[self._hash(words[at + offset] & mask)]
            zero = move == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places = np.concatenate(hits)
        keys = self._hash(words[places + offset] & mask)
        low, high = (np.searchsorted(self.bucket, keys, side) for side in ("left", "right"))
        count = high - low
        which = np.repeat(low, count) + np.arange(count.sum()) \
            - np.repeat(np.cumsum(count) - count, count)
        places, member = np.repeat(places, count), self.member[which]
        same = (words[places] & mask) == self.head[member]
        places, member = places[same], member[same]
        raw = text.tobytes()
        equal = np.fromiter((raw.startswith(self.strings[k], p) for p, k in
                             zip(places.tolist(), member.tolist())), bool, len(places))
        return places[equal], member[equal]


def searches(strings: list[bytes]) -> list[tuple[Search, np.ndarray]]:
    """One search for each class of lengths, so that short strings don't slow long ones."""
    classes: dict[int, list[int]] = {}
    for k, s in enumerate(strings):
        classes.setdefault(min(len(s).bit_length(), 6), []).append(k)
    return [(Search([strings[k] for k in members]), np.array(members))
            for _, members in sorted(classes.items())]


def _searcher(items: list[tuple[str, str | None]], width: int, names_of: dict[str, str]
              ) -> Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]:
    """Adds what one portion of the benchmark hits to the rows of a partition.

    ``names_of`` are the columns that hold the state.
    """

    def run(batches: Iterator[pa.RecordBatch], text_column: str) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in items]
        holders: dict[bytes, list[int]] = {}
        for i, strings in enumerate(windows([t for _, t in items], width)):
            for s in strings:
                holders.setdefault(s, []).append(i)
        strings = list(holders)
        words_of = np.array([s.count(b" ") - 1 for s in strings], np.int64)
        tables = searches(strings) if strings else []
        for batch, texts in slices(batches, text_column):
            buffer = normal_words(texts)
            marks = np.flatnonzero(buffer == MARK)
            starts, ends = marks[:-1] + 1, marks[1:]
            slots = np.cumsum(buffer == SPACE, dtype=np.int64)  # spaces up to here, included
            first = slots[starts] - 1
            counts = slots[ends] - slots[starts]
            found = [(p, members[k]) for table, members in tables
                     for p, k in [table.occurrences(buffer, starts, ends)]]
            places = np.concatenate([p for p, _ in found]) if found else np.empty(0, np.int64)
            which = np.concatenate([k for _, k in found]) if found else np.empty(0, np.int64)
            edge = np.zeros(int(slots[-1]) + 1 if len(slots) else 1, np.int64)
            slot = slots[places] - 1
            np.add.at(edge, slot, 1)
            np.add.at(edge, slot + words_of[which], -1)
            hit = np.cumsum(edge) > 0
            doc = np.searchsorted(starts, places, "right") - 1
            lists: dict[int, set[str]] = {}
            for d, k in set(zip(doc.tolist(), which.tolist())):
                lists.setdefault(d, set()).update(names[i] for i in holders[strings[k]])
            old_hit, old_items = (
                batch.column(names_of[c]).to_pylist() for c in ("hit", "items"))
            new_hit, new_items, n_hit = [], [], []
            for d in range(len(texts)):
                mask = hit[first[d]:first[d] + counts[d]] if d in lists else None
                if old_hit[d] is not None:
                    before = np.unpackbits(np.frombuffer(old_hit[d], np.uint8),
                                           count=int(counts[d])).astype(bool)
                    mask = before if mask is None else mask | before
                n_hit.append(0 if mask is None else int(mask.sum()))
                new_hit.append(None if mask is None else np.packbits(mask).tobytes())
                new_items.append(sorted(lists.get(d, set()).union(old_items[d] or ())))
            new = {"n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "items": pa.array(new_items, pa.list_(pa.string())),
                   "hit": pa.array(new_hit, pa.binary())}
            new = {names_of[c]: values for c, values in new.items()}
            yield pa.RecordBatch.from_arrays(
                [new.get(name, batch.column(name)) for name in batch.schema.names],
                names=batch.schema.names)

    return run


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, portion_bytes: int,
              text_column: str, item_column: str, item_text: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns for ``RESULTS``, and the names of these.

    The names are ones that the documents don't have.
    """
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    portions = max(1, -(-total // portion_bytes))
    ids = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("i"),
                           F.col(item_text).alias("t"))
    names = {c: unused(docs, f"found_{c}") for c in ("n_words", "n_hit", "items", "hit",
                                                     "contaminated")}
    fields = [StructField(names[c], kind) for c, kind in STATE]
    schema = StructType([*docs.schema.fields, *fields])
    state = docs.select(*[F.col(f"`{c}`") for c in docs.columns],
                        *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    held = []
    for k in range(portions):
        if len(held) == PORTIONS_AT_ONCE:
            state = materialise(state, "searched")
            for one in held:
                one.destroy()
            held = []
        part = ids.where(F.pmod(F.xxhash64("i", "t"), F.lit(portions)) == k)
        held.append(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]))

        def run(batches, items=held[-1]):
            return _searcher(items.value, width, names)(batches, text_column)

        state = state.mapInArrow(run, schema)
    hit = F.col(names["n_hit"])
    return state.withColumn(names["contaminated"],
                            (hit > 0) & (hit * DIRTY >= F.col(names["n_words"]))), names


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW,
                   portion_bytes: int = PORTION_BYTES, text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with ``n_words, n_hit, items, contaminated``.

    ``items`` are the ids, as sorted strings, of the benchmark items with an occurring
    window.  The benchmark is searched in portions of ``portion_bytes`` of text; each is read
    to the driver, broadcast and searched.  ``PORTIONS_AT_ONCE`` of them share one pass over
    the documents, which are not shuffled; of a larger benchmark what was found so far is
    written and the portions are given up before the next ones are read, so neither the
    driver nor a task ever holds more of it.  Hit words of all portions are joined.  A null
    text has no words; an item without words hits nothing; an item without id counts under
    the empty id; items that share an id count once.  An existing column of a result's
    name is replaced.
    """
    found, names = _searched(docs, benchmark, width, portion_bytes, text_column, item_column,
                             item_text)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS],
                        *[F.col(names[c]).alias(c) for c in RESULTS])


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW,
                    portion_bytes: int = PORTION_BYTES, text_column: str = "text",
                    item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without the contaminated ones, all columns as they were."""
    found, names = _searched(docs, benchmark, width, portion_bytes, text_column, item_column,
                             item_text)
    return found.where(~F.col(names["contaminated"])).select(*[F.col(f"`{c}`") for c in docs.columns])
