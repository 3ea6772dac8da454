"""Exact Jaccard join of word n-gram sets, down to classes of linked documents.

Shingles are put in one order, frequent ones last.  Two similar sets share one of their
first shingles, so only those are indexed: each indexed shingle has a list of (set, size,
position).  Lists of frequent shingles are dealt in parts of bounded length.  A list is cut
into blocks of sizes; size and position of an entry tell which blocks can hold a partner,
and the others are skipped unread.  Relations between sets skip most of the rest: every
set is first compared with one leader of its lists; the sets that a leader's class already
links need no comparison, and pairs between two classes are decided, where possible, by
what their leaders share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlens.llm.batches import slices
from ledgerlens.llm.hashing import mixed, span_hashes
from ledgerlens.llm.rows import COPIES, KEY, keyed, row_key, take_copies, unpacked
from ledgerlens.sources.storage import materialise, regrouped

NGRAM = 4
PERCENT = 85  # of the union that two linked sets share
SLOT_BYTES = 8 << 20  # text whose shingles one step holds in memory
FREQUENT = 32  # documents that make a shingle frequent
MOST_FREQUENT = 1 << 20  # frequent shingles that are told apart; at 5 bytes each
SLICE_BYTES = 1 << 18  # text that is cut into shingles at once
MOST_BITS = 1 << 27  # of the filter for sets that are still needed
LEADERS = 8  # sets of each block of a list that the others are first compared with
PART_BITS = 12  # logarithm of the documents from which on a list is dealt in parts
BLOCKS = 4  # blocks of a list per doubling of the set size
MARKS = 8  # words of 64 bits that mark a set

_BYTE = np.arange(256)
_BLANK = (_BYTE == 32) | (_BYTE >= 9) & (_BYTE <= 13) | (_BYTE == 0xFF)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def shingle_sets(texts: list[bytes], width: int = NGRAM
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of all distinct shingles, the sets' sizes and their digests.

    Shingles come by text, then by hash.  A text of fewer words has one shingle of all its
    words; one without words has none and the digest 0.
    """
    data = _LOWER[np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)]
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    word = span_hashes(data, starts, ends)
    text = np.searchsorted(np.flatnonzero(data == 0xFF), starts) - 1
    words = np.bincount(text, minlength=len(texts))
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    first = (np.cumsum(words) - words)[owner] \
        + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = np.minimum(words, width)[owner].astype(np.uint64)
    for k in range(width):
        at = first + k
        inside = k < words[owner]
        step = word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else h
        h = np.where(inside, mixed(h * np.uint64(0x9E3779B97F4A7C15) + step), h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[fresh], h[fresh]
    sizes = np.bincount(owner, minlength=len(texts))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + np.uint64(1)))])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    digest = mixed(total[edge[1:]] - total[edge[:-1]] + sizes.astype(np.uint64))
    digest[sizes == 0] = 0
    return owner, h, sizes, digest


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte: all first bytes, all second bytes and so on; these compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T) \
        .view(kind).ravel()


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)


def list_key(token: np.ndarray, node: np.ndarray, classes: np.ndarray, slots: int) -> np.ndarray:
    """The group that an index entry is dealt to: ``part * slots + slot``.

    First shingles are those of small hashes, so slots go by another hash.  The list of a
    shingle in 2**k documents (``classes`` has k, 0 for the rare ones) is one part, the
    part 0, or is dealt by its sets to parts from 1 on of about ``2**PART_BITS`` documents.
    """
    extra = np.maximum(classes.astype(np.int64) - PART_BITS, 0)
    part = np.where(extra > 0, mixed(node) >> np.minimum(64 - extra, 63).astype(np.uint64), 0) \
        .astype(np.int64) + (extra > 0)
    return part * slots + _slot(mixed(token), slots).astype(np.int64)


def prefix_length(n: Column | np.ndarray, percent: int = PERCENT):
    """How many first shingles of a set two similar sets must share one of."""
    return n - (percent * n + 99) // 100 + 1


def frequent_shingles(docs: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted first halves of the hashes of frequent shingles, and a class of each.

    All shingles of all documents are counted: each task counts its own and sends sorted
    counts to the slots, which add them up.  Kept are those in ``FREQUENT`` documents or
    more; if these are over ``MOST_FREQUENT``, the limit is doubled until they are not.  The
    classes only order shingles, so any choice gives the same result.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for last, batch_texts in _with_last(slices(batches, "text", SLICE_BYTES)):
            held.append((shingle_sets(batch_texts)[1] >> np.uint64(32)).astype(np.uint32))
            size += len(held[-1])
            if last or size > 1 << 20:
                value, count = np.unique(np.concatenate(held), return_counts=True)
                full, cuts = np.unique(_slot(value.astype(np.uint64) << np.uint64(32), slots),
                                       return_index=True)
                pieces = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(value)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(full.astype(np.int64)),
                    pa.array([_planes(value[p]) for p in pieces], pa.binary()),
                    pa.array([_planes(np.minimum(count[p], 65535).astype(np.uint16))
                              for p in pieces], pa.binary())], names=["slot", "v", "n"])
                held, size = [], 0

    def add(table: pa.Table) -> pa.Table:
        value = np.concatenate([_unplanes(v, "<u4") for v in table["v"].to_pylist()])
        count = np.concatenate([_unplanes(n, "<u2") for n in table["n"].to_pylist()])
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        total = np.add.reduceat(count, first)
        kept = total >= FREQUENT
        return pa.table({"v": pa.array(value[first][kept].astype(np.int64)),
                         "k": pa.array(np.log2(total[kept]).astype(np.int32))})

    counts = materialise(
        docs.select("text").mapInArrow(local, "slot long, v binary, n binary")
        .groupBy("slot").applyInArrow(add, "v long, k int"), "frequent")
    classes = sorted(counts.groupBy("k").count().collect(), reverse=True)
    least, total = 64, 0
    for k, n in classes:
        total += n
        if total > MOST_FREQUENT:
            break
        least = k
    rows = counts.where(F.col("k") >= least).toArrow()
    value, k = (rows[c].to_numpy() for c in ("v", "k"))
    order = np.argsort(value)
    return value[order].astype(np.uint32), k[order].astype(np.uint8)


def _with_last(parts) -> Iterator[tuple[bool, list[bytes]]]:
    held = None
    for _, texts in parts:
        if held is not None:
            yield False, held
        held = texts
    if held is not None:
        yield True, held


def index_lists(docs: DataFrame, slots: int, percent: int = PERCENT) -> DataFrame:
    """The lists of indexed shingles that more than one set has.

    ``token, part, node, n, pos, band`` and the ``rank`` of the set, by a hash of its node,
    among those of about the same size in its part of the list.  A node is the digest of a
    set, so equal sets are one node.  Lists in parts stay also if they have one set.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, slots))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, classes = frequent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for last, texts in _with_last(slices(batches, "text", SLICE_BYTES)):
            owner, h, sizes, digest = shingle_sets(texts)
            new = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], bool)
            if len(seen) > 1 << 20:
                seen.clear()
            of = new[owner]
            owner, h = owner[of], h[of]
            half = (h >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(value, half), max(len(value) - 1, 0))
            common = np.where(value[at] == half, classes[at], 0) if len(value) \
                else np.zeros(len(h), np.uint8)
            order = np.lexsort((h, common, owner))
            owner, h = owner[order], h[order]
            n = sizes[owner]
            inner = np.where(new, sizes, 0)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(inner) - inner, inner)
            early = pos < prefix_length(n, percent)
            held.append((h[early], digest[owner[early]], n[early].astype(np.uint32),
                         pos[early].astype(np.uint32), common[order][early]))
            size += int(early.sum())
            if last or size > 1 << 19:
                *columns, common = [np.concatenate(c) for c in zip(*held)]
                slot = list_key(columns[0], columns[1], common, slots)
                order = np.argsort(slot, kind="stable")
                full, cuts = np.unique(slot[order], return_index=True)
                pieces = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(slot)])]
                columns = [c[order] for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full),
                     *[pa.array([_planes(c[p]) for p in pieces], pa.binary()) for c in columns]],
                    names=["slot", "token", "node", "n", "pos"])
                held, size = [], 0

    def join(table: pa.Table) -> pa.Table:
        token, node, n, pos = (
            np.concatenate([_unplanes(x, kind) for x in table[c].to_pylist()])
            for c, kind in (("token", "<u8"), ("node", "<u8"), ("n", "<u4"), ("pos", "<u4")))
        part = table["slot"][0].as_py() // slots
        band = np.floor(2 * np.log2(np.maximum(n, 1))).astype(np.int64)
        lead = mixed(node)
        order = np.lexsort((lead, band, token))
        token, node, n, pos, band, lead = (x[order] for x in (token, node, n, pos, band, lead))
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, pos, band = (x[once] for x in (token, node, n, pos, band))
        opens = np.concatenate([[True], token[1:] != token[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(opens), len(token)))
        several = np.repeat((sizes > 1) | (part > 0), sizes)
        block = opens.copy()
        block[1:] |= band[1:] != band[:-1]
        head = np.flatnonzero(block)[np.cumsum(block) - 1]
        columns = {"token": token, "part": np.full(len(token), part), "node": node, "n": n, "pos": pos,
                   "band": band, "rank": np.arange(len(token)) - head}
        return pa.table({c: pa.array(x[several].astype(np.int64)) for c, x in columns.items()})

    return docs.select("text") \
        .mapInArrow(local, "slot long, token binary, node binary, n binary, pos binary") \
        .groupBy("slot").applyInArrow(join, ", ".join(
            f"{c} long" for c in ("token", "part", "node", "n", "pos", "band", "rank")))


def least_shared(sizes: Column, percent: int = PERCENT) -> Column:
    """Shared shingles that two linked sets of these sizes together have at least."""
    return F.ceil(F.lit(percent) * sizes / F.lit(100 + percent))


def possible(n: Column, pos: Column, other_n: Column, other_pos: Column,
             percent: int = PERCENT) -> Column:
    """Whether two sets that meet at these positions for the first time can be linked."""
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent) \
        & (F.least(n - pos, other_n - other_pos) >= least_shared(n + other_n, percent))


def size_block(n: Column) -> Column:
    """The block of a list that a set of this size stands in."""
    return F.floor(BLOCKS * F.log2(n)).cast("int")


def partner_blocks(n: Column, pos: Column, larger: bool, percent: int = PERCENT) -> Column:
    """The blocks that can hold a partner that is not smaller, or not larger.

    A set of n shingles that meets another one at its position has only the n - pos from
    there on to share; that bounds the other's size from above, the smaller one's share
    from below.  Null if no partner is possible.
    """
    reach = F.floor((100 + percent) * (n - pos) / percent) - n
    low, high = (n, reach) if larger else (F.ceil(percent * n / 100), F.least(n, reach))
    return F.when(low <= high, F.sequence(size_block(low), size_block(high)))


def _marks(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each set, which of its bits an odd number of shingles fall on.

    Two sets differ in as many shingles as their marks differ in bits, at least.
    """
    bits = 64 * MARKS
    odd = np.bincount(owner * bits + (h >> np.uint64(8)).astype(np.int64) % bits,
                      minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, MARKS)


MARK_NAMES = [f"m{i}" for i in range(MARKS)]


def unlike(one: str, other: str) -> Column:
    """Bits in which the marks of two sets differ; the names end in the given letters."""
    return sum((F.bit_count(F.col(m + one).bitwiseXOR(F.col(m + other))) for m in MARK_NAMES),
               F.lit(0))


def needed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, items`` of the sets in ``wanted`` (``node, crc``), and of a few others.

    A bit table of bounded size tells by the checksum of a text whether its set is needed;
    the others are neither cut into shingles nor moved.
    """
    bits = min(MOST_BITS, 1 << max(10, (64 * wanted.count()).bit_length()))
    words = wanted.select(F.pmod("crc", F.lit(bits)).alias("b")) \
        .select(F.floor(F.col("b") / 64).cast("long").alias("w"),
                F.expr("shiftleft(1L, cast(b % 64 as int))").alias("bit")) \
        .groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = held.value
        seen: set[int] = set()
        for _, texts in slices(batches, "text", SLICE_BYTES):
            place = np.array([zlib.crc32(t) for t in texts], np.uint64) \
                & np.uint64(64 * len(mask) - 1)
            hit = (mask[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
            texts = [texts[i] for i in np.flatnonzero(hit).tolist()]
            if not texts:
                continue
            _, h, sizes, digest = shingle_sets(texts)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            kept = [i for i in np.flatnonzero(sizes > 0).tolist()
                    if digest[i] not in seen and not seen.add(digest[i])]
            if len(seen) > 1 << 18:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[kept].view(np.int64)),
                 pa.array([h[edge[i]:edge[i + 1]].tobytes() for i in kept], pa.binary())],
                names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items binary") \
        .dropDuplicates(["node"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, n_a, n_b`` for all pairs, from their whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (batch.column(c).to_pylist() for c in ("items_a", "items_b"))
            rows = []
            for x, y in zip(one, other):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                rows.append((int((large[at] == small).sum()), len(x), len(y)))
            shared, n_a, n_b = (pa.array(c, pa.int64()) for c in zip(*rows)) if rows else \
                (pa.array([], pa.int64()),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), shared, n_a, n_b],
                names=["a", "b", "shared", "n_a", "n_b"])

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    other = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "items_a", "items_b") \
        .mapInArrow(run, "a long, b long, shared long, n_a long, n_b long")


def rooted(parents: DataFrame) -> DataFrame:
    """``node, label``: the root of each node of a forest given as ``node, label``.

    Each step replaces a parent by its own, so the steps grow with the logarithm of the
    depth.
    """
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = materialise(parents.join(up, "label", "left").select(
            "node", F.coalesce("above", "label").alias("label"),
            F.col("above").isNotNull().alias("moved")), "roots")
        parents = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component of ``a, b``.

    Alternating large and small stars: each node sends its larger (then its smaller)
    neighbours to the smallest one it knows.  Only minima and joins; the minima are shuffled
    anew, so that Spark can split the join at a node with very many neighbours.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = regrouped(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "a")
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        below = joined.where("b < a")
        return below.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(below.select("a", F.col("m").alias("b")))

    edges = materialise(edges.where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    mark = None
    while True:
        large = materialise(star(edges, True).where("a <> b").distinct(), "stars")
        edges = materialise(star(large, False).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        mark = now


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after classes (``a, b``: labels, or sets without one) were linked."""
    tops = materialise(components(links), "tops")
    up = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = labels.unionByName(tops).unionByName(
        tops.select(F.col("label").alias("node"), "label")).unionByName(
        labels.select(F.col("label").alias("node"), "label"))
    return known.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")) \
        .groupBy("node").agg(F.min("label").alias("label"))


def linked_nodes(docs: DataFrame, each: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, label`` of every set that is linked with a different one.

    ``docs`` has a column ``text``; ``each`` are its ``digests``.  Sets with equal labels are
    connected by links.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-size // SLOT_BYTES))
    lists = materialise(index_lists(docs, slots, percent), "lists")

    nodes = materialise(
        each.groupBy("node", *MARK_NAMES).agg(F.min("crc").alias("crc"))
        .join(lists.select("node").distinct(), "node", "left_semi"), "nodes")
    marks = nodes.select("node", *MARK_NAMES)
    entries = lists.join(marks, "node")

    def whole_sets(pairs: DataFrame, *ends: str) -> DataFrame:
        """The sets that stand in the pairs."""
        wanted = reduce(DataFrame.unionByName,
                        [pairs.select(F.col(e).alias("node")) for e in ends]).distinct()
        return materialise(needed_sets(docs, materialise(
            nodes.select("node", "crc").join(wanted, "node", "left_semi"), "wanted")), "sets")

    def side(df: DataFrame, end: str, keys: list[str], *columns: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(c + end) for c in (
            "node", "n", "pos", *columns, *MARK_NAMES)])

    size_sum = F.col("n_a") + F.col("n_b")
    meeting = possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), percent) \
        & (unlike("_a", "_b") <= size_sum - 2 * least_shared(size_sum, percent))
    enough = F.col("shared") >= least_shared(size_sum, percent)

    def nearest(members: DataFrame, leaders: DataFrame, keys: list[str],
                allowed: Column) -> DataFrame:
        """``a, b``: each set and the most similar leader that it meets."""
        return members.join(leaders, keys).where(allowed & meeting) \
            .groupBy(F.col("node_a").alias("a")).agg(F.min(F.struct(
                (unlike("_a", "_b") / size_sum).alias("far"), F.col("node_b").alias("b"))).alias("m")) \
            .select("a", "m.b")

    # Every set and a leader of smaller rank in its part of a list: a forest.
    by_part, by_band = ["token", "part", "band"], ["token", "band"]
    first = materialise(nearest(
        side(entries, "_a", by_part, "rank"),
        side(entries.where(F.col("rank") < LEADERS), "_b", by_part, "rank"),
        by_part, F.col("rank_b") < F.col("rank_a")), "first")
    home = materialise(compare(first, whole_sets(first, "a", "b")).where(enough).select(
        F.col("a").alias("node"), F.col("b").alias("leader"),
        (F.col("n_a") - F.col("shared")).alias("plus"),
        (F.col("n_b") - F.col("shared")).alias("minus")), "home")
    labels = materialise(rooted(home.select("node", F.col("leader").alias("label"))), "labels")

    # Every set and a leader that is linked already, from another class than its own.
    linked = labels.unionByName(
        labels.select(F.col("label").alias("node"), "label").distinct())
    some = F.row_number().over(Window.partitionBy("token", "band")
                               .orderBy(F.xxhash64("node"), "node")) <= LEADERS
    chosen = materialise(lists.join(linked, "node").withColumn("some", some).where("some")
                         .drop("some"), "leaders")
    members = entries.join(chosen.select("token", "band").distinct(), ["token", "band"], "left_semi") \
        .join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    second = materialise(nearest(
        side(members, "_a", by_band, "label"),
        side(chosen.join(marks, "node"), "_b", by_band, "label"),
        by_band, F.col("label_a") != F.col("label_b")), "second")
    alike = compare(second, whole_sets(second, "a", "b")).where(enough).select("a", "b")
    for end in "ab":
        alike = alike.join(linked.select(F.col("node").alias(end), F.col("label").alias("l" + end)),
                           end, "left").withColumn("l" + end, F.coalesce("l" + end, end))
    labels = materialise(merged(linked, alike.select(
        F.col("la").alias("a"), F.col("lb").alias("b"))), "labels")

    # Lists whose sets are not all linked yet, and their pairs across classes.
    marked = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_tokens = marked.groupBy("token").agg(
        (F.min("label") != F.max("label")).alias("open")).where("open").select("token")
    entries = materialise(marked.join(open_tokens, "token", "left_semi").join(marks, "node"), "open")

    def blocks(end: str, own: str, other: str) -> DataFrame:
        """The entries in their own block, once for each block that can hold a partner."""
        return side(entries.withColumn(own, size_block(F.col("n"))).withColumn(
            other, F.explode(partner_blocks(F.col("n"), F.col("pos"), end == "_a", percent))),
            end, by_blocks, "label")

    by_blocks = ["token", "block_a", "block_b"]
    pairs = materialise(
        blocks("_a", "block_a", "block_b").join(blocks("_b", "block_b", "block_a"), by_blocks).where(
            (F.col("label_a") != F.col("label_b"))
            & ((F.col("n_a") < F.col("n_b"))
               | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))) & meeting)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b",
                "label_a", "label_b").distinct(), "pairs")

    # What the leaders share decides most pairs of their sets; the rest is compared.
    def of(end: str) -> DataFrame:
        return home.select(F.col("node").alias(end), *[
            F.col(c).alias(f"{c}_{end}") for c in ("leader", "plus", "minus")])

    led = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left") \
        .withColumns({f"leader_{s}": F.coalesce(f"leader_{s}", s) for s in "ab"}) \
        .fillna(0, [f"{x}_{s}" for x in ("plus", "minus") for s in "ab"])
    led = materialise(led.withColumn("x", F.least("leader_a", "leader_b"))
                      .withColumn("y", F.greatest("leader_a", "leader_b")), "led")
    wanted = led.select("x", "y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
    sets = whole_sets(led, "a", "b", "x", "y")
    known = compare(wanted, sets).select(F.col("a").alias("x"), F.col("b").alias("y"),
                                         F.col("shared").alias("base"))
    least = least_shared(size_sum, percent)
    judged = materialise(led.join(known, ["x", "y"]).withColumn(
        "sure", F.col("base") - F.col("minus_a") - F.col("minus_b") >= least).withColumn(
        "open", ~F.col("sure") & (F.col("base") + F.col("plus_a") + F.col("plus_b") >= least)),
        "judged")
    compared = materialise(compare(judged.where("open").select("a", "b"), sets).where(enough)
                           .select("a", "b"), "compared")
    found = judged.where("sure").unionByName(
        judged.join(compared, ["a", "b"], "left_semi")).select(
        F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return merged(labels, found)


def digests(docs: DataFrame) -> DataFrame:
    """All columns but ``text``, with ``n_shingles, node, crc`` and marks, of every row."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = ["n_shingles", "node", "crc", *MARK_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_BYTES):
            owner, h, sizes, digest = shingle_sets(texts)
            marks = _marks(owner, h, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(sizes.astype(np.int64)),
                 pa.array(digest.view(np.int64)),
                 pa.array(np.array([zlib.crc32(t) for t in texts], np.int64)),
                 *[pa.array(np.ascontiguousarray(m)) for m in marks.T]],
                names=[*[f.name for f in kept], *names])

    return docs.mapInArrow(run, StructType([*kept, *[StructField(n, LongType()) for n in names]]))


def _classes(each: DataFrame, labels: DataFrame, least: Column) -> DataFrame:
    """``node, top``: the least value in the class of each set that is not empty."""
    per_node = each.where("n_shingles > 0").groupBy("node").agg(F.min(least).alias("least")) \
        .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = regrouped(per_node.groupBy("label").agg(F.min("least").alias("top")), "label")
    return per_node.join(tops, "label").select("node", "top")


def similar_documents(docs: DataFrame, *, percent: int = PERCENT, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents are linked when their sets of word n-grams share ``percent`` of their
    union or more; the component is the smallest id that links reach.  The join is exact up
    to equal 64-bit hashes.  A null text is empty; a text without words has no shingles
    and is linked with nothing, not even with its like.  Repeated rows are linked; rows
    with equal ids and different texts are separate documents that report the same id; a
    null id is never the smallest; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    each = materialise(digests(rows), "digests")
    labels = materialise(linked_nodes(rows, each, percent), "linked")
    return each.join(_classes(each, labels, F.col("doc_id")), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.col("top")).alias("component_id"))


def first_of_each_class(docs: DataFrame, *, percent: int = PERCENT, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """The documents with one row of each class: that with the smallest id.

    Texts without words are in no class and all stay.  Of rows equal in all columns one
    stays.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"),
                         row_key(docs).alias(KEY))
    each = materialise(digests(narrow), "digests")
    labels = materialise(linked_nodes(narrow, each, percent), "linked")
    best = F.struct(F.col("doc_id"), F.col(KEY))
    tops = _classes(each, labels, best).select(F.col("top")[KEY].alias(KEY)).distinct()
    counts = each.groupBy(KEY).agg(F.count(F.lit(1)).alias(COPIES),
                                   F.max("n_shingles").alias("n_shingles"))
    kept = counts.where("n_shingles > 0").join(tops, KEY, "left_semi") \
        .select(KEY, COPIES, F.lit(1).alias("__take"))
    empty = counts.where("n_shingles = 0").select(KEY, COPIES, F.col(COPIES).alias("__take"))
    return take_copies(keyed(docs), kept.unionByName(empty), "__take", "__index") \
        .select(*unpacked(*docs.columns))
