"""Byte-pair encoding and decoding with a sentencepiece model, by vectorised merge rounds.

Two characters can only be merged if some piece holds them side by side, so a text falls
apart into words that are encoded on their own.  Each distinct word of a block is encoded
once, all of them together: one flat array of symbols, the best pair of each word by a
segmented minimum, all its places merged at once from the left, and compaction, until no
word has a pair left.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerlens.llm.token_counts import inner_pairs

SPACE = "▁"  # how a model spells a blank
BLOCK = 1 << 18  # code points that are cut into words at once
MOST_WORDS = 1 << 19  # encoded words that are remembered
BATCH_POINTS = 1 << 20  # code points of the texts of one output batch
NEVER = np.iinfo(np.int32).max


def _unknown_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs given by their starts and lengths, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceCoder:
    """Encoder and decoder of one byte-pair model that keeps texts as they are.

    Symbols are the model's pieces and the characters inside them.  The pair table gives
    for two symbols the one that joins them, and its rank: smaller ranks merge first, equal
    ones from the left.
    """

    def __init__(self, model):
        codecs.register_error("each-byte", _unknown_bytes)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                   for i in range(size)]
        if model.normalize("a  ﬁ ") != f"{SPACE}a{SPACE}{SPACE}ﬁ " \
                or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model rewrites texts or has unused pieces")
        plain = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.inner = inner_pairs(model)
        letters = sorted({c for p in plain for c in p}.difference(plain))
        self.symbols = {**plain, **{c: size + k for k, c in enumerate(letters)}}
        self.known, self.loose = size, letters  # larger symbols are no pieces
        scores = np.array([model.get_score(i) for i in range(size)])
        order = np.unique(-scores)
        rank = np.searchsorted(order, -scores).astype(np.int32)

        n = size + len(letters)
        self.width = n
        pairs = {}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                x, y = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if x is not None and y is not None:
                    pairs[x * n + y] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_symbol = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_rank = rank[self.pair_symbol] if len(pairs) else np.zeros(0, np.int32)
        self.joins, self.ranks = pairs, rank.tolist()
        # A rank is plain if one piece has it and no pair with that piece comes earlier;
        # only then does merging one place leave the next place of that rank as it was.
        uses = np.zeros(len(order), np.int64)
        np.add.at(uses, rank[list(plain.values())], 1)
        self.plain_rank = uses <= 1
        own = np.concatenate([rank, np.full(len(letters), -1, np.int32)])
        for part in (self.pair_keys // n, self.pair_keys % n):
            early = (own[part] >= 0) & (self.pair_rank <= own[part])
            self.plain_rank[own[part][early]] = False

        self.byte_ids = np.array([next((i for i in range(size) if model.is_byte(i)
                                        and self.pieces[i] == f"<0x{b:02X}>"), 0)
                                  for b in range(256)], np.int32)
        self._letters(plain)
        self._surfaces(model)
        self.words: dict[str, int] = {}
        self._forget()

    # Encoding

    def _letters(self, plain: dict[str, int]) -> None:
        """Small numbers of the characters inside pieces, and which of them may stand
        side by side."""
        letters = sorted({c for p in plain for c in p})
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.number = np.zeros(0x110000, np.int16 if len(letters) < 1 << 15 else np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letter_symbol = np.array([0, *[self.symbols[c] for c in letters]], np.int64)
        wide = len(letters) + 1
        bits = np.zeros(-(-wide * wide // 8), np.uint8)
        at = np.array([number[p[0]] * wide + number[p[1]] for p in self.inner], np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.wide, self.together = wide, bits

    def _forget(self) -> None:
        self.words.clear()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _words(self, text: str) -> list[str]:
        """A text in its spelling for the model, cut where no piece reaches across."""
        number = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        pair = number[:-1] * self.wide + number[1:]
        joined = (self.together[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1
        cuts = np.flatnonzero(joined == 0) + 1
        edges = [0, *cuts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])]

    def _symbols_of(self, words: list[str]) -> np.ndarray:
        """The letters of all words; one that stands in no piece is minus its code point,
        less 1."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        number = self.number[points]
        return np.where(number > 0, self.letter_symbol[number], -1 - points)

    def _ids_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all symbols, and how many each has: a letter without a piece is
        spelled in bytes."""
        ids, counts = symbols.astype(np.int32), np.ones(len(symbols), np.int64)
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.known))
        if not len(odd):
            return ids, counts
        spelled = [(chr(-1 - s) if s < 0 else self.loose[s - self.known]).encode()
                   for s in symbols[odd].tolist()]
        counts[odd] = [len(b) for b in spelled]
        ids = np.repeat(ids, counts)
        ids[np.repeat(np.isin(np.arange(len(symbols)), odd), counts)] = \
            self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, counts

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What joins neighbouring symbols, and its rank (``NEVER`` if nothing does)."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
        if not len(self.pair_keys):
            return np.zeros(len(key), np.int32), np.full(len(key), NEVER, np.int32)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return self.pair_symbol[at], np.where(found, self.pair_rank[at], NEVER)

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """One word merged in strict order, for ranks whose places depend on each other."""
        symbols = list(symbols)
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]

        def entry(i: int) -> tuple[int, int, int, int, int] | None:
            j = after[i] if i >= 0 else -1
            if j < 0 or symbols[i] < 0 or symbols[j] < 0:
                return None
            joined = self.joins.get(symbols[i] * self.width + symbols[j])
            return joined and (self.ranks[joined], i, symbols[i], symbols[j], joined)

        heap = [e for e in map(entry, range(len(symbols) - 1)) if e]
        heapify(heap)
        gone = [False] * len(symbols)
        while heap:
            _, i, x, y, joined = heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != x or symbols[j] != y:
                continue
            symbols[i], gone[j], after[i] = joined, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for e in (entry(before[i]), entry(i)):
                if e:
                    heappush(heap, e)
        return [s for s, g in zip(symbols, gone) if not g]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has, by rounds over all words at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self._symbols_of(words)
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        ended: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            joined, rank = self._pairs(symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)])
            return joined, np.where(ends[at], NEVER, rank)

        joined, rank = pairs_at(np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
            sizes = np.diff(np.append(starts, len(symbol)))
            least = np.minimum.reduceat(rank, starts)
            best = rank == np.repeat(least, sizes)
            # Words without a pair are done; those with several places of a rank that is not
            # plain are ended one merge at a time.
            done = least == NEVER
            single = ~done & ~self.plain_rank[np.where(done, 0, least)] \
                & (np.add.reduceat(best, starts, dtype=np.int64) > 1)
            over = np.repeat(done, sizes)
            ended.append((word[over], symbol[over]))
            for k in np.flatnonzero(single).tolist():
                own = self._one_by_one(symbol[starts[k]:starts[k] + sizes[k]].tolist())
                ended.append((np.full(len(own), word[starts[k]]), np.array(own, np.int64)))
            stay = ~(over | np.repeat(single, sizes))
            # Of neighbouring places the first, third and so on, from the left.
            at = np.flatnonzero(best & stay)
            opens = np.ones(len(at), bool)
            opens[1:] = at[1:] != at[:-1] + 1
            run = np.flatnonzero(opens)
            inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[inside % 2 == 0]
            symbol[at] = joined[at]
            ends[at] = ends[at + 1]
            stay[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            symbol, word, ends, joined, rank, changed = (
                a[stay] for a in (symbol, word, ends, joined, rank, changed))
            fresh = np.flatnonzero(changed)
            joined[fresh], rank[fresh] = pairs_at(fresh)
        word, symbol = (np.concatenate([x[i] for x in ended] or [symbol]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        ids, counts = self._ids_of(symbol[order])
        return ids, np.bincount(word[order], counts, len(words)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode and remember words; all of them are distinct and new."""
        ids, lengths = self.merge(words)
        at = len(self.lengths)
        self.words.update(zip(words, range(at, at + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts of a text in the model's spelling, cut where no piece reaches across."""
        start, end = 0, 0
        while end < len(text):
            end = min(start + BLOCK, len(text))
            while end < len(text) and text[end - 1:end + 1].replace(" ", SPACE) in self.inner:
                end += 1
            yield (SPACE if start == 0 else "") + text[start:end].replace(" ", SPACE)
            start = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[list[str]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            met = set(chain.from_iterable(held))
            new = met.difference(self.words)
            if len(self.words) + len(new) > MOST_WORDS:
                self._forget()
                new = met
            if new:
                self._learn(list(new))
            sizes = [len(words) for words in held]
            at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(held)), np.int64,
                             sum(sizes))
            counts[:] += np.bincount(np.repeat(owners, sizes), self.lengths[at],
                                     len(texts)).astype(np.int64)
            parts.append(self.ids[_runs(self.starts[at], self.lengths[at])])

        for i, text in enumerate(texts):
            for block in self._blocks(text):
                held.append(self._words(block))
                owners.append(i)
                size += len(block)
                if size >= BLOCK:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), counts

    # Decoding

    def _surfaces(self, model) -> None:
        """The bytes each id stands for."""
        surface = []
        for i, piece in enumerate(self.pieces):
            if model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(model.decode([i]).encode())
            elif model.is_byte(i):
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append(piece.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_lengths = np.array([len(s) for s in surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_lengths) - self.surface_lengths
        self.opens = np.array([p.startswith(SPACE) and not model.is_unknown(i)
                               for i, p in enumerate(self.pieces)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; a byte that belongs to no character is U+FFFD.

        The blank that encoding puts before a text is taken off again.
        """
        at = self.surface_starts[ids]
        lengths = self.surface_lengths[ids].copy()
        some = np.flatnonzero(lengths > 0)
        if len(some) and self.opens[ids[some[0]]]:
            at[some[0]] += 1
            lengths[some[0]] -= 1
        return self.surface[_runs(at, lengths)].tobytes().decode("utf-8", "each-byte")


def _coder(proto: bytes) -> PieceCoder:
    import sentencepiece

    return PieceCoder(sentencepiece.SentencePieceProcessor(model_proto=proto))


def _model(df: DataFrame, path: str | None):
    """The model file, sent to the tasks; its size does not depend on the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``BATCH_POINTS`` together, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BATCH_POINTS:
            yield start, i
            start, held = i, 0
        held += size
    yield start, len(sizes)


def encoded(docs: DataFrame, model_path: str | None = None, *, text_column: str = "text",
            ids: str = "ids") -> DataFrame:
    """All columns but the text, and the token ids of the whole text.

    A null or empty text has no ids.  Repeated rows are encoded each; an empty table gives
    an empty result; a column of the name of the ids is replaced.
    """
    proto = _model(docs, model_path)
    kept = [f for f in docs.schema.fields if f.name not in (text_column, ids)]
    rows = docs.select(text_column, *[F.col(f"`{f.name}`") for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            coder = coder or _coder(proto.value)
            sizes = [0 if n is None else n for n in
                     pc.binary_length(whole.column(0)).to_pylist()]
            for start, end in _groups(sizes):
                batch = whole.slice(start, end - start)
                flat, counts = coder.encode([t or "" for t in batch.column(0).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets),
                                                                  pa.array(flat))],
                    names=[*[f.name for f in kept], ids])

    return rows.mapInArrow(run, StructType([
        *kept, StructField(ids, ArrayType(IntegerType()))]))


def decoded(rows: DataFrame, model_path: str | None = None, *, ids: str = "ids",
            text: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for; null ids stand for the empty text."""
    proto = _model(rows, model_path)
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            coder = coder or _coder(proto.value)
            lists = whole.column(whole.schema.get_field_index(ids))
            sizes = [n or 0 for n in pc.list_value_length(lists).to_pylist()]
            for start, end in _groups(sizes):
                part = lists.slice(start, end - start)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                edges = np.concatenate([[0], np.cumsum(sizes[start:end])])
                texts = [coder.decode(flat[a:b]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*whole.slice(start, end - start).columns, pa.array(texts, pa.string())],
                    names=[*[f.name for f in kept], text])

    return rows.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(
        run, StructType([*kept, StructField(text, StringType())]))
