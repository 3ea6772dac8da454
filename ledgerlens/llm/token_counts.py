"""Token counts, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 16  # code points that are encoded at once
OVERLAP = 1 << 10  # of neighbouring chunks; doubled until they meet
BATCH = 512  # texts handed to the library at once


def inner_pairs(model) -> set[str]:
    """All pairs of characters that stand side by side inside some piece.

    A merge joins two characters only if a piece holds them side by side.  Between any
    other two no merge can ever happen, so what stands left and right of that place is
    encoded alike whether or not the other side is there.
    """
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            pairs.update(a + b for a, b in zip(piece, piece[1:]))
    return pairs


class ChunkedCounter:
    """Counts of long texts from overlapping chunks."""

    def __init__(self, model, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model, self.chunk, self.overlap = model, chunk, overlap
        self.pairs = inner_pairs(model)

    def _starts(self, text: str, start: int, end: int) -> np.ndarray:
        """Where the tokens of one chunk begin, in the whole text."""
        part = text[start:end]
        begins = np.array([p.begin for p in self.model.encode(part, return_type="proto").pieces],
                          np.int64)  # in bytes
        heads = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        return start + (np.cumsum(heads)[begins] - 1 if len(begins) else begins)

    def _stable(self, text: str, place: int) -> bool:
        return text[place - 1:place + 1].replace(" ", "▁") not in self.pairs

    def _meeting(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int
                 ) -> int | None:
        """First place where a token begins in both chunks and nothing merges across."""
        both = np.intersect1d(left[(left > low) & (left < high)], right[right > low])
        return next((p for p in both.tolist() if self._stable(text, p)), None)

    def count(self, text: str) -> int:
        """The tokens of the whole text, as the library counts them at once.

        Each chunk gives the tokens from the place where it meets the one before to the
        place where it meets the next.  Chunks that don't meet overlap more; at the end of
        the text a chunk takes all that is left.
        """
        total, start, cut, overlap = 0, 0, 0, self.overlap
        left = None
        while True:
            end = start + self.chunk
            stop = end + overlap
            if left is None or overlap > self.overlap:
                left = self._starts(text, start, stop)
            if stop >= len(text):
                return total + len(left) - int(np.searchsorted(left, cut) if cut else 0)
            right = self._starts(text, end, end + self.chunk + self.overlap)
            place = self._meeting(text, left, right, end, stop)
            if place is None:
                overlap *= 2
                continue
            total += int(np.searchsorted(left, place)) \
                - int(np.searchsorted(left, cut) if cut else 0)
            start, cut, left, overlap = end, place, right, self.overlap


def token_counts(docs: DataFrame, model_path: str | None = None, *, limit: int = 4096,
                 chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    The model file is read once on the driver and sent to the tasks (its size does not
    depend on the data).  Texts up to ``chunk`` code points are encoded whole.  A null text
    is empty and has no tokens; repeated rows are counted each; an empty table gives an
    empty result; other columns are ignored.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    with open(model_path, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        counter = ChunkedCounter(model, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(1).to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = np.zeros(len(texts), np.int64)
                counts[short] = [len(x) for x in model.encode([texts[i] for i in short],
                                                              num_threads=1)]
                for i in set(range(len(texts))).difference(short):
                    counts[i] = counter.count(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts)],
                    names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"), text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")) \
        .mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
