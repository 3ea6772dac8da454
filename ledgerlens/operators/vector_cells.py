"""Nearest neighbours through cells: every vector lies in the cell of its nearest centre.

The centres are trained on a bounded sample; every vector is in a cell.  A search reads the
cells near a query.  How near the rest can come follows from distances to centres alone: by
the triangle inequality from how far a cell reaches, and from the plane half way between two
centres.  Cells that cannot hold one of the k nearest are skipped unread, so the answer is
exact; with a number of ``probes`` only so many cells are read and it is approximate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.operators.search import ranked_first
from ledgerlens.sources.storage import materialise

CELL_ROWS = 2_000  # of a cell, on average
MOST_CELLS = 4_096
CENTRE_BYTES = 32 << 20  # of all centres together
SAMPLE_BYTES = 32 << 20  # of vectors that the centres are trained on
BLOCK_BYTES = 16 << 20  # of either side that meet in one task
ROUNDS = 8  # of training
SEED = 20_240_601
DIGITS = 10  # of a distance; so sums in another order give equal distances


def task_functions(k: int):
    """The functions that tasks run.

    Nested, so that they travel with the job and workers need not have this
    package installed.
    """

    def matrix(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()).astype(np.float64)

    def squares(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Squared distances of all rows to all others, within rounding."""
        rough = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ others.T) \
            + (others * others).sum(axis=1)
        return np.maximum(rough, 0)

    def nearest(ids: np.ndarray, rows: np.ndarray,
                queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """k smallest squared distances of each query, ties by id.

        One matrix product finds the candidates: all within rounding of the k-th distance.
        Their distances are then computed from the differences.
        """
        size, other = ((x * x).sum(axis=1) for x in (rows, queries))
        found = []
        step = max(1, (1 << 22) // max(1, len(rows)))
        for start in range(0, len(queries), step):
            part = queries[start:start + step]
            rough = size - 2 * (part @ rows.T) + other[start:start + step, None]
            if len(ids) > k:
                scale = size.max(initial=0.0) + other[start:start + step]
                limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * scale
            else:
                limit = np.full(len(part), np.inf)
            for query, distances, most in zip(part, rough, limit):
                near = np.flatnonzero(distances <= most)
                gap = rows[near] - query
                squared = np.round(np.einsum("ij,ij->i", gap, gap), DIGITS)
                order = np.lexsort((ids[near], squared))[:k]
                found.append((ids[near][order], squared[order]))
        return found

    return matrix, squares, nearest


@dataclass(frozen=True)
class Cells:
    """Trained centres, every vector with its cell, and what is known of each cell.

    ``table`` has ``cell, far, id, vector``; ``known`` has one row for each cell that is not
    empty: ``cell, rows, near, far``, the least and the greatest distance to its centre.
    """

    centres: np.ndarray
    table: DataFrame
    known: pd.DataFrame
    block_bytes: int


def train_centres(vectors: DataFrame, cells: int, *, sample_bytes: int = SAMPLE_BYTES,
                  rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means over the vectors with the smallest hash of their id."""
    size = 8 * (vectors.select(F.size("vector")).limit(1).collect() or [[1]])[0][0]
    sample = vectors.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").select("vector") \
        .limit(max(1, sample_bytes // size)).toPandas()
    matrix, squares, _ = task_functions(1)
    if not len(sample):
        return np.zeros((0, 0))
    rows = matrix(sample["vector"])
    centres = rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])][:cells]
    step = max(1, (1 << 22) // len(centres))
    for _ in range(rounds):
        own = np.concatenate([squares(rows[i:i + step], centres).argmin(axis=1)
                              for i in range(0, len(rows), step)])
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def build(vectors: DataFrame, *, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS,
          sample_bytes: int = SAMPLE_BYTES, block_bytes: int = BLOCK_BYTES) -> Cells:
    """Train the centres and give every vector its cell.

    ``vectors`` has ``id, vector``, all of one size.  The driver gets the sample and one row
    for each cell.
    """
    vectors = vectors.select("id", "vector")
    rows, size = vectors.agg(F.count("*"), F.max(8 * F.size("vector"))).first()
    cells = min(most_cells, CENTRE_BYTES // (size or 1), max(1, round(rows / cell_rows)))
    centres = train_centres(vectors, max(1, cells), sample_bytes=sample_bytes)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    matrix, squares, _ = task_functions(1)
    step = max(1, (1 << 22) // max(1, len(centres)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                own = matrix(part["vector"])
                cell = squares(own, shared.value).argmin(axis=1)
                gap = own - shared.value[cell]
                yield part.assign(cell=cell, far=np.sqrt(np.einsum("ij,ij->i", gap, gap)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    table = materialise(vectors.mapInPandas(place, f"{kinds}, cell int, far double")
                        .select("cell", "far", "id", "vector"), "vector-cells")
    known = table.groupBy("cell").agg(F.count("*").alias("rows"), F.min("far").alias("near"),
                                      F.max("far").alias("far")).toPandas()
    return Cells(centres, table, known.sort_values("cell"), block_bytes)


def _routes(queries: DataFrame, index: Cells, choose: Callable) -> DataFrame:
    """``query_id, cell``: the cells that each query reads.

    ``choose(batch, distances)`` marks them, from the rows of a batch and their distances to
    the centres of all known cells.
    """
    cells = index.known["cell"].to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast(
        index.centres[cells] if len(cells) else np.zeros((0, 1)))
    matrix, squares, _ = task_functions(1)
    step = max(1, (1 << 22) // max(1, len(cells)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                distances = np.sqrt(squares(matrix(part["vector"]), shared.value))
                query, cell = np.nonzero(choose(part, distances, shared.value))
                yield pd.DataFrame({"query_id": part["id"].to_numpy()[query], "cell": cells[cell]})

    kind = queries.schema["id"].dataType.simpleString()
    return queries.mapInPandas(route, f"query_id {kind}, cell int")


def first_cells(queries: DataFrame, index: Cells, k: int, probes: int | None = None) -> DataFrame:
    """The nearest ``probes`` cells of each query, or as few as hold k vectors together."""
    rows = index.known["rows"].to_numpy()

    def choose(_: pd.DataFrame, distances: np.ndarray, __: np.ndarray) -> np.ndarray:
        return nearest_first(distances, rows, k, probes)

    nearest_first = _nearest_first()
    return _routes(queries, index, choose)


def _nearest_first():
    def nearest_first(distances: np.ndarray, rows: np.ndarray, k: int, probes: int | None
                      ) -> np.ndarray:
        order = np.argsort(distances, axis=1, kind="stable")
        if probes is None:
            before = np.cumsum(rows[order], axis=1) - rows[order]
            wanted = before < k
        else:
            wanted = np.broadcast_to(np.arange(distances.shape[1]) < probes, distances.shape)
        chosen = np.zeros(distances.shape, bool)
        np.put_along_axis(chosen, order, wanted, axis=1)
        return chosen

    return nearest_first


def further_cells(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """The cells not read yet that may hold a vector nearer than ``reach``.

    ``queries`` has ``id, vector, reach``: the k-th squared distance found so far, null if
    fewer were found.
    """
    rows, near, far = (index.known[c].to_numpy() for c in ("rows", "near", "far"))
    nearest_first = _nearest_first()
    _, squares, _ = task_functions(1)

    def choose(part: pd.DataFrame, distances: np.ndarray, centres: np.ndarray) -> np.ndarray:
        reach = np.sqrt(part["reach"].fillna(np.inf).to_numpy().astype(float))
        least = np.maximum(distances - far, near - distances)
        if distances.shape[1]:
            # The plane half way to the centre of the query's own cell.
            own = distances.argmin(axis=1)
            apart = np.sqrt(squares(centres, centres))[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (distances ** 2 - distances.min(axis=1)[:, None] ** 2) / (2 * apart)
            least = np.maximum(least, np.where(apart > 0, plane, 0))
        scale = 1 + distances + far
        return (least <= reach[:, None] + 1e-6 * scale) \
            & ~nearest_first(distances, rows, k, None)

    return _routes(queries, index, choose)


def _search(index: Cells, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance``: the best k of each query in each block it reads.

    A cell, and the queries that read it, are cut into blocks of ``block_bytes``; two blocks
    meet in one task.  A vector is copied only for further blocks of queries of its cell.
    """
    spark = queries.sparkSession
    pairs = materialise(pairs, "routes")
    asked = pairs.groupBy("cell").agg(F.count("*").alias("asked")).toPandas()
    fits = max(1, index.block_bytes // (8 * max(1, index.centres.shape[1])))
    plan = index.known[["cell", "rows"]].merge(asked, on="cell")
    blocks = spark.createDataFrame(
        [(int(c), -(-int(r) // fits), -(-int(q) // fits)) for c, r, q in
         plan[["cell", "rows", "asked"]].itertuples(index=False)],
        "cell int, parts int, packs int")  # one row for each cell

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one_of(name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(n)).cast("int")

    keys = ["cell", "part", "pack"]
    left = index.table.join(F.broadcast(blocks), "cell").select(
        "cell", one_of("id", "parts").alias("part"), every("packs").alias("pack"), "id", "vector")
    right = pairs.join(F.broadcast(blocks), "cell").select(
        "cell", every("parts").alias("part"), one_of("query_id", "packs").alias("pack"), "query_id") \
        .join(queries.select(F.col("id").alias("query_id"), "vector"), "query_id")
    matrix, _, nearest = task_functions(k)

    def search(near_side: pd.DataFrame, query_side: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "distance": []})]
        if len(near_side) and len(query_side):
            ids, rows = near_side["id"].to_numpy(), matrix(near_side["vector"])
            answers = nearest(ids, rows, matrix(query_side["vector"]))
            counts = [len(near) for near, _ in answers]
            out = [pd.DataFrame({
                "query_id": np.repeat(query_side["query_id"].to_numpy(), counts),
                "id": np.concatenate([near for near, _ in answers]),
                "distance": np.concatenate([squared for _, squared in answers])})]
        return pd.concat(out)

    kind, q_kind = (df.schema["id"].dataType.simpleString() for df in (index.table, queries))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, f"query_id {q_kind}, id {kind}, distance double")


def search(index: Cells, queries: DataFrame, k: int, *, probes: int | None = None,
           written: bool = False) -> DataFrame:
    """k nearest vectors per query: ``query_id, id, distance, rank``.

    ``queries`` has ``id, vector`` with distinct ids; ``written`` says that it is a stored
    table already.  Without ``probes`` the answer is
    exact: the nearest cells give k vectors, and then every cell is read that may hold a
    nearer one.
    """
    queries = queries.select("id", "vector")
    if not written:
        queries = materialise(queries, "query-vectors")
    order = [F.asc("distance"), F.asc("id")]

    def best(found: DataFrame) -> DataFrame:
        return ranked_first(found, "query_id", order, k) \
            .select("query_id", "id", "distance", "rank")

    first = best(_search(index, queries, first_cells(queries, index, k, probes), k))
    if probes is not None:
        return first
    first = materialise(first, "first-found")
    # One row per query, written so that the join can be split.
    reach = materialise(first.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("distance").alias("reach")), "reach")
    open_queries = queries.join(reach, "id", "left")
    more = _search(index, queries, further_cells(open_queries, index, k), k)
    return best(first.drop("rank").unionByName(more))
