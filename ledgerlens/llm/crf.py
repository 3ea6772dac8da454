"""Linear-chain conditional random fields in numpy, many chains at a time.

A long chain is cut into blocks.  Each block first tells how well every label before it
leads to every label at its end; with these tables the state is carried from block to block,
and then all blocks are worked on side by side, as if they were chains of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CELLS = 1 << 16  # places, padding included, that are worked on at once
BLOCK = 1 << 7  # places of a long chain that stay together
NEVER = -1e9  # score of a forbidden label


@dataclass
class Model:
    """Scores ``weights`` of features and labels and ``moves`` between labels."""

    weights: np.ndarray
    moves: np.ndarray


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Chains of similar length, by number; about ``CELLS`` places together."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def _spread(a: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the last but one axis."""
    top = a.max(axis=-2)
    return top + np.log(np.exp(a - top[..., None, :]).sum(axis=-2))


def _most(a: np.ndarray) -> np.ndarray:
    return a.max(axis=-2)


def _spread_on(state: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``_spread`` of the ways from each label on to each, as one product."""
    top = state.max(axis=-1, keepdims=True)
    return top + np.log(np.exp(state - top) @ np.exp(moves))


def _most_on(state: np.ndarray, moves: np.ndarray) -> np.ndarray:
    return _most(state[..., None] + moves)


class _Blocks:
    """The blocks of all chains: short chains whole, long ones in parts of ``BLOCK``.

    ``combine`` is how ways to one label add up: the logarithm of their sum, or the best;
    ``on`` does that for one step.
    """

    def __init__(self, scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray,
                 combine: Callable[[np.ndarray], np.ndarray],
                 on: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.scores, self.moves, self.combine, self.on = scores, moves, combine, on
        count = -(-lengths // BLOCK)
        self.chain = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(len(self.chain)) - np.repeat(np.cumsum(count) - count, count)
        starts = np.cumsum(lengths) - lengths
        self.starts = starts[self.chain] + nth * BLOCK
        self.sizes = np.minimum(BLOCK, lengths[self.chain] - nth * BLOCK)
        self.first, self.last = nth == 0, nth == count[self.chain] - 1

    def groups(self, wanted: np.ndarray | None = None
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of similar size: their numbers, padded places, and which are real."""
        sizes = self.sizes if wanted is None else np.where(wanted, self.sizes, 0)
        for some in _groups(sizes):
            steps = np.arange(sizes[some[-1]])
            real = steps < sizes[some][:, None]
            yield some, np.where(real, self.starts[some][:, None] + steps, 0), real

    def ways(self, wanted: np.ndarray, into: np.ndarray) -> np.ndarray:
        """For the wanted blocks the ways from each label before them to each at their end;
        a chain's first block has no label before it, only ways into it."""
        out = np.zeros((len(self.sizes), len(self.moves), len(self.moves)))
        for some, places, real in self.groups(wanted):
            u = self.scores[places]
            here = np.where(self.first[some][:, None, None], into[some][:, None], self.moves) \
                + u[:, 0, None]
            for t in range(1, u.shape[1]):
                here = np.where(real[:, t, None, None],
                                self.on(here, self.moves) + u[:, t, None], here)
            out[some] = here
        return out

    def tables(self, enter: np.ndarray | None = None, leave: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ways into each block's first place and out of its last one, by label.

        ``enter`` and ``leave`` are those of the chains, zeros by default; only the inner
        blocks of long chains need more.
        """
        into, out = (np.zeros((len(self.sizes), len(self.moves))) for _ in range(2))
        if enter is not None:
            into[self.first] = enter[self.chain[self.first]]
        if leave is not None:
            out[self.last] = leave[self.chain[self.last]]
        several = ~(self.first & self.last)
        if not several.any():
            return into, out
        ways, ends = self.ways(several, into), into[0]
        for b in np.flatnonzero(several).tolist():
            if not self.first[b]:
                into[b] = self.combine(ends[:, None] + self.moves)
            ends = ways[b][0] if self.first[b] else self.combine(ends[:, None] + ways[b])
        for b in np.flatnonzero(several)[::-1].tolist():
            if not self.last[b]:
                out[b] = self.combine((ways[b + 1] + out[b + 1]).T)
        return into, out


def chain_ways(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Ways from each label before a part of a chain to each label at its end."""
    blocks = _Blocks(scores, np.array([len(scores)]), moves, _spread, _spread_on)
    blocks.first[:] = False
    each = blocks.ways(np.ones(len(blocks.sizes), bool), np.zeros((len(blocks.sizes), len(moves))))
    whole = each[0]
    for one in each[1:]:
        whole = onward(whole, one)
    return whole


def onward(state: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """A state (or several) carried on along ways from label to label."""
    return _spread(state[..., None] + ways)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, *,
              enter: np.ndarray | None = None, leave: np.ndarray | None = None
              ) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each label at each place, and the expected number of each move.

    ``scores`` holds the places of all chains one after the other.  ``enter`` and ``leave``
    are the ways into and out of each chain, if it is a part of a longer one.
    """
    out = np.zeros(scores.shape)
    expected = np.zeros(moves.shape)
    blocks = _Blocks(scores, lengths, moves, _spread, _spread_on)
    into, leave = blocks.tables(enter, leave)
    head, tail = np.zeros(into.shape), np.zeros(into.shape)
    for some, places, real in blocks.groups():
        rows, ends = np.arange(len(some)), blocks.sizes[some] - 1
        u = scores[places]
        steps = u.shape[1]
        ahead = np.zeros(u.shape)
        back = np.repeat(leave[some][:, None], steps, axis=1)
        ahead[:, 0] = u[:, 0] + into[some]
        for t in range(1, steps):
            ahead[:, t] = u[:, t] + _spread_on(ahead[:, t - 1], moves)
        for t in range(steps - 2, -1, -1):
            back[:, t] = np.where(real[:, t + 1, None], _spread_on(
                u[:, t + 1] + back[:, t + 1], moves.T), back[:, t])
        tail[some] = ahead[rows, ends]
        whole = _spread((tail[some] + leave[some])[:, :, None])[:, 0]
        out[places[real]] = np.exp((ahead + back - whole[:, None, None])[real])
        head[some] = u[:, 0] + back[:, 0] - whole[:, None]
        if steps > 1:
            here, top = real[:, 1:], ahead[:, :-1].max(axis=2, keepdims=True)
            ours = np.exp((ahead[:, :-1] - top)[here])
            theirs = np.exp(((u + back)[:, 1:] + top - whole[:, None, None])[here])
            expected += np.exp(moves) * (ours.T @ theirs)
    later = np.flatnonzero(~blocks.first)  # moves from the block before
    expected += np.exp(tail[later - 1][:, :, None] + moves + head[later][:, None]).sum(axis=0)
    return out, expected


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of all chains; of equal paths the one with smaller labels."""
    labels = np.zeros(len(scores), np.int64)
    blocks = _Blocks(scores, lengths, moves, _most, _most_on)
    into, _ = blocks.tables()
    best, origin = np.zeros(into.shape), np.zeros(into.shape, np.int64)
    held = []
    for some, places, real in blocks.groups():
        u = scores[places]
        now = u[:, 0] + into[some]
        came = np.zeros(u.shape, np.int8)
        first = np.repeat(np.arange(len(moves))[None], len(some), axis=0)
        for t in range(1, u.shape[1]):
            ways = now[:, :, None] + moves
            came[:, t] = ways.argmax(axis=1)
            here = real[:, t, None]
            now = np.where(here, ways.max(axis=1) + u[:, t], now)
            first = np.where(here, np.take_along_axis(first, came[:, t].astype(int), 1), first)
        best[some], origin[some] = now, first
        held.append((some, places, real, came))
    ends = best.argmax(axis=1)
    for b in np.flatnonzero(~blocks.last)[::-1].tolist():
        ends[b] = (best[b] + moves[:, origin[b + 1, ends[b + 1]]]).argmax()
    for some, places, real, came in held:
        rows = np.arange(len(some))
        path = np.zeros(real.shape, np.int64)
        now = ends[some]
        for t in range(real.shape[1] - 1, -1, -1):
            path[:, t] = now
            now = np.where(real[:, t], came[rows, t, now], now) if t else now
        labels[places[real]] = path[real]
    return labels


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, kinds: int, *,
          fixed: np.ndarray | None = None, penalty: float = 1.0, steps: int = 150,
          rate: float = 0.1) -> Model:
    """Largest penalised likelihood by gradient steps (Adam); the same input, the same model.

    ``fixed`` adds scores that are not learned.  Without chains the model scores nothing.
    """
    weights = np.zeros((features.shape[1], kinds))
    moves = np.zeros((kinds, kinds))
    if not len(labels):
        return Model(weights, moves)
    seen = np.zeros((len(labels), kinds))
    seen[np.arange(len(labels)), labels] = 1
    ends = np.cumsum(lengths)[lengths > 0]
    inner = np.ones(len(labels), bool)
    inner[ends - 1] = False
    counted = np.zeros_like(moves)
    np.add.at(counted, (labels[:-1][inner[:-1]], labels[1:][inner[:-1]]), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, moves)]
    for step in range(1, steps + 1):
        scores = features @ weights
        if fixed is not None:
            scores = scores + fixed
        chance, expected = marginals(scores, lengths, moves)
        slopes = (features.T @ (chance - seen) + penalty * weights,
                  expected - counted + penalty * moves)
        for p, slope, (mean, square) in zip((weights, moves), slopes, state):
            slope = slope / len(labels)
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            p -= rate * (mean / (1 - 0.9 ** step)) \
                / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Model(weights, moves)
