"""Sequences of whole samples under several orders of their voxels: one-dimensional pair encoding beside the three-dimensional one.

Samples come whole to tasks (``bpe3d.Corpus``), so that a pass puts their voxels in every order, replays the rules learned so far and
leaves only counts, which Spark adds up. A merged token of a sequence stands for a run of voxels in its order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import space
from .bpe3d import Corpus, Finder, Rule, replay, tally

#: Codes of places (arrays x, y, z) whose order the voxels take, ties by coordinates; by name.
Codes = dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


class Sequence:
    """The voxels of a run of samples in an order (``leaf``), and the tokens over them: where each begins in ``leaf``, its sample and token."""

    def __init__(self, find: Finder, token: np.ndarray, codes: np.ndarray):
        self.find = find
        self.leaf = np.lexsort((find.p[:, 2], find.p[:, 1], find.p[:, 0], codes, find.s))
        self.begin, self.s, self.token = np.arange(len(token)), find.s[self.leaf], token[self.leaf]

    def pairs(self) -> np.ndarray:
        """(a, b) of each two neighbouring tokens of a sample."""
        here = self.s[:-1] == self.s[1:]
        return np.column_stack([self.token[:-1][here], self.token[1:][here]])

    def merge(self, a: int, b: int, new_id: int) -> np.ndarray:
        """Disjoint left-to-right replacement (of a run of equal tokens every other pair); of each merge the least city-block distance between its two sides."""
        at = np.flatnonzero((self.token[:-1] == a) & (self.token[1:] == b) & (self.s[:-1] == self.s[1:]))
        if a == b and len(at):
            run = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        l1 = np.zeros(len(at), np.int64)
        if len(at):
            ends = np.append(self.begin[1:], len(self.leaf))
            wide = [range(int(ends[k] - self.begin[k])) for k in (at[0], at[0] + 1)]  # a token is as long wherever it occurs
            place = lambda k, i: self.find.p[self.leaf[self.begin[k] + i]]
            l1 = np.min([np.abs(place(at, i) - place(at + 1, j)).sum(axis=1) for i in wide[0] for j in wide[1]], axis=0)
        self.token[at] = new_id
        stays = np.ones(len(self.token), bool)
        stays[at + 1] = False
        self.begin, self.s, self.token = self.begin[stays], self.s[stays], self.token[stays]
        return l1

    def places(self) -> np.ndarray:
        """Of each voxel the place of its token in its sample's sequence."""
        out = np.empty(len(self.leaf), np.int64)
        out[self.leaf] = np.repeat(numbered(self.s), np.diff(np.append(self.begin, len(self.leaf))))
        return out


def numbered(s: np.ndarray) -> np.ndarray:
    """0, 1, ... over the rows of each sample; rows come by sample."""
    return np.arange(len(s)) - np.searchsorted(s, s)


def train(corpus: Corpus, codes: Codes, base_vocab: int, rounds: int, min_freq: int = 2) -> list[list[tuple[int, int, int]]]:
    """Under each order up to ``rounds`` rules (a, b, new id) of the most frequent neighbours, ties to the largest; one pass a round for all orders. Only the chosen pairs reach the driver."""
    learned: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    for k in range(rounds):
        going = [i for i, rules in enumerate(learned) if len(rules) == k]

        def count(find, token, own):
            for i, code in enumerate(codes.values()):
                if i in going:  # noqa: B023
                    seq = Sequence(find, token, code(*find.p.T))
                    for rule in learned[i]:
                        seq.merge(*rule)
                    pairs = seq.pairs()
                    yield tally(np.column_stack([np.full(len(pairs), i), pairs]))

        frequent = corpus.totals(count, "ord a b", []).where(F.col("n") >= min_freq)
        for r in frequent.groupBy("ord").agg(F.max(F.struct("n", "a", "b")).alias("best")).collect():  # a row for each order
            learned[r.ord].append((r.best.a, r.best.b, base_vocab + k))
    return learned


def panel(corpus: Corpus, codes: Codes, rules: list[Rule], learned: list[list[tuple[int, int, int]]]) -> DataFrame:
    """(order_name, encoder, kind, value, n): under each order and encoder ('1d' by ``learned``, '3d' by ``rules``) the ``gap`` between the tokens' places
    of face neighbours, and the distance ``l1`` between the two sides of each merge, counted by value."""

    def count(find, token, own):
        edges = [np.concatenate(side) for side in zip(*(find.step(np.arange(len(own)), f) for f in space.FACES), strict=True)]
        anchor = np.arange(len(own))
        replay(find, token.copy(), anchor, rules)
        alive = anchor == np.arange(len(own))

        def counted(order, encoder, kind, values):
            v, n = np.unique(values, return_counts=True)
            return np.column_stack([np.full(len(v), order), np.full(len(v), encoder), np.full(len(v), kind), v]), n

        for i, code in enumerate(codes.values()):
            seq = Sequence(find, token, code(*find.p.T))
            place = np.empty(len(own), np.int64)
            kept = seq.leaf[alive[seq.leaf]]
            place[kept] = numbered(find.s[kept])
            place = place[anchor]
            yield counted(i, 1, 0, np.abs(place[edges[0]] - place[edges[1]]))
            yield counted(i, 1, 1, np.ones(len(own) - len(kept), np.int64))  # the sides of such a merge touch
            for rule in learned[i]:
                yield counted(i, 0, 1, seq.merge(*rule))
            place = seq.places()
            yield counted(i, 0, 0, np.abs(place[edges[0]] - place[edges[1]]))

    named = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) + 1).cast("int"))
    n = corpus.totals(count, "ord enc kind value", [], rules)
    return n.select(named("ord", codes).alias("order_name"), named("enc", ("1d", "3d")).alias("encoder"), named("kind", ("gap", "l1")).alias("kind"), "value", "n")
