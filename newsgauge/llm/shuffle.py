"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

The n rows are numbered in the order of their values. The permutation works on the a * b numbers from n on up that are next
to a square: a number is a pair (l, r) with l < a and r < b, and each round adds a hash of one half to the other. A result
of n or more is put through again. As the map is one-to-one and at most a * b - n numbers are n or more, that many steps
suffice for every row, and at most that many rows (fewer than the root of n) take any. The place p of a row gives its
shard, p mod the number of shards, and its slot, p divided by it; both ways are computed, nothing is looked up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.llm.ordering import fresh, row_numbers, scalar


class Permutation:
    """A permutation of 0 .. n - 1, fixed by n, ``seed`` and ``rounds``; ``forward`` and ``backward`` make SQL expressions."""

    def __init__(self, n: int, seed: int = 1, rounds: int = 6):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))

    def _round(self, sign: str) -> str:
        """One round on the pair s; j is its number. Even rounds change l, odd ones r."""
        mixed = "pmod(xxhash64({seed}L, j, s.{other}), {size}L)"
        new_l = f"pmod(s.l {sign} {mixed.format(seed=self.seed, other='r', size=self.a)}, {self.a}L)"
        new_r = f"pmod(s.r {sign} {mixed.format(seed=self.seed, other='l', size=self.b)}, {self.b}L)"
        return (f"CASE WHEN j % 2 = 0 THEN named_struct('l', {new_l}, 'r', s.r) "
                f"ELSE named_struct('l', s.l, 'r', {new_r}) END")

    def _once(self, x: str, sign: str) -> str:
        order = f"sequence(0, {self.rounds - 1})" if sign == "+" else f"sequence({self.rounds - 1}, 0, -1)"
        return (f"aggregate({order}, named_struct('l', {x} % {self.a}L, 'r', {x} div {self.a}L), "
                f"(s, j) -> {self._round(sign)}, s -> s.l + {self.a}L * s.r)")

    def _walk(self, column: str, sign: str) -> Column:
        """``column`` holds a first result."""
        beyond = self.a * self.b - self.n
        if not beyond:
            return F.expr(column)
        again = f"CASE WHEN q < {self.n}L THEN q ELSE {self._once('q', sign)} END"
        return F.expr(f"CASE WHEN {column} < {self.n}L THEN {column} "
                      f"ELSE aggregate(sequence(1, {beyond}), {column}, (q, i) -> {again}) END")

    def apply(self, df: DataFrame, number: str, into: str, back: bool = False) -> DataFrame:
        """``df`` with the place of each ``number`` (with ``back``, the number at each place) as ``into``."""
        sign = "-" if back else "+"
        return (df.withColumn(into, F.expr(self._once(f"`{number}`", sign)))
                .withColumn(into, self._walk(f"`{into}`", sign)))


def shard(df: DataFrame, order: Sequence[str], shards: int = 40, seed: int = 1) -> DataFrame:
    """``df`` with int ``shard`` and long ``slot``; columns of these two names are replaced, all others stay.

    Shard sizes differ by one row at most and slots have no gap, whatever keys the rows hold; nulls sort last. Rows alike in
    all ``order`` columns are interchangeable: which of them takes which place is not defined, all else is the same in
    every run and for any layout of the input. An empty table stays empty.
    """
    names = fresh(df, "_row", "_place")
    row, place = names["_row"], names["_place"]
    numbered = row_numbers(df, order, row)
    n = scalar(numbered.agg(F.count("*")))[0]
    placed = Permutation(n, seed).apply(numbered, row, place)
    return placed.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": F.expr(f"`{place}` div {shards}L")}).drop(row, place)
