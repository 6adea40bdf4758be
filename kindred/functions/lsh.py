"""Locality-sensitive hash families: each builds a Column from a vector Column.

A family is an object with ``hash(vec) -> Column`` and, where it has one, ``delta(vec)``, the
distance of the projection to the nearest bin edge. Vectors are ARRAY<DOUBLE> or ARRAY<BIGINT>;
with integer vectors and coefficients every hash is exact.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, fields, is_dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Lsh(Protocol):
    def hash(self, vec: Column) -> Column: ...


def literal(a: Sequence[float]) -> Column:
    """An array literal from one parsed expression instead of one call into the JVM per element."""
    whole = all(isinstance(x, int) for x in a)
    return F.expr("array(" + ", ".join(f"{x}L" if whole else f"{float(x)!r}D" for x in a) + ")")


def project(vec: Column, a: Sequence[float]) -> Column:
    zero = F.lit(0).cast("bigint") if all(isinstance(x, int) for x in a) else F.lit(0.0)
    return F.aggregate(F.zip_with(vec, literal(a), lambda x, w: x * w), zero, lambda s, v: s + v)


@dataclass(frozen=True)
class Trivial:
    def hash(self, vec: Column) -> Column:
        return F.lit(0).cast("bigint")


@dataclass(frozen=True)
class StableDistribution:
    """floor((a.x + b) / w); a from a Gaussian serves L2, from a Cauchy L1."""
    a: tuple
    b: float
    w: float

    @staticmethod
    def draw(dim: int, w: float, seed: int, cauchy: bool = False) -> StableDistribution:
        r = random.Random(seed)
        one = (lambda: math.tan(math.pi * (r.random() - 0.5))) if cauchy else (lambda: r.gauss(0, 1))
        return StableDistribution(tuple(one() for _ in range(dim)), r.random() * w, w)

    def _at(self, vec: Column) -> Column:
        return (project(vec, self.a) + F.lit(self.b)) / F.lit(self.w)

    def hash(self, vec: Column) -> Column:
        return F.floor(self._at(vec)).cast("bigint")

    def delta(self, vec: Column) -> Column:
        return self._at(vec) - F.floor(self._at(vec))


@dataclass(frozen=True)
class HyperPlane:
    a: tuple

    def hash(self, vec: Column) -> Column:
        return (project(vec, self.a) >= 0).cast("bigint")

    def delta(self, vec: Column) -> Column:
        return F.abs(project(vec, self.a))


@dataclass(frozen=True)
class Threshold:
    dim: int
    t: float

    def hash(self, vec: Column) -> Column:
        return (F.element_at(vec, self.dim + 1) >= F.lit(self.t)).cast("bigint")

    def delta(self, vec: Column) -> Column:
        return F.abs(F.element_at(vec, self.dim + 1) - F.lit(self.t))


@dataclass(frozen=True)
class Tail:
    """The last digit of another hash to the base r; r = 2 keeps the least bit."""
    of: object
    r: int = 2

    def hash(self, vec: Column) -> Column:
        return F.pmod(self.of.hash(vec), F.lit(self.r)).cast("bigint")

    def delta(self, vec: Column) -> Column:
        d = self.of.delta(vec)
        return F.least(d, 1 - d)


@dataclass(frozen=True)
class Repeat:
    """Digits of several hashes, each below ``r``, as one number."""
    of: tuple
    r: int

    def hash(self, vec: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for h in self.of:
            total = total * self.r + h.hash(vec)
        return total


@dataclass(frozen=True)
class RepeatHash:
    """Sum of hashes times odd constants, modulo 2^32 or ``bins``."""
    of: tuple
    factors: tuple
    bins: int = 2**32

    def hash(self, vec: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for h, a in zip(self.of, self.factors, strict=True):
            total = total + F.pmod(h.hash(vec) * a, F.lit(2**32))
        return F.pmod(F.pmod(total, F.lit(2**32)), F.lit(self.bins)).cast("bigint")


@dataclass(frozen=True)
class Xor:
    of: tuple

    def hash(self, vec: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for h in self.of:
            total = total.bitwiseXOR(h.hash(vec))
        return total

    def delta(self, vec: Column) -> Column:
        return F.least(*[h.delta(vec) for h in self.of])


def project_sparse(vec: Column, a: Sequence[float]) -> Column:
    """a.x of a sparse vector, a MAP<INT, number> or an array of (index, value) structs; indices outside a count as zero.

    Entries are folded one by one, each looking its weight up; nothing is joined and no dense vector made. An index that
    comes twice counts twice.
    """
    whole = all(isinstance(x, int) for x in a)
    zero = F.lit(0).cast("bigint") if whole else F.lit(0.0)
    weights = literal(a)

    def term(e):
        return e["value"] * F.when((e["index"] >= 0) & (e["index"] < len(a)), F.get(weights, e["index"].cast("int"))).otherwise(zero)
    return F.aggregate(vec, zero, lambda s, e: s + F.coalesce(term(e), zero))


def entries(vec: Column) -> Column:
    """A map's entries as (index, value) structs."""
    return F.transform(F.map_entries(vec), lambda e: F.struct(e["key"].alias("index"), e["value"].alias("value")))


@dataclass(frozen=True)
class Sparse:
    """A stable-distribution or hyperplane hash of sparse vectors, arrays of (index, value) structs."""
    of: StableDistribution | HyperPlane

    def hash(self, vec: Column) -> Column:
        at = project_sparse(vec, self.of.a)
        if isinstance(self.of, HyperPlane):
            return (at >= 0).cast("bigint")
        return F.floor((at + F.lit(self.of.b)) / F.lit(self.of.w)).cast("bigint")

    def delta(self, vec: Column) -> Column:
        at = project_sparse(vec, self.of.a)
        if isinstance(self.of, HyperPlane):
            return F.abs(at)
        at = (at + F.lit(self.of.b)) / F.lit(self.of.w)
        return at - F.floor(at)


def dump(hashes) -> str:
    """A hash, or lists of them, as JSON of its parameters, to be kept beside an index."""
    def plain(x):
        if is_dataclass(x):
            return {"kind": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
    return json.dumps(plain(hashes))


def load(text: str):
    """What dump() was given; lists come back as tuples."""
    kinds = {k.__name__: k for k in (Trivial, StableDistribution, HyperPlane, Threshold, Tail, Repeat, RepeatHash, Xor, Sparse)}

    def made(x):
        if isinstance(x, dict):
            return kinds[x["kind"]](**{k: made(v) for k, v in x.items() if k != "kind"})
        return tuple(made(v) for v in x) if isinstance(x, list) else x
    return made(json.loads(text))
