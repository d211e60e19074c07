"""The similarity functions by name, as Spark expressions where Spark can express them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from kinweave.functions import kernels
from kinweave.functions.kernels import KERNELS, MANY, by_value_pairs
from kinweave.runtime import ship

Builder = Callable[[Column, Column], Column]
KM_PER_DEGREE = 111.32


def missing(c: Column, kind: str) -> Column:
    """Null, or NaN in a floating column; the empty string is a value."""
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def blank(c: Column, kind: str) -> Column:
    """Missing, or the empty string."""
    return missing(c, kind) | (c == "") if kind == "string" else missing(c, kind)


def levenshtein(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the sets of two-letter grams of the texts, each closed by a blank on either side."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.concat(F.lit(" "), c, F.lit(" ")), i, F.lit(2))))
    x, y = grams(a), grams(b)
    return F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x).cast("double") * F.size(y))


def commonness_score(x: Column, y: Column) -> Column:
    return (1 - F.abs(x - y)) * (1 - (x + y) / 2)


def pct_diff(orig: Column, cand: Column) -> Column:
    """Absolute difference over the absolute original; of 0: 0 if equal, else 1."""
    return F.when(orig == 0, F.when(cand == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.abs(orig - cand), F.abs(orig)))


def within_degrees(limit: float) -> Builder:
    return lambda a, b: F.when(F.abs(a.cast("double") - b.cast("double")) <= limit, 1.0).otherwise(0.0)


def arrow(name: str, f: Callable[[str, str], float], many: Callable | None = None) -> Builder:
    """A two-argument Python function as an Arrow-batched expression, called once per value pair of a batch; ``many`` scores all of them at once."""

    def build(a: Column, b: Column) -> Column:
        ship(SparkSession.active())

        @F.arrow_udf(DoubleType())
        def kernel(x: pa.Array, y: pa.Array) -> pa.Array:
            return by_value_pairs(x, y, f, many)

        return kernel(a, b).alias(name)

    return build


@dataclass(frozen=True)
class Similarities:
    """An immutable registry: similarity name to expression builder.

    ``text`` names those that compare texts (other types are cast), ``python``
    those that run in Python workers and are better scored once per value pair,
    ``presence`` those that judge missing values themselves.  ``batched`` are
    quicker builders of the same values for many different value pairs.
    """

    builders: dict[str, Builder]
    text: frozenset[str] = frozenset()
    python: frozenset[str] = frozenset()
    presence: frozenset[str] = field(default_factory=lambda: frozenset(("notmissing", "notzero")))
    batched: dict[str, Builder] = field(default_factory=dict)

    @classmethod
    def default(cls, lat_radius_km: float = 10.0, lon_radius_km: float = 10.0, lat_ref: float = 54.0) -> Similarities:
        lon_km = KM_PER_DEGREE * math.cos(math.radians(lat_ref))
        native = {
            "levenshtein": levenshtein, "cosine": cosine, "commonness_score": commonness_score, "pct_diff": pct_diff,
            "within_km_lat": within_degrees(lat_radius_km / KM_PER_DEGREE), "within_km_lon": within_degrees(lon_radius_km / lon_km), "notmissing": None, "notzero": None,
        }
        return cls(native | {n: arrow(n, f, MANY.get(n)) for n, f in KERNELS.items()}, frozenset(("levenshtein", "cosine", *KERNELS)), frozenset(KERNELS), batched={"levenshtein": arrow("levenshtein", kernels.levenshtein, MANY["levenshtein"])})

    def adding(self, name: str, builder: Builder, text: bool = False) -> Similarities:
        return Similarities({**self.builders, name: builder}, self.text | {name} if text else self.text, self.python, self.presence, self._batched_but(name))

    def adding_python(self, name: str, f: Callable[[str, str], float]) -> Similarities:
        return Similarities({**self.builders, name: arrow(name, f)}, self.text | {name}, self.python | {name}, self.presence, self._batched_but(name))

    def _batched_but(self, name: str) -> dict[str, Builder]:
        return {n: b for n, b in self.batched.items() if n != name}

    def check(self, names) -> None:
        unknown = sorted(set(names) - set(self.builders))
        if unknown:
            raise KeyError(f"unknown similarities {unknown}; available: {sorted(self.builders)}")

    def column(self, name: str, a: Column, kind_a: str, b: Column, kind_b: str, batched: bool = False) -> Column:
        """The similarity of two values; 0.0 where either is missing."""
        self.check([name])
        if name in self.presence:
            there = ~blank(a, kind_a) & ~blank(b, kind_b)
            if name == "notzero":
                zero = lambda c, k: F.lit(False) if k == "string" else c.cast("double") == 0
                there = there & ~zero(a, kind_a) & ~zero(b, kind_b)
            return F.when(there, 1.0).otherwise(0.0)
        gone = missing(a, kind_a) | missing(b, kind_b)
        if name.startswith("within_km"):
            gone = blank(a, kind_a) | blank(b, kind_b)
        if name in self.text:
            a, b = a.cast("string"), b.cast("string")
        keep = lambda c: F.when(~gone, c)
        return F.coalesce(F.when(~gone, (batched and self.batched.get(name) or self.builders[name])(keep(a), keep(b))), F.lit(0.0))
