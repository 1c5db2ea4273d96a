"""Distances and vector arithmetic as column expressions over array columns.

Everything here is a built-in expression (JVM side); components are widened to double
first.  Used where few pairs are compared, where any payload predicate should reach the
scan, and as the readable definition that the batch kernels are tested against.

Inner product and cosine rank largest first, everything else smallest first; L2 is
squared and Lp is left without its root.  Undefined terms (0/0 in Canberra and
Bray-Curtis, log of 0 in Jensen-Shannon) count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine", "l1", "linf", "lp", "canberra", "braycurtis", "jensenshannon")
LARGEST_FIRST = ("ip", "cosine")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def l2(a, b):
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def ip(a, b):
    return _sum(_zip(a, b, lambda x, y: x * y))


def l1(a, b):
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def linf(a, b):
    return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))


def lp(a, b, p: float):
    return _sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def canberra(a, b):
    return _sum(_zip(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))


def braycurtis(a, b):
    below = _sum(_zip(a, b, lambda x, y: F.abs(x + y)))
    return F.when(below == 0, 0.0).otherwise(l1(a, b) / below)


def jensenshannon(a, b):
    def term(x, y):
        m = (x + y) / 2
        part = lambda v: F.when(v > 0, v * F.log(v / m)).otherwise(0.0)
        return (part(x) + part(y)) / 2

    return _sum(_zip(a, b, term))


def norm2(v):
    return _sum(F.transform(doubles(v), lambda x: x * x))


def norm(v):
    return F.sqrt(norm2(v))


def cosine(a, b):
    return ip(normalize(a), normalize(b))


def distance(metric: str, a: Column, b: Column, p: float | None = None) -> Column:
    if metric == "lp":
        return lp(a, b, p)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return globals()[metric](a, b)


def best_first(metric: str, column: Column) -> Column:
    return column.desc() if metric in LARGEST_FIRST else column.asc()


def l2_from_ip(product: Column, norm2_a: Column, norm2_b: Column) -> Column:
    """Squared L2 from an inner product and squared norms, never below 0."""
    return F.greatest(norm2_a + norm2_b - 2 * product, F.lit(0.0))


# --- arithmetic -----------------------------------------------------------------------


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def add(a, b):
    return _zip(a, b, lambda x, y: x + y)


def subtract(a, b):
    return _zip(a, b, lambda x, y: x - y)


def add_scalar(a, c: float):
    return F.transform(doubles(a), lambda x: x + F.lit(float(c)))


def madd(a, factor: float, b):
    """a + factor * b"""
    return _zip(a, b, lambda x, y: x + F.lit(float(factor)) * y)


def argmin(v: Column) -> Column:
    """Position from 0 of the first smallest component."""
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def madd_argmin(a, factor: float, b):
    return argmin(madd(a, factor, b))


def reflect(v: Column, u: Column) -> Column:
    """v mirrored at the hyperplane of the unit vector u (a Householder reflection)."""
    twice = 2 * ip(u, v)
    return _zip(v, u, lambda x, y: x - twice * y)


def imbalance(counts: Column) -> Column:
    """1.0 if all are equal: n * sum(c * c) / sum(c) ** 2, over an array."""
    total = _sum(doubles(counts))
    return F.size(counts) * norm2(counts) / (total * total)


# --- bits -----------------------------------------------------------------------------


def sign_bits(v: Column, strict: bool = False) -> Column:
    """0/1 by component: x >= 0, or x > 0 if strict."""
    return F.transform(doubles(v), lambda x: F.when((x > 0) if strict else (x >= 0), 1).otherwise(0))


def bits_to_real(bits: Column) -> Column:
    """0/1 to -1/+1."""
    return F.transform(bits, lambda b: (2 * b - 1).cast("double"))


def pack_bits(bits: Column, n: int) -> Column:
    """n bits (0/1) as 64-bit words, first bit lowest."""
    words = []
    for at in range(0, n, 64):
        word = F.lit(0).cast("long")
        for i in range(at, min(at + 64, n)):
            word = word.bitwiseOR(F.shiftleft(F.get(bits, F.lit(i)).cast("long"), i - at))
        words.append(word)
    return F.array(*words)


def select_bits(bits: Column, order: list[int]) -> Column:
    """Bits in another order, or a part of them."""
    return F.array(*[F.get(bits, F.lit(i)) for i in order])


def checksum(v: Column) -> Column:
    """Sum of integer components."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def unequal(a: Column, b: Column) -> Column:
    """Number of differing elements (generalised Hamming)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def select_dims(v: Column, dims: list[int]) -> Column:
    """Components by position; -1 gives 0."""
    return F.array(*[F.lit(0.0) if i < 0 else F.get(doubles(v), F.lit(i)) for i in dims])


# --- top-k of a row -------------------------------------------------------------------


def kmin(v: Column, k: int) -> Column:
    return F.slice(F.array_sort(v), 1, k)


def nth_smallest(v: Column, n: int) -> Column:
    """The threshold that splits a row's components into n smaller ones and the rest."""
    return F.get(F.array_sort(v), F.lit(n))


def kmax(v: Column, k: int) -> Column:
    return F.slice(F.reverse(F.array_sort(v)), 1, k)
