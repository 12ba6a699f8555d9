"""Exact eigenvalues of an integer scatter matrix: its polynomial modulo primes, Chinese remainders, isolated roots, null vectors.

Spark deals out the primes and the roots; each task works on a matrix of a vector's width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Primes that a task reduces at a time.
PRIMES_AT_ONCE = 16

#: A root's interval is narrower than the root by so many bits.
ROOT_BITS = 200

#: Decimal digits of the null vectors' equations.
DIGITS = 110


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 2^32."""
    twos = (n - 1 & 1 - n).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, n - 1 >> twos, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, bits: float) -> list[int]:
    """The largest odd primes below top whose product has more than the given bits."""
    found, have, p = [], 0.0, top - 1 | 1
    while have <= bits:
        p -= 2
        if _is_prime(p):
            found.append(p)
            have += np.log2(p)
    return found


def hessenberg_polynomials(m: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomials of m[k] modulo primes[k], lowest coefficient first. m: int64 (primes, d, d), reduced; primes below 2^31."""
    h, (k_all, d), p = m.copy(), m.shape[:2], primes[:, None]
    every = np.arange(k_all)
    for k in range(d - 2):  # similarity steps clear each column below its subdiagonal
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        h[every, k + 1], h[every, pivot] = h[every, pivot].copy(), h[every, k + 1].copy()
        h[every, :, k + 1], h[every, :, pivot] = h[every, :, pivot].copy(), h[every, :, k + 1].copy()
        inverse = np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(h[:, k + 1, k], primes, strict=True)])
        f = h[:, k + 2 :, k] * inverse[:, None] % p
        h[:, k + 2 :] = (h[:, k + 2 :] - f[:, :, None] * h[:, None, k + 1] % p[:, None]) % p[:, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * f[:, None] % p[:, None]).sum(axis=2)) % p
    poly = np.zeros((d + 1, k_all, d + 1), dtype=np.int64)  # poly[k]: that of the leading k rows and columns
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        poly[k, :, 1:] = poly[k - 1, :, :-1]
        poly[k] = (poly[k] - h[:, k - 1, k - 1, None] * poly[k - 1]) % p
        below = np.ones(k_all, dtype=np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % primes
            poly[k] = (poly[k] - (h[:, k - 1 - i, k - 1] * below % primes)[:, None] * poly[k - 1 - i]) % p
    return poly[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - m), lowest first, for a positive semidefinite integer matrix.

    Its coefficients are elementary symmetric functions of roots that add up to the trace, so none exceeds
    (1 + trace / d)^d: enough primes for twice that fix them all. Each task takes some primes; the driver gets d + 1 remainders of each.
    """
    d = len(m)
    bound = (2 + sum(m[i][i] for i in range(d)) // d) ** d
    primes = primes_below(1 << 31, bound.bit_length() + 2)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PRIMES_AT_ONCE):
                own = batch["prime"].to_numpy()[at : at + PRIMES_AT_ONCE]
                residues = np.array([[[v % int(q) for v in row] for row in m] for q in own], dtype=np.int64)
                yield pd.DataFrame({"prime": own, "remainders": list(hessenberg_polynomials(residues, own))})

    tasks = max(1, min(-(-len(primes) // PRIMES_AT_ONCE), 2 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame(pd.DataFrame({"prime": primes})).repartition(tasks)
    found = dealt.mapInPandas(reduce, "prime long, remainders array<long>").collect()
    value, modulus = [0] * (d + 1), 1
    for p, remainders in found:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, remainders, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def _above(poly: list[int], t: int) -> int:
    """How many roots, counted as often as they repeat, exceed t: sign changes of poly(x + t). Exact, as all roots are real (Budan, Fourier)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], t: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * t + c
    return (v > 0) - (v < 0)


def _isolated(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """(lo, hi, count) of the greatest positive roots, greatest first, at least `most` of them where there are so many: count roots in (lo, hi], one, or several that an integer's step does not part."""
    top = 1 - poly[-2]  # the roots add up to -poly[-2]
    todo, found = [(0, top, _above(poly, 0))], []
    while todo and sum(n for _, _, n in found) < most:
        lo, hi, n = todo.pop()
        if n == 0:
            continue
        if n == 1 or hi - lo == 1:
            found.append((lo, hi, n))
            continue
        mid = (lo + hi) // 2
        upper = _above(poly, mid) - _above(poly, hi)
        todo += [(lo, mid, n - upper), (mid, hi, upper)]
    return found


def _narrowed(poly: list[int], lo: int, hi: int) -> tuple[int, int]:
    """The interval of a single root, halved by signs until ROOT_BITS are known."""
    right = _sign(poly, hi)
    if right == 0:
        return hi, hi
    while hi - lo > 1 and hi - lo > lo >> ROOT_BITS:
        mid = (lo + hi) // 2
        sign = _sign(poly, mid)
        if sign == 0:
            return mid, mid
        lo, hi = (lo, mid) if sign == right else (mid, hi)
    return lo, hi


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """(root, shift, count) of the greatest positive roots, falling: the root is root / 2^shift to 60 bits and more; count tells how often it repeats.

    The polynomial's variable is scaled by powers of two until integers part the roots, or they agree in 60 bits and are taken for one.
    """
    d, shift = len(poly) - 1, 0
    while True:
        shift += 200
        scaled = [c << shift * (d - i) for i, c in enumerate(poly)]
        found = [(*(_narrowed(scaled, lo, hi) if n == 1 else (lo, hi)), n) for lo, hi, n in _isolated(scaled, most)]
        if all(hi - lo <= lo >> 60 for lo, hi, _ in found):
            return [((lo + hi) // 2, shift, n) for lo, hi, n in found]


def null_vectors(m: list[list[int]], root: int, shift: int, count: int) -> list[list[float]]:
    """count orthonormal vectors that m - root / 2^shift all but annuls, by inverse iteration in DIGITS digits; the entry of largest amount is positive."""
    d = len(m)
    with localcontext(Context(prec=DIGITS)):
        a = [[Decimal((m[i][j] << shift) - (root if i == j else 0)) for j in range(d)] for i in range(d)]
        tiny = max(max(abs(v) for v in row) for row in a).scaleb(-DIGITS) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            a[k][k] = a[k][k] or tiny
            row = a[k]
            for other in a[k + 1 :]:
                if other[k]:
                    f = other[k] = other[k] / row[k]
                    for j in range(k + 1, d):
                        other[j] -= f * row[j]

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a[i][j] * x[j] for j in range(i)), Decimal(0))
            for i in reversed(range(d)):
                x[i] = (x[i] - sum((a[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / a[i][i]
            return x

        rng = np.random.default_rng(7)
        block = [[Decimal(int(v)) for v in rng.integers(-1000, 1000, d)] for _ in range(count)]
        for _ in range(5):
            done: list[list[Decimal]] = []
            for v in map(solved, block):
                for _ in range(2):
                    for u in done:
                        dot = sum((x * y for x, y in zip(u, v, strict=True)), Decimal(0))
                        v = [y - dot * x for x, y in zip(u, v, strict=True)]
                    norm = sum((x * x for x in v), Decimal(0)).sqrt()
                    v = [x / norm for x in v]
                done.append(v)
            block = done
        return [[float(x if max(v, key=abs) > 0 else -x) for x in v] for v in block]


def components(spark: SparkSession, m: list[list[int]], most: int) -> list[tuple[float, float, list[float]]]:
    """(root, its share of the trace, unit vector) of up to `most` positive eigenvalues of a positive semidefinite integer matrix, falling. Each task solves for some roots."""
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return []
    roots = largest_roots(characteristic_polynomial(spark, m), most)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, root, shift, count in zip(batch["at"], batch["root"], batch["shift"], batch["count"], strict=True):
                yield pd.DataFrame({"at": at, "vector": null_vectors(m, int(root), int(shift), int(count))})

    frame = pd.DataFrame([(i, str(root), shift, n) for i, (root, shift, n) in enumerate(roots)], columns=["at", "root", "shift", "count"])
    solved = spark.createDataFrame(frame).repartition(min(len(roots), 2 * spark.sparkContext.defaultParallelism), F.col("at")).mapInPandas(solve, "at int, vector array<double>").collect()
    with localcontext(Context(prec=40)):
        value = [Decimal(root) / Decimal(1 << shift) for root, shift, _ in roots]
        return [(float(value[at]), float(value[at] / Decimal(trace)), list(v)) for at, v in sorted(solved, key=lambda r: r[0])][:most]
