"""Arithmetic in the prime field of 2**61 - 1, vectorised over numpy arrays and plain for polynomials."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = (np.uint64(x) for x in (31, 30, 61, 1))


def reduce61(s: np.ndarray) -> np.ndarray:
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod P for uint64 arrays below P, without leaving 64 bits (2**61 = 1, 2**62 = 2)."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = ah * bl + al * bh
    return reduce61(((ah * bh) << _1) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce61(a + b)


def inverse(a: np.ndarray) -> np.ndarray:
    """a ** (P - 2), by square and multiply."""
    out, base, e = np.ones_like(a), a, P - 2
    while e:
        if e & 1:
            out = mul(out, base)
        base = mul(base, base)
        e >>= 1
    return out


def points(n: int) -> list[int]:
    """n distinct sample points, all at or above 2**60, where no element lies."""
    return [(1 << 60) + (i + 1) * 0x9E3779B97F4A7 % ((1 << 60) - 3) for i in range(n)]


def trim(p: list[int]) -> list[int]:
    while p and p[-1] == 0:
        p.pop()
    return p


def evaluate(p: list[int], x: int) -> int:
    out = 0
    for c in reversed(p):
        out = (out * x + c) % P
    return out


def times_linear(p: list[int], root: int) -> list[int]:
    """p * (z - root), lowest coefficient first."""
    out = [0] + p
    for i, c in enumerate(p):
        out[i] = (out[i] - c * root) % P
    return out


def divide(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, q, lead = a[:], [0] * max(1, len(a) - len(b) + 1), pow(b[-1], P - 2, P)
    for shift in range(len(a) - len(b), -1, -1):
        c = a[shift + len(b) - 1] * lead % P
        if c:
            q[shift] = c
            for i, d in enumerate(b, shift):
                a[i] = (a[i] - c * d) % P
    return trim(q), trim(a[: len(b) - 1])


def basis(zs: list[int]) -> tuple[np.ndarray, list[int]]:
    """The matrix that takes values at zs to coefficients, and the polynomial that vanishes on zs."""
    whole = [1]
    for z in zs:
        whole = times_linear(whole, z)
    rows = []
    for z in zs:
        part, _ = divide(whole, [(-z) % P, 1])
        scale = pow(evaluate(part, z), P - 2, P)
        rows.append([c * scale % P for c in part])
    return np.array(rows, dtype=np.uint64), whole


def rational(coefficients: list[int], whole: list[int], top: int) -> tuple[list[int], list[int]]:
    """Monic (p, q) with p = q * f modulo `whole` and deg p <= top, by the extended Euclidean scheme."""
    r0, r1, t0, t1 = whole, trim(coefficients[:]), [], [1]
    while len(r1) - 1 > top:
        q, rest = divide(r0, r1)
        t2 = t0 + [0] * max(0, len(q) + len(t1) - 1 - len(t0))
        for i, a in enumerate(q):
            if a:
                for j, b in enumerate(t1, i):
                    t2[j] = (t2[j] - a * b) % P
        r0, r1, t0, t1 = r1, rest, t1, trim(t2)
    if not r1 or not t1:
        return [], []
    scale = pow(t1[-1], P - 2, P)
    return [c * scale % P for c in r1], [c * scale % P for c in t1]
