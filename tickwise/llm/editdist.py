"""Bit-parallel edit distance (Myers): whole strings in a band, and a pattern anywhere in a text."""

from __future__ import annotations

import numpy as np


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of the places where the pattern has it."""
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of two strings is at most ``limit``.

    Common ends are cut first. Only the diagonals that can matter are kept, as bits of one word that moves down
    with the columns (the banded form of the bit-parallel recurrence), so a step costs the same for long strings.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= limit
    if limit == 0:
        return False
    if max(len(a), len(b)) <= limit:
        return True
    if len(a) < len(b):
        a, b = b, a
    width = 2 * limit + 2
    full = (1 << width) - 1
    where = masks(a)
    vp, vn = full & (full << (width - limit - 1)), 0
    diagonal, row = 1 << (width - 1), 1 << (width - 2)
    score, most = limit, 2 * limit + len(b) - len(a)
    for j, ch in enumerate(b):
        at = j + limit + 1 - width
        bits = where.get(ch, 0)
        eq = (bits >> at if at >= 0 else bits << -at) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < len(a) - limit:
            score += 0 if d0 & diagonal else 1
        else:
            score += 1 if hp & row else -1 if hn & row else 0
            row >>= 1
        if score > most:
            return False
        x = d0 >> 1
        vp = (hn | ~(x | hp)) & full
        vn = x & hp
    return score <= limit


#: Largest limit whose band fits a word; pairs whose columns are held together, at most.
_WORD_LIMIT, _TOGETHER = 31, 1024


def within_many(xs: list[str], ys: list[str], limits: np.ndarray) -> np.ndarray:
    """``within`` for each pair. Bands of up to 64 bits run side by side, one column of all pairs a step; wider ones alone."""
    limits = np.asarray(limits, dtype=np.int64)
    size = np.array([(len(x), len(y)) for x, y in zip(xs, ys)], dtype=np.int64).reshape(-1, 2)
    out = np.abs(size[:, 0] - size[:, 1]) <= limits
    narrow = out & (limits <= _WORD_LIMIT) & (size.min(axis=1) > limits)
    for i in np.flatnonzero(out & ~narrow).tolist():
        out[i] = within(xs[i], ys[i], int(limits[i]))
    order = np.flatnonzero(narrow)
    order = order[np.argsort(-size[order].min(axis=1), kind="stable")]  # pairs that end early stand last
    for lo in range(0, len(order), _TOGETHER):
        some = order[lo:lo + _TOGETHER]
        out[some] = _bands([(xs[i], ys[i]) if len(xs[i]) >= len(ys[i]) else (ys[i], xs[i]) for i in some.tolist()], limits[some])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _bands(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """The recurrence of ``within`` in one word a pair; the shorter strings ``b`` descend in length."""
    one = np.uint64(1)
    n, m = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    k = limits.astype(np.uint64)
    width = k * np.uint64(2) + np.uint64(2)
    full = np.where(width == 64, ~np.uint64(0), (one << (width & np.uint64(63))) - one)
    # bit i of column j stands for a[j - limit - 1 + i]: with limit + 1 places before a, for place j + i
    codes = [(_codes(x), _codes(y)) for x, y in pairs]
    most = max(int(c.max()) for both in codes for c in both)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32) if most < np.iinfo(t).max)  # the largest value is no character
    a = np.full((len(pairs), int((n + limits).max()) + 66 + int(m.max())), np.iinfo(kind).max, dtype=kind)
    b = np.zeros((int(m.max()), len(pairs)), dtype=kind)
    for i, (x, y) in enumerate(codes):
        a[i, limits[i] + 1:limits[i] + 1 + len(x)] = x
        b[:len(y), i] = y
    vp, vn = full & (full << (width - k - one)), np.zeros(len(pairs), dtype=np.uint64)
    shift, row = width - one, width - np.uint64(2)
    score = limits.copy()
    for j in range(int(m.max())):
        live = int(np.searchsorted(-m, -j, side="left"))  # pairs with m > j
        f, p, q = full[:live], vp[:live], vn[:live]
        eq = np.packbits(a[:live, j:j + 64] == b[j, :live, None], axis=1, bitorder="little").view(np.uint64)[:, 0] & f
        d0 = ((((eq & p) + p) ^ p) | eq | q) & f
        hp = (q | ~(d0 | p)) & f
        hn = d0 & p
        down = j < n[:live] - limits[:live]
        at = np.where(down, shift[:live], row[:live])
        step = np.where(down, 1 - ((d0 >> at) & one).astype(np.int64),
                        ((hp >> at) & one).astype(np.int64) - ((hn >> at) & one).astype(np.int64))
        score[:live] += step
        row[:live] -= (~down).astype(np.uint64)
        x = d0 >> one
        vp[:live] = (hn | ~(x | hp)) & f
        vn[:live] = x & hp
    return score <= limits


def find(pattern: str, peq: dict[str, int], text: str, limit: int) -> tuple[int, int] | None:
    """Least distance of the pattern to any substring, if at most ``limit``, and the end of the first such one."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = limit + 1, 0
    get = peq.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = (vn | ~(xh | vp)) & full
        hn = vp & xh
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & full
        vp = ((hn << 1) | ~(xv | hp)) & full
        vn = hp & xv
        if score < best:
            best, end = score, j
            if not best:
                break
    return (best, end) if best <= limit else None


def ends_within(pattern: str, peq: dict[str, int], text: str, limit: int, from_start: bool = False) -> list[tuple[int, int]]:
    """``(distance, end)`` of every end in the text at which the pattern is within ``limit`` of a substring, or with
    ``from_start`` of the text up to there."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    out = []
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = (vn | ~(xh | vp)) & full
        hn = vp & xh
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & full
        if from_start:  # the row above the pattern counts the characters left out
            hp |= 1
        vp = ((hn << 1) | ~(xv | hp)) & full
        vn = hp & xv
        if score <= limit:
            out.append((score, j))
    return out
