"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes as L or S (greater or smaller than the next one), sorts the
leftmost S substrings (LMS) by their symbols and types, as many at a time as a number holds, and names
them, recurses on the names while they repeat, and induces the whole order from the sorted LMS suffixes.

Induction goes by runs, all buckets at once. An L suffix is a run of falling symbols that ends at an
LMS suffix, whose order is known; so L suffixes are ordered by their run's symbols and then by that
end. An S suffix is a run of rising symbols that ends at an L suffix, and follows in the same way
from the order of the L suffixes; of equal first symbols, L comes before S. Runs are compared by
doubling: ranks by the first h elements of a run give those by the first 2 h, and only suffixes that
still tie and whose run goes on take part. Runs of text are a few symbols long, so nearly all ties
part in the first rounds; a run of r symbols costs log r rounds.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S: smaller than the next one. The end counts as smaller than everything, so the last is L."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    less, differs = t[:-1] < t[1:], t[:-1] != t[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ; n - 1: none
    s[:-1] = (at < n - 1) & less[np.minimum(at, n - 2)]
    return s


def _next(mask: np.ndarray) -> np.ndarray:
    """For each place, and the one after the last, the first place of ``mask`` from there on; its length where there is none."""
    n = len(mask)
    at = np.full(n + 1, n, np.int32)
    at[:n][mask] = np.flatnonzero(mask)
    return np.minimum.accumulate(at[::-1])[::-1]


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order of pairs of numbers below 2^31."""
    key = first.astype(np.int64)
    key <<= 32
    key |= second
    return np.argsort(key)


def _changes(*values: np.ndarray) -> np.ndarray:
    """Where the rows of these columns differ from the row before; the first row does."""
    out = np.ones(len(values[0]), bool)
    if len(out):
        np.not_equal(values[0][1:], values[0][:-1], out=out[1:])
        for v in values[1:]:
            out[1:] |= v[1:] != v[:-1]
    return out


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row the first of its part; parts begin where ``new`` is set."""
    at = np.flatnonzero(new).astype(np.int32)
    return np.repeat(at, np.diff(np.append(at, len(new))))


def _refine(rank: np.ndarray, open_: np.ndarray, end: np.ndarray) -> None:
    """Split ties of ``open_`` places in ``rank`` by the rest of their runs, which end at the ranked places ``end``.

    A rank is the number of smaller entries in the pass, so parts of a tie take the numbers between it and the next one.
    """
    h = 1
    while len(open_):
        p = open_[_order(rank[open_], rank[open_ + h])]
        a, b = rank[p], rank[p + h]
        new = _changes(a, b)
        rank[p] = a + (_starts(new) - _starts(_changes(a)))
        new[:-1] &= new[1:]  # places that are alone now
        h *= 2
        open_ = p[~new]
        open_ = open_[open_ + h <= end[open_]]


def _pass(symbol: np.ndarray, mine: np.ndarray, ends: np.ndarray, ends_rank: np.ndarray, mine_first: bool, k: int) -> np.ndarray:
    """Ranks of the places ``mine``, whose runs end at the next place of ``ends``, and of these, in one numbering.

    ``ends_rank``: numbers by which ends with the same symbol are ordered, equal for ties. The place after the last has rank 0.
    """
    n = len(symbol)
    bucket = 2 * symbol + (mine if not mine_first else ~mine)
    e, own = np.flatnonzero(ends).astype(np.int32), np.flatnonzero(mine).astype(np.int32)
    count = np.bincount(bucket[own], minlength=2 * k) + np.bincount(bucket[e], minlength=2 * k)
    rank = np.zeros(n + 1, np.int32)
    rank[:n] = (np.cumsum(count) - count + 1).astype(np.int32)[bucket]
    if len(e):
        e = e[_order(bucket[e], ends_rank[e])]
        b = bucket[e]
        rank[e] += _starts(_changes(b, ends_rank[e])) - _starts(_changes(b))
    _refine(rank, own[(count > 1)[bucket[own]]], _next(ends))
    return rank


def _packed(code: np.ndarray, at: np.ndarray, stop: np.ndarray, each: int, bits: int) -> np.ndarray:
    """``each`` codes from ``at`` on as one number; 0 from ``stop`` on."""
    out = np.zeros(len(at), np.int64)
    for j in range(each):
        p = at + j
        out <<= bits
        out |= np.where(p < stop, code[np.minimum(p, len(code) - 1)], 0)
    return out


def _names(code: np.ndarray, lms: np.ndarray, n: int, k: int) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal ones and ordered as they are, and how many there are.

    ``code``: 1 + twice the symbol + the type, below ``k``, and a 0 at the end. A substring reaches to the next LMS place, that one included, so
    none is the beginning of another.
    """
    bits = int(k).bit_length()
    stop = np.append(lms[1:] + 1, n + 1).astype(np.int32)  # the last one runs into the end, which is a 0
    at = lms.astype(np.int32)
    each = max(1, 62 // bits)
    key = _packed(code, at, stop, each, bits)
    order = np.argsort(key)
    new = _changes(key[order])
    rank = np.empty(len(lms), np.int32)
    rank[order] = _starts(new)
    d = each
    each = max(1, 31 // bits)
    new[:-1] &= new[1:]  # places that are alone
    open_ = order[~new]
    open_ = open_[at[open_] + d < stop[open_]]
    while len(open_):
        key = _packed(code, at[open_] + d, stop[open_], each, bits)
        by = _order(rank[open_], key)
        open_, key = open_[by], key[by]
        r = rank[open_]
        new = _changes(r, key)
        rank[open_] = r + (_starts(new) - _starts(_changes(r)))
        new[:-1] &= new[1:]
        d += each
        open_ = open_[~new]
        open_ = open_[at[open_] + d < stop[open_]]
    used = np.zeros(len(lms), np.int32)
    used[rank] = 1
    return (np.cumsum(used, dtype=np.int32) - 1)[rank], int(used.sum())


def _induce(t: np.ndarray, s: np.ndarray, is_lms: np.ndarray, lms_rank: np.ndarray, k: int) -> np.ndarray:
    """Ranks of all suffixes, from 1, from those of the LMS suffixes (by place; ties allowed)."""
    falling = _pass(t, ~s, is_lms, lms_rank, True, k)
    return _pass(t, s, ~s, falling[:-1], False, k)[:-1]


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """The starts of the suffixes of ``t`` (integers from 0 to k - 1, fewer than 2^31) in order."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    t = t.astype(np.int32)
    s = classify(t)
    is_lms = s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s[:-1]
    lms = np.flatnonzero(is_lms)
    lms_rank = np.zeros(n, np.int32)
    if len(lms) > 1:
        names, kinds = _names(np.append(2 * t + s + 1, 0), lms, n, 2 * k + 1)
        if kinds < len(lms):
            lms_rank[lms[suffix_array(names, kinds)]] = np.arange(len(lms))
        else:
            lms_rank[lms] = names
    order = np.empty(n, np.int64)
    order[_induce(t, s, is_lms, lms_rank, k) - 1] = np.arange(n)
    return order


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi) in text order: how many symbols each suffix shares with the one before it in suffix order, up to ``most``.

    Symbols are compared in text order, doubling nothing: eight at a time from packed words, then singly.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    words = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        words[: n - j] |= t[j:].astype(np.uint64) << np.uint64(8 * j) if j < n else 0
    open_ = np.flatnonzero(phi >= 0)
    d = 0
    while len(open_) and d + 8 <= most:
        x = words[open_ + d] ^ words[phi[open_] + d]
        full = x == 0
        plcp[open_[full]] += 8
        rest, diff = open_[~full], x[~full]
        low = diff & (~diff + np.uint64(1))
        plcp[rest] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        open_ = open_[full]
        d += 8
    if len(open_) and d < most:
        mask = np.uint64((1 << (8 * (most - d))) - 1)
        x = (words[open_ + d] ^ words[phi[open_] + d]) & mask
        full = x == 0
        plcp[open_[full]] += most - d
        low = x[~full] & (~x[~full] + np.uint64(1))
        plcp[open_[~full]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
    return np.minimum(plcp, n - np.maximum(np.arange(n), phi)), phi
