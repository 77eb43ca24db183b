"""Removal of repeated byte strings by suffix arrays.

Every byte that a ``length``-byte string covers goes, where the same string also starts in a
document with a smaller id. Strings are judged on the input, overlaps count, and matches never cross
documents.

The text to sort is found and dealt out first. The least hash of the ``GRAM``-byte grams of a
string decides its shard, so equal strings always meet, wherever they stand; neighbouring strings
with the same least hash travel as one segment. Segments whose hash occurs in one document only hold
nothing repeated and stay where they are. The others are made distinct per bucket of documents and
sent, once each, with the least id that has them. In a shard, a hash with one distinct segment needs
no comparison: all its strings have the same documents. Of the rest the suffix array is built by
induced sorting, with a separator that no UTF-8 text holds, and permuted common prefixes cut it into
groups of suffixes that share ``length`` bytes; each group's least id goes back to the buckets.

Documents are dealt by id hash into buckets, in one shuffle that the three passes over them share.
A passage in a third of all documents is one segment a bucket, so no shard is hot. Nothing is
broadcast or collected. Buckets and shards are as many as the texts' bytes ask for (``bucket_bytes``),
so what a task holds does not grow with the data; small tables are spread over the shuffle partitions.

What travels per hash are 48 of its bits, besides those that choose the shard. Other hashes that
look the same only add candidates, for strings are compared as they are.

Null and empty texts give zero counts and empty bytes. A null id is no smaller than any other: such
rows neither lose nor take anything. Rows with equal ids don't take from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import pack, texts_of, unpack
from veritape.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 50
GRAM = 32
SHORT_GRAM = 16  # for lengths below 48
BUCKET_BYTES = 16_000_000
LEAST_BYTES = 1_000_000  # that are worth a bucket of their own
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEPARATOR = 0xFF
_ROW = "bucket int, shard int, payload binary"


def least_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """For each ``length``-byte string of ``b`` the least hash of its grams."""
    gram = GRAM if length >= 48 else SHORT_GRAM
    w = b.astype(np.uint64)
    for j in (1, 2, 4):
        w = w[:-j] | (w[j:] << np.uint64(8 * j))
    n = len(b) - gram + 1
    h = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        h ^= h >> np.uint64(32)
        h += w[j : j + n] * _C2
        h *= _C1
    h ^= h >> np.uint64(29)
    need, have = length - gram + 1, 1
    while have < need:
        j = min(have, need - have)
        h = np.minimum(h[:-j], h[j:])
        have += j
    return h


class Segments:
    """The segments of one document: hash, first string and number of strings."""

    __slots__ = ("count", "hash", "start")

    def __init__(self, b: np.ndarray, length: int):
        m = least_hashes(b, length) if len(b) >= length else np.empty(0, np.uint64)
        self.start = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))) if len(m) else np.empty(0, np.int64)
        self.hash = m[self.start]
        self.count = np.diff(np.append(self.start, len(m)))


def _texts(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    """The documents of a bucket in an order that doesn't depend on how the shuffle delivered them: the passes must agree."""
    rows = [(doc, t.encode("utf-8", "surrogatepass") if t else b"") for doc, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
    yield from sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    c = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.table({"bucket": pa.array(c[0], pa.int32()), "shard": pa.array(c[1], pa.int32()), "payload": pa.array(c[2], pa.binary())})


def _deal(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the low bits of the hashes."""
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)


def _sent(h: np.ndarray) -> np.ndarray:
    """The bits of the hashes that travel."""
    return h >> np.uint64(16)


def hashes_of(table: pa.Table, length: int, shards: int) -> pa.Table:
    """Pass 1, one bucket: its distinct hashes by shard, and which of them several documents have."""
    bucket, parts, docs = table["bucket"][0].as_py(), [], []
    for doc, b in _texts(table):
        if doc is not None:
            parts.append(np.unique(Segments(np.frombuffer(b, np.uint8), length).hash))
            docs.append(doc)
    if not parts:
        return _rows([])
    _, number = np.unique(np.array(docs), return_inverse=True)  # rows with the same id are one document
    h = np.concatenate(parts)
    d = np.repeat(number, [len(p) for p in parts])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    last = np.append(first[1:], len(h)) - 1
    several, h = d[first] != d[last], h[first]
    at = _deal(h, shards)
    return _rows([(bucket, s, pack(_sent(h[at == s]), several[at == s].astype(np.uint8))) for s in np.unique(at).tolist()])


def repeated_of(table: pa.Table) -> pa.Table:
    """One shard: for each bucket its hashes that two documents or more have."""
    shard, buckets, hs, flags = table["shard"][0].as_py(), [], [], []
    for bucket, payload in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
        h, several = unpack(payload)
        buckets.append(np.full(len(h), bucket))
        hs.append(h)
        flags.append(several)
    h, bucket, flag = np.concatenate(hs), np.concatenate(buckets), np.concatenate(flags)
    kinds, number, n = np.unique(h, return_inverse=True, return_counts=True)
    several = n > 1
    several[number[flag > 0]] = True
    keep = several[number]
    h, bucket = h[keep], bucket[keep]
    return _rows([(b, shard, pack(np.sort(h[bucket == b]))) for b in np.unique(bucket).tolist()])


def _candidates(texts: pa.Table, repeated: pa.Table, length: int):
    """Each document of a bucket with its repeated segments and the number of each in the bucket's list of distinct ones."""
    known = np.sort(np.concatenate([np.empty(0, np.uint64), *(unpack(p)[0] for p in repeated["payload"].to_pylist())]))
    number: dict[bytes, int] = {}
    docs, hashes, least = [], [], []
    for doc, b in _texts(texts):
        found = (np.empty(0, np.int64), np.empty(0, np.int64), [])
        if doc is not None and len(known):
            s = Segments(np.frombuffer(b, np.uint8), length)
            own = _sent(s.hash)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            ok = known[at] == own
            start, count, which = s.start[ok], s.count[ok], []
            for a, e, h in zip(start.tolist(), (start + count + length - 1).tolist(), s.hash[ok].tolist(), strict=True):
                i = number.setdefault(b[a:e], len(number))
                if i == len(hashes):
                    hashes.append(h)
                    least.append(doc)  # documents come by id, so the first has the least
                which.append(i)
            found = (start, count, which)
        docs.append((doc, b, found))
    return docs, number, np.array(hashes, np.uint64), np.array(least, np.int64)


def segments_of(key: tuple, texts: pa.Table, repeated: pa.Table, length: int, shards: int) -> pa.Table:
    """Pass 2, one bucket: its distinct repeated segments by shard, each with the least id that has it."""
    if not texts.num_rows or not repeated.num_rows:
        return _rows([])
    _, number, hashes, least = _candidates(texts, repeated, length)
    strings, at, rows = list(number), _deal(hashes, shards), []
    for s in np.unique(at).tolist():
        own = np.flatnonzero(at == s)
        data = [strings[i] for i in own.tolist()]
        rows.append((key[0].as_py(), s, pack(own.astype(np.uint32), _sent(hashes[own]), least[own], np.array([len(x) for x in data], np.uint32), b"".join(data))))
    return _rows(rows)


def compared(table: pa.Table, length: int) -> pa.Table:
    """One shard: for each segment of each bucket the least id that has each of its strings, in runs."""
    shard, number, least, hashes, asked = table["shard"][0].as_py(), {}, [], [], []
    for bucket, payload in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
        own, h, doc, lens, data = unpack(payload)
        at, mine = 0, []
        for n, d, x in zip(lens.tolist(), doc.tolist(), h.tolist(), strict=True):
            i = number.setdefault(data[at : at + n], len(number))
            at += n
            if i == len(least):
                least.append(d)
                hashes.append(x)
            elif d < least[i]:
                least[i] = d
            mine.append(i)
        asked.append((bucket, own, np.array(mine, np.int64)))
    strings, least = list(number), np.array(least, np.int64)
    _, kind, n = np.unique(np.array(hashes, np.uint64), return_inverse=True, return_counts=True)
    sort = np.flatnonzero(n[kind] > 1)
    count = np.array([len(x) for x in strings], np.int64) - length + 1
    runs = np.ones(len(strings), np.int64)  # a segment alone with its hash: one run
    if len(sort):
        low, offset = _least_by_suffix([strings[i] for i in sort.tolist()], least[sort], length)
        n = count[sort]
        m, of = low[np.repeat(offset, n) + _within(n)], np.repeat(np.arange(len(sort)), n)
        at = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (of[1:] != of[:-1]))))
        runs[sort] = np.bincount(of[at], minlength=len(sort))
    first = np.cumsum(runs) - runs
    size, value = np.empty(int(runs.sum()), np.uint32), np.empty(int(runs.sum()), np.int64)
    alone = np.ones(len(strings), bool)
    alone[sort] = False
    size[first[alone]], value[first[alone]] = count[alone], least[alone]
    if len(sort):
        to = np.repeat(first[sort], runs[sort]) + _within(runs[sort])
        size[to], value[to] = np.diff(np.append(at, len(m))), m[at]
    rows = []
    for bucket, own, mine in asked:
        run = np.repeat(first[mine], runs[mine]) + _within(runs[mine])
        rows.append((bucket, shard, pack(own, runs[mine].astype(np.uint32), size[run], value[run])))
    return _rows(rows)


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``n``, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)


def _least_by_suffix(strings: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the joined strings the least id that has the ``length`` bytes there, and where each string starts."""
    text = np.frombuffer(b"".join(x + b"\xff" for x in strings), np.uint8)
    size = np.array([len(x) + 1 for x in strings], np.int64)
    offset = np.cumsum(size) - size
    owner = np.repeat(docs, size)
    sa = suffix_array(text)
    plcp, _ = permuted_common_prefixes(text, sa, length)
    group = np.cumsum(plcp[sa] < length)  # suffixes in order; a new group where fewer bytes are shared
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    low = np.minimum.reduceat(owner[sa], first)
    out = np.empty(len(text), np.int64)
    out[sa] = np.repeat(low, np.diff(np.append(first, len(sa))))
    return out, offset


def cut_documents(texts: pa.Table, repeated: pa.Table, results: list[bytes], length: int) -> pa.Table:
    """Pass 3, one bucket: its documents without the covered bytes."""
    docs, number, _, _ = _candidates(texts, repeated, length)
    first, runs = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)  # of each segment: its runs among all
    sizes, values, so_far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for payload in results:
        own, n, size, value = unpack(payload)
        first[own], runs[own] = so_far + np.cumsum(n.astype(np.int64)) - n, n
        so_far += len(size)
        sizes.append(size.astype(np.int64))
        values.append(value)
    size, value = np.concatenate(sizes), np.concatenate(values)
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for doc, b, found in docs:
        start, _, which = found
        which = np.array(which, np.int64)
        each = runs[which]
        ends = np.cumsum(each)
        run = np.repeat(first[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)  # the runs of its segments
        n = size[run]
        to = np.cumsum(n)
        before = np.concatenate(([0], to))[ends - each]  # what came before each segment
        at = np.repeat(start - before, each) + to - n
        less = value[run] < doc if doc is not None else np.zeros(0, bool)
        step = np.bincount(at[less], minlength=len(b) + 1) - np.bincount(at[less] + n[less] + length - 1, minlength=len(b) + 1)
        gone = np.cumsum(step[:-1]) > 0
        out["doc_id"].append(doc)
        out["n_bytes"].append(len(b))
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0)
        out["kept"].append(np.frombuffer(b, np.uint8)[~gone].tobytes() if out["n_removed"][-1] else b)
    return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of each row."""
    if length <= SHORT_GRAM:
        raise ValueError(f"length must be over {SHORT_GRAM}")
    docs = texts_of(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST_BYTES)
    shards = n = max(1, -(-size // bucket_bytes), spread)
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.length("text").cast("long"))), F.lit(n)).cast("int")).repartition(n, "bucket")
    hashes = docs.groupBy("bucket").applyInArrow(lambda t: hashes_of(t, length, shards), _ROW)
    repeated = hashes.groupBy("shard").applyInArrow(repeated_of, _ROW)
    sent = docs.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(lambda k, a, b: segments_of(k, a, b, length, shards), _ROW)
    low = sent.groupBy("shard").applyInArrow(lambda t: compared(t, length), _ROW)
    both = repeated.withColumn("kind", F.lit(0)).unionAll(low.withColumn("kind", F.lit(1)))

    def last(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        kind = np.array(b["kind"].to_pylist(), np.int64)
        found = [p for p, k in zip(b["payload"].to_pylist(), kind, strict=True) if k]
        return cut_documents(a, b.filter(pa.array(kind == 0)), found, length)

    return docs.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
