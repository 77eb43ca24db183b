"""N-gram Jaccard join with token-combination prefixes.

Two documents link when their sets of word shingles have Jaccard similarity ``num / den`` or more.
Tokens are 64-bit shingle hashes; equal sets are one node from the start.

Near copies first. Each set meets the set of least id that shares one of its ``FIRST`` least
hashes, and what these comparisons link is one group from then on. That costs a set at most
``FIRST`` comparisons, so groups of thousands of near copies are joined at the price of a link
each, and the search below only has to find links between different groups.

Candidates. Let a set have n tokens. A partner misses at most n - ceil(t n) of them, so among the
``m = n - ceil(t n) + k`` tokens of least hash (the extended prefix) it shares k or more. Of these,
tokens that only one group has can't be shared with another group; they need no entry, though they
use up their place. The others are put in the order of the number of groups that have them: among
the first ``m - k + 1`` there must be a shared one, and the j-th shared one is among the first
``m - k + j``. The number of groups also gives a token its class, by shares of all groups
(``classes``): rare tokens index a set singly; if the first shared token is frequent, so are all
later ones, and such tokens index in combinations of two, the most frequent in combinations of
three, each from a prefix that is longer by the size of the combination less one. (k is taken for
the smallest possible partner.) A passage that many documents share holds fewer than k of a prefix
in all but the shortest, and so indexes nothing.

Links. In a bucket of the index every set is first compared with the one that has the most links
so far only: copies differ more from one another than from what they were copied from.
Buckets that then still hold more than one group go two ways. Narrow ones compare sets across
groups, except where the distances to the common first member rule a link out (Jaccard distance is
a metric). The sets of wide ones are indexed once more, by all their tokens, counted among these
sets alone: loosely similar documents have enough tokens of their own to fill the short prefix that
a full count allows, and so part without being compared. There the smaller set of a pair needs only
the first n - ceil(2t/(1+t) n) + 1 tokens of its order, since its partner is no smaller. These sets also meet ``TURNS`` other member of
each bucket, which joins clouds of similar documents, before the rest is compared across groups. No
bucket is capped.

Verification. The hashed prefixes bound the overlap of a pair exactly from above; pairs that survive
are decided on the full sets, built anew from the texts of just these documents and brought
together by (first set, chunk of partners, by their sizes).

Null, empty and wordless texts have no tokens and link with nothing; texts shorter than a shingle
are one token. Rows with a null id keep their size and get a null component. Rows that repeat an id,
with the same text or another, are one document to the components; :func:`first_rows` keeps texts
apart instead. Intermediate tables are deleted as soon as their last reader is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import connected_components, counted_cut, cut, drop_cut, measured_cut, release, rows_of, short_batches, spent

FIRST = 3  # least hashes by which near copies are found
CLASSES = ((0.05, 2), (0.2, 3))  # tokens in over this share of all groups index in combinations of so many
LEAST_FREQUENT = 512  # groups that a frequent token has at least
LEAST_K = 16
TURNS = 1
WIDE = 64  # members from which a bucket of several groups is indexed again on full sets
BROADCAST_ROWS = 100_000  # the driver holds a broadcast several times over: as collected, as a hash table that doubles as it grows, and in blocks
CHUNK_TOKENS = 1 << 19
KNOWN_WORDS = 100_000  # whose hashes a worker remembers
INDEX_ROWS = 1 << 16  # that a task holds at a time
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    w = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _C1 + w[i : i + n] * _C2
    h ^= h >> np.uint64(30)
    h *= _C2
    h ^= h >> np.uint64(27)
    h *= _C3
    h ^= h >> np.uint64(31)
    return np.unique(h)


def _ceil(num: int, den: int, n: int) -> int:
    return (num * n + den - 1) // den


def _k(n: int, num: int, den: int) -> int:
    need = _ceil(num, den, n)
    return min(need, max(LEAST_K, (n - need + 1) // 3))


def lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """The extended prefix's length, and the k that every partner's prefix shares with it at least."""
    return n - _ceil(num, den, n) + _k(n, num, den), _k(_ceil(num, den, n), num, den)


def least_size(num: int, den: int) -> int:
    """Smaller sets link with no other set than their own."""
    return -(-num // (den - num)) if den > num else 1 << 62


def sets(rows: DataFrame, width: int, num: int, den: int, full: bool = False) -> DataFrame:
    """The columns of ``rows`` but its last, the text; then n, sig, m, k, ks and the extended prefix (``full``: the whole set).

    k: how many of the m tokens a partner's list shares at least; ks: the same for partners no smaller than the set.
    """
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            n, sig, m, k, ks, low = [], [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                s = shingles(text, width, known)
                a, b = (0, 0) if not len(s) else (len(s), _ceil(num, den, len(s))) if full else lengths(len(s), num, den)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                m.append(a)
                k.append(b)
                ks.append(_ceil(2 * num, num + den, len(s)) if full else b)
                low.append(s[:a].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            flat = np.concatenate(low) if low else np.empty(0, np.int64)
            made = [pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(m, pa.int32()), pa.array(k, pa.int32()), pa.array(ks, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, "n", "sig", "m", "k", "ks", "low"])
        known.clear()
        release()

    schema = "".join(f"{c} long, " for c in kept) + "n long, sig binary, m int, k int, ks int, low array<long>"
    return rows.mapInArrow(run, schema)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``BROADCAST_ROWS`` narrow rows; else Spark shuffles."""
    return F.broadcast(df) if rows_of(df) <= BROADCAST_ROWS else df


class _Scratch:
    """Written tables that go when their last reader is done."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(counted_cut(df, name))
        return self.held[-1]

    def drop(self, frames: list[DataFrame]) -> None:
        for x in list(frames):
            drop_cut(x)
            self.held = [y for y in self.held if y is not x]

    def since(self, before: list[DataFrame]) -> list[DataFrame]:
        return [x for x in self.held if not any(x is y for y in before)]


class _Join:
    """One run: the sets, the texts to verify on, and the threshold."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, classes: tuple, least_frequent: int):
        self.width, self.num, self.den, self.scratch = width, num, den, _Scratch()
        least = least_size(num, den)
        most = max(1, _k(_ceil(num, den, least), num, den)) if least < 1 << 62 else 1
        self.classes = [(share, min(k, most)) for share, k in classes]
        self.least_frequent = least_frequent
        text = F.col(f"`{text_col}`").cast("string")
        self.docs = short_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
        numbered = self.docs.select("doc_id", "th", F.monotonically_increasing_id().alias("uid"), "text")
        every = cut(sets(numbered, width, num, den), "sets")
        self.rows = cut(every.select("doc_id", "th", "uid", "n", "sig"), "rows")  # of each row; outlasts the others
        valid = self.rows.where("n > 0 and doc_id is not null")
        self.nodes = cut(valid.groupBy("sig").agg(F.min(F.struct("doc_id", "uid")).alias("f")).select("sig", F.col("f.uid").alias("node"), F.col("f.doc_id").alias("doc")), "nodes")
        copies, found = measured_cut(valid.select("uid", "sig", "doc_id").join(self.nodes, "sig").where("uid <> node").select("uid", (F.col("doc_id") == F.col("doc")).alias("again")), "copies", n=F.count(F.lit(1)), again=F.max("again"))
        copies._veritape_rows, self.repeats = found["n"], bool(found["again"])  # whether the texts of some sets are there several times
        reps = every.where("n > 0 and doc_id is not null").where(F.col("n") >= least).join(small(copies).select("uid"), "uid", "left_anti")
        # written once: each of some twenty steps that read it would plan, broadcast or shuffle that join again
        self.reps = self.scratch.put(reps.select(F.col("uid").alias("rid"), "doc_id", "th", "n", "m", "k", "ks", "low"), "reps")
        self.scratch.drop([every, copies])
        spent(df)

    def apart(self) -> str:
        """SQL: two sizes that can't link."""
        return f"least(n, pn) * {self.den} < greatest(n, pn) * {self.num}"

    def texts(self, ids: DataFrame) -> DataFrame:
        """(rid, text) of the sets in ``ids`` (rid), a written table."""
        named = self.scratch.put(self.reps.select("rid", "doc_id", "th").join(small(ids), "rid", "left_semi"), "named")
        found = self.docs.join(small(named), ["doc_id", "th"]).select("rid", "text")
        return found.dropDuplicates(["rid"]) if self.repeats else found

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, most: at most so many tokens are in both sets, from the extended prefixes."""
        ids = self.scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "ids")
        own = self.reps.join(small(ids), "rid", "left_semi")
        side = lambda x: own.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("low").alias(f"l{x}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                na, nb = t["na"].to_numpy(), t["nb"].to_numpy()
                most = np.empty(len(na), np.int64)
                for i, (x, y) in enumerate(zip(t["la"], t["lb"], strict=True)):
                    x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                    top = min(x[-1] if len(x) < na[i] else np.uint64(2**64 - 1), y[-1] if len(y) < nb[i] else np.uint64(2**64 - 1))
                    x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
                    most[i] = len(np.intersect1d(x, y, assume_unique=True)) + min(na[i] - len(x), nb[i] - len(y))
                yield pa.RecordBatch.from_arrays([t["a"], t["b"], t["na"], t["nb"], pa.array(most)], ["a", "b", "na", "nb", "most"])

        return both.mapInArrow(run, "a long, b long, na long, nb long, most long")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """a, b, common: the number of common tokens of each pair (a, b, nb), from the full sets."""
        chunks = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / CHUNK_TOKENS).alias("chunks"))
        chunked = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
        needs = self.scratch.put(chunked.select("a", "chunk", F.col("b").alias("rid"), F.lit(1).alias("side")).unionAll(chunked.select("a", "chunk", F.col("a").alias("rid"), F.lit(0).alias("side")).distinct()), "needs")
        width = self.width

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Words()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x, width, known).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["rid", "tokens"])
            known.clear()
            release()

        full = self.texts(self.scratch.put(needs.select("rid").distinct(), "ids")).mapInArrow(build, "rid long, tokens binary")

        def match(table: pa.Table) -> pa.Table:
            first, rest = None, []
            for rid, side, tokens in zip(table["rid"].to_pylist(), table["side"].to_pylist(), table["tokens"].to_pylist(), strict=True):
                x = np.frombuffer(tokens, np.uint64)
                if side:
                    rest.append((rid, x))
                else:
                    first = x
            found = []
            for _, x in rest:
                at = np.minimum(np.searchsorted(first, x), len(first) - 1)
                found.append(int((first[at] == x).sum()))
            a = table["a"][0].as_py()
            return pa.table({"a": pa.array([a] * len(rest), pa.int64()), "b": pa.array([d for d, _ in rest], pa.int64()), "common": pa.array(found, pa.int64())})

        return full.join(small(needs), "rid").groupBy("a", "chunk").applyInArrow(match, "a long, b long, common long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked, least and greatest Jaccard distance of each pair, itself a written table; a written table."""
        if not rows_of(pairs):
            return self.scratch.put(pairs.select("a", "b", F.lit(False).alias("linked"), F.lit(0.0).alias("dlo"), F.lit(1.0).alias("dhi")), "verified")
        before = list(self.scratch.held)
        bounds = self.scratch.put(self.bounds(pairs), "bounds")
        possible = f"{self.den} * most >= {self.num} * (na + nb - most)"
        decided = self.overlaps(bounds.where(possible).select("a", "b", "nb"))
        exact = bounds.where(possible).join(decided, ["a", "b"]).selectExpr("a", "b", f"{self.den} * common >= {self.num} * (na + nb - common) linked", "1D - common / (na + nb - common) dlo", "1D - common / (na + nb - common) dhi")
        far = bounds.where(f"not ({possible})").selectExpr("a", "b", "false linked", "1D - most / (na + nb - most) dlo", "1D dhi")
        out = cut(exact.unionAll(far), "verified")
        self.scratch.drop(self.scratch.since(before))
        self.scratch.held.append(out)
        spent(out)
        return out

    def star(self, index: DataFrame, comp: DataFrame | None, links: DataFrame | None = None, turn: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Each set (key, rid, n, short) against the first of its buckets, unless they are in one group: (pivots, verified pairs).

        First is who has the most of ``links``, then the least id; in a ``turn``, who has the least hash for that turn.
        """
        if links is None:
            by = index.withColumn("few", F.col("doc_id") if turn is None else F.xxhash64("rid", F.lit(turn)))
        else:
            ends = links.select(F.explode(F.array("a", "b")).alias("rid"))
            by = index.join(small(self.scratch.put(ends.groupBy("rid").agg((-F.count("*")).alias("few")), "degrees")), "rid", "left").withColumn("few", F.coalesce("few", F.lit(0)))
        first = by.groupBy("key").agg(F.min(F.struct("few", "rid", "n", "short")).alias("p"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi")
        pivots = self.scratch.put(first.select("key", F.col("p.rid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.short").alias("pshort")), "pivots")
        each = index.join(pivots, "key")
        pairs = each.where(f"rid <> pivot and if(n < pn, short, pshort) and not ({self.apart()})").select(F.least("pivot", "rid").alias("a"), F.greatest("pivot", "rid").alias("b")).distinct()
        if comp is not None:
            c = lambda x: small(comp).select(F.col("id").alias(x), F.col("component_id").alias(f"c{x}"))
            pairs = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left").where("ca is null or cb is null or ca <> cb").select("a", "b")
        written = self.scratch.put(pairs, "star")
        out = self.verify(written)
        self.scratch.drop([written])
        return pivots, out

    def index_rows(self, reps: DataFrame, comp: DataFrame, sizes: int) -> DataFrame:
        """(key, rid, n, short): rare tokens and combinations of frequent ones, of those in two groups or more; a written table.

        Of a pair across groups that links, some key is in both, and short in the smaller set. Buckets without a short
        member are left out, as are those of one group. ``sizes``: how many sets there are.
        """
        before = list(self.scratch.held)
        group = small(comp).withColumnRenamed("id", "rid")
        # most tokens are in one set only: those go by the counts of 40 bits of them, before anything else is known
        each = reps.select("rid", F.explode("low").alias("tok")).withColumn("bits", F.expr("shiftrightunsigned(tok, 24)"))
        wide = each.groupBy("bits").agg(F.count("*").alias("c")).where("c > 1").select("bits")
        several = self.scratch.put(each.join(wide, "bits").select("rid", "tok"), "several")
        owned = several.join(group, "rid", "left").select("rid", "tok", F.coalesce("component_id", "rid").alias("comp"))
        counts = owned.groupBy("tok", "comp").agg(F.count("*").alias("sets")).groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
        lists = several.join(small(self.scratch.put(counts, "counts")), "tok").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("toks"))
        place = lists.join(reps.select("rid", "n", "k", "ks"), "rid").select("rid", "n", (F.size("toks") - F.col("k") + 1).alias("left"), (F.size("toks") - F.col("ks") + 1).alias("near"), "toks").where("left > 0")
        limits = [(max(self.least_frequent, share * sizes), k) for share, k in self.classes]
        longest = max([1, *(k for _, k in limits)])
        listed = place.select("rid", "n", "left", "near", F.transform(F.slice("toks", 1, F.col("left") + longest - 1), lambda x: x.c).alias("c"), F.transform(F.slice("toks", 1, F.col("left") + longest - 1), lambda x: x.tok).alias("tok"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = [[], [], [], []]
            size = 0

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], ["key", "rid", "n", "short"])
                for x in held:
                    x.clear()
                return out

            for batch in batches:
                for row in range(batch.num_rows):
                    rid, n, left, near = (batch.column(i)[row].as_py() for i in range(4))
                    c, tok = batch.column(4)[row].values.to_numpy(), batch.column(5)[row].values.to_numpy()
                    for key, short in combined(c, tok, left, near, limits):
                        for into, x in zip(held, (key, np.full(len(key), rid), np.full(len(key), n), short), strict=True):
                            into.append(x)
                        size += len(key)
                        if size >= INDEX_ROWS:
                            yield flush()
                            size = 0
            if size:
                yield flush()

        rows = self.scratch.put(listed.mapInArrow(run, "key long, rid long, n long, short boolean"), "keys")
        placed = rows.join(group, "rid", "left").withColumn("comp", F.coalesce("component_id", "rid"))
        useful = placed.groupBy("key").agg(F.max("short").alias("any"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("any and lo < hi").select("key")
        out = cut(rows.join(useful, "key"), "index")
        self.scratch.drop(self.scratch.since(before))
        self.scratch.held.append(out)
        spent(out)
        return out

    def mixed(self, index: DataFrame, comp: DataFrame, pivots: DataFrame, near: DataFrame) -> DataFrame:
        """Members of the buckets with more than one group, with their group and distance to the bucket's first; a written table."""
        placed = index.join(small(comp).withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("component_id", "rid")).drop("component_id")
        some = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key").join(pivots.select("key", "pivot"), "key")
        known = placed.join(some, "key").withColumn("a", F.least("pivot", "rid")).withColumn("b", F.greatest("pivot", "rid")).join(near.select("a", "b", "dlo", "dhi"), ["a", "b"], "left")
        return self.scratch.put(known.selectExpr("key", "rid", "n", "short", "comp", "pivot", "if(rid = pivot, 0D, coalesce(dlo, 0D)) dlo", "if(rid = pivot, 0D, coalesce(dhi, 1D)) dhi"), "members")

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs of a bucket's members from different groups that sizes and distances leave possible; the first was compared before."""
        x, y = members.alias("x"), members.alias("y")
        reach = (self.den - self.num) / self.den + 1e-9
        on = f"x.key = y.key and x.comp < y.comp and if(x.n < y.n, x.short, y.short) and least(x.n, y.n) * {self.den} >= greatest(x.n, y.n) * {self.num} and x.dlo <= y.dhi + {reach}D and y.dlo <= x.dhi + {reach}D and x.rid <> x.pivot and y.rid <> y.pivot"
        return x.join(y, F.expr(on)).select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(a, b) of nodes: a written table whose components are those of all links."""
        put, free = self.scratch.put, self.scratch.drop
        least = self.reps.select(F.explode(F.slice("low", 1, FIRST)).alias("key"), "rid", "doc_id", "n", F.lit(True).alias("short"))
        least = put(least.join(least.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key"), "least")
        found = put(self.star(least, None)[1].where("linked").select("a", "b"), "links")
        comp = put(_labels(found), "labels")
        index = self.index_rows(self.reps, comp, rows_of(self.reps))
        pivots, near = self.star(index, comp, found)
        found2 = put(near.where("linked").select("a", "b"), "links")
        comp2 = put(connected_components(found.unionAll(found2)), "labels")
        members = self.mixed(index, comp2, pivots, near)
        free([index, near, comp])
        size = members.groupBy("key").agg(F.count("*").alias("size"))
        narrow = members.join(size.where(f"size <= {WIDE}").select("key"), "key")
        wide = put(members.join(size.where(f"size > {WIDE}").select("key"), "key", "left_semi").select("rid").distinct(), "wide")
        cross, all_links = self.across(narrow), found.unionAll(found2)
        if rows_of(wide):
            own = put(sets(self.texts(wide), self.width, self.num, self.den, full=True), "full")
            again = self.index_rows(own, comp2, rows_of(wide))
            pivots2, near2 = self.star(again, comp2, put(found.unionAll(found2), "links"))
            found3 = put(near2.where("linked").select("a", "b"), "links")
            free([own])
            for turn in range(TURNS):  # clouds about the threshold: pivots link with some of the others
                more = self.star(again, comp2, None, turn)[1].where("linked").select("a", "b")
                found3 = put(found3.unionAll(more), "links")
            comp3 = put(connected_components(found.unionAll(found2).unionAll(found3)), "labels")
            cross = cross.unionAll(self.across(self.mixed(again, comp3, pivots2, near2))).distinct()
            all_links = all_links.unionAll(found3)
        last = self.verify(put(cross, "cross"))
        out = cut(all_links.unionAll(last.where("linked").select("a", "b")).distinct(), "all_links")
        free(self.scratch.held)
        return out


def combined(c: np.ndarray, tok: np.ndarray, left: int, near: int, limits: list[tuple[float, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of a set's ordered tokens, and whether each is short: of the first ``near`` places, or ``left`` for all partners.

    ``limits`` gives the size of combinations for tokens in more groups than so many.
    """
    k = np.ones(len(c), np.int64)
    for more_than, size in limits:
        k[c > more_than] = size
    single = np.flatnonzero(k[:left] == 1)
    yield tok[single], single < near
    for size in sorted({int(x) for x in k[:left]} - {1}):
        upto, place, held = left + size - 1, [], 0
        for i in np.flatnonzero(k[:left] == size).tolist():
            for rest in combinations(range(i + 1, min(upto, len(tok))), size - 1):
                place.append((i, *rest))
                held += 1
                if held == INDEX_ROWS:
                    yield _keys(tok, place, near + size - 1)
                    place, held = [], 0
        if place:
            yield _keys(tok, place, near + size - 1)


def _keys(tok: np.ndarray, place: list[tuple], upto: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.array(place)
    h = np.zeros(len(p), np.uint64)
    for j in range(p.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * _C1 + tok[p[:, j]].view(np.uint64) * _C2
    h ^= h >> np.uint64(32)
    h *= _C3
    h ^= h >> np.uint64(29)
    return h.view(np.int64), p[:, -1] < upto


def _labels(links: DataFrame) -> DataFrame:
    """(id, component_id) where equal labels are connected; not always the other way round.

    Two steps of the smallest neighbour are enough to skip most pairs that are together already, and
    cost far less than the components proper, which are found once, at the end.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("m")).select("id", F.least("id", "m").alias("l"))
    up = one.select(F.col("id").alias("l"), F.col("l").alias("ll"))
    return one.join(up, "l", "left").select("id", F.coalesce("ll", "l").alias("component_id"))


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10, classes: tuple = CLASSES, least_frequent: int = LEAST_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    join = _Join(df, id_col, text_col, width, num, den, classes, least_frequent)
    links, rows = join.links(), join.rows
    own = rows.where("doc_id is not null").join(join.nodes, "sig")
    several = counted_cut(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a < hi").select("doc_id", "a"), "several")
    if rows_of(several):
        links = links.unionAll(own.join(small(several), "doc_id").select("a", F.col("node").alias("b")).distinct())
    final = connected_components(links)
    of = final.withColumnRenamed("id", "node").join(join.nodes.select("node", "doc"), "node")
    least = of.groupBy("component_id").agg(F.min("doc").alias("least"))
    named = of.join(least, "component_id").select("node", "least")
    out = rows.join(join.nodes, "sig", "left").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc", "doc_id")).alias("component_id"))


def first_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``df`` with one row of each component of texts: that of the least id, then of the least text hash, then of the least other columns.

    Rows with the same id and other texts are judged by their texts. Rows with a null id stay, as do those without words.
    """
    join = _Join(df, id_col, text_col, width, num, den, CLASSES, LEAST_FREQUENT)
    links, rows = join.links(), join.rows
    final = connected_components(links).withColumnRenamed("id", "node")
    own = rows.where("doc_id is not null and n > 0").join(join.nodes.select("sig", "node"), "sig").join(final, "node", "left").select("doc_id", "th", "uid", F.coalesce("component_id", "node").alias("c"))
    first = own.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    ranked, found = measured_cut(own.join(first, "c").select("doc_id", "th", (F.struct("doc_id", "th") == F.col("f")).alias("first")).groupBy("doc_id", "th").agg(F.max("first").alias("first"), F.count("*").alias("rows")), "ranked", again=F.max(F.expr("first and rows > 1")))
    key = [F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")), F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__th")]
    side = lambda where: small(counted_cut(ranked.where(where).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "gone"))
    left = df.join(side("not first"), key, "left_anti")
    if found["again"]:
        again = side("first and rows > 1")
        once = left.join(again, key, "left_anti")
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        twice = left.join(again, key, "left_semi").groupBy(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))).agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*")
        left = once.unionAll(twice)
    return left
