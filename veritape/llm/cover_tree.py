"""Exact near-duplicate pairs of embeddings by cover trees.

Vectors are put on the unit sphere, where cosine >= t is distance <= sqrt(2 - 2t). Equal vectors of
a label are one from the start, with a weight, so a group of copies costs a single vector.

A farthest-first order of a bounded sample gives the top of the tree for all tasks: its first
centers, of which there are more the more vectors there are, deal all vectors into nodes. Every
node's covering radius is then measured over all its vectors, so pruning is exact though the sample
is not. Node pairs of one label survive if the centers' distance less both radii is within reach;
nodes are cut into blocks of about ``block`` vectors, and a vector goes to a partner block only if
its own distance to the centers allows a link.

Each pair of blocks is one task: cover trees are built in both and traversed together. A level of a
tree covers the vectors of a node of radius r by balls of radius r / 2. Levels are nested (a node's
center is the center of its first child), their radii halve, and centers of a level are more than
its radius apart. Node pairs too far apart for a link are pruned, by all children at once; a pair so
near that all its vectors must link is counted whole; pairs of leaves are compared by
double-precision products. A node whose next level would have a center for fewer than ``SPREAD``
vectors each, as where vectors don't cluster, is a leaf. A task returns, per vector, its number of
links and the smallest vector its links reach, not the pairs; sums and components follow in Spark.

Where vectors don't cluster no metric tree can prune, and the number of block pairs of a label then
grows with the square of its size over ``block`` squared; the same holds for a tight group of
different vectors beyond one block, whose pairs of blocks are counted whole.

Vectors are compared with those of the same label and length only. Null, zero and non-finite vectors
(or components), null labels and null ids link with nothing. Rows that repeat an id are separate
vectors. Ties are links: the threshold itself counts. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import bounded_sample, connected_components
from veritape.llm.jaccard import small
from veritape.session import cut

THRESHOLD = 0.98
BLOCK = 4096
SAMPLE = 4096  # vectors for the top of the tree, and so its centers at most
LEAF = 96
SPREAD = 32
SLACK = 1e-6  # distances are found from products, whose rounding this covers


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled first, so that squares neither vanish nor overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; of all pairs where both are tables."""
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0.0))


def farthest_first(x: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Indices of centers, the first row and then each the farthest from those before it, until ``most`` or all are within ``radius``; the nearest center of each row and its distance."""
    centers, near = [0], np.zeros(len(x), np.int64)
    d = _distance(x, x[0])
    while len(centers) < most and d.max() > radius:
        c = int(d.argmax())
        e = _distance(x, x[c])
        closer = e < d
        near[closer] = len(centers)
        d = np.where(closer, e, d)
        centers.append(c)
    return centers, near, d


class Node:
    """Rows ``at`` within ``radius`` of the first of them, and the next level: the children, their centers and radii."""

    __slots__ = ("at", "centers", "children", "own", "radius", "weight")

    def __init__(self, x: np.ndarray, w: np.ndarray, at: np.ndarray, radius: float):
        self.at, self.radius, self.own, self.weight = at, radius, x[at[0]], int(w[at].sum())
        self.children: list[Node] = []
        self.centers = None
        if len(at) > LEAF and radius > SLACK:
            rows, most = x[at], len(at) // SPREAD
            centers, near, d = farthest_first(rows, most + 1, radius / 2)
            if 1 < len(centers) <= most:
                for i, c in enumerate(centers):
                    members = near == i
                    members[c] = False
                    inside = np.flatnonzero(members)
                    self.children.append(Node(x, w, at[np.concatenate(([c], inside))], float(d[inside].max()) if len(inside) else 0.0))
                self.centers = x[at[centers]]

    def parts(self) -> tuple[list[Node], np.ndarray, np.ndarray]:
        """The children, or a leaf itself, with their centers and radii."""
        if not self.children:
            return [self], self.own[None, :], np.array([self.radius])
        return self.children, self.centers, np.array([c.radius for c in self.children])


def tree(x: np.ndarray, w: np.ndarray, at: np.ndarray) -> Node:
    return Node(x, w, at, float(_distance(x[at], x[at[0]]).max()))


class Links:
    """Numbers of links, and components, of the rows of a task, which have weights."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.parent = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.roots(i), self.roots(j)
        differ = a != b
        if differ.any():
            for x, y in np.unique(np.stack((a[differ], b[differ]), axis=1), axis=0).tolist():
                x, y = int(self.roots(np.array([x]))[0]), int(self.roots(np.array([y]))[0])
                self.parent[max(x, y)] = min(x, y)


def traverse(x: np.ndarray, a: Node, b: Node, threshold: float, out: Links) -> None:
    """Count and join all pairs, one row below ``a`` and one below ``b`` (each pair once where they are the same node), of cosine ``threshold`` or more."""
    reach, w = math.sqrt(2 - 2 * threshold), out.weights
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        gap = float(_distance(p.own, q.own))
        if gap - p.radius - q.radius > reach + SLACK:
            continue
        if p is q and 2 * p.radius < reach - SLACK:
            out.count[p.at] += p.weight - w[p.at]
            out.join(p.at, np.full(len(p.at), p.at[0]))
        elif p is not q and gap + p.radius + q.radius < reach - SLACK:
            out.count[p.at] += q.weight
            out.count[q.at] += p.weight
            out.join(np.concatenate((p.at, q.at)), np.full(len(p.at) + len(q.at), p.at[0]))
        elif not p.children and not q.children:
            near = x[p.at] @ x[q.at].T >= threshold
            if p is q:
                near = np.triu(near, 1)
            if near.any():
                out.count[p.at] += near @ w[q.at]
                out.count[q.at] += w[p.at] @ near
                i, j = np.nonzero(near)
                out.join(p.at[i], q.at[j])
        else:
            one, c1, r1 = p.parts()
            two, c2, r2 = q.parts()
            close = _distance(c1, c2) - r1[:, None] - r2[None, :] <= reach + SLACK
            if p is q:
                close = np.triu(close)
            stack += [(one[i], two[j]) for i, j in np.argwhere(close).tolist()]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors from their bytes, all of one length."""
    return np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])


def units(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(uid, vec_id, label, vec) with the vector as unit bytes, its length and digest; null where it links with nothing."""
    n = batch.num_rows
    vec: list = [None] * n
    width, digest = [None] * n, [None] * n
    rows = batch.column(3)
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    able = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    for size in np.unique(lengths[able]).tolist():
        at = np.flatnonzero(able & (lengths == size))
        flat = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
        for i, v in zip(at[good].tolist(), unit(flat[good]) + 0.0 if good.any() else (), strict=True):
            vec[i], width[i] = v.tobytes(), size
            digest[i] = hashlib.blake2b(vec[i], digest_size=16).digest()
    return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(width, pa.int32()), pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], ["uid", "vec_id", "label", "width", "digest", "vec"])


def linked(table: pa.Table, threshold: float) -> pa.Table:
    """One pair of blocks: for each of its vectors the links found here and the least vector reached."""
    side = table["side"].to_numpy()
    x, uid, w = _matrix(table["vec"]), table["uid"].to_numpy(), table["w"].to_numpy()
    out = Links(w)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a = tree(x, w, one) if len(one) else None
    if table["same"][0].as_py():
        traverse(x, a, a, threshold, out)
    elif len(one) and len(two):
        traverse(x, a, tree(x, w, two), threshold, out)
    found = np.flatnonzero(out.count)
    root = out.roots(found)
    return pa.table({"uid": pa.array(uid[found]), "links": pa.array(out.count[found]), "root": pa.array(uid[root])})


def _top(classes: DataFrame, n: int, block: int, sample: int) -> dict[int, np.ndarray]:
    """For each vector length of the sample its centers; the origin, at distance 1 of all, serves the other lengths."""
    picked = [(r.width, np.frombuffer(r.vec, np.float64)) for r in bounded_sample(classes, ["uid"], sample).select("width", "vec").collect()]
    wanted = max(1, math.ceil(n / (8 * block)))
    out = {}
    for width in sorted({k for k, _ in picked}):
        own = np.stack([v for k, v in picked if k == width])
        share = max(1, math.ceil(wanted * len(own) / len(picked)))
        out[width] = own[farthest_first(own, min(share, len(own)))[0]]
    return out


def _to_centers(x: np.ndarray, centers: np.ndarray | None) -> np.ndarray:
    return np.ones((len(x), 1)) if centers is None else _distance(x, centers)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; pairs are compared within a label."""
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield units(batch)

    base = cut(rows.mapInArrow(prepare, "uid long, vec_id long, label string, width int, digest binary, vec binary"), "vectors")
    good = base.where("vec is not null")
    classes = cut(good.groupBy("label", "digest").agg(F.min("uid").alias("class"), F.min("vec_id").alias("least"), F.count("*").alias("w")), "classes")
    member = good.select("uid", "label", "digest").join(classes.select("label", "digest", "class"), ["label", "digest"]).select("uid", "class")
    copies = cut(member.where("uid <> class").select("uid"), "copies")
    reps = good.join(small(copies), "uid", "left_anti").select("uid", "label", "width", "vec")
    n = classes.count()
    centers = spark.sparkContext.broadcast(_top(reps, n, block, sample) if n else {})  # at most ``sample`` vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(2).to_numpy()
            node, dist = np.zeros(len(width), np.int32), np.zeros(len(width))
            for k in np.unique(width).tolist():
                at = np.flatnonzero(width == k)
                d = _to_centers(_matrix(batch.column(3).take(pa.array(at))), centers.value.get(k))
                node[at] = d.argmin(axis=1)
                dist[at] = d[np.arange(len(at)), node[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(dist)], ["uid", "label", "width", "vec", "node", "dist"])

    def partners_of(table: pa.Table) -> pa.Table:
        """The nodes of one label and length, ``sample`` at most: pairs within reach, both ways."""
        c = centers.value.get(table["width"][0].as_py())
        node, r, chunks = table["node"].to_numpy(), table["r"].to_numpy(), table["chunks"].to_numpy()
        one, two, gap = [], [], []
        for i in range(len(node)):
            g = np.zeros(len(node)) if c is None else _distance(c[node], c[node[i]])
            near = np.flatnonzero(g - r - r[i] <= reach)
            one.append(np.full(len(near), i))
            two.append(near)
            gap.append(g[near])
        i, j = np.concatenate(one), np.concatenate(two)
        take = lambda v: pa.array(v)
        return pa.table({"label": table["label"].take(take(i)), "width": table["width"].take(take(i)), "node": take(node[i]), "chunks": take(chunks[i]), "other": take(node[j]), "other_r": take(r[j]), "other_chunks": take(chunks[j]), "gap": take(np.concatenate(gap))})

    reach = math.sqrt(2 - 2 * threshold) + 2 * SLACK
    placed = cut(reps.mapInArrow(assign, "uid long, label string, width int, vec binary, node int, dist double"), "placed")
    nodes = placed.groupBy("label", "width", "node").agg(F.count("*").alias("n"), F.max("dist").alias("r")).withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    partners = nodes.groupBy("label", "width").applyInArrow(partners_of, "label string, width int, node int, chunks int, other int, other_r double, other_chunks int, gap double")
    mine = placed.join(classes.select(F.col("class").alias("uid"), "w"), "uid").withColumn("h", F.pmod(F.xxhash64("uid"), F.lit(1 << 30)))
    sent = mine.join(partners, ["label", "width", "node"]).where(F.col("gap") - F.col("dist") <= F.col("other_r") + reach).withColumn("chunk", (F.col("h") % F.col("chunks")).cast("int"))
    sent = sent.withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("other_chunks") - 1)))
    first = F.struct("node", "chunk")
    second = F.struct(F.col("other").alias("node"), F.col("other_chunk").alias("chunk"))
    keyed = sent.select("label", "width", F.least(first, second).alias("one"), F.greatest(first, second).alias("two"), F.when(first <= second, 0).otherwise(1).alias("side"), (first == second).alias("same"), "uid", "w", "vec")
    # a block meets itself and, once, each other block
    found = cut(keyed.groupBy("label", "width", "one", "two").applyInArrow(lambda t: linked(t, threshold), "uid long, links long, root long"), "links")
    degree = found.groupBy(F.col("uid").alias("class")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class")
    least = comp.join(classes.select("class", "least"), "class").groupBy("component_id").agg(F.min("least").alias("reached"))
    named = comp.join(least, "component_id").select("class", "reached")
    judged = classes.join(degree, "class", "left").join(named, "class", "left").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("reached", "least").alias("reached"))
    out = base.select("vec_id", "label", "digest").join(judged, ["label", "digest"], "left").withColumn("component_id", F.coalesce("reached", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
