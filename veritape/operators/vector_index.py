"""An inverted file over vectors: exact nearest neighbours that read few cells, or probed ones that read a fixed number.

Rows are dealt to the cells of a k-means model, which is fitted on a bounded sample, and lie in one
folder a cell, sorted by their distance to the cell's center (the radius). A small table holds each
cell's rows, least and greatest radius. By the triangle inequality a row of a cell whose center is D
away from the query is at least ``|D - radius|`` away, so a search first reads the nearest cells,
takes the k-th distance found there as its bound, and then reads only the cells, and in them only the
radii, that can hold anything as near. The result equals a scan's, ties included.

What is bounded: the sample (``SAMPLE`` rows), the cells (``MAX_CELLS``) and thereby the centers and
the table of cells, which is all that the driver and each task hold. Every row is indexed. A cell of
any size is dealt to as many files as its rows need, so a hot one is written and read by many tasks.

Rows whose vector is null, of another length than most of the sample, or holds null or non-finite
components lie in cell -1 and are near to nothing. Repeated rows stay repeated. An empty table gives
an index without cells, whose searches are empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritape.functions.numbers import squared_distance
from veritape.operators.nearest import matrix, nearest, usable
from veritape.session import cut, drop_cut

SAMPLE = 20_000  # rows that the centers are fitted on, at most
MAX_CELLS = 4096
ROWS_A_FILE = 200_000
PAIRS = 1_000_000  # (query, cell) pairs that are broadcast at a time, at most
CALIBRATE = 64  # rows whose true neighbours set the number of cells that a probed search reads
CALIBRATE_K = 10
SLACK = 1e-9  # of a bound, for rounding

NO_CELL = -1


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of least hash of ``key``: thinned by hash before they are ordered, so tasks send little more than that."""
    n = rows.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    thin = rows.where(h < int((1 << 30) * min(1.0, 1.5 * most / n))) if n > 2 * most else rows
    return thin.orderBy(h, key).limit(most)


class VectorIndex:
    """The index under ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = spark.read.parquet(f"{self.path}/head").first()
        self.id_col, self.vec_col, self.width, self.sort, self.schema = head.id_col, head.vec_col, head.width, list(head.sort), T.StructType.fromJson(json.loads(head.schema))
        stats = spark.read.parquet(f"{self.path}/stats").groupBy("ivf_cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        known = spark.read.parquet(f"{self.path}/centers").join(F.broadcast(stats), "ivf_cell").orderBy("ivf_cell").collect()  # MAX_CELLS rows at most
        self.cells = np.array([r.ivf_cell for r in known], np.int32)
        self.centers = np.array([r.center for r in known], np.float64).reshape(len(known), self.width)
        self.n, self.low, self.high = (np.array([r[k] for r in known], np.float64) for k in ("n", "low", "high"))

    # ---- building -------------------------------------------------------------------------------

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, sort: tuple[str, ...] = (), seed: int = 7, recall: float | None = None) -> VectorIndex:
        """Fit and write the index. ``cells``: the square root of the rows if not given. ``sort``: columns that searches filter by; rows of
        a cell are sorted by them first. ``recall``: what probed searches shall reach; see :meth:`calibrate`."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        held = cut(vectors, "vectors")
        lengths = held.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
        width = lengths.w if lengths else 0
        good = held.where(usable(F.col(vec_col), width)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        total = good.count() if width else 0
        wanted = max(2, min(cells or int(total**0.5), MAX_CELLS))
        schema = T.StructType([*vectors.schema.fields, T.StructField("ivf_radius", T.DoubleType()), T.StructField("ivf_cell", T.IntegerType())])
        head = [(id_col, vec_col, width, list(sort), schema.json())]
        spark.createDataFrame(head, "id_col string, vec_col string, width int, sort array<string>, schema string").write.parquet(f"{path}/head")
        centers: list = []
        if total:
            points = bounded_sample(good, "id", min(sample, SAMPLE)).select(array_to_vector("v").alias("features"))
            model = KMeans(k=wanted, seed=seed, maxIter=10, initSteps=1).fit(points)
            model.write().save(f"{path}/model")
            centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        spark.createDataFrame(centers, "ivf_cell int, center array<double>").write.parquet(f"{path}/centers")
        cls._write(held, path, id_col, vec_col, width, sort, bool(total))
        drop_cut(held)
        index = cls(spark, path)
        if recall is not None:
            index.calibrate(recall)
        return index

    @staticmethod
    def _write(rows: DataFrame, path: str, id_col: str, vec_col: str, width: int, sort: tuple[str, ...] | list[str], fitted: bool) -> None:
        """Deal ``rows`` to cells and add them. The table of cells is written first: if the rows don't follow, bounds are merely wider than they need be."""
        spark, vector = rows.sparkSession, F.col(vec_col).cast("array<double>")
        if fitted:
            centers = spark.read.parquet(f"{path}/centers")
            zero = F.array_repeat(F.lit(0.0), width)
            placed = rows.withColumn("ivf_ok", usable(F.col(vec_col), width)).withColumn("ivf_vector", array_to_vector(F.when(F.col("ivf_ok"), vector).otherwise(zero)))
            placed = KMeansModel.load(f"{path}/model").setFeaturesCol("ivf_vector").setPredictionCol("ivf_near").transform(placed)
            placed = placed.withColumn("ivf_cell", F.when(F.col("ivf_ok"), F.col("ivf_near")).otherwise(NO_CELL)).drop("ivf_vector", "ivf_near", "ivf_ok")
            placed = placed.join(F.broadcast(centers), "ivf_cell", "left").withColumn("ivf_radius", F.sqrt(squared_distance(vector, F.col("center")))).drop("center")
        else:
            placed = rows.withColumn("ivf_cell", F.lit(NO_CELL)).withColumn("ivf_radius", F.lit(None).cast("double"))
        placed = cut(placed, "placed")
        stats = cut(placed.groupBy("ivf_cell").agg(F.count("*").alias("n"), F.min("ivf_radius").alias("low"), F.max("ivf_radius").alias("high")), "stats")
        stats.write.mode("append").parquet(f"{path}/stats")
        # a cell's rows go to as many files as they need
        spread = stats.select("ivf_cell", F.ceil(F.col("n") / ROWS_A_FILE).cast("int").alias("ivf_files"))
        dealt = placed.join(F.broadcast(spread), "ivf_cell").withColumn("ivf_file", F.pmod(F.xxhash64(id_col), F.col("ivf_files")))
        dealt = dealt.repartition("ivf_cell", "ivf_file").sortWithinPartitions("ivf_cell", "ivf_file", *sort, "ivf_radius").drop("ivf_files", "ivf_file")
        dealt.write.mode("append").partitionBy("ivf_cell").parquet(f"{path}/rows")
        drop_cut(placed)
        drop_cut(stats)

    def append(self, vectors: DataFrame) -> VectorIndex:
        """Add rows to the cells that are there; returns the index as it is then. If most rows came later than the fit, build anew."""
        if not len(self.centers):
            raise ValueError("the index was built without any usable vector: build it anew")
        self._write(vectors, self.path, self.id_col, self.vec_col, self.width, self.sort, True)
        return VectorIndex(self.spark, self.path)

    # ---- reading --------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All indexed rows, with ivf_cell and ivf_radius."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def probes(self) -> int:
        """The calibrated number of cells for probed searches; the square root of all cells without calibration."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/probes")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return min(len(self.cells), self.spark.read.parquet(f"{self.path}/probes").first().probes if there else int(len(self.cells) ** 0.5) + 1)

    def calibrate(self, target: float, k: int = CALIBRATE_K) -> int:
        """The least number of nearest cells that hold ``target`` of the true neighbours of ``CALIBRATE`` rows, which it finds by an exact search; it is kept with the index."""
        asked = bounded_sample(self.rows().where("ivf_cell >= 0").select(F.col(self.id_col).alias("query_id"), F.col(self.vec_col).alias("query")), "query_id", CALIBRATE)
        asked = cut(asked.dropDuplicates(["query_id"]), "asked")
        away = {r.query_id: np.argsort(np.argsort(self._away(np.array(r.query, np.float64))[0], kind="stable")) for r in asked.collect()}
        place = {int(c): i for i, c in enumerate(self.cells)}
        near = self.batch_top_k(asked, k, keep_cell=True).select("query_id", "ivf_cell").collect()  # CALIBRATE * k rows at most
        ranks = sorted(int(away[r.query_id][place[r.ivf_cell]]) for r in near)
        probes = ranks[min(len(ranks), -int(-len(ranks) * target // 1)) - 1] + 1 if ranks else 1
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")
        return probes

    def _away(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the centers from ``q``, and the least distance that a row of each cell can have."""
        away = np.sqrt(((self.centers - q) ** 2).sum(axis=1))
        return away, np.maximum(0, np.maximum(away - self.high, self.low - away))

    def _checked(self, query: list[float]) -> np.ndarray:
        q = np.array(query, np.float64)
        if len(self.cells) and q.shape != (self.width,):
            raise ValueError(f"the query has {q.size} components, the index {self.width}")
        return q

    def top_k(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """The ``k`` nearest rows, filtered first, with ``distance`` (squared), as a scan gives them. With ``probes`` only that many nearest cells are read."""
        q = self._checked(query)
        if not len(self.cells):
            return self._near(self.rows().where("ivf_cell <> -1"), q, where).limit(0)
        away, least = self._away(q)
        by_center = np.argsort(away, kind="stable")
        if probes is not None:
            return self._best(self._of(by_center[:probes]), q, k, where)
        bound, take = np.inf, int(np.searchsorted(np.cumsum(self.n[by_center]), k)) + 1
        while take < len(self.cells):
            found = self._best(self._of(by_center[:take]), q, k, where).select("distance").collect()  # k numbers at most
            if len(found) == k:
                bound = float(np.sqrt(max(r.distance for r in found))) * (1 + SLACK) + SLACK
                break
            take *= 4
        inside = np.flatnonzero(least <= bound)
        rows = self._of(inside)
        if np.isfinite(bound):
            near = F.create_map(*[x for i in inside for x in (F.lit(int(self.cells[i])), F.lit(float(away[i])))])
            rows = rows.where(F.col("ivf_radius").between(float(away[inside].min() - bound), float(away[inside].max() + bound)))  # reaches the files' statistics
            rows = rows.where(F.abs(F.col("ivf_radius") - F.element_at(near, F.col("ivf_cell"))) <= bound)
        return self._best(rows, q, k, where)

    def _of(self, places: np.ndarray) -> DataFrame:
        return self.rows().where(F.col("ivf_cell").isin([int(self.cells[i]) for i in places]))

    def _near(self, rows: DataFrame, q: np.ndarray, where: Column | None) -> DataFrame:
        rows = rows if where is None else rows.where(where)
        there = F.lit([float(x) for x in q]).cast("array<double>")
        return rows.withColumn("distance", squared_distance(F.col(self.vec_col), there)).drop("ivf_cell", "ivf_radius")

    def _best(self, rows: DataFrame, q: np.ndarray, k: int, where: Column | None) -> DataFrame:
        return self._near(rows, q, where).orderBy("distance", self.id_col).limit(k)

    # ---- many queries ---------------------------------------------------------------------------

    def batch_top_k(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_vec: str = "query", keep_cell: bool = False) -> DataFrame:
        """query_id, rank, distance and the rows' columns: the ``k`` nearest rows for each query, as a scan gives them, or among ``probes`` cells.

        Queries go in blocks whose (query, cell) pairs are at most ``PAIRS``; a block's pairs and queries are broadcast, the
        rows stay where they lie. Queries without a usable vector have no rows.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("query")).where(usable(F.col("query"), self.width))
        held = cut(asked, "queries")
        n, block = held.count(), max(1, PAIRS // max(1, len(self.cells)))
        if n <= block:
            return self._block(held, k, probes, keep_cell)
        blocks = -(-3 * n // (2 * block))  # two thirds full on average: hashing is uneven
        dealt = held.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        return reduce(DataFrame.unionAll, [cut(self._block(dealt.where(F.col("__block") == b).drop("__block"), k, probes, keep_cell), "nearest") for b in range(blocks)])

    def _block(self, queries: DataFrame, k: int, probes: int | None, keep_cell: bool = False) -> DataFrame:
        if not len(self.cells):
            return self._ranked(queries, self._pairs(queries.withColumn("bound", F.lit(None).cast("double")), 1), k, False, keep_cell)
        start = queries.withColumn("bound", F.lit(None).cast("double"))
        first = self._ranked(queries, self._pairs(start, self.probes() if probes is None else probes), k, False, keep_cell)
        if probes is not None:
            return first
        found = first.groupBy("query_id").agg(F.count("*").alias("m"), F.sqrt(F.max("distance")).alias("d"))
        bounds = cut(found.select("query_id", F.when(F.col("m") == k, F.col("d") * (1 + SLACK) + SLACK).otherwise(float("inf")).alias("bound")), "bounds")
        again = queries.join(F.broadcast(bounds), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return self._ranked(queries, self._pairs(again, None), k, True, keep_cell)

    def _pairs(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """query_id, ivf_cell, away, bound: the ``probes`` nearest cells of each query, or all that its bound lets in."""
        index = VectorIndex.__new__(VectorIndex)  # what the tasks need, without the session
        index.centers, index.low, index.high, cells = self.centers, self.low, self.high, self.cells

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors, bounds = (batch.column(i) for i in range(3))
                out: list = [[], [], [], []]
                for i, (v, b) in enumerate(zip(vectors.to_pylist(), bounds.to_pylist(), strict=True)):
                    away, least = index._away(np.array(v, np.float64))
                    inside = np.flatnonzero(least <= b) if probes is None else np.argsort(away, kind="stable")[:probes]
                    for got, more in zip(out, (np.full(len(inside), i), cells[inside], away[inside], np.full(len(inside), np.inf if b is None else b)), strict=True):
                        got.append(more)
                at, *rest = (np.concatenate(x) if x else np.empty(0) for x in out)
                columns = [ids.take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.float64(), pa.float64()), strict=True))]
                yield pa.record_batch(columns, names=["query_id", "ivf_cell", "away", "bound"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "query", "bound").mapInArrow(pairs, f"query_id {kind}, ivf_cell int, away double, bound double")

    def _ranked(self, queries: DataFrame, pairs: DataFrame, k: int, bounded: bool, keep_cell: bool) -> DataFrame:
        rows = self.rows().where("ivf_cell >= 0")
        ids, q = matrix(queries, "query_id", "query", max(self.width, 1))
        found = pairs.toArrow()  # at most PAIRS rows
        place = pc.index_in(found["query_id"], value_set=ids).to_numpy()
        cell, bound = found["ivf_cell"].to_numpy(), np.full(len(ids), np.inf)
        if bounded:
            bound[place] = found["bound"].to_numpy() ** 2 * (1 + SLACK)
        sort = np.argsort(cell, kind="stable")
        held, begin = np.unique(cell[sort], return_index=True)
        cells = {int(c): np.unique(part) for c, part in zip(held, np.split(place[sort], begin[1:]), strict=True)} if len(held) else {}
        near = nearest(rows.where(F.col("ivf_cell").isin(list(cells))), ids, q, k, self.id_col, self.vec_col, queries.schema["query_id"].dataType, bound, cells)
        near = near.drop("ivf_radius", *[] if keep_cell else ["ivf_cell"])
        w = Window.partitionBy("query_id").orderBy("distance", self.id_col)
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """query_id, recall: the share of each query's true neighbours (query_id, id_col) that ``found`` has."""
    hit = found.select("query_id", id_col, F.lit(1).alias("hit"))
    return truth.join(hit, ["query_id", id_col], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def temporary_path(root: str) -> str:
    return f"{root}/veritape/index-{uuid.uuid4().hex}"
