"""The persistent tables: versions that change as a whole, over immutable Parquet parts.

A table is a list of parts, each written once. A version is a small manifest that names the parts of
every table; it is put under the next free number, and only if no other writer has taken that number.
So a transaction over several tables is seen whole or not at all, a run that dies leaves the version
before it, and a reader that holds a version goes on reading it while others write.

Changes write only what changes: an upsert writes the changed keys, a replacement the companies it
covers. Reading lets the newest part win by key, or by company; parts are folded when there are many,
newest first and only while the next older one isn't much larger, so each row is rewritten a number
of times that grows with the logarithm of the table.

A writer that loses the race for a number tries the next one. If a table that it has read was changed
meanwhile, its work is done again on the new version; if not, its parts are added to the new version.

The log needs a file system where renaming to a name that exists fails (HDFS does; local files are
linked instead). Nothing here is a format of its own: parts are plain Parquet folders.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritape.functions.text import display_name, vector_id
from veritape.operators.dedup import last_wins
from veritape.operators.numbering import dense_numbers
from veritape.operators.retrieval import top_k
from veritape.operators.vector_index import VectorIndex
from veritape.schemas import TABLES
from veritape.session import cut

#: What the newest part wins by: the key, the company, or nothing.
UPSERT, REPLACE, APPEND = "upsert", "replace", "append"
KINDS = {"companies": UPSERT, "analysis_cache": UPSERT, "claims": REPLACE, "timeseries": REPLACE, "risk": REPLACE, "vectors": APPEND}
MAX_PARTS = 8
FOLD = 4  # a part joins a fold of newer ones unless it is more than so many times their size
ATTEMPTS = 30
KEEP_S = 3600  # parts of no version are younger than this while their writer may still commit


class Snapshot:
    """One version of all tables."""

    def __init__(self, store: Store, version: int, tables: dict[str, list[dict]], index: dict | None, streams: dict[str, int] | None = None):
        self.store, self.version, self.tables, self.index, self.streams = store, version, tables, index, streams or {}

    def parts(self, name: str) -> list[dict]:
        return self.tables.get(name, [])

    def exists(self, name: str) -> bool:
        return bool(self.parts(name))

    def read(self, name: str) -> DataFrame:
        return self._merged(name, self.parts(name))[0]

    def _rows(self, name: str, part: dict) -> DataFrame:
        return self.store.spark.read.schema(TABLES[name][0]).parquet(f"{self.store.root}/{part['rows']}")

    def _merged(self, name: str, parts: list[dict]) -> tuple[DataFrame, DataFrame | None]:
        """The rows of ``parts`` and, for tables that are replaced by company, the companies that they cover."""
        spark, kind = self.store.spark, KINDS[name]
        if not parts:
            return spark.createDataFrame([], TABLES[name][0]), None
        covers = [spark.read.schema("company_id bigint").parquet(f"{self.store.root}/{p['covers']}") for p in parts] if kind == REPLACE else []
        if len(parts) == 1:
            return self._rows(name, parts[0]), covers[0] if covers else None
        numbered = lambda frames: reduce(DataFrame.unionByName, [f.withColumn("__part", F.lit(i)) for i, f in enumerate(frames)])
        rows = numbered([self._rows(name, p) for p in parts])
        if kind == APPEND:
            return self._renewed(rows, parts)
        if kind == UPSERT:
            order = ["seq", "__part"] if "seq" in rows.columns else ["__part"]
            return last_wins(rows, TABLES[name][1], order).drop("__part"), None
        newest = numbered(covers).groupBy("company_id").agg(F.max("__part").alias("__part"))
        return rows.join(newest, ["company_id", "__part"]).select(*[c for c in rows.columns if c != "__part"]), newest.select("company_id")

    def _renewed(self, rows: DataFrame, parts: list[dict]) -> tuple[DataFrame, DataFrame | None]:
        """Vectors (with ``__part``) but those of companies that a later part renewed, and the renewed companies, if any."""
        covers = [self.store.spark.read.schema("company string").parquet(f"{self.store.root}/{p['covers']}").withColumn("__from", F.lit(i)) for i, p in enumerate(parts) if "covers" in p]
        if not covers:
            return rows.drop("__part"), None
        last = reduce(DataFrame.unionByName, covers).groupBy("company").agg(F.max("__from").alias("__from"))
        kept = rows.withColumn("company", F.col("metadata")["company"]).join(last, "company", "left").where("__from is null or __part >= __from")
        return kept.select(*[c for c in rows.columns if c != "__part"]), last.select("company")

    # ---- what the services read -----------------------------------------------------------------

    def company(self, folder: str) -> DataFrame:
        return self.read("companies").where(F.col("folder_name") == folder)

    def companies(self, ready: bool = False) -> DataFrame:
        rows = self.read("companies")
        return (rows.where("status = 'ready'") if ready else rows).select("id", "folder_name", "display_name", "status", "processed_at").orderBy("display_name")

    def analysis(self, company_id: int, mode: str) -> DataFrame:
        return self.read("analysis_cache").where((F.col("company_id") == company_id) & (F.col("mode") == mode))

    def claims(self, company_id: int) -> DataFrame:
        return self.read("claims").where(F.col("company_id") == company_id).orderBy("quarter")

    def vectors(self) -> DataFrame:
        return self.read("vectors").withColumn("company", F.col("metadata")["company"])

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        """The ``k`` nearest vectors with ``distance``, filtered first: from the index, and by a scan of what came after it.
        If some of that renewed companies the index still holds their old vectors, and all are scanned."""
        later = [p for p in self.parts("vectors") if p["rows"] not in self.index["parts"]] if self.index else []
        if self.index is None or any("covers" in p for p in later):
            return top_k(self.vectors(), query, k, where)
        found = VectorIndex(self.store.spark, f"{self.store.root}/{self.index['path']}").top_k(query, k, where)
        if not later:
            return found
        rest = self._merged("vectors", later)[0].withColumn("company", F.col("metadata")["company"])
        return found.unionByName(top_k(rest, query, k, where)).orderBy("distance", "id").limit(k)


class Transaction(Snapshot):
    """Changes on top of one version, which see each other; :meth:`Store.transact` commits them together."""

    def __init__(self, base: Snapshot):
        super().__init__(base.store, base.version, {k: list(v) for k, v in base.tables.items()}, base.index, dict(base.streams))
        self.base, self.added, self.seen, self.written = base, {}, set(), []

    def parts(self, name: str) -> list[dict]:
        self.seen.add(name)
        return super().parts(name)

    def _write(self, name: str, rows: DataFrame, covers: DataFrame | None = None) -> dict:
        part = {"rows": f"data/{name}/{uuid.uuid4().hex}"}
        self.written.append(part["rows"])
        rows.write.parquet(f"{self.store.root}/{part['rows']}")
        if covers is not None:
            part["covers"] = f"{part['rows']}-covers"
            self.written.append(part["covers"])
            covers.write.parquet(f"{self.store.root}/{part['covers']}")
        part["bytes"] = self.store.size(part["rows"])
        return part

    def _add(self, name: str, rows: DataFrame, covers: DataFrame | None = None) -> None:
        part = self._write(name, rows, covers)
        self.added.setdefault(name, []).append(part)
        self.tables.setdefault(name, []).append(part)

    def fold(self, name: str) -> None:
        """If a table has many parts, its newest become one. Appended parts only do if some of them renewed companies."""
        parts = self.tables.get(name, [])
        if len(parts) <= MAX_PARTS or (KINDS[name] == APPEND and not any("covers" in p for p in parts[1:])):
            return
        self.seen.add(name)
        at, total = len(parts) - 1, parts[-1]["bytes"]
        while at > 0 and (parts[at - 1]["bytes"] <= FOLD * total or len(parts) - at < 2):
            at -= 1
            total += parts[at]["bytes"]
        if KINDS[name] == APPEND and self.index and any(p["rows"] in self.index["parts"] for p in parts[at:]):
            self.index = None  # it names parts that are no more
        self.tables[name] = [*parts[:at], self._write(name, *self._merged(name, parts[at:]))]

    # ---- changes --------------------------------------------------------------------------------

    def upsert_companies(self, rows: DataFrame) -> None:
        """``rows``: folder_name, status, error_msg, seq. id and display_name keep their first value; processed_at is set only when ready."""
        self._add("companies", company_changes(self.read("companies"), rows))

    def save_analysis(self, rows: DataFrame) -> None:
        """company_id, mode, result_json, seq: the last per (company_id, mode) stays."""
        columns, key = [x.split()[0] for x in TABLES["analysis_cache"][0].split(", ")], TABLES["analysis_cache"][1]
        self._add("analysis_cache", last_wins(rows.withColumn("created_at", F.current_timestamp()).select(*columns), key, ["seq"]))

    def replace_company_rows(self, name: str, rows: DataFrame, order: list[str] | None = None, companies: DataFrame | None = None) -> None:
        """claims, timeseries or risk: the companies in ``rows`` get just these rows. Keys of the table are unique after it, the last in ``order`` staying.

        Companies of ``companies`` (company_id) that have no rows now lose those they had.
        """
        columns, key = [x.split()[0] for x in TABLES[name][0].split(", ")], TABLES[name][1]
        new = cut((last_wins(rows, key, order or key) if key else rows).select(*columns), "replaced")
        covers = new.select("company_id") if companies is None else new.select("company_id").unionByName(companies.select("company_id"))
        # sorted, so that a read of one company skips most of each file; no shuffle
        self._add(name, new.sortWithinPartitions("company_id"), covers.select(F.col("company_id").cast("long")).distinct())

    def append_vectors(self, sentences: DataFrame, embed: Column, order: list[str]) -> int:
        """Vectors of companies that have none yet; returns the table's row count."""
        old = self.read("vectors") if self.exists("vectors") else None
        rows = vector_rows(sentences, embed, order, old)
        self._add("vectors", rows.withColumn("embedding", F.col("embedding").cast("array<float>")))
        return self.read("vectors").count()  # from the files' footers

    def renew_vectors(self, sentences: DataFrame, embed: Column, order: list[str], companies: DataFrame) -> None:
        """Vectors of ``companies`` (company), which hold all of ``sentences``: just those of these, whatever they had. Old ones are
        read past until the parts are folded."""
        rows = vector_rows(sentences, embed, order)
        self._add("vectors", rows.withColumn("embedding", F.col("embedding").cast("array<float>")), companies.select("company").distinct())

    def note_batch(self, stream: str, batch: int) -> None:
        """``batch`` of a stream, and all before it, are part of this version."""
        self.streams[stream] = max(batch, self.streams.get(stream, -1))

    def index_vectors(self, **settings: Any) -> None:
        """A new index over all vectors of now; later ones are scanned until the next."""
        self.index = {"path": f"data/index/{uuid.uuid4().hex}", "parts": [p["rows"] for p in self.parts("vectors")]}
        self.written.append(self.index["path"])
        VectorIndex.build(self.vectors(), f"{self.store.root}/{self.index['path']}", sort=("company",), **settings)


class Store:
    """The tables of one analysis under ``root``. Reads go to the latest version; each single change is a transaction of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files ----------------------------------------------------------------------------------

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def size(self, path: str) -> int:
        fs, p = self._path(path)
        return fs.getContentSummary(p).getLength()

    def _names(self, path: str) -> list[tuple[str, float]]:
        fs, p = self._path(path)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _put(self, path: str, text: str) -> bool:
        """Write a file unless it is there; it appears whole or not at all."""
        name = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, staged = self._path(name)
        _, final = self._path(path)
        out = fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = self.spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority
                os.link(local(staged).toString(), local(final).toString())
            else:
                rename = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
                context.rename(staged, final, self.spark.sparkContext._gateway.new_array(rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(staged, False)

    # ---- versions -------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names("log") if n.endswith(".json"))

    def at(self, version: int) -> Snapshot:
        """The tables as of ``version``; 0 is the empty store."""
        if version == 0:
            return Snapshot(self, 0, {}, None, {})
        fs, p = self._path(f"log/{version:020}.json")
        stream = fs.open(p)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self, version, found["tables"], found["index"], found.get("streams"))

    def latest(self) -> Snapshot:
        return self.at(max(self.versions(), default=0))

    def transact(self, work: Callable[[Transaction], Any]) -> Any:
        """Do ``work`` on a transaction and commit all of it, or nothing if it raises. Returns what it returns."""
        for _ in range(ATTEMPTS):
            tx = Transaction(self.latest())
            try:
                result = work(tx)
                for name in list(tx.added):
                    tx.fold(name)
                if (tx.tables, tx.index, tx.streams) == (tx.base.tables, tx.base.index, tx.base.streams):
                    return result
                if self._commit(tx):
                    return result
            except BaseException:
                self._discard(tx)
                raise
            self._discard(tx)  # what it read has changed: once more
        raise RuntimeError(f"another writer came first {ATTEMPTS} times")

    def _commit(self, tx: Transaction) -> bool:
        base = tx.base
        for _ in range(ATTEMPTS):
            changed = {k for k in {*base.tables, *tx.base.tables} if base.tables.get(k, []) != tx.base.tables.get(k, [])}
            if changed & tx.seen or (base.streams != tx.base.streams and tx.streams != tx.base.streams) or (base.index != tx.base.index and tx.index != tx.base.index):
                return False
            tables = {k: [*base.tables.get(k, []), *tx.added.get(k, [])] if k in changed else tx.tables.get(k, []) for k in {*base.tables, *tx.tables}}
            index = base.index if tx.index == tx.base.index else tx.index
            streams = base.streams if tx.streams == tx.base.streams else tx.streams
            if self._put(f"log/{base.version + 1:020}.json", json.dumps({"at": time.time(), "tables": tables, "index": index, "streams": streams}, sort_keys=True)):
                return True
            base = self.latest()
        return False

    def _discard(self, tx: Transaction) -> None:
        for path in tx.written:
            fs, p = self._path(path)
            fs.delete(p, True)

    def roll_back(self, version: int) -> None:
        """A new version with the tables of an older one."""

        def work(tx: Transaction) -> None:
            old = self.at(version)
            tx.seen |= {*tx.tables, *old.tables}
            tx.tables, tx.index, tx.streams = {k: list(v) for k, v in old.tables.items()} | {k: [] for k in tx.tables if k not in old.tables}, old.index, dict(old.streams)

        self.transact(work)

    def vacuum(self, keep: int = 10, older_s: float = KEEP_S) -> int:
        """Delete all but the last ``keep`` versions, and parts that none of these names; returns the number of parts."""
        versions = self.versions()
        for v in versions[:-keep]:
            fs, p = self._path(f"log/{v:020}.json")
            fs.delete(p, False)
        kept = [self.at(v) for v in versions[-keep:]]
        named = {x for s in kept for parts in s.tables.values() for p in parts for x in (p["rows"], p.get("covers"))} | {s.index["path"] for s in kept if s.index}
        stale = [f"data/{t}/{n}" for t, _ in self._names("data") for n, at in self._names(f"data/{t}") if f"data/{t}/{n}" not in named and at < time.time() - older_s]
        for path in stale:
            fs, p = self._path(path)
            fs.delete(p, True)
        return len(stale)

    # ---- reads of the latest version, and single changes ----------------------------------------

    def create(self) -> None:
        """Nothing to do: a store without a version has all tables, empty."""

    def exists(self, name: str) -> bool:
        return self.latest().exists(name)

    def read(self, name: str) -> DataFrame:
        return self.latest().read(name)

    def company(self, folder: str) -> DataFrame:
        return self.latest().company(folder)

    def companies(self, ready: bool = False) -> DataFrame:
        return self.latest().companies(ready)

    def analysis(self, company_id: int, mode: str) -> DataFrame:
        return self.latest().analysis(company_id, mode)

    def claims(self, company_id: int) -> DataFrame:
        return self.latest().claims(company_id)

    def nearest(self, query: list[float], k: int, where: Column | None = None) -> DataFrame:
        return self.latest().nearest(query, k, where)

    def upsert_companies(self, rows: DataFrame) -> None:
        self.transact(lambda tx: tx.upsert_companies(rows))

    def save_analysis(self, rows: DataFrame) -> None:
        self.transact(lambda tx: tx.save_analysis(rows))

    def replace_company_rows(self, name: str, rows: DataFrame, order: list[str] | None = None, companies: DataFrame | None = None) -> None:
        self.transact(lambda tx: tx.replace_company_rows(name, rows, order, companies))

    def append_vectors(self, sentences: DataFrame, embed: Column, order: list[str]) -> int:
        return self.transact(lambda tx: tx.append_vectors(sentences, embed, order))

    def index_vectors(self, **settings: Any) -> None:
        self.transact(lambda tx: tx.index_vectors(**settings))


def company_changes(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``old`` that ``rows`` changes, changed, and new ones: last status, error and time, first id and display name."""
    last = last_wins(rows.select("folder_name", "status", F.when(F.col("status") == "ready", F.current_timestamp()).alias("processed_at"), "error_msg", "seq"), ["folder_name"], ["seq"])
    firsts = rows.groupBy("folder_name").agg(F.min("seq").alias("__first"))
    known = old.select("folder_name", "id", "display_name", F.struct("status", "processed_at", "error_msg", "seq").alias("__old"))
    most = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__max"))
    fresh = firsts.join(old.select("folder_name"), "folder_name", "left_anti").crossJoin(F.broadcast(most))  # one row
    new = dense_numbers(fresh, ["__first", "folder_name"], "id", F.col("__max")).select("folder_name", "id", display_name(F.col("folder_name"), strict=False).alias("display_name"), F.lit(None).cast(known.schema["__old"].dataType).alias("__old"))
    now = F.struct("status", "processed_at", "error_msg", "seq")
    newer = F.when(F.col("__old").isNull() | (F.col("__old.seq").isNull()) | (F.col("seq") >= F.col("__old.seq")), now).otherwise(F.col("__old"))
    changed = last.join(known.unionByName(new), "folder_name").withColumn("__now", newer)
    return changed.select("id", "folder_name", "display_name", "__now.status", "__now.processed_at", "__now.error_msg", "__now.seq")


def upsert_companies(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The whole table after :func:`company_changes`."""
    changed = company_changes(old, rows)
    return old.select(*changed.columns).join(changed.select("folder_name"), "folder_name", "left_anti").select(*changed.columns).unionByName(changed)


def vector_rows(sentences: DataFrame, embed: Column, order: list[str], old: DataFrame | None = None) -> DataFrame:
    """id, document, metadata, embedding for the sentences of companies that ``old`` lacks; ids number the input, blank rows included."""
    rows = sentences
    if old is not None:
        rows = rows.join(old.select(F.col("metadata")["company"].alias("company")).distinct(), "company", "left_anti")
    has = set(sentences.columns)
    value = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    n = F.row_number().over(Window.partitionBy("company").orderBy(*order)) - 1
    rows = rows.withColumn("__i", n).where(F.trim("sentence") != "")
    meta = F.create_map(F.lit("company"), F.col("company"), F.lit("quarter"), value("quarter", ""), F.lit("result"), value("result", "CONTEXT"), F.lit("reason"), value("reason", "TRANSCRIPT_EXCERPT"))
    return rows.select(vector_id(F.col("company"), F.col("__i")).alias("id"), F.col("sentence").alias("document"), meta.alias("metadata"), embed.alias("embedding"))
