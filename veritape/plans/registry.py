"""Every query of the claim-analysis engine with its SQL equivalent, bound to the star-schema test tables.

Each query runs an operator over its whole table. Where a query needs text that the tables lack
(folder names, filing tags, answers of a model), it is built from their columns by rule.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritape.functions import numbers as N
from veritape.functions import quarters as Q
from veritape.functions import text as T
from veritape.functions import vocab as V
from veritape.models import model_claims, probability
from veritape.operators import asof, claims, classifier, dataset, dedup, embedder, facts, fuzzy, payload, retrieval, risk, sentence_model, timeseries, verify
from veritape.operators.numbering import dense_numbers
from veritape.operators.vector_index import VectorIndex, bounded_sample, recall, temporary_path
from veritape.schemas import TABLES
from veritape.session import cut, shared_dir, table
from veritape.sinks import Store, upsert_companies, vector_rows
from veritape.sources.xbrl import raw_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return keep


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# ---- quarters, names, weights -------------------------------------------------------------------

SQL_FQ = "CASE WHEN month({d}) <= 3 THEN year({d}) || '-Q4' ELSE (year({d}) + 1) || '-Q' || CAST(ceil((month({d}) - 3) / 3.0) AS INTEGER) END"
SQL_NORMAL = """
CASE WHEN regexp_matches({q}, '([1-4])[Qq].*?(?:FY|20)?(\\d{{2,4}})') THEN regexp_extract({q}, '([1-4])[Qq].*?(?:FY|20)?(\\d{{2,4}})', {i})
     WHEN regexp_matches({q}, '[Qq]([1-4]).*?(?:FY|20)?(\\d{{2,4}})') THEN regexp_extract({q}, '[Qq]([1-4]).*?(?:FY|20)?(\\d{{2,4}})', {i})
     WHEN regexp_matches({q}, '^\\d{{4}}-Q[1-4]$') THEN {plain} END"""


def sql_normalise(rel: str, col: str) -> str:
    """A relation like ``rel`` with ``col`` normalised, as SQL."""
    n = SQL_NORMAL.format(q="uq", i=1, plain="substr(uq, 7, 1)")
    y = SQL_NORMAL.format(q="uq", i=2, plain="substr(uq, 1, 4)")
    return f"""(SELECT * EXCLUDE (uq, yy, nn, {col}), CASE WHEN yy IS NULL THEN uq ELSE (CASE WHEN contains(uq, 'FY') OR nn = 4 THEN y2 ELSE y2 + 1 END) || '-Q' || nn END AS {col}
 FROM (SELECT *, CASE WHEN yy < 100 THEN yy + 2000 ELSE yy END AS y2 FROM (SELECT *, CAST({y} AS INTEGER) AS yy, CAST({n} AS INTEGER) AS nn FROM (SELECT *, upper(trim({col})) AS uq FROM {rel}))))"""


@query(f"SELECT o_orderkey, {SQL_FQ.format(d='o_orderdate')} AS fiscal, CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS y FROM orders")
def fiscal_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-2, SRT-1"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", Q.fiscal_quarter(F.col("o_orderdate")).alias("fiscal"))
    return o.withColumn("y", Q.sort_key(F.col("fiscal")).y.cast("bigint"))


def _quarter_text(o: DataFrame) -> DataFrame:
    y, n, k = F.year("o_orderdate"), F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 6
    yy = F.lpad((y % 100).cast("string"), 2, "0")
    c = F.concat
    made = (
        F.when(k == 0, c(F.lit("Q"), n, F.lit("FY"), yy))
        .when(k == 1, c(n, F.lit("q"), yy))
        .when(k == 2, c(F.lit(" Q"), n, F.lit(" "), y.cast("string")))
        .when(k == 3, c(y.cast("string"), F.lit("-Q"), n))
        .when(k == 4, c(F.lit("Q"), n, F.lit(" FY"), y.cast("string"), F.lit("-"), yy))
        .otherwise(c(y.cast("string"), F.lit("-Unknown")))
    )
    return o.select("o_orderkey", made.alias("raw"))


SQL_QTEXT = """(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Q' || n || 'FY' || yy WHEN 1 THEN n || 'q' || yy WHEN 2 THEN ' Q' || n || ' ' || y
 WHEN 3 THEN y || '-Q' || n WHEN 4 THEN 'Q' || n || ' FY' || y || '-' || yy ELSE y || '-Unknown' END AS raw
 FROM (SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS n, lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS yy FROM orders))"""


@query(f"SELECT a.o_orderkey, a.raw, b.raw AS normal FROM {SQL_QTEXT} a JOIN (SELECT o_orderkey, raw FROM {sql_normalise(SQL_QTEXT, 'raw')}) b USING (o_orderkey)")
def quarter_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13"""
    return _quarter_text(table(spark, sf_dir, "orders")).withColumn("normal", Q.normalise_quarter(F.col("raw")))


SQL_FOLDER = """(SELECT doc_id, source, CASE doc_id % 7 WHEN 0 THEN 'FY ' || (10 + doc_id % 15) || '-' || (11 + doc_id % 15) WHEN 1 THEN source || '_' || (10 + doc_id % 15)
 WHEN 2 THEN source || ' 20' || (10 + doc_id % 15) WHEN 3 THEN (2010 + doc_id % 15) || '-' || (2011 + doc_id % 15) WHEN 4 THEN 'X_2000' WHEN 5 THEN 'FY20' || (10 + doc_id % 15) ELSE 'misc' END AS folder FROM documents)"""
SQL_YEAR = """CASE WHEN regexp_extract(folder, '(\\d{2})-(\\d{2})', 2) <> '' THEN 2000 + CAST(regexp_extract(folder, '(\\d{2})-(\\d{2})', 2) AS INTEGER)
 WHEN regexp_extract(folder, '[_\\s](\\d{2,4})$', 1) <> '' THEN CAST(regexp_extract(folder, '[_\\s](\\d{2,4})$', 1) AS INTEGER) + CASE WHEN CAST(regexp_extract(folder, '[_\\s](\\d{2,4})$', 1) AS INTEGER) > 2000 THEN 0 ELSE 2000 END
 WHEN regexp_extract(folder, '(20\\d{2})', 1) <> '' THEN CAST(regexp_extract(folder, '(20\\d{2})', 1) AS INTEGER) END"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("doc_id") % 7, F.col("doc_id") % 15
    s = lambda x: x.cast("string")
    folder = (
        F.when(k == 0, F.concat(F.lit("FY "), s(n + 10), F.lit("-"), s(n + 11)))
        .when(k == 1, F.concat("source", F.lit("_"), s(n + 10)))
        .when(k == 2, F.concat("source", F.lit(" 20"), s(n + 10)))
        .when(k == 3, F.concat(s(n + 2010), F.lit("-"), s(n + 2011)))
        .when(k == 4, F.lit("X_2000"))
        .when(k == 5, F.concat(F.lit("FY20"), s(n + 10)))
        .otherwise(F.lit("misc"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "source", folder.alias("folder"))


@query(f"SELECT doc_id, folder, {SQL_YEAR} AS yr FROM {SQL_FOLDER}")
def year_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11"""
    return _folders(spark, sf_dir).select("doc_id", "folder", Q.folder_year(F.col("folder")).alias("yr"))


@query(f"SELECT doc_id, CASE WHEN yr IS NULL THEN 'Unknown' WHEN doc_id % 5 < 4 THEN yr || '-Q' || (doc_id % 5 + 1) ELSE yr || '-Unknown' END AS doc_q FROM (SELECT doc_id, {SQL_YEAR} AS yr FROM {SQL_FOLDER})")
def doc_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12"""
    name = F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("call q"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit(".txt"))).otherwise("notes.TXT")
    return _folders(spark, sf_dir).select("doc_id", Q.file_quarter(name, Q.folder_year(F.col("folder"))).alias("doc_q"))


@query(f"SELECT source, folder, round(greatest(1 - 0.25 * (row_number() OVER (PARTITION BY source ORDER BY yr DESC, folder) - 1), 0.1), 2)::DOUBLE AS weight FROM (SELECT DISTINCT source, folder, {SQL_YEAR} AS yr FROM {SQL_FOLDER}) WHERE yr IS NOT NULL")
def recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1, JN-6"""
    f = _folders(spark, sf_dir).select("source", "folder").distinct().withColumn("y", Q.folder_year(F.col("folder"))).where("y is not null")
    w = Window.partitionBy("source").orderBy(F.desc("y"), "folder")
    return f.select("source", "folder", N.recency_weight(F.row_number().over(w) - 1).cast("double").alias("weight"))


@query(
    """SELECT p_partkey, trim(regexp_replace(f, '(?i)\\s*\\d{4}\\s*Quarterly\\s*Data\\s*', '', 'g')) AS shown, regexp_replace(p_name, '[^a-zA-Z0-9_\\-]', '_', 'g') AS safe, lower(trim(p_brand)) AS key,
 substr(replace(p_name, ' ', '_'), 1, 30) || '_' || p_size AS vid FROM (SELECT *, p_name || ' ' || (2000 + p_size) || ' Quarterly Data' AS f FROM part)"""
)
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14, STR-16, STR-18, STR-21"""
    p = table(spark, sf_dir, "part").withColumn("f", F.concat("p_name", F.lit(" "), (F.col("p_size") + 2000).cast("string"), F.lit(" Quarterly Data")))
    return p.select("p_partkey", T.display_name(F.col("f")).alias("shown"), T.safe_name(F.col("p_name")).alias("safe"), T.company_key(F.col("p_brand")).alias("key"), T.vector_id(F.col("p_name"), F.col("p_size")).alias("vid"))


# ---- facts --------------------------------------------------------------------------------------

_TAGS = [r[0] for r in V.TAG_METRIC] + V.TAG_BLOCKLIST + ["ComprehensiveIncomeForThePeriod", "IncomeTaxExpense", "Unknown"]
SQL_TAGGED = f"(SELECT *, list_extract({_list(_TAGS)}, CAST((l_orderkey + l_linenumber * 5) % {len(_TAGS)} AS INTEGER) + 1) AS tag FROM lineitem)"
SQL_METRIC = (
    f"CASE WHEN list_contains({_list(V.TAG_BLOCKLIST)}, tag) THEN NULL "
    + " ".join(f"WHEN tag = '{t}' THEN '{m}'" for t, m, _ in V.TAG_METRIC)
    + " "
    + " ".join(f"WHEN contains(lower(tag), '{t.lower()}') THEN '{m}'" for t, m, _ in V.TAG_METRIC)
    + " END"
)
SQL_PRIORITY = "CASE " + " ".join(f"WHEN tag = '{t}' THEN {p}" for t, _, p in V.TAG_METRIC) + " ELSE 50 END"
SQL_SCALED = "CASE WHEN abs(v) > 1000000 THEN round_even(v / 10000000, 4) ELSE v END"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(t) for t in _TAGS])
    return li.withColumn("tag", F.get(names, ((F.col("l_orderkey") + F.col("l_linenumber") * 5) % len(_TAGS)).cast("int")))


@query(f"SELECT l_orderkey, l_linenumber, tag, {SQL_METRIC} AS metric, {SQL_PRIORITY} AS priority FROM {SQL_TAGGED}")
def fact_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-4, STR-22"""
    t = _tagged(spark, sf_dir).withColumn("qname", F.concat(F.lit("{http://example.org/ns}"), "tag"))
    tag = T.local_name(F.col("qname"))
    return t.select("l_orderkey", "l_linenumber", tag.alias("tag"), facts.map_tag(tag).alias("metric"), facts.tag_priority(tag).alias("priority"))


@query(f"SELECT l_orderkey, l_linenumber, {SQL_SCALED} AS scaled FROM (SELECT *, CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE l_extendedprice * 101.7::DOUBLE END AS v FROM lineitem) WHERE abs(v) >= 1 AND l_returnflag <> 'R'")
def fact_admit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7, FLT-8, MTH-1, MTH-3"""
    text = F.when(F.col("l_linenumber") % 7 == 6, "n/a").otherwise((F.col("l_extendedprice") * 101.7).cast("string"))
    context = F.when(F.col("l_returnflag") == "R", "D_SegmentA").otherwise("D")
    rows = table(spark, sf_dir, "lineitem").withColumns({"v": N.number(text), "ctx": context}).where("abs(v) >= 1").where(~facts.is_segment(F.col("ctx")))
    return rows.select("l_orderkey", "l_linenumber", N.scale_fact(F.col("v")).alias("scaled"))


@query(
    f"""SELECT l_suppkey, metric, tag, CAST(priority AS BIGINT) AS priority, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, metric ORDER BY priority DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
 FROM (SELECT *, {SQL_METRIC} AS metric, {SQL_PRIORITY} AS priority FROM {SQL_TAGGED}) WHERE metric IS NOT NULL) WHERE rn = 1"""
)
def fact_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1"""
    t = _tagged(spark, sf_dir).withColumns({"metric": facts.map_tag(F.col("tag")), "priority": facts.tag_priority(F.col("tag"))}).where("metric is not null")
    return facts.pick_by_priority(t, ["l_suppkey", "metric"], "priority", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("l_suppkey", "metric", "tag", F.col("priority").cast("bigint").alias("priority"), "l_extendedprice")


@query(
    """SELECT l_orderkey, l_linenumber, tag, ref, unit, value, CASE WHEN NOT is_instant THEN day END AS start, CASE WHEN NOT is_instant THEN strftime(l_shipdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS "end", CASE WHEN is_instant THEN day END AS instant
 FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS day, ref LIKE 'I%' AS is_instant FROM (
 SELECT *, 'Income' AS tag, 'D' || l_linenumber AS ref, 'INR' AS unit, l_extendedprice AS value FROM lineitem
 UNION ALL SELECT *, 'Expenses', 'I' || l_linenumber, NULL, l_quantity FROM lineitem)) WHERE (l_orderkey + l_linenumber) % 11 <> 5"""
)
def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, SRC-7, JN-5, XML-1: a filing a line, parsed; contexts stand before and after their facts, and each eleventh filing breaks at its end"""
    # parsing costs far more than reading, so rows are dealt to all cores, not read by the few tasks that a file makes; a number of partitions that is given isn't merged again
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity").repartition(tasks, "l_orderkey", "l_linenumber")
    date = lambda name, days: F.concat(F.lit(f"<i:{name}>"), F.date_format(F.date_add("l_shipdate", days), "yyyy-MM-dd"), F.lit(f"</i:{name}>"))
    context = lambda kind, *dates: F.concat(F.lit(f'<i:context id="{kind}'), F.col("l_linenumber").cast("string"), F.lit('"><i:period>'), *dates, F.lit("</i:period></i:context>"))
    fact = lambda tag, kind, unit, c: F.concat(F.lit(f'<e:{tag} {unit} contextRef="{kind}'), F.col("l_linenumber").cast("string"), F.lit('">'), F.col(c).cast("string"), F.lit(f"</e:{tag}>"))
    span, instant = context("D", date("startDate", 0), date("endDate", 90)), context("I", date("instant", 0))
    last = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 5, "</x").otherwise("</x>")
    text = F.concat(F.lit('<x xmlns:i="http://www.xbrl.org/2003/instance" xmlns:e="http://example.org">'), span, fact("Income", "D", 'unitRef="INR"', "l_extendedprice"), fact("Expenses", "I", "", "l_quantity"), instant, last)
    raw = raw_facts(li.select("l_orderkey", "l_linenumber", text.cast("binary").alias("content")), ("l_orderkey", "l_linenumber"))
    return raw.select("l_orderkey", "l_linenumber", T.local_name(F.col("tag")).alias("tag"), F.col("context_ref").alias("ref"), F.col("unit_ref").alias("unit"), N.number(F.col("text")).alias("value"), "start", "end", "instant")


@query("SELECT l_partkey, l_returnflag, l_quantity, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_quantity ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-1, SRT-2"""
    return dedup.first_wins(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag", "l_quantity"], [F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, days, days <= 105 AS admitted FROM (SELECT o_orderkey, CAST(o_orderkey % 200 AS BIGINT) AS days FROM orders)")
def period_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1"""
    o = table(spark, sf_dir, "orders").withColumn("days", (F.col("o_orderkey") % 200).cast("bigint"))
    start = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", "days", Q.period_admitted(start.cast("string"), F.date_add(start, F.col("days").cast("int")).cast("string")).alias("admitted"))


# ---- series -------------------------------------------------------------------------------------


def _series_facts(spark: SparkSession, sf_dir: str, company: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    metric = F.when(F.col("o_orderstatus") == "F", "revenue").when(F.col("o_orderstatus") == "O", "net_profit").otherwise("operating_profit")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")) if company == "c_mktsegment" else o
    return joined.select(F.col(company).cast("string").alias("company"), Q.fiscal_quarter(F.col("o_orderdate")).alias("quarter"), metric.alias("metric"), F.col("o_totalprice").alias("value"))


def sql_pivot(company: str) -> str:
    source = "orders JOIN customer ON o_custkey = c_custkey" if company == "c_mktsegment" else "orders"
    return f"""(SELECT company, quarter, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS revenue, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS net_profit,
 max(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN o_totalprice END) AS operating_profit FROM (SELECT CAST({company} AS VARCHAR) AS company, {SQL_FQ.format(d="o_orderdate")} AS quarter, * FROM {source}) GROUP BY company, quarter)"""


def sql_filled(company: str) -> str:
    w = "OVER (PARTITION BY company ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"last_value({c} IGNORE NULLS) {w} AS {c}" for c in ("revenue", "net_profit", "operating_profit"))
    return f"(SELECT company, quarter, {cols} FROM {sql_pivot(company)})"


def sql_features(company: str) -> str:
    out = []
    for c in V.SERIES_COLUMNS:
        out += [
            f"(({c} - lag({c}, 1) OVER w) / nullif(lag({c}, 1) OVER w, 0)) * 100 AS {c}_qoq_change",
            f"{c} - lag({c}, 1) OVER w AS {c}_qoq_abs_change",
            f"(({c} - lag({c}, 4) OVER w) / nullif(lag({c}, 4) OVER w, 0)) * 100 AS {c}_yoy_change",
        ]
    return f"(SELECT company, quarter, revenue, net_profit, operating_profit, profit_margin, {', '.join(out)} FROM (SELECT *, net_profit / nullif(revenue, 0) * 100 AS profit_margin FROM {sql_filled(company)}) WINDOW w AS (PARTITION BY company ORDER BY quarter))"


@query(f"SELECT * FROM {sql_pivot('o_custkey')}")
def ts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2"""
    return timeseries.pivot_metrics(_series_facts(spark, sf_dir, "o_custkey"))


@query(f"SELECT * FROM {sql_filled('o_custkey')}")
def ts_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3"""
    return timeseries.forward_fill(ts_pivot(spark, sf_dir), ["revenue", "net_profit", "operating_profit"])


@query(f"SELECT * FROM {sql_features('c_mktsegment')}")
def ts_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2, WIN-3 to WIN-6, MTH-2, SRT-1"""
    return timeseries.features(timeseries.pivot_metrics(_series_facts(spark, sf_dir, "c_mktsegment")))


@query(f"SELECT * FROM {sql_features('o_custkey')}")
def ts_features_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over customers, whose quarters have gaps."""
    return timeseries.features(ts_pivot(spark, sf_dir))


@query(f"SELECT {', '.join(f'count({c}) > 0 AS has_{c}' for c in V.SERIES_COLUMNS)} FROM {sql_features('o_custkey')}")
def ts_present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-6"""
    return timeseries.present_columns(ts_features_sparse(spark, sf_dir))


# ---- claims against the series ------------------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "NOWHERE"]
_METRICS = ["revenue", "profit", "ebitda", "margin", "expenses", "npa", "loan", "provision"]
_DIRECTIONS = ["increase", "decrease", "neutral"]
SQL_CLAIMS = f"""(SELECT event_id, list_extract({_list(_SEGMENTS)}, CAST(event_id % 6 AS INTEGER) + 1) AS company,
 CASE WHEN event_id % 11 = 0 THEN (1994 + event_id % 9) || '-UNKNOWN' ELSE (1993 + event_id % 12) || '-Q' || (event_id % 4 + 1) END AS quarter,
 list_extract({_list(_METRICS)}, CAST(event_id % 8 AS INTEGER) + 1) AS metric, CASE WHEN event_id % 4 = 3 THEN NULL ELSE list_extract({_list(_DIRECTIONS)}, CAST(event_id % 4 AS INTEGER) + 1) END AS direction,
 CASE WHEN event_id % 3 = 0 THEN 'up YoY on ' || event_type ELSE 'better ' || event_type END AS sentence FROM events)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (i % k).cast("int"))
    s = lambda x: x.cast("string")
    return e.select(
        "event_id",
        pick(_SEGMENTS, 6).alias("company"),
        F.when(i % 11 == 0, F.concat(s(i % 9 + 1994), F.lit("-UNKNOWN"))).otherwise(F.concat(s(i % 12 + 1993), F.lit("-Q"), s(i % 4 + 1))).alias("quarter"),
        pick(_METRICS, 8).alias("metric"),
        F.when(i % 4 < 3, pick(_DIRECTIONS, 4)).alias("direction"),
        F.when(i % 3 == 0, F.concat(F.lit("up YoY on "), "event_type")).otherwise(F.concat(F.lit("better "), "event_type")).alias("sentence"),
    )


def sql_asof(claims_sql: str, series_sql: str) -> str:
    return f"""(SELECT m.*, CASE WHEN prevq = quarter THEN 'EXACT_MATCH' WHEN prevq IS NOT NULL THEN 'FALLBACK_PREV_QUARTER' WHEN lastq IS NOT NULL THEN 'FALLBACK_LATEST' ELSE 'NO_COMPANY_DATA' END AS match_type
 FROM (SELECT c.*, (SELECT max(s.quarter) FROM {series_sql} s WHERE s.company = c.company AND s.quarter <= c.quarter) AS prevq, (SELECT max(s.quarter) FROM {series_sql} s WHERE s.company = c.company) AS lastq FROM {claims_sql} c) m)"""


@query(f"WITH ts AS MATERIALIZED (SELECT * FROM {sql_features('c_mktsegment')}) SELECT a.event_id, a.company, a.quarter, a.match_type, ts.quarter AS matched, ts.revenue FROM {sql_asof(SQL_CLAIMS, 'ts')} a LEFT JOIN ts ON ts.company = a.company AND ts.quarter = coalesce(a.prevq, a.lastq)")
def asof_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1, T2"""
    out = asof.asof_with_fallback(_claims(spark, sf_dir), ts_features(spark, sf_dir), "company", "quarter")
    return out.select("event_id", "company", "quarter", "match_type", F.col("match.quarter").alias("matched"), F.col("match.revenue").alias("revenue"))


def _sql_verified() -> str:
    series = sql_normalise(f"(SELECT * FROM {sql_features('c_mktsegment')})", "quarter")
    base = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in V.METRIC_COLUMN.items()) + " END"
    pick = lambda kind: "CASE base " + " ".join(f"WHEN '{c}' THEN {c}_{kind}_change" for c in V.SERIES_COLUMNS) + " END"
    return f"""WITH ts AS MATERIALIZED (SELECT * FROM {series}), cl AS (SELECT * FROM {sql_normalise(SQL_CLAIMS, "quarter")}),
 matched AS (SELECT a.event_id, a.company, a.quarter, a.metric, a.direction, a.sentence, a.match_type, ts.company IS NOT NULL AS found, {base} AS b0, ts.* EXCLUDE (company, quarter) FROM {sql_asof("cl", "ts")} a LEFT JOIN ts ON ts.company = a.company AND ts.quarter = coalesce(a.prevq, a.lastq)),
 based AS (SELECT *, CASE WHEN b0 = 'total_expenses' THEN NULL ELSE b0 END AS base FROM matched),
 changed AS (SELECT *, CASE WHEN contains(lower(sentence), 'yoy') OR contains(lower(sentence), 'year') THEN {pick("yoy")} ELSE {pick("qoq")} END AS one, {pick("qoq")} AS two FROM based),
 judged AS (SELECT *, coalesce(one, two) AS ch, base IS NOT NULL AND found AND coalesce(one, two) IS NOT NULL AS done, CASE lower(direction) WHEN 'increase' THEN coalesce(one, two) WHEN 'decrease' THEN -coalesce(one, two) END AS towards FROM changed)
 SELECT event_id, company, quarter, metric, direction, sentence, CASE WHEN done THEN round_even(ch, 2) END AS actual_change,
 CASE WHEN NOT done THEN 'SKIPPED' WHEN towards IS NULL THEN 'PARTIAL' WHEN towards > 2 THEN 'VERIFIED' WHEN towards < -2 THEN 'NOT VERIFIED' ELSE 'PARTIAL' END AS result,
 CASE WHEN base IS NULL THEN 'MISSING_METRIC_MAPPING' WHEN NOT found THEN 'MISSING_TS_ROW' WHEN ch IS NULL THEN 'MISSING_VALUE' ELSE (CASE WHEN towards IS NULL THEN 'UNKNOWN_DIRECTION' WHEN towards > 2 THEN 'VERIFIED_STRONG' WHEN towards < -2 THEN 'CONTRADICTS_DIRECTION' ELSE 'PARTIAL_NO_CHANGE' END) || ' | ' || match_type || CASE WHEN one IS NULL THEN '|FALLBACK_CHANGE' ELSE '' END END AS reason FROM judged"""


@query(_sql_verified())
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-2, JN-3, STR-17, MTH-7, MTH-8, T1, T3, T5"""
    return verify.verify(_claims(spark, sf_dir), ts_features(spark, sf_dir))


# ---- risk ---------------------------------------------------------------------------------------

SQL_RESULTS = f"""(SELECT c_mktsegment AS company, {SQL_FQ.format(d="o_orderdate")} AS quarter, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'P' THEN 'NOT VERIFIED' ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'PARTIAL' END END AS result,
 CASE o_orderstatus WHEN 'P' THEN 'CONTRADICTS_DIRECTION | EXACT_MATCH' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING_VALUE' ELSE 'UNKNOWN_DIRECTION' END ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'CONTRADICTS_OTHER' ELSE 'VERIFIED_STRONG' END END AS reason FROM orders JOIN customer ON o_custkey = c_custkey)"""
_RATES = [("ver", "result = 'VERIFIED'"), ("fail", "result = 'NOT VERIFIED'"), ("part", "result = 'PARTIAL'"), ("skip", "coalesce(result, 'SKIPPED') = 'SKIPPED'"), ("mismatch", "contains(reason, 'CONTRADICTS_DIRECTION')"), ("missing", "contains(reason, 'MISSING')"), ("unknown", "contains(reason, 'UNKNOWN_DIRECTION')")]
SQL_RATES = f"(SELECT company, quarter, count(*) AS total_claims, {', '.join(f'count(*) FILTER ({c}) / count(*) AS {n}' for n, c in _RATES)} FROM {SQL_RESULTS} GROUP BY company, quarter)"
_R4 = "round_even({0} * 10000, 0) / 10000"
SQL_RISK = f"""SELECT company, quarter, CAST(total_claims AS BIGINT) AS total_claims, quarter_weight, verification_rate, failure_rate, partial_rate, skipped_rate, direction_mismatch_rate, missing_data_rate, unknown_direction_rate, consistency_score,
 {_R4.format("coalesce(failure_rate - avg(failure_rate) OVER (PARTITION BY company ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)")} AS risk_drift,
 CASE WHEN failure_rate > 0.4 OR direction_mismatch_rate > 0.3 OR consistency_score < 0.5 THEN 1 ELSE 0 END AS warning_flag FROM (SELECT company, quarter, total_claims, quarter_weight,
 {_R4.format("ver")} AS verification_rate, {_R4.format("fail")} AS failure_rate, {_R4.format("part")} AS partial_rate, {_R4.format("skip")} AS skipped_rate, {_R4.format("mismatch")} AS direction_mismatch_rate, {_R4.format("missing")} AS missing_data_rate, {_R4.format("unknown")} AS unknown_direction_rate,
 round_even(greatest(0::DOUBLE, least(1::DOUBLE, (0.5::DOUBLE * ver + 0.2::DOUBLE * (1 - fail) + 0.2::DOUBLE * (1 - mismatch) + 0.1::DOUBLE * (1 - missing)) * quarter_weight)), 4) AS consistency_score
 FROM (SELECT r.*, round(greatest(1 - 0.25 * (row_number() OVER (PARTITION BY company ORDER BY quarter DESC) - 1), 0.1), 2)::DOUBLE AS quarter_weight FROM {SQL_RATES} r))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    third, s = F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")
    return o.select(
        F.col("c_mktsegment").alias(" Company "),
        Q.fiscal_quarter(F.col("o_orderdate")).alias("Quarter"),
        F.when(s == "F", "VERIFIED").when(s == "P", "NOT VERIFIED").when(~third, "PARTIAL").alias("RESULT"),
        F.when(s == "P", "CONTRADICTS_DIRECTION | EXACT_MATCH").when(s == "F", F.when(F.col("o_orderkey") % 5 == 0, "CONTRADICTS_OTHER").otherwise("VERIFIED_STRONG")).when(third, "MISSING_VALUE").otherwise("UNKNOWN_DIRECTION").alias("reason"),
    )


@query(SQL_RISK)
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3 to AGG-6, WIN-2, WIN-7, MTH-4, MTH-11, PRJ-4, PRJ-5"""
    return risk.aggregate_risk(_results(spark, sf_dir)).withColumn("quarter_weight", F.col("quarter_weight").cast("double"))


@query(f"SELECT quarter, round(greatest(1 - 0.25 * (row_number() OVER (ORDER BY quarter DESC) - 1), 0.1), 2)::DOUBLE AS quarter_weight FROM (SELECT DISTINCT {SQL_FQ.format(d='o_orderdate')} AS quarter FROM orders)")
def risk_weights_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2 over all companies together"""
    o = table(spark, sf_dir, "orders").select(Q.fiscal_quarter(F.col("o_orderdate")).alias("quarter"))
    return risk.quarter_weights(o, "global").withColumn("quarter_weight", F.col("quarter_weight").cast("double"))


@query(f"SELECT company, CASE WHEN warning_flag = 1 OR consistency_score < 0.4 THEN 'HIGH' WHEN consistency_score < 0.65 THEN 'MODERATE' ELSE 'LOW' END AS level, consistency_score, warning_flag FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY quarter DESC) AS rn FROM ({SQL_RISK})) WHERE rn = 1")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-10, WIN-8"""
    return payload.risk_from_table(risk_table(spark, sf_dir)).select("company", "risk.level", "risk.consistency_score", "risk.warning_flag")


@query(
    f"""SELECT company, CASE WHEN known = 0 THEN 'UNKNOWN' WHEN s > 0.6 THEN 'LOW' WHEN s > 0.3 THEN 'MODERATE' ELSE 'HIGH' END AS level, CASE WHEN known > 0 THEN s END AS consistency_score, CASE WHEN known > 0 AND s < 0.3 THEN 1 ELSE 0 END AS warning_flag FROM (SELECT company, count(direction) AS known, round_even(greatest(0::DOUBLE, least(1::DOUBLE,
 coalesce(count(*) FILTER (direction = 'increase') / nullif(count(direction), 0), 0) - 0.5 * coalesce(count(*) FILTER (direction = 'decrease') / nullif(count(direction), 0), 0) - 0.2 * (count(*) FILTER (direction IS NULL) / count(*)))), 2) AS s FROM (SELECT company, direction FROM {SQL_CLAIMS} UNION ALL SELECT 'silent', NULL FROM region) GROUP BY company)"""
)
def risk_claims_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7"""
    silent = table(spark, sf_dir, "region").select(F.lit("silent").alias("company"), F.lit(None).cast("string").alias("direction"))
    c = _claims(spark, sf_dir).select("company", "direction").unionByName(silent).withColumn("direction_missing", F.col("direction").isNull())
    return risk.risk_from_claims(c, ["company"])


# ---- text ---------------------------------------------------------------------------------------

def sql_strip(x: str) -> str:
    return f"trim({x}, '{V.SPACES}')"


def sql_clean(x: str) -> str:
    return sql_strip(rf"regexp_replace(regexp_replace({x}, '[\r\n\t]+', ' ', 'g'), '[{V.SPACE}]{{2,}}', ' ', 'g')")


def sql_sentences(text: str) -> str:
    """A relation of doc_id, pos and sentence, for an SQL expression over documents."""
    return rf"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS pos, sentence FROM (SELECT doc_id, raw_pos, {sql_clean("s")} AS sentence
 FROM (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS raw_pos FROM (SELECT doc_id, string_split(regexp_replace({text}, '([.!?])[{V.SPACE}]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents))) WHERE sentence <> '')"""


SQL_SENTENCES = sql_sentences("text")
SQL_VALID = rf"length(sentence) >= 20 AND NOT regexp_matches(sentence, '(?i)(^[\p{{Nd}}{V.SPACE}.,|\-%()$₹/:]+$|^[{V.SPACE}]*[A-Z{V.SPACE}]{{1,6}}[{V.SPACE}]*$|www\.|http|©|™|®)') AND len(regexp_extract_all(sentence, '[a-zA-Z]{{2,}}')) >= 3"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


#: Abbreviations, which the tables' own texts lack: some words written as such.
_SHORTENED = {" the ": " approx. ", " of ": " e.g. ", " der ": " bzw. ", " de ": " Mr. ", " by ": " Inc. "}
SQL_SHORTENED = "text"
for _w, _x in _SHORTENED.items():
    SQL_SHORTENED = f"replace({SQL_SHORTENED}, '{_w}', '{_x}')"
SQL_WORDS = rf"""(SELECT doc_id, i, t, lower(regexp_replace(t, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}.]+$', '', 'g')) AS w FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM
 (SELECT doc_id, list_filter(regexp_split_to_array({SQL_SHORTENED}, '[{V.SPACE}]+'), x -> x <> '') AS ts FROM documents)))"""
SQL_ABBREVIATIONS = rf"""(SELECT word, n_with, n_without, (n_with + n_without) / n_all AS share, CASE WHEN dots < n_all THEN -2 * (n_with * ln(dots / n_all / 0.99) + n_without * ln((1 - dots / n_all) / 0.01)) * exp(-(length(word) - inside)) * (inside + 1) * pow(length(word) - inside, -n_without) ELSE 0 END AS score FROM
 (SELECT *, length(word) - length(replace(word, '.', '')) AS inside, sum(n_with) OVER ()::DOUBLE AS dots, sum(n_with + n_without) OVER ()::DOUBLE AS n_all FROM
 (SELECT regexp_replace(w, '\.+$', '') AS word, count(*) FILTER (ends_with(w, '.')) AS n_with, count(*) FILTER (NOT ends_with(w, '.')) AS n_without FROM {SQL_WORDS} WHERE regexp_matches(w, '\p{{L}}') GROUP BY 1)) WHERE n_with > 0)"""
SQL_SHORT = f"(SELECT word FROM {SQL_ABBREVIATIONS} WHERE score >= 0.3 AND share >= 1 / 50000.0)"
SQL_STARTS = rf"""(WITH words AS MATERIALIZED (SELECT * FROM {SQL_WORDS}), short AS MATERIALIZED (SELECT * FROM {SQL_SHORT}),
 pairs AS (SELECT regexp_replace(w, '\.+$', '') AS word, regexp_matches(pt, '[.!?]$') AND NOT (ends_with(pw, '.') AND (length(pb) < 2 OR NOT regexp_matches(pb, '\p{{L}}') OR pb IN (SELECT word FROM short))) AS sure FROM (SELECT *, regexp_replace(pw, '\.+$', '') AS pb FROM (SELECT w, lag(t) OVER o AS pt, lag(w) OVER o AS pw FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i))) WHERE pt IS NOT NULL),
 counts AS (SELECT word, count(*) FILTER (sure)::DOUBLE AS a, count(*)::DOUBLE AS n, sum(count(*) FILTER (sure)) OVER ()::DOUBLE AS e, sum(count(*)) OVER ()::DOUBLE AS m FROM pairs GROUP BY word),
 ll AS (SELECT *, (n - a) AS b, m - e AS r, n / m AS p, a / e AS p1, (n - a) / (m - e) AS p2 FROM counts WHERE a > 0 AND regexp_matches(word, '\p{{L}}'))
 SELECT word, CAST(a AS BIGINT) AS n_start, CAST(n AS BIGINT) AS n, n / m AS share,
 2 * (a * ln(p1) + CASE WHEN e > a THEN (e - a) * ln(1 - p1) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(p2) ELSE 0 END + CASE WHEN r > b THEN (r - b) * ln(1 - p2) ELSE 0 END - (a * ln(p) + CASE WHEN e > a THEN (e - a) * ln(1 - p) ELSE 0 END) - (CASE WHEN b > 0 THEN b * ln(p) ELSE 0 END + CASE WHEN r > b THEN (r - b) * ln(1 - p) ELSE 0 END)) AS score FROM ll WHERE p1 > p2)"""


def _shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for w, x in _SHORTENED.items():
        text = F.replace(text, F.lit(w), F.lit(x))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"SELECT word, n_with, n_without, round(score, 6) + 0 AS score FROM {SQL_ABBREVIATIONS}")
def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5: how likely each word that bears a period is an abbreviation"""
    counts = sentence_model.word_counts(_shortened(spark, sf_dir))
    return sentence_model.abbreviation_scores(counts).select("word", "n_with", "n_without", F.round("score", 6).alias("score"))


@query(f"SELECT word, n_start, n, round(score, 6) AS score FROM {SQL_STARTS} WHERE score >= 30 AND share >= 1 / 50000.0")
def sentence_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5: words that start sentences"""
    found = sentence_model.scored_starters(_shortened(spark, sf_dir))[1]
    return found.select("word", "n_start", "n", F.round("score", 6).alias("score"))


@query(
    rf"""WITH short AS MATERIALIZED (SELECT list(word) AS ws FROM {SQL_SHORT}), starts AS MATERIALIZED (SELECT list(word) AS ws FROM {SQL_STARTS} WHERE score >= 30 AND share >= 1 / 50000.0),
 parts AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace({SQL_SHORTENED}, '([.!?])[{V.SPACE}]+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents)),
 marked AS (SELECT *, lower(regexp_replace(regexp_extract(before, '([^{V.SPACE}]+)$', 1), '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}.]+$', '', 'g')) AS w, regexp_extract(p, '^([^{V.SPACE}]+)', 1) AS f FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM parts)),
 judged AS (SELECT *, i > 1 AND ends_with(w, '.') AND (list_contains(short.ws, regexp_replace(w, '\.+$', '')) OR regexp_matches(regexp_replace(w, '\.+$', ''), '^\p{{L}}$'))
  AND NOT (regexp_matches(f, '^[^\p{{L}}\p{{Nd}}]*\p{{Lu}}') AND list_contains(starts.ws, regexp_replace(lower(regexp_replace(f, '^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}.]+$', '', 'g')), '\.+$', ''))) AS glued FROM marked, short, starts),
 numbered AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM judged)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS pos, sentence FROM (SELECT doc_id, g, {sql_clean("string_agg(p, ' ' ORDER BY i)")} AS sentence FROM numbered GROUP BY doc_id, g) WHERE sentence <> ''"""
)
def sentence_model_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5: sentences by the model learned from the same texts"""
    docs = _shortened(spark, sf_dir)
    found = docs.select("doc_id", F.posexplode(sentence_model.fit(docs).sentences(F.col("text"))).alias("pos", "sentence"))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


#: Line ends and white space of many kinds, which the tables' own texts lack.
_ODD_LINES = "\f 12 34 \f kept by form feed\u0085ab\u2028\u00a0\u2003xy\u00a0\u2029no-break\u00a0space \v(1.5)\u2003%\x1c \u0661\u0662\u0663 | 4\x1dlast line"


@query(rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text || '{_ODD_LINES}', '\r\n|\r', chr(10), 'g'), '{V.LINE_END}'), x -> length({sql_strip('x')}) > 3 AND NOT regexp_matches({sql_strip('x')}, '^[\p{{Nd}}{V.SPACE}.,|\-%()]+$')), chr(10)) AS cleaned FROM documents")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3"""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_lines(F.concat("text", F.lit(_ODD_LINES))).alias("cleaned"))


_ODD_SPACES = "replace(replace(text, ', ', chr(160) || ',' || chr(8195) || ' '), '. ', '.' || chr(12288) || chr(31))"


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, sentence, {SQL_VALID} AS valid, trim(regexp_replace(regexp_replace(lower(sentence), '[{V.SPACE}]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')) AS k FROM {sql_sentences(_ODD_SPACES)}")
def sentence_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-3, FLT-4: white space beyond ASCII"""
    text = F.replace(F.replace("text", F.lit(", "), F.lit("\u00a0,\u2003 ")), F.lit(". "), F.lit(".\u3000\x1f"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(text)).alias("pos", "sentence"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence", T.is_valid_sentence(F.col("sentence")).alias("valid"), T.dedup_key(F.col("sentence")).alias("k"))


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, sentence FROM {SQL_SENTENCES}")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-5, ARR-1, SVC-8"""
    return _sentences(spark, sf_dir).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {SQL_VALID} AS valid FROM {SQL_SENTENCES}")
def sentence_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4"""
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.is_valid_sentence(F.col("sentence")).alias("valid"))


@query(f"SELECT source, doc_id, CAST(pos AS BIGINT) AS pos, sentence FROM (SELECT d.source, s.*, row_number() OVER (PARTITION BY sentence ORDER BY s.doc_id, pos) AS rn FROM {SQL_SENTENCES} s JOIN documents d ON d.doc_id = s.doc_id WHERE {SQL_VALID}) WHERE rn = 1")
def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-2, PRJ-1"""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("raw_text"), F.lit(1.0).alias("weight"))
    return claims.explode_sentences(d, order=["doc_id"]).select("source", "doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS rn FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(sentence), '[{V.SPACE}]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g')) AS k FROM {SQL_SENTENCES})) WHERE rn = 1")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-3, STR-3"""
    return dedup.first_wins(_sentences(spark, sf_dir).withColumn("k", T.dedup_key(F.col("sentence"))), ["k"], [F.asc("doc_id"), F.asc("pos")]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "k")


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, list_filter(list_transform(regexp_split_to_array(sentence, '\b(and|the|but|while|however)\b'), x -> trim(x)), x -> length(x) > 20) AS parts FROM {SQL_SENTENCES}")
def contrast_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6, FLT-11"""
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.contrast_parts(F.col("sentence"), r"\b(and|the|but|while|however)\b").alias("parts"))


_CORPUS_METRICS = [*V.METRIC_KEYWORDS, ("thing", ["thing", "ering"]), ("le", ["elle", "eau"]), ("an", ["anan", "ent"])]
SQL_METRICS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({{0}}), '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in _CORPUS_METRICS) + "], x -> x IS NOT NULL)"


@query(f"SELECT sentence, metric, doc_id, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY sentence, metric ORDER BY doc_id, pos) AS rn FROM (SELECT doc_id, pos, sentence, unnest({SQL_METRICS.format('sentence')}) AS metric FROM {SQL_SENTENCES})) WHERE rn = 1")
def metric_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7, ARR-2, FLT-12, X-5"""
    each = _sentences(spark, sf_dir).select("*", F.explode(T.metrics(F.col("sentence"), _CORPUS_METRICS)).alias("metric"))
    return dedup.first_wins(each, ["sentence", "metric"], [F.asc("doc_id"), F.asc("pos")]).select("sentence", "metric", "doc_id", F.col("pos").cast("bigint").alias("pos"))


_ENDINGS = ["grew", "fell and declined", "was strong", "stayed flat", "did better", "came", "support held"]
SQL_ENDED = f"(SELECT doc_id, pos, sentence || ' margin ' || list_extract({_list(_ENDINGS)}, CAST((doc_id + pos) % 7 AS INTEGER) + 1) || ' ' || (doc_id % 90) || CASE WHEN pos % 3 = 0 THEN ' %' WHEN pos % 3 = 1 THEN '.5 crore' ELSE '' END AS s FROM {SQL_SENTENCES})"


def _ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*[F.lit(x) for x in _ENDINGS]), ((F.col("doc_id") + F.col("pos")) % 7).cast("int"))
    unit = F.when(F.col("pos") % 3 == 0, " %").when(F.col("pos") % 3 == 1, ".5 crore").otherwise("")
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat("sentence", F.lit(" margin "), end, F.lit(" "), (F.col("doc_id") % 90).cast("string"), unit).alias("s"))


@query(
    f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_matches(lower(s), '{V.DECREASE}') THEN 'decrease' WHEN regexp_matches(lower(s), '{V.INCREASE}') THEN 'increase' WHEN regexp_matches(lower(s), '{V.SOFT}') OR regexp_matches(lower(s), '{V.NEUTRAL}') THEN 'neutral'
 WHEN len(list_filter(range(1, len(w) + 1), i -> contains(w[i], 'margin') AND contains(array_to_string(w[greatest(1, i - 8):i + 7], ' '), 'better'))) > 0 THEN 'increase' END AS direction FROM (SELECT *, regexp_extract_all(lower(s), '[a-z]+') AS w FROM {SQL_ENDED})"""
)
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8, WIN-9, T7"""
    return _ended(spark, sf_dir).select("doc_id", "pos", T.direction(F.col("s"), F.lit("margin")).alias("direction"))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, nullif(regexp_extract(lower(s), '(\d+(\.\d+)?\s*(%|bps|basis points|crore|million|billion|lakh))', 1), '') AS magnitude FROM {SQL_ENDED}")
def magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4, STR-9, LIM-5"""
    return _ended(spark, sf_dir).select("doc_id", "pos", T.magnitude(F.lower("s")).alias("magnitude"))


@query(
    f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(len(list_filter({_list(V.PERFORMANCE_KEYWORDS)}, k -> contains(lower(s), k))) + len(list_filter({_list(V.DIRECTION_KEYWORDS)}, k -> len(list_filter(t, x -> starts_with(x, k))) > 0)) AS BIGINT) AS score FROM (SELECT *, list_distinct(regexp_extract_all(lower(s), '[a-z]+')) AS t FROM {SQL_ENDED})"""
)
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10"""
    return _ended(spark, sf_dir).select("doc_id", "pos", T.keyword_score(F.col("s")).alias("score"))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, regexp_matches(sentence, '(?i)\d+\.?\d*\s?[%m|bncrk₹$]') AS numeric_claim, length(sentence) < 40 OR contains(sentence, 'Page') OR contains(sentence, 'Classification') AS noise FROM {SQL_SENTENCES}")
def numeric_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, FLT-13"""
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), T.is_numeric_claim(F.col("sentence")).alias("numeric_claim"), T.is_noise(F.col("sentence")).alias("noise"))


SQL_OPENED = f"(SELECT doc_id, pos, CASE doc_id % 5 WHEN 0 THEN 'Thank you. ' WHEN 1 THEN 'Moving on ' WHEN 2 THEN 'not ' ELSE '' END || sentence || CASE WHEN pos % 6 = 0 THEN '?' ELSE '' END AS s FROM {SQL_SENTENCES})"


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    start = F.when(k == 0, "Thank you. ").when(k == 1, "Moving on ").when(k == 2, "not ").otherwise("")
    return _sentences(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.concat(start, "sentence", F.when(F.col("pos") % 6 == 0, "?").otherwise("")).alias("s"))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, ends_with(trim(s), '?') OR regexp_matches(trim(s), '{V.TRANSITION}') OR regexp_matches(trim(s), '{V.GARBAGE}') OR length(trim(s)) < 25 AS excluded FROM {SQL_OPENED}")
def hard_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5"""
    return _opened(spark, sf_dir).select("doc_id", "pos", T.hard_exclusion(F.col("s")).alias("excluded"))


@query(
    rf"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, {sql_strip(f"regexp_replace({sql_clean('s')}, '{V.ARTEFACT}', '', 'g')")} AS stripped
 FROM (SELECT doc_id, pos, sentence || CASE WHEN pos % 4 = 0 THEN '  Page ' || pos || ' of 99 tail' WHEN pos % 4 = 1 THEN ' republic of x' WHEN pos % 4 = 2 THEN ' Classification - Secret x' ELSE '' END AS s FROM {SQL_SENTENCES})"""
)
def artefact_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2, T11"""
    p = F.col("pos")
    end = F.when(p % 4 == 0, F.concat(F.lit("  Page "), p.cast("string"), F.lit(" of 99 tail"))).when(p % 4 == 1, " republic of x").when(p % 4 == 2, " Classification - Secret x").otherwise("")
    return _sentences(spark, sf_dir).select("doc_id", p.cast("bigint").alias("pos"), T.strip_artefacts(F.concat("sentence", end)).alias("stripped"))


def _sql_claim(rel: str) -> str:
    return f"""(SELECT *, CASE WHEN ends_with(trim(s), '?') OR regexp_matches(trim(s), '{V.TRANSITION}') OR regexp_matches(trim(s), '{V.GARBAGE}') OR length(trim(s)) < 25 OR negated THEN false
 WHEN list_contains({_list(V.SPEECH_VERBS)}, root) AND NOT entity THEN false WHEN list_contains({_list(V.BE_VERBS)}, root) THEN (nouns >= 1 AND entity) OR (subject AND adjectives >= 1)
 ELSE (subject AND list_contains({_list(V.VERBS)}, root)) OR (nouns >= 1 AND verbs >= 1) OR (nouns >= 1 AND entity) OR nouns + verbs + adjectives >= 4 OR (nouns >= 1 AND adjectives >= 1) END AS is_claim
 FROM (SELECT *, len(list_filter(w, x -> list_contains({_list(V.NOUNS)}, x))) AS nouns, len(list_filter(w, x -> list_contains({_list(V.VERBS)}, x))) AS verbs, len(list_filter(w, x -> list_contains({_list(V.ADJECTIVES)}, x))) AS adjectives,
 regexp_matches(s, '\\d|%|₹|\\$') AS entity, regexp_matches(lower(s), '{V.NEGATED.replace(chr(39), chr(39) * 2)}') AS negated, coalesce(w[verb], '') AS root, verb IS NOT NULL AND len(list_filter(w[1:verb - 1], x -> list_contains({_list(V.NOUNS)}, x))) > 0 AS subject
 FROM (SELECT *, list_min(list_filter(range(1, len(w) + 1), i -> list_contains({_list(V.VERBS + V.SPEECH_VERBS + V.BE_VERBS)}, w[i]))) AS verb FROM (SELECT *, regexp_extract_all(lower(s), '[a-z]+') AS w FROM {rel}))))"""


SQL_SPOKEN = f"(SELECT doc_id, pos, CASE doc_id % 6 WHEN 0 THEN 'Revenue ' WHEN 1 THEN 'We say ' WHEN 2 THEN 'Margins are stable and ' WHEN 3 THEN 'Profit is 12 ' WHEN 4 THEN 'It is not ' ELSE '' END || s AS s FROM {SQL_ENDED})"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    start = F.when(k == 0, "Revenue ").when(k == 1, "We say ").when(k == 2, "Margins are stable and ").when(k == 3, "Profit is 12 ").when(k == 4, "It is not ").otherwise("")
    return _ended(spark, sf_dir).withColumn("s", F.concat(start, "s"))


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, is_claim FROM {_sql_claim(SQL_SPOKEN)}")
def claim_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-1, CLS-2, CLS-3, AGG-9"""
    rows = _spoken(spark, sf_dir).withColumn("f", T.nlp_features(F.col("s")))
    return rows.select("doc_id", "pos", T.is_claim(F.col("s"), F.col("f")).alias("is_claim"))


@query(rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos FROM (SELECT *, len(list_filter({_list(V.PERFORMANCE_KEYWORDS)}, k -> contains(lower(trim(s)), k))) + len(list_filter({_list(V.DIRECTION_KEYWORDS)}, k -> len(list_filter(list_distinct(regexp_extract_all(lower(trim(s)), '[a-z]+')), x -> starts_with(x, k))) > 0)) AS score FROM {SQL_SPOKEN}) WHERE length(trim(s)) >= 25 AND NOT ends_with(trim(s), '?') AND NOT regexp_matches(trim(s), '{V.GARBAGE}') AND NOT regexp_matches(trim(s), '{V.TRANSITION_SHORT}') AND NOT regexp_matches(trim(s), '{V.NEGATION.replace(chr(39), chr(39) * 2)}') AND score >= 3")
def likely_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15"""
    return _spoken(spark, sf_dir).where(T.is_likely_claim(F.col("s"))).select("doc_id", "pos")


#: Documents whose sentences train the classifier, at most: those of least hash.
TRAIN_DOCS = 1000


@query()
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2, ML-3: a classifier that learns the rules' claims from the sentences of a bounded sample of documents, and its scores of
    all documents' sentences that are held out (the tests recompute scores in SQL from the stored weights)"""
    rows = _spoken(spark, sf_dir)
    judged = lambda df: df.withColumn("label", T.is_claim(F.col("s"), T.nlp_features(F.col("s"))).cast("int"))
    some = bounded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", TRAIN_DOCS)
    model = classifier.fit(judged(rows.join(F.broadcast(some), "doc_id", "left_semi")), "s")
    return judged(rows.where(classifier.fold(F.col("s")) == 0)).select("doc_id", "pos", "label", model.probability(F.col("s")).alias("score"))


@query()
def classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2: accuracy, precision, recall and F1 of classifier_scores"""
    return classifier.evaluate(classifier_scores(spark, sf_dir))


SQL_TERMS = r"(SELECT doc_id, CAST('0x' || substr(md5(w), 1, 7) AS INTEGER) % 8192 AS bucket FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS w FROM documents))"


@query(f"SELECT bucket, df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 9) AS idf FROM (SELECT bucket, count(DISTINCT doc_id) AS df FROM {SQL_TERMS} GROUP BY bucket)")
def term_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-7: in how many documents each bucket of words occurs, and its weight"""
    d = table(spark, sf_dir, "documents")
    return embedder.text_counts(d).select("bucket", "df", F.round(embedder.inverse_frequency(F.col("df"), d.count()), 9).alias("idf"))


@query()
def learned_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-7: the embedder trained on all documents, and their vectors (the tests recompute vectors in SQL from the stored weights)"""
    held = cut(embedder.bags(table(spark, sf_dir, "documents"), keep=("doc_id",)), "terms")  # stays, as the result reads it
    return embedder.fit_bags(held).embed_bags(held)


@query()
def model_claim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2, ML-3, FLT-9, FLT-10, X-4, MTH-12, with the lexical stand-in; held against brute force in the tests."""
    rows = _spoken(spark, sf_dir).select(F.lit("all").alias("company"), (F.col("doc_id") % 8).cast("string").alias("quarter"), F.col("s").alias("sentence"), "doc_id", "pos")
    return model_claims(rows, order=["doc_id", "pos"])


# ---- sets, samples, tables ----------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def antijoin_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7, JN-12"""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return dedup.anti_remainder(d, b, F.col("doc_id"), b["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels) WHERE rn <= (SELECT least(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) FROM labels)")
def balanced_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-1, SET-1, SET-2"""
    b = table(spark, sf_dir, "labels")
    return dataset.balanced(b.where("quality = 1"), b.where("quality = 0"), "doc_id").select("doc_id", "quality")


@query(
    "SELECT sentence, label FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY o, doc_id) AS rn FROM (SELECT text AS sentence, CASE WHEN quality = 1 THEN 'CLAIM' ELSE 'NON_CLAIM' END AS label, 1 - quality AS o, d.doc_id FROM documents d JOIN labels USING (doc_id))) WHERE rn = 1"
)
def merged_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6, X-7, SMP-2"""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("text").alias("sentence"), "quality")
    return dataset.merge_labelled(d.where("quality = 1"), d.where("quality = 0"), "doc_id")


SQL_SCORED = rf"(SELECT doc_id, pos, s, regexp_matches(s, '(?i)\d+\.?\d*\s?[%m|bncrk₹$]') AS cand, pos % 3 AS label, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.8 END AS conf FROM {SQL_ENDED})"


@query(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, cand AND label <> 2 AND conf > 0.85 AS verified FROM {SQL_SCORED}")
def scored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, ML-4, ML-5, SET-3"""
    score = F.struct((F.col("pos") % 3).cast("int").alias("label"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.8).alias("confidence"))
    good, rest = dataset.split_by_score(_ended(spark, sf_dir).withColumnRenamed("s", "sentence"), score)
    return good.select("doc_id", "pos", F.lit(True).alias("verified")).unionByName(rest.select("doc_id", "pos", F.lit(False).alias("verified")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4, SNK-6, SNK-7, X-9"""
    return dedup.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(
    """WITH old AS (SELECT n_nationkey + 1 AS id, n_name AS folder_name FROM nation), new AS (SELECT event_id AS seq, CASE WHEN user_id % 3 = 0 THEN n_name ELSE 'user ' || user_id || ' 2024 Quarterly Data' END AS folder_name, CASE WHEN event_type = 'purchase' THEN 'ready' ELSE 'error' END AS status FROM events JOIN nation ON n_nationkey = user_id % 25),
 fresh AS (SELECT folder_name, row_number() OVER (ORDER BY min(seq), folder_name) + (SELECT max(id) FROM old) AS id FROM new WHERE folder_name NOT IN (SELECT folder_name FROM old) GROUP BY folder_name)
 SELECT CAST(i.id AS BIGINT) AS id, i.folder_name, trim(regexp_replace(i.folder_name, '(?i)\\s*(\\d{4}\\s*)?Quarterly\\s*Data\\s*', '', 'g')) AS display_name, coalesce(l.status, 'pending') AS status FROM (SELECT id, folder_name FROM old UNION ALL SELECT id, folder_name FROM fresh) i LEFT JOIN (SELECT folder_name, arg_max(status, seq) AS status FROM new GROUP BY folder_name) l USING (folder_name)"""
)
def upsert_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, STR-14"""
    n = table(spark, sf_dir, "nation")
    null = lambda t: F.lit(None).cast(t)
    old = n.select((F.col("n_nationkey") + 1).cast("bigint").alias("id"), F.col("n_name").alias("folder_name"), F.col("n_name").alias("display_name"), F.lit("pending").alias("status"), null("timestamp").alias("processed_at"), null("string").alias("error_msg"), F.lit(-1).cast("bigint").alias("seq"))
    e = table(spark, sf_dir, "events").join(F.broadcast(n), F.col("n_nationkey") == F.col("user_id") % 25)
    new = e.select(F.when(F.col("user_id") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" 2024 Quarterly Data"))).alias("folder_name"), F.when(F.col("event_type") == "purchase", "ready").otherwise("error").alias("status"), null("string").alias("error_msg"), F.col("event_id").alias("seq"))
    return upsert_companies(old, new).select("id", "folder_name", "display_name", "status")


@query("SELECT o_orderkey, tier FROM (SELECT *, min(tier) OVER (PARTITION BY o_custkey) AS best FROM (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS tier FROM orders)) WHERE tier = best")
def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5, T23"""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tiers = [o.where(F.col("o_orderstatus") == s).withColumn("tier", F.lit(i)) for i, s in enumerate(["P", "F", "O"])]
    return dedup.first_nonempty(tiers, ["o_custkey"]).select("o_orderkey", "tier")


@query("SELECT id, c_name AS folder_name, c_name AS display_name, 'ready' AS status FROM (SELECT c_name, c_mktsegment, row_number() OVER (ORDER BY c_custkey, c_name) AS id FROM customer) WHERE c_mktsegment = 'BUILDING'")
def ready_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-11, SRT-4, SVC-5: written to a store and listed from it."""
    store = Store(spark, f"{shared_dir(spark)}/veritape/listing-{uuid.uuid4().hex}")
    store.create()
    status = F.when(F.col("c_mktsegment") == "BUILDING", "ready").otherwise("pending")
    store.upsert_companies(table(spark, sf_dir, "customer").select(F.col("c_name").alias("folder_name"), status.alias("status"), F.lit(None).cast("string").alias("error_msg"), F.col("c_custkey").cast("long").alias("seq")))
    return store.companies(ready=True).select("id", "folder_name", "display_name", "status")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/veritape/store-{uuid.uuid4().hex}")


@query(f"SELECT 1 AS version, CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS folder_name, 'pending' AS status FROM nation UNION ALL SELECT 2 AS version, id, folder_name, status FROM ({ORACLES['upsert_company']})")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-3: two commits; the first version is read again after the second, which holds only what it changed"""
    store, nothing = _store(spark), F.lit(None).cast("string").alias("error_msg")
    n = table(spark, sf_dir, "nation")
    store.upsert_companies(n.select(F.col("n_name").alias("folder_name"), F.lit("pending").alias("status"), nothing, (F.col("n_nationkey") - 1000).cast("long").alias("seq")))
    e = table(spark, sf_dir, "events").join(F.broadcast(n), F.col("n_nationkey") == F.col("user_id") % 25)
    folder = F.when(F.col("user_id") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" 2024 Quarterly Data")))
    store.upsert_companies(e.select(folder.alias("folder_name"), F.when(F.col("event_type") == "purchase", "ready").otherwise("error").alias("status"), nothing, F.col("event_id").alias("seq")))
    seen = [store.at(v).read("companies").select(F.lit(v).alias("version"), "id", "folder_name", "status") for v in store.versions()]
    return seen[0].unionByName(seen[1])


@query("SELECT user_id AS company_id, event_type AS quarter, value AS confidence FROM events WHERE user_id % 5 <> 0 AND (user_id % 3 <> 0 OR event_type = 'purchase')")
def store_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: rows by company, replaced for some of them and removed for others, each in a part of its own"""
    store = _store(spark)
    e = table(spark, sf_dir, "events").withColumn("row", F.struct(F.col("user_id").alias("company_id"), F.col("event_type").alias("quarter"), F.col("value").alias("confidence")))
    rows = lambda df: spark.createDataFrame([], TABLES["claims"][0]).unionByName(df.select("row.*"), allowMissingColumns=True)
    store.replace_company_rows("claims", rows(e))
    thirds, fifths = e.where("user_id % 3 = 0"), e.where("user_id % 5 = 0")
    store.replace_company_rows("claims", rows(thirds.where("event_type = 'purchase'")), companies=thirds.select("row.company_id").distinct())
    store.replace_company_rows("claims", rows(fifths.where("false")), companies=fifths.select("row.company_id").distinct())
    return store.read("claims").select("company_id", "quarter", "confidence")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n FROM orders")
def dense_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: numbers of new rows in order, by ranges and their sizes"""
    return dense_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "n").select("o_orderkey", "n")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'ation_1')")
def match_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, FLT-2: no exact name, so the substring tier."""
    return claims.match_company(table(spark, sf_dir, "nation"), "none of these", "ation_1", "n_name").select("n_nationkey", "n_name")


@query("SELECT n_name, 2 AS tier FROM (SELECT n_name FROM nation WHERE contains(lower(n_name), 'ion_1') ORDER BY n_name LIMIT 1) UNION ALL SELECT n_name, 1 AS tier FROM nation WHERE lower(n_name) = 'nation_7' UNION ALL SELECT n_name, 2 AS tier FROM (SELECT n_name FROM nation WHERE contains(lower(n_name), 'tion_2') ORDER BY n_name LIMIT 1)")
def fuzzy_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, JN-11, STR-23: names that may or may not be there, in the first two tiers."""
    n = table(spark, sf_dir, "nation")
    found = [fuzzy.lookup(n, ["n_name"], "n_name", q, cutoff=2.0) for q in ("ion_1", "Nation_7", "tion_2")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("n_name", "tier")


@query()
def fuzzy_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24, JN-10's third tier (Ratcliff-Obershelp has no SQL); the tests compare it with the library's own matching."""
    return fuzzy.lookup(table(spark, sf_dir, "nation"), ["n_name"], "n_name", "natoin-7").select("n_name", "tier", F.round("score", 6).alias("score"))


# ---- retrieval ----------------------------------------------------------------------------------

SQL_DIST = "round(list_sum(list_transform(range(1, 65), i -> (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)), 6)"
SQL_V = "(SELECT v.vec_id, v.label, {d} AS distance, d.text AS document FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q JOIN documents d ON d.doc_id = v.vec_id {w})"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query(f"SELECT v.vec_id, {SQL_DIST} AS distance FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2, 1 LIMIT 12")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-13, LIM-4, SRC-15"""
    return _rounded(retrieval.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 12, id_col="vec_id")).select("vec_id", "distance")


@query(f"SELECT v.vec_id, {SQL_DIST} AS distance FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label = 3 ORDER BY 2, 1 LIMIT 12")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16"""
    return _rounded(retrieval.top_k(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 12, F.col("label") == 3, "vec_id")).select("vec_id", "distance")


def _vector_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    k = F.col("vec_id") % 3
    return v.join(d, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", F.col("text").alias("document"), F.when(k == 0, "VERIFIED").when(k == 1, "NOT VERIFIED").otherwise("PARTIAL").alias("result"), F.when(k == 0, "VERIFIED_STRONG | EXACT_MATCH").when(k == 1, "CONTRADICTS_DIRECTION | EXACT_MATCH").otherwise("PARTIAL_NO_CHANGE").alias("reason"))


def _sql_near(n: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY distance, vec_id) AS rn FROM (SELECT * FROM {SQL_V.format(d=SQL_DIST, w='')} ORDER BY distance, vec_id LIMIT {n})) WHERE rn = 1 AND NOT (length(document) < 40 OR contains(document, 'Page') OR contains(document, 'Classification')))"


@query(f"SELECT vec_id, distance FROM {_sql_near(12)} ORDER BY distance, vec_id LIMIT 6")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-8, LIM-2, X-6, FLT-6"""
    return _rounded(retrieval.retrieve_context(_vector_docs(spark, sf_dir), _first_vector(spark, sf_dir), 6, id_col="vec_id")).select("vec_id", "distance")


@query(f"SELECT vec_id, signal, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY distance, vec_id) AS rank FROM (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'weak' END AS signal FROM {_sql_near(32)})) WHERE rank <= 8")
def signal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-3, CLS-4"""
    return retrieval.signal_top_k(_vector_docs(spark, sf_dir), _first_vector(spark, sf_dir), 8, id_col="vec_id").select("vec_id", "signal", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT query_id, vec_id, rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {SQL_DIST} AS distance FROM embeddings v CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 5")
def retrieval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-12: every vector whose id 100 divides, against all"""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _rounded(retrieval.batch_top_k(v, q, 5, "vec_id")).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "distance")


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return VectorIndex.build(table(spark, sf_dir, "embeddings"), temporary_path(shared_dir(spark)), "vec_id", sort=("label",))


def _every_hundredth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(ORACLES["vector_topk"])
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, LIM-4: the rows of vector_topk, from an index over the whole table that reads only the cells that can hold them"""
    return _rounded(_index(spark, sf_dir).top_k(_first_vector(spark, sf_dir), 12)).select("vec_id", "distance")


@query(ORACLES["vector_topk_filtered"])
def vector_topk_filtered_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16 over the index"""
    return _rounded(_index(spark, sf_dir).top_k(_first_vector(spark, sf_dir), 12, F.col("label") == 3)).select("vec_id", "distance")


@query(ORACLES["retrieval_batch"])
def retrieval_batch_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-12 over the index, after a third of the rows was appended to it"""
    v = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(v.where("vec_id % 3 <> 1"), temporary_path(shared_dir(spark)), "vec_id").append(v.where("vec_id % 3 = 1"))
    found = _rounded(index.batch_top_k(_every_hundredth(spark, sf_dir), 5))
    return found.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "distance")


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-2: the share of the ten nearest rows that a probed search finds, for every vector whose id 100 divides (k-means has no SQL)"""
    index = VectorIndex.build(table(spark, sf_dir, "embeddings"), temporary_path(shared_dir(spark)), "vec_id", recall=0.95)
    queries = _every_hundredth(spark, sf_dir)
    return recall(index.batch_top_k(queries, 10, probes=index.probes()), index.batch_top_k(queries, 10).select("query_id", "vec_id"), "vec_id")


@query(r"""SELECT c_name || '_' || i AS id, document, 'CONTEXT' AS result, 'TRANSCRIPT_EXCERPT' AS reason FROM (SELECT replace(substr(c, 1, 30), ' ', '_') AS c_name, row_number() OVER (PARTITION BY c ORDER BY conv_id, turn) - 1 AS i, text AS document FROM (SELECT *, 'Company ' || role AS c FROM conversations)) WHERE trim(document) <> '' AND c_name <> 'Company_user'""")
def vector_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8, PRJ-2, MAP-1: companies that are there already are left out"""
    k = table(spark, sf_dir, "conversations").withColumn("company", F.concat(F.lit("Company "), "role")).withColumnRenamed("text", "sentence")
    old = spark.range(1).select(F.create_map(F.lit("company"), F.lit("Company user")).alias("metadata"))
    return vector_rows(k, F.lit(None), ["conv_id", "turn"], old).select("id", "document", F.col("metadata")["result"].alias("result"), F.col("metadata")["reason"].alias("reason"))


# ---- payload ------------------------------------------------------------------------------------


@query(
    f"""SELECT company, quarter, label, value, trend FROM (SELECT company, quarter, unnest([{", ".join(f"struct_pack(label := '{lab} · ' || quarter, value := CASE WHEN {c} IS NULL THEN NULL ELSE format('{{:,.1f}}', {c}) || ' {u}' END, trend := CASE WHEN {c}_qoq_change > 1 THEN 'up' WHEN {c}_qoq_change < -1 THEN 'down' ELSE 'flat' END)" for lab, c, u in payload.TILES)}], recursive := true)
 FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY quarter DESC) AS rn FROM {sql_features("o_custkey")}) WHERE rn = 1) WHERE value IS NOT NULL"""
)
def latest_metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8, ARR-3, MTH-5, MTH-6"""
    rows = payload.metric_tiles(timeseries.latest(ts_features_sparse(spark, sf_dir), ["company"]))
    return rows.select("company", "quarter", F.explode("metrics").alias("m")).select("company", "quarter", "m.label", "m.value", "m.trend")


@query(
    f"""SELECT company, label, target_pct, color FROM (SELECT company, unnest([{", ".join(f"struct_pack(label := '{lab} QoQ %', target_pct := CASE WHEN {c}_qoq_change IS NULL THEN NULL ELSE CAST(least(trunc(abs({c}_qoq_change) * 2), 100) AS INTEGER) END, color := CASE WHEN {c}_qoq_change > 1 THEN 'var(--accent-green)' WHEN {c}_qoq_change < -1 THEN 'var(--accent-red)' ELSE 'var(--accent-blue)' END)" for lab, c, _ in payload.TILES)}], recursive := true)
 FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY quarter DESC) AS rn FROM {sql_features("o_custkey")}) WHERE rn = 1) WHERE target_pct IS NOT NULL"""
)
def bar_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-4, MTH-9"""
    rows = payload.bar_tiles(timeseries.latest(ts_features_sparse(spark, sf_dir), ["company"]))
    return rows.select("company", F.explode("bar_metrics").alias("m")).select("company", "m.label", "m.target_pct", "m.color")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '2' AS extra FROM events")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1, JSN-2, JSN-3, JN-13, SRC-12, SRC-14"""
    e = table(spark, sf_dir, "events").withColumn("j", payload.overlay_json(F.col("props"), F.lit('{"extra": 2}')))
    m = F.from_json("j", "map<string,string>")
    return e.select("event_id", m["k"].cast("bigint").alias("k"), m["extra"].alias("extra"))


SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), x -> x <> '')"


@query(rf"SELECT conv_id, turn, regexp_replace(array_to_string(w[1:8], ' '), '[,.;]+$', '') || CASE WHEN len(w) > 8 THEN '…' ELSE '' END AS title FROM (SELECT conv_id, turn, {SQL_WORDS.format('text')} AS w FROM conversations)")
def signal_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, LIM-6"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.signal_title(F.col("text")).alias("title"))


@query("SELECT conv_id, CASE WHEN p > 1.5 * n THEN 'Positive' WHEN n > 1.5 * p THEN 'Negative' ELSE 'Mixed' END AS verdict FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS p, count(*) FILTER (role <> 'user') AS n FROM conversations GROUP BY conv_id)")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11"""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("p"), F.count_if(F.col("role") != "user").alias("n"))
    return g.select("conv_id", N.verdict_label(F.col("p"), F.col("n")).alias("verdict"))


@query(f"SELECT company, array_to_string(list_sort(list_distinct(list(quarter))), ', ') AS source_label FROM {sql_normalise(SQL_CLAIMS, 'quarter')} GROUP BY company")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8"""
    return payload.source_label(_claims(spark, sf_dir))


@query(
    f"""SELECT company, CAST(rn AS INTEGER) AS rank, quarter, substr(sentence, 1, 140) AS sentence, metric, coalesce(direction, 'neutral') AS direction, coalesce(result, 'UNVERIFIED') AS result, coalesce(actual_change, 0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY event_id) AS rn FROM (SELECT event_id, company, metric, direction, sentence, actual_change, result, quarter FROM {sql_normalise("(" + _sql_verified() + ")", "quarter")})) WHERE rn <= 20"""
)
def head20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM-1, PRJ-3, T14: quarters shift once more for display"""
    return payload.display_claims(verify_claims(spark, sf_dir), ["event_id"])


@query(
    r"""SELECT conv_id, turn, coalesce(nullif(trim(substr(list_filter(l, x -> starts_with(x, 'SUMMARY:'))[-1], 9)), ''), trim(a)) AS explanation, CAST(len(list_filter(l, x -> starts_with(x, 'POS:'))) AS INTEGER) AS n_pos, trim(substr(list_filter(l, x -> starts_with(x, 'NEG:'))[1], 5)) AS neg
 FROM (SELECT *, list_transform(string_split(trim(a), chr(10)), x -> trim(x)) AS l FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'SUMMARY: ' || t || chr(10) ELSE 'no format' || chr(10) END || ' POS: one' || chr(10) || 'POS: two' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'NEG: ' || turn ELSE '' END AS a FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations)))"""
)
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-19, ML-9"""
    k = table(spark, sf_dir, "conversations")
    t = F.regexp_replace("text", r"\s+", " ")
    a = F.concat(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("SUMMARY: "), t, F.lit("\n"))).otherwise("no format\n"), F.lit(" POS: one\nPOS: two\n"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("NEG: "), F.col("turn").cast("string"))).otherwise(""))
    p = T.parse_answer(a)
    return k.select("conv_id", "turn", p.explanation.alias("explanation"), F.size(p.positive).alias("n_pos"), F.get(p.negative, 0).alias("neg"))


@query("SELECT conv_id, '- ' || array_to_string(list(text ORDER BY turn, text), chr(10) || '- ') AS context FROM conversations GROUP BY conv_id")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20"""
    k = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return k.select("conv_id", T.context_lines(F.transform("t", lambda x: x.text)).alias("context"))


@query("SELECT event_id, round(exp(a - m) / (exp(a - m) + exp(b - m)), 9) AS p FROM (SELECT event_id, a, b, greatest(a, b) AS m FROM (SELECT event_id, (event_id % 7)::DOUBLE AS a, (event_id % 5)::DOUBLE AS b FROM events))")
def softmax_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-12"""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(probability(F.array((F.col("event_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double")), 0), 9).alias("p"))

