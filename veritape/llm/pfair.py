"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are put in blocks of ``block_rows``. With shares a_i of a period M = sum a_i,
block j (from 1) of source i is released at slot floor((j-1) M / a_i) and due by slot
ceil(j M / a_i). Earliest deadline first among the released blocks, ties to the smaller source
name, gives every block a slot in its window; so after any number of slots a source that still has
blocks is less than one block from its weight's due. The schedule repeats each M slots, so one
period is computed, in SQL, and joined: block j takes slot ((j-1) div a_i) M + that of block
((j-1) mod a_i) + 1. A source that has run out leaves its slots empty; no row is dropped or
repeated.

Weights are any positive numbers. They become whole shares: exactly where a period of
``max_period`` slots can hold them (0.137 is 137 of 1000), else in parts of ``max_period``, each
source with one at least. Beyond ``max_sources`` sources, those of the least weights share one entry of the
schedule with their weights' sum and take turns in it, a block each; within it their weights count
as equal.

A source's rows are numbered in the order of the MD5 of their id, which shuffles them the same way
in every run. Numbers come from counts per (source, first 12 bits of the MD5), so even a source
with a third of all rows is ranked in 4,096 parts; only the counts are gathered per source.

The schedule holds at most ``max_period`` slots and is broadcast; the table of sources is broadcast if
it is small. A null source is a source of its own. Null ids count as empty text for the order. Rows
that repeat an id follow one another, in the order of their hashes. Input columns may have any name;
those of the results replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritape.session import cut

BLOCK_ROWS = 16
DEFAULT_SHARE = 1
SHARES = {"src0": 6, "src1": 3, "src2": 2}
MAX_SOURCES = 1024
MAX_PERIOD = 4096
BROADCAST_ROWS = 100_000
RESULTS = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_order")


def whole_shares(weights: list[float], max_period: int = MAX_PERIOD) -> list[int]:
    """Whole shares in proportion to the weights, with a sum of at most ``max_period``."""
    exact = [Fraction(str(w)) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("each weight is above 0")
    if len(exact) > max_period:
        raise ValueError(f"{len(exact)} entries need a period of as many slots")
    if not exact:
        return []
    scale = lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    if sum(whole) <= max_period:
        return whole
    due = [w * max_period / sum(exact) for w in exact]
    out = [max(1, int(d)) for d in due]
    for i in sorted(range(len(due)), key=lambda i: (out[i] - due[i], i))[: max(0, max_period - sum(out))]:
        out[i] += 1  # the largest rests
    while sum(out) > max_period:  # what the least sources took beyond their due
        out[max((i for i in range(len(out)) if out[i] > 1), key=lambda i: (out[i] - due[i], out[i]))] -= 1
    return out


def shares_of(df: DataFrame, source_col: str = "source", shares: dict[str, float] | None = None, default: float = DEFAULT_SHARE, max_sources: int = MAX_SOURCES, max_period: int = MAX_PERIOD) -> DataFrame:
    """(source, entry, place, places, share) of the sources in ``df``: its entry in the schedule, its turn among the sources of
    that entry, of which there are so many, and the entry's share. ``shares`` are weights of named sources."""
    named = F.create_map(*[F.lit(x) for name, weight in (shares or {"": default}).items() for x in (name, float(weight))])
    sources = df.select(F.col(f"`{source_col}`").cast("string").alias("source")).groupBy("source").agg(F.count("*").alias("n_rows"))
    found = cut(sources.select("source", F.coalesce(named[F.col("source")], F.lit(float(default))).alias("weight"), F.coalesce("source", F.lit("")).alias("name")), "sources")
    head = found.orderBy(F.desc("weight"), "name", F.col("source").isNull()).limit(max_sources + 1).collect()
    if len(head) <= max_sources:
        rest, names = None, [(r.source, r.name, r.weight) for r in head]
    else:  # the last entry is for all others
        names = [(r.source, r.name, r.weight) for r in head[: max_sources - 1]]
        own = head[: max_sources - 1]
        known = F.array(*[F.lit(r.source) for r in own if r.source is not None]).cast("array<string>")
        is_own = F.coalesce(F.array_contains(known, F.col("source")), F.lit(any(r.source is None for r in own)))
        rest = cut(found.where(~is_own), "sources")
        names.append((None, None, rest.agg(F.sum("weight")).first()[0]))
    names.sort(key=lambda x: (x[1] is None, x[1] or "", x[0] is not None))
    given = whole_shares([w for *_, w in names], max_period)
    rows = [(source, i, 0, 1, share) for i, ((source, name, _), share) in enumerate(zip(names, given, strict=True)) if name is not None]
    out = df.sparkSession.createDataFrame(rows, "source string, entry int, place long, places long, share long")
    if rest is not None:
        part = F.substring(F.md5("name"), 1, 3)  # ranked in parts, like the rows
        counts = rest.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
        before = counts.withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4,096 rows at most
        placed = rest.withColumn("p", part).withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("name", "source"))).join(F.broadcast(before.select("p", "b")), "p")
        places = rest.count()
        out = out.unionAll(placed.select("source", F.lit(len(names) - 1), (F.col("b") + F.col("r") - 1).cast("long"), F.lit(places).cast("long"), F.lit(given[-1]).cast("long")))
    return out


def schedule(shares: DataFrame) -> DataFrame:
    """One period: (entry, share, period, turn, slot, release, deadline), turns from 1 to the share."""
    one = shares.select("entry", "share").distinct().groupBy().agg(F.array_sort(F.collect_list(F.struct("entry", "share"))).alias("s")).where("size(s) > 0")
    one = one.withColumn("m", F.expr("cast(aggregate(s, 0L, (t, x) -> t + x.share) as int)"))
    due = "((n[i] + 1) * m + s[i].share - 1) div s[i].share"
    pick = f"array_min(transform(filter(sequence(0, size(s) - 1), i -> n[i] < s[i].share and (n[i] * m) div s[i].share <= t), i -> named_struct('due', cast({due} as int), 'i', i)))"
    step = f"transform(array(acc.n), n -> transform(array({pick}), p -> named_struct('n', transform(n, (x, i) -> if(i = p.i, x + 1, x)), 'out', concat(acc.out, array(named_struct('i', p.i, 'turn', n[p.i] + 1))))))[0][0]"
    start = "named_struct('n', transform(s, x -> 0), 'out', cast(array() as array<struct<i: int, turn: int>>))"
    rows = one.select("s", "m", F.expr(f"aggregate(sequence(0, m - 1), {start}, (acc, t) -> {step}).out").alias("o"))
    each = rows.select("s", "m", F.posexplode("o").alias("slot", "x"))
    return each.selectExpr("s[x.i].entry entry", "cast(s[x.i].share as long) share", "cast(m as long) period", "cast(x.turn as long) turn", "cast(slot as long) slot").selectExpr("*", "(turn - 1) * period div share release", "(turn * period + share - 1) div share deadline")


def ranked(rows: DataFrame) -> DataFrame:
    """(row, id, source) rows with ``rank``: from 0, the row's number within its source."""
    # plain keys in place of a null-safe join: numbering and joining then share one exchange, so rows move once
    rows = rows.withColumn("md5", F.md5(F.coalesce("id", F.lit("")))).withColumn("part", F.conv(F.substring("md5", 1, 3), 16, 10).cast("int")).withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    keys = ["key", "none", "part"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = counts.select(*keys, F.coalesce(F.sum("n").over(Window.partitionBy("key", "none").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("md5", "tie")))
    return numbered.join(before, keys).select("row", "source", (F.col("before") + F.col("rn") - 1).alias("rank"))


def mix(df: DataFrame, shares: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with mix_block, mix_slot, mix_release, mix_deadline and mix_order, by which the mixture is read."""
    kept = [c for c in df.columns if c not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = ranked(df.select(row.alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in kept]).alias("tie")))
    few = shares.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = shares.withColumnRenamed("source", "s")
    rows = rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.expr(f"rank div {block_rows}"))
    # the block's number in its entry gives its round and its turn there
    rows = rows.withColumn("b", F.expr("block * places + place")).withColumn("round", F.expr("b div share")).withColumn("turn", F.expr("b % share + 1")).drop("share")
    out = rows.join(F.broadcast(schedule(shares)), ["entry", "turn"])
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("block").alias("mix_block"),
        F.expr("round * period + slot").alias("mix_slot"),
        F.expr("round * period + release").alias("mix_release"),
        F.expr("round * period + deadline").alias("mix_deadline"),
        F.expr(f"(round * period + slot) * {block_rows} + rank % {block_rows}").alias("mix_order"),
    )


def edf_slots(shares: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(source, turn, slot) of one period, computed plainly: what the tests hold the plan against."""
    period, done, out = sum(a for _, a in shares), dict.fromkeys((s for s, _ in shares), 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // a), s) for s, a in sorted(shares) if done[s] < a and done[s] * period // a <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append((s, done[s], t))
    return out


def oracle(shares: dict[str, int], default: int = DEFAULT_SHARE, block_rows: int = BLOCK_ROWS) -> str:
    """The mixture in DuckDB SQL, for whole shares that a period holds; sources are those of the table, null among them."""
    given = " ".join(f"WHEN '{s}' THEN {a}" for s, a in shares.items())
    return f"""
WITH RECURSIVE sources AS (
  SELECT source, coalesce(source, '') AS name, CAST(CASE source {given} ELSE {default} END AS BIGINT) AS share FROM (SELECT DISTINCT source FROM documents)
),
given AS (SELECT list(share ORDER BY name, source IS NOT NULL) AS s, CAST(sum(share) AS BIGINT) AS m FROM sources),
numbered AS (SELECT *, row_number() OVER (ORDER BY name, source IS NOT NULL) AS entry FROM sources),
run(t, n, i) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(s, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM given
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(n) + 1), lambda j: n[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p
  FROM (
    SELECT t, n, list_min(list_transform(list_filter(range(1, len(s) + 1), lambda j: n[j] < s[j] AND (n[j] * m) // s[j] <= t + 1),
      lambda j: {{'due': ((n[j] + 1) * m + s[j] - 1) // s[j], 'j': j}})).j AS p
    FROM run, given WHERE t + 1 < m
  )
),
plan AS (SELECT source, share, n[i] AS turn, t AS slot FROM run JOIN numbered ON i = entry),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS rk FROM documents),
blocks AS (SELECT doc_id, source, rk, rk // {block_rows} AS b FROM ranked)
SELECT doc_id, blocks.source, CAST(b AS BIGINT) AS mix_block,
  CAST((b // share) * m + slot AS BIGINT) AS mix_slot,
  CAST((b // share) * m + ((turn - 1) * m) // share AS BIGINT) AS mix_release,
  CAST((b // share) * m + (turn * m + share - 1) // share AS BIGINT) AS mix_deadline,
  CAST(((b // share) * m + slot) * {block_rows} + rk % {block_rows} AS BIGINT) AS mix_order
FROM blocks JOIN plan ON blocks.source IS NOT DISTINCT FROM plan.source AND b % share + 1 = turn, given
"""
