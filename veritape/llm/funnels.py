"""Ordered funnel counting by a forward sweep.

A funnel is an ordered list of kinds and a kind that excludes. Each row of the first kind starts an
attempt; the next step is the client's earliest row of its kind that is later than the previous
step. It is reached unless that takes longer than ``within``, or an excluded row lies after the
previous step and not after the next.

One sweep over a client's rows in order of time counts all attempts of all funnels at once. Attempts
wait in a deque for each step, as pairs of the time of their last step and their number. A row of the
step's kind moves the whole deque on, where it becomes one pair, since all now share their last time;
a row of the excluded kind clears the deques, and pairs that wait too long leave at the old end. So
the state is what waits within ``within``, and the work is linear in the rows.

An attempt lasts at most (steps - 1) * ``within``. Clients are therefore cut into windows of time:
an attempt belongs to the window of its start, and a window also sees the rows of that span after its
end, which start nothing there. Windows of one client are swept in any order and on any executor, so
a client with a third of all rows takes no single task; rows go through as a sorted stream, batch by
batch, and none is gathered in a group. Rows of equal client and time are one, with a bit for each
kind, and repeated rows thereby count once.

The p-th percentile of a step's times is found without sorting them: times of a (funnel, client,
step) are summed up by their high bits, then by their low bits within the one class where the rank
falls, so a window there has at most about the square root of ``within`` in microseconds rows. The
times are written once and read by these steps, so the sweep runs once.

Rows with a null client, time or kind are left out, as are kinds that no funnel names. An empty
table gives an empty result, and clients without a first step have no row. Ties of time are no
order: neither of two rows of the same microsecond is later. Columns may have any name.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritape.session import cut

#: name, kinds in order, excluded kind
FUNNELS = (
    ("A", ("view", "click", "view", "purchase"), "error"),
    ("B", ("signup", "view", "click", "purchase"), "error"),
    ("C", ("click", "click", "purchase", "view"), "signup"),
)
WITHIN = timedelta(minutes=15)
WINDOW = timedelta(hours=3)
PERCENT = 50
OUT_ROWS = 10_000

Funnel = tuple[str, tuple[str, ...], str]


def micros(time: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970; a timestamp without a zone is taken as it stands, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        second = (F.expr("1000000") * F.date_part(F.lit("SECOND"), time)).cast("long")
        return F.unix_date(time.cast("date")).cast("long") * 86_400_000_000 + F.hour(time).cast("long") * 3_600_000_000 + F.minute(time).cast("long") * 60_000_000 + second
    return F.unix_micros(time.cast("timestamp"))


def sweeper(funnels: tuple[Funnel, ...], kinds: list[str], within: int, client_type: pa.DataType):
    """The sweep over batches of (client, from, to, at, bits), sorted by client, window and time: attempts start from ``from`` and before ``to``."""
    bit = {k: 1 << i for i, k in enumerate(kinds)}
    plans = [(name, [bit[k] for k in steps], bit[out]) for name, steps, out in funnels]
    names = ["funnel", "client_id", "step", "gap", "n"]
    types = [pa.string(), client_type, pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting = [[deque() for _ in steps[1:]] for _, steps, _ in plans]
        started = [0] * len(plans)
        client = start = None

        def close() -> None:
            for f, (name, _, _) in enumerate(plans):
                if started[f]:
                    out.append((name, client, 1, None, started[f]))
                started[f] = 0
                for d in waiting[f]:
                    d.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for c, lo, hi, at, bits in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if lo != start or c != client:
                    close()
                    client, start = c, lo
                for f, (name, steps, excluded) in enumerate(plans):
                    waits = waiting[f]
                    if bits & excluded:
                        for d in waits:
                            d.clear()
                    for k in range(len(waits), 0, -1):  # later steps first: what moves on at this time moves once
                        if bits & steps[k] and waits[k - 1]:
                            d, total = waits[k - 1], 0
                            for then, n in d:
                                if at - then <= within:
                                    out.append((name, c, k + 1, at - then, n))
                                    total += n
                            d.clear()
                            if total and k < len(waits):
                                put(waits[k], at, total)
                    if bits & steps[0] and at < hi:
                        started[f] += 1
                        if waits:
                            put(waits[0], at, 1)
                if len(out) >= OUT_ROWS:
                    yield batch_of()
        close()
        if out:
            yield batch_of()

    def put(d: deque, at: int, n: int) -> None:
        while d and at - d[0][0] > within:
            d.popleft()
        d.append((at, n))

    return run


def step_times(
    clicks: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, *, client_col: str = "client_id", kind_col: str = "kind", time_col: str = "ts", within: timedelta = WITHIN, window: timedelta = WINDOW
) -> DataFrame:
    """funnel, client_id, step (from 1), gap (microseconds from the previous step; null for the first) and n, the number of attempts."""
    kinds = sorted({k for _, steps, out in funnels for k in (*steps, out)})
    if len(kinds) > 62:
        raise ValueError("at most 62 kinds: each is a bit of a long")
    limit, width = within // timedelta(microseconds=1), window // timedelta(microseconds=1)
    span = limit * (max(len(steps) for _, steps, _ in funnels) - 1)
    client = clicks.schema[client_col].dataType
    rows = clicks.select(
        F.col(f"`{client_col}`").alias("c"),
        micros(F.col(f"`{time_col}`"), clicks.schema[time_col].dataType).alias("at"),
        F.coalesce(*[F.when(F.col(f"`{kind_col}`") == k, F.lit(1 << i).cast("long")) for i, k in enumerate(kinds)]).alias("bit"),
    ).where("c is not null and at is not null and bit is not null")
    window_of = "({0} - pmod({0}, {1}L)) div {1}L"
    windows = rows.withColumn("w", F.explode(F.expr(f"sequence({window_of.format(f'(at - {span}L)', width)}, {window_of.format('at', width)})")))
    # one exchange by (client, window) serves the grouping and the sweep
    merged = windows.repartition("c", "w").groupBy("c", "w", "at").agg(F.bit_or("bit").alias("bits"))
    streams = merged.sortWithinPartitions("c", "w", "at").select("c", (F.col("w") * width).alias("lo"), ((F.col("w") + 1) * width).alias("hi"), "at", "bits")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(client.simpleString())
    if arrow is None:
        raise ValueError("clients are numbers or strings")
    swept = streams.mapInArrow(sweeper(funnels, kinds, limit, arrow), f"funnel string, client_id {client.simpleString()}, step int, gap long, n long")
    return swept.groupBy("funnel", "client_id", "step", "gap").agg(F.sum("n").alias("n"))


def percentile(times: DataFrame, percent: int, most: int) -> DataFrame:
    """(funnel, client_id, step, gap) of the ceil(percent * n / 100)-th smallest gap, gaps being at most ``most``."""
    keys = ["funnel", "client_id", "step"]
    shift = (most.bit_length() + 1) // 2
    timed = times.where("gap is not null").withColumn("part", F.shiftright("gap", shift))
    whole, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = timed.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("total", F.sum("m").over(whole)).withColumn("upto", F.sum("m").over(upto))
    parts = parts.withColumn("rank", F.expr(f"greatest(1, (total * {percent} + 99) div 100)"))
    found = parts.where("upto >= rank and upto - m < rank").select(*keys, "part", (F.col("rank") - F.col("upto") + F.col("m")).alias("rest"))
    inner = Window.partitionBy(*keys).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    near = timed.join(found, [*keys, "part"]).withColumn("upto", F.sum("n").over(inner))
    return near.where("upto >= rest and upto - n < rest").select(*keys, "gap")


def count_funnels(
    clicks: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, *, client_col: str = "client_id", kind_col: str = "kind", time_col: str = "ts", within: timedelta = WITHIN, window: timedelta = WINDOW, percent: int = PERCENT
) -> DataFrame:
    """One row for each funnel and client with attempts.

    n1, n2, ...: attempts that reach each step; deepest: the last step that any reaches; t2, t3, ...: the percentile of the
    microseconds from the previous step, null if the step isn't reached; same_depth: clients of equal funnel and deepest.
    """
    steps = range(1, 1 + max(len(s) for _, s, _ in funnels))
    times = cut(step_times(clicks, funnels, client_col=client_col, kind_col=kind_col, time_col=time_col, within=within, window=window), "times")
    key = ["funnel", "client_id"]
    counts = times.groupBy(*key).agg(*[F.sum(F.when(F.col("step") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in steps], F.max("step").alias("deepest"))
    picked = percentile(times, percent, within // timedelta(microseconds=1))
    picked = picked.groupBy(*key).agg(*[F.max(F.when(F.col("step") == k, F.col("gap"))).alias(f"t{k}") for k in steps if k > 1])
    depths = times.groupBy(*key).agg(F.max("step").alias("deepest")).groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    # one row for each funnel and step, however many clients there are
    return counts.join(picked, key, "left").join(F.broadcast(depths), ["funnel", "deepest"]).select(*key, *[f"n{k}" for k in steps], "deepest", *[f"t{k}" for k in steps if k > 1], "same_depth")


def oracle(funnels: tuple[Funnel, ...] = FUNNELS, percent: int = PERCENT) -> str:
    """The query's rows in DuckDB SQL, for funnels of four steps and 15 minutes."""
    heads, ends = [], []
    for name, steps, out in funnels:
        f = name.lower()
        heads.append(f"{f}1 as (select client_id, ts as s, ts as t from r where kind = '{steps[0]}')")
        for k, kind in enumerate(steps[1:], 2):
            heads.append(
                f"{f}{k} as (select a.client_id, a.t as s, b.ts as t from {f}{k - 1} a asof join (select client_id, ts from r where kind = '{kind}') b on a.client_id = b.client_id and a.t < b.ts "
                f"asof left join (select client_id, ts from r where kind = '{out}') e on a.client_id = e.client_id and a.t < e.ts "
                f"where b.ts <= a.t + interval 15 minutes and (e.ts is null or e.ts > b.ts))"
            )
        ends += [f"select '{name}' as funnel, client_id, {k} as step, date_diff('microsecond', s, t) as gap from {f}{k}" for k in range(1, 5)]
    return f"""
with r as (select distinct client_id, kind, ts from clicks where client_id is not null and kind is not null and ts is not null),
{", ".join(heads)},
gaps as ({" union all ".join(ends)}),
ranked as (select *, row_number() over (partition by funnel, client_id, step order by gap) as rn, count(*) over (partition by funnel, client_id, step) as n from gaps),
found as (
  select funnel, client_id, {", ".join(f"count(*) filter (step = {k})::bigint as n{k}" for k in range(1, 5))}, max(step)::int as deepest,
    {", ".join(f"max(gap) filter (step = {k} and rn = (n * {percent} + 99) // 100)::bigint as t{k}" for k in range(2, 5))}
  from ranked group by 1, 2
)
select *, count(*) over (partition by funnel, deepest)::bigint as same_depth from found
"""
