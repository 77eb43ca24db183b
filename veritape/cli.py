"""python -m veritape.cli ROOT STORE (--all | --company NAME | --list)"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritape.operators.fuzzy import lookup
from veritape.plans import analysis
from veritape.sinks import Store
from veritape.sources.tree import listing


def folders(spark: SparkSession, root: str):
    from veritape.functions.text import display_name

    names = listing(spark, root, r"(?i)\.(txt|pdf|xml)$", content=False).select("company").distinct()
    return names.withColumn("display", display_name(F.col("company"))).orderBy("company")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("store")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--all", action="store_true")
    which.add_argument("--company")
    which.add_argument("--list", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("veritape").getOrCreate()
    if a.list:
        folders(spark, a.root).show(1000, False)
        return 0
    store = Store(spark, a.store)
    if a.all:
        names = [r.company for r in folders(spark, a.root).collect()]
        failed = analysis.run_each(spark, a.root, store, names)
        for name, why in failed.items():
            print(f"{name}: {why.splitlines()[0] if why else 'failed'}")
        print(f"{len(names) - len(failed)} ready, {len(failed)} failed")
        return int(bool(failed))
    found = lookup(folders(spark, a.root), ["company", "display"], "company", a.company, similar=["company"], both_ways=True).first()
    if found is None:
        print(f"no company like {a.company}")
        return 1
    return int(bool(analysis.run_each(spark, a.root, store, [found.company])))


if __name__ == "__main__":
    raise SystemExit(main())
