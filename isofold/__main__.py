"""python -m isofold NAME --sf DIR [--out PATH]: runs a registered query over the tables in a folder, and shows or writes its result."""

from __future__ import annotations

import argparse

from .plans.registry import QUERIES


def main() -> None:
    p = argparse.ArgumentParser(prog="isofold", description=__doc__)
    p.add_argument("name", choices=sorted(QUERIES))
    p.add_argument("--sf", required=True, help="folder of the input tables")
    p.add_argument("--out", help="where the result goes as Parquet; shown if left out")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args()
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"isofold {a.name}").getOrCreate()
    out = QUERIES[a.name](spark, a.sf)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
