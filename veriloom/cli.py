"""Command line: list the queries, or run one over a folder of tables and show or write its rows.

    python -m veriloom.cli --list
    python -m veriloom.cli keyword_topk /data/tables [--out DIR] [--rows 20]

Exit status 0 on success, 2 for an unknown query.
"""

from __future__ import annotations

import argparse
import sys

from veriloom.plans import catalog
from veriloom.session import get_spark, ship


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veriloom")
    p.add_argument("query", nargs="?")
    p.add_argument("tables", nargs="?")
    p.add_argument("--list", action="store_true")
    p.add_argument("--out")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    catalog.load()
    if a.list or not a.query:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.query not in catalog.QUERIES or not a.tables:
        print(f"unknown query or no tables given: {a.query}", file=sys.stderr)
        return 2
    spark = get_spark()
    ship(spark)
    df = catalog.QUERIES[a.query](spark, a.tables)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
