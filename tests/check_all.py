"""Compare every registered query with its SQL: python -m tests.check_all [folder] [section or name ...]"""

from __future__ import annotations

import sys
import time
from importlib import import_module

import catalog
from rookery.session import local_session
from tests.compare import connect, differences


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracle = {}, {}
    sections = [s for s in wanted if s in catalog.SECTIONS] or ([] if wanted else list(catalog.SECTIONS))
    for s in sections:
        queries |= import_module(f"catalog.{s}").QUERIES
        oracle |= import_module(f"catalog.{s}").ORACLE
    names = [w for w in wanted if w not in catalog.SECTIONS]
    if names:
        every, texts = catalog.queries(), catalog.oracle_sql()
        queries |= {n: every[n] for n in names}
        oracle |= {n: texts[n] for n in names if n in texts}
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, query in queries.items():
        start = time.time()
        try:
            problems = differences(query(spark, folder), con, oracle[name]) if name in oracle else [
                f"note: no sql, {query(spark, folder).count()} rows"
            ]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        real = [p for p in problems if not p.startswith("note")]
        bad += bool(real)
        print(f"{'BAD ' if real else 'ok  '} {name:28s} {time.time() - start:6.2f}s", *problems, sep="\n      " if problems else " ")
    print(f"{len(queries)} queries, {bad} bad")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
