"""Command line check of the registered queries: python -m tests.check_queries [sf_dir] [name part ...]"""

import sys
import time

from tests.oracle import LAST_ROWS, connect, difference
from threadloom.session import build_session


def main(argv):
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sql:
                result = difference(df, con, sql[name])
            else:
                result = None if df.count() >= 0 else "no rows"
            note = f" {LAST_ROWS['n']} rows" if name in sql else " (no SQL)"
        except Exception as e:  # report and go on
            result, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.2f}s{note}"
              + (f"\n     {result}" if result else ""), flush=True)
    print(f"failures: {bad}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
