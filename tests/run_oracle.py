"""python -m tests.run_oracle [sf_dir] [name prefix ...]: check queries and time them."""

import sys
import time

import __spark_entry__ as entry
from lumenact.session import local_session
from tests.compare import compare, connect


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, build in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"rows only: {df.count()}"
            else:
                verdict = compare(df, sql, con) or "equal"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        bad += not verdict.startswith(("equal", "rows only"))
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
