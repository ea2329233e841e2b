"""Run registered queries against their oracles: ``python -m tests.check_queries [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

from evidencelake.plans.registry import Tables, load_all
from evidencelake.session import local_session
from tests.oracle import compare, connect


def main() -> int:
    args = sys.argv[1:]
    root = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    spark, con = local_session(8), connect(root)
    failed = 0
    for name, q in load_all().items():
        if wanted and not any(w == name or w in q.build.__module__ for w in wanted):
            continue
        started = time.time()
        try:
            df = q.build(Tables(spark, root))
            if q.sql is None:
                n = df.count()
                problem = None if n else "no rows"
                tag = f"rows-only {n}"
            else:
                problem, tag = compare(df, con, q.sql), "oracle"
        except Exception as e:  # report and go on
            problem, tag = f"{type(e).__name__}: {str(e)[:700]}", "error"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - started:6.2f}s {name} [{tag}] {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
