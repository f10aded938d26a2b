"""python tests/run_checks.py [sf_dir] [name ...]: all queries against their oracles."""
import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]
import __spark_entry__ as entry_module  # noqa: E402
from compare import compare, connect  # noqa: E402
from conftest import make_session  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    chosen = [q for q in queries if not args or any(q.startswith(a) for a in args)]
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in oracle:
                result = compare(name, queries[name], oracle[name], spark, sf_dir, con)
            else:
                result = f"OK rows only {queries[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__} {str(error)[:700]}"
        bad += not (result.startswith("OK") and "types" not in result)
        print(f"{time.time() - start:6.2f}s {name}: {result}", flush=True)
    print(f"{len(chosen)} queries, {bad} not OK")
