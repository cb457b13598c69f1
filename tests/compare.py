"""Run queries beside their oracles: ``python tests/compare.py [folder] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    try:
        import numpy as np

        if isinstance(value, np.generic):
            return plain(value.item())
    except ImportError:
        pass
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, build, oracle, folder):
    df = build(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if oracle is None:
        return f"rows only: {len(ours)}"
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    types = dict(zip(names, [str(d[1]) for d in cursor.description]))
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}"
    mine = dict(df.dtypes)
    simple = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(n, mine[n], types[n]) for n in names if simple.get(mine[n], mine[n]) != types[n].replace("STRING", "VARCHAR")]
    note = f" types {odd}" if odd else ""
    if ours == theirs:
        return f"ok {len(ours)}{note}"
    extra, lack = sorted(set(ours) - set(theirs), key=repr), sorted(set(theirs) - set(ours), key=repr)
    return f"DIFF ours {len(ours)} theirs {len(theirs)}{note}\n   + {extra[:2]}\n   - {lack[:2]}"


def main():
    import duckdb

    import __spark_entry__ as entry
    from fleetfault.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.001"
    spark = local_session("8", 8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    oracles = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            said = compare(spark, con, name, build, oracles.get(name), folder)
        except Exception as problem:  # noqa: BLE001
            said = "FAIL " + str(problem)[:600]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not said.startswith(("ok", "rows"))
        print(f"{name}: {said} ({time.time() - start:.1f}s)", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
