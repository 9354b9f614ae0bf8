"""Compare registered queries with their SQL: ``python tests/check.py [folder] [name prefix ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def compare(spark, con, folder, run, sql):
    """None if equal, else a short account of the difference."""
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = canonical(df.columns, rows), canonical(names, want)
    if left == right:
        return None
    extra = [x for x in left if x not in set(right)][:2]
    missing = [x for x in right if x not in set(left)][:2]
    return f"{len(left)} rows against {len(right)}; only here {extra}; only in SQL {missing}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from hostguard.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session("hostguard-check", cores="8")
    session.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    sqls = oracle_sql()
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(session, connection, folder, run, sqls.get(name))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in sqls else "rows"
        print(f"## {'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
