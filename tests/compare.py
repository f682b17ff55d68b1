"""Compares registered queries with their SQL in DuckDB. Run: python tests/compare.py SF_DIR [name ...]"""

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "") if not hasattr(v, "hour") else v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            n = sum(x != y for x, y in zip(got[1], want[1]))
            return f"{n} rows differ, first: {[(c, x, y) for c, x, y in zip(got[0], a, b) if x != y]} in {a}"
    return None


def session():
    from wayloom.session import build_session

    return build_session(
        "compare",
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
           "spark.log.level": "ERROR"},
    )


def main():
    import __spark_entry__ as E

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    queries, oracles = E.queries(), E.oracle_sql()
    for n in [n for n in names if n.startswith("@")]:
        names += list(__import__("importlib").import_module(f"wayloom.plans.{n[1:]}").QUERIES)
    picked = [q for q in queries if not names or q in names]
    bad = 0
    for name in picked:
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                df = queries[name](spark, sf_dir)
                rows = df.collect()
                problem = None
                print(f"rows  {name}: {len(rows)}", str(rows[:1])[:200])
        except Exception as e:
            problem = "ERROR " + (str(e) if "-v" not in sys.argv else traceback.format_exc())[:900]
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} good")


if __name__ == "__main__":
    main()
