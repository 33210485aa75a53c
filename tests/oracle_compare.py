"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Compares row count, column names/types and the multiset of rows.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def compare(spark_df, con, sql: str):
    s_pdf = spark_df.toPandas()
    d_pdf = con.execute(sql).fetchdf()
    s_cols, d_cols = sorted(s_pdf.columns), sorted(d_pdf.columns)
    if s_cols != d_cols:
        return False, f"columns differ: spark-only {set(s_cols)-set(d_cols)} duck-only {set(d_cols)-set(s_cols)}"
    if len(s_pdf) != len(d_pdf):
        return False, f"row count spark={len(s_pdf)} duck={len(d_pdf)}"
    types = {}
    for c in s_cols:
        sk, dk = s_pdf[c].dtype.kind, d_pdf[c].dtype.kind
        if sk != dk and not (len(s_pdf) == 0):
            types[c] = (str(s_pdf[c].dtype), str(d_pdf[c].dtype))
    def rows(pdf):
        out = []
        for r in pdf[s_cols].itertuples(index=False):
            out.append(tuple("NULL" if (x is None or (isinstance(x, float) and math.isnan(x) and False)) else _norm(x) for x in r))
        return sorted(out, key=repr)
    rs, rd = rows(s_pdf), rows(d_pdf)
    if rs != rd:
        bad = [(a, b) for a, b in zip(rs, rd) if a != b][:3]
        return False, f"values differ (types {types}): {bad}"
    return True, f"{len(s_pdf)} rows" + (f" dtype-diff {types}" if types else "")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from ensemble.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    n_ok = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                ok, msg = True, f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        n_ok += ok
        print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time()-t:6.1f}s {msg}", flush=True)
    print(f"{n_ok} ok")


if __name__ == "__main__":
    main()
