"""Runs queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings nav fund_sheet fund_summaries prospectus_data page_text parent_chunk doc_sections "
    "nav_feed source_units chunking_config container_spec"
).split()


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else v


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    theirs = Counter(tuple(_cell(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} and {cols}"
    ours = Counter(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"


if __name__ == "__main__":
    import os

    os.environ["PYSPARK_SUBMIT_ARGS"] = "--conf spark.ui.showConsoleProgress=false pyspark-shell"
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    from fundspark.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    for n, f in e.queries().items():
        if names and n not in names or not names and n.startswith("p") and n[1:2].isdigit():
            continue
        t = time.time()
        try:
            if n in e.oracle_sql():
                out = differences(spark, sf, n, f, e.oracle_sql()[n]) or "same"
            else:
                out = f"{f(spark, sf).count()} rows, no SQL"
        except Exception as x:
            out = "FAILED " + str(x).split("\n")[0][:300]
        print(n, f"{time.time() - t:.1f}s", out[:600], flush=True)
