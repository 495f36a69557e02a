"""Compare registered queries with their SQL. Usage: python tests/oracle_check.py [sf] [query ...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


#: Learned models, tokenizers and the curve: held against brute force in the tests instead.
ROWS_ONLY = {"pipeline", "op1_url_model", "op2_decision_list", "op3_block_labeller", "op8_token_files", "op9_bpe", "op10_hilbert",
             "op13_simhash"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else (None if math.isnan(v) else v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return name in ROWS_ONLY, f"no SQL, {sum(got[1].values())} rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return True, f"{sum(want[1].values())} rows"
    note = f"{sum(got[1].values())} vs {sum(want[1].values())} rows"
    if got[0] != want[0]:
        note += f" columns {got[0]} vs {want[0]}"
    extra, lack = got[1] - want[1], want[1] - got[1]
    return False, f"{note}; only ours {len(extra)}: {list(extra)[:3]!r:.500}; only sql {len(lack)}: {list(lack)[:3]!r:.500}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failed:", bad)
