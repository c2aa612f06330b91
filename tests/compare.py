"""Run a registered query and its SQL over the same tables and compare the rows."""
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), len(got), took, ""
    start = time.time()
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    slow = time.time() - start
    note = f"oracle {slow:.1f}s" if slow > 5 else ""
    if got_cols != want_cols:
        return "COLUMNS", len(got), took, f"{got_cols} vs {want_cols}"
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else []
        lost = [r for r in want if r not in got][:3] if len(got) < 20000 else []
        return "DIFF", len(got), took, f"{len(got)} vs {len(want)}; only spark {extra}; only sql {lost}"
    types = {type(v).__name__ for r in want[:200] for v in r}
    if "Decimal" in types:
        note += " DECIMAL in oracle"
    if not got:
        return "EMPTY", 0, took, note
    return "ok", len(got), took, note


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{status:8} {name:28} rows={n:<8} {took:6.2f}s {note}", flush=True)
