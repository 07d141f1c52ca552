"""Hashes that meet by chance."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from canopy.plans import registry


def test_hash_verify_where_hashes_meet(spark, tmp_path):
    """Of a changed name that has the same 16 bits, query and SQL say the same."""
    short = lambda s: hashlib.md5(s.encode()).hexdigest()[:4]
    met = next(f"Customer#{i:09}" for i in range(2_000_000) if short(f"Customer#{i:09}") == short(f"Customer#{i:09}.1x"))
    rows = spark.createDataFrame([(1, met, 3), (2, "Customer#000000002", 3), (3, "Customer#000000003", 3)], "c_custkey long, c_name string, c_nationkey int")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r.c_custkey, r.item_ok, r.leaf_ok) for r in registry.QUERIES["hash_verify"](spark, str(tmp_path)).select("c_custkey", "item_ok", F.col("leaf_ok")).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert set(db.execute(registry.ORACLES["hash_verify"]).fetchall()) == got == {(1, True, True), (2, True, False), (3, True, True)}
