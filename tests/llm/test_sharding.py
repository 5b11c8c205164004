"""Sharding against SQL that walks the same permutation, and its edge cases."""

import duckdb
import numpy as np
import pytest

from fleetline.llm import queries, sharding

KEYS = sharding.round_keys(42)
#: Row numbers by id, a Feistel network of four rounds in 128-bit integers, walked again while the place is outside.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM documents),
halves AS (
  SELECT r, n, greatest(1, CAST(ceil(length(bin(greatest(n - 1, 1))) / 2.0) AS INTEGER)) AS b FROM sized),
walk AS (
  SELECT r, n, b, CAST(r AS HUGEINT) AS v, TRUE AS first FROM halves
  UNION ALL
  SELECT r, n, b, CAST((l4 << b) | r4 AS HUGEINT), FALSE FROM (
   SELECT *, r3 AS l4, xor(l3, ((xor(r3, {KEYS[3]}::HUGEINT) * {sharding.MULTIPLIER}) >> 15) & m) AS r4 FROM (
    SELECT *, r2 AS l3, xor(l2, ((xor(r2, {KEYS[2]}::HUGEINT) * {sharding.MULTIPLIER}) >> 15) & m) AS r3 FROM (
     SELECT *, r1 AS l2, xor(l1, ((xor(r1, {KEYS[1]}::HUGEINT) * {sharding.MULTIPLIER}) >> 15) & m) AS r2 FROM (
      SELECT *, r0 AS l1, xor(l0, ((xor(r0, {KEYS[0]}::HUGEINT) * {sharding.MULTIPLIER}) >> 15) & m) AS r1 FROM (
       SELECT *, v >> b AS l0, v & m AS r0 FROM (
        SELECT *, (1::HUGEINT << b) - 1 AS m FROM walk WHERE first OR v >= n))))))),
places AS (SELECT r, v FROM walk WHERE NOT first AND v < n)
SELECT doc_id, CAST(size AS BIGINT), CAST(v % 8 AS INTEGER), CAST(v // 8 AS BIGINT) FROM sized JOIN places USING (r)
"""


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.queries()["op10_sharding"](spark, sf_dir).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL).fetchall())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    for seed in (0, 42, 2**31 - 1):
        assert sorted(sharding.feistel(np.arange(n), n, seed)) == list(range(n))


def test_same_shards_for_any_partitioning(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = sharding.shard_rows(docs.coalesce(1), 5, seed=7).select("doc_id", "shard", "slot").collect()
    many = sharding.shard_rows(docs.repartition(7), 5, seed=7).select("doc_id", "shard", "slot").collect()
    assert sorted(one) == sorted(many)


def test_nulls_repeats_clashing_names_and_no_rows(spark):
    rows = [(None, "a", 1, 2)] * 700 + [(5, None, 3, 4)] * 700 + [(i, "", 0, 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, _bucket int")
    out = sharding.shard_rows(df, 3).collect()
    for shard in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (766, 767)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    assert sharding.shard_rows(df.limit(0), 3).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(50).selectExpr("id AS doc_id", "repeat('x', int(id)) AS text")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4
