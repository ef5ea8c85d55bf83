"""The shuffle into shards: exact sizes, gapless slots, the law of its matrix, and uniform places."""
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import sharding


def placed_well(rows, n, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n
    assert all(sizes[s] == n // shards + (s < n % shards) for s in range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_query_on_awkward_rows(edge_docs, plain_rows):
    rows = sharding.digests(edge_docs).collect()
    placed_well(rows, len(plain_rows), 24)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in plain_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_empty(no_docs):
    assert sharding.digests(no_docs).collect() == []
    assert sharding.shuffled(no_docs).columns == [*no_docs.columns, "shard", "slot"]


def test_small_blocks_and_cells(spark, monkeypatch):
    """Many blocks, levels of the tree and cells; other columns stay, and a third of all rows are equal."""
    monkeypatch.setattr(sharding, "BLOCK_BITS", 5)
    monkeypatch.setattr(sharding, "FAN_BITS", 2)
    monkeypatch.setattr(sharding, "CELL", 8)
    docs = spark.range(3000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("no").alias("_llm"))
    rows = sharding.shuffled(docs, 7, seed=3).collect()
    placed_well(rows, 3000, 7)
    assert Counter(r.doc_id for r in rows) == Counter(i if i % 3 else None for i in range(3000))
    again = sharding.shuffled(docs, 7, seed=3).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    assert sorted(map(tuple, rows), key=repr) != sorted(map(tuple, sharding.shuffled(docs, 7, seed=4).collect()), key=repr)


@pytest.mark.parametrize("total, marked, taken", [(10, 4, 5), (30, 1, 11), (200, 60, 37), (12, 12, 5), (12, 0, 5), (9, 5, 9), (40_000, 3_000, 9_000)])
def test_draws_follow_the_law(spark, total, marked, taken):
    n = 4000
    drawn = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(taken), (F.col("id") + 0.5) / n).alias("k"))
    got = Counter(r.k for r in drawn.collect())
    low, high = max(0, taken + marked - total), min(marked, taken)
    chance = {k: math.exp(sum(math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in ((marked, k), (total - marked, taken - k)))
                          - (math.lgamma(total + 1) - math.lgamma(taken + 1) - math.lgamma(total - taken + 1))) for k in range(low, high + 1)}
    assert all(abs(got[k] - n * p) <= 1.01 for k, p in chance.items())  # quantiles at even steps
    assert sum(got.values()) == n and set(got) <= set(chance)


def test_matrix_has_the_law_of_a_permutation(spark, monkeypatch):
    """Sums of every matrix, and over seeds the moments that a uniform permutation has."""
    monkeypatch.setattr(sharding, "FAN_BITS", 1)
    sizes, shards, runs = [3, 9, 0, 4, 8], 3, 150
    total = sum(sizes)
    room = spark.range(runs).select(F.col("id").alias("seed"), F.array(*(F.lit(8).cast("long") for _ in range(shards))).alias("room"))
    children = F.array(*(F.struct(F.lit(i).cast("long").alias("no"), F.lit(n).cast("long").alias("n")) for i, n in enumerate(sizes)))
    rows = room.select(F.explode(sharding.split(F.col("room"), children, 0, F.col("seed"))).alias("c")).select("c.*").collect()
    for i, n in enumerate(sizes):
        own = [r.room for r in rows if r.no == i]
        assert len(own) == runs and all(sum(x) == n for x in own)
        for s in range(shards):
            assert abs(sum(x[s] for x in own) / runs - n / 3) < 0.35
            variance = n / 3 * (2 / 3) * (total - n) / (total - 1)
            assert abs(sum((x[s] - n / 3) ** 2 for x in own) / runs - variance) < 0.6
    blocks = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "no long, n long")
    matrix = {r.no: r.room for r in sharding.communication(blocks, shards, 5, 4).collect()}
    assert {i: sum(x) for i, x in matrix.items()} == {i: n for i, n in enumerate(sizes) if n}
    assert [sum(x[s] for x in matrix.values()) for s in range(shards)] == [8, 8, 8]


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.range(500, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write(docs, str(tmp_path / "out"), 6)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    placed_well(rows, 500, 6)
    assert len({r.doc_id for r in rows}) == 500
    expected = 500 / 36
    near = Counter((r.doc_id * 6 // 500, r.shard) for r in rows)
    assert sum((near[a, b] - expected) ** 2 / expected for a in range(6) for b in range(6)) < 60  # chi-squared with 25 degrees of freedom
