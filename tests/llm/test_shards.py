import random
import zlib

from tests.llm.rows import TEXTS, documents
from worklens.llm import sharding
from worklens.sources.staging import settle


def with_metadata(spark, rows):
    df = documents(spark, rows)
    return df.selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 7 = 0 THEN NULL ELSE 'en' END AS lang", "'hot' AS source", "length(text) AS n_chars")


def brute(points, shards, dims):
    """(shard, point) by the same rule, all points in memory."""
    scale = [max(1, max(a[i] for a, _ in points) - min(a[i] for a, _ in points)) for i in range(dims)] if points else []

    def split(rows, first, k):
        if k == 1 or not rows:
            return [(first, a) for a, _ in rows]
        width = [(max(a[i] for a, _ in rows) - min(a[i] for a, _ in rows)) / scale[i] for i in range(dims)]
        dim = max(range(dims), key=lambda i: (width[i], -i))
        if width[dim] == 0:
            dim = dims
        rows = sorted(rows, key=lambda r: (r[0][dim], r[0]))
        target, under, at = max(1, sum(s for _, s in rows) * (k // 2) // k), 0, 0
        while under + rows[at][1] < target:
            under += rows[at][1]
            at += 1
        at += under + rows[at][1] - target <= target - under
        return split(rows[:at], first, k // 2) + split(rows[at:], first + k // 2, k - k // 2)

    return sorted(split(points, 0, shards))


def test_tree_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 64)
    rng = random.Random(5)
    rows = [(i, "x" * rng.choice([0, 3, 10, 200, 5000])) for i in range(300)] + [(7, "same row")] * 150 + TEXTS
    for shards in (1, 5, 16):
        points = settle(sharding.points(with_metadata(spark, rows)).select("size", "at"), "test")
        placed, _, shard = sharding.grow(points, shards, 3)
        got = sorted((shard[r["node"]], list(r["at"])) for r in placed.collect())
        assert got == brute([(list(r["at"]), r["size"]) for r in points.collect()], shards, 3)


def test_assignments(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    rows = TEXTS + [(100 + i, "y" * (i % 50)) for i in range(400)] + [(7, "row that comes again")] * 300
    got = sharding.assignments(with_metadata(spark, rows), 8).collect()
    want = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got), key=repr) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for rows_ in by.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    assert set(by) <= set(range(8))


def test_near_equal_bytes_whatever_is_hot(spark):
    rows = [(i, "z" * 50) for i in range(1000)] + [(5, "the same")] * 500
    sizes = {}
    for r in sharding.assignments(documents(spark, rows).selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4 * 51


def test_columns_stay_and_empty_tables(spark, tmp_path):
    docs = with_metadata(spark, None)
    out = sharding.with_shard(docs, 4)
    assert out.columns == [*docs.columns, "shard"] and out.count() == len(TEXTS)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(TEXTS)
    empty = with_metadata(spark, [])
    assert sharding.assignments(empty).count() == 0 and sharding.with_shard(empty).count() == 0
    assert sharding.shards_for(docs, 10**9) == 1 and sharding.shards_for(docs, 1000) > 50
