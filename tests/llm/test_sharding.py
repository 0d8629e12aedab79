import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from rowparity.llm.sharding import bits_for, hilbert_index, sharded, write_shards


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_by_unit_steps(n, bits):
    cells = sorted(product(range(1 << bits), repeat=n), key=lambda c: hilbert_index(list(c), bits))
    assert sorted(hilbert_index(list(c), bits) for c in cells) == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(cells, cells[1:]))


def rows(k):
    return [(i, "t" * (i % 50), ("en", "de", None)[i % 3], f"src{i * i % 7}", i % 50) for i in range(k)] + [(None, None, None, None, None), (3, "ttt", "en", "src2", 3), (3, "ttt", "en", "src2", 3)]


@pytest.mark.parametrize("k", [0, 20, 37, 500])
def test_law_of_rows(spark, k):
    table = rows(k)
    out = sharded(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as cell", "2 as part", "3 as shard"), 40).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t, *_ in table)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, ())) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    cells = [c for _, c in sorted({(r.shard, r.slot): r.cell for r in out}.items())]
    assert cells == sorted(cells)


def test_empty_table_and_written_files(spark, tmp_path):
    table = spark.createDataFrame(rows(300)[:300], "doc_id long, text string, lang string, source string, n_chars long")
    assert sharded(table.limit(0)).collect() == []
    write_shards(table, str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 8


def test_steps_cells_and_places_against_brute_force(spark):
    """Whole strings count, a value's step is the share of rows below it, and partitioning changes nothing."""
    table = [(i, "t" * i, f"https://site{i * 7 % 8}.example", i % 9, i * i % 31) for i in range(200)]
    df = spark.createDataFrame(table, "doc_id long, text string, site string, kind int, n long")
    dimensions = ("site", "kind", "n")
    bits = bits_for(8, 3)
    assert 1 << 3 * bits >= 16 * 8

    def step(column, value):
        every = [row[column] for row in table]
        return max(sum(x < v for x in every) * (1 << bits) // len(every) for v in set(every) if v <= value)

    expected = {row[0]: hilbert_index([step(k, row[k]) for k in (2, 3, 4)], bits) for row in table}
    places = []
    for parts in (1, 7):
        out = sharded(df.repartition(parts), 8, dimensions).collect()
        assert {r.doc_id: r.cell for r in out} == expected
        places.append({r.doc_id: (r.shard, r.slot) for r in out})
        assert sorted((s, k) for s, k in places[-1].values()) == [(s, k) for s in range(8) for k in range(25)]
    assert places[0] == places[1] and len({step(2, row[2]) for row in table}) == 8


def test_files_prune(spark, tmp_path):
    """Files along the curve have narrow ranges in every dimension; hashed files have full ones."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.xxhash64("id", F.lit(1)) % 1000).alias("a"), (F.xxhash64("id", F.lit(2)) % 1000).alias("b"))
    df = df.withColumn("shard", F.lit("own"))
    write_shards(df, str(tmp_path / "s"), 16, ("a", "b"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("shard = 'own'").count() == 4000
    ranges = back.groupBy("shard_").agg(*(((F.max(c) - F.min(c)) / 2000).alias(c) for c in "ab")).collect()
    assert len(ranges) == 16 and all(sum(r[c] for r in ranges) / 16 < 0.4 for c in "ab")


def test_repeated_rows_are_written_as_often(spark, tmp_path):
    table = [*rows(60), (3, "other text", "en", "src2", 3), (61, "", "", "", 0)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s")).drop("shard")
    assert Counter(map(tuple, back.collect())) == Counter(table)
