from datetime import datetime

import brute
import pytest
from pyspark.sql import functions as F

from tessera.operators import small_files

SCHEMA = "file_id bigint, path string, stack string, written_at timestamp, size_bytes bigint, metadata string, content string, depth string, record int"
AT = [datetime(2024, 1, d) for d in range(1, 9)]


def table(spark, tmp_path, rows):
    path = str(tmp_path / "files.parquet")
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return path


def test_against_brute_force_with_dirt(spark, tmp_path):
    long = "\n".join(f'{{"layer": 1, "segment_id": {i}}}' for i in range(4000))
    rows = [
        (1, "s/layers/1/a.json", "s", AT[0], 9, '{"depth": 3}', '{"layer": 1, "segment_id": 7}\r\n\r\n{"layer":"1","segment_id":8.0,"x":[1]}\n'),
        (1, "s/layers/1/a.json", "s", AT[0], 9, '{"depth": 3}', '{"layer": 1, "segment_id": 7}\r\n\r\n{"layer":"1","segment_id":8.0,"x":[1]}\n'),
        (2, "s/layers/1/b.json", None, AT[0], 9, '{"depth": "4"}', '{"segment_id": "7", "layer": 1.0}'),
        (3, "t/layers/1/a.json", "t", AT[1], 9, None, '{"layer": 1, "segment_id": 7}\n{"layer": 1, "segm'),
        (4, "s/layers/1/c.json", "s", AT[2], 0, "broken", ""),
        (5, "s/layers/1/d.json", "s", AT[3], 0, "{}", None),
        (6, "s/layers/1/e.json", "s", None, 0, '{"depth": null}', '{"layer": 1, "segment_id": 8}'),
        (7, "s/layers/1/f.json", "s", AT[4], 0, '{"depth": [1]}', '[{"layer":1}]\n3\n"x"\n{"layer": 1, "segment_id": 7} x\n{"layer": 1, "segment_id": 7}{}'),
        (8, "s/layers/1/g.json", "s", AT[5], 0, '{"depth": 2}', long),
        (9, "s/layers/1/h.json", "s", AT[6], 0, '{"depth": 2}', '{"segment_id": 7}\n{"segment_id": 7}'),
    ]
    done = small_files.consolidate(spark, table(spark, tmp_path, rows))
    got = {(r.file_id, r.line_no) for r in small_files.repeated(done).collect()}
    files = [dict(zip(SCHEMA.replace(",", "").split()[::2], r, strict=False)) for r in rows if r[0] != 9]
    assert got == brute.p2(files)
    kept = done.kept.collect()
    assert len(kept) == done.packed.rows == len({(r.stack, r.file_key, r.line_no) for r in kept})
    assert {r.depth for r in kept if r.stack == "s"} == {4}
    assert sum(r.file_id == 9 for r in kept) == 2  # records that nothing identifies stay


def test_empty_table(spark, tmp_path):
    done = small_files.consolidate(spark, table(spark, tmp_path, []))
    assert done.kept.count() == done.staged.count() == small_files.repeated(done).count() == 0


def test_folder_of_tiny_files(spark, tmp_path):
    source, target = str(tmp_path / "tiny"), str(tmp_path / "packed")
    df = spark.range(1000).withColumn("t", F.when(F.col("id") % 3 > 0, F.lit("x")))
    df.unionByName(df.limit(10)).repartition(60).write.parquet(source)
    done = small_files.compact_folder(spark, source, target)
    assert done.rows == 1010
    assert len([f for f in (tmp_path / "packed").iterdir() if f.suffix == ".parquet"]) == 1
    back = spark.read.parquet(target)
    assert back.exceptAll(spark.read.parquet(source)).count() == 0 and back.count() == 1010


def test_a_lossy_write_is_noticed(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(small_files, "_sums", lambda df: [F.count(F.lit(1)).alias("rows"), F.sum(F.lit(len(calls.append(1) or calls))).alias("checksum")])
    with pytest.raises(RuntimeError):
        small_files.write_verified(spark.range(5), str(tmp_path / "x"), 1)
