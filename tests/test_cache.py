"""The stored cache of parsed files: one changed file rewrites one bucket."""

import os

from pyspark.sql import functions as F

from topograph.plans import project
from topograph.sources import parse, tree


def written(path):
    return {d: max(os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}


def rows(*files):
    return [(p, sha, "python", "symbol", 0, "class", p, None, None, 1, 0, False) for p, sha in files]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "cache")
    frame = lambda *x: spark.createDataFrame(rows(*x), parse.SCHEMA)
    many = [(f"d/f{i}.py", "1") for i in range(60)]
    tree.store_cache(frame(*many), path)
    before = written(path)
    load = lambda: tree.stored_cache(spark, path, parse.SCHEMA)
    assert len(before) > 30 and {(r.path, r.sha1) for r in load().collect()} == set(many) and load().columns == frame(*many).columns
    tree.store_cache(frame(*many), path, load())
    assert written(path) == before
    changed = [("d/f0.py", "2"), *many[1:]]
    tree.store_cache(frame(*changed), path, load())
    after = written(path)
    bucket = frame(("d/f0.py", "2")).select(tree.bucket_of(F.col("path"))).first()[0]
    assert {d for d in after if after[d] != before.get(d)} == {f"bucket={bucket}"}
    assert {(r.path, r.sha1) for r in load().collect()} == set(changed)
    tree.store_cache(frame(*changed[1:]), path, load())  # the bucket keeps its other files, or one row of nulls
    assert {(r.path, r.sha1) for r in load().collect()} == set(many[1:])
    tree.store_cache(frame(*changed[1:], ("new.py", "1")), path, load())
    assert {(r.path, r.sha1) for r in load().collect()} == {*many[1:], ("new.py", "1")}


def test_caches_of_another_shape_are_none(spark, tmp_path):
    flat = str(tmp_path / "flat")
    spark.createDataFrame(rows(("a.py", "1")), parse.SCHEMA).write.parquet(flat)
    assert tree.stored_cache(spark, flat, parse.SCHEMA) is None and tree.stored_cache(spark, str(tmp_path / "no"), parse.SCHEMA) is None
    tree.store_cache(spark.createDataFrame(rows(("a.py", "1")), parse.SCHEMA), flat)
    assert tree.stored_cache(spark, flat, parse.SCHEMA).count() == 1
    moved = str(tmp_path / "moved")
    spark.createDataFrame(rows(("a.py", "1")), parse.SCHEMA).selectExpr("*", "999 AS bucket").write.partitionBy("bucket").parquet(moved)
    assert tree.stored_cache(spark, moved, parse.SCHEMA) is None


def test_files_without_rows_are_not_parsed_again(spark, tmp_path, monkeypatch):
    root, cache = tmp_path / "tree", str(tmp_path / "cache")
    root.mkdir()
    (root / "a.py").write_text("import b\n")
    (root / "b.py").write_text("x = 1\n")
    project.scan(spark, str(root), cache_path=cache)
    asked = []
    real = tree.to_parse
    monkeypatch.setattr(tree, "to_parse", lambda files, old: asked.append({r.path for r in real(files, old).select("path").collect()}) or real(files, old))
    again = project.scan(spark, str(root), cache_path=cache)
    assert asked == [set()] and {(r.src, r.dst) for r in again.edges.collect()} == {("a.py", "b.py")}
    (root / "a.py").unlink()
    assert project.scan(spark, str(root), cache_path=cache).edges.isEmpty()
    assert {r.path for r in project.saved_cache(spark, cache).collect()} == {"b.py"}
