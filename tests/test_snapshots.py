"""The versioned index: what is rewritten, what survives a dead writer, what a replay changes."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import indexing as I
from millrace.operators import snapshots as S

KIND = "project_id string, path string, text string, seq int"


def texts(spark, rows):
    return spark.createDataFrame([(*r, 0)[:4] if len(r) == 3 else r for r in rows], KIND).withColumn("bucket", F.lit("x")).withColumn("was", F.lit(1))


def state(spark, folder):
    chunks = S.read_snapshot(spark, folder, "chunks").select("chunk_id", "project_id", "path", "ord", "content", "content_hash").collect()
    return sorted(map(tuple, chunks)), sorted(map(tuple, S.read_snapshot(spark, folder, "files").collect()))


def whole(spark, rows):
    """The index of all files at once."""
    walked = spark.createDataFrame([r[:3] for r in rows], "project_id string, path string, text string")
    files, chunks = I.build_index(walked, spark.createDataFrame([], S.FILES), spark.createDataFrame([], S.CHUNKS))
    return sorted(map(tuple, chunks.select("chunk_id", "project_id", "path", "ord", "content", "content_hash").collect())), sorted(map(tuple, files.collect()))


def corpus():
    return [(f"p{i % 3}", f"src/f{i}.ts", "\n".join(f"line {i} {j}" for j in range(i * 7))) for i in range(30)]


def test_changes_rewrite_their_buckets_alone(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/index", corpus()
    first = S.apply_batch(spark, folder, texts(spark, rows), buckets=8)
    assert first["number"] == 1 and state(spark, folder) == whole(spark, rows)
    assert S.apply_batch(spark, folder, texts(spark, rows)) == first  # nothing new
    rows[4] = ("p1", "src/f4.ts", "changed\n")
    second = S.apply_batch(spark, folder, texts(spark, [rows[4], rows[5]]))
    assert sum(first["buckets"][b] != v for b, v in second["buckets"].items()) == 1
    assert state(spark, folder) == whole(spark, rows)
    # A project without files has no rows.
    S.apply_batch(spark, folder, texts(spark, [(p, f, None) for p, f, _ in rows if p == "p2"] + [("p2", "never/there.ts", None)]))
    assert state(spark, folder) == whole(spark, [r for r in rows if r[0] != "p2"])
    old = state_at = S.read_snapshot(spark, folder, "files", at=first)
    assert old.count() == 30 and state_at is old
    S.expire(spark, folder, 1)
    assert len(os.listdir(f"{tmp_path}/index/manifests")) <= 2 and state(spark, folder) == whole(spark, [r for r in rows if r[0] != "p2"])


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    folder, rows = f"file://{tmp_path}/index", corpus()
    S.apply_batch(spark, folder, texts(spark, rows), "s", 0)
    before = state(spark, folder)

    def die(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(S, "_put", die)
        with pytest.raises(RuntimeError):
            S.apply_batch(spark, folder, texts(spark, [("p0", "src/f0.ts", "new")]), "s", 1)
    assert state(spark, folder) == before
    S.apply_batch(spark, folder, texts(spark, [("p0", "src/f0.ts", "new")]), "s", 1)
    assert ("p0", "src/f0.ts", "ts") in {f[:3] for f in state(spark, folder)[1]}
    # The same number can't be written twice.
    with pytest.raises(ValueError):
        S._put(spark, folder, {"number": 2})


def test_odd_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    odd = [(None, "a.ts", "x", 0), ("p", None, "x", 0), ("p", "a.ts", "old", 1), ("p", "a.ts", "new", 2), ("p", "b.ts", "x", 3), ("p", "b.ts", None, 4), ("p", "c.ts", "", 0), ("p", "d.ts", "tie", 0), ("p", "d.ts", None, 0)]
    S.apply_batch(spark, folder, texts(spark, odd))
    assert state(spark, folder) == whole(spark, [("p", "a.ts", "new"), ("p", "c.ts", ""), ("p", "d.ts", "tie")])
    empty = f"file://{tmp_path}/none"
    assert S.apply_batch(spark, empty, texts(spark, odd).limit(0))["number"] == 0 and state(spark, empty) == ([], [])


def test_a_stream_that_is_killed_and_replays_a_batch(spark, tmp_path, monkeypatch):
    folder, source, rows = f"file://{tmp_path}/index", f"{tmp_path}/in", corpus()
    parts = [rows[:12], rows[12:], [("p0", "src/f3.ts", "again"), ("p1", "src/f4.ts", None)]]
    for n, part in enumerate(parts):
        texts(spark, part).coalesce(1).write.mode("append").parquet(source)
        os.utime(max((os.path.join(source, f) for f in os.listdir(source) if f.endswith(".parquet")), key=os.path.getmtime), (1e9 + n, 1e9 + n))

    def run():
        stream = spark.readStream.schema(texts(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
        S.continuous_index(stream, folder, f"{tmp_path}/checkpoint").awaitTermination()

    apply, numbers = S.apply_batch, []

    def killed(*a, **b):
        done = apply(*a, **b)
        numbers.append(done["number"])
        if len(numbers) == 2:
            raise RuntimeError("killed after the swap, before the stream knows")
        return done

    monkeypatch.setattr(S, "apply_batch", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert numbers == [1, 2, 2, 3]  # the second batch came twice and made one snapshot
    left = [r for r in rows if r[1] not in ("src/f3.ts", "src/f4.ts")] + [("p0", "src/f3.ts", "again")]
    assert state(spark, folder) == whole(spark, left)
