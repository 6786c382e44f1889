"""Archives and trees whose entries aren't as they should be."""

import io
import zipfile

from millrace.operators.conversations import file_view
from millrace.operators.indexing import diff_files, purged_cache
from millrace.sources import files as S
from millrace.sources.files import by_bytes, list_tree, read_archives, read_tree


def archive(entries, damage=None):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    data = bytearray(held.getvalue())
    if damage:
        at = bytes(data).index(damage)
        data[at] ^= 1
    return bytes(data)


def test_an_archive_is_refused_as_a_whole(spark):
    rows = [("good", archive([("a", "1"), ("d/b", "22")])), ("crc", archive([("a", "fine"), ("b", "spoiled-bytes")], b"spoiled-bytes")), ("up", archive([("a", "1"), ("../b", "2")])), ("none", None), ("junk", b"no archive"), ("empty", archive([]))]
    got = read_archives(spark.createDataFrame(rows, "project_id string, content binary")).collect()
    assert sorted((r.path, bytes(r.content)) for r in got if r.project_id == "good") == [("a", b"1"), ("d/b", b"22")]
    for bad in ("crc", "up", "none", "junk"):
        assert [(r.path, r.error is not None) for r in got if r.project_id == bad] == [(None, True)]
    assert not [r for r in got if r.project_id == "empty"]


def test_pruned_directories_are_not_listed(spark, tmp_path):
    for name in ("src/a.ts", "node_modules/x/b.ts", "src/dist/c.ts", ".env", "distx/d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = read_tree(spark.createDataFrame([("p", f"file://{tmp_path}")], "project_id string, root string")).collect()
    assert sorted(r.path for r in got) == [".env", "distx/d.ts", "src/a.ts"]


def test_views_are_clamped_and_need_an_index(spark):
    files = spark.createDataFrame([("p", "a", [str(i) for i in range(1, 11)])], "project_id string, path string, lines array<string>")
    ranges = spark.createDataFrame([("p", "a", 2, 3), ("p", "a", 9, 40), ("p", "other", 1, 2)], "project_id string, path string, start_line int, end_line int")
    got = {r.start_line: (r.context_start, r.context_end, r.view) for r in file_view(ranges, files, 2).collect()}
    assert got == {2: (1, 5, ["1", "2", "3", "4", "5"]), 9: (7, 10, ["7", "8", "9", "10"])}


def test_diffs_of_null_hashes_and_keys(spark):
    kind = "project_id string, path string, content_hash string"
    now = spark.createDataFrame([("p", "a", None), (None, "b", "1"), ("p", None, "2"), ("p", "c", None)], kind)
    was = spark.createDataFrame([("p", "a", None), (None, "b", "0"), ("p", "d", None)], kind)
    got = {(r.project_id, r.path): r.state for r in diff_files(now, was).collect()}
    assert got == {("p", "a"): "unchanged", (None, "b"): "changed", ("p", None): "new", ("p", "c"): "new", ("p", "d"): "stale"}


def test_purged_cache(spark):
    cache = spark.createDataFrame([("m", "a", [1.0]), ("m", "b", [1.0, 2.0]), ("m", "c", None), ("n", "d", [1.0])], "model_id string, text_hash string, embedding array<float>")
    assert sorted(r.text_hash for r in purged_cache(cache, "m", 2).collect()) == ["b", "d"]


def test_one_deep_project_is_listed_level_by_level(spark, tmp_path):
    for name in ("a", "s/b", "s/t/c", "s/t/u/d", "s/t/u/v/e", ".git/x", "z/_f", "z/.g", "s/ü n/h"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "nothing").write_text("")
    root = f"file://{tmp_path}"
    roots = spark.createDataFrame([("p", root), ("p", root), ("q", root + "/s/"), ("gone", root + "/no-such"), ("null", None), (None, root + "/z")], "project_id string, root string")
    got = {(r.project_id, r.path): bytes(r.content).decode() for r in read_tree(roots).collect()}
    below = {n: n for n in ("a", "s/b", "s/t/c", "s/t/u/d", "s/t/u/v/e", "z/_f", "z/.g", "s/ü n/h")} | {"nothing": ""}
    want = {("p", n): t for n, t in below.items()} | {("q", n[2:]): t for n, t in below.items() if n[:2] == "s/"} | {(None, n[2:]): t for n, t in below.items() if n[:2] == "z/"}
    assert got == want
    assert list_tree(roots.limit(0)).count() == 0 and read_tree(roots.limit(0)).count() == 0
    assert {r.path for r in read_tree(roots.filter("project_id = 'p'"), 1).collect() if r.content is None} == {n for n, t in below.items() if len(t.encode()) > 1}


def test_files_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(S, "OPEN_BYTES", 10)
    rows = [("p", "r", f"f{i}", 990 if i % 10 == 0 else 90) for i in range(200)]
    dealt = by_bytes(spark.createDataFrame(rows, S.LISTED), S.F.col("size"), 3_800)
    held = {}
    for r in dealt.withColumn("part", S.F.spark_partition_id()).collect():
        held.setdefault(r.part, []).append(r.size + 10)
    assert dealt.rdd.getNumPartitions() == 10 and sum(map(len, held.values())) == 200
    assert max(map(sum, held.values())) < 3_800 + 1_000
