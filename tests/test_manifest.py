"""Files against a manifest of their sizes and digests."""

from __future__ import annotations

from weft.operators.records import is_current, manifest_diff
from weft.sources.io import file_digests


def test_files_against_their_manifest(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_text(f"file {name}")
    before = file_digests(spark, str(tmp_path)).collect()
    manifest = spark.createDataFrame(before, "path string, bytes long, sha256 string")
    assert is_current(file_digests(spark, str(tmp_path)), manifest)
    (tmp_path / "a").write_text("file x")
    (tmp_path / "b").write_text("file b, longer")
    (tmp_path / "c").unlink()
    (tmp_path / "e").write_text("new")
    found = file_digests(spark, str(tmp_path))
    got = {r["path"][-1]: r["status"] for r in manifest_diff(found, manifest).collect()}
    assert got == {"a": "changed", "b": "resized", "c": "missing", "d": "same", "e": "extra"}
    assert not is_current(found, manifest)


def test_manifests_at_the_edges(spark):
    make = lambda *rows: spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    found = make(("p", 1, "AB"), ("q", 1, None), ("r", None, "ab"), ("s", 1, "ab"), ("s", 1, "ab"), (None, 1, "ab"))
    listed = make(("p", 1, "ab"), ("q", 1, "ab"), ("r", 1, "ab"), ("s", 1, "ab"), (None, 1, "ab"))
    got = {r["path"]: r["status"] for r in manifest_diff(found, listed).collect()}
    assert got == {"p": "same", "q": "changed", "r": "resized", "s": "repeated", None: "same"}
    assert manifest_diff(found.limit(0), listed.limit(0)).count() == 0 and is_current(found.limit(0), listed.limit(0))
