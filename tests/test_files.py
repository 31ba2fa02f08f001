"""Text files and saved datasets."""

from ragmill.sources import files


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één\ntwo".encode() + b"\xff")
    (tmp_path / "b.md").write_text("x")
    (tmp_path / "c.bin").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.text_files(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"].text == "één\ntwo�" and got["a.txt"].line_count == 2
    assert (got["b.md"].format, got["b.md"].file_size) == ("MD", 1)


def test_datasets(spark, tmp_path):
    pairs = spark.createDataFrame([("q1", "a1", 1, 0, "f"), ("q2", "a2", 1, 1, "f")], files.QA)
    path = files.save_dataset(pairs, f"file://{tmp_path}", 3, "20240101", "x")
    files.save_dataset(pairs.limit(1), f"file://{tmp_path}", 4, "20240101")
    assert files.load_dataset(spark, path).count() == 2
    got = files.list_datasets(spark, f"file://{tmp_path}", 3).collect()
    assert [(r.name, r.pair_count) for r in got] == [("kb_3_20240101_x", 2)]
