import json

from leafweave.streaming import annotations


def test_new_pages_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"book": "b", "at": "2020-01-01T00:00:00Z", "pageNumber": n % 3, "layout": "two_column", "isChapterStart": False, "hasFootnotes": False, "isBackMatter": False} for n in range(6)]
    (source / "one.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        annotations.write(annotations.fresh(annotations.read(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.pageNumber for r in got.collect()) == [0, 1, 2]
