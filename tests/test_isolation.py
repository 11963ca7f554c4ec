"""Failures stay with their items."""

import pytest

from brindle.operators import isolation


def facts(data):
    text = data.decode()
    if not text.strip():
        raise ValueError("empty file")
    return {"words": len(text.split()), "first": text.split()[0]}


def test_a_folder_with_bad_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in (("a.md", b"one two"), ("b.md", b" \n"), ("deep/c.md", b"\xff\xfe\x00"), ("d.txt", b"not taken"), ("deep/e.md", b"three")):
        (tmp_path / name).write_bytes(data)
    got = isolation.isolated(isolation.folder_items(spark, str(tmp_path), "*.md"), facts, "words long, first string").cache()
    rows = {r.key.rpartition("/")[2]: (r.status, r.words, r.first) for r in got.collect()}
    assert rows == {"a.md": ("done", 2, "one"), "b.md": ("failed", None, None), "c.md": ("failed", None, None), "e.md": ("done", 1, "three")}
    report = isolation.batch_report(got).first()
    assert (report["items"], report.done, report.failed, report.errors) == (4, 2, 2, ["UnicodeDecodeError x1", "ValueError x1"])


def test_nulls_wrong_types_and_no_items(spark):
    items = spark.createDataFrame([(1, "5"), (2, None), (3, "x"), (4, "99999999999999999999"), (5, "7")], "k long, v string")
    got = {r.k: (r.status, r.n, (r.error or "").split(":")[0]) for r in isolation.isolated(items, lambda v: {"n": int(v)}, "n long", "k", "v").collect()}
    assert {k: x[:2] for k, x in got.items()} == {1: ("done", 5), 2: ("failed", None), 3: ("failed", None), 4: ("failed", None), 5: ("done", 7)}
    assert got[2][2] == "TypeError" and got[3][2] == "ValueError"
    none = isolation.isolated(items.limit(0), lambda v: {"n": 1}, "n long", "k", "v")
    assert none.collect() == [] and isolation.batch_report(none).first()["items"] == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_more_items_than_a_slice(spark, parts):
    items = spark.range(1000).selectExpr("id as key", "id as value").repartition(parts)

    def odd(v):
        if v % 3 == 0:
            raise RuntimeError(f"bad {v}")
        return {"double": 2 * v}

    got = isolation.isolated(items, odd, "double long", at_once=64)
    assert {(r.key, r.status, r.double) for r in got.collect()} == {(i, "failed", None) if i % 3 == 0 else (i, "done", 2 * i) for i in range(1000)}
