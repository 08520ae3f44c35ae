"""Saves that are killed at any point leave the version before them, and every version can be gone back to."""

import json

import pytest

from trackloom.sources import versioned as V

SCHEMA = "id string, n long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).repartition(3)


def now(spark, path, version=None):
    return {r.key: (r.content_version, r.n) for r in V.read(spark, path, SCHEMA, version).collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path)
    assert V.content_version(path) == 0 and now(spark, path) == {}
    V.save(rows(spark, ("a", 1), ("b", 2), (None, 9)), path, "id")
    V.save(rows(spark, ("b", 3), ("c", 4)), path, "id")
    assert now(spark, path) == {"a": (1, 1), "b": (2, 3), "c": (2, 4)} and V.content_version(path) == 2
    assert now(spark, path, 1) == {"a": (1, 1), "b": (1, 2)}
    V.save(rows(spark, ("z", 0)), path, "id", full=True)
    assert now(spark, path) == {"z": (3, 0)}
    V.restore(path, 2)
    assert {k: n for k, (_, n) in now(spark, path).items()} == {"a": 1, "b": 3, "c": 4} and V.content_version(path) == 5
    V.restore(path, 1)
    assert {k: n for k, (_, n) in now(spark, path).items()} == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        now(spark, path, 99)


def test_killed_between_steps(spark, tmp_path):
    path = str(tmp_path)
    V.save(rows(spark, ("a", 1)), path, "id")
    # after tasks have written, before the version is drafted; after the draft, before its renaming; a task that failed half-way
    writer = V.DocumentWriter(path, False)
    message = writer.write(iter([{"key": "a", "body": json.dumps({"id": "a", "n": 2})}]))
    assert now(spark, path) == {"a": (1, 1)}
    (tmp_path / "versions" / "2.json.draft").write_text(json.dumps({"contentVersion": 2, "full": False, "files": [message.file]}))
    (tmp_path / "data" / "broken").mkdir()
    (tmp_path / "data" / "broken" / "part-x.json").write_text('{"key": "a", "bo')
    assert now(spark, path) == {"a": (1, 1)}
    writer.commit([message, None, V.Written(None)])
    assert now(spark, path) == {"a": (2, 2)}
    gone = V.DocumentWriter(path, False)
    gone.write(iter([{"key": "a", "body": "{}"}]))
    gone.abort([])
    gone.abort([])
    assert now(spark, path) == {"a": (2, 2)} and not (tmp_path / "data" / gone.save).exists()


def test_a_failing_save_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    V.save(rows(spark, ("a", 1)), path, "id")
    bad = rows(spark, ("a", 2), ("b", 0)).selectExpr("id", "n", "1 / n as x")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        V.save(bad, path, "id")
    assert now(spark, path) == {"a": (1, 1)} and V.content_version(path) == 1
    V.save(rows(spark, ("x", 1)).where("n > 5"), path, "id")
    assert now(spark, path) == {"a": (1, 1)} and V.content_version(path) == 2
