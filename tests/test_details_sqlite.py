"""Extraction details and SQLite files."""

import json
import sqlite3

from pyspark.sql import functions as F

from potluck.functions import details as d
from potluck.operators.store import RecipeStore
from potluck.sources.sqlite import import_recipes, read_sqlite, write_sqlite


def test_accessors(spark):
    df = spark.createDataFrame([('{"extraction": {"ingredients": {"confidence": 0.85, "strategy": "s"}}}',), ("{}",), (None,), ("no json",)], "m string")
    got = df.select(d.extraction_confidence(F.col("m"), "ingredients"), d.extraction_strategy(F.col("m"), "ingredients")).collect()
    assert [tuple(r) for r in got] == [(0.85, "s"), (None, None), (None, None), (None, None)]


def test_merge(spark):
    rows = [
        (None, '{"a":1}', {"extraction": {"x": {"a": 1}}}),
        ('{"k":"v \\"q\\"","extraction":{"y":{"b":2},"x":{"old":0}}}', '{"a":1}', {"k": 'v "q"', "extraction": {"y": {"b": 2}, "x": {"a": 1}}}),
        ('{"k":1}', "{}", {"k": 1}),
        ('{"k":true}', None, {"k": True}),
    ]
    df = spark.createDataFrame([(i, m, x) for i, (m, x, _) in enumerate(rows)], "i int, m string, x string")
    got = [json.loads(r[0]) for r in df.orderBy("i").select(d.merge_extraction(F.col("m"), F.col("x"), "x")).collect()]
    assert got == [w for _, _, w in rows]


def test_with_confidence(spark):
    df = spark.createDataFrame([("2 cups flour\n1 tsp salt\n\n3 large eggs",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(d.with_confidence(F.col("x"))).collect()]
    assert got[0]["line_count"] == 3 and got[0]["confidence"] > 0.5 and got[0]["components"]["measurement"] == 0.85
    assert [(g["text"], g["confidence"], g["components"], g["line_count"]) for g in got[1:]] == [(None, 0.0, None, 0)] * 2
    assert spark.createDataFrame([(" a \n\n b",)], "x string").select(d.normalize_whitespace(F.col("x"))).first()[0] == "a\nb"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "r.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE recipes (id INTEGER PRIMARY KEY, title TEXT NOT NULL, book TEXT, quality_score INTEGER, tags TEXT, metadata TEXT, created_at TIMESTAMP)")
        c.execute("CREATE TABLE tags (id INTEGER PRIMARY KEY, tag_name TEXT)")
        c.execute("CREATE TABLE recipe_tags (recipe_id INTEGER, tag_id INTEGER)")
        c.executemany("INSERT INTO recipes VALUES (?, ?, 'B', ?, NULL, NULL, '2025-01-01')", [(i * 7, f"t{i}", None if i == 3 else i) for i in range(50)])
        c.executemany("INSERT INTO tags VALUES (?, ?)", [(1, "x"), (2, "y")])
        c.executemany("INSERT INTO recipe_tags VALUES (?, ?)", [(7, 1), (7, 2), (14, 2)])
    rows = read_sqlite(spark, path, "recipes", rows_per_task=60).orderBy("id").collect()
    assert [r["title"] for r in rows] == [f"t{i}" for i in range(50)] and rows[3]["quality_score"] is None
    store = RecipeStore(spark, str(tmp_path / "store"))
    assert import_recipes(spark, path, store) == 50
    assert {r["tag_name"]: r["count"] for r in store.list_tags().collect()} == {"x": 1, "y": 2}
    copy = str(tmp_path / "copy.db")
    assert write_sqlite(store.recipes.select("title", "quality_score"), copy, "recipes") == 50
    assert read_sqlite(spark, copy, "recipes").agg(F.sum("quality_score")).first()[0] == sum(range(50)) - 3
