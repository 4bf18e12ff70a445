"""The store, its queries and the A/B statistics."""

import json

import pytest
from pyspark.sql import functions as F

from potluck.operators import abtest, quality, store
from potluck.operators.store import RecipeStore

SCHEMA = "title string, book string, ingredients string, instructions string, quality_score int, tags array<string>, metadata string"
ROWS = [
    ("Ribs", "Fire", "2 lbs pork 100%", "Smoke it", 80, ["BBQ", " bbq ", "pork", ""], None),
    ("Soup", "Water", None, "Boil_it", 50, ["quick"], None),
    ("Stew", "Fire", "beef", "a\\b it", 50, ["bbq", "quick", "pork"], None),
    ("Plain", "Water", "x", None, 10, None, None),
    (None, "Water", "no title", "x", 90, ["lost"], None),
]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    s = RecipeStore(spark, str(tmp_path_factory.mktemp("store")))
    assert s.save(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)) == 4
    return s


def names(df):
    return [r["title"] for r in df.collect()]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    s = RecipeStore(spark, path)
    assert s.version() == 2 and s.count() == 0 and s.list_tags().count() == 0
    again = RecipeStore(spark, path)
    assert again.version() == 2 and spark.read.parquet(path + "/schema_version").count() == 2
    assert s.save(spark.createDataFrame([], SCHEMA)) == 0


def test_saved_rows(shop):
    assert shop.count() == 4 and shop.recipes.select("id").distinct().count() == 4
    assert shop.recipes.where("created_at is null").count() == 0
    assert names(shop.query()) == ["Ribs", "Soup", "Stew", "Plain"]


def test_tags_are_normal_and_unique(shop):
    assert sorted(r["tag_name"] for r in shop.tags.collect()) == ["bbq", "pork", "quick"]
    assert [tuple(r) for r in shop.list_tags().collect()] == [("bbq", 2), ("pork", 2), ("quick", 2)]
    got = {r["title"]: (r["tags"], r["metadata"]) for r in shop.query().collect()}
    assert got["Ribs"] == (["bbq", "pork"], "{}") and got["Plain"] == ([], "{}")


def test_unused_tag_counts_zero(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b")], "id long, tag_name string")
    links = spark.createDataFrame([(7, 1), (8, 1)], "recipe_id long, tag_id long")
    assert [tuple(r) for r in store.tag_counts(links, tags).collect()] == [("a", 2), ("b", 0)]


def test_a_key_is_saved_once_and_batches_are_whole(spark, tmp_path):
    s = RecipeStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert s.save(rows, key="a#1") == 4 == s.save(rows, key="a#1") and s.count() == 4
    # what a save leaves behind that never came to its manifest is not seen
    s.recipes.withColumn("id", F.col("id") + 100).write.parquet(f"{s.path}/recipes/batch-lost")
    s.tags.withColumn("tag_name", F.lit("lost")).write.parquet(f"{s.path}/tags/batch-lost")
    assert s.count() == 4 and "lost" not in {r["tag_name"] for r in s.tags.collect()}


def test_two_writers_do_not_collide(spark, tmp_path):
    a = RecipeStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame(ROWS, SCHEMA)
    a.save(rows)
    commit, seen = a._commit, []

    def late(number, content):
        if not seen:  # another writer is done just before
            seen.append(1)
            RecipeStore(spark, a.path).save(rows.withColumn("tags", F.array(F.lit("new"), F.lit("bbq"))))
        return commit(number, content)

    a._commit = late
    a.save(rows.withColumn("tags", F.array(F.lit("new"))))
    assert a.count() == 12 == a.recipes.select("id").distinct().count()
    assert sorted(r["tag_name"] for r in a.tags.collect()) == ["bbq", "new", "pork", "quick"] and a.tags.select("id").distinct().count() == 4
    assert {r["tag_name"]: r["count"] for r in a.list_tags().collect()} == {"new": 8, "bbq": 6, "pork": 2, "quick": 2}
    before = sorted(map(tuple, a.query().select("id", "title", "tags").collect()))
    a.compact()
    assert sorted(map(tuple, a.query().select("id", "title", "tags").collect())) == before and a.save(rows) == 4 and a.count() == 16


def test_filters(shop):
    assert names(shop.query({"book": "Fire"})) == ["Ribs", "Stew"]
    assert names(shop.query({"book": "Fire", "title": None}, min_quality=60)) == ["Ribs"]
    assert shop.count({"book": "Water"}) == 2 and shop.count({"quality_score": 50}) == 2
    with pytest.raises(ValueError):
        shop.query({"ingredients": "x"})
    with pytest.raises(ValueError):
        shop.count({"id; drop": 1})


def test_tag_queries(shop):
    assert names(shop.query(tags=["BBQ", "quick"])) == ["Stew"]
    assert names(shop.query(tags=["bbq", "quick"], tags_match_all=False)) == ["Ribs", "Soup", "Stew"]
    assert names(shop.query(tags=["bbq", "bbq"])) == []  # a tag named twice can't be met
    assert names(shop.query(tags=[" bbq"])) == []  # wanted tags are not stripped
    assert set(names(shop.query(tags=["bbq", "pork"]))) <= set(names(shop.query(tags=["bbq", "pork"], tags_match_all=False)))


def test_limits(shop):
    assert len(names(shop.query(limit=2))) == 2 and len(names(shop.query(limit=0))) == 4
    assert names(shop.search("i", limit=0)) == [] and len(names(shop.search("i", limit=-1))) == 4


def test_search(shop):
    assert names(shop.search("FIRE")) == []  # the book is not searched
    assert names(shop.search("SMOKE")) == ["Ribs"]
    assert names(shop.search("b_il")) == ["Soup"] and names(shop.search("s%up")) == ["Soup"]  # wild cards stay wild
    assert names(shop.search("a\\b")) == ["Stew"]
    assert names(shop.search("it", tags=["QUICK"])) == ["Soup", "Stew"]


def test_saving_twice_stores_twice_and_tags_once(spark, tmp_path):
    s = RecipeStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame(ROWS, SCHEMA)
    s.save(rows)
    s.save(rows)
    assert s.count() == 8 and s.tags.count() == 3 and s.recipes.select("id").distinct().count() == 8
    s.add_tags(s.recipes.where("title = 'Plain'").select("id", F.array(F.lit("New"), F.lit("bbq")).alias("tags")))
    s.add_tags(s.recipes.where("title = 'Plain'").select("id", F.array(F.lit("New")).alias("tags")))
    assert {r["tag_name"]: r["count"] for r in s.list_tags().collect()} == {"bbq": 6, "pork": 4, "quick": 4, "new": 2}


AB = [
    ("a", "x", {"ab_test": {"agreement": True, "old_success": True, "new_success": True, "confidence": 0.5, "strategy": "s"}}),
    ("b", "x", {"ab_test": {"agreement": False, "old_success": False, "new_success": True, "confidence": None, "strategy": "s"}}),
    ("c", "x", {"ab_test": {"agreement": False, "old_success": True, "new_success": False, "confidence": 0.9, "strategy": None}}),
    ("d", "x", {"other": 1}),
    ("e", "x", None),
]


def ab(spark, rows=AB):
    return spark.createDataFrame([(t, b, m and json.dumps(m)) for t, b, m in rows], "title string, book string, metadata string")


def test_ab_statistics(spark):
    r = abtest.statistics(ab(spark)).first()
    assert r["total_tests"] == 3 and abs(r["agreement_rate"] - 100 / 3) < 1e-9 and abs(r["old_success_rate"] - 200 / 3) < 1e-9 and abs(r["avg_confidence"] - 0.7) < 1e-9
    assert tuple(abtest.statistics(ab(spark, AB[3:])).first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_ab_disagreements_and_report(spark):
    assert [(r["title"], r["confidence"]) for r in abtest.disagreements(ab(spark)).collect()] == [("c", 0.9), ("b", None)]
    text = abtest.report(ab(spark))
    assert "DISAGREEMENTS (2 cases)" in text and "Total tests:        3" in text and "Confidence: N/A, Strategy: s" in text
    assert "NO DISAGREEMENTS FOUND" in abtest.report(ab(spark, AB[:1]))


def test_compare(spark):
    d = F.struct(F.lit(0.4).alias("confidence"), F.lit(None).cast("double").alias("linguistic_score"), F.lit("s").alias("strategy"), F.lit(None).cast("boolean").alias("used_structural_detector"))
    r = spark.range(1).select(abtest.compare(F.lit("x" * 25), F.lit("y" * 26), d).alias("c")).first()["c"]
    assert (r["old_success"], r["new_success"], r["agreement"], r["old_length"], r["linguistic_score"], r["used_structural_detector"]) == (False, True, False, 25, 0.0, False)


def test_tiers(spark):
    r = quality.tiers(spark.createDataFrame([(x,) for x in (70, 69, 50, 49, 30, 29)], "quality_score int")).first()
    assert (r["total"], r["average"], r["excellent"], r["good"], r["fair"], r["poor"], r["poor_pct"]) == (6, 49.5, 1, 2, 2, 1, 16.7)
    none = quality.tiers(spark.createDataFrame([], "quality_score int")).first()
    assert (none["total"], none["average"], none["excellent_pct"]) == (0, 0.0, 0.0)


def test_data_quality(spark):
    df = spark.createDataFrame([("4",), ("",), (None,), ("abc",), ("abc",), (" 12x",), ("-3",)], "serves string")
    r = quality.completeness(df, ["serves"]).first()
    assert tuple(r) == ("serves", 7, 2, 2, 2)
    assert [tuple(x) for x in quality.top_garbage(df, "serves").collect()] == [("abc", 2)]


def test_saved_rows_are_written_once_also_when_another_writer_is_faster(spark, tmp_path, monkeypatch):
    s = RecipeStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "b", ["x"]), ("c", "d", ["y", "x"])], "title string, book string, tags array<string>")
    assert s.save(rows) == 2
    # the files are those that the rows were first written to, with the tags beside them
    assert "__tags" in spark.read.parquet(*s.recipes.inputFiles()).columns and "__tags" not in s.recipes.columns
    real, other = RecipeStore._commit, []

    def late(self, number, content):
        if not other:
            other.append(RecipeStore(spark, self.path))
            monkeypatch.setattr(RecipeStore, "_commit", real)
            other[0].save(rows)
            monkeypatch.setattr(RecipeStore, "_commit", late)
            return False
        return real(self, number, content)

    monkeypatch.setattr(RecipeStore, "_commit", late)
    assert s.save(rows) == 2
    got = [(r["title"], r["tags"]) for r in s.query().collect()]
    assert sorted(got) == [("a", ["x"])] * 3 + [("c", ["x", "y"])] * 3 and len({r["id"] for r in s.recipes.collect()}) == 6
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_staging")]
