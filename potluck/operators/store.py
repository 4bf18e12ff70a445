"""The recipe store: Parquet tables recipes, tags, recipe_tags and schema_version under one folder (SNK1-4, FIL9-14, JOI, AGG, SRT)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.functions import vocab as v
from potluck.functions.text import strip

from . import abtest

RECIPES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(n, T.StringType())
        for n in "title book author chapter epub_section serves prep_time cook_time ingredients instructions notes tags cooking_method protein_type difficulty".split()
    ]
    + [T.StructField("quality_score", T.IntegerType()), T.StructField("raw_content", T.StringType()), T.StructField("created_at", T.TimestampType())]
)
METADATA = T.StructField("metadata", T.StringType())
TAGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("tag_name", T.StringType())])
LINKS = T.StructType([T.StructField("recipe_id", T.LongType()), T.StructField("tag_id", T.LongType())])
VERSIONS = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("applied_at", T.TimestampType()), T.StructField("description", T.StringType())])
CURRENT = 2


def checked(filters: dict | None) -> dict:
    """The filters that have a value; a column outside the white list raises ValueError."""
    given = {k: x for k, x in (filters or {}).items() if x is not None}
    for k in given:
        if k not in v.FILTER_COLUMNS:
            raise ValueError(f"Invalid column name: {k}")
    return given


def where_equal(df: DataFrame, filters: dict | None) -> DataFrame:
    tests = [F.col(k) == F.lit(x) for k, x in checked(filters).items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def like(c: Column, query: str) -> Column:
    """%query% without regard to case; % and _ in the query stay wild, a backslash is itself."""
    return c.ilike("%" + query.replace("\\", "\\\\") + "%")


def matching(df: DataFrame, query: str) -> DataFrame:
    hit = [F.coalesce(like(F.col(c), query), F.lit(False)) for c in ("title", "ingredients", "instructions")]
    return df.where(hit[0] | hit[1] | hit[2])


def with_any_tag(recipes: DataFrame, links: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Recipes with at least one of the tags; no row twice, so nothing to make distinct."""
    ids = links.join(_wanted(tags, wanted), "tag_id").select(F.col("recipe_id").alias("id"))
    return recipes.join(ids, "id", "left_semi")


def with_all_tags(recipes: DataFrame, links: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Recipes with all of the tags; a tag named twice can't be met twice, so nothing matches."""
    ids = (
        links.join(_wanted(tags, wanted), "tag_id")
        .groupBy("recipe_id")
        .agg(F.count_distinct("tag_id").alias("n"))
        .where(F.col("n") == len(wanted))
        .select(F.col("recipe_id").alias("id"))
    )
    return recipes.join(ids, "id", "left_semi")


def _wanted(tags: DataFrame, wanted: list[str]) -> DataFrame:
    # a row per wanted tag; Spark broadcasts it if it finds it small
    return tags.where(F.lower("tag_name").isin([w.lower() for w in wanted])).select(F.col("id").alias("tag_id"))


def tag_lists(links: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, tags): the sorted tag names of each recipe that has some."""
    named = links.join(tags.select(F.col("id").alias("tag_id"), "tag_name"), "tag_id")
    return named.groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))


def attach_tags(recipes: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows as recipes: with their tags (an empty list without any) and metadata ("{}" without any)."""
    empty = F.array().cast("array<string>")
    out = recipes.drop("tags").join(tag_lists(links, tags), "id", "left")
    return out.withColumn("tags", F.coalesce("tags", empty)).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def tag_counts(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Every tag with the number of its recipes, 0 for an unused one."""
    return (
        tags.join(links, tags["id"] == links["tag_id"], "left")
        .groupBy(tags["id"], "tag_name")
        .agg(F.count("recipe_id").alias("count"))
        .select("tag_name", "count")
        .orderBy(F.col("count").desc(), "tag_name")
    )


def normal_tags(df: DataFrame, id_col: str = "id", tags_col: str = "tags") -> DataFrame:
    """(recipe_id, tag_name): stripped, lower-cased, not blank, each once."""
    one = df.select(F.col(id_col).alias("recipe_id"), F.explode(tags_col).alias("t")).select("recipe_id", F.lower(strip(F.col("t"))).alias("tag_name"))
    return one.where("tag_name <> ''").distinct()


def new_tags(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The wanted tag names, each once, that are not known yet: what insert-or-ignore would add."""
    return wanted.select("tag_name").distinct().join(known, "tag_name", "left_anti")


def by_quality(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The best first, equal ones by id; limit None is all, as is a negative one."""
    out = df.orderBy(F.col("quality_score").desc(), "id")
    return out if limit is None or limit < 0 else out.limit(limit)


class RecipeStore:
    """Tables in a folder. What is saved becomes visible all at once, when a manifest names its batch; a manifest lists every batch
    and is written under the next number, which only one of several writers gets: the others take new ids and try again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._init()

    # files

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def _delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _manifest(self) -> tuple[int, dict]:
        """The number and content of the last manifest; a store without one has what lies in its tables' own folders."""
        fs, p = self._at("_log")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()] if fs.exists(p) else []
        if not numbers:
            old = [self.spark.read.schema(s).parquet(f"{self.path}/{n}").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for n, s in (("recipes", RECIPES), ("tags", TAGS))]
            return 0, {"own": True, "batches": [], "keys": {}, "recipe_id": old[0] + 1, "tag_id": old[1] + 1}
        stream = fs.open(self._at(f"_log/{max(numbers):010d}")[1])
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return max(numbers), json.loads(text)

    def _commit(self, number: int, content: dict) -> bool:
        """Write the manifest with the next number; False if another writer has it."""
        fs, target = self._at(f"_log/{number + 1:010d}")
        _, draft = self._at(f"_log/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.exists(target) and fs.rename(draft, target):
            return True
        fs.delete(draft, False)
        return False

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        # files of older versions lack later columns, which then read as null
        _, state = self._manifest()
        folders = [""] * state["own"] + [f"/{b}" for b in state["batches"]]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}{f}" for f in folders])

    def version(self) -> int:
        """The greatest applied version, 0 for a store that does not exist."""
        if not self._exists("schema_version"):
            return 0
        return self.versions.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def set_version(self, version: int, note: str = "") -> None:
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("applied_at"), F.lit(note).alias("description"))
        self._append(row, "schema_version")

    def _init(self) -> None:
        at = self.version()
        if at == 0:
            for name, schema in (("recipes", RECIPES), ("tags", TAGS), ("recipe_tags", LINKS)):
                if not self._exists(name):
                    self._append(self.spark.createDataFrame([], schema), name)
            self.set_version(1, "First schema, with tags")
        if at < 2:
            # adding a column needs no rewrite: it is in the schema that files are read with
            self.set_version(2, "Metadata as JSON")

    @property
    def versions(self) -> DataFrame:
        return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/schema_version")

    @property
    def recipes(self) -> DataFrame:
        return self._read("recipes", T.StructType([*RECIPES.fields, METADATA]))

    @property
    def tags(self) -> DataFrame:
        return self._read("tags", TAGS)

    @property
    def recipe_tags(self) -> DataFrame:
        return self._read("recipe_tags", LINKS)

    def _move(self, name: str, to: str) -> None:
        (fs, old), (_, new) = self._at(name), self._at(to)
        if not fs.rename(old, new):
            raise OSError(f"{name} can't be moved to {to}")

    def _add(self, make: Callable[[dict, str], DataFrame], key: str | None, count: int, undo: Callable[[dict, str], None] | None = None) -> int:
        """Commit a batch. make(state, folder) puts its recipes there and gives (recipe_id, tag_name), with ids from the state on; undo takes them back."""
        while True:
            number, state = self._manifest()
            if key is not None and key in state["keys"]:
                return state["keys"][key]
            batch = f"batch-{uuid.uuid4().hex}"
            known = self.tags
            folder = lambda name: f"{self.path}/{name}/{batch}"  # noqa: B023, E731
            wanted = make(state, f"recipes/{batch}")
            new = new_tags(wanted, known)
            new.select((F.monotonically_increasing_id() + F.lit(state["tag_id"])).alias("id"), "tag_name").write.parquet(folder("tags"))
            added = self.spark.read.schema(TAGS).parquet(folder("tags"))
            ids = known.union(added).groupBy("tag_name").agg(F.min("id").alias("tag_id"))
            wanted.join(ids, "tag_name").select("recipe_id", "tag_id").write.parquet(folder("recipe_tags"))
            saved = self.spark.read.schema(RECIPES).parquet(folder("recipes"))
            top = [df.agg(F.max("id")).first()[0] for df in (saved, added)]
            after = state | {
                "batches": [*state["batches"], batch],
                "keys": state["keys"] | ({key: count} if key is not None else {}),
                "recipe_id": state["recipe_id"] if top[0] is None else top[0] + 1,
                "tag_id": state["tag_id"] if top[1] is None else top[1] + 1,
            }
            if self._commit(number, after):
                return count
            if undo:
                undo(state, f"recipes/{batch}")
            for name in ("recipes", "tags", "recipe_tags"):
                self._delete(f"{name}/{batch}")

    def save(self, recipes: DataFrame, key: str | None = None) -> int:
        """Append recipes with their tags; those without title or book are left out. Returns how many were saved.

        Saving twice stores twice, unless both saves have the same key: what was saved under a key is saved once.
        """
        names = set(recipes.columns)
        columns = []
        for f in [*RECIPES.fields, METADATA]:
            if f.name == "id":
                columns.append(F.monotonically_increasing_id().alias("id"))
            elif f.name == "created_at":
                columns.append(F.current_timestamp().alias("created_at"))
            elif f.name in ("tags", "difficulty") or f.name not in names:
                columns.append(F.lit(0 if f.name == "quality_score" else None).cast(f.dataType).alias(f.name))
            else:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        given = F.col("tags") if "tags" in names else F.array().cast("array<string>")
        _, state = self._manifest()
        if key is not None and key in state["keys"]:
            return state["keys"][key]
        staging, first = f"_staging-{uuid.uuid4().hex}", state["recipe_id"]
        columns[0] = (F.monotonically_increasing_id() + F.lit(first)).alias("id")
        # the tags stay beside the recipes in the files, where readers, who ask for the columns of the table, don't see them
        recipes.where("title is not null and book is not null").select(*columns, given.alias("__tags")).write.parquet(f"{self.path}/{staging}")
        saved = self.spark.read.parquet(f"{self.path}/{staging}").count()

        def make(state: dict, folder: str) -> DataFrame:
            if state["recipe_id"] == first:
                self._move(staging, folder)
            else:  # another writer has taken these ids
                staged = self.spark.read.parquet(f"{self.path}/{staging}")
                staged.withColumn("id", F.col("id") + F.lit(state["recipe_id"] - first)).write.parquet(f"{self.path}/{folder}")
            return normal_tags(self.spark.read.parquet(f"{self.path}/{folder}").select("id", "__tags"), "id", "__tags")

        def undo(state: dict, folder: str) -> None:
            if state["recipe_id"] == first:
                self._move(folder, staging)

        if saved or key is not None:
            self._add(make, key, saved, undo)
        self._delete(staging)
        return saved

    def add_tags(self, rows: DataFrame) -> None:
        """Link tags to saved recipes from (id, tags); known tags and links are left as they are (JOI9)."""
        none = self.recipes.limit(0)

        def make(state: dict, folder: str) -> DataFrame:
            none.write.parquet(f"{self.path}/{folder}")
            linked = self.recipe_tags.join(self.tags.withColumnRenamed("id", "tag_id"), "tag_id").select("recipe_id", "tag_name")
            return normal_tags(rows).join(linked, ["recipe_id", "tag_name"], "left_anti")

        self._add(make, None, 0)

    def compact(self) -> None:
        """Bring all batches into one, so that a store of many small saves is read from few folders. Readers of older manifests are not disturbed."""
        number, state = self._manifest()
        batch = f"batch-{uuid.uuid4().hex}"
        for name, df in (("recipes", self.recipes), ("tags", self.tags), ("recipe_tags", self.recipe_tags)):
            df.write.parquet(f"{self.path}/{name}/{batch}")
        if not self._commit(number, state | {"own": False, "batches": [batch]}):
            for name in ("recipes", "tags", "recipe_tags"):
                self._delete(f"{name}/{batch}")
            raise RuntimeError("another writer was faster; compact again")

    def query(self, filters: dict | None = None, min_quality: int | None = None, limit: int | None = None, tags: list[str] | None = None, tags_match_all: bool = True) -> DataFrame:
        """Recipes by column values, least score and tags, best first; limit 0 or None is all."""
        found = where_equal(self.recipes, filters)
        if min_quality is not None:
            found = found.where(F.col("quality_score") >= min_quality)
        if tags:
            found = (with_all_tags if tags_match_all else with_any_tag)(found, self.recipe_tags, self.tags, tags)
        return by_quality(attach_tags(by_quality(found, limit) if limit else found, self.recipe_tags, self.tags))

    def search(self, text: str, limit: int = 50, *, tags: list[str] | None = None) -> DataFrame:
        """Recipes with the text in title, ingredients or instructions and any of the tags; limit 0 is none, a negative one all."""
        found = matching(self.recipes, text)
        if tags:
            found = with_any_tag(found, self.recipe_tags, self.tags, tags)
        return by_quality(attach_tags(by_quality(found, limit), self.recipe_tags, self.tags))

    def count(self, filters: dict | None = None) -> int:
        return where_equal(self.recipes, filters).count()

    def list_tags(self) -> DataFrame:
        return tag_counts(self.recipe_tags, self.tags)

    def ab_statistics(self) -> DataFrame:
        return abtest.statistics(self.recipes)

    def ab_disagreements(self) -> DataFrame:
        return abtest.disagreements(self.recipes)

    def ab_report(self) -> str:
        return abtest.report(self.recipes)
