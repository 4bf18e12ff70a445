"""Structure reports and the check of extraction against a table of contents (SRC6, SRC7, DOM10, DOM11, AGG12, JOI5, JOI6, SCO43)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.functions import vocab as v
from potluck.functions.text import strip
from potluck.functions.validate import is_likely_recipe_title
from potluck.sources import epub
from potluck.sources.dom import HEADERS, parse

MATCH = 0.6


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _header_counts(markup: pd.Series) -> pd.Series:
    def one(x) -> list[int]:
        tags = [n.tag for n in parse(x if isinstance(x, str) or x is None else bytes(x)).walk()]
        return [tags.count(h) for h in HEADERS]

    return markup.map(one)


def header_distribution(pages: DataFrame, markup_col: str, *keys: str) -> DataFrame:
    """Counts of h1 to h6 over all documents, per key if some are given."""
    counted = pages.select(*keys, _header_counts(F.col(markup_col)).alias("h"))
    return counted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col("h")[i]), F.lit(0)).alias(h) for i, h in enumerate(HEADERS)])


def indicator_frequency(pages: DataFrame, markup_col: str, *keys: str) -> DataFrame:
    """In how many documents each indicator occurs, anywhere in the markup, per key if some are given."""
    low = pages.select(*keys, F.lower(F.col(markup_col)).alias("m"))
    return low.groupBy(*keys).agg(*[F.count_if(F.contains("m", F.lit(w))).alias(w.replace(" ", "_")) for w in v.STRUCTURE_INDICATORS])


def toc_recipes(toc: DataFrame) -> DataFrame:
    """Leaves of a table of contents that look like recipes, with the title of the section they are in."""
    return toc.where("is_leaf").where(is_likely_recipe_title(F.col("title"))).select("path", "book", "ordinal", "title", "href", "category", "level")


def structure_report(files: DataFrame) -> DataFrame:
    """One row per archive: metadata, numbers of items, TOC entries, header counts and indicator frequencies."""
    items = epub.read_items(files)
    documents = epub.read_documents(files).where("error is null")
    per_book = items.groupBy("path").agg(
        F.max("book").alias("title"),
        F.max("author").alias("author"),
        F.count("item_name").alias("total_items"),
        F.count_if(F.col("kind").isin("document", "navigation")).alias("document_items"),
        F.count_if(F.col("kind") == "image").alias("image_items"),
        F.max("error").alias("error"),
    )
    toc = epub.read_toc(files).groupBy("path").agg(F.count(F.lit(1)).alias("toc_entries"))
    heads = header_distribution(documents, "content", "path")
    marks = indicator_frequency(documents.withColumn("content", F.col("content").cast("string")), "content", "path")
    pack = lambda df, names, to: df.select("path", F.map_from_arrays(F.array(*[F.lit(n.replace("_", " ")) for n in names]), F.array(*names)).alias(to))
    return (
        per_book.join(toc, "path", "left")
        .join(pack(heads, list(HEADERS), "header_distribution"), "path", "left")
        .join(pack(marks, [w.replace(" ", "_") for w in v.STRUCTURE_INDICATORS], "recipe_indicators"), "path", "left")
        .withColumn("toc_entries", F.coalesce("toc_entries", F.lit(0)))
        .withColumn("has_toc", F.col("toc_entries") > 0)
    )


def format_structure(report: DataFrame) -> DataFrame:
    """(path, text): the report as lines; headers by name, indicators by falling number, both without zeros for headers."""
    heads = F.array_sort(F.filter(F.map_entries("header_distribution"), lambda e: e["value"] > 0))
    marks = F.array_sort(F.map_entries("recipe_indicators"), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    lines = F.concat(
        F.array(
            F.concat(F.lit("Title: "), F.col("title")),
            F.concat(F.lit("Author: "), F.col("author")),
            F.concat(F.lit("Total items: "), F.col("total_items")),
            F.concat(F.lit("Document items: "), F.col("document_items")),
            F.when(F.col("has_toc"), F.concat(F.lit("TOC entries: "), F.col("toc_entries"))).otherwise("No TOC found"),
        ),
        F.transform(heads, lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
        F.transform(marks, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': found in "), e["value"], F.lit("/"), F.col("document_items"), F.lit(" documents"))),
    )
    return report.select("path", F.array_join(lines, "\n").alias("text"))


def normal_title(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # a matcher indexes its second text once: pairs are taken by that text
    out = [0.0] * len(a)
    matcher, last = SequenceMatcher(None, autojunk=True), None
    left, right = a.tolist(), b.tolist()
    for i in sorted(range(len(out)), key=lambda i: right[i] or ""):
        if left[i] and right[i]:
            if right[i] != last:
                last = right[i]
                matcher.set_seq2(last)
            matcher.set_seq1(left[i])
            out[i] = matcher.ratio()
    return pd.Series(out)


def fuzzy_match(a: Column, b: Column) -> Column:
    """SCO43: 2 M / T over lower-cased titles without punctuation; 0 if either is empty."""
    return _ratio(normal_title(F.coalesce(a, F.lit(""))), normal_title(F.coalesce(b, F.lit(""))))


def _bounds(entry: str, codes: np.ndarray, index: dict[str, int]) -> np.ndarray:
    """For titles of one length, given as rows of character codes, the most that the ratio with entry can be.

    Matching blocks are a common subsequence, so they hold no more characters than the longest one; its length comes from
    bit vectors, all titles at once. Beyond 64 characters the number of common characters takes its place.
    """
    x, y = len(entry), codes.shape[1]
    if x > 64:
        mine = np.bincount([index[c] for c in entry if c in index], minlength=len(index) + 1)
        common = np.array([np.minimum(mine, np.bincount(row, minlength=len(index) + 1)).sum() for row in codes])
        return 2.0 * common / (x + y)
    places = np.zeros(len(index) + 1, np.uint64)
    for i, c in enumerate(entry):
        if c in index:
            places[index[c]] |= np.uint64(1 << i)
    v = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(y):
        u = v & places[codes[:, j]]
        v = (v + u) | (v - u)
    return 2.0 * (x - np.bitwise_count(v & np.uint64((1 << x) - 1))) / (x + y)


class _Tree:
    """Titles of one length as a tree of their prefixes; a level's nodes are the first titles, in their order, of each prefix."""

    def __init__(self, texts: list[str]):
        n, y = len(texts), len(texts[0])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, y)
        self.order = np.lexsort(codes.T[::-1])
        codes = codes[self.order]
        known, places = np.unique(codes, return_inverse=True)
        self.codes, self.index, self.length = places.reshape(n, y), {chr(c): i for i, c in enumerate(known.tolist())}, y
        self.levels = []  # per level: the character of each node, and where the children of each node of the level above begin and end
        new, above = np.zeros(n, bool), np.zeros(1, np.int64)
        new[0] = True
        for j in range(y):
            new[1:] |= self.codes[1:, j] != self.codes[:-1, j]
            starts = np.flatnonzero(new)
            first = np.searchsorted(starts, above)
            self.levels.append((self.codes[starts, j], first, np.append(first[1:], len(starts))))
            above = starts

    def near(self, places: np.ndarray, x: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int] | None:
        """(name, place of a title, their longest common subsequence) for all of `least` or more, the most that any left-out title could have, and the nodes seen.

        places has a row of bit masks per name of x <= 64 characters. A prefix is left once what it has in common with the name and
        its remaining length are less than `least`. None if more than `most` nodes are open at a time.
        """
        m = len(places)
        name, node, v = np.arange(m), np.zeros(m, np.int64), np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
        whole = np.uint64((1 << x) - 1)
        common, missed, seen = np.zeros(m, np.int64), 0, 0
        for j, (chars, first, end) in enumerate(self.levels):
            n = end[node] - first[node]
            total = int(n.sum())
            if total > most and m > 1:
                return None
            seen += total
            up = np.repeat(np.arange(len(node)), n)
            child = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + first[node][up]
            name, v = name[up], v[up]
            u = v & places[name, chars[child]]
            v = (v + u) | (v - u)
            common = x - np.bitwise_count(v & whole).astype(np.int64)
            best = common + (self.length - j - 1)
            keep = best >= least
            if not keep.all():
                missed = max(missed, int(best[~keep].max()))
            name, node, v, common = name[keep], child[keep], v[keep], common[keep]
        return name, node, common, missed, seen


def _best_in_blocks(least: float):
    def search(names: list[str], tree: _Tree, answer, most: int) -> None:
        """answer(name, [(title, bound)]) says whether a name is done; titles with the longest common subsequences come first."""
        x, y = len(names[0]), tree.length
        masks = np.zeros((len(names), len(tree.index) + 1), np.uint64)
        for k, name in enumerate(names):
            for i, c in enumerate(name):
                if c in tree.index:
                    masks[k, tree.index[c]] |= np.uint64(1 << i)
        low = next(k for k in range(x + y + 1) if 2.0 * k / (x + y) >= least)
        jobs = [(np.arange(len(names)), min(x, y))]
        while jobs:
            rows, k = jobs.pop()
            if k < low:
                continue
            found = tree.near(masks[rows], x, k, most)
            if found is None:
                jobs += [(rows[: len(rows) // 2], k), (rows[len(rows) // 2 :], k)]
                continue
            name, node, common, missed, seen = found
            open_ = np.ones(len(rows), bool)
            for part in np.split(np.arange(len(name)), np.flatnonzero(np.diff(name)) + 1) if len(name) else []:
                i = name[part[0]]
                open_[i] = not answer(int(rows[i]), node[part], 2.0 * common[part] / (x + y), 2.0 * k / (x + y))
            # where the tree hardly narrows the search, one last look at all that can count; else the next greatest bound
            wide = seen > len(rows) * len(tree.order) // 4
            jobs.append((rows[open_], min(k - 1, low if wide else missed) if k > low else low - 1))
            if not open_.any():
                jobs.pop()

    def one(names: list[str], ids: np.ndarray, texts: list[str], titles: list[str]) -> Iterator[tuple[str, float, int, str]]:
        matcher = SequenceMatcher(None, autojunk=True)
        found: dict[int, tuple[float, int]] = {}

        def best_of(name: str, where: np.ndarray, bound: np.ndarray) -> tuple[float, int]:
            best, at = 0.0, -1
            matcher.set_seq1(name)
            for k in np.lexsort((ids[where], -bound)).tolist():
                if bound[k] < best:
                    break
                t = int(where[k])
                if bound[k] == best and ids[t] > ids[at]:
                    continue
                matcher.set_seq2(texts[t])
                score = matcher.ratio()
                if score >= least and (score > best or (score == best and ids[t] < ids[at])):
                    best, at = score, t
            return best, at

        if len(names[0]) > 64:
            index = {c: i for i, c in enumerate(sorted({c for text in texts for c in text}))}
            codes = np.array([[index[c] for c in text] for text in texts], np.int64)
            for i, name in enumerate(names):
                bound = _bounds(name, codes, index)
                some = np.flatnonzero(bound >= least)
                found[i] = best_of(name, some, bound[some])
        else:
            tree = _Tree(texts)

            def answer(i: int, nodes: np.ndarray, bound: np.ndarray, down_to: float) -> bool:
                best = best_of(names[i], tree.order[nodes], bound)
                if best[1] >= 0 and best[0] >= down_to:
                    found[i] = best
                return i in found

            for at in range(0, len(names), 4096):
                part = names[at : at + 4096]
                search(part, tree, lambda i, nodes, bound, down_to, at=at: answer(at + i, nodes, bound, down_to), 1 << 21)
        for i, (score, t) in found.items():
            if t >= 0:
                yield names[i], score, int(ids[t]), titles[t]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, ids, texts, titles in zip(frame["names"], frame["ids"], frame["texts"], frame["named"]):
                yield pd.DataFrame(list(one(list(names), np.array(ids, np.int64), list(texts), list(titles))), columns=["__a", "score", "title_id", "title"])

    return run


def best_matches(entries: DataFrame, titles: DataFrame, least: float = MATCH, block: int = 65536) -> DataFrame:
    """For each entry(entry_id, entry_title) the best title(title_id, title) with a ratio of `least` or more, else null; of equal ones that with the least id.

    Equal normalised titles are an equi-join. The other names meet the titles in blocks of one length, ranges of about `block`
    titles in their order, as a ratio is at most 2 min / (sum) of the lengths. In a block a name goes down the tree of prefixes:
    what a prefix has in common with it bounds the ratio of all titles below, so it sees few of them. The greatest bounds come
    first, until difflib finds a ratio that no other title can beat.
    """
    a = entries.select("entry_id", "entry_title", normal_title(F.coalesce("entry_title", F.lit(""))).alias("__a"))
    b = titles.select(F.col("title_id").cast("long").alias("title_id"), "title", normal_title(F.coalesce("title", F.lit(""))).alias("text")).where("text <> ''")
    b = b.groupBy("text").agg(F.min(F.struct("title_id", "title")).alias("t")).select("text", "t.title_id", "t.title")
    names = a.select("__a").where("__a <> ''").distinct()
    equal = names.join(b.withColumnRenamed("text", "__a"), "__a").select("__a", F.lit(1.0).alias("score"), "title_id", "title")
    rest = names.join(b.select(F.col("text").alias("__a")), "__a", "left_anti")
    # a block of names takes a block of titles with it, so there are no more of them than keep the cores busy, or memory asks for
    some = max(256, min(16384, rest.count() // (4 * entries.sparkSession.sparkContext.defaultParallelism)))
    sized = rest.withColumn("names_len", F.length("__a"))
    parts = sized.groupBy("names_len").agg(F.ceil(F.count(F.lit(1)) / some).alias("__n"))
    place = F.pmod(F.xxhash64("__a"), F.col("__n")).cast("int").alias("names_block")
    left = sized.join(parts, "names_len").groupBy("names_len", place).agg(F.collect_list("__a").alias("names"))
    ranges = b.repartitionByRange(max(1, -(-b.count() // block)), F.length("text"), "text").withColumn("titles_block", F.spark_partition_id())
    right = ranges.groupBy(F.length("text").alias("titles_len"), "titles_block").agg(F.collect_list(F.struct("title_id", "text", "title")).alias("t"))
    share = least / (2 - least)
    lengths = left.select("names_len").distinct().select(
        "names_len", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(F.col("names_len") * share).cast("int")), F.ceil(F.col("names_len") / share).cast("int"))).alias("titles_len")
    )
    pairs = left.join(lengths, "names_len").join(right, "titles_len").repartition("names_len", "names_block", "titles_len", "titles_block")
    pairs = pairs.select("names", F.col("t.title_id").alias("ids"), F.col("t.text").alias("texts"), F.col("t.title").alias("named"))
    near = pairs.mapInPandas(_best_in_blocks(least), "__a string, score double, title_id long, title string")
    best = equal.union(near).groupBy("__a").agg(F.max(F.struct("score", (-F.col("title_id")).alias("k"), "title")).alias("m"))
    return a.join(best, "__a", "left").select("entry_id", "entry_title", (-F.col("m.k")).alias("title_id"), F.col("m.title").alias("title"), F.col("m.score").alias("score"))


def validation(matches: DataFrame, titles: DataFrame) -> DataFrame:
    """One row: toc_count, extracted_count, matched, coverage and the missing entries in order; an empty TOC covers 0."""
    hit = F.col("score").isNotNull()
    return matches.agg(
        F.count(F.lit(1)).alias("toc_count"),
        F.count_if(hit).alias("matched"),
        F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("coverage"),
        F.transform(F.array_sort(F.collect_list(F.when(~hit, F.struct("entry_id", "entry_title")))), lambda e: e["entry_title"]).alias("missing"),
    ).crossJoin(titles.agg(F.count(F.lit(1)).alias("extracted_count")))


def validate_extraction(spark: SparkSession, recipes: DataFrame, path: str) -> DataFrame:
    """Entries of one book's TOC against all given recipes(title), in their order."""
    toc = toc_recipes(epub.read_toc(epub.scan_files(spark, path)))
    entries = toc.select(F.col("ordinal").alias("entry_id"), F.col("title").alias("entry_title"))
    titles = recipes.select((F.col("id") if "id" in recipes.columns else F.monotonically_increasing_id()).alias("title_id"), "title")
    return validation(best_matches(entries, titles), titles).withColumn("book_name", F.lit(path.rsplit("/", 1)[-1]))

