"""Command line: extract, batch, analyze, validate, search, query-tags, list-tags, export, ab-report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from potluck.operators import analyze, export, quality
from potluck.operators.store import RecipeStore
from potluck.plans.config import Config
from potluck.plans.pipeline import batch, extract_recipes
from potluck.sources import epub


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="potluck", description="Recipes from EPUB cookbooks, on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flags, options in arguments:
            c.add_argument(*flags, **options)
        return c

    store = (("--store", "-s"), {"default": "recipes_store"})
    least = (("--min-quality",), {"type": int, "default": 20})
    verbose = (("--verbose", "-v"), {"action": "store_true"})
    command("extract", (("epub",), {}), store, least, verbose, (("--legacy",), {"action": "store_true"}))
    command("batch", (("folder",), {}), store, least, verbose, (("--pattern", "-p"), {"default": "*.epub"}))
    command("analyze", (("epub",), {}), verbose)
    command("validate", (("epub",), {}), store)
    command("search", (("query",), {}), store, (("--limit",), {"type": int, "default": 10}), (("--tag",), {"action": "append"}))
    command("query-tags", (("tags",), {"nargs": "+"}), store, (("--match-all",), {"action": "store_true"}), (("--limit", "-l"), {"type": int, "default": 20}))
    command("list-tags", store)
    command(
        "export",
        store,
        (("--format",), {"choices": ["json", "markdown", "vault"], "default": "json"}),
        (("--output",), {}),
        (("--organize-by",), {"choices": export.ORGANIZE, "default": "book"}),
        (("--book",), {}),
        (("--min-quality",), {"type": int}),
        (("--limit",), {"type": int}),
        verbose,
    )
    command("ab-report", store, (("--limit",), {"type": int, "default": 20}))
    return p


def _show(df, *columns: str, n: int = 20) -> None:
    df.select(*[F.substring(c, 1, 40).alias(c) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes]).show(n, truncate=False)


def run(spark: SparkSession, argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    store = RecipeStore(spark, a.store) if hasattr(a, "store") else None
    if a.command == "extract":
        found = extract_recipes(spark, a.epub, Config.of(min_quality_score=a.min_quality, use_pattern_extraction=not a.legacy)).persist()
        print(f"saved {store.save(found)} recipes")
        quality.tiers(found).show()
        _show(quality.top(found, 5, "title"), "title", "quality_score")
        if a.verbose:
            _show(found.orderBy("item_ordinal", "section_ordinal"), "title", "chapter", "quality_score", "metadata", n=1000)
        found.unpersist()
    elif a.command == "batch":
        found, files = batch(spark, a.folder, Config.of(min_quality_score=a.min_quality), a.pattern)
        found = found.persist()
        print(f"saved {store.save(found)} recipes")
        quality.batch_summary(files, found).show()
        _show(files.where("error is not null").limit(5), "path", "error", n=5)
        if a.verbose:
            per_book = found.groupBy("book").agg(F.count(F.lit(1)).alias("recipes"))
            each = files.join(per_book, "book", "left").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.coalesce("recipes", F.lit(0)).alias("recipes"), "error")
            _show(each.orderBy("file"), "file", "recipes", "error", n=1000)
        found.unpersist()
    elif a.command == "analyze":
        for row in analyze.format_structure(analyze.structure_report(epub.scan_files(spark, a.epub))).collect():
            print(row["text"])
        if a.verbose:
            files = epub.scan_files(spark, a.epub)
            _show(epub.read_items(files).orderBy("ordinal"), "item_name", "kind", n=1000)
            _show(epub.read_toc(files).orderBy("ordinal"), "title", "href", "category", "level", n=1000)
    elif a.command == "validate":
        r = analyze.validate_extraction(spark, store.recipes, a.epub).first()
        print(f"{r['matched']} of {r['toc_count']} entries ({r['coverage'] * 100:.1f}%), {r['extracted_count']} recipes")
        for title in r["missing"][:10]:
            print(f"  missing: {title}")
    elif a.command == "search":
        _show(store.search(a.query, a.limit, tags=a.tag), "title", "book", "quality_score", n=a.limit)
    elif a.command == "query-tags":
        _show(store.query(tags=a.tags, tags_match_all=a.match_all, limit=a.limit), "title", "book", "quality_score", n=a.limit or 20)
    elif a.command == "list-tags":
        store.list_tags().show(1000, truncate=False)
    elif a.command == "export":
        rows = store.query({"book": a.book}, a.min_quality, a.limit)
        if a.verbose:
            _show(rows, "title", "book", "quality_score", n=1000)
        if a.format == "vault":
            print(export.export_vault(rows, a.output or "vault", a.organize_by))
        elif a.format == "json":
            export.write_parts(export.export_json(rows), a.output or "recipes.json", "\n")
        else:
            export.write_parts(export.export_markdown(rows), a.output or "recipes.markdown")
    elif a.command == "ab-report":
        print(store.ab_report())
        _show(store.ab_disagreements().limit(a.limit), "title", "book", "confidence", "strategy", n=a.limit)
    return 0


def main() -> int:
    return run(SparkSession.builder.appName("potluck").getOrCreate())


if __name__ == "__main__":
    raise SystemExit(main())
