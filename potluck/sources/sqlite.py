"""Tables of an SQLite file: read in parallel by row-id ranges, and written back for tools that want one file (SRC8)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from potluck.operators.store import RecipeStore, tag_lists

_TYPES = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "TIMESTAMP": "string"}
ROWS_PER_TASK = 100_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _schema(connection: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    found = connection.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"no such table: {table}")
    return [(name, next((t for part, t in _TYPES.items() if part in declared.upper()), "string")) for _, name, declared, *_ in found]


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A table of the file at a path that all executors share. Integers are read as bigint, dates as the text they are stored as."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
        columns = _schema(c, table)
        lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
    schema = ", ".join(f"`{n}` {t}" for n, t in columns)
    if lo is None:
        return spark.createDataFrame([], schema)
    names = ", ".join(_quoted(n) for n, _ in columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as c:
            for frame in frames:
                for start in frame["id"]:
                    rows = c.execute(f"SELECT {names} FROM {_quoted(table)} WHERE rowid BETWEEN ? AND ?", (int(start), int(start) + rows_per_task - 1)).fetchall()
                    yield pd.DataFrame(rows, columns=[n for n, _ in columns]).astype({n: "Int64" for n, t in columns if t == "bigint"})

    starts = spark.range(lo, hi + 1, rows_per_task, max(1, min(1000, (hi - lo) // rows_per_task + 1)))
    return starts.mapInPandas(read, schema)


def import_recipes(spark: SparkSession, path: str, store: RecipeStore) -> int:
    """Save the recipes of an SQLite recipe database, with their tags, to a store."""
    recipes = read_sqlite(spark, path, "recipes").drop("tags", "created_at")
    links, tags = read_sqlite(spark, path, "recipe_tags"), read_sqlite(spark, path, "tags")
    return store.save(recipes.join(tag_lists(links, tags), "id", "left").drop("id"))


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Append rows to a table, made if it is not there. One file has one writer: rows come to the driver partition by partition."""
    types = ["INTEGER" if t in ("int", "bigint", "boolean") else "REAL" if t in ("double", "float") else "TEXT" for _, t in df.dtypes]
    n = 0
    with closing(sqlite3.connect(path)) as c, c:
        c.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(f'{_quoted(x)} {t}' for x, t in zip(df.columns, types))})")
        for row in df.toLocalIterator():
            c.execute(f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})", tuple(row))
            n += 1
    return n
