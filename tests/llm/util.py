"""Small documents tables with every awkward case."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """df with more columns, whose names the operators use within."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("mine"))
    return df


def prose(seed, n, vocabulary=2000):
    import numpy as np

    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))
