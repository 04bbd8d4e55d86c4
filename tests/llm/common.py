"""Documents with awkward rows, shared by the operators' tests."""

import random

from pyspark.sql import functions as F

WORDS = [a + b + c for a in "blor kren thim vasu pod".split() for b in "ta mi gu".split() for c in ("ne", "ro", "x", "él")]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text): null, empty, blank, short, repeated, long and odd texts; a null id; a repeated row."""
    base = prose(120, 1)
    return [
        (1, base), (2, base), (2, base), (3, base + " tail word"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
        (9, "ONE TWO"), (None, base), (None, None), (10, prose(4000, 2)), (11, "ünï\u00a0cödé ßtring 日本語 😀 x\x00y"), (12, base.upper()), (13, prose(60, 3) + " " + base),
    ]


def frame(spark, rows):
    """A documents table with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit(7) for c in ("row", "bytes", "spans", "score", "digest", "c0", "component_id", "kept", "block", "rank", "held", "toxic")}
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra})


def empty(spark):
    return frame(spark, []).limit(0)
