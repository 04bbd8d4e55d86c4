"""Language identification by compression: the language whose dictionary compresses a text best."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillcep.llm.common import held_out, table

LETTER = re.compile(r"[^\W\d_]")

#: Bounds of the fit: bytes of a language's dictionary, sampled documents of a language, and characters of a passage.
DICTIONARY, SAMPLE, PASSAGE = 32 << 10, 400, 80
#: Bytes compressed at once; a whole text is the sum of its blocks, so its own repeats don't drown the dictionary.
BLOCK = 4 << 10


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw content for each non-null lang of docs (doc_id, text, lang), from a bounded sample by hash of the id.

    All sampled documents of a language give equally many passages, as many as fill the dictionary, from places that a
    hash deals over the whole text: what texts begin with has no more weight than the rest. Rows of a null doc_id, lang
    or text aren't learned. The sample is drawn in two rounds, so a frequent language never gathers in one task."""
    order = F.xxhash64("doc_id", F.lit(23))
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", order.alias("h"))
    first = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id")
    ids = ids.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE // 16)
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= SAMPLE)
    ids = ids.withColumn("passages", F.ceil(F.lit(DICTIONARY / PASSAGE) / F.max("r").over(Window.partitionBy("lang"))).cast("int"))
    texts = docs.where("text is not null").select("doc_id", F.lower("text").alias("text")).join(F.broadcast(ids.drop("h")), "doc_id")
    room = F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1
    place = lambda i: (F.pmod(F.xxhash64("doc_id", i), room) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(1), "passages"), lambda i: F.substring(F.col("text"), place(i), F.lit(PASSAGE)))
    out: dict[str, list[str]] = {}
    for lang, passages in texts.select("lang", F.array_distinct(cut)).collect():
        out.setdefault(lang, []).extend(passages)
    return {k: "\n".join(sorted(v)).encode()[:DICTIONARY] for k, v in sorted(out.items())}


def sizes(text: bytes, compressors) -> list[int]:
    """Compressed bytes of a text under each compressor, block by block."""
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def _classifier(raw: dict[str, bytes], level: int, narrow: float):
    names = list(raw)

    def run(batches):
        compressors = []
        for content in raw.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if not text or not names or not LETTER.search(text):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                found = sizes(text.lower().encode(), compressors)
                best = int(np.argmin(found))
                second = min((s for i, s in enumerate(found) if i != best), default=None)
                margin = 1.0 if second is None else 1 - found[best] / second
                langs.append(names[best]), scores.append(min(1.0, margin / 0.1)), rejected.append(margin < narrow)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, raw: dict[str, bytes], *keep: str, level: int = 6, narrow: float = 0.005) -> DataFrame:
    """The columns `keep` of docs, lang_pred, score (0 to 1, by the margin over the runner-up) and rejected.

    `rejected` marks margins under `narrow`; lang_pred is still the smallest (the first by name on ties). A null text,
    one without any letter, and every text when no language was learned, is `und`, score 0, rejected."""
    d = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in d.dtypes[:-1]] + ["lang_pred string, score double, rejected boolean"])
    return d.mapInArrow(_classifier(raw, level, narrow), schema).toDF(*keep, "lang_pred", "score", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: learns outside the held-out quarter, predicts every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, dictionaries(docs.where(~held_out("doc_id", 4, 2))), "doc_id")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
