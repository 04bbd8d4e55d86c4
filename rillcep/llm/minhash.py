"""Near-duplicate documents by min-max hashing (Ji et al., Min-Max Hash for Jaccard Similarity, ICDM 2013).

Every permutation yields two signature values, the smallest and the largest hash of the set, so half the hash
evaluations fill the same signature. Documents with equal shingle sets are one class before any banding; class
representatives that share a band join a candidate block, and inside the blocks links are confirmed on full sets.

A block of up to BLOCK documents is compared in one piece. In a larger one, such as thousands of near copies, each
document is first compared with the smallest of each of its bands. What that connects, the block's core above all,
needs no comparison among itself: the rest is compared with the core and among itself, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, mix64, random64, staged, sub_batches, table, token_ids, words_of
from rillcep.llm.graph import components

#: Documents compared in one task at most; larger candidate blocks are compared piece by piece.
BLOCK = 500


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words = [words_of(t) for t in texts]
    ids = token_ids([w for ws in words for w in ws])
    powers = random64(width, 77) | np.uint64(1)
    grams = np.zeros(max(0, len(ids) - width + 1), dtype=np.uint64)
    for j in range(width):
        grams += ids[j : len(ids) - width + 1 + j] * powers[j]
    grams = mix64(grams)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b"\0".join(ws), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def min_max(sets: list[np.ndarray], evaluations: int) -> np.ndarray:
    """Signatures (documents x 2*evaluations): minimum and maximum of each hash evaluation. No set may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    xors, factors = random64(evaluations, 11), random64(evaluations, 13) | np.uint64(1)
    out = np.empty((len(sets), 2 * evaluations), dtype=np.uint64)
    for k in range(evaluations):
        v = (flat ^ xors[k]) * factors[k]
        out[:, 2 * k] = np.minimum.reduceat(v, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def banding(threshold: float, values: int, miss: float = 1e-3) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the threshold with probability `miss` at most."""
    return next((r, values // r) for r in range(16, 0, -1) if (1 - threshold**r) ** (values // r) <= miss)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _signer(width: int, rows: int, bands: int):
    evaluations = (rows * bands + 1) // 2
    mults = random64(rows, 5) | np.uint64(1)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in sub_batches(texts, 4 << 20):
                sets = shingle_sets(texts[lo:hi], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [None] * len(sets)
                if full:
                    sig = min_max([sets[i] for i in full], evaluations)[:, : rows * bands].reshape(len(full), bands, rows)
                    banded = mix64((sig * mults).sum(axis=2, dtype=np.uint64)).view(np.int64)
                    for row, i in zip(banded, full):
                        keys[i] = row
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield arrow(SIGNED, [ids[lo:hi], [len(s) for s in sets], digests, keys])

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_block(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """(id, local root) for members linked inside a block: 100*|A&B| >= percent*|A|B|, every pair of different groups compared.

    known: the groups to begin with, where some members are connected already."""
    n = len(ids)
    flat = np.concatenate(sets)
    _, dense = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(dense.max() + 1, dtype=np.int32)
    group = np.arange(n) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    for x in range(n - 1):
        near = (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])) & (group != group[x])
        near[: x + 1] = False
        if not (others := np.flatnonzero(near)).size:
            continue
        own = dense[starts[x] : starts[x + 1]]
        marks[own] = 1
        if len(others) * 4 < n:
            common = np.array([marks[dense[starts[y] : starts[y + 1]]].sum() for y in others])
        else:
            common = np.add.reduceat(marks[dense], starts[:-1])[others]
        marks[own] = 0
        hits = others[100 * common >= percent * (sizes[x] + sizes[others] - common)]
        if hits.size:
            merged = np.unique(np.append(group[hits], group[x]))
            group[np.isin(group, merged)] = merged[0]
    root = {}
    for i, g in zip(ids, group.tolist()):
        root[g] = min(i, root.get(g, i))
    return [(i, root[g]) for i, g in zip(ids, group.tolist()) if root[g] != i]


def _linker(width: int, percent: int):
    """Rows come sorted by block; consecutive rows of a block are compared together."""

    def solve(key, ids, groups, texts):
        return _link_block(ids, shingle_sets(texts, width), percent, groups) if key is not None and len(ids) > 1 else []

    def run(batches):
        key, ids, groups, texts = None, [], [], []
        for batch in batches:
            out = []
            for comp, i, j, doc, group, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (comp, i, j) != key:
                    out += solve(key, ids, groups, texts)
                    key, ids, groups, texts = (comp, i, j), [], [], []
                ids.append(doc), groups.append(group), texts.append(text)
            yield arrow(LINKS, [[a for a, _ in out], [b for _, b in out]])
        out = solve(key, ids, groups, texts)
        yield arrow(LINKS, [[a for a, _ in out], [b for _, b in out]])

    return run


def _against_first(width: int, percent: int):
    """Rows come sorted by (low, salt, whether the document isn't low itself): each is compared with the first."""

    def run(batches):
        key, first = None, None
        for batch in batches:
            lows, salts, docs, texts = (c.to_pylist() for c in batch.columns)
            found = []
            for lo, hi in sub_batches(texts, 4 << 20):
                for low, salt, doc, own in zip(lows[lo:hi], salts[lo:hi], docs[lo:hi], shingle_sets(texts[lo:hi], width)):
                    if (low, salt) != key:
                        key, first = (low, salt), own
                    elif doc != low:
                        common = len(np.intersect1d(first, own, assume_unique=True))
                        if 100 * common >= percent * (len(first) + len(own) - common):
                            found.append((doc, low))
            yield arrow(LINKS, [[a for a, _ in found], [b for _, b in found]])

    return run


def _stars(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (a, low): the links among them. A low of many pairs is dealt out, with a copy for each part."""
    parts = pairs.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "low").select("low", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"), F.col("a").alias("doc_id"))
    own = parts.select("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("low").alias("doc_id"))
    rows = dealt.unionByName(own).join(source.hint("merge"), "doc_id").select("low", "salt", "doc_id", "text", (F.col("doc_id") != F.col("low")).alias("later"))
    rows = rows.repartition("low", "salt").sortWithinPartitions("low", "salt", "later").select("low", "salt", "doc_id", "text")
    return rows.mapInArrow(_against_first(width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, values: int = 140) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row.

    A text without words (null, empty, white space) has an empty set and is linked with nothing; a text of fewer
    than `width` words is one shingle. Repeated rows are exact copies. Rows of a null doc_id are never linked: their
    component_id is null and they are kept. An empty table gives an empty result; other columns are ignored.
    """
    percent = round(100 * threshold)
    rows, bands = banding(threshold, values)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = staged(source.mapInArrow(_signer(width, rows, bands), "doc_id long, n_shingles long, digest binary, bands array<long>"), "minmax")
    # 1. Equal sets are one class, represented by the smallest doc_id.
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    # 2. Representatives sharing a band meet in a candidate block: a star to the band's smallest, then components.
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    low = banded.groupBy("band", "key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "key", "low")
    blocks = components(banded.join(low, ["band", "key"]).selectExpr("rep as a", "low as b"))
    # 3. In blocks beyond BLOCK documents, links with the bands' smallest come first; each block has a core then.
    text = source.where("doc_id is not null")
    sizes = blocks.groupBy("component").agg(F.count("*").alias("n"))
    large = blocks.join(sizes.where(F.col("n") > BLOCK).drop("n"), "component")
    pairs = banded.join(low, ["band", "key"]).where("rep <> low").select(F.col("rep").alias("a"), "low").distinct()
    pairs = pairs.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    stars = staged(_stars(pairs, text, width, percent), "stars")
    joined = large.join(components(stars).withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    groups = joined.groupBy("component", "group").agg(F.count("*").alias("n"))
    cores = groups.groupBy("component").agg(F.max_by("group", F.struct("n", "group")).alias("core"), F.ceil(F.max("n") / BLOCK).cast("int").alias("own"), F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("others"))
    # The pieces of the core have numbers below own; each pair of pieces meets once, but never two of the core.
    cut = joined.join(cores, "component").withColumn("inner", F.col("group") == F.col("core"))
    cut = cut.withColumn("piece", F.when(F.col("inner"), F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("node"), F.greatest("others", F.lit(1)))).cast("int"))
    last = F.col("own") + F.col("others") - 1
    cut = cut.withColumn("other", F.explode(F.when(F.col("others") == 0, F.array().cast("array<int>")).when(F.col("inner"), F.sequence("own", last)).otherwise(F.sequence(F.lit(0), last))))
    cut = cut.select(F.col("node").alias("doc_id"), "component", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "group")
    whole = blocks.join(sizes.where(F.col("n") <= BLOCK).drop("n"), "component").select(F.col("node").alias("doc_id"), "component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("node").alias("group"))
    compared = whole.unionByName(cut).join(text.hint("merge"), "doc_id").select("component", "i", "j", "doc_id", "group", "text")
    compared = compared.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id")
    linked = components(stars.unionByName(compared.mapInArrow(_linker(width, percent), "a long, b long")))
    # 4. Back to every row through its class.
    named = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: links at Jaccard 0.85 on five-word shingles over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.85)


def oracle() -> str:
    """The same in SQL: every pair of documents with a common shingle."""
    return r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[k + 1 : k + 5], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS to_id FROM ways UNION SELECT doc_id, b FROM reach JOIN ways ON a = to_id),
groups AS (SELECT doc_id, min(to_id) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)
"""
