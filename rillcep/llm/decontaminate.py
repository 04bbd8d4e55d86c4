"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Every pair of adjacent words of an item is a seed, however common; a document holds it where the two words are adjacent
or have one word between them. A seed in a document places a window around the item's diagonal, and a local alignment of
words over that window gives the share of the item found there, so edited and reordered copies score too. Windows that
hold too few of the item's words to reach the threshold are not aligned.

No alignment of half the item's score lacks a seed, in items of four words or more: without one, between any two matched
words lie either a lost or replaced word of the item, so that at most every other word matches, for less than half the
score, or two foreign words, whose errors take back all that a match gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, sub_batches, table

#: Words of items that a pass over the documents holds at once; a larger benchmark takes several passes.
MAX_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1

_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(_PUNCTUATION).split() if text else []


class Seeds:
    """Items of at least two words (or `width`) as word numbers, and their pairs of adjacent words as sorted codes."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.number = {}
        self.ids, self.tokens = [], []
        for item, text in items:
            w = words(text)
            if len(w) >= max(2, width):
                self.ids.append(item)
                self.tokens.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], dtype=np.int64))
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        grams = [t[:-1] * (len(self.number) + 1) + t[1:] for t in self.tokens]
        code = np.concatenate([*grams, np.zeros(0, dtype=np.int64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)]).astype(np.int64)
        by = np.argsort(code, kind="stable")
        self.item, self.place = item[by], place[by]
        self.sorted, self.first, self.times = np.unique(code[by], return_index=True, return_counts=True)

    def read(self, texts: list[str | None]):
        """(tokens of all texts with a gap of unknown words between, start and end of each, and for each hit: text, position, item, place there)."""
        number = _Numbers(self.number)
        split = [words(t) for t in texts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 2)])
        flat = np.full(starts[-1], -1, dtype=np.int32)
        for s, w in zip(starts, split):
            flat[s : s + len(w)] = np.fromiter(map(number.__getitem__, w), dtype=np.int32, count=len(w))
        wide, base, hits = flat.astype(np.int64), len(self.number) + 1, []
        for apart in (1, 2):
            codes = np.where((wide[:-apart] >= 0) & (wide[apart:] >= 0), wide[:-apart] * base + wide[apart:], -1)
            at = np.flatnonzero(codes >= 0)
            if len(self.sorted) and len(at):
                found = np.minimum(np.searchsorted(self.sorted, codes[at]), len(self.sorted) - 1)
                fits = self.sorted[found] == codes[at]
                at, found = at[fits], found[fits]
                many = self.times[found]
                entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                hits.append((np.repeat(at, many), self.item[entry], self.place[entry]))
        at, item, place = (np.concatenate([*(h[i] for h in hits), np.zeros(0, dtype=np.int64)]) for i in range(3))
        return flat, starts[:-1], starts[:-1] + sizes, np.searchsorted(starts, at, side="right") - 1, at, item, place


class _Numbers(dict):
    def __missing__(self, word):
        return -1


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item in its window, as a share of the item's full score."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    for lo in range(0, len(order), 256):
        part = order[lo : lo + 256]
        a = np.full((len(part), max(len(items[i]) for i in part)), -2, dtype=np.int64)
        b = np.full((len(part), max(len(windows[i]) for i in part)), -3, dtype=np.int64)
        for r, i in enumerate(part):
            a[r, : len(items[i])] = items[i]
            b[r, : len(windows[i])] = windows[i]
        ramp = -GAP * np.arange(b.shape[1])
        h = np.zeros((len(part), b.shape[1] + 1), dtype=np.int64)
        best = np.zeros(len(part), dtype=np.int64)
        for i in range(a.shape[1]):
            row = np.maximum(h[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISMATCH), h[:, 1:] + GAP)
            row = np.maximum.accumulate(np.maximum(row, 0) + ramp, axis=1) - ramp
            h[:, 1:] = row
            best = np.maximum(best, row.max(axis=1))
        out[part] = best / np.array([MATCH * len(items[i]) for i in part])
    return out


#: Words of windows looked at at once.
CELLS = 1 << 18


def _enough(seeds: Seeds, flat: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the words first to last of each window can hold an alignment over the threshold: it needs as many words of
    the item in the window, and as many words of the window in the item.

    A word has the bits of its places in the item (modulo 64, so that longer items are bounded from above)."""
    out = np.zeros(len(item), dtype=bool)
    bits = np.zeros(len(seeds.number) + 1, dtype=np.uint64)  # the last is for unknown words, -1
    order = np.lexsort((last - first, item))
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(item)), dtype=bool), item[order][1:] != item[order][:-1]]))
    for own in np.split(order, starts[1:]) if len(item) else ():
        k = int(item[own[0]])
        tokens, size = seeds.tokens[k], int(seeds.sizes[k])
        np.bitwise_or.at(bits, tokens, np.uint64(1) << (np.arange(size) % 64).astype(np.uint64))
        rows = max(1, CELLS // int((last - first)[own[-1]]))
        for lo in range(0, len(own), rows):
            part = own[lo : lo + rows]
            at = first[part, None] + np.arange(int((last - first)[part[-1]]))
            here = bits[flat[np.minimum(at, len(flat) - 1)]]
            here[at >= last[part, None]] = 0
            of_item = np.bitwise_count(np.bitwise_or.reduce(here, axis=1)).astype(np.int64) * -(-size // 64)
            out[part] = np.minimum(of_item, np.count_nonzero(here, axis=1)) >= threshold * size
        bits[tokens] = 0
    return out


FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


SCHEMA = "doc_id long, text_hash long, item_id long, score double, n_seeds long, start long, stop long"


def _aligner(seeds: Seeds, threshold: float):
    #: How far an alignment reaches from its diagonal: it has at most 2 (1 - threshold) errors a word.
    slack = np.ceil(np.maximum(seeds.sizes // 2 + 4, 2 * (1 - threshold) * seeds.sizes)).astype(np.int64)

    def run(batches):
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in sub_batches(texts, 2 << 20):
                flat, starts, ends, doc, at, item, place = seeds.read(texts[lo:hi])
                # Hits on near diagonals of a text and item share a window, which covers what each of them can reach.
                diagonal = at - place
                band = (diagonal - starts[doc] + seeds.sizes[item]) // seeds.sizes[item]
                order = np.lexsort((diagonal, band, item, doc))
                doc, item, band, diagonal = doc[order], item[order], band[order], diagonal[order]
                fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), dtype=bool), (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
                hits = np.diff(np.append(fresh, len(doc)))
                low, high, doc, item = diagonal[fresh], diagonal[fresh + hits - 1], doc[fresh], item[fresh]
                first = np.maximum(starts[doc], low - slack[item])
                last = np.minimum(ends[doc], high + seeds.sizes[item] + slack[item])
                keep = _enough(seeds, flat, item, first, last, threshold)
                doc, item, first, last, hits = doc[keep], item[keep], first[keep], last[keep], hits[keep]
                scores = align([seeds.tokens[k] for k in item], [flat[a:b] for a, b in zip(first, last)]) if len(item) else []
                best: dict[tuple[int, int], tuple] = {}
                for d, k, score, n, a, b in zip(doc.tolist(), item.tolist(), scores, hits.tolist(), (first - starts[doc]).tolist(), (last - starts[doc]).tolist()):
                    if score >= threshold and (score, n, a, b) > best.get((d, k), (0.0,)):
                        best[d, k] = (score, n, a, b)
                rows = [(ids[lo + d], hashes[lo + d], seeds.ids[k], *found) for (d, k), found in best.items()]
                yield arrow(FOUND, [list(c) for c in zip(*rows)] if rows else [[] for _ in FOUND])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, item_id, score, n_seeds, start, stop) for each item found in a document.

    text_hash: xxhash64 of the text, which with doc_id tells rows apart that share a doc_id or have none; score: the best alignment as a share of the item's full score; n_seeds: seed hits in the window, words start to
    stop of the document. Null and empty texts match nothing, nor do items of fewer than `width` words. Repeated
    items are found each; repeated rows of docs repeat their findings. Empty tables give an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes, out = int(size // MAX_WORDS) + 1, None
    for k in range(passes):
        items = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        seeds = Seeds([tuple(r) for r in items], width)
        if not seeds.tokens:
            continue
        found = docs.mapInArrow(_aligner(seeds, threshold), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every benchmark item against every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
