"""Katz backoff model of any order (Katz, 1987) with Good-Turing discounts, a discount for each order.

    P(w | u v) = d(c(u v w)) c(u v w) / c(u v)   if u v w was seen,   else   a(u v) P(w | v),   and so on down to
    P(w)       = d(c(w)) c(w) / N                if w was seen,       else   what the discounts left
    a(h)       = (1 - sum over seen w of P(w | h)) / (1 - sum over seen w of P(w | h without its first word))

so that every P(. | h) sums to one over the V known tokens and one unknown. Counts over K_GT keep their value. A
history whose counts are all over K_GT has nothing left: its probabilities are scaled by c(h) / (c(h) + 1). Before a
text's first word stands a start, and no history reaches beyond it. A history that was never seen isn't used.

Documents travel as blocks of packed token numbers. One exchange for each order serves a block: its distinct words go
to buckets of words and come back numbered, with their counts; its distinct n-grams go to buckets of histories and come
back with their counts, the histories' weights and, where a longer order follows, their numbers, which are the longer
one's histories. Numbers are exact: no two n-grams share one. Histories with more than a bucket's share of tokens are
spread over all buckets by their last word, and only their sums meet. The buckets also write the partitioned tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, held_out, mix64, staged, sub_batches, table, words_of

K_GT = 5
#: Least bytes of text in a block, and buckets of each exchange for each block. Blocks grow with the root of the corpus,
#: so that the messages between blocks and buckets (their product) grow in proportion to it.
BLOCK, SPREAD, GROWTH = 8 << 20, 3, 3000
#: The number of the start; words and n-grams are numbered from 1.
START = 0


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of up to 64 bits as bytes, as wide as the largest needs, sorted by significance and compressed."""
    raw = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, -(-int(raw.max()).bit_length() // 8)) if len(raw) else 1
    return bytes([width]) + zstandard.compress(raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = raw.T
    return out.view("<i8").ravel()


def packed_floats(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values, dtype="<f8")
    return zstandard.compress(raw.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_floats(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<f8").ravel()


def packed_rising(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=0))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("known", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("counts", pa.binary()), ("stream", pa.binary())])


class _Numbering(dict):
    """Tokens numbered as they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _blocker(limit: int):
    def run(batches):
        at = TaskContext.get().partitionId() << 32
        docs, held, arrays, size, names = [], [], [], 0, _Numbering()

        def close():
            nonlocal at, size
            number = np.concatenate(arrays)
            sizes = np.array([len(a) for a in arrays])
            vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
            by = np.argsort(-np.bincount(number), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            number = rank[number]
            learned = np.repeat(~np.array(held, dtype=bool), sizes)
            row = [at, np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs]).tobytes(), np.array(held, dtype=bool).tobytes(), packed(sizes), vocabulary[by].tobytes(), packed(np.bincount(number[learned], minlength=len(by))), packed(number)]
            at, size = at + 1, 0
            docs.clear(), held.clear(), arrays.clear(), names.clear()
            return arrow(BLOCKS, [[v] for v in row])

        for batch in batches:
            ids, folds, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in sub_batches(texts, 2 << 20):
                for i in range(lo, hi):
                    docs.append(ids[i]), held.append(folds[i])
                    words = words_of(texts[i])
                    words.append(b"")  # the end; no word is empty
                    arrays.append(np.fromiter(map(names.__getitem__, words), dtype=np.int32, count=len(words)))
                    size += len(texts[i] or b"")
                if size >= limit:
                    yield close()
        if docs:
            yield close()

    return run


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places) of each bucket that holds keys, in a fixed order."""
    home = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    used, first = np.unique(home[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, first[1:])))


WORDS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _word_sender(buckets: int):
    def run(batches):
        for batch in batches:
            for block, vocabulary, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.frombuffer(vocabulary, np.uint64), unpacked(counts)
                for bucket, at in _by_bucket(keys, buckets):
                    yield arrow(WORDS, [[bucket], [block], [keys[at].tobytes()], [packed(counts[at])]])

    return run


def _buckets(batches):
    """Groups consecutive rows by their first column."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


#: What buckets write: answers to blocks, tables of the model, and whole-corpus sums.
REPLIES = pa.schema(
    [("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in "abcdefgh"), ("sums", pa.list_(pa.int64()))]
    + [("asks", pa.list_(pa.struct([("block", pa.int64()), ("own", pa.binary())])))]
    + [("hot", pa.list_(pa.struct([("key", pa.int64()), ("kept", pa.float64()), ("lower", pa.float64()), ("total", pa.int64()), ("blocks", pa.list_(pa.int64()))])))]
)
REPLY = "kind string, bucket long, block long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, h binary, sums array<long>, asks array<struct<block: long, own: binary>>, hot array<struct<key: long, kept: double, lower: double, total: long, blocks: array<long>>>"


def _reply(rows: list[dict]):
    return arrow(REPLIES, [[r.get(f.name) for r in rows] for f in REPLIES])


def _numbered(counts: np.ndarray, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of each): frequent ones get small numbers, and each bucket its own."""
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(counts), dtype=np.int64)
    number[order] = np.arange(len(counts)) * buckets + bucket + 1
    return order, number


def _summed(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exact in 64 bits."""
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, place, values)
    return out


def _word_counter(buckets: int):
    def run(batches):
        for bucket, rows in _buckets(batches):
            keys = [np.frombuffer(r[2], np.uint64) for r in rows]
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = _summed(at, np.concatenate([unpacked(r[3]) for r in rows]), len(known))
            order, number = _numbered(counts, bucket, buckets)
            ends = np.cumsum([len(k) for k in keys])[:-1]
            out = [{"kind": "answer", "bucket": bucket, "block": r[1], "a": packed(c), "b": packed(n)} for r, c, n in zip(rows, np.split(counts[at], ends), np.split(number[at], ends))]
            out.append({"kind": "unigram", "bucket": bucket, "a": known[order].tobytes(), "b": packed(counts[order])})
            out.append({"kind": "sums", "bucket": bucket, "sums": [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K_GT + 2))]})
            yield _reply(out)

    return run


def _turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's discounts from counts of counts n[1..K_GT+1]; None unless all lie between 0 and 1."""
    a = (K_GT + 1) * n[K_GT + 1] / n[1]
    r = np.arange(1, K_GT + 1)
    d = ((r + 1) * n[2:] / (n[1:-1] * r) - a) / (1 - a) if a != 1 else r * np.nan
    return np.concatenate([[1.0], d, [1.0]]) if ((0 < d) & (d <= 1)).all() else None


def good_turing(count_of_counts: list[int]) -> np.ndarray:
    """d[0..K_GT+1]: the discount of each count r up to K_GT, 1 beyond.

    Counts of counts too irregular for that (copies make some counts odd) are smoothed first by the line through
    log n(r) over log r; where even this fails, as on tiny corpora, d(r) = (r - 0.5) / r."""
    n = np.array([1.0, *count_of_counts[: K_GT + 1]])
    if (n > 0).all():
        found = _turing(n)
        if found is None:
            r = np.arange(1, K_GT + 2)
            slope, start = np.polyfit(np.log(r), np.log(n[1:]), 1)
            found = _turing(np.concatenate([[1.0], np.exp(start + slope * np.log(r))]))
        if found is not None:
            return found
    r = np.arange(1, K_GT + 1)
    return np.concatenate([[1.0], (r - 0.5) / r, [1.0]])


@dataclass(frozen=True)
class Unigrams:
    """Whole-corpus sums; total N, distinct V, discounts, and the scale that leaves the unknown token its share."""

    total: int
    distinct: int
    discounts: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, sums: list[int]) -> "Unigrams":
        total, distinct, *cc = sums
        d = good_turing(cc)
        left = sum((1 - d[r]) * r * n for r, n in enumerate(cc[:K_GT], 1)) / total if total else 1.0
        scale = 1.0 if left > 0 else total / (total + 1)
        return cls(total, distinct, d, scale, left if left > 0 else 1 / (total + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        known = self.scale * self.discounts[np.minimum(counts, K_GT + 1)] * counts / max(self.total, 1)
        return np.where(counts > 0, known, self.unknown)


def _runs(values: np.ndarray):
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))
    return first, np.diff(np.append(first, len(values)))


def _discounted(discounts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return discounts[np.minimum(counts, K_GT + 1)] * counts


@dataclass(frozen=True)
class Plan:
    """What both sides of the exchanges know. discounts: of each order from the second on, as far as they are known."""

    unigrams: Unigrams
    documents: int
    buckets: int
    discounts: tuple = ()

    @property
    def limit(self) -> float:
        return 2 * max(self.unigrams.total, 1) / self.buckets


@dataclass
class Grams:
    """A block's distinct n-grams of one order, in the order in which they are sent: by bucket, history and word."""

    number: np.ndarray  # of each token's n-gram, -1 where its history is unknown
    history: np.ndarray
    total: np.ndarray  # count of the history
    word: np.ndarray
    lower: np.ndarray  # count of the n-gram without its first word
    lower_total: np.ndarray  # count of the history without its first word
    lower_full: np.ndarray  # whether that one's probabilities are scaled
    parts: list  # (bucket, from, to)


class Replay:
    """A block's tokens under the model, one order after the other."""

    def __init__(self, plan: Plan, held: bytes, sizes: bytes, vocabulary: bytes, stream: bytes, answers):
        self.plan, self.sizes, self.stream = plan, unpacked(sizes), unpacked(stream)
        self.learned = np.repeat(~np.frombuffer(held, dtype=bool), self.sizes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        keys, by = np.frombuffer(vocabulary, np.uint64), {a["bucket"]: a for a in answers}
        self.counts, self.ids = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for bucket, at in _by_bucket(keys, plan.buckets):
            self.counts[at], self.ids[at] = unpacked(by[bucket]["a"]), unpacked(by[bucket]["b"])
        self.order, self.p = 1, plan.unigrams.p(self.counts)[self.stream]
        # Of the n-grams of the present order: the token's, their counts and numbers, their histories' counts and scaling.
        self.number, self.count, self.id = self.stream, self.counts, self.ids
        self.total, self.full = np.full(len(keys), plan.unigrams.total), np.zeros(len(keys), dtype=bool)

    def grams(self) -> Grams:
        """Those of the next order."""
        before = np.concatenate([[-1], self.number[:-1]])
        ids, counts = self.id, self.count
        if self.order == 1:
            ids, counts = np.append(ids, START), np.append(counts, self.plan.documents)
        before[self.starts] = len(self.id) if self.order == 1 else -1
        at = np.flatnonzero((before >= 0) & (counts[before] > 0))
        _, first, place = np.unique(before[at] * len(self.counts) + self.stream[at], return_index=True, return_inverse=True)
        first = at[first]
        history, total, word = ids[before[first]], counts[before[first]], self.ids[self.stream[first]]
        both = np.where(total > self.plan.limit, history.view(np.uint64) ^ (word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), history.view(np.uint64))
        home = (mix64(both) % np.uint64(self.plan.buckets)).astype(np.int64)
        order = np.lexsort((word, history, home))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        number = np.full(len(self.stream), -1, dtype=np.int64)
        number[at] = rank[place]
        first = first[order]
        lower = self.number[first]
        start, length = _runs(home[order])
        parts = list(zip(home[order][start].tolist(), start.tolist(), (start + length).tolist()))
        return Grams(number, history[order], total[order], word[order], self.count[lower], self.total[lower], self.full[lower], parts)

    def step(self, replies, hots) -> None:
        """Goes on to the next order, by the buckets' replies to its n-grams."""
        g, self.order = self.grams(), self.order + 1
        count, ids, weight = np.zeros(len(g.word), dtype=np.int64), np.zeros(len(g.word), dtype=np.int64), np.zeros(len(g.word))
        by = {(r["which"], r["bucket"]): r for r in replies or () if r["order"] == self.order}
        for bucket, a, b in g.parts:
            counts = by["counts", bucket]
            count[a:b] = unpacked(counts["a"])
            if counts["b"] is not None:
                ids[a:b] = unpacked(counts["b"])
            weight[a:b] = np.repeat(unpacked_floats(by["weights", bucket]["a"]), _runs(g.history[a:b])[1])
        for x in hots or ():
            if x["order"] == self.order:
                weight[g.history == x["key"]] = x["weight"]
        scale = np.where(weight < 0, g.total / (g.total + 1.0), 1.0)
        seen = scale * _discounted(self.plan.discounts[self.order - 2], count) / np.maximum(g.total, 1)
        at = np.flatnonzero(g.number >= 0)
        own = g.number[at]
        self.p[at] = np.where(count[own] > 0, seen[own], np.abs(weight[own]) * self.p[at])
        self.number, self.count, self.id, self.total, self.full = g.number, count, ids, g.total, weight < 0


GRAMS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("histories", "lengths", "totals", "lower_totals", "lower_full", "words", "lower", "times"))])
SENT = "bucket long, block long, histories binary, lengths binary, totals binary, lower_totals binary, lower_full binary, words binary, lower binary, times binary"


def _replays(plan: Plan, batches):
    """(row, replay up to the order of the replies) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            replay = Replay(plan, row["held"], row["sizes"], row["vocabulary"], row["stream"], row["answers"])
            for _ in plan.discounts:
                replay.step(row["replies"], row["hots"])
            yield row, replay


def _sender(plan: Plan):
    """Blocks -> their n-grams of the next order."""

    def run(batches):
        for row, replay in _replays(plan, batches):
            g = replay.grams()
            times = np.bincount(g.number[replay.learned & (g.number >= 0)], minlength=len(g.word))
            for bucket, a, b in g.parts:
                start, length = _runs(g.history[a:b])
                own = a + start
                yield arrow(GRAMS, [[bucket], [row["block"]], [packed_rising(g.history[own])], [packed(length)], [packed(g.total[own])], [packed(g.lower_total[own])], [packed(g.lower_full[own])], [packed(g.word[a:b])], [packed(g.lower[a:b])], [packed(times[a:b])]])

    return run


def _gram_counter(buckets: int, more: bool):
    """A bucket's distinct n-grams: counts (and numbers, if a longer order follows) back to the blocks, and the learned
    ones as a row of the model's table."""

    def run(batches):
        for bucket, rows in _buckets(batches):
            blocks, opened = [r[1] for r in rows], [[unpacked_rising(r[2]), *map(unpacked, r[3:])] for r in rows]
            known, number = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
            total, lower_total, lower_full = np.zeros((3, len(known)), dtype=np.int64)
            for column, k in ((total, 2), (lower_total, 3), (lower_full, 4)):
                column[number] = np.concatenate([o[k] for o in opened])
            h = np.repeat(number, np.concatenate([o[1] for o in opened]))
            w, lower, times = (np.concatenate([o[k] for o in opened]) for k in (5, 6, 7))
            order = np.lexsort((w, h))
            fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])])
            place = np.empty(len(h), dtype=np.int64)
            place[order] = np.cumsum(fresh) - 1
            first = order[fresh]
            c = _summed(place, times, len(first))
            ids = _numbered(c, bucket, buckets)[1] if more else None
            out, at = [], 0
            for block, o in zip(blocks, opened):
                own = place[at : at + len(o[5])]
                at += len(o[5])
                out.append({"kind": "answer", "bucket": bucket, "block": block, "a": packed(c[own]), "b": packed(np.where(c[own] > 0, ids[own], 0)) if more else None})
            seen = c > 0
            learned = first[seen]
            size = np.bincount(h[learned], minlength=len(known))
            asks = [{"block": block, "own": packed_rising(np.searchsorted(known, o[0]))} for block, o in zip(blocks, opened)]
            out.append({"kind": "gram", "bucket": bucket, "a": packed_rising(known), "b": packed(total), "c": packed(size), "d": packed(w[learned]), "e": packed(c[seen]), "f": packed(lower[learned]), "g": packed(lower_total), "h": packed(lower_full), "asks": asks})
            out.append({"kind": "sums", "bucket": bucket, "sums": [int((c == r).sum()) for r in range(1, K_GT + 2)]})
            yield _reply(out)

    return run


def _weigher(plan: Plan):
    """A row of an n-gram table -> backoff weights, negative for a history whose probabilities are scaled."""
    order = len(plan.discounts) + 1

    def run(batches):
        for batch in batches:
            for bucket, *packs, asks in zip(*(x.to_pylist() for x in batch.columns)):
                known, (total, size, c, u, lower_total, lower_full) = unpacked_rising(packs[0]), map(unpacked, packs[1:])
                h = np.repeat(np.arange(len(known)), size)
                if order == 2:
                    below = plan.unigrams.p(u)
                else:
                    scale = np.where(lower_full > 0, lower_total / (lower_total + 1.0), 1.0) / np.maximum(lower_total, 1)
                    below = scale[h] * _discounted(plan.discounts[-2], u)
                kept = np.bincount(h, weights=_discounted(plan.discounts[-1], c), minlength=len(known))
                lower = np.bincount(h, weights=below, minlength=len(known))
                p = kept / np.maximum(total, 1)
                full = (total > 0) & (p >= 1 - 1e-12)
                weight = np.where(total > 0, np.where(full, 1 / (total + 1.0), 1 - p) / np.maximum(1 - lower, 1e-300), 1.0)
                weight[full] *= -1
                hot = total > plan.limit
                weight[hot] = np.nan
                owns = [(a["block"], unpacked_rising(a["own"])) for a in asks]
                out = [{"kind": "answer", "bucket": bucket, "block": b, "a": packed_floats(weight[own])} for b, own in owns]
                out.append({"kind": "history", "bucket": bucket, "a": packed_rising(known), "b": packed_floats(weight)})
                if hot.any():
                    own = [(b, np.isin(np.arange(len(known)), o)) for b, o in owns]
                    out.append({"kind": "hot", "bucket": bucket, "hot": [{"key": int(known[k]), "kept": kept[k], "lower": lower[k], "total": int(total[k]), "blocks": [b for b, m in own if m[k]]} for k in np.flatnonzero(hot)]})
                yield _reply(out)

    return run


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scorer(plan: Plan):
    def run(batches):
        for row, r in _replays(plan, batches):
            n, v = plan.unigrams.total, plan.unigrams.distinct
            counts = r.counts[r.stream]
            base, logs = np.log10((counts + 0.1) / (n + 0.1 * (v + 1))), np.log10(np.maximum(r.p, 1e-300))
            known, base, logs = (np.add.reduceat(x, r.starts) for x in ((counts > 0).astype(np.int64), base, logs))
            ids, real = np.frombuffer(row["docs"], "<i8").tolist(), np.frombuffer(row["known"], dtype=bool).tolist()
            yield arrow(SCORED, [[d if k else None for d, k in zip(ids, real)], np.frombuffer(row["held"], dtype=bool), r.sizes, known, np.full(len(r.sizes), n), base, logs])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")


def _total(replies: DataFrame, width: int) -> list[int]:
    return [int(x or 0) for x in replies.where("kind = 'sums'").agg(*(F.sum(F.col("sums")[i]) for i in range(width))).first()]


def _answered(plan: Plan, order: int, grams: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies by block, weights of spread histories by block) of one order. Spread histories' sums meet first."""
    replies = [r.where("kind = 'answer'").select("block", F.struct(F.lit(order).alias("order"), F.lit(which).alias("which"), "bucket", "a", "b").alias("r")) for which, r in (("counts", grams), ("weights", weights))]
    spread = weights.where("kind = 'hot'").select(F.explode("hot").alias("x")).select("x.*")
    sums = spread.groupBy("key").agg(F.sum("kept").alias("kept"), F.sum("lower").alias("lower"), F.first("total").alias("total"))
    p = F.col("kept") / F.col("total")
    weight = F.when(p >= 1 - 1e-12, -1 / (F.col("total") + 1.0)).otherwise(1 - p) / F.greatest(1 - F.col("lower"), F.lit(1e-300))
    hots = spread.select("key", F.explode("blocks").alias("block")).distinct().join(sums.select("key", weight.alias("weight")), "key")
    return replies[0].unionByName(replies[1]), hots.select("block", F.struct(F.lit(order).alias("order"), "key", "weight").alias("x"))


def score_documents(docs: DataFrame, held: str, block_bytes: int | None = None, order: int = 2) -> tuple[DataFrame, dict[str, DataFrame]]:
    """docs (doc_id, text, and the boolean column `held`: true rows aren't learned from) -> (scores, model tables).

    scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row for each input row. A null or
    empty text is its end alone. Repeated rows are learned as often. Where nothing is learned, every token is the
    unknown one, with P = 1. An empty table gives an empty result; other columns are ignored. order: words of an n-gram,
    2 or more.
    Tables, a row per bucket of packed arrays: `unigram` (a words, b counts; the r-th word of bucket k of K is number
    r K + k + 1), and for each order `2gram`, ... (a numbers of histories, b their counts, c continuations of each, d their
    words' numbers, e counts) and `2gram_weights`, ... (a histories, b weights; NaN for spread ones)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{held}`").alias("held"), F.col("text").cast("binary").alias("text"))
    if block_bytes is None:
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        block_bytes = max(BLOCK, int((GROWTH * size) ** 0.5))
    blocks = staged(source.mapInArrow(_blocker(block_bytes), "block long, docs binary, known binary, held binary, sizes binary, vocabulary binary, counts binary, stream binary"), "blocks")
    buckets = max(4, SPREAD * blocks.count())
    # Words: numbers and counts of the corpus for each block's vocabulary.
    sent = blocks.select("block", "vocabulary", "counts").mapInArrow(_word_sender(buckets), "bucket long, block long, keys binary, counts binary")
    words = staged(_dealt(sent).mapInArrow(_word_counter(buckets), REPLY), "words", by="kind")
    plan = Plan(Unigrams.of(_total(words, K_GT + 3)), source.where("not held").count(), buckets)
    answers = words.where("kind = 'answer'").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias("answers"))
    tables, replies, hots = {"unigram": words.where("kind = 'unigram'").select("bucket", "a", "b")}, None, None

    def state(*columns: str) -> DataFrame:
        """Blocks with all replies so far."""
        out = blocks.select("block", "held", "sizes", "vocabulary", "stream", *columns).join(answers.hint("merge"), "block")
        if replies is None:
            return out.withColumns({"replies": F.lit(None), "hots": F.lit(None)})
        own = replies.groupBy("block").agg(F.collect_list("r").alias("replies"))
        return out.join(own.hint("merge"), "block", "left").join(hots.groupBy("block").agg(F.collect_list("x").alias("hots")), "block", "left")

    for n in range(2, order + 1):
        # N-grams: counts, then the discounts that need the counts of counts, then weights.
        grams = staged(_dealt(state().mapInArrow(_sender(plan), SENT)).mapInArrow(_gram_counter(buckets, n < order), REPLY), "grams", by="kind")
        plan = replace(plan, discounts=(*plan.discounts, good_turing(_total(grams, K_GT + 1))))
        table_ = grams.where("kind = 'gram'")
        weights = staged(table_.select("bucket", "a", "b", "c", "e", "f", "g", "h", "asks").mapInArrow(_weigher(plan), REPLY), "weights", by="kind")
        own = _answered(plan, n, grams, weights)
        replies, hots = own if replies is None else (replies.unionByName(own[0]), hots.unionByName(own[1]))
        tables[f"{n}gram"], tables[f"{n}gram_weights"] = table_.select("bucket", "a", "b", "c", "d", "e"), weights.where("kind = 'history'").select("bucket", "a", "b")
    scores = state("docs", "known").mapInArrow(_scorer(plan), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores, tables


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: learns outside the held-out tenth, scores every document."""
    docs = table(spark, sf_dir, "documents").withColumn("rill_held", held_out("doc_id", 10, 0))
    return score_documents(docs, "rill_held")[0]
