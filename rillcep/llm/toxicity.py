"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., NeurIPS 2017).

Confirmed toxic texts are the positives; a sample of all texts, labelled or not, is the unlabelled set; the share of
toxic rows among labelled ones is the class prior pi. A linear model minimises
    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])
with the sigmoid loss, bounded as the paper advises: a prior that is off shifts scores little. When the bracket turns
negative, the step goes back along it instead.
Features are words and word beginnings of four and five letters (inflections share those): all whose share among the
positives, two standard deviations down, is above their share among all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, held_out, table

LETTERS = re.compile(r"[^\W\d_]+")

#: Bounds of the fit: rows taken of each kind, by hash of the id. The features' shares are counted over all texts.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
#: Texts that hold as large a share of all rows count once in those shares, like one text.
FREQUENT = 0.001


def word_features(word: str) -> list[int]:
    """64-bit names of a lower-cased word's features."""
    parts = [word, *(f"^{word[:n]}" for n in (4, 5) if len(word) > n)]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


class _Memo(dict):
    """word -> made(word), forgotten beyond a bound."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = value = self.made(word)
        return value


def features(text: str | None, memo: dict) -> set[int]:
    return set().union(*map(memo.__getitem__, set(LETTERS.findall(text.lower())))) if text else set()


@dataclass(frozen=True)
class Model:
    """Weights by feature name, and a bias."""

    weights: dict[int, float]
    bias: float


def supported(positive: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(names, least share) of the features that may be chosen: the share among the positives less two deviations."""
    names, df = np.unique(np.concatenate([*positive, np.zeros(0, np.int64)]), return_counts=True)
    least = (df - 2 * np.sqrt(df)) / max(1, len(positive))
    return names[least > 0], least[least > 0]


def _sparse(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in chosen) of every chosen feature."""
    flat, row = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.minimum(np.searchsorted(chosen, flat), max(0, len(chosen) - 1))
    fits = chosen[at] == flat if len(chosen) else np.zeros(len(flat), dtype=bool)
    return row[fits], at[fits]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.05, decay: float = 3e-6) -> Model:
    """nnPU fit on feature arrays of confirmed toxic and of unlabelled texts; without positives, all scores are low."""
    if not positive or not unlabelled:
        return Model({}, -4.0)
    (rp, ip), (ru, iu), p, u = _sparse(positive, chosen), _sparse(unlabelled, chosen), len(positive), len(unlabelled)
    prior, n = min(max(prior, 0.01), 0.9), len(chosen)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigma(np.bincount(rp, weights=w[ip], minlength=p) + b), sigma(np.bincount(ru, weights=w[iu], minlength=u) + b)
        risk_n = su.mean() - prior * sp.mean()
        d_pos = d_neg_p = -prior * sp * (1 - sp) / p
        d_neg_u = su * (1 - su) / u
        if risk_n >= 0:
            dp, du = d_pos + d_neg_p, d_neg_u
        else:
            dp, du = -d_neg_p, -d_neg_u
        grad = np.bincount(ip, weights=dp[rp], minlength=n) + np.bincount(iu, weights=du[ru], minlength=n) + decay * w
        grad = np.append(grad, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(dict(zip(chosen.tolist(), w.tolist())), float(b))


FEATURED = pa.schema([("text", pa.int64()), ("names", pa.list_(pa.int64()))])


def _featurer(kept: set[int] | None):
    """(hash of the text, text) -> the features of the text, of those kept if given."""

    def run(batches):
        memo = _Memo(word_features if kept is None else lambda word: [f for f in word_features(word) if f in kept])
        for batch in batches:
            yield arrow(FEATURED, [batch.column(0), [sorted(features(t, memo)) for t in batch.column(1).to_pylist()]])

    return run


COUNTED = pa.schema([("name", pa.int64()), ("n", pa.int64())])


def _counter(kept: set[int]):
    """Texts -> the number of texts with each kept feature, once for a task; under the name -1, of all texts."""

    def run(batches):
        memo, n = _Memo(lambda word: [f for f in word_features(word) if f in kept]), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(features(text, memo))
            n[-1] += batch.num_rows
        yield arrow(COUNTED, [list(n.keys()), list(n.values())])

    return run


def _arrays(texts: DataFrame, kept: set[int] | None) -> list[np.ndarray]:
    """Feature arrays of a bounded number of texts; copies of one text are one example."""
    rows = texts.select(F.xxhash64("text").alias("key"), "text").mapInArrow(_featurer(kept), "text long, names array<long>").toArrow()
    arrays = [np.asarray(n.values) if n.values is not None else np.zeros(0, np.int64) for n in rows.column("names")]
    return list(dict(zip(rows.column("text").to_pylist(), arrays)).values())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on docs (doc_id, text) and labels (doc_id, toxic); both may be cut to a fold first.

    The fit sees MAX_POSITIVE confirmed toxic and MAX_UNLABELLED texts at most; what share of texts has a feature is
    counted over all of docs, where a text that holds FREQUENT of all rows counts once. Labels of a null doc_id or toxic
    are ignored, of several labels of a document the largest counts; rows of a null doc_id can't be in either sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("toxic")).first()[0]
    order = F.xxhash64("doc_id", F.lit(17))
    sampled = lambda ids, n: docs.select("doc_id", "text").join(F.broadcast(ids.orderBy(order, "doc_id").limit(n)), "doc_id")
    positive = _arrays(sampled(known.where("toxic = 1").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id"), MAX_POSITIVE), None)
    names, least = supported(positive)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    same = docs.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    frequent = same.where(F.col("n") > F.greatest(F.lit(1), docs.select(F.count("*") * FREQUENT).scalar()))  # 1 / FREQUENT rows at most
    once = docs.select("doc_id", "text", key.alias("own")).join(F.broadcast(frequent), F.col("own") == F.col("key"), "left")
    once = once.where("key is null or doc_id = first").select("text")
    counts = once.mapInArrow(_counter(set(names.tolist())), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()
    counts = {r["name"]: r["n"] for r in counts}
    share = np.array([counts.get(f, 0) for f in names.tolist()]) / max(1, counts.get(-1, 0))
    chosen = names[least > share]
    unlabelled = _arrays(sampled(docs.where("doc_id is not null").select("doc_id"), MAX_UNLABELLED), set(chosen.tolist()))
    return fit(positive, unlabelled, chosen, prior or 0.0)


def _scorer(model: Model):
    kept = set(model.weights)

    def run(batches):
        memo = _Memo(lambda word: tuple(f for f in word_features(word) if f in kept))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                g = model.bias + sum(model.weights[f] for f in sorted(features(text, memo)))
                out.append(1 / (1 + np.exp(-min(max(g, -30.0), 30.0))))
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(out, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """The columns `keep` of docs and `name`: the probability that the whole text is toxic.

    Null and empty texts score the model's bias alone. One row for each input row; other columns are ignored."""
    d = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text"))
    schema = ", ".join([f"{n} {t}" for n, t in d.dtypes[:-1]] + ["score double"])
    return d.mapInArrow(_scorer(model), schema).toDF(*keep, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: learns outside the held-out third, scores every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = held_out("doc_id", 3, 1)
    model = train(docs.where(~fold), labels.where(~fold))
    out = score(docs, model, "doc_id")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
