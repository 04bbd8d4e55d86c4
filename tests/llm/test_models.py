"""Toxicity, language identification and the backoff model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillcep.llm import katz, language, toxicity
from rillcep.llm.common import held_out
from tests.llm.common import awkward, empty, frame, prose


def test_fold_rule(spark):
    got = spark.range(200).select("id", held_out("id", 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def toxic_rows(n):
    rng, rows = random.Random(4), []
    for i in range(n):
        words = prose(rng.randint(5, 80), 1000 + i).split()
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["scumbag", "vermin", "rotter"], rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(600)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0 or y], "doc_id long, toxic int")
    fold = held_out("doc_id", 3, 1)
    model = toxicity.train(docs.where(~fold), labels.where(~fold))
    got = toxicity.score(docs, model, "doc_id", "score", name="p").where(fold).collect()
    truth = {i: y for i, _, y in rows}
    assert np.mean([(r.p >= 0.7) == bool(truth[r.doc_id]) for r in got]) >= 0.95
    assert all(r.p < 0.7 for r in got if not truth[r.doc_id])


def test_toxicity_awkward(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model, "doc_id").collect()
    assert len(got) == len(awkward()) and all(0 <= r.score < 0.5 for r in got)
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd), "doc_id").count() == len(awkward())
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), none), "doc_id").count() == 0


def test_non_negative_risk_steps_back():
    rng = np.random.default_rng(1)
    positive = [np.array([1, *rng.integers(100, 200, 3)]) for _ in range(40)]
    unlabelled = [np.array([2, *rng.integers(100, 200, 3)]) for _ in range(60)] + positive[:5]
    names, least = toxicity.supported(positive)
    assert 1 in names and least[names == 1] < 1 and least.min() > 0
    model = toxicity.fit(positive, unlabelled, names, 0.1)
    assert model.weights[1] > 2 and model.bias < 0


def slow_fit(positive, unlabelled, chosen, prior, steps=1200):
    """The same risk and steps, text by text and feature by feature."""
    names = [*chosen.tolist(), None]
    w, m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    w[None] = math.log(prior / (1 - prior))
    sigma = lambda x: 1 / (1 + math.exp(-(w[None] + sum(w[f] for f in x if f in w))))
    for t in range(1, steps + 1):
        p, u = [sigma(x) for x in positive], [sigma(x) for x in unlabelled]
        forward = sum(u) / len(u) - prior * sum(p) / len(p) >= 0
        grad = {f: 3e-6 * w[f] if f is not None else 0.0 for f in names}
        for rows, s, d in ((positive, p, -prior * (2 if forward else -1)), (unlabelled, u, 1 if forward else -1)):
            for x, y in zip(rows, s):
                for f in [*x, None]:
                    if f in grad:
                        grad[f] += d * y * (1 - y) / len(rows)
        for f in names:
            m[f], v[f] = 0.9 * m[f] + 0.1 * grad[f], 0.999 * v[f] + 0.001 * grad[f] ** 2
            w[f] -= 0.05 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-8)
    return w


def test_fit_against_slow():
    rng = np.random.default_rng(3)
    draw = lambda n, low, high: [np.unique(rng.integers(low, high, 4)) for _ in range(n)]
    positive, unlabelled = draw(9, 0, 8), draw(20, 2, 14)
    chosen = np.arange(0, 6)
    model, slow = toxicity.fit(positive, unlabelled, chosen, 0.2, steps=60), slow_fit(positive, unlabelled, chosen, 0.2, 60)
    assert model.bias == pytest.approx(slow[None], abs=1e-6) and model.weights == pytest.approx({f: slow[f] for f in range(6)}, abs=1e-6)


def test_toxicity_of_copies_by_the_thousand(spark):
    """Half of all rows are copies of one toxic text: its words tell as before."""
    rows = toxic_rows(600)
    bad = next(t for i, t, y in rows if y)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(10_000 + i, bad) for i in range(600)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0 or y], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels), "doc_id", name="p").collect()
    truth = {i: y for i, _, y in rows}
    assert np.mean([(r.p >= 0.7) == bool(truth.get(r.doc_id, 1)) for r in got]) >= 0.97


LANGUAGES = {"aa": ["zor", "kel", "mish", "tav", "orn"], "bb": ["aqui", "luma", "eso", "ndo", "rapi"], "cc": ["chw", "stry", "blf", "ngw", "pth"]}


def spoken(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGUAGES[lang]) + rng.choice(LANGUAGES[lang]) for _ in range(n))


def test_language_held_out(spark):
    rows = [(i, spoken(k, 12 + i % 60, i), k) for i, k in enumerate(list(LANGUAGES) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    raw = language.dictionaries(docs.where(~held_out("doc_id", 4, 2)))
    got = language.identify(docs, raw, "doc_id", "lang").where(held_out("doc_id", 4, 2)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_against_slow(spark):
    """Each text under each dictionary, block by block, compressed anew."""
    import zstandard

    rows = [(i, spoken(k, 3 + 90 * (i % 40), i), k) for i, k in enumerate(list(LANGUAGES) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    raw = language.dictionaries(docs)
    assert set(raw) == set(LANGUAGES) and all(0 < len(v) <= language.DICTIONARY for v in raw.values())
    assert all(passage in "\n".join(t.lower() for _, t, k in rows if k == lang) for lang, v in raw.items() for passage in v.decode().split("\n")[:-1])

    def slow(text):
        out = {}
        for lang, content in raw.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data, total = text.lower().encode(), 0
            for at in range(0, len(data), language.BLOCK):
                total += len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[at : at + language.BLOCK]))
            out[lang] = total
        return min(sorted(out), key=out.get)

    got = {r.doc_id: r.lang_pred for r in language.identify(docs, raw, "doc_id").collect()}
    assert got == {i: slow(t) for i, t, _ in rows}


def test_language_awkward(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "12 !? \u0301", "aa"), (4, spoken("bb", 5000, 1), "bb"), (5, spoken("aa", 50, 2), "aa"), (6, "日", None), (None, "kel", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.dictionaries(docs), "doc_id").collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "bb", "aa"]
    assert got[6].lang_pred in ("aa", "bb") and got[1].score == 0 and got[1].rejected
    assert language.dictionaries(empty(spark)) == {}
    assert language.identify(docs, {}, "doc_id").where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty(spark), {}, "doc_id").count() == 0


def brute_katz(rows, order):
    """Rows (doc_id, text, held) scored by dictionaries of n-grams, the start as None."""
    texts = [(i, [None, *(t or "").encode().lower().split(), b""], h) for i, t, h in rows]
    counts, hist = [Counter() for _ in range(order + 1)], Counter()
    for _, w, held in texts:
        for k in range(1, len(w)):
            for n in range(1, min(order, k + 1) + 1):
                counts[n][tuple(w[k - n + 1 : k + 1])] += not held
                hist[tuple(w[k - n + 1 : k])] += not held
    counts = [Counter({g: c for g, c in x.items() if c}) for x in counts]
    uni, total, top = counts[1], sum(counts[1].values()), katz.K_GT + 1
    d = [None] + [katz.good_turing([Counter(x.values())[k] for k in range(1, katz.K_GT + 2)]) for x in counts[1:]]
    left = 1 - sum(d[1][min(c, top)] * c / total for c in uni.values()) if total else 1.0
    scale = {(): 1.0}
    if left <= 1e-15:
        scale[()], left = total / (total + 1), 1 / (total + 1)
    by = defaultdict(list)
    for n in range(2, order + 1):
        for g in counts[n]:
            by[g[:-1]].append(g)
    weight = {}

    def prob(g):
        n, h = len(g), g[:-1]
        if n == 1:
            return scale[()] * d[1][min(uni[g], top)] * uni[g] / total if uni[g] else left
        if not hist[h]:
            return prob(g[1:])
        return scale[h] * d[n][min(counts[n][g], top)] * counts[n][g] / hist[h] if counts[n][g] else weight[h] * prob(g[1:])

    for h in sorted(by, key=len):
        p, scale[h] = sum(d[len(h) + 1][min(counts[len(h) + 1][g], top)] * counts[len(h) + 1][g] for g in by[h]) / hist[h], 1.0
        if p >= 1 - 1e-12:
            p = scale[h] = hist[h] / (hist[h] + 1)
        weight[h] = (1 - p) / (1 - sum(prob(g[1:]) for g in by[h]))
    for h in sorted(by, key=str)[:3] + sorted(by, key=lambda h: -len(by[h]))[:3]:
        unknown = weight[h] * math.prod(weight[h[k:]] if hist[h[k:]] else 1 for k in range(1, len(h))) * left
        assert sum(prob((*h, w)) for (w,) in uni) + unknown == pytest.approx(1)
    out = []
    for i, w, held in texts:
        base = sum(math.log10((uni[x,] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w[1:])
        score = sum(math.log10(prob(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(1, len(w)))
        out.append((i, held, len(w) - 1, sum(uni[x,] > 0 for x in w[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("block", [None, 600])
def test_katz_against_brute_force(spark, block, order):
    rows = awkward() + [(100 + i, prose(30, 500 + i)) for i in range(40)] + [(200, "the " * 4000 + "the end the start"), (201, "never seen words")]
    rows += [(300 + i, prose(30, 500 + i) + " " + prose(9, 600 + i)) for i in range(20)]  # what longer orders have seen
    rows = [(i, t, i is not None and i % 7 == 0) for i, t in rows]
    df = frame(spark, [(i, t) for i, t, _ in rows]).withColumn("fold", F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False)))
    scores, tables = katz.score_documents(df, "fold", block, order)
    got = sorted((tuple(r) for r in scores.collect()), key=lambda r: str(r[:4]))
    want = sorted(brute_katz(rows, order), key=lambda r: str(r[:4]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for k in (5, 6):
        assert [g[k] for g in got] == pytest.approx([w[k] for w in want])
    assert len(tables) == 2 * order - 1 and all(t.count() > 0 for t in tables.values())


def test_katz_counts_beyond_32_bits():
    """Counts of two blocks whose sum passes 2 ** 32, as they travel and meet."""
    values = np.array([0, 1, 255, 256, 2**32 + 5, 2**56, 2**63 - 1])
    assert katz.unpacked(katz.packed(values)).tolist() == values.tolist()
    assert katz.unpacked(katz.packed(np.zeros(0, dtype=np.int64))).tolist() == []
    keys = np.array([7, 9], dtype=np.uint64).tobytes()
    batch = pa.RecordBatch.from_pylist([{"bucket": 0, "block": b, "keys": keys, "counts": katz.packed(np.array([2**32 - 1, 3]))} for b in range(2)])
    rows = [r for b in katz._word_counter(4)([batch]) for r in b.to_pylist()]
    assert [katz.unpacked(r["a"]).tolist() for r in rows if r["kind"] == "answer"] == [[2**33 - 2, 6]] * 2
    assert next(r["sums"] for r in rows if r["kind"] == "sums")[0] == 2**33 + 4
    one = {"bucket": 0, "histories": katz.packed_rising(np.array([2**40])), "lengths": katz.packed([1]), "totals": katz.packed([2**35]), "lower_totals": katz.packed([9]), "lower_full": katz.packed([0]), "words": katz.packed([5]), "lower": katz.packed([2**34]), "times": katz.packed([2**32])}
    batch = pa.RecordBatch.from_pylist([{**one, "block": b} for b in range(2)]).select(katz.GRAMS.names)
    rows = [r for b in katz._gram_counter(4, True)([batch]) for r in b.to_pylist()]
    assert [katz.unpacked(r["a"]).tolist() for r in rows if r["kind"] == "answer"] == [[2**33]] * 2
    found = next(r for r in rows if r["kind"] == "gram")
    assert (katz.unpacked(found["b"])[0], katz.unpacked(found["e"])[0], katz.unpacked(found["f"])[0]) == (2**35, 2**33, 2**34)


def test_katz_nothing_learned(spark):
    df = frame(spark, awkward()).withColumn("fold", F.lit(True))
    got = katz.score_documents(df, "fold")[0].collect()
    assert len(got) == len(awkward()) and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert katz.score_documents(empty(spark).withColumn("fold", F.lit(False)), "fold")[0].count() == 0


def test_good_turing():
    d = katz.good_turing([1000, 400, 200, 110, 70, 45])
    assert (d[1:-1] > 0).all() and (d[1:-1] < 1).all() and d[-1] == 1
    assert katz.good_turing([0] * 6)[1] == 0.5
    assert (katz.good_turing([100, 300, 10, 50, 5, 7])[1:-1] > 0).all()
