import random

import numpy as np
import pytest

from rillcep.llm import minhash
from tests.llm.common import awkward, empty, frame, prose


def sets(text):
    w = text.encode().lower().split() if text else []
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def brute(rows, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    made = [(i, sets(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(made):
        for j, b in made[k + 1 :]:
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def variants(seed):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = prose(80, 100 + g).split()
        for v in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{v}"
            rows.append((1000 * g + v + 100, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [500, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = awkward() + variants(5)
    got = minhash.near_duplicates(frame(spark, rows), threshold=0.85).collect()
    want = brute(rows, 85)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {i: len(sets(t)) for i, t in rows if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


@pytest.mark.parametrize("block", [500, 9])
def test_core_and_the_rest(spark, monkeypatch, block):
    """Copies of one text with ever more edits: a core near its smallest, and documents that only each other link to it."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng, rows, words = random.Random(8), [], prose(200, 1).split()
    for v in range(60):
        w = list(words)
        for k in range(v // 6):  # a chain: each six share their edits, the next six have one more
            w[7 + 17 * k] = f"edit{k}"
        w[3] = f"own{v}"
        rows.append((v, " ".join(w)))
    rows += [(100 + v, prose(150, 50 + v // 2) + f" end{v}") for v in range(12)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), threshold=0.85).collect()}
    assert got == brute(rows, 85) and len(set(got.values())) < 12


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_bands():
    for t in (0.8, 0.85, 0.9):
        rows, bands = minhash.banding(t, 140)
        assert rows * bands <= 140 and (1 - t**rows) ** bands <= 1e-3


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64))
    sig = minhash.min_max([a, a[:800]], 200)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08
