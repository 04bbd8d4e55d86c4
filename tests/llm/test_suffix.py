import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillcep.llm import suffix
from tests.llm.common import awkward, empty, frame, prose


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        covered = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                covered[k : k + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        out.append((i, len(t), int(covered.sum()), int((np.diff(np.append([0], covered.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shared():
    passage = prose(40, 50)
    rows = [(100 + k, prose(20 + k, 200 + k) + " " + passage + f" {k} " + prose(9, 300 + k)) for k in range(12)]
    return [*rows, (200, "ab" * 300), (201, "x" * 500), (202, passage + " " + passage), (203, "\0" * 90 + "q" + "\0" * 90)]


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize("width", [40, 150])
def test_against_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = awkward() + shared()
    got = sorted((tuple(r) for r in suffix.removal_report(frame(spark, rows), width).collect()), key=str)
    assert got == brute(rows, width)


def brute_words(rows, width):
    """(doc_id, maximal runs of words under repeated windows, text without them)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, t in texts for w in [t.split()] for k in range(len(w) - width + 1))
    out = []
    for i, t in texts:
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        covered = np.zeros(len(w) + 2, dtype=int)
        for k in range(len(w) - width + 1):
            if seen[tuple(t[a:b] for a, b in w[k : k + width])] > 1:
                covered[k + 1 : k + width + 1] = 1
        starts, stops = np.flatnonzero(np.diff(covered) == 1).tolist(), np.flatnonzero(np.diff(covered) == -1).tolist()
        kept, at = b"", 0
        for a, b in zip(starts, stops):
            kept, at = kept + t[at : w[a][0]], w[b - 1][1]
        out.append((i, list(zip(starts, stops)), (kept + t[at:]).decode()))
    return out


@pytest.mark.parametrize("hot", [4096, 0])
@pytest.mark.parametrize("width", [6, 25])
def test_words_against_brute_force(spark, monkeypatch, width, hot):
    """Windows of words: short words, other white space and case between copies, and a passage in twelve documents."""
    monkeypatch.setattr(suffix, "HOT", hot)
    spaced = "\n".join(prose(40, 50).split())
    rows = awkward() + shared() + [(300, "a b c " * 30), (301, "x " + "b c a " * 20), (302, spaced), (303, spaced.upper())]
    want = brute_words(rows, width)
    df = frame(spark, rows)
    keys = {r["key"]: r["row"] for r in suffix.keyed_texts(df.drop("row")).select("row", F.struct("doc_id", "text").alias("key")).collect()}
    found = {bytes(r["row"]): [tuple(p) for p in r["passages"]] for r in suffix.passages(df, width).collect()}
    assert {bytes(keys[i, t]): runs for (i, t), (_, runs, _) in zip(rows, want) if runs} == found
    cut = suffix.without_repeats(df, width, "words").collect()
    assert sorted(((r.doc_id, r.text) for r in cut), key=str) == sorted(((i, text if t is not None else None) for (i, t), (_, _, text) in zip(rows, want)), key=str)


def test_multikey_sort():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(300)]
    order, lcp = suffix.multikey_sort(strings)
    width = 8 * max(1, -(-max(map(len, strings)) // 8))
    padded = [s.ljust(width, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)
    for k in range(1, len(order)):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert lcp[k] == next((i for i in range(width) if a[i] != b[i]), width)


def test_word_symbols(monkeypatch):
    """Equal words have equal symbols wherever they stand, others not, also when a text is read in pieces."""
    text = (prose(400, 9) + "  a aa aaa \t b\n\x0bé " + "long" * 90 + " " + prose(50, 9)).encode()
    whole = np.frombuffer(suffix.symbols(text, "words"), np.uint64)
    words = text.split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words)) == len(set(zip(words, whole.tolist())))
    monkeypatch.setattr(suffix, "PIECE", 64)
    assert suffix.symbols(text, "words") == whole.tobytes() and suffix.symbols(b" \n", "words") == suffix.symbols(b"", "words") == b""


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 100)
    text = prose(200, 9).encode()
    starts = [o + s for o, piece in suffix._pieces(text, 40) for s in range(len(piece) - 39)]
    assert starts == list(range(len(text) - 39))


def test_cutting_keeps_characters_and_columns(spark):
    passage = "é" * 60
    rows = [(1, "a" + passage + "b"), (2, "ĩ" + passage + "ĩ"), (3, None), (4, "clean text")]
    df = frame(spark, rows)
    out = suffix.without_repeats(df, 41)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "ab" and got[1].n_chars == 2 and got[3].text is None and got[4].text == "clean text"
    assert got[2].text == "ĩĩ" and got[2].row == 7


def test_empty_table(spark):
    assert suffix.removal_report(empty(spark), 50).count() == 0
    assert suffix.without_repeats(empty(spark), 50).count() == 0
