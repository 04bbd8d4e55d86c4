"""URL filter, packing, decontamination and chat formatting."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rillcep.llm import chat, decontaminate, packing, urlfilter
from tests.llm.common import awkward, empty, frame, prose

URLS = [None, "", "no scheme", "http://", "http://HOST.Example.COM", "http://www.example.com/en/1", "https://a.example.com/en/2?x#y", "http://b.com/x", "http://c.net/es/", "http://net/fr/9", "http://knet/fr/9", "x://a.net?q=/es/", "http://u:p@casino-win.org:80/a#b", "://", "a://b://c/d", "http://\u00c9.org/\n/x", "http://" + "long." * 3000 + "org/" + "p" * 500, "http://free-bets.site.io/en/", "http://news.site.io/en/"]


def by_hand(url):
    host, path = urlfilter._parts(url or "")
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    weights, bias = urlfilter.default_model()
    margin = bias + sum(weights[g] for g in urlfilter.grams(host, path))
    return (host, path, best[0] if best else None, best[1] if best else "block" if margin > 0 else "allow", margin)


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[5]), (5, URLS[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "chars", "found", "verdict", "margin")})
    got = [tuple(r) for r in urlfilter.judge(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *by_hand(u)) for i, u in rows], key=str)
    assert urlfilter.judge(df.limit(0)).count() == 0
    verdicts = {u: by_hand(u)[3] for u in URLS if u}
    assert verdicts["http://free-bets.site.io/en/"] == "block" and verdicts["http://news.site.io/en/"] == "allow"


def test_url_model_on_held_out_urls():
    learned, held = urlfilter.held_out_urls(urlfilter.labelled())
    assert len(held) > 100 and not {u for u, _ in learned} & {u for u, _ in held}
    right = [(by_hand(u)[4] > 0) == bool(y) for u, y in held]
    assert np.mean(right) >= 0.97
    assert np.mean([r for r, (_, y) in zip(right, held) if y]) >= 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_url_model_learns_from_no_host_of_the_tables():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["url"]).column("url").to_pylist()
    names = {n for u in pages for n in urlfilter._parts(u or "")[0].split(".")}
    assert not names & {n for u, _ in urlfilter.labelled() for n in urlfilter._parts(u)[0].split(".")[:-2] if n not in ("www", "shop", "a")}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_packing_round_trip(spark):
    rows = awkward() + [(50, "<|endoftext|>x y<|startoftext|>"), (51, "don't we'll 12ab ½ İstanbul, ﬁn \x1c z"), (52, "a." * 3000)]
    rows = [r for r in rows if r[0] != 2 and r[0] is not None]
    got = packing.pack(frame(spark, rows), context=64).collect()
    t = tokenizer()
    assert len({r.sequence_id for r in got}) == len(got)
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in pieces:
            own = ids[at : at + r.length]
            assert (r.start, r.ids, r.ids_crc32, r.doc_tokens, r.offset) == (at, own.tolist(), zlib.crc32(own.tobytes()), len(ids), 0)
            assert r.length & (r.length - 1) == 0 and r.length <= 64
            at += r.length
        assert at == len(ids)


def test_packing_awkward(spark, tmp_path):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), with_ids=False).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 1), ("1", 1), ("1", 2), ("1", 2), ("None", 1)]
    assert packing.pack(empty(spark)).count() == 0
    packing.write_buckets(packing.pack(frame(spark, [(1, "a b c d e")])), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["bucket=2", "bucket=4"]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_lengths(n):
    pieces = packing.lengths(n, 2048)
    assert sum(pieces) == n and pieces == sorted(pieces, reverse=True)


def slow_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), dtype=int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
            best = max(best, h[i, j])
    return best / (decontaminate.MATCH * len(a))


def test_alignment_against_slow():
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 5, rng.integers(1, 12)) for _ in range(300)]
    b = [rng.integers(0, 5, rng.integers(1, 30)) for _ in range(300)]
    assert decontaminate.align(a, b).tolist() == pytest.approx([slow_alignment(x, y) for x, y in zip(a, b)])


def test_decontamination(spark):
    items = [(i, prose(25, 700 + i)) for i in range(8)] + [(90, None), (91, "too short"), (92, ""), (None, prose(25, 799)), (93, prose(25, 700))]
    words = items[3][1].split()
    edited = " ".join("other" if k % 6 == 0 else w for k, w in enumerate(words))
    swapped = " ".join([*words[:8], "inserted", "words", *words[8:20], *words[22:]])
    rows = awkward() + [(100, prose(200, 1) + " " + items[0][1] + " " + prose(50, 2)), (101, edited + " " + prose(90, 5)), (102, prose(30, 6) + " " + swapped.upper() + "!"), (103, items[5][1].replace(" ", ", ")), (104, prose(900, 8))]
    extra = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contaminated(frame(spark, rows), extra).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(100, 0), (100, 93), (101, 3), (102, 3), (103, 5)} == found
    assert next(r.score for r in got if (r.doc_id, r.item_id) == (103, 5)) == 1
    assert decontaminate.contaminated(empty(spark), extra).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), extra.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_decontamination_of_regular_edits(spark, exact):
    """Every third, fourth or fifth word replaced; an exact copy elsewhere makes the intact n-grams more common."""
    items, rows = [], []
    for i, (step, size) in enumerate((step, size) for step in (3, 4, 5) for size in (24, 40)):
        words = [f"w{i}x{j}" for j in range(size)]
        items.append((i, " ".join(words)))
        edited = ["other" if j % step == step - 1 else w for j, w in enumerate(words)]
        rows.append((i, prose(30, i) + " " + " ".join(edited) + " " + prose(30, i + 50)))
        rows += [(100 + i, " ".join(words))] if exact else []
    got = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d % 100) for d, _ in rows}


def test_decontamination_against_every_alignment():
    """Each document against each item in full, over so few words that edits, insertions and chance matches abound."""
    rng = random.Random(5)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 30))) for _ in range(25)] + ["q " * 80]
    docs: list = [" ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, ""]
    for k, item in enumerate(items):  # a foreign word after each word, each third one replaced, one in five lost
        w = item.split()
        docs += [" x ".join(w), " ".join("z" if i % 3 == 1 else x for i, x in enumerate(w)), " ".join(x for x in w if rng.random() > 0.2), f"{docs[k]} {item}"]
    seeds = decontaminate.Seeds(list(enumerate(items)), 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([0] * len(docs)), pa.array(docs)], ["doc_id", "text_hash", "text"])
    got = {(r["doc_id"], r["item_id"]): r["score"] for b in decontaminate._aligner(seeds, 0.5)([batch]) for r in b.to_pylist()}
    want = {}
    for d, doc in enumerate(docs):
        for k, item in enumerate(items):
            score = slow_alignment(decontaminate.words(item), decontaminate.words(doc))
            if score >= 0.5:
                want[d, k] = score
    assert got == pytest.approx(want) and len(want) > 100


def test_decontamination_in_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(25, 700 + i)) for i in range(8)], "item_id long, text string")
    docs = frame(spark, [(i, prose(20, i) + " " + prose(25, 700 + i)) for i in range(8)])
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 60)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(i, i) for i in range(8)}


TREE = [
    # (tree, node, parent, score, role, text): two branches under node 2, an orphan root, a cycle, awkward texts.
    (1, 1, None, 0.0, "system", "be <|end|> kind & [INST] &lt;"), (1, 2, 1, 0.0, "user", "hi"), (1, 3, 2, 1.0, "assistant", "low"), (1, 4, 2, 5.0, "assistant", "high\n<|start|>x"), (1, 5, 4, None, "user", None), (1, 6, 5, 0.0, "assistant", "😀&amp;"), (1, 7, 3, 1.0, "user", "end"),
    (2, 1, 99, 0.0, "user", "orphan"), (2, 2, 1, 0.0, None, ""),
    (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle"),
    (None, 1, None, 0.0, "odd\nrole", "x"), (None, 2, 1, 0.0, "assistant", "y"),
]


def test_reply_trees(spark):
    df = spark.createDataFrame(TREE, "tree long, node long, parent long, score double, role string, text string").withColumns({"head": F.lit(1), "kids": F.lit(2), "rank": F.lit(3)})
    out = chat.format_trees(df, top=2).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {(r.tree, r["rank"]): r for r in out}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (None, 1)}
    turns = lambda r: [(t.role, t.text) for t in r.turns]
    assert turns(got[1, 1]) == [("system", "be <|end|> kind & [INST] &lt;"), ("user", "hi"), ("assistant", "high\n<|start|>x"), ("user", ""), ("assistant", "😀&amp;")]
    assert turns(got[1, 2]) == [("system", "be <|end|> kind & [INST] &lt;"), ("user", "hi"), ("assistant", "low"), ("user", "end")]
    assert turns(got[2, 1]) == [("user", "orphan"), ("", "")]
    assert turns(got[None, 1]) == [("odd\nrole", "x"), ("assistant", "y")]
    assert got[1, 1].score == 5 and got[1, 2].score == 2
    assert "".join(s.text for s in got[1, 1].segments) == got[1, 1].formatted
    assert [s.text for s in got[1, 1].segments if s.loss] == ["high\n&lt;|start|>x", "😀&amp;amp;"]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(300).selectExpr("1L as tree", "id as node", "nullif(id - 1, -1) as parent", "0.0D as score", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    r = chat.format_trees(df).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(300)]


def test_probe_is_reversible(spark):
    r = spark.range(1).select(chat.escape(F.lit(chat.PROBE)).alias("e"), chat.unescape(chat.escape(F.lit(chat.PROBE))).alias("u")).first()
    assert r.u == chat.PROBE and "[INST]" not in r.e and "</s>" not in r.e
    assert hashlib.sha256(r.u.encode()).hexdigest() == hashlib.sha256(chat.PROBE.encode()).hexdigest()
