"""Exact substring deduplication over a distributed, sampled suffix array.

A window is a string of `width` symbols inside a document; a symbol is a byte, or a word where the unit is words (its
64-bit hash stands for it, so windows of words don't depend on white space). Which windows occur twice is decided by
sorting suffixes, but only at anchors: the anchor of a window is the position of its smallest gram hash (leftmost on
ties), so equal windows have the same anchor and a suffix array of the anchors serves all windows. An anchor with the
consecutive windows that chose it is one record, about one for each (width-gram)/2 symbols.

1. Records are pre-aggregated: those with equal surroundings are one class. A class of two records or more repeats
   as a whole; an anchor whose gram occurs once cannot belong to a repeat and goes.
2. The remaining suffixes are dealt by sampled splitters on their leading bytes (repartitionByRange), so that equal
   leading grams meet; each bucket is sorted by multikey quicksort, once by the text after the anchor and once by
   the reversed text before it. Windows are equal just where both ranks agree to the depth they need.
3. Grams with over HOT distinct surroundings would straddle buckets; their windows are compared across buckets by a
   128-bit digest, dealt by that digest, so no task holds a hot group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, discard, mix64, random64, staged, sub_batches, table

#: Symbols of an anchor's gram, and the bytes of a symbol.
GRAM, SIZE = {"bytes": 64, "words": 8}, {"bytes": 1, "words": 8}
#: Distinct surroundings of one gram that are sorted in one bucket.
HOT = 4096
#: Suffixes sorted together in a task.
SORTED = 16_384
#: Symbols of a text scanned at once; longer texts are scanned in overlapping pieces.
PIECE = 2 << 20

_TABLE = random64(256, 101)
_BASE = int(random64(1, 103)[0]) | 1
_POWERS = [np.ones(0, dtype=np.uint64)] * 2


def _powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse; they are kept, as many as the longest piece needed."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step)
    return _POWERS


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words [^\\x20\\x09-\\x0D]+ in bytes."""
    edges = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(text, dtype=np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def symbols(text: bytes, unit: str) -> bytes:
    """A text as the bytes of its symbols; a word's is its length and rolling polynomial hash, mixed."""
    if unit == "bytes":
        return text
    data, (starts, ends) = np.frombuffer(text, dtype=np.uint8), word_bounds(text)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):  # words of about PIECE bytes at once
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        powers, inverses = _powers(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data[first:last]] * powers[: last - first], out=sums[1:])
        lo, hi = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix64((sums[hi] - sums[lo]) * inverses[lo] + (hi - lo).astype(np.uint64))
        at = to
    return out.tobytes()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes that start at each position (rolling polynomial modulo 2**64, then mixed)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else mix64(data)) * powers[: len(data)], out=sums[1:])
    return mix64((sums[gram:] - sums[:n]) * inverses[:n])


def sliding_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of `span` values, by prefix and suffix minima of blocks."""
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def anchors(data: np.ndarray, width: int, gram: int):
    """(anchor, first window, last window, gram hash) arrays of a text: each window start lies in just one run."""
    span = width - gram + 1
    hashes = gram_hashes(data, gram)
    if len(hashes) < span:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_minimum(ranked, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last, hashes[at[first]]


def _pieces(text, width: int):
    """(offset, symbols) pieces whose windows partition those of the text."""
    if len(text) <= PIECE + width:
        yield 0, text
        return
    for at in range(0, len(text) - width + 1, PIECE):
        yield at, text[at : at + PIECE + width - 1]


RECORDS = pa.schema([("row", pa.binary()), ("gram", pa.int64()), ("around", pa.binary()), ("p", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _recorder(width: int, gram: int, unit: str):
    kind, size = (np.uint8, 1) if unit == "bytes" else (np.uint64, 8)

    def run(batches):
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in sub_batches(texts, 4 << 20):
                out = [[], [], [], [], [], []]
                for row, text in zip(rows[start:stop], texts[start:stop]):
                    text = symbols(text or b"", unit)
                    if len(text) < width * size:
                        continue
                    for off, piece in _pieces(np.frombuffer(text, dtype=kind), width):
                        p, lo, hi, h = anchors(piece, width, gram)
                        out[0] += [row] * len(p)
                        out[1].append(h.view(np.int64))
                        out[2] += [xxhash.xxh3_128_digest(piece[a : b + width].data, seed=c - a) for a, b, c in zip(lo.tolist(), hi.tolist(), p.tolist())]
                        for k, v in ((3, p), (4, lo), (5, hi)):
                            out[k].append(v + off)
                if out[0]:
                    yield arrow(RECORDS, [out[0], np.concatenate(out[1]), out[2], *(np.concatenate(x) for x in out[3:])])

    return run


SUFFIXES = pa.schema([("row", pa.binary()), ("gram", pa.int64()), ("p", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("single", pa.bool_()), ("hot", pa.bool_()), ("lead", pa.binary()), ("context", pa.binary())])


def _cutter(width: int, gram: int, unit: str):
    """Rows (row, text, records) -> one row per wanted record with its surroundings."""
    size = SIZE[unit]

    def run(batches):
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in sub_batches(texts, 4 << 20):
                out = [[] for _ in SUFFIXES]
                for i in range(start, stop):
                    text = symbols(texts[i], unit)
                    for r in batch.column(2)[i].as_py():
                        p = r["p"]
                        for column, v in zip(out, (rows[i], r["gram"], p, r["lo"], r["hi"], r["single"], r["hot"], text[p * size : (p + gram) * size], text[r["lo"] * size : (r["hi"] + width) * size])):
                            column.append(v)
                yield arrow(SUFFIXES, out)

    return run


def multikey_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): a multikey quicksort by eight-byte keys, refining only groups still tied; lcp[i] is the common
    prefix of order[i-1] and order[i] in bytes, with strings zero-padded to the longest."""
    n = len(strings)
    depth = max(1, -(-max((len(s) for s in strings), default=1) // 8))
    keys = np.frombuffer(b"".join(s.ljust(8 * depth, b"\0") for s in strings), dtype=">u8").reshape(n, depth).astype(np.uint64)
    order, lcp = np.arange(n), np.full(n, 8 * depth, dtype=np.int64)
    lcp[:1] = 0
    tied = np.arange(n)  # places in the order whose group has more than one string
    group = np.zeros(n, dtype=np.int64)
    for d in range(depth):
        if len(tied) < 2:
            break
        key = keys[order[tied], d]
        by = np.lexsort((key, group))
        order[tied] = order[tied][by]
        key = key[by]
        inside = group[1:] == group[:-1]
        differ = np.flatnonzero(inside & (key[1:] != key[:-1]))
        x = key[differ] ^ key[differ + 1]
        same = np.zeros(len(x), dtype=np.int64)
        for b in range(1, 8):
            same += (x >> np.uint64(64 - 8 * b)) == 0
        lcp[tied[differ + 1]] = 8 * d + same
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(fresh) - 1
        keep = np.bincount(group)[group] > 1
        tied, group = tied[keep], group[keep]
    return order, lcp


def repeated_windows(befores: list[bytes], afters: list[bytes], least: np.ndarray, most: np.ndarray, width: int, size: int = 1) -> np.ndarray:
    """flags[i, d]: the window that starts d symbols before anchor i is also a window of another anchor here.

    befores/afters: text before (reversed) and from each anchor; windows exist for d in least..most. size: of a symbol."""
    n, deepest = len(afters), int(most.max())
    flags = np.zeros((n, deepest + 1), dtype=bool)
    ranked = [multikey_sort(x) for x in (afters, befores)]
    places = np.arange(n)

    def classes(which: int, depth: int) -> np.ndarray:
        order, lcp = ranked[which]
        out = np.empty(n, dtype=np.int64)
        out[order] = np.maximum.accumulate(np.where(lcp < depth, places, 0))
        return out

    for d in range(int(least.min()), deepest + 1):
        valid = np.flatnonzero((least <= d) & (d <= most))
        if len(valid) < 2:
            continue
        key = classes(0, (width - d) * size)[valid] * n + (classes(1, d * size)[valid] if d else 0)
        by = np.argsort(key, kind="stable")
        tie = key[by][1:] == key[by][:-1]
        flags[valid[by], d] = np.concatenate([tie, [False]]) | np.concatenate([[False], tie])
    return flags


SPANS = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])


def _sorter(width: int, size: int):
    """Suffixes sorted by (lead, gram) -> spans of the singles' repeated windows; whole gram groups are taken together."""

    def solve(items):
        rows, p, lo, hi, single, context = (list(x) for x in zip(*items))
        p, lo, hi = np.array(p), np.array(lo), np.array(hi)
        cuts = ((p - lo) * size).tolist()
        flags = repeated_windows([c[:k][::-1] for c, k in zip(context, cuts)], [c[k:] for c, k in zip(context, cuts)], p - hi, p - lo, width, size)
        flags[~np.array(single)] = False
        edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (who, d1), (_, d2) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        return arrow(SPANS, [[rows[i] for i in who], p[who] - (d2 - 1), p[who] - d1 + width])

    def run(batches):
        items, mark, last = [], 0, None
        for batch in batches:
            for row, gram, p, lo, hi, single, context in zip(*(c.to_pylist() for c in batch.columns)):
                if gram != last:
                    if len(items) >= SORTED:
                        yield solve(items)
                        items = []
                    last = gram
                items.append((row, p, lo, hi, single, context))
        if items:
            yield solve(items)

    return run


WINDOWS = pa.schema([("row", pa.binary()), ("digest", pa.binary()), ("start", pa.int64()), ("single", pa.bool_())])


def _digester(width: int, size: int):
    """Hot suffixes -> a digest of every window."""

    def run(batches):
        for batch in batches:
            for row, p, lo, hi, single, context in zip(*(c.to_pylist() for c in batch.columns)):
                n = hi - lo + 1
                yield arrow(WINDOWS, [[row] * n, [xxhash.xxh3_128_digest(context[k * size : (k + width) * size]) for k in range(n)], np.arange(lo, hi + 1), [single] * n])

    return run


def repeated_spans(keyed: DataFrame, width: int, unit: str = "bytes") -> DataFrame:
    """keyed (row: binary, text: binary) -> row, spans array<struct<start, stop>>: symbols under repeated windows.

    Spans may overlap or touch; rows without any are absent."""
    gram, size = min(GRAM[unit], (width + 1) // 2), SIZE[unit]
    records = staged(keyed.mapInArrow(_recorder(width, gram, unit), "row binary, gram long, around binary, p long, lo long, hi long"), "anchors")
    classes = records.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "p", "lo", "hi")).alias("r"))
    classes = staged(classes, "classes")
    grams = classes.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = records.join(classes.where("n > 1").select("gram", "around"), ["gram", "around"]).select("row", F.col("lo").alias("start"), (F.col("hi") + width).alias("stop"))
    wanted = classes.join(grams, "gram").select("r.row", F.struct("gram", "r.p", "r.lo", "r.hi", (F.col("n") == 1).alias("single"), (F.col("kinds") > HOT).alias("hot")).alias("record"))
    wanted = wanted.groupBy("row").agg(F.collect_list("record").alias("records"))
    cut = keyed.dropDuplicates(["row"]).join(wanted, "row").select("row", "text", "records")
    suffixes = staged(cut.mapInArrow(_cutter(width, gram, unit), "row binary, gram long, p long, lo long, hi long, single boolean, hot boolean, lead binary, context binary"), "suffixes")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.where("not hot").repartitionByRange(parts, "lead").sortWithinPartitions("lead", "gram")
    spans = "row binary, start long, stop long"
    ordered = dealt.select("row", "gram", "p", "lo", "hi", "single", "context").mapInArrow(_sorter(width, size), spans)
    windows = suffixes.where("hot").select("row", "p", "lo", "hi", "single", "context").mapInArrow(_digester(width, size), "row binary, digest binary, start long, single boolean")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    crossing = windows.where("single").join(twice, "digest").select("row", "start", (F.col("start") + width).alias("stop"))
    found = whole.unionByName(ordered).unionByName(crossing)
    made = found.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    made.staged_tables = (records, classes, suffixes)
    return made


def merged(spans) -> list[tuple[int, int]]:
    """Maximal covered runs of (start, stop) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """docs with `row`: a key of doc_id and text, equal for repeated rows only, and `bytes`: the text, null as empty."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.length(text))
    return docs.withColumns({"bytes": text, "row": F.unhex(F.substring(F.md5(key.cast("binary")), 1, 24))})


def with_spans(docs: DataFrame, width: int, unit: str = "bytes") -> DataFrame:
    """docs plus row, bytes and spans (null: nothing repeats)."""
    keyed = keyed_texts(docs)
    spans = repeated_spans(keyed.selectExpr("row", "bytes as text"), width, unit)
    out = keyed.join(spans, "row", "left")
    out.staged_tables = spans.staged_tables
    return out


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("row", pa.binary())])


def _reporter(batches):
    for batch in batches:
        out = [[] for _ in REPORT]
        for doc, row, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            runs = merged((s["start"], s["stop"]) for s in spans or ())
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            for column, v in zip(out, (doc, len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), row)):
                column.append(v)
        yield arrow(REPORT, out)


def _removals(docs: DataFrame, width: int) -> DataFrame:
    d = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    out = d.select("doc_id", "row", "bytes", "spans").mapInArrow(_reporter, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, row binary")
    out.staged_tables = d.staged_tables
    return out


def removal_report(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text, ...).

    Null and empty texts have no bytes. Repeated rows are occurrences of their text like any other. A null doc_id is
    kept as null. Texts shorter than `width` bytes keep everything. An empty table gives an empty result."""
    return _removals(docs, width).drop("row")


RUNS = pa.schema([("row", pa.binary()), ("passages", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _joiner(batches):
    for batch in batches:
        runs = [[{"start": a, "stop": b} for a, b in merged((s["start"], s["stop"]) for s in spans)] for spans in batch.column(1).to_pylist()]
        yield arrow(RUNS, [batch.column(0), runs])


def passages(docs: DataFrame, words: int = 51) -> DataFrame:
    """row, passages array<struct<start, stop>>: maximal runs of words (numbered in their text) under repeated windows
    of `words` words, of the texts that have any; row is the key of keyed_texts."""
    keyed = keyed_texts(docs.select("doc_id", "text"))
    spans = repeated_spans(keyed.selectExpr("row", "bytes as text"), words, "words")
    return spans.select("row", "spans").mapInArrow(_joiner, "row binary, passages array<struct<start: long, stop: long>>")


def _snapped(text: bytes, runs) -> bytes:
    """The text without the runs; characters that a run covers only in part stay."""
    kept, at = [], 0
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _remover(unit: str):
    def cut(text: bytes, spans) -> bytes:
        runs = merged((s["start"], s["stop"]) for s in spans)
        if unit == "words":
            starts, ends = word_bounds(text)
            runs = [(int(starts[a]), int(ends[b - 1])) for a, b in runs]
        return _snapped(text, runs)

    def run(batches):
        for batch in batches:
            texts = [cut(t, spans) if spans else t for t, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist())]
            rest = [i for i, n in enumerate(batch.schema.names) if n not in ("bytes", "spans")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in rest] + [pa.array(texts, type=pa.binary())], [batch.schema.names[i] for i in rest] + ["bytes"])

    return run


def without_repeats(docs: DataFrame, width: int, unit: str = "bytes") -> DataFrame:
    """docs with every repeated string of `width` bytes or words cut from text (whole characters only) and n_chars, if
    there, renewed.

    A null text stays null. Columns other than text and n_chars pass through unchanged. White space around words stays."""
    columns = docs.columns
    hidden = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), F.col("doc_id"), F.col("text"))
    d = with_spans(hidden, width, unit)
    kept = [f"c{i}" for i in range(len(columns)) if columns[i] not in ("text", "n_chars")]
    types = dict(d.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in kept] + ["was_null boolean", "bytes binary"])
    out = d.select(*kept, F.col("text").isNull().alias("was_null"), "bytes", "spans").mapInArrow(_remover(unit), schema)
    text = F.when(~F.col("was_null"), F.col("bytes").cast("string"))
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return out.select(*((made[c] if c in made else F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: bytes under repeated 400-byte strings, over all documents; beside them, passages of over fifty words that
    occur elsewhere too (n_passages), many of which have fewer than 400 bytes."""
    docs = table(spark, sf_dir, "documents")
    report = _removals(docs, 400)
    kept = staged(report, "removed")
    for t in report.staged_tables:
        discard(t)
    found = passages(docs, 51).select("row", F.size("passages").cast("long").alias("n_passages"))
    return kept.join(found, "row", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))


def oracle() -> str:
    """The same in SQL: every window of 400 bytes, and of 51 words."""
    return r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
twice AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY w) AS n FROM (SELECT r, k, md5_number(substr(h, 2 * k + 1, 800)) AS w FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS k FROM texts WHERE length(h) >= 800))) WHERE n > 1),
marked AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 400 THEN 0 ELSE 1 END AS fresh FROM twice),
runs AS (SELECT r, n, min(k) AS a, max(k) + 400 AS b FROM (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS n FROM marked) GROUP BY r, n),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS prior FROM runs),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM gaps JOIN texts USING (r) GROUP BY r),
again AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY w) AS n FROM (SELECT r, k, md5_number(array_to_string(words[k + 1 : k + 51], ' ')) AS w FROM (SELECT r, words, unnest(range(0, len(words) - 50)) AS k FROM texts WHERE len(words) > 50))) WHERE n > 1),
passages AS (SELECT r, count(*) AS n_passages FROM (SELECT r, k - lag(k) OVER (PARTITION BY r ORDER BY k) AS step FROM again) WHERE step IS NULL OR step > 51 GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut.r IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256, coalesce(n_passages, 0) AS n_passages
FROM texts LEFT JOIN cut USING (r) LEFT JOIN passages USING (r)
"""
