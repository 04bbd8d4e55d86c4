"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions: n-grams, hashes and the weighted sum stay inside one projection without a shuffle.
The model is fitted on the driver from a small labelled table and its weights are whole thousandths, so that the
verdict is an exact integer sum.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4, 5)
BUCKETS = 1 << 14
#: Labelled URLs used by a fit at most.
MAX_LABELLED = 10_000

#: (verdict, host, path): fits the host and its subdomains where the path begins so; the longest that fits decides.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Words of the invented names in the labelled table: of hosts to block, of hosts to allow, and beside either.
_BAD = "adult casino pills bets spam xxx ads cams loans poker slots cheap free win porn click meds track lottery escort".split()
_GOOD = "news library weather history garden museum cooking science travel council school music river bakery forest theatre clinic harbour letters orchard".split()
_BESIDE = "zone world place daily house point corner street hub central".split()
_PREFIXES, _ENDS = ("", "www.", "shop.", "a."), ("example.org", "example.net", "invalid.com", "test.io")
_PATHS = ("/en/12", "/de/345.html", "/fr/678/", "/es/90", "/", "/a/b?c=d")


def labelled() -> list[tuple[str, int]]:
    """The labelled table of the query, (url, 1 to block): invented names of a telling word and another, and of no
    meaning, each under one prefix, end and path."""
    out = []
    for words, label in ((_BAD, 1), (_GOOD, 0)):
        for i, a in enumerate(words):
            names = [f"{a}-{b}" for b in _BESIDE] + [f"{b}{a}" for b in _BESIDE[:4]] + [f"{a}-{words[(i + 1) % len(words)]}", f"{words[(i + 3) % len(words)]}-{a}"]
            out += [(f"https://{_PREFIXES[(i + j) % 4]}{name}.{_ENDS[(i + j // 2) % 4]}{_PATHS[(i + j) % 6]}", label) for j, name in enumerate(names)]
    # Most hosts are neither: made-up names of two syllables, to allow.
    syllables = [f"{a}{b}{c}" for a in "bdfgklmnprstvw" for b in "aeiou" for c in ("", "l", "n", "r")]
    made_up = [f"{a}{syllables[(37 * i + 11) % len(syllables)]}" for i, a in enumerate(syllables)]
    return out + [(f"https://{_PREFIXES[i % 4]}{name}.{_ENDS[i // 3 % 4]}{_PATHS[i // 2 % 6]}", 0) for i, name in enumerate(made_up)]


def held_out_urls(rows: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(learned, held out): a fourth of the rows, by hash of the URL, is kept for measuring."""
    apart = lambda u: hashlib.md5(u.encode()).digest()[0] % 4 == 0
    return [r for r in rows if not apart(r[0])], [r for r in rows if apart(r[0])]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null. A chain of tests: meant for some hundred rules."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def grams(host: str, path: str) -> list[int]:
    """Bucket of every character n-gram of ^host path$, repeats included."""
    text = f"^{host}{path}$"
    return [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:4], 16) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)]


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2] if "://" in url else ""
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    return host.translate(str.maketrans(UPPER, LOWER)), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def fit(rows: list[tuple[str, int]], steps: int = 400, rate: float = 1.0, decay: float = 2e-4) -> tuple[list[int], int]:
    """(weights by bucket, bias) in whole thousandths of log-odds; gradient descent over MAX_LABELLED rows at most."""
    rows = sorted(rows)[:MAX_LABELLED]
    bags = [grams(*_parts(u)) for u, _ in rows]
    row, bucket = np.repeat(np.arange(len(rows)), [len(b) for b in bags]), np.concatenate([np.array(b, dtype=np.int64) for b in bags])
    y, w, b = np.array([label for _, label in rows], dtype=float), np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        g = np.bincount(row, weights=w[bucket], minlength=len(rows)) + b
        e = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - y) / len(rows)
        w -= rate * (np.bincount(bucket, weights=e[row], minlength=BUCKETS) + decay * w)
        b -= rate * e.sum()
    clip = lambda v: max(-30_000, min(30_000, round(1000 * float(v))))
    return [clip(v) for v in w], clip(b)


@functools.cache
def default_model() -> tuple[list[int], int]:
    """The query's model, fitted when first asked for."""
    return fit(held_out_urls(labelled())[0])


def margin(chars: Column, model: tuple[list[int], int]) -> Column:
    """The model's log-odds to block, in thousandths (long), of the array of characters of ^host path$."""
    weights, bias = model
    packed = F.lit(b"".join((v + 32768).to_bytes(2, "big") for v in weights))

    def weight(gram: Column) -> Column:
        bucket = F.conv(F.substring(F.md5(gram.cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
        return F.conv(F.hex(F.substring(packed, 2 * bucket + 1, F.lit(2))), 16, 10).cast("long") - 32768

    def summed(n: int) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, F.lit(0).cast("long"), lambda acc, i: acc + weight(F.concat(*(chars[i + k] for k in range(n)))))

    return F.lit(bias).cast("long") + sum((summed(n) for n in SIZES[1:]), summed(SIZES[0]))


def judge(pages: DataFrame, rules=RULES, model=None) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict, margin; one row for each input row.

    A URL that is null or has no :// has an empty host and path, no rule, and the model's verdict on those. Repeated
    rows are judged alike; a null page_id passes through; an empty table gives an empty result."""
    d = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    d = d.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("chars", F.regexp_extract_all(F.concat(F.lit("^"), "host", "path", F.lit("$")), F.lit("(?s)."), 0))
    d = d.withColumns({"found": rule_of(F.col("host"), F.col("path"), rules), "margin": margin(F.col("chars"), model or default_model())})
    own = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return d.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "margin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every page's URL."""
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same in SQL, with the fitted weights as literals."""
    weights, bias = default_model()
    nonzero = ", ".join(f"({i}, {v})" for i, v in enumerate(weights) if v)
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " WHEN margin > 0 THEN 'block' ELSE 'allow' END"
    sizes = " UNION ALL ".join(f"SELECT {n} AS n" for n in SIZES)
    return f"""
WITH weights(bucket, weight) AS (VALUES {nonzero}),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT page_id, coalesce(translate(raw, '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM hosts),
texts AS (SELECT DISTINCT host, path, '^' || host || path || '$' AS t FROM parts),
sizes AS ({sizes}),
grams AS (SELECT host, path, substr(t, i, n) AS gram FROM (SELECT host, path, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM texts, sizes)),
margins AS (SELECT host, path, sum(weight) AS m FROM (SELECT host, path, ('0x' || substr(md5(gram), 1, 4))::INTEGER % {BUCKETS} AS bucket FROM grams) JOIN weights USING (bucket) GROUP BY host, path),
judged AS (SELECT page_id, host, path, CAST({bias} + coalesce(m, 0) AS BIGINT) AS margin FROM parts LEFT JOIN margins USING (host, path))
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, margin FROM judged
"""
