"""Patterns (followed-by) and sequences (strict contiguity) over one or more streams.

Chains of single events whose conditions don't refer to each other become window expressions: the next matching
event by a running last value in reverse order, contiguity by lead(). Everything else goes through the automaton,
one pass over each partition in order, with only the open attempts in memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillcep.errors import AnalysisError
from rillcep.functions.expressions import Scope, compile_, conjuncts, variables
from rillcep.functions.extensions import Registry
from rillcep.lang import ast
from rillcep.operators import nfa
from rillcep.schema import SEQ, US, col


@dataclass
class Source:
    df: DataFrame
    attributes: dict[str, str]
    place: int


@dataclass
class Matched:
    """Matches: one column per atom reference; a list where the atom counts."""

    df: DataFrame
    refs: dict[str, tuple[str, dict[str, str], bool]]  # ref -> (column, attributes, is a list)


def _own(condition, atom: ast.Atom) -> bool:
    return all(v.stream in (None, atom.ref, atom.stream) and v.index is None for v in variables(condition))


def _fits(atom: ast.Atom, source: Source, extensions: Registry) -> tuple[Column, tuple]:
    """(the conditions on the event itself, those on earlier captures)."""
    parts = [c for f in atom.filters for c in conjuncts(f)]
    own, other = [c for c in parts if _own(c, atom)], tuple(c for c in parts if not _own(c, atom))

    def resolve(v: ast.Var):
        if v.name not in source.attributes:
            raise AnalysisError(f"{atom.stream} has no attribute {v.name}")
        return col(v.name), source.attributes[v.name]

    scope = Scope(resolve, extensions, F.col(US))
    out = F.lit(True)
    for c in own:
        out = out & F.coalesce(compile_(c, scope)[0], F.lit(False))
    return out, other


def match(pattern: ast.Pattern, sources: dict[str, Source], keys: list[str], extensions: Registry) -> Matched:
    steps, atoms, every = nfa.compiled(pattern)
    refs = {a: a.ref or f"__e{i}" for i, a in enumerate(atoms)}
    if len(set(refs.values())) != len(atoms):
        raise AnalysisError("two events of a pattern have one name")
    tests = [_fits(a, sources[a.stream], extensions) for a in atoms]
    simple = not any(other for _, other in tests) and all(s.kind in ("one", "count") and (s.low, s.high) == (1, 1) and len(s.atoms) == 1 and not atoms[s.atoms[0]].counted for s in steps)
    tagged = None
    for name, s in sources.items():
        row = F.struct(*map(col, s.attributes))
        fits = [t[0] if a.stream == name else F.lit(False) for a, t in zip(atoms, tests)]
        part = s.df.select(*map(col, keys), US, SEQ, F.lit(s.place).alias("__place"), F.lit(name).alias("__stream"), *(f.alias(f"__f{i}") for i, f in enumerate(fits)), *(row.alias(f"__r_{n}") if n == name else F.lit(None).cast(_row_type(o)).alias(f"__r_{n}") for n, o in sources.items()))
        if not pattern.strict:  # an event that fits nothing can't matter; in a sequence it breaks contiguity
            anything = F.lit(False)
            for i in range(len(atoms)):
                anything = anything | F.col(f"__f{i}")
            part = part.where(anything)
        tagged = part if tagged is None else tagged.unionByName(part)
    lists = {refs[a]: a.counted for a in atoms}
    if simple and every in ("each", None):
        df = _chain(tagged, pattern, atoms, refs, every, keys)
    elif simple and every == "group" and len(steps) == 1:
        df = _chain(tagged, pattern, atoms, refs, "each", keys)
    else:
        df = _folded(tagged, pattern, steps, atoms, refs, [t[1] for t in tests], every, keys, sources)
        df = df.select(US, SEQ, *map(col, keys), *(col(r) if lists[r] else F.get(col(r), F.lit(0)).alias(r) for r in lists))
    return Matched(df, {refs[a]: (refs[a], sources[a.stream].attributes, a.counted) for a in atoms})


def _row_type(source: Source) -> T.StructType:
    return T.StructType([f for f in source.df.schema.fields if f.name in source.attributes])


def _chain(df: DataFrame, pattern: ast.Pattern, atoms, refs, every, keys: list[str]) -> DataFrame:
    part = W.partitionBy(*map(col, keys))
    order = [F.col(US), F.col(SEQ), F.col("__place")]
    n = len(atoms)
    # Each event that fits step k carries what follows from there; the last step first.
    rest = F.struct(F.col(US).alias("us"), F.col(SEQ).alias("seq"), col(f"__r_{atoms[-1].stream}").alias(f"r{n - 1}"))
    df = df.withColumn("__rest", F.when(F.col(f"__f{n - 1}"), rest))
    back = part.orderBy(*(c.desc() for c in order)).rowsBetween(W.unboundedPreceding, -1)
    for k in range(n - 2, -1, -1):
        if pattern.strict:
            after = F.lead("__rest").over(part.orderBy(*order))
        else:
            # The next event that fits step k+1 decides, even where nothing follows it.
            after = F.last(F.when(F.col(f"__f{k + 1}"), F.struct(F.col("__rest").alias("x"))), ignorenulls=True).over(back)["x"]
        df = df.withColumn("__after", after)
        own = F.struct(F.col("__after.us").alias("us"), F.col("__after.seq").alias("seq"), col(f"__r_{atoms[k].stream}").alias(f"r{k}"), *(F.col("__after")[f"r{j}"].alias(f"r{j}") for j in range(k + 1, n)))
        df = df.withColumn("__rest", F.when(F.col(f"__f{k}") & F.col("__after").isNotNull(), own))
    df = df.where(F.col("__rest").isNotNull())
    if pattern.within is not None:
        df = df.where(F.col("__rest.us") - F.col(US) <= pattern.within)
    if every is None:
        df = df.withColumn("__nth", F.row_number().over(part.orderBy(*order))).where(F.col("__nth") == 1)
    return df.select(F.col("__rest.us").alias(US), F.col("__rest.seq").alias(SEQ), *map(col, keys), *(F.col("__rest")[f"r{k}"].alias(refs[a]) for k, a in enumerate(atoms)))


def _folded(df: DataFrame, pattern, steps, atoms, refs, conditions, every, keys, sources) -> DataFrame:
    rows = {n: _row_type(s) for n, s in sources.items()}
    schema = T.StructType([T.StructField(US, T.LongType()), T.StructField(SEQ, T.LongType()), *(f for f in df.schema.fields if f.name in keys), *(T.StructField(refs[a], T.ArrayType(rows[a.stream])) for a in atoms)])
    made = [nfa.Atom(refs[a], a.stream, c) for a, c in zip(atoms, conditions)]
    names, strict, within = df.columns, pattern.strict, pattern.within
    at = {n: i for i, n in enumerate(names)}

    def run(batches):
        key, matcher = None, None

        def rowed(found):
            for caps, us, seq in found:
                yield (us, seq, *key, *(caps.get(a.ref, []) for a in made))

        for pdf in batches:
            out = []
            for row in zip(*(pdf[n].tolist() for n in names)):
                own = tuple(row[at[k]] for k in keys)
                if matcher is None or own != key:
                    if matcher is not None:
                        out += rowed(matcher.flush())
                    key, matcher = own, nfa.Matcher(steps, made, strict, every, within)
                stream = row[at["__stream"]]
                event = {"us": row[at[US]], "seq": row[at[SEQ]], "stream": stream, "row": row[at[f"__r_{stream}"]], "fits": [row[at[f"__f{i}"]] for i in range(len(made))]}
                out += rowed(matcher.add(event))
            yield pd.DataFrame(out, columns=schema.names)
        if matcher is not None:
            yield pd.DataFrame(list(rowed(matcher.flush())), columns=schema.names)

    dealt = df.repartition(*map(col, keys)) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*map(col, keys), US, SEQ, "__place").mapInPandas(run, schema)
