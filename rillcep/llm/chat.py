"""Chat formatting of reply trees.

A tree's messages first contract to runs (a message with its line of only children), by pointer jumping: rounds grow
with the logarithm of the longest run. Iterative self-joins over the runs then enumerate root-to-leaf paths, paths
are ranked by the sum of their messages' scores, and each chosen path is written as one conversation. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillcep.llm.common import staged, table

#: Template: START role newline text END. Both begin with a character that texts hold only in escaped form.
START, END = "<|start|>", "<|end|>\n"
#: (character, escape), in the order of escaping; unescaping goes backwards.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _same(a: DataFrame, b: DataFrame, *pairs: tuple[str, str]) -> Column:
    """Equality of column pairs with null equal to null."""
    out = F.lit(True)
    for x, y in pairs:
        out = out & a[x].eqNullSafe(b[y])
    return out


def runs(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent, score, role, text) -> the same with head (its run's first node) and place in the run.

    A parent that isn't in the tree counts as none. Messages on a cycle have no root and are left out."""
    kids = nodes.groupBy("tree", "parent").agg(F.count("*").alias("kids"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.lit(True).alias("known"))
    kids = kids.where("parent is not null")
    kids = kids.join(known, _same(kids, known, ("tree", "t"), ("parent", "n")), "left").select(F.col("tree").alias("kt"), F.col("parent").alias("kp"), "kids", "known")
    d = nodes.join(kids, _same(nodes, kids, ("tree", "kt"), ("parent", "kp")), "left")
    follows = F.coalesce(F.col("known") & (F.col("kids") == 1), F.lit(False))
    parent = F.when(F.col("known"), F.col("parent"))
    state = d.select("tree", "node", parent.alias("parent"), "score", "role", "text", F.when(follows, F.col("parent")).otherwise(F.col("node")).alias("head"), F.when(follows, 1).otherwise(0).cast("long").alias("place"), (~follows).alias("done"))
    messages = staged(state, "messages")
    jumps = messages.select("tree", "node", "head", "place", "done")
    rounds = max(1, messages.count().bit_length() + 1)
    for _ in range(rounds):
        if jumps.where("not done").isEmpty():
            break
        to = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("head").alias("h"), F.col("place").alias("p"), F.col("done").alias("f"))
        open_ = jumps.where("not done")
        moved = open_.join(to, _same(open_, to, ("tree", "t"), ("head", "n"))).select("tree", "node", F.col("h").alias("head"), (F.col("place") + F.col("p")).alias("place"), F.col("f").alias("done"))
        jumps = staged(jumps.where("done").unionByName(moved), "jumps")
    at = jumps.where("done").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("head").alias("h"), F.col("place").alias("p"))
    rest = messages.drop("head", "place", "done")
    return rest.join(at, _same(rest, at, ("tree", "t"), ("node", "n"))).select("tree", "node", "parent", "score", "role", "text", F.col("h").alias("head"), F.col("p").alias("place"))


def paths(placed: DataFrame) -> DataFrame:
    """Root-to-leaf paths of runs(): tree, leaf (the last run's head), heads array in order, score."""
    own = placed.groupBy("tree", "head").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("own"))
    tails = placed.select(F.col("tree").alias("tt"), F.col("node").alias("tn"), F.col("head").alias("above"))
    tops = placed.where("place = 0").select("tree", "head", "parent")
    links = tops.join(tails, _same(tops, tails, ("tree", "tt"), ("parent", "tn")), "left").select("tree", "head", "above")
    own2 = own.select(F.col("tree").alias("ot"), F.col("head").alias("oh"), "own")
    links = staged(links.join(own2, _same(links, own2, ("tree", "ot"), ("head", "oh"))).select("tree", "head", "above", "own"), "links")
    step = links.where("above is not null").select(F.col("tree").alias("t"), F.col("head").alias("next"), "above", F.col("own").alias("more"))
    inner = step.select(F.col("t").alias("it"), F.col("above").alias("ia")).distinct()
    frontier = links.where("above is null").select("tree", F.col("head").alias("leaf"), F.array("head").alias("heads"), F.col("own").alias("score"))
    done = None
    while True:
        ends = frontier.join(inner, _same(frontier, inner, ("tree", "it"), ("leaf", "ia")), "left_anti")
        done = ends if done is None else done.unionByName(ends)
        longer = frontier.join(step, _same(frontier, step, ("tree", "t"), ("leaf", "above")))
        frontier = staged(longer.select("tree", F.col("next").alias("leaf"), F.concat("heads", F.array("next")).alias("heads"), (F.col("score") + F.col("more")).alias("score")), "frontier")
        if frontier.isEmpty():
            return done


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The `top` paths of each tree by score, ties by the smaller leaf; two rounds, so a bushy tree doesn't meet in one task."""
    best = [F.desc("score"), F.asc("leaf")]
    part = Window.partitionBy("tree", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*best)
    found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*best))).where(F.col("rank") <= top)


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """nodes (tree, node, parent, score, role, text) -> tree, rank, score, formatted, segments.

    segments are array<struct<text, loss>>: the formatted text cut where the loss mask changes; loss is set on the
    escaped texts of assistant messages only. Null texts and roles are empty; null scores count 0; a null tree is a
    tree of its own. Node ids must be unique in a tree. An empty table gives an empty result."""
    nodes = nodes.select("tree", "node", "parent", F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = staged(runs(nodes), "runs")
    chosen = ranked(paths(placed), top).select("tree", "rank", F.col("score").alias("total"), F.posexplode("heads").alias("nth", "run"))
    body = placed.select(F.col("tree").alias("pt"), F.col("head").alias("ph"), "place", "role", "text")
    lines = chosen.join(body, _same(chosen, body, ("tree", "pt"), ("run", "ph")))
    turns = lines.groupBy("tree", "rank", "total").agg(F.array_sort(F.collect_list(F.struct("nth", "place", "role", "text"))).alias("turns"))

    def written(t: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), t["role"] == "assistant"), piece(F.lit(END), F.lit(False)))

    out = turns.select("tree", "rank", F.col("total").alias("score"), F.flatten(F.transform("turns", written)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def turn(raw: Column) -> Column:
        role = F.substring_index(raw, "\n", 1)
        text = F.substring(raw, F.char_length(role) + 2, F.char_length(raw) - F.char_length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    pieces = F.split(formatted, r"<\|start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every conversation as a tree of one line, and conversation -1 of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.withColumn("node", F.row_number().over(line).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    out = format_trees(nodes.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text"))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = out.select("tree", "formatted", turns.alias("turns"), masked.alias("masked"))
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"), F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def oracle() -> str:
    escaped = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    role, text = escaped.format("role"), escaped.format("text")
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS masked,
    sum({len(START) + 1 + len(END)} + length(replace({role}, chr(10), '&#10;')) + length({text})) AS n
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars, sha256(masked) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM whole
"""
