"""Embedding near-duplicates by a robust-pruned flat graph (Vamana: Subramanya et al., DiskANN, NeurIPS 2019).

1. Vectors are clustered on a bounded sample; each goes to the shards of its OVERLAP nearest centroids. A shard's graph
   grows by insertion: a greedy search from the medoid finds a vector's candidates, robust pruning keeps its neighbours.
2. The adjacency lists of all shards are united, a list for each vector.
3. Each vector searches the united graph from the medoid of its home cell, then range by range: from itself and all
   that it found near the threshold. A task has the vectors of a home cell and their neighbours in all other cells.
4. What the search found is verified in double precision; n_found counts it.
5. An exact check follows, since a graph can miss links: each vector is compared with every cell that one within the
   threshold can lie in. A neighbour u at cosine t is at most sqrt(2 - 2t) away, so for v of cell a, u can lie in cell b
   only if v.(a - b) <= sqrt(2 - 2t) |a - b|. No pair is missed, however a dense group is split among cells, and the audit
   has the graph's recall over all rows: n_found against n_links. A vector visits its cells by a shuffle, in pieces of
   bounded size; the few that can have neighbours almost anywhere go past blocks of all vectors instead.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillcep.llm.common import arrow, staged, table
from rillcep.llm.graph import components

#: Bounds of the clustering: vectors that it sees, and clusters (one for 800 vectors below that).
SAMPLE, CLUSTERS = 20_000, 2048
#: Shards that a vector is in, and vectors of one shard's graph or of one search. Larger cells are cut by hash, at the
#: cost of the graph's recall; the exact check doesn't depend on it.
OVERLAP, PIECE = 3, 16_000
#: Bytes of the vectors that others are compared with at once, and vectors of a task multiplied at once.
BLOCK, ROWS = 8 << 20, 256
#: Cells that a vector visits by a shuffle.
VISITS = 32
#: Graph: neighbours kept, room for edges back before they are pruned too, the pruning slack, the beam of insertions, and
#: the nearest that point back in the end.
DEGREE, ROOM, ALPHA, INSERT, BACK = 20, 32, 1.2, 32, 8
#: Search: beam width, and how far below the threshold the range search still expands.
BEAM, SLACK = 24, 0.05


def unit(vectors) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (rows x degree, -1 for none) of nodes out of candidates (rows x c, -1 for none): nearest first, dropping
    each that a kept one is closer to by the factor alpha."""
    rows, c = candidates.shape
    found = x[candidates]
    far = 1 - np.einsum("ij,icj->ic", x[nodes], found)
    far[(candidates < 0) | (candidates == nodes[:, None])] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    found = np.take_along_axis(found, order[:, :, None], 1)
    between = alpha * (1 - found @ found.transpose(0, 2, 1))
    alive, kept, out = np.isfinite(far), np.zeros(rows, dtype=np.int64), np.full((rows, degree), -1, dtype=np.int64)
    for j in range(c):
        take = np.flatnonzero(alive[:, j] & (kept < degree))
        if len(take):
            out[take, kept[take]] = candidates[take, j]
            kept[take] += 1
            alive[take] &= between[take, j] > far[take]
    return out


def greedy(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest nodes found (queries x beam, -1 for none), cosines of all that was looked at (queries x nodes, else -inf)):
    a best-first search of each query along the graph (nodes x width, -1 for none)."""
    q, width = len(queries), graph.shape[1]
    rows, seen = np.arange(q), np.full((q, len(x)), -np.inf)
    ids, near = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -np.inf)
    ids[:, 0], near[:, 0] = start, queries @ x[start]
    seen[:, start] = near[:, 0]
    done = np.ones((q, beam), dtype=bool)
    done[:, 0] = False
    while True:
        best = np.where(done, -np.inf, near)
        slot = best.argmax(axis=1)
        active = np.flatnonzero(np.isfinite(best[rows, slot]))
        if not len(active):
            return ids, seen
        done[active, slot[active]] = True
        step = graph[ids[active, slot[active]]]
        fresh = (step >= 0) & np.isneginf(seen[active[:, None], step])
        sims = np.where(fresh, np.einsum("ij,icj->ic", queries[active], x[step]), -np.inf)
        at, place = np.nonzero(fresh)
        seen[active[at], step[at, place]] = sims[at, place]
        all_ids, all_near = np.concatenate([ids[active], step], axis=1), np.concatenate([near[active], sims], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        top = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_near, all_done))


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def grow(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of each vector, by insertion in batches of up to a tenth of the graph so far: candidates by a greedy
    search from the medoid and among the batch itself; edges back are added, and pruned where they outgrow the room."""
    n, start = len(x), medoid(x)
    graph, many = np.full((n, ROOM), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rest = np.random.default_rng(11).permutation(n)
    rest, at, inside = rest[rest != start], 0, 1
    while at < len(rest):
        batch = rest[at : at + min(256, max(1, inside // 10))]
        at, inside = at + len(batch), inside + len(batch)
        found, _ = greedy(x, graph, x[batch], start, INSERT)
        mates = x[batch] @ x[batch].T
        mates = batch[np.argsort(-mates, axis=1, kind="stable")[:, : DEGREE // 2]]
        kept = robust_prune(x, batch, np.concatenate([found, mates], axis=1), DEGREE, ALPHA)
        graph[batch, :DEGREE], many[batch] = kept, (kept >= 0).sum(axis=1)
        a, b = batch[np.nonzero(kept >= 0)[0]], kept[kept >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for node, back in zip(b[first].tolist(), np.split(a, first[1:])):
            own = graph[node, : many[node]]
            own = np.concatenate([own, back[~np.isin(back, own)]])
            if len(own) > ROOM:
                own = robust_prune(x, np.array([node]), own[None, :], DEGREE, ALPHA)[0]
                own = own[own >= 0]
            graph[node] = -1
            graph[node, : len(own)], many[node] = own, len(own)
    # Pruning must leave no vector that none leads to: the nearest of each point back to it, whatever their room.
    a, b = np.repeat(np.arange(n), np.minimum(many, BACK)), np.concatenate([*(g[: min(m, BACK)] for g, m in zip(graph, many)), np.zeros(0, dtype=np.int64)])
    order = np.argsort(b, kind="stable")
    back = np.split(a[order], np.searchsorted(b[order], np.arange(1, n)))
    return [np.unique(np.concatenate([g[:m], r])) for g, m, r in zip(graph, many, back)]


def search(x: np.ndarray, adjacency: list[np.ndarray], own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries, nodes) arrays of the pairs at the threshold that the vectors `own` (places in x) find in the graph: a
    greedy search from the medoid, then range by range through all nodes near the threshold, the vector itself first."""
    graph = np.full((len(x), max(1, max(map(len, adjacency)))), -1, dtype=np.int64)
    for i, g in enumerate(adjacency):
        graph[i, : len(g)] = g
    start, pairs = medoid(x), []
    for lo in range(0, len(own), ROWS):
        part = own[lo : lo + ROWS]
        _, seen = greedy(x, graph, x[part], start, BEAM)
        inside = seen >= threshold - SLACK
        inside[np.arange(len(part)), part] = True
        while inside.any():
            further = np.zeros_like(inside)
            for node in np.flatnonzero(inside.any(axis=0)):
                block = np.ix_(np.flatnonzero(inside[:, node]), adjacency[node])
                fresh = np.isneginf(seen[block])
                if fresh.any():
                    sims = x[part[block[0][:, 0]]] @ x[adjacency[node]].T
                    seen[block] = np.where(fresh, sims, seen[block])
                    further[block] |= fresh & (sims >= threshold - SLACK)
            inside = further
        seen[np.arange(len(part)), part] = -np.inf
        a, b = np.nonzero(seen >= threshold)
        pairs.append((part[a], b))
    return tuple(np.concatenate([p[i] for p in pairs]) for i in range(2))


def reach(x: np.ndarray, home: np.ndarray, middle: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a vector (rows) can have a neighbour at the threshold in a cell (columns)."""
    apart, squares = float(np.sqrt(max(0.0, 2 - 2 * threshold))), (middle**2).sum(axis=1)
    dots = x @ middle.T
    between = np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * (middle[home] @ middle.T), 0))
    return dots[np.arange(len(x)), home][:, None] - dots <= apart * between + 1e-6


def _assigner(middle: np.ndarray, threshold: float):
    """Vectors with their cell, the cells of their shards, and those that they visit (none: too many)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = unit(part.column("vector").to_pylist())
                near = np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, :OVERLAP]
                inside = reach(x, near[:, 0], middle, threshold)
                visits = [np.flatnonzero(r) if n <= VISITS else None for r, n in zip(inside, inside.sum(axis=1))]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), pa.array(near[:, 0]), pa.array(list(near), pa.list_(pa.int64())), pa.array(visits, pa.list_(pa.int64())), pa.array(list(x), pa.list_(pa.float64()))], ["rep", "copies", "cell", "cells", "visits", "vector"])

    return run


def _matrix(batch) -> np.ndarray:
    column = batch.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _groups(batches):
    """Consecutive rows of one (cell, piece) as a table each."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "piece")], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if parts and tuple(keys[lo]) != key:
                yield pa.Table.from_batches(parts)
                parts = []
            key = tuple(keys[lo])
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


LISTS = pa.schema([("rep", pa.int64()), ("neighbours", pa.list_(pa.int64()))])


def _builder(batches):
    """Shards -> the adjacency lists of each, by rep."""
    for shard in _groups(batches):
        reps = shard.column("rep").to_numpy()
        yield arrow(LISTS, [reps, [reps[g] for g in grow(_matrix(shard))]])


FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("found", pa.int64())])


def _searcher(threshold: float):
    """Parts of the united graph -> for each vector at home there: the links found, and the smallest vector among them."""

    def run(batches):
        for part in _groups(batches):
            reps, copies, home = (part.column(c).to_numpy() for c in ("rep", "copies", "home"))
            by = np.argsort(reps)
            lists = part.column("neighbours").combine_chunks()
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            place = np.minimum(np.searchsorted(reps, flat, sorter=by), len(reps) - 1)
            known = reps[by[place]] == flat  # a neighbour's neighbours may lie elsewhere
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(reps)), sizes)[known], minlength=len(reps)))
            a, b = search(_matrix(part), np.split(by[place[known]], ends[:-1]), np.flatnonzero(home), threshold)
            n = np.bincount(a, weights=copies[b], minlength=len(reps)).astype(np.int64)
            low = np.full(len(reps), np.iinfo(np.int64).max)
            np.minimum.at(low, a, reps[b])
            own = np.flatnonzero(n > 0)
            yield arrow(FOUND, [reps[own], np.zeros(len(own), np.int64), low[own], n[own]])

    return run


def _packed(batches):
    """Columns of a batch as bytes, for the driver."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "copies", "cell")] + [_matrix(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["rep", "copies", "cell", "vector"])


class Block:
    """Vectors that others are compared with; middle: the centroids, or None where all are compared with all."""

    def __init__(self, reps: np.ndarray, copies: np.ndarray, cells: np.ndarray, x: np.ndarray, middle: np.ndarray | None, threshold: float):
        by = np.lexsort((reps, cells))
        self.reps, self.copies, self.cells, self.x = reps[by], copies[by], cells[by], x[by]
        self.middle, self.threshold = middle, threshold
        self._label()

    def matches(self, x: np.ndarray, cells: np.ndarray):
        """(rows, members) arrays of all pairs at the threshold, a few rows at a time."""
        for lo in range(0, len(x), ROWS):
            part = x[lo : lo + ROWS]
            if self.middle is None:
                a, b = np.nonzero(part @ self.x.T >= self.threshold)
                yield a + lo, b
                continue
            inside = reach(part, cells[lo : lo + ROWS], self.middle, self.threshold)
            members = np.flatnonzero(inside.any(axis=0)[self.cells])
            a, b = np.nonzero(part @ self.x[members].T >= self.threshold)
            yield a + lo, members[b]

    def _label(self) -> None:
        """root: of each member, the one of smallest rep that it is connected with inside the block."""
        root, rank = np.arange(len(self.reps)), np.argsort(np.argsort(self.reps))
        for a, b in self.matches(self.x, self.cells):
            # Each row joins the components that its matches are in so far.
            pairs = np.unique(a * len(root) + root[b])
            for i, j in zip((pairs // len(root)).tolist(), (pairs % len(root)).tolist()):
                i, j = root[i], root[j]
                if i != j:
                    i, j = (i, j) if rank[i] < rank[j] else (j, i)
                    root[root == j] = i
        self.root = root

    def found(self, reps: np.ndarray, x: np.ndarray, cells: np.ndarray):
        """For each vector with matches here: their number, and an edge to each component of the block among them."""
        for a, b in self.matches(x, cells):
            if not len(a):
                continue
            low, n = a[0], a[-1] + 1 - a[0]
            other = reps[a] != self.reps[b]
            links = np.bincount(a[other] - low, self.copies[b[other]], n).astype(np.int64)
            edges = np.zeros((n, len(self.reps)), dtype=bool)
            edges[a - low, self.root[b]] = True
            row, root = np.nonzero(edges)
            first = np.concatenate([[True], row[1:] != row[:-1]])
            yield arrow(FOUND, [reps[row + low], np.where(first, links[row], 0), self.reps[root], np.zeros(len(row), np.int64)])


def _matcher(block: Block):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from block.found(batch.column("rep").to_numpy(), _matrix(batch), batch.column("cell").to_numpy())

    return run


def _hosts(threshold: float):
    """Pieces of cells, each with its members before its visitors."""

    def run(batches):
        key, members, block = None, [], None

        def piece():
            table_ = pa.Table.from_batches(members)
            n = table_.num_rows
            return Block(table_.column("rep").to_numpy(), table_.column("copies").to_numpy(), np.zeros(n, np.int64), _matrix(table_), None, threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "piece", "visitor")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part, own = batch.slice(lo, hi - lo), tuple(keys[lo, :2])
                if own != key:
                    key, members, block = own, [], None
                if not keys[lo, 2]:
                    members.append(part)
                elif members:
                    block = block or piece()
                    yield from block.found(part.column("rep").to_numpy(), _matrix(part), np.zeros(hi - lo, np.int64))

    return run


def _visited(placed: DataFrame, size: int, threshold: float) -> DataFrame:
    """Matches of the vectors that visit cells, each compared with the members of each piece of those."""
    pieces = placed.groupBy("cell").agg(F.ceil(F.count("*") * (size * 8) / BLOCK).cast("int").alias("pieces"))  # CLUSTERS rows at most
    members = placed.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    members = members.select("cell", "piece", F.lit(0).alias("visitor"), "rep", "copies", "vector")
    visitors = placed.where("visits is not null").select(F.explode("visits").alias("cell"), "rep", "copies", "vector").join(F.broadcast(pieces), "cell")
    visitors = visitors.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("cell", "piece", F.lit(1).alias("visitor"), "rep", "copies", "vector")
    rows = members.unionByName(visitors).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "visitor", "rep")
    return staged(rows.mapInArrow(_hosts(threshold), MADE), "found")


MADE = "rep long, links long, root long, found long"


def _cut(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with the piece of their cell; sizes has CLUSTERS rows at most."""
    pieces = sizes.select("cell", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    return rows.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).drop("pieces")


def _searched(placed: DataFrame, threshold: float) -> DataFrame:
    """Links found in the united graph."""
    shards = placed.select("rep", F.explode("cells").alias("cell"), "vector")
    shards = _cut(shards, shards.groupBy("cell").count()).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "rep")
    lists = shards.select("rep", "cell", "piece", "vector").mapInArrow(_builder, "rep long, neighbours array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # OVERLAP lists at most
    nodes = staged(_cut(placed.drop("cells"), placed.groupBy("cell").count()).join(united, "rep"), "graph")
    at_home = nodes.select("cell", "piece", "rep", "copies", "vector", "neighbours", F.lit(True).alias("home"))
    asked = nodes.select(F.col("cell").alias("c"), F.col("piece").alias("p"), F.explode("neighbours").alias("rep")).distinct().join(nodes, "rep")
    asked = asked.where("c <> cell or p <> piece").select(F.col("c").alias("cell"), F.col("p").alias("piece"), "rep", "copies", "vector", "neighbours", F.lit(False).alias("home"))
    parts = at_home.unionByName(asked).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "rep")
    return staged(parts.mapInArrow(_searcher(threshold), MADE), "found")


def _of_dimension(classes: DataFrame, size: int, threshold: float) -> list[DataFrame]:
    """What the graph search found, and the exact check's matches."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()["vector"]
    k = int(min(CLUSTERS, max(1, n // 800), len(sample)))
    middle = centroids(unit(list(sample)), k)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = classes.mapInArrow(_assigner(middle, threshold), "rep long, copies long, cell long, cells array<long>, visits array<long>, vector array<double>")
    placed = staged(placed.repartitionByRange(parts, "cell", "rep"), "placed")  # rows multiplied together share cells
    found = [_searched(placed.drop("visits"), threshold), _visited(placed, size, threshold)]
    wide = placed.where("visits is null").select("rep", "cell", "vector")
    if wide.isEmpty():
        return found
    all_ = placed.select("rep", "copies", "cell", "vector")
    passes = -(-n * size * 8 // BLOCK)
    for p in range(passes):
        rows = all_.where(F.pmod(F.xxhash64("rep"), F.lit(passes)) == p).mapInArrow(_packed, "rep binary, copies binary, cell binary, vector binary").collect()
        if not rows:
            continue
        reps, copies, cells = (np.concatenate([np.frombuffer(r[c], dtype=np.int64) for r in rows]) for c in range(3))
        block = Block(reps, copies, cells, np.concatenate([np.frombuffer(r[3]) for r in rows]).reshape(-1, size), middle, threshold)
        found.append(staged(wide.mapInArrow(_matcher(block), MADE), "found"))
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """vectors (vec_id, embedding, ...) -> (result, audit).

    result: vec_id, n_links, component_id, kept, n_found (the links that the graph search found by itself); one row for
    each input row. Null, empty and all-zero vectors and those with a null or non-finite component link with nothing,
    nor do vectors of different lengths with each other. Equal vectors link. A row of a null vec_id links with nothing:
    component_id null, kept. audit: one row, `links` of all rows and those `found` by the graph search. An empty table
    gives an empty result; other columns are ignored."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vector", lambda c: c != 0)
    v = v.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine, F.lit(False)))
    keyed = v.withColumn("class", F.when(F.col("fine"), F.sha2(F.array_join(F.transform("vector", lambda c: c.cast("string")), ",").cast("binary"), 256)))
    classes = keyed.where("fine").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = staged(classes, "vectors")
    made = []
    for size in sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect()):
        made += _of_dimension(classes.where(F.size("vector") == size).select("rep", "copies", "vector"), size, threshold)
    found = reduce(DataFrame.unionByName, made, vectors.sparkSession.createDataFrame([], MADE))
    linked = components(found.selectExpr("rep as a", "root as b"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    named = classes.select("class", "rep", "copies").join(links, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    total = lambda c: (F.coalesce(c, F.lit(0)) + F.col("copies") - 1)
    named = named.select("class", total("links").alias("n_links"), total("found").alias("n_found"), F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "class").join(named, "class", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    counted = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    result = out.select("vec_id", counted("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), counted("n_found"))
    return result, result.agg(F.sum("n_links").alias("links"), F.sum("n_found").alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all embeddings, cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]


def oracle() -> str:
    """The same in SQL, over all pairs. n_found is n_links: the search is held to find all links there."""
    return r"""
WITH RECURSIVE fine AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT a AS vec_id, a AS to_id FROM ways UNION SELECT vec_id, b FROM reach JOIN ways ON a = to_id),
groups AS (SELECT vec_id, min(to_id) AS low FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept, coalesce(n, 0) AS n_found FROM embeddings LEFT JOIN groups USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
