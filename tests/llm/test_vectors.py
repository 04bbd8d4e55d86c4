import numpy as np
import pytest

from rillcep.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, class string, shards int"


def rows():
    rng = np.random.default_rng(5)
    out, n = [], 0
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(1 + g % 6):
            out.append((n, (base + rng.normal(size=16) * 0.05).astype(float).tolist()))
            n += 1
    same = out[0][1]
    out += [(n + i, same) for i in range(5)] + [(n + 5, [2 * x for x in same])]
    out += [(n + 6, None), (n + 7, []), (n + 8, [0.0] * 16), (n + 9, [float("nan")] * 16), (n + 10, [float("inf")] + [1.0] * 15), (n + 11, [None] + [1.0] * 15), (None, same), (n + 12, [1.0, 2.0]), (n + 13, [2.0, 4.0])]
    return out


@pytest.mark.parametrize("piece,visits", [(16_000, 32), (20, 0)])
def test_against_brute_force(spark, monkeypatch, piece, visits):
    """visits: 0 sends every vector past blocks of all."""
    monkeypatch.setattr(vectors, "PIECE", piece)
    monkeypatch.setattr(vectors, "VISITS", visits)
    data = rows()
    df = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in data], SCHEMA)
    result, audit = vectors.near_duplicates(df, 0.95)
    got = {r.vec_id: r for r in result.collect()}
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _ in data if i is not None}
    for a, x in fine:
        for b, y in fine:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a].add(b)
    for i, own in links.items():
        assert got[i].n_links == len(own), i
        near, todo = {i}, [i]
        while todo:
            for b in links[todo.pop()] - near:
                near.add(b), todo.append(b)
        assert got[i].component_id == min(near) and got[i].kept == (i == min(near))
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    found = audit.first()
    assert found.links == sum(len(own) for own in links.values()) and (0.9 * found.links if piece > 20 else 0) <= found.found <= found.links


def test_hot_group_over_many_clusters(spark, monkeypatch):
    """A third of the rows are distinct near copies, which noise splits among many of the centroids; some vectors visit
    their cells, in pieces, others can have neighbours in too many."""
    monkeypatch.setattr(vectors, "BLOCK", 50_000)
    monkeypatch.setattr(vectors, "VISITS", 12)
    rng = np.random.default_rng(3)
    n, d = 16_000, 16
    x = rng.normal(size=(n, d))
    x[::3] = rng.normal(size=d) + rng.normal(size=(len(x[::3]), d)) * 0.2
    x = x.astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    result, audit = vectors.near_duplicates(df, 0.95)
    got, found = result.toPandas().sort_values("vec_id"), audit.first()
    u = vectors.unit(x)
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.95).sum(axis=1) - 1 for i in range(0, n, 1000)])
    assert want[::3].mean() > 1000 and n // 800 > 3 * 3
    assert got["n_links"].tolist() == want.tolist()
    assert found.links == want.sum() and (got["n_found"] <= got["n_links"]).all()
    print("recall of the graph alone", found.found / found.links)
    assert (got["component_id"].to_numpy()[::3][want[::3] > 0] == 0).all()


def test_search_recall():
    """The graph search alone, on its own shard and on two shards whose lists are united."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 24))
    x = vectors.unit(np.repeat(base, 5, axis=0) + rng.normal(size=(1000, 24)) * 0.1)
    truth = x @ x.T >= 0.95
    np.fill_diagonal(truth, False)
    halves = [np.arange(0, 700), np.arange(300, 1000)]
    united = [set() for _ in x]
    for half in halves:
        for i, own in zip(half, vectors.grow(x[half])):
            united[i] |= set(half[own].tolist())
    for lists in (vectors.grow(x), [np.array(sorted(u)) for u in united]):
        linked = np.zeros_like(truth)
        linked[vectors.search(x, lists, np.arange(len(x)), 0.95)] = True
        assert (linked & truth).sum() >= 0.99 * truth.sum() and not (linked & ~truth).any()


def test_search_recall_in_a_tight_group():
    """Hundreds of near copies among vectors far apart, where pruning alone leaves members that none leads to."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[rng.choice(1500, 300, replace=False)] = rng.normal(size=32) + rng.normal(size=(300, 32)) * 0.1
    x = vectors.unit(x)
    truth = x @ x.T >= 0.95
    np.fill_diagonal(truth, False)
    linked = np.zeros_like(truth)
    linked[vectors.search(x, vectors.grow(x), np.arange(len(x)), 0.95)] = True
    assert truth.sum() > 80_000 and (linked & truth).sum() >= 0.99 * truth.sum() and not (linked & ~truth).any()


def test_empty_table(spark):
    result, _ = vectors.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert result.count() == 0
