"""Links and components of embeddings against all pairs."""

import math

import numpy as np
import pytest

from vitaeflow.llm import embedding_links as links

KIND = "vec_id long, embedding array<double>, label int, place long, n long, `a b` string"


def by_hand(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) from all pairs."""

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) if k is not None else None for k, v in rows]
    near = [[j for j, b in enumerate(units) if i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= cosine] for i, a in enumerate(units)]
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        name = None if k is None else min(rows[j][0] for j in seen)
        out.append((k, len(near[i]), name, k is not None and k == name))
    return out


def groups(rng, n, dim, noise):
    """n vectors: far ones, near copies at several distances, scaled and equal copies, and chains."""
    out = []
    while len(out) < n:
        v = rng.normal(size=dim)
        out.append(v)
        for spread in rng.choice(noise, size=rng.integers(0, 6)):
            out.append(v + spread * rng.normal(size=dim))
        if rng.random() < 0.2:
            out += [v * 3, v, v]
        if rng.random() < 0.1:
            for _ in range(5):
                v = v + 0.3 * rng.normal(size=dim)
                out.append(v)
    return out[:n]


@pytest.mark.parametrize("dim, n", [(1, 60), (2, 300), (3, 500), (16, 600)])
def test_trees_find_all_pairs(dim, n):
    rng = np.random.default_rng(dim)
    raw = np.array(groups(rng, n, dim, [0.01, 0.1, 0.3, 0.45]))
    counts = rng.integers(1, 4, size=n)
    half = n // 2
    a, b = links.grown(raw[:half], counts[:half]), links.grown(raw[half:], counts[half:])
    for tree in (a, b):  # nested nets with separated nodes, and true covering radii
        for radius, level, at in zip(links.RADII, tree.levels, tree.nodes):
            points = tree.units[level.points]
            apart = np.linalg.norm(points[:, None] - points[None], axis=2) + 9 * np.eye(len(points))
            assert apart.min() > radius - 1e-7 or level is tree.levels[-1]
            assert (np.linalg.norm(tree.units - points[at], axis=1) <= level.radii[at] + 1e-12).all()
            assert level.sizes.sum() == len(tree.units)
    near = links.units_of(raw) @ links.units_of(raw).T >= 0.9
    one, two, labels = links.traversed(a, b)
    assert (one == near[:half, half:] @ counts[half:]).all() and (two == near[half:, :half] @ counts[:half]).all()
    cross = near.copy()
    cross[:half, :half] = cross[half:, half:] = False
    reach = np.linalg.matrix_power((cross | np.eye(n, dtype=bool)).astype(float), 1) > 0
    for _ in range(12):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    assert ((labels[:, None] == labels[None]) == reach).all()
    own, _, _ = links.traversed(a, a)
    assert (own == near[:half, :half] @ counts[:half]).all()


def test_rows_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 40)
    monkeypatch.setattr(links, "BALLS", 3)
    monkeypatch.setattr(links, "PIVOTS", 8)
    rng = np.random.default_rng(3)
    rows = [(k * 7 % 997, v.tolist()) for k, v in enumerate(groups(rng, 300, 8, [0.05, 0.3, 0.5]))]
    center = rng.normal(size=8)
    rows += [(2000 + k, (center + 0.02 * rng.normal(size=8)).tolist()) for k in range(200)]  # whole blocks of near copies
    rows += [(3000 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]) for k in range(60)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 8), (4003, [1.0, None] + [0.0] * 6), (4004, [float("nan")] * 8), (4005, [float("inf")] + [1.0] * 7)]
    rows += [(None, center.tolist()), (None, None), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (4008, [1e300] * 8), (4009, [1e-300] * 8), (4010, [-1.0, -2.0])]
    rows += [(2000, [9.0, -9.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (4011, [1.0] + [0.0] * 7), (4012, [0.9, math.sqrt(1 - 0.81)] + [0.0] * 6)]
    docs = spark.createDataFrame([(k, v, 1, 5, 6, "x") for k, v in rows], KIND)
    got = links.near_embeddings(docs)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = by_hand(rows)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    assert links.near_embeddings(docs.limit(0)).count() == 0
    assert [tuple(r) for r in links.near_embeddings(docs.filter("vec_id = 4000")).collect()] == [(4000, 0, 4000, True)]


def test_trees_are_not_shuffled_to_their_pairs(spark, monkeypatch):
    """What is written must not grow with the pairs of blocks: trees are read where they are kept."""
    monkeypatch.setattr(links, "BLOCK", 20)
    plans, kept = [], links.cut_in_batches

    def noted(df, rows):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, rows)

    monkeypatch.setattr(links, "cut_in_batches", noted)
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(groups(rng, 200, 16, [0.1, 0.3]))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, links.near_embeddings(docs).collect())) == sorted(by_hand([(k, np.array(v, dtype=np.float32).tolist()) for k, v in rows]))
    assert len(plans) == 1 and "Exchange" not in plans[0]
