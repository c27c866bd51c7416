"""Exact cosine groups against all pairs by brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rankframe.llm import cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, h1 string, cell int"


def groups_by_hand(rows, cosine):
    """rows: (id, vector). The number of links and the smallest id reached, in the order of the rows."""
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[i][1]) for i in usable), default=0)
    x = np.array([[float(np.float32(c)) for c in rows[i][1]] + [0.0] * (width - len(rows[i][1])) for i in usable]).reshape(len(usable), width)
    squares = (x * x).sum(axis=1)
    near = (x @ x.T) / np.sqrt(squares[:, None] * squares[None, :]) >= cosine
    np.fill_diagonal(near, False)
    label = list(range(len(usable)))
    for i, j in zip(*np.nonzero(near)):
        a, b = (min(label[i], label[j]), max(label[i], label[j]))
        if a != b:
            label = [a if n == b else n for n in label]
    smallest = {}
    for n, i in zip(label, usable):
        if rows[i][0] is not None:
            smallest[n] = min(smallest.get(n, rows[i][0]), rows[i][0])
    want = [(i, 0, i) for i, _ in rows]
    for n, i, links in zip(label, usable, near.sum(axis=1)):
        want[i] = (rows[i][0], int(links), smallest.get(n))
    return sorted(want, key=repr)


def clouds(seed, groups, size, dim, width):
    """Groups of vectors around common directions, some chained, and as many without neighbours."""
    pick = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        at = pick.normal(size=dim)
        for n in range(pick.integers(1, size)):
            rows.append(at + pick.normal(size=dim) * width * pick.random())
            at = at + (pick.normal(size=dim) * width / 2 if n % 3 == 0 else 0)
    rows += list(pick.normal(size=(groups, dim)))
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(pick.permutation(len(rows) * 2), rows)]


def run(spark, rows, cosine=0.9):
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in cover_tree.near_groups(df, cosine).collect()), key=repr)


@pytest.mark.parametrize(("dim", "width", "cosine"), [(2, 0.3, 0.99), (8, 0.3, 0.9), (32, 0.25, 0.9)])
def test_same_as_all_pairs(spark, dim, width, cosine):
    rows = clouds(dim, 40, 40, dim, width)
    assert run(spark, rows, cosine) == groups_by_hand(rows, cosine)


def test_many_small_stripes_and_tiles(spark, monkeypatch):
    """A tiny sample and tiny stripes: cells dealt over several stripes, many tiles."""
    for name, value in (("SAMPLE", 12), ("STRIPE", 20), ("LEAST_TILES", 4), ("FOLD", 50)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = clouds(9, 30, 60, 6, 0.3)
    assert run(spark, rows) == groups_by_hand(rows, 0.9)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])]
    rows += [(7, [1.0, 0.0]), (8, [1e-30, 0.0]), (None, [3e38, 0.0]), (9, [1.0]), (9, [1.0]), (9, [0.0, 1.0]), (None, [0.0, -1.0]), (10, [-0.0, -2.0])]
    assert run(spark, rows) == groups_by_hand(rows, 0.9)
    assert run(spark, rows[:6]) == [(i, 0, i) for i in range(1, 7)]
    assert run(spark, []) == []


def test_copies_by_the_thousand(spark):
    """One vector in a third of the rows, and near copies of it."""
    pick = np.random.default_rng(4)
    hot = pick.normal(size=16)
    rows = [(i, [float(np.float32(c)) for c in hot]) for i in range(3000, 6000)]
    rows += [(i, [float(np.float32(c)) for c in hot + pick.normal(size=16) * 0.02]) for i in range(300)]
    rows += [(i, [float(np.float32(c)) for c in pick.normal(size=16)]) for i in range(300, 900)]
    got = run(spark, rows)
    assert {r[1:] for r in got if r[0] >= 3000} == {(3299, 0)} and sum(r[2] == 0 for r in got) == 3300


def test_at_the_threshold_exactly(spark):
    """Whole numbers with a cosine of 9/10, where rounding decides in products of unit vectors."""
    rows = [(1, [10.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [9.0, -4.0, 1.0, 1.0]), (4, [90.0, 30.0, 10.0, 31.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows], SCHEMA)
    found, members = cover_tree.similar_pairs(df, 0.9)
    assert {(1, 2), (1, 3)} <= {(r["a"], r["b"]) for r in found.collect()} and members.count() == 4
    assert {(r[0], r[2]) for r in run(spark, rows)} >= {(1, 1), (2, 1), (3, 1)}


def test_pairs_between_different_vectors(spark):
    rows = clouds(3, 20, 20, 8, 0.3)
    rows += [(i + 10_000, v) for i, v in rows[:30]]
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows], SCHEMA)
    found, members = cover_tree.similar_pairs(df, 0.9)
    x = np.array([v for _, v in rows[:-30]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    want = {tuple(sorted((rows[a][0], rows[b][0]))): x[a] @ x[b] for a, b in zip(i, j)}
    got = {(r["a"], r["b"]): r["cosine"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert dict(map(tuple, members.collect())) == {i: i % 10_000 if i >= 10_000 else i for i, _ in rows}


def test_bounds_skip_and_count_whole_nodes():
    """Tight clouds: far fewer products than pairs, by exclusion and by inclusion."""
    pick = np.random.default_rng(1)
    raw = np.concatenate([pick.normal(size=12) + pick.normal(size=(200, 12)) * 0.01 for _ in range(10)])
    tree = cover_tree.cover_tree(cover_tree.unit_rows(raw))
    part = cover_tree.Subtree(tree, raw[tree.order], np.ones(2000, dtype=np.int64), 0)
    found = cover_tree.Counter(2000)
    assert cover_tree.traverse(part, part, 0.9, found) < 20_000
    assert (found.links == ((part.units @ part.units.T >= 0.9).sum(axis=1) - 1)).all()


def test_tree_invariants():
    """Centres are their node's first vector, cover it, and stand further apart than the level."""
    pick = np.random.default_rng(2)
    units = cover_tree.unit_rows(pick.normal(size=(700, 5)))
    tree = cover_tree.cover_tree(units)
    units = units[tree.order]
    assert sorted(tree.order) == list(range(700))
    for n, (lo, hi, radius, first, last) in enumerate(zip(tree.lo, tree.hi, tree.radius, tree.first, tree.last)):
        assert cover_tree.angles(units[lo : lo + 1], units[lo:hi]).max() <= radius + 1e-7
        if last > first:
            assert tree.lo[first] == lo and tree.hi[last - 1] == hi and (tree.hi[first : last - 1] == tree.lo[first + 1 : last]).all()
            centres = units[tree.lo[first:last]]
            apart = cover_tree.angles(centres, centres) + 9 * np.eye(last - first)
            assert apart.min() > tree.radius[first:last].max() - 1e-7
