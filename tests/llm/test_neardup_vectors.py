import random

import numpy as np
import pandas as pd

from tabsynth.llm import neardup_vectors as nv
from tabsynth.llm.components import connected_components


def brute(rows, least=0.93):
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for lab in {r[2] for r in rows}:
        at = [i for i, r in enumerate(rows) if ok[i] and r[2] == lab]
        if not at:
            continue
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
            links[at[a]] += 1
            links[at[b]] += 1
            parent[find(at[a])] = find(at[b])
    least_id = {}
    for i, r in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), r[0]), r[0])
    return {(r[0], links[i], least_id[find(i)]) for i, r in enumerate(rows)}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1200)] + [(rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 4), (700, 700)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    import sys

    sys.setrecursionlimit(5000)
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}


def test_small_cases(spark):
    rows = [(4, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (9, [1.0, 0.1], 1), (3, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (10, [1.0, 0.0], None), (11, [-1.0, 0.0], 1), (4, [1.0, 0.0], 1), (12, [3e38, 0.0], 2), (13, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in nv.near_duplicates(df).collect())
    want = {2: (3, 2), 4: (3, 2), 9: (3, 2), 3: (1, 3), 12: (1, 3)}
    assert got == sorted((v, *want.get(v, (0, v)), want.get(v, (0, v))[1] == v) for v, _, _ in rows)
    assert nv.near_duplicates(df.limit(0)).count() == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nv, "HOME_BLOCK", 70)
    monkeypatch.setattr(nv, "PROBE_BLOCK", 150)
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(500, 32))
    x = np.concatenate([centre, centre[:300] + rnd.normal(size=(300, 32)) * 0.2, centre[:200] + rnd.normal(size=(200, 32)) * 0.3, np.repeat(centre[:1], 80, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2 if i < 1000 else 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])).selectExpr("vec_id", "cast(embedding as array<float>) embedding", "cast(label as int) label")
    got = {(r.vec_id, r.n_links, r.component_id) for r in nv.near_duplicates(df, probes=6, list_rows=60).collect()}
    want = brute(rows)
    assert sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want) and len(got & want) >= 0.97 * len(want)
    assert {(r.vec_id, r.n_links, r.component_id) for r in nv.near_duplicates(df, probes=99, list_rows=60).collect()} == want


def test_exact_mode_and_unequal_lengths(spark, monkeypatch):
    monkeypatch.setattr(nv, "HOME_BLOCK", 70)
    rnd = np.random.default_rng(2)
    rows = []
    for dim, n in ((16, 400), (5, 120), (3, 1)):
        centre = rnd.normal(size=(n, dim))
        x = np.concatenate([centre, centre[: n // 2] + rnd.normal(size=(n // 2, dim)) * 0.3]).astype(np.float32)
        rows += [(len(rows) + i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(10_000, [1.0, 0.0], 0), (10_001, [2.0, 0.0], 0), (10_002, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in nv.near_duplicates(df, probes=1, list_rows=40, exact=True).collect()]
    by_length = {d: [r for r in rows if len(r[1]) == d] for d in {len(r[1]) for r in rows}}
    assert set(got) == set().union(*(brute(part) for part in by_length.values())) and len(got) == len(rows)


def test_clashing_columns(spark):
    names = ["cid", "h1", "x", "copies", "dim", "list", "component", "n"]
    rows = [(i, [1.0, i / 1000], 1, *range(8)) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(["vec_id long", "embedding array<double>", "label int", *(f"{n} int" for n in names)]))
    assert {(r.n_links, r.component_id) for r in nv.near_duplicates(df).collect()} == {(4, 0)}
