import numpy as np

from tests.llm.conftest import Groups
from tracewright.llm import ego_join as ej

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies int"


def brute(rows, cosine=0.98):
    unit = {}
    for i, v, label, *_ in rows:
        x = None if v is None else [np.nan if e is None else e for e in v]
        if label is not None and x and np.isfinite(x).all() and np.any(x):
            unit[i] = (label, np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)))
    links, groups = {r[0]: 0 for r in rows}, Groups([r[0] for r in rows])
    for i, (a, x) in unit.items():
        for j, (b, y) in unit.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= cosine:
                links[i] += 1
                links[j] += 1
                groups.join(i, j)
    return {i: (n, groups.find(i), groups.find(i) == i) for i, n in links.items()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ej, "SEQUENCE", 16)
    monkeypatch.setattr(ej, "LEAF", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3), "n", 1))
    nan, inf = float("nan"), float("inf")
    rows += [(300, rows[0][1], 0, "n", 1), (301, rows[0][1], None, "n", 1), (302, None, 1, "n", 1), (303, [0.0] * 16, 1, "n", 1), (304, [nan] * 16, 1, "n", 1), (305, [inf] * 16, 1, "n", 1)]
    rows += [(306, [None] * 16, 1, "n", 1), (307, [1.0, 2.0], 1, "n", 1), (308, [2.0, 4.0], 1, "n", 1), (309, [], 1, "n", 1), (310, [-0.0, 1.0], 1, "n", 1), (311, [0.0, 1.0], 1, "n", 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ej.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and sum(n for n, _, _ in got.values()) > 100


def test_empty(spark):
    assert ej.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(1, None, 1, "n", 1), (1, None, None, "n", 1)], SCHEMA)
    assert [(r.n_links, r.component_id, r.kept) for r in ej.near_duplicates(only).collect()] == [(0, 1, True)] * 2
