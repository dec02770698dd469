import random
from collections import defaultdict

import pytest

from tracewright.llm import mixing as mx


def water(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap * sizes[s] + 1e-9]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def make(seed, n=4000):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "Z", "é", "tiny"] + [f"s{i}" for i in range(5)]
    return [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 30))), "a" if rng.random() < 0.4 else "tiny" if i < 3 else rng.choice(names[:6] + names[7:])) for i in range(n)]


@pytest.mark.parametrize("few", [True, False])
def test_against_definition(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mx, "BROADCAST_SOURCES", 0)
    rows = make(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.plan(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, s in rows:
        sizes[s] += len(text.split())
    expected = water(sizes)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= most[s] / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mx.plan(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_rows_as_often_as_taken(spark):
    docs = spark.createDataFrame(make(2, 600), "doc_id long, text string, source string")
    times = defaultdict(int)
    for r in mx.mix(docs).collect():
        times[r.doc_id] += 1
    assert {r.doc_id: r.copies for r in mx.plan(docs).collect() if r.copies} == dict(times)


def test_edges(edge_docs, no_docs):
    assert mx.plan(no_docs).collect() == [] and mx.mix(no_docs).collect() == []
    rows = mx.plan(edge_docs).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    assert mx.mix(edge_docs).columns == edge_docs.columns
