import random

import pytest

from tests.llm.conftest import Groups, near_texts
from tracewright.llm import minhash as mh


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    groups = Groups(sets)
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                groups.join(i, j)
    return {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "block"), [(4, 256), (5, 256), (4, 3)])
def test_against_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(mh, "BLOCK", block)
    rows = list(enumerate(near_texts(k, 150) + ["one two three", "ONE two  three", "one", "", None, "one two three four"]))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=k).collect()}
    assert got == brute(rows, k) and len({c for _, c, _ in got.values()}) < 130


def test_edges(edge_docs, no_docs):
    assert mh.near_duplicates(no_docs).collect() == []
    rows = mh.near_duplicates(edge_docs).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].component_id == 1 and not by[5][0].kept and all(r.kept for r in by[6] + by[2] + by[3] + by[None])


def test_texts_that_share_an_id(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(16)]
    rows = [(1 if i < 8 else None, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {}
    for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect():
        got.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert got[1] == [(1, True)] * 8
    assert sorted(got[None]) == [(108 + i, False) for i in range(8)]
    for i in range(16):
        assert got[100 + i] == ([(1, False)] if i < 8 else [(108 + i - 8, True)])


def test_memory_of_a_slice(spark, monkeypatch):
    """Texts are hashed in slices of 256 KB, and a worker gives its memory back when a task ends."""
    import ctypes

    from tracewright.llm import _spark

    called = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": lambda self, n: called.append(n)})())
    assert list(_spark.trimmed(lambda batches: (b * 2 for b in batches))([1, 2])) == [2, 4] and called == [0]
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 1000)], ["text"])
    assert max(b.num_rows for b in _spark.text_batches([texts], "text", 1 << 18)) == 262
