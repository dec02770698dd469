import hashlib
import re

from tracewright.llm import spotsigs as sp


def signatures(text):
    w = [b.decode("utf-8", "surrogateescape") for b in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    content = [i for i, x in enumerate(w) if x not in sp.ANCHORS]
    out = set()
    for i, x in enumerate(w):
        after = [j for j in content if j > i][:2]
        if x in sp.ANCHORS and len(after) == 2:
            out.add((x, w[after[0]], w[after[1]]))
    return out or {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_against_definition(spark):
    texts = ["The cat of the house ran to a big red barn", "the cat of the house ran to a small barn é", "no anchors whatsoever here", "x", "", None, "Le chat de la maison noire et la souris grise"] * 3
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in sp.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in rows:
        own, following = text or "", texts[(i + 1) % len(texts)] or ""
        n = len(own) // 4
        edited = own[: len(own) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(signatures(own), signatures(edited))) < 1e-12
        assert abs(r.near_next - jaccard(signatures(own), signatures(following))) < 1e-12
        assert r.fingerprint == got[i % 7].fingerprint


def test_pruned_likeness():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(0, 600))).astype(np.uint32)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 400, rng.integers(0, 60)).astype(np.uint32)]))
        exact = sp.likeness(a, b)
        assert sp.likeness(a, b, 0.8) == (exact if exact >= 0.8 else 0.0) or (exact < 0.8 and sp.likeness(a, b, 0.8) in (0.0, exact))
        if exact >= 0.8:
            assert abs(sp.length_partition(len(a), 0.8) - sp.length_partition(len(b), 0.8)) <= 1
        assert (sp.read(sp.written(a)) == a).all()


def test_edges(spark, edge_docs, no_docs):
    assert sp.edited_and_next(no_docs).collect() == [] and sp.fingerprints(no_docs).collect() == []
    rows = sp.edited_and_next(edge_docs).collect()
    assert len(rows) == 12
    same = [r.fingerprint for r in rows if r.doc_id in (1, 5)]
    assert same[0] == same[1] and {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0."}
    one = sp.edited_and_next(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
