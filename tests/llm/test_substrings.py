import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewright.llm import substring_dedup as sd
from tracewright.llm._suffix_array import permuted_common_prefixes, suffix_array


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            else:
                seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.choice([1, 2, 3, 20])
        t = np.array([rng.randint(1, a) for _ in range(rng.randint(0, 60))] + [0])
        order = sorted(range(len(t)), key=lambda i: list(t[i:]))
        for size in (a + 1, 1000):  # vector and name induction
            assert suffix_array(t, size).tolist() == order
        shared = permuted_common_prefixes(t, np.array(order), 7)
        for i, j in zip(order[1:], order):
            n = 0
            while i + n < len(t) and j + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert shared[i] == min(n, 7)


def test_against_brute_force(spark):
    rng = random.Random(4)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = [(k, "".join(rng.choice(parts)[rng.randint(0, 30) : rng.randint(100, 400)] for _ in range(rng.randint(0, 5)))) for k in range(60)]
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, "a" * 99), (103, None), (104, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sum(v[1] for v in got.values()) > 1000


def test_edges(spark, edge_docs, no_docs):
    assert sd.dedup_substrings(no_docs).collect() == []
    rows = sd.dedup_substrings(edge_docs, texts=True).collect()
    assert len(rows) == 12 and all(r.n_bytes == r.n_removed + len(r.kept) for r in rows)
    twice = spark.createDataFrame([(1, "x" * 150)] * 2 + [(None, "y" * 120), (2, "y" * 120)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.dedup_substrings(twice).collect())
    assert got == [("1", 149), ("1", 149), ("2", 120), ("None", 119)]


def test_classes_need_both_hashes_equal():
    rows = {"gram": [5, 5, 5, 6], "context": [1, 2, 1, 1], "doc": [1, 2, 3, 4], "uid": [1, 2, 3, 4], "first": [0, 0, 0, 0]}
    firsts, again = sd._firsts({k: np.array(v, np.uint64 if k in ("gram", "context") else np.int64) for k, v in rows.items()})
    assert sorted(firsts.tolist()) == [0, 1, 3] and again.tolist() == [2]


def test_texts_are_not_copied_where_only_digests_are_asked():
    table = pa.table({"doc_id": list(range(20)), "uid": list(range(20)), "text": ["x" * 1_000_000] * 20})
    none = pa.table({"packed": pa.array([], pa.binary())})
    tracemalloc.start()
    got = sd._apply(table, none, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("kept_sha256").to_pylist() == [hashlib.sha256(b"x" * 1_000_000).hexdigest()] * 20
    assert most < 5_000_000


def test_a_bucket_of_documents_is_a_partition(spark):
    full = spark.range(2000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("uid"), F.lit("x").alias("text"))
    rows = sd._documents(full, 51).select("bucket", "uid", F.spark_partition_id().alias("p")).collect()
    assert all(r.bucket == r.p for r in rows) and len({r.p for r in rows}) == 51
    assert sd._of_documents(np.array([r.uid for r in rows], np.int64), 51).tolist() == [r.bucket for r in rows]
