"""Operator 4: near-duplicate documents by min-max hashing.

Each document is the set of its distinct word shingles.  Every permutation gives two
values, its least and its greatest image of the set, so the signature takes half as many
hash evaluations; two permutations make a band of four values.  With ``BANDS`` = 24
bands a pair of similarity 0.8 shares none with probability 3e-6, of 0.9 with 1e-11.

Documents with equal sets form a class, of which one is kept for the rest.  Classes that
share a band are candidates.  Bands are not turned into pairs: every class is tied to its
band's smallest class, and components of these ties are the groups in which links are
confirmed.  A group is cut into blocks of ``BLOCK`` classes, and each pair of blocks is a
task of its own that holds the full sets of two blocks; in it, pairs that are already
connected are skipped, and only the links that connect are returned.  Thus no task grows
with a group, and what is written grows with the number of documents.  All links between
different groups of connected documents are tested on full sets.

Nulls and empty texts have no shingle, are linked with nothing and are kept.  A null
doc_id is an id of its own kind.  Texts that share an id are told apart by their hashes.  Rows that repeat are one class.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._blocks import Block, block_links, confirmed_links, in_blocks
from tracewright.llm._spark import Shelf, components, cut, text_batches, trimmed
from tracewright.llm._words import U, mix, shingles, words

BANDS, BLOCK = 24, 256
_MULTIPLIERS = np.random.default_rng(41).integers(1 << 20, 1 << 31, 2 * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_FACTORS = np.random.default_rng(42).integers(1, 1 << 62, (BANDS, 4), dtype=np.uint64) * U(2) + U(1)


def set_keys(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingle hashes, whatever their order."""
    return (int(mix(found).sum(dtype=U)), int(mix(found ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest image under each permutation."""
    low = np.full(2 * BANDS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(2 * BANDS, np.uint32)
    x = (found >> U(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        images = _MULTIPLIERS[:, None] * x[None, i : i + 4096]
        np.minimum(low, images.min(1), out=low)
        np.maximum(high, images.max(1), out=high)
    return low, high


def bands(found: np.ndarray) -> np.ndarray:
    low, high = signature(found)
    four = np.concatenate([low.reshape(BANDS, 2), high.reshape(BANDS, 2)], axis=1).astype(U)
    return mix((four * _BAND_FACTORS).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U)).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    hashes, at = words(column)
    return [np.unique(s) for s in shingles(hashes, at, size)]


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, k0, k1 (128 bits that stand for the set), bands."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in text_batches(batches, "text", 1 << 18):
            sets = _sets(batch.column(1), size)
            keys = [set_keys(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k and _signed(k[0]) for k in keys], pa.int64()),
                    pa.array([k and _signed(k[1]) for k in keys], pa.int64()),
                    pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "k0", "k1", "bands"],
            )

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_key"))
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, text_key bigint, n_shingles bigint, k0 bigint, k1 bigint, bands array<bigint>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    small, large = len(a), len(b)
    if 100 * min(small, large) < percent * max(small, large):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (small + large - common)


def _likely(sets: list[np.ndarray], percent: int) -> Callable:
    sizes = np.array([len(x) for x in sets])
    return lambda y: 100 * np.minimum(sizes, sizes[y]) >= percent * np.maximum(sizes, sizes[y])


def _set_links(blocks: list[Block], percent: int) -> list[tuple]:
    similar, likely = functools.partial(_similar, percent=percent), functools.partial(_likely, percent=percent)
    return [link for b in blocks for link in block_links(*b, similar, likely)]


def _links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(src, dst): confirmed links between classes, enough to connect all that are linked."""
    ties = classes.select("node", F.explode("bands").alias("band"))
    hubs = ties.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("band", "hub")
    groups = components(ties.join(hubs, "band").select(F.col("node").alias("src"), F.col("hub").alias("dst")))
    members = in_blocks(groups.withColumnRenamed("component_id", "group"), BLOCK).join(classes.select("node", "at"), "node")
    texts = docs.select(docs[doc_id].alias("_id"), F.xxhash64(docs[text]).alias("_key"), docs[text].alias("text"))
    rows = members.join(texts, F.col("at.doc_id").eqNullSafe(F.col("_id")) & (F.col("at.text_key") == F.col("_key")))
    rows = rows.select("node", "group", "blocks", "block", "text")
    return confirmed_links(rows, lambda batch: _sets(batch.column("text"), size), functools.partial(_set_links, percent=percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    key = ["k0", "k1", "n_shingles"]
    with Shelf(docs.sparkSession) as shelf:
        base = shelf.put(signatures(docs, doc_id, text, size))
        classes = base.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("bands").alias("bands"))
        classes = shelf.put(classes.withColumn("node", F.monotonically_increasing_id()))
        joined = components(_links(docs, classes, doc_id, text, size, percent))
        named = classes.select(*key, "doc", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component_id", "node"))
        least = named.groupBy("component").agg(F.min("doc").alias("least"))
        named = named.join(least, "component").select(*key, "least")
        out = cut(base.select("doc_id", *key).join(named, key, "left"))
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
