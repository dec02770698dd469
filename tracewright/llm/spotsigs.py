"""Operator 2: document fingerprints by SpotSigs.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  At
every *anchor*, a very common word, stands a spot: the anchor and the ``CHAIN`` content
words (words that are no anchors) that follow it.  The hashes of all spots form the
document's signature set.  A text with words but without a spot has its runs of
``CHAIN`` + 1 words instead (fewer words: the whole sequence), one without a word has the
empty set.  The set is a function of the text alone, so equal texts have equal sets.

The fingerprint writes the set out: its length, a dot, and base64 of the sorted 32-bit
hashes.  Sets are compared by Jaccard similarity.  Lengths decide first: sets whose length
partitions (geometric, by 1 / least) lie apart cannot reach the least similarity, and the
merge stops as soon as what is left cannot.

Nulls: a null text is empty; two empty sets have similarity 1.  A null doc_id sorts first.
Rows that share a doc_id are ordered by text; each gets its own row.  A single row follows
itself.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._spark import shuffle_partitions, text_batches
from tracewright.llm._words import U, mix, words

#: Content words in a chain.
CHAIN = 2
# Very common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from in is it of on or that the this to was were with
als auf aus das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu
au aux ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une
al como con del el en es la las lo los más no para por que se su un una y
""".split()

_SEPARATES = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_CHAIN_FACTORS = np.random.default_rng(7).integers(1, 1 << 62, CHAIN + 2, dtype=np.uint64) * U(2) + U(1)


def _anchor_hashes() -> np.ndarray:
    return np.sort(words(pa.array(ANCHORS), _SEPARATES)[0])


_ANCHOR_HASHES = _anchor_hashes()


def _chain_hash(parts: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(parts[0]), U)
    for part, factor in zip(parts, _CHAIN_FACTORS):
        total += part * factor
    return mix(total) >> U(32)


def signature_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted signature set (uint32) of every text."""
    hashes, at = words(column, _SEPARATES)
    n = len(hashes)
    if not n:
        return [np.zeros(0, np.uint32)] * len(column)
    place = np.minimum(np.searchsorted(_ANCHOR_HASHES, hashes), len(_ANCHOR_HASHES) - 1)
    is_anchor = _ANCHOR_HASHES[place] == hashes
    content = np.flatnonzero(~is_anchor)
    anchors = np.flatnonzero(is_anchor)
    row_of = np.repeat(np.arange(len(column)), np.diff(at))
    after = np.searchsorted(content, anchors)  # the first content word after each anchor
    whole = after + CHAIN <= len(content)
    anchors, after = anchors[whole], after[whole]
    chain = [content[after + i] for i in range(CHAIN)]
    inside = row_of[chain[-1]] == row_of[anchors] if len(anchors) else np.zeros(0, bool)
    anchors, chain = anchors[inside], [c[inside] for c in chain]
    spots = _chain_hash([hashes[anchors], *(hashes[c] for c in chain)]).astype(np.uint32)
    cuts = np.searchsorted(anchors, at)
    runs = _chain_hash([hashes[i : n - CHAIN + i] for i in range(CHAIN + 1)]).astype(np.uint32) if n > CHAIN else None
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            out.append(np.unique(spots[a:b]))
        elif at[i + 1] - at[i] > CHAIN:
            out.append(np.unique(runs[at[i] : at[i + 1] - CHAIN]))
        elif at[i + 1] > at[i]:
            own = hashes[at[i] : at[i + 1]]
            out.append((mix((own * _CHAIN_FACTORS[: len(own)]).sum(dtype=U, keepdims=True) + U(len(own))) >> U(32)).astype(np.uint32))
        else:
            out.append(np.zeros(0, np.uint32))
    return out


def written(found: np.ndarray) -> str:
    return f"{len(found)}." + base64.b64encode(found.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(".")[2]), "<u4")


def length_partition(length: int, least: float) -> int:
    """Sets with similarity ``least`` or more are in the same partition or in neighbouring ones."""
    return 0 if length < 1 else 1 + math.floor(math.log(length) / -math.log(least) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0 as soon as it is known to be under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if least > 0 and abs(length_partition(len(a), least) - length_partition(len(b), least)) > 1:
        return 0.0
    if least > 0 and min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    need = least / (1 + least) * (len(a) + len(b))  # common signatures that are needed
    common, step = 0, len(a) if least <= 0 else 256
    for i in range(0, len(a), max(step, 1)):
        common += int(np.isin(a[i : i + step], b, assume_unique=True).sum())
        if common + len(a) - min(len(a), i + step) < need - 1e-9:
            return 0.0
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text; moves no data."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in text_batches(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(s) for s in signature_sets(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All rows by ranges of doc_id, each range followed by the first row of the next one (ghost).

    The driver gets one number a range: bounds and least ids, never texts.
    """
    parts = shuffle_partitions(docs.sparkSession)
    key = F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(docs[doc_id].alias("doc_id"), key.alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], F.lit(max(10_000, 20 * parts)))).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    heads = sorted((r.least, r.part) for r in rows.groupBy(range_of("key").alias("part")).agg(F.min("key").alias("least")).collect())
    firsts = np.array([h[0] for h in heads], np.int64)
    before = np.array([heads[i - 1][1] for i in range(len(heads))], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        own = np.searchsorted(bounds, k, side="right")
        at = np.minimum(np.searchsorted(firsts, k), len(firsts) - 1)
        head = firsts[at] == k
        return pd.Series([[o, before[a]] if h else [o] for o, a, h in zip(own, at, head)])

    placed = rows.select("doc_id", "key", "text", F.posexplode(places("key")).alias("ghost", "part"))
    return placed.repartition(parts, "part").sortWithinPartitions("part", "ghost", "key", "text").select("part", "ghost", "doc_id", "text")


def edited_and_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the contract of the query."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held = None  # the last row: it waits for the next one
        for batch in text_batches(batches, "text", 1 << 20):
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            rows = [held, *rows] if held else rows
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
            held = rows[-1]
            texts = pa.array([r[3] for r in rows], pa.string())
            sets = signature_sets(texts)
            own = [s for s, x, y in zip(sets, rows, rows[1:]) if x[0] == y[0] and not x[1]]
            following = [s for s, x, y in zip(sets[1:], rows, rows[1:]) if x[0] == y[0] and not x[1]]
            edited = []
            for x, y in pairs:
                n = len(x[3]) // 4
                part = y[3][:n]
                edited.append(x[3][: len(x[3]) - n] + part)
            edited_sets = signature_sets(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], batch.schema.field(2).type),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited], pa.string()),
                    pa.array([written(s) for s in own], pa.string()),
                    pa.array([written(s) for s in edited_sets], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(own, edited_sets)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return _in_order(docs, doc_id, text).mapInArrow(run, schema)
