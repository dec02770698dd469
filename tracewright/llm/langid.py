"""Operator 10: language identification by nearest centroid.

A text is lower-cased, runs of non-letters become one space, and its one-, two- and
three-character n-grams are hashed to ``DIMS`` counts.  Weighted by (1 + ln count) times
inverse document frequency and scaled to length one, they are compared by cosine with
several centroids per language, found by spherical k-means.  A text whose best cosine lies
under the distance limit learned from the sample is rejected.

Fitting uses a bounded sample: at most about ``sample_rows`` rows a language, chosen by a
hash of the text; sampled texts are read whole.  Prediction moves no data.

Nulls: a null text, and one without a letter, is ``und`` with score 0 and isn't rejected or
compared; a null language isn't learned from.  With nothing to learn from every text is
``und``.  Ties go to the language first in code point order.  Repeated rows are predicted
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._spark import cut, text_batches

DIMS = 1 << 14
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    letters = _GAP.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):
        return None
    a = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + a[2:]
    grams = np.concatenate([a * np.uint32(0xC2B2AE3D), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(0x2C1B3C6D)) >> np.uint32(18), minlength=DIMS)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # DIMS rows, a column for each centroid
    idf: np.ndarray
    limit: float  # least cosine that isn't rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        at = np.flatnonzero(counts)
        w = (1 + np.log(counts[at])) * self.idf[at]
        cosines = w @ self.centroids[at] / max(float(np.linalg.norm(w)), 1e-12)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, score < self.limit


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first starts; unit centroids."""
    starts = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        new = _unit(new)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 1200, clusters: int = 4, rejected_share: float = 0.005) -> Model:
    """Learn from the rows of ``docs`` whose language isn't null."""
    rows = docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count()
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("count")).alias("share"))
    picked = rows.join(F.broadcast(share), "lang").where(F.shiftrightunsigned(F.xxhash64("text"), 33) < F.col("share") * (1 << 31))  # broadcast: one row a language
    picked = cut(picked.select("lang", "text").dropDuplicates(["lang", "text"]).repartition(8, "text"))

    def frequencies(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for batch in text_batches(batches, "text"):
            for t in batch.column(1).to_pylist():
                c = ngram_counts(t)
                if c is not None:
                    df[:DIMS] += c > 0
                    df[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], ["df"])

    df = sum((np.frombuffer(r.df, np.int64) for r in picked.mapInArrow(frequencies, "df binary").collect()), np.zeros(DIMS + 1, np.int64))
    idf = np.where(df[:DIMS] > 0, np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 0.05, 0.0)

    def centroids(table: pa.Table) -> pa.Table:
        name = table.column("lang")[0].as_py()
        found = [c for t in sorted(table.column("text").to_pylist()) if (c := ngram_counts(t)) is not None]
        if not found:
            return pa.table({"lang": pa.array([], pa.string()), "centroids": pa.array([], pa.binary()), "cosines": pa.array([], pa.binary())})
        x = np.zeros((len(found), DIMS), np.float32)
        for i, c in enumerate(found):
            at = np.flatnonzero(c)
            x[i, at] = (1 + np.log(c[at])) * idf[at]
        x = _unit(x)
        c = _cluster(x, clusters).astype(np.float32)
        return pa.table({"lang": pa.array([name], pa.string()), "centroids": pa.array([c.tobytes()], pa.binary()), "cosines": pa.array([(x @ c.T).max(1).astype(np.float32).tobytes()], pa.binary())})

    made = picked.groupBy("lang").applyInArrow(centroids, "lang string, centroids binary, cosines binary").collect()  # a group: sample_rows rows
    languages, parts, cosines = [], [], []
    for r in sorted(made, key=lambda r: r.lang):
        c = np.frombuffer(r.centroids, np.float32).reshape(-1, DIMS)
        languages += [r.lang] * len(c)
        parts.append(c)
        cosines.append(np.frombuffer(r.cosines, np.float32))
    if not parts:
        return Model([], np.zeros((DIMS, 0)), idf, 0.0)
    limit = float(np.quantile(np.concatenate(cosines), rejected_share)) * 0.5
    return Model(languages, np.ascontiguousarray(np.concatenate(parts).T.astype(np.float64)), idf, limit)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, rejected; with ``reject`` a rejected text is ``und``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in text_batches(batches, "text"):
            rows = [model.predict(t) for t in batch.column(1).to_pylist()]
            names = [UNKNOWN if reject and r[2] else r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
