"""Operator 3: toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs and digits that stand for letters become
those letters, accents (combining marks, after decomposition) and zero-width characters go,
and every other run of non-letters becomes one space.  One automaton finds all lexicon entries in one pass:
whole words and word beginnings, each with a weight, and exception phrases, which cancel
the entries that they cover.  The sum of the weights, and that sum normalised by the
length in words, go through a logistic curve to a score between 0 and 1.

Lexicon, exceptions and curve are learned from labelled rows: weights are log-odds of
document frequencies; a beginning is preferred to the words that it explains; exceptions
are two-word phrases with an entry that only occur in clean documents.  Learning uses a
bounded sample (``sample_rows`` labelled rows, by a hash of doc_id); scoring sees every
whole text and moves no data.

Nulls: null and empty texts have no entry and get the score of a text without entries;
labels that are null are not learned from; of several labels for one id the highest
counts.  Without any toxic row the lexicon is empty and all scores are 0.  Repeated rows
are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._spark import cut, hash_share, text_batches, trimmed

# Characters that look like Latin letters, and digits or signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_SIGNS = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_LOOSE = re.compile("[̀-ͯ​-‏⁠﻿­]+")
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    text = text or ""
    if not text.isascii():
        text = _LOOSE.sub("", unicodedata.normalize("NFKD", text))
    return " " + _GAP.sub(" ", text.lower().translate(_SIGNS)).strip() + " "


@dataclass
class Lexicon:
    """entries: text -> weight, where a text begins with a space and ends with one if it is a whole word."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, weight in self.entries.items():
            found.add_word(text, (len(text), weight))
        for text in self.exceptions:
            found.add_word(text, (len(text), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(weight) + c * math.log1p(100 * weight / max(words, 1))))))


def weigh(automaton, folded: str) -> float:
    """Sum of the weights of the entries found, without those that an exception covers."""
    if not len(automaton):
        return 0.0
    hits, covers = [], []
    for end, (size, weight) in automaton.iter(folded):
        (covers if weight is None else hits).append((end - size + 1, end, weight))
    if covers:
        covers.sort(key=lambda c: c[0])
        starts = [c[0] for c in covers]
        reach = list(itertools.accumulate((c[1] for c in covers), max))  # how far the exceptions up to here cover
        hits = [h for h in hits if not (k := bisect.bisect_right(starts, h[0])) or reach[k - 1] < h[1]]
    best: dict[int, float] = {}  # one entry a word: the heaviest
    for start, _, weight in hits:
        best[start] = max(weight, best.get(start, 0.0))
    return sum(best.values())


#: Shortest and longest word beginnings that can be entries.
BEGINNINGS = range(3, 9)
#: An entry needs this many toxic documents and this weight.
LEAST_DOCS, LEAST_WEIGHT = 4, 1.5
#: Chance that any entry at all is taken by accident; its log-likelihood ratio must be beyond that.
ACCIDENT = 0.05


def least_evidence(candidates: int) -> float:
    """The log-likelihood ratio (chi-square, one degree) that one of so many candidates exceeds by chance with ``ACCIDENT``."""
    low, high = 0.0, 200.0
    while high - low > 1e-6:
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > ACCIDENT / max(candidates, 1) else (low, middle)
    return high


def forms(word: str) -> list[str]:
    """The entries that a word can stand for: itself and its beginnings."""
    return [f" {word} ", *(" " + word[:n] for n in BEGINNINGS if len(word) >= n)]


def family(text: str | None) -> int:
    """Nearly the same for near copies: the least hash of five-word shingles."""
    w = fold(text).split()
    return min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))


def _families(rows: DataFrame) -> DataFrame:
    """One text of each family, so that copies of a document aren't taken for evidence."""

    def run(batches):
        for batch in text_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([family(t) for t in batch.column(0).to_pylist()], pa.int64())], ["text", "toxic", "family"])

    return rows.select("text", "toxic").mapInArrow(trimmed(run), "text string, toxic int, family bigint").groupBy("family", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(feature, n, times): in how many rows each feature occurs, and how often altogether."""

    def run(batches):
        known: dict[str, list[str]] = {}  # word -> its wanted forms
        for batch in text_batches(batches, "text", 1 << 19):
            seen: dict[str, list[int]] = {}
            if len(known) > 100_000:
                known.clear()
            for text in batch.column(0).to_pylist():
                found: dict[str, int] = {}
                for word, times in Counter(fold(text).split()).items():
                    own = known.get(word)
                    if own is None:
                        own = known[word] = forms(word) if wanted is None else [f for f in forms(word) if f in wanted]
                    for f in own:
                        found[f] = found.get(f, 0) + times
                for f, times in found.items():
                    at = seen.setdefault(f, [0, 0])
                    at[0] += 1
                    at[1] += times
            columns = [pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "n", "times"])

    counted = rows.select("text").mapInArrow(trimmed(run), "feature string, n bigint, times bigint")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 30_000) -> Lexicon:
    """Learn from at most about ``sample_rows`` of the rows of ``labels`` whose label isn't null."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("toxic"))
    total = marks.count()
    if not total:
        return Lexicon()
    marks = marks.where(hash_share(F.col("_id"), min(1.0, sample_rows / total)))
    sample = docs.select(docs[doc_id].alias("_id"), docs[text].alias("text")).join(F.broadcast(marks), "_id")  # broadcast: sample_rows rows
    sample = cut(_families(sample.select("text", (F.col("toxic") == 1).cast("int").alias("toxic"))))
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    sizes = {r.toxic: (r.n, r.words) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("words")).collect()}
    if 1 not in sizes:
        return Lexicon()
    first = _counts(toxic, None).where(F.col("n") >= LEAST_DOCS)  # the sample bounds them
    in_toxic = {r.feature: (r.n, r.times) for r in first.toLocalIterator()}
    in_clean = {r.feature: (r.n, r.times) for r in _counts(clean, frozenset(in_toxic)).toLocalIterator()}
    entries = _select(in_toxic, in_clean, sizes[1], sizes.get(0, (0, 0)))
    lexicon = Lexicon(entries)
    lexicon.exceptions = _exceptions(sample, lexicon)
    lexicon.curve = _curve(sample, lexicon)
    return lexicon


def _select(in_toxic: dict[str, tuple[int, int]], in_clean: dict[str, tuple[int, int]], toxic: tuple[int, int], clean: tuple[int, int]) -> dict[str, float]:
    """Weights (log ratio of the rates among all words) of the entries; the arguments hold (documents, words)."""
    entries: dict[str, float] = {}
    share = toxic[0] / (toxic[0] + clean[0])
    least = least_evidence(len(in_toxic))
    for text in sorted(in_toxic, key=lambda x: (len(x), x)):
        (t, times), (c, clean_times) = in_toxic[text], in_clean.get(text, (0, 0))
        weight = math.log((times + 0.5) / (toxic[1] + 1)) - math.log((clean_times + 0.5) / (clean[1] + 1))
        p = t / (t + c)
        evidence = 2 * (t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c and share < 1 else 0))
        if weight < LEAST_WEIGHT or evidence < least or p < share:
            continue
        body = text.rstrip(" ")
        if any(entries.get(body[: n + 1], -9) >= min(weight - 1, 5) for n in BEGINNINGS if n + 1 <= len(body)):
            continue
        entries[text] = weight
    # the most specific text that stands for (nearly) the same occurrences is the safest on new documents
    return {max((f for f in in_toxic if f.startswith(e) and in_toxic[f][1] >= 0.97 * in_toxic[e][1]), key=lambda f: (len(f), f)): w for e, w in entries.items()}


def _exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases with an entry that occur in at least three clean documents and in no toxic one."""

    def run(batches):
        automaton = lexicon.automaton()
        for batch in text_batches(batches, "text"):
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                phrases = set()
                for end, (size, _) in automaton.iter(folded) if len(automaton) else ():
                    start = end - size + 1
                    stop = folded.index(" ", start + 1)
                    after = folded.find(" ", stop + 1)
                    before = folded.rfind(" ", 0, start) if start else -1
                    if after > 0:
                        phrases.add(folded[start : after + 1])
                    if before >= 0:
                        phrases.add(folded[before : stop + 1])
                out += [(p, int(toxic == 1)) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int64())], ["phrase", "toxic"])

    seen = sample.mapInArrow(trimmed(run), "phrase string, toxic bigint").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    return [r.phrase for r in seen.where("t = 0 and c >= 3").orderBy("phrase").collect()]


def _curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression with a small ridge on the sample's (bounded) rows."""
    weighed = _weighed(sample.select("toxic", "text"), lexicon, "toxic", "toxic int").select("toxic", "weight", "words").toPandas()
    w, n, y = weighed["weight"].to_numpy(float), weighed["words"].to_numpy(float), (weighed["toxic"] == 1).to_numpy(float)
    x = np.column_stack([np.ones(len(w)), np.log1p(w), np.log1p(100 * w / np.maximum(n, 1))])
    beta = np.zeros(3)
    ridge = np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _weighed(rows: DataFrame, lexicon: Lexicon, key: str, field_: str) -> DataFrame:
    """Rows (key, text) -> (key, weight, words, score)."""

    def run(batches):
        automaton = lexicon.automaton()
        for batch in text_batches(batches, "text"):
            folded = [fold(t) for t in batch.column(1).to_pylist()]
            weights = [weigh(automaton, t) for t in folded]
            words = [max(0, t.count(" ") - 1) for t in folded]
            scores = [lexicon.score(w, n) for w, n in zip(weights, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())], [key, "weight", "words", "score"])

    return rows.mapInArrow(trimmed(run), f"{field_}, weight double, words bigint, score double")


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, weight, words, score of every whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return _weighed(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), lexicon, "doc_id", f"doc_id {kind}")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""

    def run(batches):
        automaton = lexicon.automaton()
        for batch in text_batches(batches, text):
            at = batch.schema.get_field_index(text)
            keep = []
            for t in batch.column(at).to_pylist():
                folded = fold(t)
                keep.append(lexicon.score(weigh(automaton, folded), max(0, folded.count(" ") - 1)) < limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
