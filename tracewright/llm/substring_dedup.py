"""Operator 1: exact repeated-substring dedup with suffix arrays by induced sorting.

Every byte that is covered by a ``LENGTH``-byte window which also starts earlier in the
corpus (smaller doc_id, or same document and earlier start) is removed.

1. Windows are gathered by anchors (see ``_anchors``): equal windows have equal anchors at
   equal places.  An anchor occurrence stands for about 34 windows.  Occurrences whose
   windows are all equal (same *context*) form a class; in all but its first occurrence
   every window starts earlier too.  Equal contexts inside a task are merged before the
   shuffle, so a very common passage sends one row a task.  Rows travel packed, one byte
   string for each pair of task and bucket.
2. Contexts of the same anchor that differ can still share windows.  The texts of their
   first occurrences are fetched and dealt into shards by anchor.  In a shard they are
   joined to one string, whose suffix array is built by induced sorting.  Permuted common
   prefixes of at least ``LENGTH`` tell the equal windows; all but the first are marked.
3. The marked intervals meet their texts, and the bytes they cover go.

Nulls: a null text is empty; a null doc_id is smaller than all others.  Rows that repeat
(same id and text) are one occurrence: neither makes the other a repeat.  Rows that share
only the id are ordered by a hash of their texts.  Texts shorter than a window stay as
they are.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._anchors import window_anchors
from tracewright.llm._spark import cut, give_back, shuffle_partitions, text_batches, trimmed
from tracewright.llm._suffix_array import permuted_common_prefixes, suffix_array
from tracewright.llm._words import U, mix, text_bytes

LENGTH = 100
#: Anchors held by a task before they are dealt out, and bytes joined to one string.
HOLD, SHARD_BYTES = 600_000, 1 << 20
_NO_ID = -(1 << 63)

ANCHOR = [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("first", "<u4"), ("before", "u1"), ("more", "u1")]
SPAN = [("uid", "<i8"), ("start", "<u4"), ("size", "<u4")]
WANTED = [("uid", "<i8"), ("gram", "<u8"), ("doc", "<i8"), ("first", "<u4"), ("size", "<u4")]
PIECE = [("gram", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("first", "<u4"), ("size", "<u4")]


def _pack(table: dict[str, np.ndarray], kind: list[tuple[str, str]], rows: np.ndarray) -> bytes:
    """Columns one after another, which compress better than records."""
    return len(rows).to_bytes(4, "little") + b"".join(table[name][rows].astype(t).tobytes() for name, t in kind)


def _unpack(parts: list[bytes], kind: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    columns: dict[str, list[np.ndarray]] = {name: [] for name, _ in kind}
    for part in parts:
        n, at = int.from_bytes(part[:4], "little"), 4
        for name, t in kind:
            columns[name].append(np.frombuffer(part, t, n, at))
            at += n * np.dtype(t).itemsize
    return {name: np.concatenate(columns[name]) if parts else np.zeros(0, t) for name, t in kind}


def _dealt(table: dict[str, np.ndarray], kind: list[tuple[str, str]], bucket: np.ndarray, what: int) -> list[tuple[int, int, bytes]]:
    """(bucket, what, packed rows)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(bucket) else [0]
    return [(int(bucket[order[a]]), what, _pack(table, kind, order[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "what", "packed"])


_PACKED = "bucket int, what int, packed binary"


def _by_key(key: np.ndarray, n: int, salt: int) -> np.ndarray:
    return (mix(key.view(U) + U(salt)) % U(n)).astype(np.int64)


def _of_documents(uid: np.ndarray, n: int) -> np.ndarray:
    """The buckets of documents, as in ``_documents``."""
    return np.mod(uid.astype(np.int64), n)


def _documents(full: DataFrame, parts: int) -> DataFrame:
    """Texts by bucket.  A bucket is a partition: hashed to partitions, six of 51 met in one."""
    return full.select(F.pmod("uid", F.lit(parts)).cast("int").alias("bucket"), "doc_id", "uid", "text").repartitionById(parts, F.col("bucket"))


def _firsts(a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of anchor rows: the first occurrence of each class, and the rows that come later."""
    order = np.lexsort((a["first"], a["uid"], a["doc"], a["context"], a["gram"]))
    gram, context = a["gram"][order], a["context"][order]  # both hashes tell classes apart, 128 bits
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]) if len(order) else np.zeros(0, bool)
    firsts = order[new]
    own = firsts[np.cumsum(new) - 1] if len(order) else order  # by place in order: the first of the class
    again = ~new & ~((a["uid"][order] == a["uid"][own]) & (a["first"][order] == a["first"][own]))
    return firsts, order[again]


def _spans(a: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {"uid": a["uid"][rows], "start": a["first"][rows], "size": a["more"][rows].astype(np.int64) + LENGTH}


def _take(table: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in table.items()}


def _anchor_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors (what 0, by gram) and, of classes met twice in a task, spans (what 1)."""

    def run(batches):
        held, size = [], 0

        def deal():
            a = {k: np.concatenate([h[k] for h in held]) for k, _ in ANCHOR}
            firsts, again = _firsts(a)
            found, spans = _take(a, firsts), _spans(a, again)
            return _dealt(found, ANCHOR, _by_key(found["gram"], buckets, 1), 0) + _dealt(spans, SPAN, _by_key(spans["uid"], buckets, 2), 1)

        for batch in text_batches(batches, "text", 1 << 20):
            raw, at = text_bytes(batch.column(2))
            found = window_anchors(raw, at, LENGTH)
            row = found["row"]
            held.append(
                {
                    "gram": found["gram"],
                    "context": found["context"],
                    "doc": batch.column(0).to_numpy()[row],
                    "uid": batch.column(1).to_numpy()[row],
                    "first": found["first"].astype(np.uint32),
                    "before": (found["pos"] - found["first"]).astype(np.uint8),
                    "more": (found["last"] - found["first"]).astype(np.uint8),
                }
            )
            size += len(row)
            if size >= HOLD:
                yield _batch(deal())
                held, size = [], 0
        if size:
            yield _batch(deal())

    return texts.select("doc", "uid", "text").mapInArrow(trimmed(run), _PACKED)


def _classes(dealt: DataFrame, doc_buckets: int) -> DataFrame:
    """From anchors by bucket: spans of later occurrences (what 1) and contexts to fetch (what 2), by document bucket."""

    def run(batches):
        spans: list[dict[str, np.ndarray]] = []
        wanted: list[dict[str, np.ndarray]] = []
        size, now, held = 0, None, []

        def finish():
            a = _unpack(held, ANCHOR)
            firsts, again = _firsts(a)
            spans.append(_spans(a, again))
            gram = a["gram"][firsts]
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            several = firsts[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(order) else firsts
            wanted.append({"uid": a["uid"][several], "gram": a["gram"][several], "doc": a["doc"][several], "first": a["first"][several], "size": a["more"][several].astype(np.int64) + LENGTH})
            return len(again) + len(several)

        def deal():
            out = []
            for kind, parts, what in ((SPAN, spans, 1), (WANTED, wanted, 2)):
                table = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kind}
                out += _dealt(table, kind, _of_documents(table["uid"], doc_buckets), what)
            return _batch(out)

        for batch in batches:
            for bucket, what, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if what == 1:
                    spans.append(_unpack([packed], SPAN))
                    size += len(spans[-1]["uid"])
                    continue
                if bucket != now:
                    if held:
                        size += finish()
                    now, held = bucket, []
                held.append(packed)
                if size >= HOLD:
                    yield deal()
                    spans, wanted, size = [], [], 0
        if held:
            finish()
        yield deal()

    return dealt.mapInArrow(trimmed(run), _PACKED)


def _fetch(texts: pa.Table, asked: pa.Table, shards: int) -> pa.Table:
    """Cut the wanted contexts out of the texts of one document bucket; by shard."""
    want = _unpack([p for w, p in zip(asked.column("what").to_pylist(), asked.column("packed").to_pylist()) if w == 2], WANTED)
    order = np.argsort(want["uid"], kind="stable")
    want = _take(want, order)
    pieces, rows = [], []
    seen = set()
    for batch in texts.to_batches():
        raw, at = text_bytes(batch.column("text"))
        uids = batch.column("uid").to_numpy()
        for uid, begin, a, b in zip(uids.tolist(), at.tolist(), np.searchsorted(want["uid"], uids).tolist(), np.searchsorted(want["uid"], uids, "right").tolist()):
            if a == b or uid in seen:
                continue
            seen.add(uid)
            for k in range(a, b):
                f = begin + int(want["first"][k])
                pieces.append(raw[f : f + int(want["size"][k])].tobytes())
                rows.append(k)
    got = _take(want, np.array(rows, np.int64))
    shard = _by_key(got["gram"], shards, 4)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    out = [(s, _pack(got, PIECE, order[a:b]) + b"".join([pieces[k] for k in order[a:b]])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    found = pa.table({"shard": pa.array([s for s, _ in out], pa.int32()), "packed": pa.array([p for _, p in out], pa.binary())})
    del pieces, got, out
    give_back()
    return found


def repeated_windows(pieces: list[bytes], doc: np.ndarray, uid: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with their places: runs of windows that occur earlier, as (context, start in it, bytes covered)."""
    sizes = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 0xff does not occur in UTF-8
    t = np.append(joined.astype(np.int64) + 1, 0)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    sa = suffix_array(t, 258)
    shared = permuted_common_prefixes(t, sa, 2 * length)
    own = np.repeat(np.arange(len(pieces)), sizes + 1)
    own = np.append(own, len(pieces) - 1)
    left = begin[own] + sizes[own] - np.arange(len(t))  # bytes of the context from each place on
    equal = (shared >= length) & (left >= length)  # the window is equal to that of the suffix before
    in_order = equal[sa]
    touched = in_order | np.append(in_order[1:], False)
    group = np.cumsum(~in_order)[touched]
    place = sa[touched]
    which = own[place]
    start = first[which] + place - begin[which]
    order = np.lexsort((start, uid[which], doc[which], group))
    later = np.concatenate([[False], group[order][1:] == group[order][:-1]]) if len(order) else np.zeros(0, bool)
    marked = np.sort(place[order][later])
    if not len(marked):
        return marked, marked, marked
    new = np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (own[marked[1:]] != own[marked[:-1]])])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(marked)))
    which = own[marked[at]]
    return which, marked[at] - begin[which], runs - 1 + length


def _shard_spans(pieces: DataFrame, doc_buckets: int) -> DataFrame:
    """Spans of repeated windows (what 1) by document bucket, from shards of contexts."""

    def spans_of(held):
        """A shard's contexts in runs of about SHARD_BYTES; all of one anchor stay together."""
        head, texts = [], []
        for packed in held:
            n = int.from_bytes(packed[:4], "little")
            width = 4 + n * sum(np.dtype(t).itemsize for _, t in PIECE)
            part = _unpack([packed[:width]], PIECE)
            head.append(part)
            ends = width + np.cumsum(part["size"].astype(np.int64))
            texts += [packed[e - s : e] for e, s in zip(ends.tolist(), part["size"].tolist())]
        table = {k: np.concatenate([h[k] for h in head]) for k, _ in PIECE}
        order = np.argsort(table["gram"], kind="stable")
        gram, size = table["gram"][order], table["size"][order].astype(np.int64)
        cuts, held_bytes = [0], 0
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        total = np.cumsum(size)
        for e in ends.tolist():
            if total[e - 1] - held_bytes >= SHARD_BYTES or e == len(gram):
                cuts.append(e)
                held_bytes = total[e - 1]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            rows = order[a:b]
            if len(rows) < 2:
                continue
            first = table["first"][rows].astype(np.int64)
            which, start, covered = repeated_windows([texts[r] for r in rows.tolist()], table["doc"][rows], table["uid"][rows], first)
            found.append({"uid": table["uid"][rows][which], "start": first[which] + start, "size": covered})
        return found

    def run(batches):
        now, held, spans = None, [], []
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != now:
                    if held:
                        spans += spans_of(held)
                    now, held = shard, []
                held.append(packed)
        if held:
            spans += spans_of(held)
        table = {k: np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, t) for k, t in SPAN}
        yield _batch(_dealt(table, SPAN, _of_documents(table["uid"], doc_buckets), 1))

    return pieces.mapInArrow(trimmed(run), _PACKED)


def kept_spans(n_bytes: int, start: np.ndarray, end: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """What the spans leave over, the number of bytes they cover, and the number of maximal runs."""
    if not len(start):
        return [(0, n_bytes)], 0, 0
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    a, b = start[at], reach[np.append(at[1:], len(start)) - 1]
    keep = list(zip([0, *b.tolist()], [*a.tolist(), n_bytes]))
    return [k for k in keep if k[0] < k[1]], int((b - a).sum()), len(a)


def _apply(texts: pa.Table, marked: pa.Table, texts_too: bool) -> pa.Table:
    spans = _unpack(marked.column("packed").to_pylist(), SPAN)
    order = np.argsort(spans["uid"], kind="stable")
    uid = spans["uid"][order]
    start = spans["start"][order].astype(np.int64)
    end = start + spans["size"][order]
    out = []
    for batch in texts.to_batches():
        raw, at = text_bytes(batch.column("text"))
        for own, begin, stop in zip(batch.column("uid").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            a, b = np.searchsorted(uid, own, "left"), np.searchsorted(uid, own, "right")
            keep, removed, runs = kept_spans(stop - begin, start[a:b], end[a:b])
            rest, digest = [raw[begin + x : begin + y] for x, y in keep], hashlib.sha256()
            for piece in rest:
                digest.update(piece)
            out.append((stop - begin, removed, runs, digest.hexdigest(), b"".join(rest) if texts_too else None))
    columns = {"doc_id": texts.column("doc_id")}
    for i, name in enumerate(["n_bytes", "n_removed", "n_spans"]):
        columns[name] = pa.array([o[i] for o in out], pa.int64())
    columns["kept_sha256"] = pa.array([o[3] for o in out], pa.string())
    if texts_too:
        columns["kept"] = pa.array([o[4] for o in out], pa.binary())
    del out
    give_back()
    return pa.table(columns)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``texts`` the remaining bytes."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets, shards = 4 * parts, 2 * parts
    kind = docs.schema[doc_id].dataType.simpleString()
    key = F.coalesce(docs[doc_id].cast("long"), F.lit(_NO_ID))
    full = docs.select(docs[doc_id].alias("doc_id"), key.alias("doc"), F.coalesce(docs[text], F.lit("")).alias("text"))
    full = full.withColumn("uid", F.xxhash64(F.lit(1), "doc_id", "text"))

    dealt = _anchor_rows(full, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    marked = cut(_classes(dealt, parts))  # the shuffle files of the anchors go with it

    by_document = _documents(full, parts)
    wanted = marked.where("what = 2").repartitionById(parts, F.col("bucket"))
    pieces = by_document.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(lambda t, w: _fetch(t, w, shards), "shard int, packed binary")
    pieces = pieces.repartition(parts, "shard").sortWithinPartitions("shard")
    spans = marked.where("what = 1").unionByName(_shard_spans(pieces, parts)).repartitionById(parts, F.col("bucket"))
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    return by_document.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(lambda t, m: _apply(t, m, texts), schema)
