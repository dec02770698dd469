"""Operator 6: near-duplicate embeddings by an epsilon grid order join.

For unit vectors cosine >= c means Euclidean distance <= eps = sqrt(2 - 2c).  Projected on
orthonormal axes distances only shrink, so vectors are laid on a grid of cell width eps
along the ``AXES`` leading principal axes and sorted by cell (the epsilon grid order).
Sequences of ``SEQUENCE`` vectors in that order are intervals; two intervals are joined only
if their bounding boxes, along all axes, are at most eps apart.  Pairs of intervals are
found by a join on the cells of the first axis that each covers (intervals are short runs
of the order, so most cover one), and each pair is a task of its own: it recursively halves
both sequences, drops halves whose boxes are provably distant, and compares what is left
in double precision.  A task returns the number of links of each vector and the links
that connect them, so its output is linear in its vectors.

Equal vectors (of one label) are one class: a class of n copies has n - 1 links each.  The
principal axes are fitted on a bounded sample of ``SAMPLE`` vectors; any axes give the
same result, only with other speed.

Null labels, null vectors, zero vectors and vectors with null or non-finite components
link with nothing.  Vectors of different lengths link with nothing.  Rows that share a
vec_id count as different vectors.  Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._blocks import Forest
from tracewright.llm._spark import components, cut, shuffle_partitions

AXES, SEQUENCE, LEAF, SAMPLE = 8, 512, 64, 4000
#: Boxes are widened by this much, so rounding cannot lose a pair.
SLACK = 1e-9


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of valid vectors as doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def valid_vectors(rows: DataFrame, label: str, embedding: str) -> DataFrame:
    """node (one a class of equal vectors and labels), label, v, copies, least vec_id."""
    v = F.col(embedding).cast("array<double>")
    fine = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.col(label).alias("label"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


def principal_axes(classes: DataFrame, n: int, dims: int) -> np.ndarray:
    """dims x AXES, orthonormal; from a sample by a hash of the class."""
    share = min(1.0, SAMPLE / max(n, 1))
    rows = classes.where((F.size("v") == dims) & (F.shiftrightunsigned(F.xxhash64(F.lit(6), "node"), 33) < F.lit(int(share * (1 << 31))))).select("v").limit(2 * SAMPLE).toPandas()
    if not len(rows):
        return np.eye(dims)[:, : min(AXES, dims)]
    x = np.array(rows["v"].tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1][:, : min(AXES, dims)])


def _boxes_near(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether points in the boxes of two sets of projections can be eps apart."""
    gap = np.maximum(0.0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) <= eps * eps + SLACK


def sequence_join(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray, same: bool, cosine: float, found) -> None:
    """Call found(i, j) with index arrays of the links between two sequences of unit vectors x, y with projections p, q."""
    eps = math.sqrt(2 - 2 * cosine)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        if a == b or c == d or not _boxes_near(p[a:b], q[c:d], eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                found(i, j)
            continue
        m, n = (a + b) // 2 if b - a > 1 else b, (c + d) // 2 if d - c > 1 else d
        if same and (a, b) == (c, d):
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        else:
            todo += [(e, f, g, h) for e, f in ((a, m), (m, b)) for g, h in ((c, n), (n, d))]


def links(rows: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (node, label, copies, least), link counts (node, n_links to other classes' copies), connecting links (src, dst)."""
    spark = rows.sparkSession
    valid = valid_vectors(rows.select(rows[vec_id].alias("vec_id"), rows[embedding].alias(embedding), rows[label].alias(label)), label, embedding)
    key = F.xxhash64("label", F.size("v"), "v")
    classes = valid.groupBy(key.alias("node"), "label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = cut(classes)
    counts, ties = [], []
    lengths = [r.dims for r in classes.groupBy(F.size("v").alias("dims")).count().collect()]  # as many rows as there are vector lengths
    for dims in sorted(lengths):
        own = classes.where(F.size("v") == dims)
        linked = cut(_links_of_length(own, own.count(), dims, cosine, shuffle_partitions(spark)))
        counts.append(linked.where("dst is null").select("src", "n"))
        ties.append(linked.where("dst is not null").select("src", "dst"))
    if not counts:
        empty = spark.createDataFrame([], "src bigint, dst bigint, n bigint")
        return classes, empty.select(F.col("src").alias("node"), F.col("n").alias("n_links")), empty.select("src", "dst")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return classes, union(counts).groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n_links")), union(ties)


def _links_of_length(classes: DataFrame, n: int, dims: int, cosine: float, parts: int) -> DataFrame:
    """(src, null, n): links found for a class; (src, dst, null): connecting links."""
    axes = principal_axes(classes, n, dims)
    eps = math.sqrt(2 - 2 * cosine)
    kind = classes.schema["label"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            x = _vectors(batch.column(3), dims)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            p = x @ axes
            cells = np.floor(p / eps).astype(np.int32)
            flat = lambda m, t: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), flat(cells, pa.int32()), flat(p, pa.float64()), flat(x, pa.float64())], ["node", "label", "copies", "cells", "p", "x"])

    laid = classes.select("node", "label", "copies", "v").mapInArrow(project, f"node bigint, label {kind}, copies bigint, cells array<int>, p array<double>, x array<double>")

    def cut_sequences(batches):
        """Number the sequences of one range of the order; a sequence has one label and at most SEQUENCE vectors."""
        label, size, serial = None, 0, -1
        for batch in batches:
            ids = []
            for own, part in zip(batch.column(1).to_pylist(), batch.column(6).to_pylist()):
                if serial < 0 or own != label or size >= SEQUENCE:
                    label, size, serial = own, 0, serial + 1
                size += 1
                ids.append(part << 32 | serial)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ids, pa.int64())], [*batch.schema.names[:6], "sequence"])

    order = ["label", "cells", "node"]
    ranges = max(1, min(parts, n // SEQUENCE))
    laid = laid.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    laid = cut(laid.mapInArrow(cut_sequences, f"node bigint, label {kind}, copies bigint, cells array<int>, p array<double>, x array<double>, sequence bigint"))

    # bounding box and cells on the first axis of every sequence; pairs whose boxes are near
    low = F.array(*[F.min(F.col("p")[i]) for i in range(axes.shape[1])])
    high = F.array(*[F.max(F.col("p")[i]) for i in range(axes.shape[1])])
    boxes = laid.groupBy("sequence", "label").agg(low.alias("low"), high.alias("high"), F.min(F.col("cells")[0]).alias("from"), F.max(F.col("cells")[0]).alias("to"))
    one = boxes.select("label", F.col("sequence").alias("one"), "low", "high", F.explode(F.sequence("from", "to")).alias("cell"))
    two = boxes.select("label", F.col("sequence").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell"))
    gap = F.transform(F.arrays_zip("low", "high", "low2", "high2"), lambda z: F.greatest(F.lit(0.0), z["low"] - z["high2"], z["low2"] - z["high"]))
    pairs = one.join(two, ["label", "cell"]).where("one <= two").where(F.aggregate(F.transform(gap, lambda g: g * g), F.lit(0.0), lambda s, g: s + g) <= eps * eps + SLACK)
    pairs = cut(pairs.select("one", "two").distinct())
    sides = pairs.select("one", "two", F.col("one").alias("sequence")).unionByName(pairs.where("one < two").select("one", "two", F.col("two").alias("sequence")))
    tasks = sides.join(laid.select("sequence", "node", "copies", "p", "x"), "sequence")
    tasks = tasks.repartition("one", "two").sortWithinPartitions("one", "two", "sequence").select("one", "two", "sequence", "node", "copies", "p", "x")

    def join(batches):
        for (one, two), parts_ in _groups(batches):
            yield _join_pair(one, two, parts_, dims, axes.shape[1], cosine)

    return tasks.mapInArrow(join, "src bigint, dst bigint, n bigint")


def _groups(batches):
    """((one, two), batches of that pair) from sorted batches."""
    key, held = None, []
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if (a[s], b[s]) != key:
                if held:
                    yield key, held
                key, held = (a[s], b[s]), []
            held.append(batch.slice(s, e - s))
    if held:
        yield key, held


def _join_pair(one: int, two: int, parts: list[pa.RecordBatch], dims: int, n_axes: int, cosine: float) -> pa.RecordBatch:
    column = lambda i: pa.chunked_array([b.column(i) for b in parts]).combine_chunks()
    sequence, node, copies = (column(i).to_numpy() for i in (2, 3, 4))
    p, x = _vectors(column(5), n_axes), _vectors(column(6), dims)
    left = np.flatnonzero(sequence == one)
    right = np.flatnonzero(sequence == two)
    same = one == two
    linked = np.zeros(len(node), np.int64)
    forest, ties = Forest(len(node)), []

    def found(i, j):
        i, j = left[i], right[j]
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.join(a, b):
                ties.append((a, b))

    sequence_join(x[left], p[left], x[right], p[right], same, cosine, found)
    some = np.flatnonzero(linked)
    src = np.concatenate([node[some], node[[t[0] for t in ties]]]) if ties else node[some]
    dst = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[[t[1] for t in ties]] if ties else [], pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), dst, pa.concat_arrays([pa.array(linked[some], pa.int64()), pa.nulls(len(ties), pa.int64())])], ["src", "dst", "n"])


def near_duplicates(rows: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable by links), kept; one row for each input row."""
    classes, counts, ties = links(rows, cosine, vec_id, embedding, label)
    found = components(ties)
    named = classes.select("node", "copies", "least").join(found, "node", "left").withColumn("component", F.coalesce("component_id", "node"))
    named = named.join(counts, "node", "left").select("node", "component", "least", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    named = cut(named)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("node", "n_links", "component_id")
    base = rows.select(rows[vec_id].alias("vec_id"), rows[embedding].alias(embedding), rows[label].alias(label))
    v = F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))
    keyed = base.select("vec_id", F.xxhash64(label, F.size(v), v).alias("node"), F.col(label).isNotNull().alias("labelled"))
    out = keyed.join(named, (keyed["node"] == named["node"]) & F.col("labelled"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
