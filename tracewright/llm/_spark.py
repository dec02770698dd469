"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which ``components`` gives up with an error; they are about the logarithm of the longest chain.
MOST_ROUNDS = 60
#: Edges that a task holds at a time when it replaces them by stars.
CHUNK_EDGES = 1 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # numbers of mallopt
#: Functions whose results a worker keeps.
_KEEPERS: list[Callable] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) gets a temporary folder:
    on a cluster a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewright-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def released(spark: SparkSession):
    """Inside, the shuffle files of an execution go as soon as it ends (its result is on shared disk by then)."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.checkpoint(eager=True)


class Shelf:
    """Intermediate tables in the shared folder; they go when they are dropped or the shelf is closed.

    Nothing that is evaluated later may read them: a result is ``cut`` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{ensure_checkpoint_dir(spark)}/shelf-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, hashes: tuple[str, ...] = ()) -> DataFrame:
        """hashes: columns without repeats, for which Parquet need not look for any."""
        path = f"{self.folder}/{len(self.paths)}.parquet"
        with released(self.spark):
            df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for k, (table, path) in list(self.paths.items()):
            if path and any(table is t for t in tables):
                self._delete(path)
                self.paths[k] = (None, "")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.folder)


def give_back() -> None:
    """Give the memory back that this process has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library keeps what is freed
        trim(0)


def keep_freed() -> None:
    """From now on arrays of some MB are taken from what this process has freed, and not mapped and faulted in anew each time."""
    if limit := getattr(ctypes.CDLL(None), "mallopt", None):
        limit(_MMAP_THRESHOLD, 32 << 20)  # the most that the GNU library takes
        limit(_TRIM_THRESHOLD, 64 << 20)


def shrink_heaps(spark: SparkSession) -> None:
    """Let every executor's JVM collect its garbage, upon which it gives back the heap it does not use; Python workers need the memory too."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def keeper(cached: Callable) -> Callable:
    """Mark a function with ``cache_clear`` whose results a worker keeps for later tasks of the same operator."""
    _KEEPERS.append(cached)
    return cached


def forget_others(uses: Callable | None) -> None:
    """Let go of what this worker keeps for tasks of other operators."""
    for cached in _KEEPERS:
        if cached is not uses and cached.cache_info().currsize:
            cached.cache_clear()
            give_back()


def trimmed(run: Callable, keep: bool = False, uses: Callable | None = None) -> Callable:
    """``run`` for mapInArrow; when a task ends, its worker, which waits for others, gives the memory back that it does not use.

    keep: until then it keeps what it frees (see ``keep_freed``).  uses: the ``keeper`` that run reads; others' results go.
    """

    def wrapped(batches):
        forget_others(uses)
        if keep:
            keep_freed()
        yield from run(batches)
        give_back()

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_share(key, share: float):
    """Condition that holds for about ``share`` of the distinct keys, the same ones on every run."""
    return F.shiftrightunsigned(F.xxhash64(key), 33) < F.lit(int(share * (1 << 31)))


def text_batches(batches, text: str, limit: int = 4 << 20):
    """Slice Arrow batches so that a slice holds about ``limit`` text bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones connect: each node but the smallest, with the smallest of its component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v, changed) of (u, v, changed): each task's edges as stars, CHUNK_EDGES at a time; a hub costs a row a task."""

    def run(batches):
        held, size = [], 0

        def flush():
            u, v, changed = (np.concatenate([h[i] for h in held]) for i in range(3))
            child, root = stars(u, v)
            return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64()), pa.array(np.full(len(child), changed.any()))], ["u", "v", "changed"])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= CHUNK_EDGES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return edges.mapInArrow(trimmed(run), "u bigint, v bigint, changed boolean")


def components(*edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (src, dst) between bigint nodes: rows (node, component_id).

    component_id is the smallest node of the component; only nodes that occur in
    an edge between two different nodes are returned.  In a round a node with several
    smaller neighbours links them to the smallest, every edge moves on to the parent of its
    lower end, and each task replaces its edges by stars; the number of edges never grows.
    A node's neighbours meet as a set of at most one for each task that made
    stars; the edges of a hub are only read in a join, whose large partitions Spark splits.
    """
    with Shelf(edges[0].sparkSession) as shelf:
        # one after another, so that the shuffle files of one are gone when the next is made
        parts = [shelf.put(_contracted(e.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), F.lit(False).alias("changed")).where("u <> v"))) for e in edges]
        now = functools.reduce(DataFrame.unionByName, parts)
        for _ in range(MOST_ROUNDS):
            near = now.groupBy("u").agg(F.collect_set("v").alias("vs")).withColumn("m", F.array_min("vs"))
            parents = near.select(F.col("u").alias("own"), F.col("m").alias("above"))
            several = F.size("vs") > 1
            linked = near.select("m", several.alias("several"), F.explode(F.transform("vs", lambda v: F.when(v == F.col("m"), F.col("u")).otherwise(v))).alias("x"))
            moved = linked.join(parents, F.col("m") == F.col("own"), "left")
            new = shelf.put(_contracted(moved.select(F.col("x").alias("u"), F.coalesce("above", "m").alias("v"), (F.col("several") | F.col("above").isNotNull()).alias("changed"))))
            shelf.drop(*parts)
            now, parts = new, [new]
            if not now.agg(F.max("changed")).first()[0]:
                found = now.select("u", "v").distinct()
                return cut(found.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()))
    raise RuntimeError("components did not settle")
