"""Confirming links inside candidate groups without all pairs of a group in one task."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm._spark import text_batches, trimmed


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def block_links(nodes: list, items: list, left: list[bool], right: list[bool], similar: Callable, likely: Callable) -> list[tuple]:
    """Links that connect, between an item of the left block and one of the right block (which may be the same).

    ``likely(items)`` gives a function from y to a mask over the items that can be similar to
    item y; pairs that it leaves out, and pairs that are connected already, are not compared.
    """
    n, out = len(nodes), []
    left, right = np.array(left, bool), np.array(right, bool)
    label, can = np.arange(n), likely(items)
    for y in range(1, n):
        facing = (right[:y] if left[y] else False) | (left[:y] if right[y] else False)
        for x in np.flatnonzero(facing & can(y)[:y]).tolist():
            if label[x] != label[y] and similar(items[x], items[y]):
                label[label == label[x]] = label[y]
                out.append((nodes[x], nodes[y]))
    return out


class Block(NamedTuple):
    """The items of a pair of blocks of a group, and to which of the two each belongs."""

    nodes: list
    items: list
    left: list[bool]
    right: list[bool]


def in_blocks(groups: DataFrame, size: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """(node, group) -> also block and blocks: a group is cut into blocks of about ``size`` nodes, and ``heaviest`` weight, by a hash."""
    share = F.count("*") / size
    if weight is not None:
        share = F.greatest(share, F.sum(weight) / heaviest)
    sizes = groups.groupBy("group").agg(F.ceil(share).cast("int").alias("blocks"))
    return groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64(F.lit(4), "node"), F.col("blocks")).cast("int"))


def confirmed_links(rows: DataFrame, prepare: Callable, links: Callable, together: int = 0) -> DataFrame:
    """(src, dst): links that connect all items of a group that are similar, directly or by others.

    rows: (node bigint, group, blocks, block, text) and what ``prepare`` reads, one for each node.  Each pair of
    blocks of a group is a task of its own, so a task holds two blocks at most, or
    several smaller groups of ``together`` characters in all.  ``prepare`` makes comparable items of
    an Arrow batch of rows (an item may be None); ``links`` takes a list of ``Block`` to links.
    """
    own = [c for c in rows.columns if c not in ("node", "group", "blocks", "block", "text")]
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "block", "text", *own)
    rows = rows.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two", "node")

    def run(batches):
        key, nodes, blocks, items, held, size = None, [], [], [], [], 0

        def close():
            if len(nodes) > 1:
                held.append(Block(nodes, items, [b == key[1] for b in blocks], [b == key[2] for b in blocks]))

        def flush():
            out = links(held) if held else []
            held.clear()
            return out

        def rows_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["src", "dst"])

        for batch in text_batches(batches, "text", 1 << 18):
            out = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for group, one, two, node, block, item, length in zip(*columns, prepare(batch), pc.utf8_length(batch.column(5)).to_pylist()):
                if key != (group, one, two):
                    close()
                    if size >= together:
                        out += flush()
                        size = 0
                    key, nodes, blocks, items = (group, one, two), [], [], []
                if item is not None and not (nodes and nodes[-1] == node):
                    nodes.append(node)
                    blocks.append(block)
                    items.append(item)
                    size += length
            yield rows_of(out)
        if key:
            close()
        yield rows_of(flush())

    return rows.mapInArrow(trimmed(run), "src bigint, dst bigint")
