"""Every registered query that has SQL gives what DuckDB gives on the driver's smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracewright.plans import log_queries  # noqa: F401
from tracewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _shown(row):
    return tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)  # repr: a decimal is no float


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(_shown([r[c] for c in columns]) for r in df.collect()) == sorted(map(_shown, expected))


def test_clusters_of_all_user_turns(spark, con):
    from pyspark.sql import functions as F

    from tracewright.functions import text as tx

    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'")
    keyed = turns.select("conv_id", "turn", "text", tx.prompt_key(F.col("text")).alias("norm")).collect()
    expected = {}
    for r in sorted(keyed, key=lambda r: (r.conv_id, r.turn)):
        n, sample = expected.get(r.norm, (0, r.text[:200]))
        expected[r.norm] = n + 1, sample
    got = {r.norm: (r.prompts, r.sample) for r in QUERIES["template_clusters"](spark, SF).collect()}
    assert got == expected
    assert sum(n for n, _ in got.values()) == con.execute("SELECT count(*) FROM conversations WHERE role = 'user'").fetchone()[0]
    assert any(not r.text.isascii() for r in keyed)


def test_entry(spark):
    assert entry.entry(spark).columns == ["gram", "sessions", "occurrences", "score"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_without_the_optional_part(monkeypatch):
    """A module that is there but cannot be imported counts as absent."""
    import builtins
    import sys

    whole = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("tracewright.llm"):
            raise ImportError(name)
        return whole(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith(("tracewright.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tracewright.llm.queries", None)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
