import random

import pytest

from tests.llm.conftest import Groups
from tracewright.llm._spark import components


@pytest.mark.parametrize("seed", range(2))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(900 + i, 901 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7)]
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    expected = {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len(expected) and {r.node: r.component_id for r in got} == expected


def test_none(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []
