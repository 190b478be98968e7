"""Components and greedy suppression of chains longer than any number of rounds."""

import pytest

from cadenza.operators import greedy
from cadenza.operators.graph import connected_components


@pytest.mark.parametrize("step", [1, -1])
def test_a_long_chain_is_one_component(spark, step):
    chain = list(range(1, 1001))[::step]
    edges = list(zip(chain, chain[1:])) + [(2000, 2001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in chain} | {2000: 2000, 2001: 2000}


def test_unfinished_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_a_long_chain_of_conflicts_is_walked_to_its_end(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 1001)], "better long, worse long")
    assert {r.id for r in greedy.suppress(df).collect()} == set(range(2, 1002, 2))
    short = df.where("better < 30")
    assert {r.id for r in greedy.suppress(short, walk=0).collect()} == set(range(2, 31, 2))  # rounds only


def test_cycles_are_an_error_and_odd_pairs_are_ignored(spark):
    rows = [(1, 2), (3, 3), (None, 1), (2, None)]
    assert [r.id for r in greedy.suppress(spark.createDataFrame(rows, "better long, worse long")).collect()] == [2]
    for rounds in (0, 12):
        with pytest.raises(Exception, match="cycle"):
            greedy.suppress(spark.createDataFrame([(1, 2), (2, 1)], "better long, worse long"), rounds=rounds).collect()
