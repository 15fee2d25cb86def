"""Members of large stars are taken once each; sizes are read without their sets."""

import re

import pytest

from terracell.llm import partenum
from terracell.llm.shared import materialise
from tests.llm.test_partenum import brute, family, run


def recorded(monkeypatch):
    rows, plans = {}, {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        rows[label] = (out := materialise(df, label)).count()
        return out

    monkeypatch.setattr(partenum, "materialise", kept)
    return rows, plans


def test_a_member_of_many_stars_is_taken_once(spark, monkeypatch):
    monkeypatch.setattr(partenum, "DIRECT", 2)
    rows, _ = recorded(monkeypatch)
    sets = {c: [*range(c, 100), *range(1000 * c, 1000 * c + c)] for c in range(1, 9)}
    sets[9] = [*sets[8][:-1], 77777]
    live = spark.createDataFrame([(star, c) for star in (101, 102, 103) for c in sets], "a long, b long")
    found = spark.createDataFrame([(2, 1), (3, 1), (102, 101)], "node long, root long")
    table = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>")
    got = {(r.a, r.b) for r in partenum.remaining(live, found, table, 85).collect()}
    root = lambda c: 1 if c < 4 else c
    common = lambda a, b: len({*sets[a]} & {*sets[b]})
    near = {(a, b) for a in sets for b in sets if a < b and root(a) != root(b) and 100 * common(a, b) >= 85 * (len(sets[a]) + len(sets[b]) - common(a, b))}
    assert near and near <= got
    assert rows["jaccard-apart"] == len(sets)


def test_no_member_leaves_no_pair(spark):
    live = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "node long, root long")
    assert partenum.remaining(live, found, spark.createDataFrame([], "cls long, shingles array<long>"), 85).isEmpty()


@pytest.mark.parametrize("seed", [9, 21])
def test_families_without_lists_of_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(partenum, "DIRECT", 1)
    monkeypatch.setattr(partenum, "CENTERS", 1)
    rows = family(seed)
    assert run(spark, rows) == brute(rows)


def test_sketches_are_compared_without_reading_sets(spark, monkeypatch):
    _, plans = recorded(monkeypatch)
    table = spark.createDataFrame([(c, 3, b"\0" * partenum.SKETCH, [1, 2, 3]) for c in (1, 2)], "cls long, size long, sketch binary, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in partenum.verify(pairs, materialise(table, "sets"), 85).collect()] == [(1, 2)]
    read = re.findall(r"ReadSchema: struct<(\S*)>", plans["jaccard-near"])
    assert "sketch:binary" in str(read) and "shingles" not in str(read)
