"""Members that stars leave apart, by pairs of small stars and by elements of large ones."""

import pytest

from terracell.llm import partenum
from terracell.llm.shared import materialise


@pytest.mark.parametrize("direct", [partenum.DIRECT, 2])
def test_small_stars_are_listed_without_elements(spark, monkeypatch, direct):
    base = list(range(100))
    sets = {c: sorted({*base[c:], *range(1000 * c, 1000 * c + c)}) for c in range(1, 9)}
    sets[9] = [*sets[8][:-1], 77777]
    rows = {}

    def kept(df, label):
        rows[label] = (out := materialise(df, label)).count()
        return out

    monkeypatch.setattr(partenum, "DIRECT", direct)
    monkeypatch.setattr(partenum, "materialise", kept)
    live = spark.createDataFrame([(1, c) for c in sets], "a long, b long")
    found = spark.createDataFrame([(2, 1), (3, 1)], "node long, root long")
    table = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>")
    got = {(r.a, r.b) for r in partenum.remaining(live, found, table, 85).collect()}
    root = lambda c: 1 if c < 4 else c
    common = lambda a, b: len({*sets[a]} & {*sets[b]})
    near = {(a, b) for a in sets for b in sets if a < b and root(a) != root(b) and 100 * common(a, b) >= 85 * (len(sets[a]) + len(sets[b]) - common(a, b))}
    assert near and near <= got and all(root(a) != root(b) for a, b in got)
    assert (rows["jaccard-tokens"] == 0) == (direct > len(sets))
