import random

import pytest

from terracell.llm import piece_nbest as p


@pytest.fixture(scope="module")
def v():
    return p.load()


def every(v, text):
    """All segmentations of a marked text, best first."""
    edges = p.edges_from(v, text)

    def go(i):
        if i == len(text):
            yield 0.0, ()
            return
        for j, s, ids in edges[i]:
            for t, rest in go(j):
                yield s + t, ids + rest

    return sorted(go(0), key=lambda f: (-round(f[0], 9), f[1]))


def test_n_best_of_units(v):
    rng = random.Random(1)
    for _ in range(60):
        unit = p.marked("".join(rng.choice("theraionüé") for _ in range(rng.randint(1, 9))))
        want = every(v, unit)
        assert [round(s, 9) for s, _ in p.n_best(v, unit, 6)] == [round(s, 9) for s, _ in want[:6]]
        best, ids, gap = p.viterbi(v, unit)
        assert best == pytest.approx(want[0][0]) and (len(want) == 1 or best - gap == pytest.approx(want[1][0]))


def test_n_best_of_texts(v):
    rng = random.Random(2)
    for _ in range(25):
        text = " ".join("".join(rng.choice("thera") for _ in range(rng.randint(1, 4))) for _ in range(3))
        want, got = every(v, p.marked(text)), p.encode(v, text, 4)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want[:4]]
        assert all(p.decode(v, ids) == text for _, ids in got)


@pytest.mark.parametrize("text", ["", " ", "a  b\n c ", "▁xm▁", "", "日本🙂\x00\t", "é" * 50, "ń"])
def test_round_trip(v, text):
    for _, ids in p.encode(v, text, 4):
        assert p.decode(v, ids) == text if text else ids == []


def test_column(spark, v):
    df = spark.createDataFrame([(1, "the cat"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r._pieces for r in p.tokenise(df).collect()}
    assert rows[1].ids == p.encode(v, "the cat")[0][1] and rows[1].exact and len(rows[1].scores) == 4
    assert rows[2].ids == [] and rows[3].ids == [] and rows[3].exact


def test_slices_match_single_texts(spark, v):
    import pyarrow as pa

    from terracell.llm import textbatch

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(40).collect()]
    texts = [None, "", " ", "\n\n a", "▁ odd", "日本 ńń x", "y" * 90, "a\tb", *docs, "", "é"]
    many = p.Lattices(v)
    for _ in range(2):  # the second time from the store
        ((_, part),) = textbatch.slices(pa.array(texts, pa.large_string()), 1 << 24)
        for text, got in zip(texts, many.encode_slice(part, 4).to_pylist()):
            want = p.encode(v, text, 4)
            assert got["ids"] == want[0][1] and got["exact"]
            assert got["scores"] == pytest.approx([s for s, _ in want])
