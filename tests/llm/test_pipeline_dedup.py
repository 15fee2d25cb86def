"""The near-copy stage of the pipeline against all pairs, five words and a similarity of 0.8."""

import corpus_pipeline
from tests.llm.test_partenum import DATA, family, near_copies, shingles


def least_of_groups(rows, n=5, percent=80):
    """The least doc_id of each group, by comparing all pairs that share a shingle."""
    sets, parent, holds = [shingles(t, n) for _, t in rows], list(range(len(rows))), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for g in s:
            holds.setdefault(g, []).append(i)
    for i, j in {(i, j) for m in holds.values() for a, i in enumerate(m) for j in m[a + 1 :]}:
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
            parent[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def kept(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.jaccard_dedup(spark, df, DATA).collect())


def test_a_copy_between_the_two_thresholds_goes(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "other", *base[31:]]  # 51 of 61 shingles of five words: 0.836
    assert kept(spark, [(1, " ".join(base)), (2, " ".join(near))]) == [1]


def test_families_match_all_pairs(spark):
    for rows in (near_copies(), family(9), family(10)):
        assert kept(spark, rows) == sorted(least_of_groups(rows))


def test_documents_match_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = kept(spark, rows)
    assert found == sorted(least_of_groups(rows)) and not {255, 875, 944} & set(found)


def test_repeated_ids_go_by_their_own_text(spark):
    far = " ".join(f"x{i}" for i in range(40))
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:30], "other", *base[31:]])
    base = " ".join(base)
    rows = [(1, base), (2, near), (2, far), (3, "one text of its own"), (3, "quite another text here"), (3, "one text of its own"), (4, base), (4, near), (5, None), (5, ""), (5, "words of a fifth text"), (None, base)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.jaccard_dedup(spark, df, DATA)
    got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    assert out.columns == df.columns
    assert got == sorted([(0, base), (1, base), (2, far), (3, "one text of its own"), (3, "quite another text here"), (5, ""), (5, "words of a fifth text")])
