import random

import numpy as np
import pyarrow as pa

from terracell.llm import partenum, textbatch

DATA = "/root/testdata/sf0.01"


def shingles(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows):
    """doc_id to (n_shingles, component) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holds = {}
    for i, s in enumerate(sets):
        for g in s:
            holds.setdefault(g, []).append(i)
    near = {(i, j) for m in holds.values() for a, i in enumerate(m) for j in m[a + 1 :]}
    for i, j in near:
        common = len(sets[i] & sets[j])
        if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
            parent[b] = a
    return {d: (len(sets[i]), rows[find(i)][0]) for i, (d, _) in enumerate(rows)}


def near_copies(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "É a b c"), (8, "é a b c")]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 4, 5, 8, 20, 60, 200]))]
        rows.append((len(rows) + 1, " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 1, rng.choice(["  ", "\n", " "]).join(copy)))
    rng.shuffle(rows)
    return rows


def family(seed=9, n=140, copies=150):
    """Copies of one text with few to many edits: a core that links and many that nearly do."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(n)]
    rows = []
    for i in range(copies):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            at = rng.randrange(len(copy))
            kind = rng.random()
            edit = [f"x{rng.randrange(10**6)}"] if kind < 0.6 else [] if kind < 0.8 else [copy[at], "y"]
            copy[at : at + rng.choice([1, 1, 9])] = edit
        rows.append((i, " ".join(copy)))
    return rows


def test_one_family_of_near_copies(spark):
    for seed in (9, 10, 11):
        rows = family(seed)
        assert run(spark, rows) == brute(rows)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_groups(df).collect()}


def test_matches_all_pairs(spark):
    rows = near_copies()
    assert run(spark, rows) == brute(rows)


def test_matches_all_pairs_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 60, 100, 333, 1000]:
        for _ in range(6):
            b = n + int(rng.integers(0, n * 15 // 85 + 1))
            least = -(-85 * (n + b) // 185)
            common = rng.integers(1, 1 << 62, least).astype(np.uint64)
            sets = [np.sort(np.concatenate([common, rng.integers(1, 1 << 62, m - least).astype(np.uint64)])) for m in (n, b)]
            sig, row = partenum.signatures(np.concatenate(sets), np.array([0, n, n + b]))
            assert set(sig[row == 0]) & set(sig[row == 1]), (n, b)


def test_words_follow_row_bounds():
    texts = pa.array(["a b", None, "", "c", " d\te ", "Éa B"])
    ((_, part),) = textbatch.slices(texts)
    w = textbatch.words(part)
    found = [(int(r), bytes(w.data[s:e]).decode()) for r, s, e in zip(w.row, w.start, w.end)]
    assert found == [(0, "a"), (0, "b"), (3, "c"), (4, "d"), (4, "e"), (5, "Éa"), (5, "b")]
