import numpy as np

from terracell.llm import embed_join


def brute(rows, cosine=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = dict.fromkeys(parent, 0)
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (n[i], find(i), find(i) == i) for i in parent}


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_join.near_duplicates(df).collect()}


def sample(n=260, d=64, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.standard_normal(d)
        for _ in range(rng.integers(1, 4)):
            noisy = base + rng.standard_normal(d) * rng.choice([0, 0.1, 0.2, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in noisy * rng.choice([1, 1e-3, 50])]))
    return rows


def test_matches_all_pairs(spark):
    rows = sample()
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0], [1.0, 2.1], [3.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    assert run(spark, rows) == brute(rows)


def test_hot_cells_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    rows = [(i, [float(np.float32(x)) for x in base + rng.standard_normal(64) * 0.18]) for i in range(150)]
    monkeypatch.setattr(embed_join, "CHUNK", 40)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == {}
