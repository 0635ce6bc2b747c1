import numpy as np
from lodestar.llm import embeddings


def brute(rows, least):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[k] = np.asarray(v, np.float32).astype(float)
    links = {k: 0 for k in range(len(rows))}
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least_of = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_of[find(k)] = min(i, least_of.get(find(k), i))
    return {i: (links[k], least_of.get(find(k))) for k, (i, _) in enumerate(rows)}


def test_matches_brute_force(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for c in range(60):
        center = rnd.standard_normal(24)
        for _ in range(int(rnd.integers(1, 8))):
            rows.append((center + rnd.standard_normal(24) * rnd.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [0.0] * 24, None, [], [float("nan")] + [1.0] * 23, [1.0, None], [1.0, 2.0], [2.0, 4.0], [x * 3 for x in rows[5]]]
    rows = [(int(i), v) for i, v in zip(rnd.permutation(len(rows)), rows, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ".replace(", ", ", ").rstrip(", "))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, 0.95).collect()}
    assert got == brute(rows, 0.95)


def test_chunks_leaves_and_empty(spark, monkeypatch):
    for name, value in (("CHUNK", 7), ("LEAF", 4), ("SHALLOW", 3), ("WIDTH", 5)):
        monkeypatch.setattr(embeddings, name, value)
    rnd = np.random.default_rng(3)
    c = rnd.standard_normal(16)
    rows = [(i, (c + 0.1 * rnd.standard_normal(16)).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows, 0.95)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_null_id_links(spark):
    v = np.eye(8)[0]
    chain = [np.cos(a) * np.eye(8)[0] + np.sin(a) * np.eye(8)[1] for a in (0.0, 0.25, 0.5)]
    rows = [(7, chain[0].tolist()), (None, chain[1].tolist()), (3, chain[2].tolist()), (9, (-v).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {7: (1, 3, False), None: (2, 3, False), 3: (1, 3, True), 9: (0, 9, True)}


def test_splits_reach_whatever_is_near():
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((400, 6))
    tree = embeddings.Splits(x[:100], 5)
    row, leaf, home = tree.leaves(x, 0.7)
    assert (np.sort(row[home]) == np.arange(400)).all()
    own = np.empty(400, int)
    own[row[home]] = leaf[home]
    visits = set(zip(row.tolist(), leaf.tolist(), strict=True))
    assert len(visits) == len(row)
    near = np.argwhere(((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.49)
    assert all((a, own[b]) in visits for a, b in near.tolist())
