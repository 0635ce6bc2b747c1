import hashlib

import numpy as np
import pytest
from lodestar.llm import codes, fixedpoint

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = -(-longest // parts)
    x = {k: [int(np.floor(256 * c)) for c in v] + [0] * (width * parts - len(v)) for k, (_, v, _) in enumerate(kept)}
    first = sorted(x, key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[x[k][p * width : (p + 1) * width] for k in first] for p in range(parts)]

    def nearest(v, p):
        own = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for v in x.values():
                held[nearest(v, p)[1]].append(v[p * width : (p + 1) * width])
            new.append([[sum(c) // len(own) for c in zip(*own, strict=True)] if own else e for own, e in zip(held, books[p], strict=True)])
        books = new
    out = []
    for k, (i, _, lab) in enumerate(kept):
        far = [nearest(x[k], p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in far), sum(d for d, _ in far), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab]) for i, c, e, lab in out), key=repr), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("parts,entries,dim", [(4, 8, 12), (4, 5, 10), (16, 64, 16)])
def test_matches_plain_version(spark, monkeypatch, parts, entries, dim):
    monkeypatch.setattr(fixedpoint, "BLOCK_BYTES", 700)
    monkeypatch.setattr(codes, "FAN", 2)
    rnd = np.random.default_rng(dim)
    rows = [(int(i), rnd.standard_normal(dim).round(2).tolist(), int(i) % 3 or None) for i in rnd.permutation(150)]
    rows += rows[:30] * 2 + [(500, None, 1), (501, [None] * dim, 1), (502, [float("nan")] * dim, 1), (None, rows[0][1], 1), (3, [0.0] * dim, None), (7, [-600_000.0] + [1.0] * (dim - 2), 2)]
    held = [(i, None if v is None else [c if c is None else max(c, -fixedpoint.MOST / 256) for c in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    books = codes.train(df, parts=parts, entries=entries)
    got = codes.with_group_errors(codes.encode(df, books), "label").collect()
    want, sha = plain(held, parts, entries, codes.ROUNDS)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert codes.digest(books) == sha


def test_decode_gives_the_coded_vector(spark):
    rows = [(i, [float(i), -float(i), i / 2, 0.5], 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = codes.train(df, parts=2, entries=40, rounds=1)
    got = codes.encode(df, books).collect()
    assert all(((codes.decode(r.code, books) - np.floor(np.array(r.embedding) * 256)) ** 2).sum() == r.error for r in got)
    assert sum(r.error for r in got) == 0  # as many entries as vectors


def test_results_do_not_depend_on_partitions(spark):
    rnd = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rnd.standard_normal(8).tolist(), 0) for i in range(400)], SCHEMA)
    assert (codes.train(df.repartition(1), parts=4, entries=9) == codes.train(df.repartition(13), parts=4, entries=9)).all()


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], SCHEMA)
    books = codes.train(df)
    assert codes.encode(df, books).count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5)], SCHEMA).selectExpr("*", "'theirs' AS code", "'theirs' AS error", "'theirs' AS label_error", "'x' AS total")
    got = codes.with_group_errors(codes.encode(df, codes.train(df, parts=2)), "label").first()
    assert (got.code, got.error, got.label_error, got.total) == ("0000", 0, 0, "x")
