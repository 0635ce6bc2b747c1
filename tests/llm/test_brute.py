"""Brute-force versions and edge cases of mixing, SimHash, language ID and decontamination."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from lodestar.llm import components, decontaminate, langid, mixing, simhash
from lodestar.llm.textnp import Words, batches_of


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(sh))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rnd = random.Random(1)
    base = [[f"Wörd{rnd.randrange(500)}" for _ in range(rnd.randint(1, 90))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (7, rows[7][1])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fp = {i: plain_fingerprint(t) for i, t in rows}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])


def test_simhash_forest_finds_all_links():
    rnd = np.random.default_rng(3)
    center = rnd.integers(0, 1 << 62, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rnd.integers(0, 64, 40).astype(np.uint64)) for c in center]))
    table = simhash.pivots()
    fp = fp[np.argsort(np.bitwise_count(fp ^ table[0]), kind="stable")]
    child, root = simhash.forest(np.zeros(len(fp)), fp, 3, table)
    got = groups(range(len(fp)), zip(child.tolist(), root.tolist(), strict=True))
    want = groups(range(len(fp)), [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 3])
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, k) for k in range(6, 40)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 300)), rnd.choice(["a", "b", "c", "c", "c", None])) for i in range(400)] + [(900, None, "b"), (901, "x y", "empty"), (None, "z", "a"), (3, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(mixing.mix(df.repartition(7)).collect(), key=repr)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(k for k in size if k is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, level = 1.5 * sum(size.values()), None
    full = set()
    while True:
        level = (budget - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if 2 * size[s] < weight[s] * level}
        if more == full:
            break
        full = more
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows if i != 3 or s != "a"}
    for r in got:
        s = "a" if r.doc_id is None or (r.doc_id == 3 and r.size == 1) else source[r.doc_id]
        assert r.taken <= 2 * r.size and r.source_size == size[s]
        assert r.target == pytest.approx(min(2 * size[s], weight[s] * level))
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - min(2 * size[s], weight[s] * level)) <= max(3, 0.01 * size[s])


def test_mixing_goes_on_past_long_documents(spark):
    """A document that doesn't fit is passed over: sources of many short and two very long documents still meet their targets."""
    rnd = random.Random(5)
    rows = [(1000 * s + i, "w " * rnd.randint(50, 450), f"s{s}") for s in range(3) for i in range(150)] + [(9000 + k, "w " * 20_000, f"s{k % 3}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in ("a", "b", "c"):
        got = defaultdict(int)
        target = {}
        for r in mixing.mix(docs, seed=seed, carry=True).collect():
            got[r.source] += r.taken
            target[r.source] = (r.target, r.source_size)
        assert all(abs(got[s] - t) <= 0.002 * n for s, (t, n) in target.items()), (seed, got, target)
    docs.unpersist()


def test_mixing_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], none.schema)).first().taken == 0


def test_myers_against_plain():
    rnd = random.Random(4)
    for _ in range(300):
        p = [rnd.randrange(3) for _ in range(rnd.randint(1, 70))]
        t = [rnd.randrange(3) for _ in range(rnd.randint(0, 90))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for j, x in enumerate(p):
                new.append(min(row[j] + (x != c), row[j + 1] + 1, new[-1] + 1))
            row = new
            best = min(best, row[-1])
        assert decontaminate.myers(p, t) == best


def test_leaks(spark):
    rnd = random.Random(5)

    def words(n):
        return [f"w{rnd.randrange(2000)}" for _ in range(n)]

    items = [(i, words(rnd.randint(8, 70))) for i in range(25)] + [(90, ["tiny", "item"]), (91, [])]
    docs, want = [], {}
    for d in range(120):
        body, inside = words(rnd.randint(0, 120)), []
        if d % 3 == 0:
            i, w = items[rnd.randrange(25)]
            w = list(w)
            for _ in range(rnd.randint(0, len(w) // 3)):
                k = rnd.randrange(len(w))
                op = rnd.random()
                if op < 0.4:
                    w[k] = "changed"
                elif op < 0.7:
                    w.insert(k, "more")
                elif len(w) > 1:
                    w.pop(k)
            at = rnd.randint(0, len(body))
            body[at:at] = [x.upper() for x in w]
        low = [x.lower() for x in body]
        for i, w in items:
            if len(w) >= 4 and decontaminate.myers([hash(x) for x in w], [hash(x) for x in low]) <= int(len(w) * 0.2):
                inside.append(i)
        want[d] = inside
        docs.append((d, ", ".join(body)))
    docs += [(500, None), (501, "")]
    want |= {500: [], 501: []}
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(i, "  ".join(w)) for i, w in items] + [(None, "a b c d e"), (92, None)], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.leaks(frame, table).collect()}
    assert got == want and sum(map(bool, want.values())) > 20
    decontaminate.BLOCK_WORDS, keep = 200, decontaminate.BLOCK_WORDS
    try:
        assert {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontaminate.leaks(frame, table).collect()} == want
    finally:
        decontaminate.BLOCK_WORDS = keep
    assert decontaminate.leaks(frame, table.limit(0)).where("size(leaks) > 0").count() == 0


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(900, None, None), (901, "", "en"), (902, "123 -- 456", None), (903, None, "fr")], "doc_id long, text string, lang string")
    both = docs.unionByName(extra)
    got = langid.identify(both.withColumnRenamed("lang", "truth"), both.where("doc_id % 4 <> 2 ")).collect()
    held = [r for r in got if r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([r.lang_pred == r.truth for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id >= 900} == {900: "und", 901: "und", 902: "und", 903: "und"}
    assert langid.identify(both.limit(3), both.where("false")).where("lang_pred <> 'und'").count() == 0


def test_trigrams_against_plain():
    texts = ["Ab c", "", None, "éa1b"]
    codes, spans, has = langid.trigrams(texts)
    of = langid.classes()

    def plain(t):
        s = [0]
        for ch in t or "":
            k = int(of[ord(ch)])
            if k or s[-1]:
                s.append(k)
        if s[-1]:
            s.append(0)
        return [(s[i] * 40 + s[i + 1]) * 40 + s[i + 2] for i in range(len(s) - 2)]

    for t, (a, b) in zip(texts, spans, strict=True):
        assert codes[a:b].tolist() == plain(t), t
    assert has.tolist() == [True, False, False, True]


def test_words_against_plain():
    import pandas as pd

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab é\t\n\x0b\x1c  Z𝄞") for _ in range(rnd.randint(0, 40))) for _ in range(50)] + [None, ""]
    w = Words(texts)
    for t, a, b in zip(texts, w.doc, w.doc[1:], strict=False):
        assert [bytes(w.buf[x:y]) for x, y in zip(w.start[a:b], w.end[a:b], strict=True)] == (t or "").encode().lower().split()
    seen = {}
    for h, a, b in zip(w.hash.tolist(), w.start, w.end, strict=True):
        assert seen.setdefault(h, bytes(w.buf[a:b])) == bytes(w.buf[a:b])
    assert len(seen) == len({bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)})
    s = pd.Series(["abc", None, "d" * 50, "e"])
    assert [x.tolist() for x in batches_of(s, 10)] == [["abc", None], ["d" * 50, "e"]] and list(batches_of(s.iloc[:0])) == []
