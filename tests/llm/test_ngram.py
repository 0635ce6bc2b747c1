import math
import random
from collections import Counter, defaultdict

from lodestar.llm import ngram


def brute(train, texts):
    def toks(t):
        return [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]

    c, big = Counter(), Counter()
    for t in train:
        x = toks(t)
        c.update(x)
        big.update(zip(["<s>", *x], x))
    n, v = sum(c.values()), len(c)

    def disc(counts):
        k = Counter(counts)
        return ngram.discounts(k[1], k[2], k[3], k[4])

    d2 = disc(big.values())
    cc = Counter(w for _, w in big)
    d1 = disc(cc.values())
    total = sum(cc.values())
    ctx = defaultdict(list)
    for (a, _), m in big.items():
        ctx[a].append(m)
    out = []
    for t in texts:
        x = toks(t)
        s = b = 0.0
        for a, w in zip(["<s>", *x], x):
            b += math.log10((c[w] + 1) / (n + v + 1))
            rest = sum(d1[min(m, 3)] for m in cc.values()) / total if total else 1
            low = (max(cc[w] - d1[min(cc[w], 3)], 0) / total if total else 0) + rest / (v + 1)
            if ctx[a]:
                tot = sum(ctx[a])
                m = big[a, w]
                p = max(m - d2[min(m, 3)], 0) / tot + sum(d2[min(m, 3)] for m in ctx[a]) / tot * low
            else:
                p = low
            s += math.log10(p)
        out.append((len(x), sum(c[w] > 0 for w in x), n, b, s))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(9)
    words = [f"w{i}é" for i in range(60)] + ["The", "the", "OF"]
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.6 else "the" for _ in range(rnd.randint(0, 80))) for _ in range(120)] + [None, "", "\n \t", "unseen words only"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram.score(df, df.where("doc_id % 3 <> 1").select("text")).collect()}
    want = brute([t for i, t in rows if i % 3 != 1], texts)
    for i, (n, known, total, b, s) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, b, abs_tol=1e-9) and math.isclose(r.score, s, rel_tol=1e-9, abs_tol=1e-9), i


def test_more_shards_change_nothing(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, many = ngram.train(df), ngram.train(df, shard_tokens=10)
    assert (few.layout.bits, many.layout.bits) == (5, 8)
    a, b = few.score(texts), many.score(texts)
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a["score"], b["score"], strict=True))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = ngram.score(df, df.where("doc_id < 0").select("text")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert ngram.score(df.where("doc_id < 0"), df.select("text")).count() == 0
