import random

import numpy as np

from gradeloom.llm.near_dups import dart_signatures, elements, near_duplicates


def brute(rows, least=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = [set(elements(t.encode()).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and len(sets[i] & sets[j]) / u >= least:
                root[find(i)] = find(j)
    cls = {t: find(i) for i, t in enumerate(texts)}
    low = lambda d: -1 if d is None else d
    groups = {}
    for d, t in rows:
        groups.setdefault(cls[t or ""], []).append(low(d))
    return sorted((low(d), min(groups[cls[t or ""]]), len(groups[cls[t or ""]])) for d, t in rows)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    rows = []
    for i in range(n):
        base = [word() for _ in range(rnd.choice([3, 8, 60, 200]))]
        rows.append((i, " ".join(base)))
        for j in range(rnd.randint(0, 8)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                w[rnd.randrange(len(w))] = word()
            base = w if rnd.random() < 0.5 else base  # chains drift apart
            rows.append((1000 + i * 10 + j, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, "..."), (5003, "..."), (None, "one two"), (5004, "one two"), (5004, "one two"), (5005, "x " * 20_000)]


def check(spark, rows, **how):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, class_id int, band int")
    got = sorted((-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2]) for r in near_duplicates(df, **how).collect())
    assert got == brute(rows)


def test_classes_against_brute_force(spark):
    check(spark, corpus(1))
    check(spark, [])
    check(spark, corpus(2, 15), block=3)


def test_names_that_collide(spark):
    check(spark, corpus(3, 15), name_bits=3)


def test_boilerplate(spark):
    """A chain of texts of resemblance about 0.5, far more than a block, with some pairs of 0.8 and more among them that no band's first text is near to."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(600):
        own = [f"o{i}x{k}" for k in range(26)]
        rows.append((i, " ".join(base + own)))
        if i % 40 == 0:
            own[-1] = "changed"
            rows.append((10_000 + i, " ".join(base + own)))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for large in (8, 1):  # 1: groups of over 64 texts are parted by a second band
        got = {r[0]: r[1:] for r in near_duplicates(df, block=64, large=large).collect()}
        assert got == {d: (d % 10_000, 2 if d % 10_000 % 40 == 0 else 1) for d, _ in rows}


def test_signatures_estimate_resemblance():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    for n, shared in ((1, 1), (20, 10), (600, 540), (2000, 1000)):
        a, b = pool[:n], np.concatenate((pool[:shared], pool[n : 2 * n - shared]))
        s = dart_signatures([a, b] * 3, k=512)
        assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.1
    w = [np.array([3.0, 1.5, 0.5]), np.array([1.0, 2.5, 0.5])]
    s = dart_signatures([pool[:3], pool[:3]], w, k=2048)
    assert abs((s[0] == s[1]).mean() - (1 + 1.5 + 0.5) / (3 + 2.5 + 0.5)) < 0.05
