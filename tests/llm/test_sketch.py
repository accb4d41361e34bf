import hashlib
import random

import numpy as np

from gradeloom.llm.sketch import containment, distinct, fingerprint_edits, merge, merge_sketches, pack, resemblance, shingle_hashes, sketch, unpack


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        sets = [set(shingle_hashes(x.encode()).tolist()) for x in (t, e, nxt)]
        j = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *j))
    return out


def test_edited_and_next(spark):
    rnd = random.Random(5)
    rows = [(i * 7 % 101, " ".join(rnd.choice("abcdé") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 60)))) for i in range(101)]
    rows += [(5, rows[5][1]), (5, "twice"), (None, "null id"), (500, None), (501, ""), (502, "x " * 30_000)]
    for some in (rows, rows[:1], rows[:2]):
        df = spark.createDataFrame([(*r, 1, 1) for r in some], "doc_id long, text string, n_chars int, raw int")
        got = fingerprint_edits(df).collect()
        near = sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)
        assert near == sorted((d or -1, n, s, round(a, 9), round(b, 9)) for d, n, s, a, b in brute(some))
        texts = {(r[0] or -1, len(r[1] or "")): r[1] or "" for r in some}
        for r in got:
            assert r["fingerprint"] == pack(sketch(texts[r["doc_id"] or -1, r["n_chars"]].encode()))
    assert fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_and_merging(spark):
    rnd = random.Random(6)
    words = [str(rnd.random()) for _ in range(6000)]
    a, b = " ".join(words[:4000]).encode(), " ".join(words[1000:]).encode()
    sa, sb = sketch(a), sketch(b)
    x, y = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    assert abs(resemblance(sa, sb) - len(x & y) / len(x | y)) < 0.15
    assert abs(containment(sa, sb) - len(x & y) / len(x)) < 0.25
    assert abs(distinct(sa) / len(x) - 1) < 0.3
    whole = merge([sa, sb])
    assert whole.tolist() == np.unique(np.concatenate((shingle_hashes(a), shingle_hashes(b))))[: len(whole)].tolist()
    df = spark.createDataFrame([(i % 3, pack(s)) for i, s in enumerate([sa, sb, sa, sb, sb, sa])] + [(None, None)], "g int, fingerprint string").repartition(4)
    got = {r["g"]: r for r in merge_sketches(df, "g").collect()}
    assert unpack(got[0]["fingerprint"]).tolist() == whole.tolist() and got[None]["n_shingles"] == 0 and len(got) == 4
