import hashlib
import re

from gradeloom.llm.decontam import contaminated_words


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            q = words(it)
            size = min(window, len(q))
            for i in range(len(q) - size + 1 if q else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == q[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


LONG = " ".join(f"w{i % 13}" for i in range(40))
ITEMS = [(1, LONG), (2, "One two THREE"), (10, "é ü x"), (3, None), (4, ""), (5, "..."), (6, "solo"), (7, LONG), (None, "rare pair")]
DOCS = [
    (1, "a b " + LONG + " c"), (2, "one, two; three! one two"), (3, None), (4, ""), (5, "x é ü x"), (6, "Solo solo"), (6, "Solo solo"),
    (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "a rare pair"), (9, "ONE two three w0 w1"), (11, "word " * 5000 + LONG),
]


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, 0, "x") for a, b in docs], "doc_id long, text string, n_words int, item_id string")
    b = spark.createDataFrame([(a, c, 1) for a, c in items], "item_id long, text string, doc_id int")
    got = contaminated_words(d, b, **kw).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(docs, [("null" if a is None else a, c) for a, c in items])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_against_brute_force(spark):
    check(spark, DOCS, ITEMS)


def test_benchmark_in_several_blocks(spark):
    check(spark, DOCS, ITEMS, block_words=4)


def test_blocks_one_at_a_time(spark, monkeypatch):
    """Never more than one block's tables are held, and none is left."""
    from pyspark.core.broadcast import Broadcast

    make, destroy, seen = spark.sparkContext.broadcast, Broadcast.destroy, {"made": 0, "live": 0, "most": 0}

    def made(value):
        seen["made"], seen["live"] = seen["made"] + 1, seen["live"] + 1
        seen["most"] = max(seen["most"], seen["live"])
        return make(value)

    def destroyed(self, blocking=False):
        seen["live"] -= 1
        destroy(self, blocking)

    monkeypatch.setattr(spark.sparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", destroyed)
    items = [(i, f"item{i} word{i} " + " ".join(f"q{i * 7 % 50} r{k}" for k in range(6))) for i in range(40)]
    docs = [(i, "x " + items[i * 9 % 40][1] + " y") for i in range(30)] + DOCS
    check(spark, docs, items + ITEMS, block_words=60)
    assert seen["made"] >= 14 and seen["most"] == 2 and seen["live"] == 0


def test_empty_tables(spark):
    check(spark, DOCS, [])
    check(spark, [], ITEMS)
