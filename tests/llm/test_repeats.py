import hashlib
import random
import re
from collections import defaultdict

from gradeloom.llm.span_dedup import remove_copied_passages
from gradeloom.llm.suffix_dedup import remove_repeats


def brute_bytes(docs, size):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in docs]
    for r in raws:
        for i in range(len(r) - size + 1):
            seen[r[i : i + size]] += 1
    for (d, _), r in zip(docs, raws, strict=True):
        gone = [False] * len(r)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        yield d, len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()


def brute_words(docs, size):
    least = {}
    rows = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    rank = lambda d: -1 if d is None else d
    for d, w in rows:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            least[k] = min(least.get(k, 1 << 60), rank(d))
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < rank(d):
                gone[i : i + size] = [True] * size
        yield d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab") * rnd.randint(1, 3) + rnd.choice(["", "é", "ü,"]) + str(rnd.randint(0, 99))
    shared = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [rnd.choice(shared)[rnd.randint(0, 40) :] if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))]
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (101, docs[3][1]), (7, docs[8][1]), (None, docs[9][1]), (102, None), (103, ""), (104, "x" * 300), (105, "x y " * 90), (106, " ".join(shared) * 3)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id long, text string, lo int, n int, key int")


def test_bytes(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = remove_repeats(frame(spark, docs), size=50, seed=17, sort_up_to={1: 2000, 2: 3}[seed]).drop("kept").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_bytes(docs, 50)))


def test_words(spark):
    for seed in (3, 4):
        docs = corpus(seed)
        got = remove_copied_passages(frame(spark, docs), size=12, seed=5).drop("kept").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_words(docs, 12)))


def test_texts_and_kept_columns(spark):
    a, b = (" ".join(str(i) for i in range(lo, lo + 9)) for lo in (100, 200))
    docs = [(1, a + "é" * 40), (2, "é" * 40 + b), (3, None)]
    got = {r["doc_id"]: (r["kept"], r["lo"], r["n"]) for r in remove_repeats(frame(spark, docs), size=20, seed=5, keep=("lo", "n")).collect()}
    assert got == {1: (a, 1, 2), 2: (b, 1, 2), 3: ("", 1, 2)}
    got = {r["doc_id"]: r["kept"] for r in remove_copied_passages(frame(spark, [(1, "a b c d e"), (2, "x b c d  e")]), size=3, seed=2).collect()}
    assert got == {1: "a b c d e", 2: "x"}


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0 and remove_copied_passages(frame(spark, [])).count() == 0


def test_names_that_collide(spark):
    """Names of three bits: nearly all collide, and only the checks tell windows and blocks apart."""
    docs = corpus(5)
    got = remove_repeats(frame(spark, docs), size=50, seed=17, sort_up_to=0, name_bits=3).drop("kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_bytes(docs, 50)))
    got = remove_copied_passages(frame(spark, docs), size=12, seed=5, name_bits=3).drop("kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_words(docs, 12)))


def test_text_longer_than_a_chunk(spark):
    """Repeats across the places where a very long text is cut into chunks of 2^18 symbols."""
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2**18 + 3000))
    docs = [(1, long), (2, "x" + long[2**18 - 300 : 2**18 + 200] + "y"), (3, "z" + long[5000:5500])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(frame(spark, docs), texts=False).collect()}
    assert got == {1: (len(long), 1000, 2), 2: (502, 500, 1), 3: (501, 500, 1)}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2^64."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, " ".join([*words[:25], word, *words[25:]])), (2, " ".join([*words[:25], other, *words[25:]])), (3, " ".join([*words[:25], word, *words[25:]]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_copied_passages(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 51}


def test_rows_of_null_id_whose_32_bit_hashes_are_equal(spark):
    """Two texts of null id that a 32-bit hash does not tell apart; a third text repeats a passage of the first."""
    from pyspark.sql import functions as F

    passage = "".join(chr(97 + (i * i + 3 * i) % 23) for i in range(450))
    left = spark.range(200_000).select(F.concat(F.col("id").cast("string"), F.lit(passage)).alias("a")).withColumn("h", F.hash("a"))
    right = spark.range(200_000).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("b")).withColumn("h", F.hash("b"))
    a, b = left.join(right, "h").select("a", "b").first()
    docs = spark.createDataFrame([(None, a), (None, b), (7, passage)], "doc_id long, text string")
    got = {r["kept"]: (r["n_bytes"], r["n_removed"]) for r in remove_repeats(docs).collect()}
    assert got[b] == (len(b), 0) and got[""] == (450, 450) and got[a[: len(a) - 450]] == (len(a), 450)
