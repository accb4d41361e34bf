import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import word_pairs
from gradeloom.llm.common import materialize
from gradeloom.llm.langid import identify, third, train_language_model
from gradeloom.llm.toxicity import score_toxicity, train_toxicity

WORDS = {"aa": ["lorem", "ipsum", "dolor", "sitam"], "bb": ["zwei", "gross", "schon", "über"], "cc": ["ñoño", "queso", "calle", "luz"]}


def texts(n, seed=1):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        yield i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 40))), lang


def test_language_of_held_out_texts(spark):
    rows = [(i, t, x, 0.5, True) for i, t, x in texts(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    model = train_language_model(docs.filter(third() != 1))
    out = identify(docs.select("doc_id", "text", "lang").filter(third() == 1), model)
    assert out.count() > 50 and out.filter("lang_pred <> lang or rejected").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, x) for i, t, x in texts(60)], "doc_id long, text string, lang string")
    model = train_language_model(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "lorem ipsum dolor"), (5, "lorem " * 200_000), (5, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r for r in identify(odd, model).collect()}
    for key in ((1, None), (2, ""), (3, "123 !")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0 and got[key]["rejected"]
    assert got[None, "lorem"]["lang_pred"] == got[5, "lorem"]["lang_pred"] == "aa" and 0 <= got[5, "x"]["score"] <= 1
    none = train_language_model(docs.limit(0))
    assert identify(odd, none).filter("lang_pred <> 'und'").count() == 0 and identify(odd.limit(0), model).count() == 0


def test_language_with_many_copies(spark):
    """A text copied thousands of times does not take the place of its language's other texts."""
    rows = [(i, t, x) for i, t, x in texts(300, 7)]
    rows += [(1000 + i, "xyzzy 1 plugh", "aa") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(docs.filter("doc_id % 3 <> 1"), texts_a_language=60)
    out = identify(docs.filter("doc_id % 3 = 1 and doc_id < 1000"), model)
    assert out.filter("lang = 'aa'").count() > 20 and out.filter("lang_pred <> lang").count() == 0


def test_toxicity_of_held_out_texts(spark):
    rnd, rows = random.Random(3), []
    for i, t, _ in texts(600, 4):
        words = t.split()
        if y := int(rnd.random() < 0.3):
            words.insert(rnd.randint(0, len(words)), "scumlike" + rnd.choice(["", "s", "er"]))
        rows.append((i, " ".join(words), y, i % 5))
    rows += [(None, None, None, 1), (700, "", 0, None), (701, "ok", 2, 0), (702, "lorem " * 100_000, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    model = train_toxicity(docs.filter("fold <> 4 or fold is null"))
    got = score_toxicity(docs, model, keep=("toxic", "fold"))
    assert got.count() == len(rows) and got.filter("score is null or score < 0 or score > 1").count() == 0
    held = got.filter("fold = 4")
    assert held.filter("predicted <> toxic").count() <= 0.03 * held.count()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, 0), (2, None, 0, 0)], "doc_id long, text string, toxic int, fold int")
    for labelled in (docs.limit(0), docs):
        got = score_toxicity(docs, train_toxicity(labelled))
        assert got.filter(F.col("score").between(0, 1)).count() == 2


def test_toxicity_of_words_that_fold_alike(spark):
    """Toxic and clean Cyrillic words whose letters fold to the same symbols (each pair's last bytes are alike by the fold), and numbers."""
    rnd, rows, filler = random.Random(5), [], ["дом", "река", "лес", "поле", "город"]
    for bad, good in (("абвг", "рсту"), ("1488", "1066")):
        for i in range(400):
            y = int(rnd.random() < 0.4)
            words = rnd.choices(filler, k=rnd.randint(3, 20))
            words.insert(rnd.randint(0, len(words)), bad if y else good)
            rows.append((len(rows), " ".join(words), y, i % 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    got = score_toxicity(docs.filter("fold = 4"), train_toxicity(docs.filter("fold <> 4")), keep=("toxic",))
    assert got.filter("predicted <> toxic").count() <= 0.03 * got.count()


def test_toxicity_tables_grow_and_pairs_count(spark):
    """Two words that are toxic only side by side."""
    from gradeloom.llm.word_pairs import train_words

    rnd, rows = random.Random(6), []
    for i in range(800):
        y, words = int(rnd.random() < 0.4), rnd.choices(["lorem", "ipsum", "dolor"], k=rnd.randint(4, 12))
        k = rnd.randint(0, len(words) - 2)
        words[k:k] = ["hinabgefahren", "zusammengebracht"] if y else ["hinabgefahren", "lorem", "zusammengebracht"]
        rows.append((i, " ".join(words), y, i % 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    got = score_toxicity(docs.filter("fold = 4"), train_toxicity(docs.filter("fold <> 4")), keep=("toxic",))
    assert got.filter("predicted <> toxic").count() <= 0.03 * got.count()
    kinds = []
    for n in (500, 1000):
        made = spark.createDataFrame([(f"w{i} v{i}".encode(), 0) for i in range(n)], "raw binary, y int")
        kinds.append(train_words(made)[2][0, 0][2])
    assert kinds == [1000, 2000]


def test_toxicity_by_joined_table_equals_broadcast(spark):
    rnd, rows = random.Random(8), []
    for i, t, _ in texts(300, 9):
        y = int(rnd.random() < 0.3)
        rows.append((i, t + " vermin" * y, y, i % 5))
    rows += [(None, None, None, 1), (700, "", 0, None), (701, "x", 0, 0), (701, "x", 0, 0), (702, "lorem vermin " * 90_000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    got = [sorted(map(repr, score_toxicity(docs, train_toxicity(docs, broadcast_rows=n), keep=("toxic", "fold")).collect())) for n in (0, 1_000_000)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_toxicity_with_words_in_many_blocks(spark, monkeypatch):
    """A word's pairs are parted among blocks when there are many of them; the scores are the same."""
    from gradeloom.llm import word_pairs

    rows = [(i, t + " vermin" * (i % 3 == 0), int(i % 3 == 0), i % 5) for i, t, _ in texts(200, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    few = sorted(map(repr, score_toxicity(docs, train_toxicity(docs)).collect()))
    size = sum(len(t.encode()) for _, t, _, fold in rows if fold)
    monkeypatch.setattr(word_pairs, "BLOCK", size // (4 * word_pairs.BY_WORD) + 1)
    model = train_toxicity(docs, broadcast_rows=0)
    assert model[0][0].count() > word_pairs.BY_WORD
    assert sorted(map(repr, score_toxicity(docs, model).collect())) == few


def test_toxicity_column_names(spark):
    """A column named like the result's is ignored unless it is to be kept, which is refused."""
    docs = spark.createDataFrame([(1, "a b", 1, 0, 0.5, 7), (2, "c", 0, 1, 0.1, 8)], "doc_id long, text string, toxic int, fold int, score double, predicted int")
    model = train_toxicity(docs)
    assert score_toxicity(docs, model).columns == ["doc_id", "score", "predicted"]
    with pytest.raises(ValueError):
        score_toxicity(docs, model, keep=("score",))


def test_pairs_of_ordinary_texts_have_steps(spark):
    """A pair that class 1 never holds is evidence against it; the step is that of the formula."""
    from math import log

    import numpy as np

    from gradeloom.llm.word_pairs import DISCOUNT, SCALE, pair_keys, steps_of, train_words, word_keys

    rows = spark.createDataFrame([(b"alpha beta", 0)] * 6 + [(b"gamma beta", 1)] * 3 + [(b"alpha gamma", 1)], "raw binary, y int")
    model = train_words(rows)[0].collect()
    steps = {k: v for r in model for k, v in zip(*map(np.ndarray.tolist, steps_of(r["data"])), strict=True)}
    assert sum(r["n"] for r in model) == len(steps)
    a, b = word_keys(np.array(["alpha", "beta"], object))
    p0, p1 = (6 - DISCOUNT + DISCOUNT * 6 / 9) / 6, DISCOUNT * 6 / 9 / 3
    assert steps[int(pair_keys(np.array([a]), np.array([b]))[0])] == round(log(p1 / p0) * SCALE)


def test_toxicity_leaves_the_model_alone_on_disk(spark, monkeypatch):
    """Neither the tables in between nor the shuffles of what is written stay."""
    held, kept = word_pairs.materialize, []
    monkeypatch.setattr(word_pairs, "materialize", lambda *a, **k: kept.append(held(*a, **k)) or kept[-1])
    rows = spark.createDataFrame([("aa bb cc", 0), ("bb dd", 1), ("aa dd", 1)], "raw string, y int").withColumn("raw", F.col("raw").cast("binary"))
    model, n, _ = word_pairs.train_words(rows)
    there = [df for df in kept if all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert there == [model] and len(kept) > 2 and model.count() > 0 and n > 0


def test_shuffles_of_written_tables_leave_the_disk(spark):
    def shuffled():
        return {f for folder in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*") for f in glob.glob(f"{folder}/*/shuffle_*.data")}

    before = shuffled()
    rows = materialize(spark.range(10_000).groupBy((F.col("id") % 5000).alias("k")).count())
    assert rows.count() == 5000 and not {f for f in shuffled() - before if os.path.getsize(f) > 2000}
