import random

import corpus_pipeline
from gradeloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {"aa": [f"{a}{b}or" for a in "lmnr" for b in "aeiou"], "bb": [f"{a}{b}sch" for a in "zgktp" for b in "äöü"]}


def corpus(spark, folder):
    rnd = random.Random(1)

    def text(lang, n):
        return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(WORDS[lang]) + str(rnd.randint(0, 99)) for _ in range(n))

    clean = [(i, text(lang := rnd.choice(sorted(WORDS)), rnd.randint(20, 120)), lang) for i in range(120)]
    item = text("aa", 12)
    passage = text("bb", 80)
    short = text("bb", 55)[:330]  # under 400 bytes
    rows = list(clean)
    rows += [(200, "123 456", "aa"), (201, None, None), (202, clean[0][1], "aa"), (202, clean[0][1], "aa"), (203, clean[1][1] + " extra", "bb")]
    rows += [(210, text("aa", 30) + " " + item + " " + text("aa", 30), "aa")]
    rows += [(None, text("aa", 40), "aa"), (None, text("aa", 30), None)]
    rows += [(230 + i, text("bb", 40) + " " + short + " " + text("bb", 40), "bb") for i in range(2)]
    rows += [(240, " ".join(f"{a}{b}or{a}{b}or{i % 97}" for i in range(2000) for a in "lmnr" for b in "aeiou"), "aa")]  # a very long text
    rows += [(220 + i, text("bb", 20) + " " + passage + " " + text("bb", 20), "bb") for i in range(3)]
    spark.createDataFrame([(d, t, x, "s", len(t or "")) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return clean, passage, short


def test_stages(spark, tmp_path):
    clean, passage, short = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == COLUMNS
        kept[name] = {(r["doc_id"], r["text"]) for r in docs.collect()}
        assert name == "language_id" or len(kept[name]) == docs.count()
    ids = {k: [d for d, _ in v] for k, v in kept.items()}
    assert not {200, 201} & set(ids["language_id"]) and {d for d, *_ in clean} <= set(ids["language_id"])
    assert len({0, 202} & set(ids["near_duplicates"])) == len({1, 203} & set(ids["near_duplicates"])) == 1
    assert {d for d, *_ in clean} - {0, 1} <= set(ids["benchmark_decontamination"]) and 210 not in ids["benchmark_decontamination"]
    assert {220, 221, 222} <= set(ids["suffix_array_dedup"]) and not any(passage[:300] in t for _, t in kept["suffix_array_dedup"])
    assert {230, 231} <= set(ids["suffix_array_dedup"]) and any(short in t for _, t in kept["near_duplicates"]) and not any(short in t for _, t in kept["suffix_array_dedup"])
    assert ids["benchmark_decontamination"].count(None) == 2 and 240 in ids["benchmark_decontamination"]
    texts = {d: t for d, t in kept["benchmark_decontamination"]}
    assert all(texts[d] == t for d, t, _ in clean if d in texts)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(ids["benchmark_decontamination"])


def test_empty_table(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)))
    assert docs.count() == 0
