import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from gradeloom.llm.packing import pack_best_fit
from gradeloom.llm.token_store import Shard, pack, read_token_shards, token_places, write_token_shards
from gradeloom.llm.tokens import Encoder, tokenizer_path

TEXTS = [
    "", "a", " ", "  ", "\n\n", "Hello, world! it's  we'll\n\n x\t\ty ", "<|endoftext|> a  <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "ÉCOLE école İ ß ﬁ é K", "a \n\nb   c ", " x — y—!",
    "don't!!! ### $$$ 12345 6²5 x²5 —!—5 it's. It'S", "日本語 テキスト。 mixed日本", "\x1cab\x1d cd\x00\x7f", "THE the ThE, the.", "'s 's' 'll 've", "a" * 3000, "w " * 3000, "\r\n x\r\n\r\n y \x0b\x0c z", "x '' y' 'z \"q\"",
]


def test_cached_encoding_is_the_librarys():
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab'. ,!\n\t é— s²5") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc, ref = Encoder(tokenizer_path(name), keeps, most_pieces=500), Tokenizer.from_file(tokenizer_path(name))
        want = [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
        for lo in range(0, len(texts), 100):
            ids, counts = enc.encode([t.encode() for t in texts[lo : lo + 100]])
            got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            for t, a, b in zip(texts[lo : lo + 100], got, want[lo : lo + 100], strict=True):
                assert a == b, (name, t)
        assert len(enc.encode([])[0]) == 0


def test_new_words_reach_the_library_many_at_a_time():
    enc, sent = Encoder(tokenizer_path("byte_bpe_50k.json"), True), []

    class Library:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return enc_library.encode_batch_fast(texts, **more)

    enc_library, enc.tokenizer = enc.tokenizer, Library()
    odd = ["x", "\x1ca", "b\x1d", "e\u0301", "\u180e", "it's", "a\0b", "\0", "\0c", "5x²", "日本", "\n", "y!\nz", "x"]
    text = " ".join([f"w{i:x}k" for i in range(2000)] + odd)
    ids, counts = enc.encode([text.encode()])
    assert ids.tolist() == enc_library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    plain = " ".join(f"v{i:x}k" for i in range(2000))
    sent.clear()
    assert enc.encode([plain.encode()])[0].tolist() == enc_library.encode(plain, add_special_tokens=False).ids
    assert len(sent) <= 20


def test_shard_round_trip():
    rnd = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (700, 3), (5000, 50_000), (1300, 70_000)):
        t = rnd.integers(0, top, n).astype(np.uint32)
        s = Shard(pack(t, np.array([n]), np.array([5]), np.array([False])))
        assert s.tokens().tolist() == t.tolist() and s.documents == [5] and s.counts.tolist() == [n]
        for x in set(t[:5].tolist()) | {0, 99_999}:
            assert s.places(x) == np.flatnonzero(t == x).tolist() and s.count(x, n // 3, n // 2) == int((t[n // 3 : n // 2] == x).sum())
        assert [s.token(i) for i in range(0, n, 97)] == t[::97].tolist()


def frame(spark, texts=TEXTS):
    rows = [(i * 3 % 41, t) for i, t in enumerate(texts)]
    rows += [(3, texts[4]), (3, texts[4]), (None, "null id"), (99, None)] if texts else []
    return spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, start int, length int, part int"), rows


def ids_of(rows, name):
    ref = Tokenizer.from_file(tokenizer_path(name))
    return [(d, t or "", ref.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_in_id_order(spark, tmp_path):
    df, rows = frame(spark)
    folder = f"file://{tmp_path}/shards"
    index = write_token_shards(df, folder, parts=5)
    got = sorted(map(tuple, read_token_shards(spark, folder, index).collect()), key=lambda x: x[1])
    want, at, all_ids = [], 0, []
    for d, _, ids in sorted(ids_of(rows, "byte_bpe_50k.json"), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
        all_ids += ids
    assert got == want
    n, place = token_places(spark, folder, index, [all_ids[7]]).select("n", "first_place").first()
    assert n == all_ids.count(all_ids[7]) and place == all_ids.index(all_ids[7])


def test_no_documents(spark, tmp_path):
    df, _ = frame(spark, [])
    folder = f"file://{tmp_path}/none"
    assert read_token_shards(spark, folder, write_token_shards(df, folder)).count() == 0
    assert pack_best_fit(df).count() == 0


def best_fit(lengths, size):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(size - x)
    return len(gaps)


def test_packing(spark):
    df, rows = frame(spark, TEXTS + [f"word {i} " * (i % 17) for i in range(200)])
    got = pack_best_fit(df, size=32, salts=3).collect()
    pieces = sorted((d or -1, k, k * 32, len(ids[k * 32 : k * 32 + 32]), crc(ids[k * 32 : k * 32 + 32])) for d, _, ids in ids_of(rows, "word_bpe_49k.json") for k in range(-(-len(ids) // 32)))
    assert sorted((r[0] or -1, *r[1:5]) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 32
    assert len(by) == best_fit([p[3] for p in pieces], 32)
