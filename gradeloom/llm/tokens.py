"""Encoding of many texts by a public tokenizer file, with a bounded cache of words in each Python worker.

The tokenizers of these files treat the pieces of a text that their patterns cut out one by one. Texts are cut at places
where such a piece always ends, such as a blank before a word or a word's end before a sign; each distinct
piece is encoded once by the library and its ids are put together again. Texts for which a cut could change the
ids (special tokens written out, blanks outside ASCII) are given to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

BLANK = rb" \t\n\x0b\x0c\r"
#: A blank belongs to the word after it, as in the byte-level pattern.
SPACED = re.compile(rb" ?[^%s]+|[%s]+(?![^%s])|[%s]+" % (BLANK, BLANK, BLANK, BLANK))
#: A word's end before signs, the apostrophe apart.
CLOSING = re.compile(rb"(.*[A-Za-z])([!-&(-/:-@\[-`{-~]+)", re.S)
ODD_BLANKS = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\0")
#: What the keys of pieces that are no word after a blank begin with.
APART = (b"\0", b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Signs between words that other means than the patterns might take for blanks.
CONTROL = re.compile(rb"[\x1c-\x1f]")
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Numbers(dict):
    """Numbers the keys asked for; new keys are also listed."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    def __init__(self, path: str, keeps_blanks: bool, most_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all that it has
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_blanks, self.most_pieces = keeps_blanks, most_pieces
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab() if keeps_blanks else {}
        #: which ids begin with a blank
        self.begins = np.zeros(max(vocab.values(), default=-1) + 1, bool)
        self.begins[[i for piece, i in vocab.items() if piece[:1] == "Ġ"]] = True
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat, self.start, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def whole(self, raw: bytes) -> bool:
        """Whether cutting the text could change its ids."""
        if any(s in raw for s in self.special):
            return True
        return self.keeps_blanks and any(b in raw for b in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")) and bool(WIDE_BLANK.search(raw))

    def cut(self, raw: bytes) -> list:
        """Keys of the text's pieces: a piece with a blank before it stands without the blank, other pieces begin with a newline or a 0."""
        if not self.keeps_blanks:
            return raw.lower().split()
        if raw[:1].isspace() or raw[-1:].isspace() or any(x in raw for x in ODD_BLANKS):
            return [p[1:] if p[:1] == b" " and len(p) > 1 and p[1:2] not in b" \0\n" else b"\0" + p for p in SPACED.findall(raw)]
        parts = raw.replace(b"\n", b" \n").split(b" ")
        parts[0] = b"\0" + parts[0]
        return parts if raw else []

    def text(self, key) -> str:
        if isinstance(key, tuple):
            return key[0].decode()
        if not self.keeps_blanks:
            return key.decode()
        return (key[1:] if key[:1] == b"\0" else key if key[:1] == b"\n" else b" " + key).decode()

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered pieces one after another, and where each piece's end."""
        size, done = self.size[at], np.cumsum(self.size[at])
        total = int(done[-1]) if len(done) else 0
        return self.flat[np.repeat(self.start[at] - (done - size), size) + np.arange(total)], done

    def put(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at], self.size[at] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)

    def encoded(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys' pieces one after another, and each piece's number of ids; one text a piece."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([self.text(k) for k in keys], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encoded_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encoded``, for words after a blank, all in one text: each begins at an id with a blank. Where that does not tell them apart, one by one."""
        raw = b" " + b" ".join(words)
        if not (CONTROL.search(raw) or WIDE_BLANK.search(raw) or any(s in raw for s in self.special)):
            ids = np.array(self.tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
            if len(size) == len(words):
                return ids, size
        return self.encoded(words)

    def learn(self, many: int = 256) -> None:
        """Encode the pieces that are new, words after a blank many at a time."""
        number, new, first = self.number, self.number.new, len(self.number) - len(self.number.new)
        plain, joined = [], []
        sign = b"\0" if self.keeps_blanks else b""
        for i, key in enumerate(new):  # grows as parts are added
            m = CLOSING.fullmatch(key) if not isinstance(key, tuple) else None
            if m:
                joined.append((first + i, number[m[1]], number[sign + m[2]]))
            else:
                plain.append(i)
        if len(number) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(number)), np.resize(self.size, 2 * len(number))
        words = [i for i in plain if new[i] and isinstance(new[i], bytes) and not new[i].startswith(APART)] if self.keeps_blanks else []
        for lo in range(0, len(words), many):
            at = words[lo : lo + many]
            self.put(np.array(at, np.int64) + first, *self.encoded_words([new[i] for i in at]))
        if words:
            done = set(words)
            plain = [i for i in plain if i not in done]
        self.put(np.array(plain, np.int64) + first, *self.encoded([new[i] for i in plain]))
        if joined:
            at, head, tail = np.array(joined, np.int64).T
            while len(at):  # parts that are joined themselves come first
                ready = (head < first) | ~np.isin(head, at)
                both, done = self.gather(np.stack((head[ready], tail[ready]), 1).reshape(-1))
                self.put(at[ready], both, np.diff(done[1::2], prepend=0))
                at, head, tail = at[~ready], head[~ready], tail[~ready]
        number.new = []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and each text's number of ids."""
        if len(self.number) > self.most_pieces:
            self.clear()
        pieces, ends = [], []
        for raw in texts:
            if self.whole(raw):
                pieces.append((raw,))
            else:
                pieces += self.cut(raw)
            ends.append(len(pieces))
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if self.number.new:
            self.learn()
        ids, done = self.gather(at)
        return ids, np.diff(np.concatenate(([0], done))[np.array(ends, np.int64)] if ends else np.zeros(0, np.int64), prepend=0)


@cache
def encoder(path: str, keeps_blanks: bool, most_pieces: int = 1_500_000) -> Encoder:
    """One encoder a Python worker, kept from batch to batch and task to task: about 250 bytes a piece."""
    return Encoder(path, keeps_blanks, most_pieces)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
