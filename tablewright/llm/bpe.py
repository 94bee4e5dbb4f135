"""BPE encoding in batched numpy merge rounds, and decoding.

The distinct words of a block lie in one flat array of symbols. Each round looks all
neighbouring pairs up in the sorted array of pair keys by binary search, takes the
lowest rank in each word, merges that pair everywhere in its word from left to right,
and drops the words in which no pair is left. Words keep their ids in the worker's
memo, and documents gather them. Decoding starts from a document's ids alone.

Texts are prepared as the vocabulary's file says: NFC, white space folded, lower case
by character, words by its pattern, the end-of-word suffix. Special strings become
their own ids. Decoding joins the tokens' strings with a blank, as the library does
for a file without a decoder.

Null texts count as empty (no ids, empty decoded text); repeated rows count each by
itself; an empty table gives an empty table. Columns of the input that have a result
column's name are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, spans_of, table, text_array
from .pretokens import BLANKS, NUMBERS, byte_letters, default_path, is_narrow

NONE = np.iinfo(np.int64).max
MEMO = 200_000
# White space as the vocabulary's normaliser knows it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The file's pattern over lower-cased texts of the first 256 characters, where the standard library's engine is faster.
SMALL = "a-zªµºß-öø-ÿ"
NARROW_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{SMALL}]+|[{NUMBERS}]|[^{BLANKS}{SMALL}{NUMBERS}]+"


class WordBpe:
    """A vocabulary with end-of-word suffix, read from its file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_letters()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.text_of = {i: s for s, i in (vocab | added).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")").split
        self.fold = re.compile(f"[{SPACE}]+").sub
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.find_narrow = re.compile(NARROW_WORDS).findall
        self.ids: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """An empty memo: ids of all known words end to end, and where each starts."""
        self.ids.clear()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """Words of a text; special strings come back as they are."""
        if "<|" in text and any(a in text for a in self.added):
            return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if is_narrow(text):
            return self.find_narrow(text.lower())
        text = self.fold(" ", unicodedata.normalize("NFC", text))
        return self.find(text.replace("Σ", "σ").lower())  # sigma by itself, not by its place in the word

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        syms, ends = self.first[data], np.cumsum(lengths)
        syms[ends - 1] = self.last[data[ends - 1]]
        of = np.repeat(np.arange(len(words)), lengths)
        done_syms, done_of = [], []
        while len(syms):
            pair = syms[:-1] * self.size + syms[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(syms), NONE)
            rank[:-1] = np.where((self.keys[at] == pair) & (of[:-1] == of[1:]), self.ranks[at], NONE)
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            sizes = np.diff(np.append(starts, len(of)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = least != NONE
            hit = np.flatnonzero((rank == least) & open_)
            # of overlapping occurrences, every second one from the left merges
            head = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(hit - np.repeat(hit[head], np.diff(np.append(head, len(hit))))) % 2 == 0]
            syms[hit] = self.merged[rank[hit]]
            stay = np.ones(len(syms), bool)
            stay[hit + 1] = False
            done = ~open_
            done_syms.append(syms[done])
            done_of.append(of[done])
            stay &= open_
            syms, of = syms[stay], of[stay]
        if not words:
            return np.zeros(0, np.int64), lengths
        flat, of = np.concatenate(done_syms), np.concatenate(done_of)
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Encode the words that the memo lacks."""
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if not new:
            return
        if len(self.ids) + len(new) > MEMO and self.ids:
            self.forget()
            new = list(dict.fromkeys(words))
        plain = [w for w in new if w not in self.added]
        special = [w for w in new if w in self.added]
        flat, n = self.merge([w.encode() for w in plain])
        flat = np.concatenate([flat, np.array([self.added[w] for w in special], np.int64)])
        n = np.concatenate([n, np.ones(len(special), np.int64)])
        ends = np.cumsum(n)
        self.ids.update(zip(plain + special, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, ends - n + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.words(t) for t in texts]
        self.learn([w for words in split for w in words])
        out = []
        for words in split:
            at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            out.append(self.flat[spans_of(self.starts[at], self.lengths[at])])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.text_of.__getitem__, ids.tolist()))


OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def bpe_round_trip(df: DataFrame, vocabulary: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), text_col: str = "text") -> DataFrame:
    """``df`` with the ``outputs`` of encoding its texts and decoding the ids again.

    Outputs: n_tokens, ids, decoded, and the SHA-256 of ids (little-endian 32-bit) and of
    the decoded text in UTF-8, for checks that need not carry the ids themselves.
    """

    def start():
        bpe = WordBpe(vocabulary or default_path("word_bpe_49k.json"))

        def work(column: pa.Array) -> list[pa.Array]:
            ids = bpe.encode(text_array(column).to_pylist())
            texts = list(map(bpe.decode, ids)) if {"decoded", "decoded_sha256"} & set(outputs) else []
            made = {
                "n_tokens": lambda: pa.array([len(x) for x in ids], pa.int64()),
                "ids": lambda: pa.array(ids, pa.list_(pa.int32())),
                "decoded": lambda: pa.array(texts, pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            }
            return [made[name]() for name in outputs]

        return work

    return append_columns(df, start, [T.StructField(name, OUTPUTS[name]) for name in outputs], text_col)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
