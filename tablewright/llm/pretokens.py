"""Pre-tokens of byte-level BPE vocabularies and what the library gives for each of them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import regex

# Fixed value: the pattern that this vocabulary family splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters, numbers and white space among the first 256 characters.
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
#: The same pattern over texts of those characters, where the standard library's engine is faster.
NARROW_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: Distinct pre-tokens that a Python worker remembers between blocks; beyond it, it forgets all.
MEMO = 300_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_narrow(text: str) -> bool:
    """Whether all characters are among the first 256."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ids_of_words(tokenizer, added: dict[str, int]) -> Callable[[list[str]], list[list[int]]]:
    """The library's ids of single pre-tokens (an added token is its own id)."""
    letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
    merge = tokenizer.model.tokenize
    return lambda words: [[added[w]] if w in added else [t.id for t in merge(w.encode().decode("latin-1").translate(letters))] for w in words]


class Pretokens:
    """Splits texts as the vocabulary's library does; added tokens stand for themselves."""

    def __init__(self, added: dict[str, int]):
        self.find = regex.compile(PATTERN).findall
        self.find_narrow = re.compile(NARROW_PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.added = added
        self.marks = [x[:2] for x in added]

    def __call__(self, text: str) -> list[str]:
        if self.cut and any(m in text for m in self.marks) and any(a in text for a in self.added):
            out: list[str] = []
            for i, part in enumerate(self.cut(text)):
                if i % 2:
                    out.append(part)
                elif part:
                    out += self.split(part)
            return out
        return self.split(text)

    def split(self, text: str) -> list[str]:
        return self.find_narrow(text) if is_narrow(text) else self.find(text)


def load(path: str):
    """The library's tokenizer, one thread a task: Spark has the others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, {x.content: i for i, x in t.get_added_tokens_decoder().items()}


class Memo:
    """Something computed once per distinct pre-token, in batches, over the blocks of a task."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = MEMO):
        self.compute, self.limit, self.known = compute, limit, {}

    def lookup(self, words: list[str]) -> list:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = list(dict.fromkeys(words))
            known.update(zip(new, self.compute(new), strict=True))
        return list(map(known.__getitem__, words))

