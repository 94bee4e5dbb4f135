import random

import pytest
from tokenizers import Tokenizer

from tablewright.llm import token_counts
from tablewright.llm.pretokens import Pretokens, default_path, is_narrow
from tablewright.llm.token_counts import count_tokens, number_blocks, op6_token_counts, packed, unpacked

ODD = [
    "", " ", "  ", "a", " a  b ", "'s don't 're''s", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|> <|endo", "\x1c\x1d a\x1f", "\x85  a",
    "tab\t\tx\n\n y\r\n", "日本語 テスト", "ßẞ İi ΑΣ Σ", "a​b  c", "12 345 ½ ٣", "é é 🙂👨‍👩‍👧", "x" * 5000, "﻿ a", "᠎ 　z",
]


def library():
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_matches_library_on_odd_texts(spark):
    rnd = random.Random(1)
    pool = [*"aAzÉé 0½'’st\n\t\x0b\x1c\x85  .<|>!-_", "<|endoftext|>", "  ", "ͅ", "ͺ", "ⅷ"]
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(df).collect()}
    t = library()
    for i, text in enumerate(texts):
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 512), repr(text)
    assert (got[None].n_tokens, got[None].n_bytes, got[None].over_limit) == (0, 0, False)


def test_query_against_library(spark, sf_dir):
    t = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op6_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(t.encode(docs[r.doc_id], add_special_tokens=False)) for r in got)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(df).count() == 0
    df = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(df).collect()] == [2, 2, 2]


def test_rare_frequent_and_long_pretokens_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4000)
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 1000)
    rnd = random.Random(3)
    texts = [" ".join(["the", "-" * 80, f"rare{i}x", *(rnd.choice(["of", "and", "z" * 300]) for _ in range(i % 90))]) for i in range(400)] + ["the " * 20000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = number_blocks(df.selectExpr("struct(doc_id) as kept", "text"))
    assert held.count() > 10
    t = library()
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_frequencies_come_back_as_they_were():
    sizes, slots, times = unpacked(packed([2, 0, 3], [7, 0, 70000, 1, 2], [1, 300, 5, 1, 2**31 - 1]), 3)
    assert (list(sizes), list(slots), list(times)) == ([2, 0, 3], [0, 7, 1, 2, 70000], [300, 1, 1, 2**31 - 1, 5])
    assert [len(x) for x in unpacked(packed([0], [], []), 1)] == [1, 0, 0]


def test_columns_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "a b", "k", 5, "w", "m", 9)], "doc_id long, text string, kept string, pieces int, words string, tallies string, n_bytes int")
    row = count_tokens(df).first()
    assert (row.kept, row.pieces, row.words, row.tallies, row.n_bytes, row.n_tokens) == ("k", 5, "w", "m", 3, 2)


@pytest.mark.parametrize("text", ODD)
def test_narrow_pattern_is_the_same_split(text):
    p = Pretokens({})
    if is_narrow(text):
        assert p.find_narrow(text) == p.find(text)


def test_narrow_classes_name_all_first_characters():
    p = Pretokens({})
    for i in range(256):
        for text in (chr(i), "a" + chr(i) + "1", " " + chr(i) + " ", chr(i) * 2 + "b", "1" + chr(i)):
            assert p.find_narrow(text) == p.find(text), i
