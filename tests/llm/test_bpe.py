import hashlib
import random
import struct

from tokenizers import Tokenizer

from tablewright.llm.bpe import WordBpe, bpe_round_trip, op8_bpe_round_trip
from tablewright.llm.pretokens import default_path
from tests.llm.test_token_counts import ODD

PATH = default_path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(2)
    pool = [*"aAzÉé 0½'’st\n\t\x0b\x1c\x85  .<|>!-_ΣσςİıßẞJ", "<|endoftext|>", "<|startoftext|>", "aaa", "hello", "ͅ", "é", "Å", "ⅷ"]
    return ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50))) for _ in range(500)] + ["aaaaaaa", "abababab", "ΑΣ ΑΣΑ"]


def test_matches_library():
    t, bpe = library(), WordBpe(PATH)
    for text in texts():
        ids = bpe.encode([text])
        want = t.encode(text, add_special_tokens=False).ids
        assert ids[0].tolist() == want, repr(text)
        assert bpe.decode(ids[0]) == t.decode(want, skip_special_tokens=False)


def test_operator(spark):
    t, all_texts = library(), texts()
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(all_texts)] + [(-1, None, "")] * 2, "doc_id long, text string, ids string")
    rows = bpe_round_trip(df).collect()
    assert len(rows) == len(all_texts) + 2
    for r in rows:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe_round_trip(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    t = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_bpe_round_trip(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
