import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")

from terralens.llm import bpe as B  # noqa: E402

PATH = B.default_tokenizer()
OWN = B.BytePairCodec(open(PATH, encoding="utf-8").read())
LIB = tokenizers.Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids string"


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


def test_chosen_texts():
    for text in ("", " ", "\n\n  x", "I'll don't 'S it's", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endo", "naïve café ½ ²³ ١٢٣ Ⅷ 中文 한국어 🙂👍🏽", "\x85x\x1cy z　", "àb", "x" * 3000, "ab" * 900 + " " * 700, "é" * 500, "9" * 700, "".join(map(chr, range(0x20, 0x2000)))):
        same(text)
    for lo, hi in (r.split("-") for r in B.YOUNG.split()):
        for c in {int(lo, 16), int(hi, 16), int(lo, 16) - 1, int(hi, 16) + 1}:
            same(f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}?")


def test_short_and_long_words_agree():
    r = random.Random(1)
    for n in (2, 5, 40, 127, 128):
        word = "".join(r.choice("aeinrst") for _ in range(n))
        assert OWN.encode_word(word) == OWN._encode_long([OWN.byte_ids[b] for b in word.encode()])


def test_decode_of_broken_bytes():
    ids = [OWN.byte_ids[0xC3], OWN.byte_ids[0x28], OWN.byte_ids[0xE2]]
    assert OWN.decode(ids) == "�(�" == LIB.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello, world", "x"), (3, "Hello, world", "x"), (None, "é " * 5000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.decoded): r for r in B.encode_decode(df, PATH).collect()}
    for i, t, _ in rows:
        r = got[i, t or ""]
        assert r.ids == LIB.encode(t or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    d = B.token_digests(df, PATH).filter("doc_id = 3").first()
    assert d.ids_sha256 == hashlib.sha256(np.array(got[3, "Hello, world"].ids, "<u4").tobytes()).hexdigest()
    assert B.encode_decode(df.filter("false"), PATH).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in B.op9_bpe(spark, d).collect():
        ids = LIB.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
