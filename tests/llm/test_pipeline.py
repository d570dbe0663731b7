"""The pipeline against plain-Python versions of its stages, on a small table."""

import hashlib
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as C
import test_mixing
import test_near_duplicates
import test_substring
from terralens.llm import bpe, mixing, toxicity
from terralens.llm.common import text_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(tmp_path, spark):
    r = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ra", "to", "mi", "ske", "lu") for b in ("n", "pel", "st", "or", "um", "ja", "")]
    passage = " ".join(r.choices(vocab, k=60))
    rows, labels = [], []
    for i in range(500):
        w = r.choices(vocab, k=r.randrange(5, 120))
        toxic = r.random() < 0.2
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilgrum", "vilgrax", "scabby"]))
        if i % 9 == 0:
            w += passage.split()
        rows.append((i, " ".join(w), r.choice(["en", "fr", "de"]), f"src{r.randrange(6)}"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    for i in range(60):
        w = rows[i * 5][1].split()
        w[len(w) // 2] = "edit"
        rows.append((500 + i, " ".join(w), "en", "src1"))
    rows += [(600, None, "en", "src2"), (601, "", "fr", "src2"), (602, rows[7][1], None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def clean(rows, field):
    out = []
    for row in rows:
        data, offs = text_bytes(pa.array([row[1]], pa.string()))
        t = toxicity.Tokens(data, offs)
        if field.scores(field.tag(t), t.rows)[0] < 0.5:
            out.append(row)
    return out


def test_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = table(tmp_path, spark)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    left = clean(rows, toxicity.trained(docs, labels))
    assert 300 < len(left) < len(rows)
    first = {}
    for row, g in zip(left, test_near_duplicates.groups([x[1] for x in left])):
        first[g] = min(first.get(g, row), row, key=lambda x: x[0])
    left = sorted(first.values())
    cut = test_substring.brute([x[1] for x in left], C.MIN_WORDS)
    kept = [(x[0], None if x[1] is None else [t for t, gone in zip(*c) if not gone], c, *x[2:]) for x, c in zip(left, cut)]
    assert any(any(c[1]) for c in cut)

    got_cut = {x.doc_id: x.text for x in C.cut_passages(spark, spark.createDataFrame([(*x, 0) for x in left], SCHEMA), str(tmp_path)).collect()}
    texts = []
    for i, toks, _, lang, source in kept:
        assert (got_cut[i] or "").split() == (toks or [])
        texts.append((i, got_cut[i], lang, source))
    mixed = {x[0] for x in test_mixing.brute(texts, C.SHARE, mixing.WEIGHTS, 1, mixing.SEED)}
    lib = Tokenizer.from_file(bpe.default_tokenizer())
    want = {}
    for i, t, _, _ in texts:
        if i in mixed:
            ids = lib.encode(t or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in C.run(spark, str(tmp_path)).collect()}
    assert got == want and 0.6 * len(texts) < len(want) < len(texts)


def test_stages_keep_the_columns_and_run_on_nothing(spark, tmp_path):
    table(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("false")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == [], name
