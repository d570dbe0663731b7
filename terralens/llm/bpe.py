"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is split into short words by the byte-level pattern. Per word two arrays
are held: the ids of the current parts (the part boundaries) and the ranks of
adjacent parts. The smallest rank is sought again and again, the boundary below
it is deleted and its two neighbouring ranks are refreshed. A long word, for
which rescanning would be quadratic, keeps the same merges in a heap over linked
parts. Words repeat, so each worker remembers a bounded number of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.common import released

#: Longest word, in bytes, for the rescanned array.
SHORT = 128
#: Most words a worker remembers; beyond that it starts anew.
CACHE_WORDS = 250_000
_NONE = 1 << 60

# The byte-level split pattern of the vocabulary's family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that the installed regex knows as letters or numbers
# and the tokenizer's older Unicode tables do not.
YOUNG = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 "
    "AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


def _young_class() -> str:
    return "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in (r.split("-") for r in YOUNG.split()))


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: a byte
    that prints stands for itself, the others take code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairCodec:
    """Encoder and decoder of a ``tokenizers`` byte-level BPE file, given as its JSON text."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        vocab, merges = doc["model"]["vocab"], doc["model"]["merges"]
        alphabet = byte_alphabet()
        self.token_bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [0] * 256
        for i, t in self.token_bytes.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 24 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.split = regex.compile(PATTERN).findall
        young = _young_class()
        self.has_young = regex.compile(f"[{young}]").search
        self.beyond_latin = regex.compile("[՘-\U0010ffff]").search
        careful = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{young}])")
        careful = careful.replace(r" ?\p{L}+", f" ?(?:(?![{young}])\\p{{L}})+").replace(r" ?\p{N}+", f" ?(?:(?![{young}])\\p{{N}})+")
        self.split_careful = regex.compile(careful).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: str) -> tuple[int, ...]:
        byte_ids = self.byte_ids
        parts = [byte_ids[b] for b in word.encode()]
        n = len(parts)
        if n > SHORT:
            return self._encode_long(parts)
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 24 | b, _NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            new = merged[low]
            parts[i] = new
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 24 | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << 24 | parts[i + 1], _NONE)
        return tuple(parts)

    def _encode_long(self, parts: list[int]) -> tuple[int, ...]:
        get, merged, n = self.ranks.get, self.merged, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 24 | parts[i + 1])) is not None]
        heapq.heapify(heap)

        def push(i, j):
            if (r := get(parts[i] << 24 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = merged[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return tuple(p for p in parts if p >= 0)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become their ids."""
        out: list[int] = []
        pieces = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else (text,)
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(self.special[piece])
                continue
            plain = piece.isascii() or not (self.beyond_latin(piece) and self.has_young(piece))
            found = self.split(piece) if plain else self.split_careful(piece)
            known = self.known
            missing = set(found).difference(known)
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = set(found)
            for w in missing:
                known[w] = self.encode_word(w)
            out.extend(chain.from_iterable(map(known.__getitem__, found)))
            for w in missing:
                if len(w) > SHORT:
                    del known[w]
        return out

    def decode(self, ids) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, BytePairCodec] = {}
_SCHEMA = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _codec(spec) -> BytePairCodec:
    key = hashlib.sha1(spec.value.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(spec.value)
    return _CODECS[key]


def _mapped(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, row, schema: pa.Schema, ddl: str) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: a file of fixed size

    def run(batches):
        codec = _codec(spec)
        for batch in batches:
            keys, texts, done, size = batch.column(0).to_pylist(), batch.column(1), [], 0
            for i, k in enumerate(keys):
                text = texts[i].as_py() or ""
                done.append((k, *row(codec, text)))
                size += len(text)
                if size > 4 << 20 or i + 1 == len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                    done, size = [], 0

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), ddl).withColumnRenamed("id", id_col)


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row, in one pass without a shuffle.

    A null text counts as empty: no ids, empty decoded text. Repeated rows give
    repeated results, an empty table an empty one; extra columns are not read.
    """
    def row(codec, text):
        ids = codec.encode(text)
        return len(ids), ids, codec.decode(ids)

    return _mapped(df, tokenizer_path, id_col, text_col, row, _SCHEMA, "id long, n_tokens long, ids array<int>, decoded string")


def token_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text."""
    def row(codec, text):
        ids = codec.encode(text)
        little = array("I", ids)
        if sys.byteorder == "big":
            little.byteswap()
        return len(ids), hashlib.sha256(little).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(df, tokenizer_path, id_col, text_col, row, schema, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


SQL = None
