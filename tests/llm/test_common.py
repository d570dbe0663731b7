import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import common as C
from terralens.llm import hashindex as H

U64 = np.uint64


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x85 aBé中-", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    data, offs = C.text_bytes(pa.array(texts, pa.string()))
    starts, ends, rows, hashes = C.words(data, offs, lower=True)
    known = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        a, b = rows[i], rows[i + 1]
        assert [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] == raw.split()
        for w, h in zip(raw.lower().split(), hashes[a:b].tolist()):
            assert known.setdefault(w, h) == h  # one hash per word, wherever it stands
    assert len(set(known.values())) == len(known)


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(C, "_PIECE", 64)
    text = " ".join(f"w{i % 50}" for i in range(400))
    data, offs = C.text_bytes(pa.array([text, text, "x" * 500]))
    _, _, rows, h = C.words(data, offs)
    assert len(set(h[: rows[1]].tolist())) == 50 and (h[: rows[1]] == h[rows[1] : rows[2]]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**31)), max_size=50))
def test_pack_round_trip(rows):
    rows = sorted(rows)
    keys = np.array([r[0] for r in rows], U64)
    a, b = C.unpack(C.pack(keys, np.array([r[1] for r in rows], np.int64)), np.int64)
    assert a.tolist() == keys.tolist() and b.tolist() == [r[1] for r in rows]


def test_row_slices():
    assert list(C.row_slices(np.array([0, 5, 5, 30, 31]), 6)) == [(0, 2), (2, 3), (3, 4)]
    assert list(C.row_slices(np.array([0]))) == [] and list(C.row_slices(np.array([0, 0, 0]), 6)) == [(0, 2)]


@pytest.mark.parametrize("part_bits", [0, 2, 14])
def test_shelves(tmp_path, monkeypatch, part_bits):
    """Any number of buckets a file; buckets and whole files that are not there."""
    monkeypatch.setattr(H, "PART_BITS", part_bits)
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(U64) * U64(2))
    bits = 4
    keys = keys[~np.isin(keys >> U64(60), [3, 8, 9, 10, 11])]
    shelf = H.Shelf(f"file://{tmp_path}/x", bits, {"key": U64, "n": np.int64, "raw": np.uint8})
    tops, at = H.bucket_edges(keys, bits)
    out = shelf.writer()
    for t, a, b in zip(tops.tolist(), at[:-1], at[1:]):
        out.add(t, keys[a:b], np.arange(a, b), b"x" * (t + 1))
    parts = out.close()
    assert len(list((tmp_path / "x").iterdir())) == len(parts) == {0: 1, 2: 3, 14: 11}[part_bits]
    shelf.filled(parts)
    assert shelf.get(3) is None and shelf.get(9) is None and shelf.get(4)[2].tobytes() == b"x" * 5
    shelf.kinds = {"key": U64, "n": np.int64, "raw": np.uint8}
    want = np.sort(np.concatenate((keys[::7], keys[::11] + U64(1), (np.arange(16, dtype=U64) << U64(60)) + U64(5))))
    narrow = H.Shelf(f"file://{tmp_path}/y", bits, {"key": U64, "n": np.int64})
    out = narrow.writer()
    for t, a, b in zip(tops.tolist(), at[:-1], at[1:]):
        out.add(t, keys[a:b], np.arange(a, b))
    got = H.find(narrow.filled(out.close()), want)
    inside = np.isin(want, keys)
    assert (got["found"] == inside).all() and (keys[got["n"][inside]] == want[inside]).all()
    assert not H.find(H.Shelf(f"file://{tmp_path}/z", bits, {"key": U64}).filled([]), want)["found"].any()


def test_spool_folds_and_caps():
    batches = [x for x in H.spool([np.array([7, 7, 9], U64), np.array([7], U64), np.zeros(0, U64)], 3, 2)]
    (bucket, blobs), = list(H.by_bucket(batches))
    keys, counts = H.merged(blobs, np.uint8)
    assert bucket == 0 and keys.tolist() == [7, 9] and counts.tolist() == [2, 1]


def test_bitmap():
    for bits in (0, 2, 3, 9):
        for chosen in ([], [0], [0, (1 << bits) - 1], list(range(1 << bits))):
            m = H.bitmap(chosen, bits)
            assert [b for b in range(1 << bits) if H.has(m, b)] == sorted(set(chosen))


def test_buckets_have_no_ceiling():
    assert H.bucket_bits(0) == 5 and H.bucket_bits(100 << 40) == 22 and H.bucket_bits(100 << 40, 16 << 20) == 23
    assert H.flush_size(5) == H.FLUSH and H.flush_size(22) == H.FLUSH_MOST


def test_scratch_is_dropped(spark):
    since = C.scratch_made()
    a, b = (C.stash(spark.range(3), "x") for _ in range(2))
    kept = C._MADE[since]
    C.drop_scratch(spark, since, (kept,))
    assert a.count() == 3 and C.scratch_made() == since + 1
    C.drop_scratch(spark, since)
    assert C.scratch_made() == since
    import os

    assert not os.path.exists(kept.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    class Conf:
        def get(self, key, default=None):
            return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://h:7077")))
