import hashlib
import base64

from terralens.llm import warc as A
from terralens.llm.common import scratch

SCHEMA = "page_id long, url string, html string, key string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    root = scratch(spark, "t")
    shards = A.write_index(A.write_archives(df, root, **kw), root, block_lines=4)
    return sorted(A.read_captures(df, root, shards).collect(), key=str), root, shards


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://www.h{i % 5}.Example.org:80/p/{i % 7}?q={i % 3}#f", f"<p>é{i % 11}</p>" * (i % 11)) for i in range(200)]
    rows += [(900, None, "null url"), (901, "", None), (902, "not a url\twith tab\n", ""), (903, "http://[bad", "bad host"), (904, "http://x/" + "y" * 5000, "z" * 200_000)]
    rows += [(950 + i, "http://same.example/", f"own {i}") for i in range(30)]
    got, root, shards = run(spark, rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        f = first[h or ""]
        want.append((i, len((h or "").encode()), b32(h), "response" if f == i else "revisit", None if f == i else f))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    reader = A.CaptureReader(root, shards)
    hit = reader.find(A.url_key("http://same.example/"), 957)
    assert len(hit) == 1 and reader.read(hit[0])[1] == b"own 7"
    assert reader.find(A.url_key("http://same.example/"), 5) == [] and reader.find("zzz", 1) == [] and reader.find("", 1) == []


def test_small_payloads_and_repeated_rows(spark):
    got, _, _ = run(spark, [(1, "u", "a"), (2, "u", "a"), (3, "u", "abcdef"), (4, "v", "abcdef")], min_bytes=3)
    assert [(r.page_id, r.record_type, r.refers_to) for r in sorted(got)] == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    got, _, _ = run(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "w", "b"), (2, "x", "a")])
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "response", None), ("None", "revisit", 1)]


def test_targets_of_revisits_with_odd_urls(spark):
    odd = ["http://a.example/café", "http://a.example/a b", 'http://a.example/?q="x"', "  http://a.example/blank ", "http://a.example/%C3%A9?é=|", "", None, "http://[bad", "http://a.example/\ttab\nline", "//x y", "HTTP://A.example:80/ß#f"]
    rows = [(10 * i, u, f"payload {i}") for i, u in enumerate(odd)] + [(10 * i + 1, "http://other.example/" + str(i), f"payload {i}") for i in range(len(odd))]
    got, _, _ = run(spark, rows)
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in got) == sorted((i, "revisit" if i % 10 else "response", i - 1 if i % 10 else None, b32(h)) for i, _, h in rows)


def test_one_payload_of_many_pages_and_no_payload_is_shuffled(spark, tmp_path):
    rows = [(i, f"http://h{i % 50}.example/{i}", "same" * 500 if i % 3 else f"own {i}") for i in range(3000)]
    got, _, _ = run(spark, rows)
    assert sum(r.record_type == "revisit" for r in got) == 1999 and {r.refers_to for r in got if r.record_type == "revisit"} == {1}
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).select("page_id", "url", "html")
    df.write.parquet(str(tmp_path / "p"))
    plans = []
    keep = A.stash
    try:
        A.stash = lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or keep(d, name)
        A.write_archives(spark.read.parquet(str(tmp_path / "p")), scratch(spark, "t"))
    finally:
        A.stash = keep
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_digests_that_share_a_key(spark, tmp_path):
    import numpy as np

    shas = np.zeros((3, 20), np.uint8)
    shas[1, 19], shas[2, 10] = 1, 1
    shelf = A.Shelf(f"file://{tmp_path}/r", 5, A.Repeats.KINDS)
    out = shelf.writer()
    out.add(0, A.sha_key(shas), shas, [7, 8, 9], [0, 1, 2, 3], b"abc")
    shelf.filled(out.close())
    other = shas[:1].copy()
    other[0, 15] = 9
    assert A.Repeats(shelf).of(np.concatenate((shas[::-1], other))) == [(9, "c"), (8, "b"), (7, "a"), None]


def test_empty_table(spark):
    assert run(spark, [])[0] == []


def test_url_key():
    assert A.url_key("https://www.Blog.example.com/A?B#c") == "com,example,blog)/a?b"
    assert A.url_key("http://a.org:8080") == "org,a:8080)/" and A.url_key(None) == ")/"


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as from '{d}/pages.parquet'")
    want = con.execute(A.SQL).fetchall()
    got = [tuple(r) for r in A.op5_warc(spark, d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
