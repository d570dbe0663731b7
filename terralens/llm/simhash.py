"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share most bits. Groups of
neighbours form nodes; a node keeps, as mask and pattern, the bits that all its
fingerprints share and its parent does not already hold. A query adds up its
differences from the root down and leaves a whole group as soon as they exceed the
radius. The work is dealt out by bits that two fingerprints within the radius must
share for one way of choosing them; each block of fingerprints that share them has an
index of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import hashindex as hx
from terralens.llm.common import U64, drop_path, filesystem, mix64, released, scratch, stash
from terralens.llm.graph import components

# --------------------------------------------------------------------------
# fingerprints


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, A-Z folded and joined by a space;
    of all words if there are fewer than k, and none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, U64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= k:
        return np.array([digest(joined, 42)], U64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in pairs], U64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(U64)[0])


def fingerprints(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, the 64 bits as a signed long; a null text counts as empty."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([simhash(shingle_hashes(x.as_py(), k)) for x in b.column(1)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), "id long, fp long")


# --------------------------------------------------------------------------
# the index


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    g = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> U64(s)
    return g


class GrayIndex:
    """Tree over Gray-sorted fingerprints; levels from the root's children to the leaves."""

    def __init__(self, fps: np.ndarray, fanout: int = 16):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        pattern, free = self.fps, np.zeros(len(fps), U64)
        levels = [(pattern, free)]
        while len(pattern) > fanout:
            at = np.arange(0, len(pattern), fanout)
            heads = np.repeat(pattern[at], np.diff(np.append(at, len(pattern))))
            # bits on which the group disagrees, or that are free in one of its parts
            free = np.bitwise_or.reduceat((pattern ^ heads) | free, at)
            pattern = pattern[at]
            levels.append((pattern, free))
        self.levels, self.fanout = [], fanout
        levels.reverse()
        for depth, (pattern, free) in enumerate(levels):
            mask = ~free
            if depth:  # what the parent holds is factored out
                above = ~levels[depth - 1][1]
                mask &= ~np.repeat(above, fanout)[: len(mask)]
            self.levels.append((pattern, mask))

    def search(self, queries: np.ndarray, radius: int, room: int = 1 << 21):
        """Batches (query numbers, fingerprint numbers) of all pairs within the radius."""
        step = max(1, room // max(1, len(self.levels[0][0])))
        stack = []
        for lo in range(0, len(queries), step):
            q = np.arange(lo, min(lo + step, len(queries)))
            n = len(self.levels[0][0])
            stack.append((0, np.repeat(q, n), np.tile(np.arange(n), len(q)), None))
            while stack:
                depth, q_at, node, acc = stack.pop()
                if len(q_at) > room:  # deep and wide: take it in parts
                    h = len(q_at) // 2
                    stack += [(depth, q_at[i], node[i], None if acc is None else acc[i]) for i in (slice(h, None), slice(h))]
                    continue
                pattern, mask = self.levels[depth]
                d = np.bitwise_count((queries[q_at] ^ pattern[node]) & mask[node])
                if acc is not None:
                    d = d + acc
                ok = d <= radius
                q_at, node, acc = q_at[ok], node[ok], d[ok]
                if not len(q_at):
                    continue
                if depth + 1 == len(self.levels):
                    yield q_at, node
                    continue
                below = len(self.levels[depth + 1][0])
                kids = (node[:, None] * self.fanout + np.arange(self.fanout)).reshape(-1)
                real = kids < below
                stack.append((depth + 1, np.repeat(q_at, self.fanout)[real], kids[real], np.repeat(acc, self.fanout)[real]))


class Joined:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] and b[i], by lowering labels until none changes."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _block_links(batches, radius):
    """Links of a block from rows sorted by (block, salt, visitor): a star within
    each local component, and one link from a visitor to each it touches."""
    names = ["a", "b"]
    state = {"key": None, "members": [], "index": None, "joined": None, "guests": [], "n": 0}

    def out(a, b):
        if len(a):
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names)

    def ready():
        if state["index"] is None:
            index = state["index"] = GrayIndex(np.concatenate(state["members"]) if state["members"] else np.zeros(0, U64))
            joined = state["joined"] = Joined(len(index.fps))
            if len(index.fps) > 1:
                for q, m in index.search(index.fps, radius):
                    joined.add(q[q < m], m[q < m])
            own = np.flatnonzero(joined.root != np.arange(len(index.fps)))
            return out(index.fps[own], index.fps[joined.root[own]])

    def visited():
        guests = np.concatenate(state["guests"])
        state["guests"], state["n"] = [], 0
        index, joined = state["index"], state["joined"]
        if len(index.fps):
            for q, m in index.search(guests, radius):
                yield out(guests[q], index.fps[joined.root[m]])

    def finish():
        if state["key"] is not None:
            yield ready()
            if state["guests"]:
                yield from visited()

    def run():
        for b in batches:
            block, salt, guest, fp = (np.asarray(c) for c in (x.to_numpy(zero_copy_only=False) for x in b.columns))
            if not len(fp):
                continue
            fp = fp.astype(np.int64).view(U64)
            at = np.append(np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (salt[1:] != salt[:-1]) | (guest[1:] != guest[:-1])))), len(fp))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                key = (block[lo], salt[lo])
                if key != state["key"]:
                    yield from finish()
                    state.update(key=key, members=[], index=None, joined=None, guests=[], n=0)
                if not guest[lo]:
                    state["members"].append(fp[lo:hi].copy())
                    continue
                yield ready()
                state["guests"].append(fp[lo:hi].copy())
                state["n"] += hi - lo
                if state["n"] > 1 << 16:
                    yield from visited()
        yield from finish()

    yield from (x for x in run() if x is not None)


def block_masks(total: int, radius: int, block_size: int) -> list[list[tuple[int, int]]]:
    """Ways to choose bits of which two fingerprints within the radius have all equal,
    for one way at least: the 64 bits are cut into more pieces than the radius, and all
    but ``radius`` of them are chosen. A way is a list of (lowest bit, width). More and
    thus longer choices are taken for more fingerprints, so that blocks stay small."""
    pieces = radius + 1
    while True:
        edges = [64 * i // pieces for i in range(pieces + 1)]
        ways = [[(edges[k], edges[k + 1] - edges[k]) for k in c] for c in combinations(range(pieces), pieces - radius)]
        if total <= block_size << min(sum(w for _, w in way) for way in ways) or pieces == radius + 4:
            return ways
        pieces += 1


def fingerprint_links(nodes: DataFrame, radius: int = 2, block_size: int = 512, hot: int = 1 << 16) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect all pairs
    within the radius, though not pair by pair.

    A block holds fingerprints that agree in chosen bits, and a Gray-order index of its
    own; a fingerprint stands in as many blocks as there are ways to choose, three for
    a radius of 2 and up to a billion fingerprints. A block of more than ``hot`` of them
    is split by salt; its parts visit each other.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not radius:  # distinct ones differ
        return spark.createDataFrame([], "a long, b long")
    keys = []
    for n, way in enumerate(block_masks(nodes.count(), radius, block_size)):
        key = F.lit(n).cast("long")
        for low, width in way:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    placed = nodes.select("fp", F.explode(F.array(*keys)).alias("block"))
    # blocks over the limit only: few, as each stands for that many fingerprints
    crowded = placed.groupBy("block").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot)
    crowded = stash(crowded.select("block", F.ceil(F.col("c") / hot).cast("int").alias("salts")), "crowded-blocks")
    placed = placed.join(crowded, "block", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    inner = placed.filter("salts > 1").withColumn("other", F.explode(F.sequence(F.col("salt"), F.col("salts") - 1))).filter("other > salt")
    rows = placed.select("block", "salt", F.lit(0).alias("guest"), "fp").unionByName(inner.select("block", F.col("other").alias("salt"), F.lit(1).alias("guest"), "fp"))
    dealt = rows.repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", "guest")
    return dealt.mapInArrow(released(lambda it: _block_links(it, radius)), "a long, b long")


def near_fingerprints(df: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): fingerprints link at ``radius`` or fewer differing bits;
    component is the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows share a component. A null id is passed over when the smallest is sought.
    An empty table gives an empty result; extra columns are not read.
    """
    rows = stash(fingerprints(df, k, id_col, text_col), "fingerprints")
    nodes = stash(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = components(fingerprint_links(nodes, radius))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(named, "root").select("fp", "component")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


SQL = None


# --------------------------------------------------------------------------
# near-duplicate texts at a similarity

#: Candidates: BANDS runs of BAND least hashes. A pair at similarity 0.8 shares a
#: band with probability 1 - (1 - 0.8**4)**20, all but three in a hundred thousand.
BANDS, BAND = 20, 4
#: Members of a bucket that one task compares among themselves.
CROWD = 2048
_PERMUTE = mix64(np.arange(1, BANDS * BAND + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SETS = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("content", pa.int64()), ("file", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS_DDL = "rid long, id long, content long, file int, start long, n long, fp long, bands array<long>"


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands of a shingle set; an empty set has one key of its own."""
    if not len(shingles):
        return np.zeros(1, np.int64)
    with np.errstate(over="ignore"):
        # an odd factor permutes the 64-bit numbers
        least = np.full(BANDS * BAND, U64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[i : i + 2048] * _PERMUTE[:, None]).min(axis=1), out=least)
        rows, key = least.reshape(BANDS, BAND), np.arange(1, BANDS + 1, dtype=U64)
        for i in range(BAND):
            key = mix64(key + rows[:, i])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shingle_sets(df: DataFrame, root: str, k: int, rid_col: str, id_col: str, text_col: str) -> DataFrame:
    """Fingerprint, bands and shingle set of every row; the sets go to files below
    ``root`` (32-bit hashes, sorted), the rows tell where."""
    def run(batches):
        from pyspark import TaskContext

        name = TaskContext.get().partitionId()
        fsys, path = filesystem(f"{root}/sets-{name}")
        fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp, at, out = f"{path}.{TaskContext.get().taskAttemptId()}.tmp", 0, None
        for b in batches:
            rows = []
            for rid, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                out = out or fsys.open_output_stream(tmp)
                h = shingle_hashes(text.as_py(), k)
                full = np.unique(h)
                part = np.unique((full >> U64(32)).astype(np.uint32))
                out.write(part.tobytes())
                content = int(np.array([xxhash.xxh64_intdigest(full.tobytes(), 7)], U64).view(np.int64)[0])
                rows.append((rid, key, content, name, at, len(part), int(np.array([simhash(h)], U64).view(np.int64)[0]), band_keys(full).tolist()))
                at += len(part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SETS.types, strict=True)], schema=_SETS)
        if out is not None:
            out.close()
            fsys.move(tmp, path)

    src = df.select(F.col(rid_col).alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(released(run), _SETS_DDL)


def _linked(root: str, threshold: float):
    """Links within parts of buckets, of rows (key, salt, guest, rid, file, start, n)
    sorted by the first three. From the first member on, what is similar is linked and
    in turn compared with those not yet linked, so all of a component is found, with no
    pair of members linked already compared. A guest, a member of another part, is then
    linked to one member of each component that it is similar to."""
    def take(row):
        return hx.Column.get(f"{root}/sets-{row[1]}", np.uint32)[row[2] : row[2] + row[3]]

    # sets of too different a size cannot be similar enough; fingerprints rule nothing
    # out, as they count repeated shingles and sets do not
    def near(sizes, n):
        return np.flatnonzero(np.minimum(sizes, n) >= threshold * np.maximum(sizes, n)).tolist()

    class Part:
        def __init__(self, rows, out):
            self.rows, self.sizes = rows, np.array([r[3] for r in rows], np.int64)
            self.component = np.arange(len(rows))
            open_ = np.arange(len(rows))
            while len(open_) > 1:
                first, open_ = int(open_[0]), open_[1:]
                front = [first]
                while front and len(open_):
                    i = front.pop()
                    mine = take(rows[i])
                    hit = [n for n in near(self.sizes[open_], len(mine)) if similarity(mine, take(rows[open_[n]])) >= threshold]
                    found = open_[hit]
                    self.component[found] = first
                    out += [(rows[i][0], rows[j][0]) for j in found.tolist()]
                    front += found.tolist()
                    open_ = np.delete(open_, hit)

        def visit(self, row, out):
            mine, met = take(row), set()
            for j in near(self.sizes, len(mine)):
                c = int(self.component[j])
                if c not in met and similarity(mine, take(self.rows[j])) >= threshold:
                    met.add(c)
                    out.append((row[0], self.rows[j][0]))

    def run(batches):
        out, now, members, part = [], None, [], None

        def batch():
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            for key, salt, guest, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(out) > 100_000:
                    yield batch()
                if (key, salt) != now:
                    if part is None and len(members) > 1:
                        Part(members, out)
                    now, members, part = (key, salt), [], None
                if not guest:
                    members.append(row)
                    continue
                part = part or Part(members, out)
                part.visit(row, out)
        if part is None and len(members) > 1:
            Part(members, out)
        if out:
            yield batch()
        hx.Column.close(root)

    return run


def near_duplicate_groups(df: DataFrame, rid_col: str, k: int = 5, threshold: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, keep): rows of one group share ``keep``, the row that stays, which is
    that of the smallest id (null last), then of the smallest rid.

    Texts link if the Jaccard similarity of their sets of k-word shingles is at
    least ``threshold``; groups are the connected components. Fingerprints within
    ``radius`` bits come from the Gray-order index; since a 64-bit fingerprint is
    far wider apart at 0.8, bands of least hashes bring further candidates. Every
    link is checked on the sets. Texts with equal sets are one member from the
    start; all texts without a word are equal. ``rid`` is a unique long.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = scratch(spark, "sets")
    rows = stash(shingle_sets(df, root, k, rid_col, id_col, text_col), "set-rows")
    one = F.min(F.struct("rid", "file", "start", "n", "fp", "bands")).alias("one")
    reps = stash(rows.groupBy("content").agg(one).select("content", "one.*"), "set-reps")

    banded = reps.select(F.explode("bands").alias("key"), "rid", "file", "start", "n")
    # the index's links as buckets: a component of close fingerprints is one bucket
    nodes = reps.select("fp").distinct()
    close = components(fingerprint_links(nodes, radius))
    indexed = reps.join(close, reps.fp == close.node).select(F.xxhash64("root", F.lit("fp")).alias("key"), "rid", "file", "start", "n")
    same = reps.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp")
    equal = reps.join(same, "fp").select(F.xxhash64("fp", F.lit("eq")).alias("key"), "rid", "file", "start", "n")
    listed = banded.unionByName(indexed).unionByName(equal)
    # a bucket of more than CROWD rows is split by salt; each part visits those after it
    crowded = listed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWD)
    crowded = stash(crowded.select("key", F.ceil(F.col("c") / CROWD).cast("int").alias("salts")), "crowded")
    row = ["rid", "file", "start", "n"]
    placed = listed.join(crowded, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
    guests = placed.filter("salts > 1").withColumn("other", F.explode(F.sequence(F.col("salt"), F.col("salts") - 1))).filter("other > salt")
    rows_ = placed.select("key", "salt", F.lit(0).alias("guest"), *row).unionByName(guests.select("key", F.col("other").alias("salt"), F.lit(1).alias("guest"), *row))
    dealt = rows_.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "guest", "rid")
    found = components(dealt.mapInArrow(released(_linked(root, threshold)), "a long, b long"))  # writes them, so the sets can go
    drop_path(spark, root)

    classes = reps.join(found, reps.rid == found.node, "left").select("content", F.coalesce("root", "rid").alias("class"))
    # written, so that the join by class below meets plain exchanges, whose large partitions can be split
    placed = stash(rows.select("rid", "id", "content").join(classes, "content").select("rid", "id", "class"), "classes")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("least")
    keep = stash(placed.groupBy("class").agg(least).select("class", F.col("least.rid").alias("keep")), "kept")
    return placed.join(keep, "class").select("rid", "id", "keep")


def drop_near_duplicates(df: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each near-duplicate group, all columns.

    The table is written once with a row number; the numbers that go are sorted
    hash arrays, which the workers search while they read the table again, so the
    texts are not shuffled.
    """
    spark = df.sparkSession
    rid = "__rid"
    while rid in df.columns:
        rid += "_"
    numbered = stash(df.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicate_groups(numbered, rid, k, threshold, id_col=id_col, text_col=text_col).filter("rid <> keep").select("rid")
    bits = hx.bucket_bits(8 * numbered.count())
    dead = scratch(spark, "gone")

    def keys(batches):
        yield from hx.spool((mix64(b.column(0).to_numpy().view(U64)) for b in batches), bits, 1)

    dropped = hx.written(gone.mapInArrow(released(keys), hx.BLOBS_DDL), dead, 1, bits)
    at = numbered.columns.index(rid)

    def run(batches):
        for b in batches:
            key = mix64(b.column(at).to_numpy().view(U64))
            order = np.argsort(key)
            there = np.zeros(len(key), bool)
            there[order] = hx.find(dropped, key[order])["found"]
            kept = b.filter(pa.array(~there))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(kept.columns) if i != at], names=[n for i, n in enumerate(kept.schema.names) if i != at])
        hx.Column.close(dead)

    return numbered.mapInArrow(released(run), df.schema)
