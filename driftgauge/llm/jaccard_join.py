"""Operator 10, n-gram Jaccard join by T-occurrence search.

Two documents link when ``100 * intersection >= percent * union`` of their sets of
word shingles. The join is exact and never emits the pairs of a group:

1. *Sets.* Each task makes its documents' sets of 64-bit shingle hashes. Equal sets
   are one class, known by a 128-bit digest.
2. *Blocks.* Linked sets differ in at most D = floor(size * (100 - percent) / percent)
   shingles. When the hash space is cut into more than D segments, linked sets
   agree on one whole segment at least. Sets of similar size share a cut; the sum of
   the hashes in a non-empty segment is a key. (A set with so many empty segments
   that only those might agree adds, for each of them, the segments of a second
   cut.) Tasks send keys packed, and of a key's list a few entries each: the others
   are known to be shared. A linked set shares at least so many of a set's keys, so
   each set leaves out its longest lists but one of that number, as DivideSkip skips
   long lists. Sets that share a list that is left are joined to the smallest of them.
   The components of those edges are blocks, and every link lies inside a block.
3. *Search.* The texts of blocks of two or more classes are fetched, once for each
   class, by a 128-bit key of the text; while there are at most ``FETCHED`` such keys they
   are broadcast, so that no other text is shuffled. A block of more than ``TILE``
   shingles is cut by size into chunks and searched by pairs of chunks, those of sizes
   that can link only, so a task's memory is bounded. In a tile, each set queries an
   inverted index for the sets that reach the overlap T it needs: DivideSkip merges
   the short lists, keeps what may still reach T, and probes the long lists for those.
   A tile returns one row for each of its sets: a root within the tile and a number
   of links.
4. *Components* of those rows, and of equal digests, are the result.

The lists are merged by counting (an array as long as the tile) where they hold more
than a heap's worth of entries, and by a heap below that.

Edge cases: null, empty and wordless texts have an empty set and link with nothing,
each its own component; with fewer words than a shingle the whole sequence is one;
repeated rows and ties are copies of each other; a text of any length is one set, a
tile of its own where it exceeds ``TILE``; a null id counts as no id: a component's id
is the smallest non-null one, or null; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, spread_join, table, text_of
from .components import components

WORDS, PERCENT = 3, 90
BAND = 1.5
#: Shingles of a tile's chunk, and keys that a task holds before it sends them.
TILE, HELD = 1_000_000, 500_000
#: Entries of a key's list beyond one more than this are known to be shared where they are made, and skip its exchange.
LONG = 1
#: Entries of short lists that are merged by a heap; more are merged by counting.
HEAP = 64
#: Text keys, of sixteen bytes, that are broadcast at most.
FETCHED = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lower-cased."""
    w = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    k = min(words, n)
    rolled = ids[: n - k + 1].copy()
    for i in range(1, k):
        rolled = rolled * _BASE + ids[i : n - k + 1 + i]
    return np.unique(mix(rolled + np.uint64(k)))


class Cuts:
    """How sets of each size are cut into segments."""

    def __init__(self, percent: int, band: float = BAND):
        self.percent, self.edges = percent, [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * band)))

    def differ(self, size: int) -> int:
        """Shingles in which a set of this size and a linked one differ, at most."""
        return size * (100 - self.percent) // self.percent

    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """(band, segments, differing shingles at most) in which a set of this size has keys: its own band, and the one below if a linked set may be there."""
        k = int(np.searchsorted(self.edges, size, "right")) - 1
        bands = [k, *([k - 1] if k and size * self.percent <= 100 * (self.edges[k] - 1) else [])]
        out = []
        for b in bands:
            d = self.differ(self.edges[b + 1] - 1)
            if d:
                out.append((b, d + 2 + d * (90 - self.percent + 6) // 100, min(d, self.differ(size))))
        return out

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set's keys, and how many of them at least any linked set shares (0 if that isn't sure)."""
        found, need = [], 1 << 30
        if not self.differ(len(s)):
            return np.zeros(0, np.uint64), need  # it links with equal sets only
        for band, m, d in self.schemes(len(s)):
            at, sums = _segments(s, m, 1)
            found.append(mix(sums + mix((at + np.uint64(band << 32)) * _BASE)))
            need = min(need, max(0, len(at) - d))  # m - d segments agree, and m - len(at) of them may be empty
            if len(at) <= d:  # perhaps only empty segments agree
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
                at2, sums2 = _segments(s, m, 2)
                second = np.full(m, 7, np.uint64)
                second[at2.astype(np.int64)] = sums2
                second = mix(second + mix((np.arange(m, dtype=np.uint64) + np.uint64((band << 32) | 1 << 62)) * _BASE))
                found.append(mix(second[None, :] + mix(empty + np.uint64(band << 32 | 1 << 61))[:, None]).ravel())
        return np.concatenate(found) if found else np.zeros(0, np.uint64), need


def _segments(s: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty segments and the sums of the hashes in each."""
    h = mix(s + np.uint64(salt * int(_BASE) % (1 << 64)))
    seg = (h >> np.uint64(20)) % np.uint64(m)
    order = np.argsort(seg, kind="stable")
    seg, h = seg[order], h[order]
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return seg[starts], np.add.reduceat(mix(h ^ _BASE), starts)


def _thin(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries by key, with their place in the key's list: up to LONG + 1 of each list, and the (node, key) of the rest."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)
    key, node = key[new], node[new]
    first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    kept = place <= LONG
    return key[kept], node[kept], place[kept], node[~kept], key[~kept].view(np.int64)


_SENT = ["bucket", "long", "blob", "id", "n", "digest", "text_key", "node", "need"]
_KEYS = ["kind", "a", "b", "id", "n", "digest", "text_key", "need"]


def _map(words: int, percent: int, buckets: int):
    def rows(bucket, long, blob, id_type):
        k = len(bucket)
        null = [pa.nulls(k, t) for t in (id_type, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(long, pa.bool_()), pa.array(blob, pa.binary()), *null], _SENT)

    def send(key, node, turn, id_type):
        key, node, _, a, b = _thin(key, node)
        to = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        packed = np.stack([key[order].view(np.int64), node[order]], 1)
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        parts = np.split(packed, cuts) if len(packed) else []
        heads = to[order][np.concatenate(([0], cuts))] if len(packed) else []
        out = [(int(t), False, p.tobytes()) for t, p in zip(heads, parts)]
        for i in range(0, len(a), 50_000):
            out.append(((turn + i // 50_000) % buckets, True, np.stack([a[i : i + 50_000], b[i : i + 50_000]], 1).tobytes()))
        for i in range(0, len(out), 64):
            yield rows(*zip(*out[i : i + 64]), id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, turn = Cuts(percent), 0
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        held, seen = 0, {}
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            id_type = b.schema.field(0).type
            ns, digests, own, needs = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                node = None if digest is None else int.from_bytes(digest[:8], "big", signed=True)
                ns.append(len(s))
                digests.append(digest)
                own.append(node)
                if digest is not None and digest not in seen:
                    k, seen[digest] = cuts.keys(s)
                    keys.append(k)
                    nodes.append(np.full(len(k), node, np.int64))
                    held += len(k)
                needs.append(None if digest is None else seen[digest])
                if held + len(seen) >= HELD:
                    yield from send(np.concatenate(keys), np.concatenate(nodes), turn, id_type)
                    keys, nodes, held, turn, seen = [], [], 0, turn + 1, {}
            k = len(ns)
            spread = pa.array((np.arange(k) + turn) % buckets, pa.int32())
            turn += k
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), b.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), b.column(2), pa.array(own, pa.int64()), pa.array(needs, pa.int32())], _SENT)
        if keys:
            yield from send(np.concatenate(keys), np.concatenate(nodes), turn, id_type)

    return run


def _reduce():
    def rows(kind, a, b, id_type):
        for i in range(0, len(a), 10_000):
            x, y = a[i : i + 10_000], b[i : i + 10_000]
            k = len(x)
            null = [pa.nulls(k, t) for t in (id_type, pa.int64(), pa.binary(), pa.binary(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), *null], _KEYS)

    def finish(key, node, id_type):
        """The shared keys of a bucket."""
        if key:
            k, n, place, x, y = _thin(np.concatenate(key), np.concatenate(node))
            yield from rows(1, x, y, id_type)
            starts = np.flatnonzero(place == 0)
            sizes = np.diff(np.append(starts, len(k)))
            at = np.repeat(sizes, sizes) > 1
            yield from rows(1, n[at], k[at].view(np.int64), id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, held, bucket, id_type = [], [], 0, None, None
        for b in batches:
            long, id_type = b.column(1), b.schema.field(3).type
            if (f := b.filter(long.is_null())).num_rows:
                k = f.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), f.column(7), pa.nulls(k, pa.int64()), *f.columns[3:7], f.column(8)], _KEYS)
            for at, is_long, blob in zip(b.column(0).to_pylist(), long.to_pylist(), b.column(2).to_pylist()):
                if at != bucket:
                    yield from finish(key, node, id_type)
                    key, node, held, bucket = [], [], 0, at
                if blob is None:
                    continue
                pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
                if is_long:
                    yield from rows(1, pairs[:, 0], pairs[:, 1], id_type)
                    continue
                key.append(pairs[:, 0].view(np.uint64))
                node.append(pairs[:, 1])
                held += len(pairs)
                if held >= 8 * HELD:  # long lists are thinned
                    k, n, _, x, y = _thin(np.concatenate(key), np.concatenate(node))
                    yield from rows(1, x, y, id_type)
                    key, node, held = [k], [n], len(k) // 2
        yield from finish(key, node, id_type)

    return run


def block_edges(both: DataFrame) -> DataFrame:
    """Edges (a, b) between sets whose links lie in one block, from the entries (a: set, b: key) of shared keys.

    Any linked set shares at least ``need`` of a set's keys. So each set leaves out its need - 1 longest lists: in
    the order of all keys by length, linked sets still share one. A passage that many documents share makes a few
    long lists for each, which go first, and doesn't tie unlike documents together.
    """
    entries = materialise(both.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct(), "jaccard-entries")
    total = entries.count()
    length = entries.groupBy("key").agg(F.count("*").alias("length"))
    need = both.where("kind = 0 AND a IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.min("need").alias("need"))
    measured = spread_join(entries, length, "key", "length", total, ["node"]).select("node", "key", F.col("found.length").alias("length"))
    ranked = measured.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("length").desc(), "key")))
    kept = materialise(ranked.join(need, "node").where(F.col("place") >= F.col("need")).select("node", "key"), "jaccard-kept")
    roots = kept.groupBy("key").agg(F.min("node").alias("root"), F.count("*").alias("length"))
    out = spread_join(kept, roots, "key", "length", total, ["node"]).where("node <> found.root").select(F.col("node").alias("a"), F.col("found.root").alias("b"))
    return out


def with_tiles(active: DataFrame, percent: int) -> DataFrame:
    """``active`` (digest, n, block and more) with ``chunk`` and ``tiles``, the pairs (i, j) of chunks of its block in which a set is searched.

    A block of at most ``TILE`` shingles is one tile. A larger one is cut by size; sets of one size that exceed a
    chunk are dealt by their digest. Chunks are in order of size, so those that can link to one are neighbours of it.
    """
    rows = active.count()
    totals = materialise(active.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("rows")), "jaccard-blocks")
    sized = spread_join(active, totals, "block", "rows", rows, ["digest"]).select("*", F.col("found.total").alias("total")).drop("found")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    small = sized.where(F.col("total") <= TILE).drop("total").select("*", F.lit(0).alias("chunk"), one.alias("tiles"))
    large = sized.where(F.col("total") > TILE).drop("total").withColumn("size", F.struct("block", "n"))
    held = large.groupBy("size").agg(F.sum("n").alias("held"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("size.block").orderBy("size.n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = materialise(held.withColumn("before", before), "jaccard-sizes")
    part = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = spread_join(large, held, "size", "rows", rows, ["digest"])
    cut = cut.withColumn("chunk", F.floor((F.col("found.before") + part * F.col("found.held")) / TILE).cast("int")).drop("found", "size")
    chunks = materialise(cut.groupBy("block", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("rows")), "jaccard-chunks")
    x, y = chunks.alias("x"), chunks.alias("y")
    meet = (F.col("x.block") == F.col("y.block")) & (F.col("x.chunk") <= F.col("y.chunk")) & (F.col("y.low") * percent <= F.col("x.high") * 100)
    pairs = x.join(y, meet).select(F.col("x.block").alias("block"), F.struct(F.col("x.chunk").alias("i"), F.col("y.chunk").alias("j")).alias("tile"))
    ends = pairs.select("block", "tile", F.explode(F.array_distinct(F.array("tile.i", "tile.j"))).alias("chunk"))
    tiles = ends.groupBy("block", "chunk").agg(F.collect_list("tile").alias("tiles")).join(chunks, ["block", "chunk"])
    tiles = materialise(tiles.select(F.struct("block", "chunk").alias("part"), "tiles", "rows"), "jaccard-tiles")
    found = spread_join(cut.withColumn("part", F.struct("block", "chunk")), tiles, "part", "rows", rows, ["digest"])
    return small.unionByName(found.select(*small.columns[:-1], F.col("found.tiles").alias("tiles")))


def required(a: int, b: np.ndarray | int, percent: int):
    """Overlap that sets of these sizes need to link."""
    return -(-(percent * (a + b)) // (100 + percent))


def search(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, its linked later sets). side, where given: sets of one side aren't matched with each other."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")  # small sets first: lists are sorted by size
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), sizes[order])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    heads, bounds = tokens[starts], np.append(starts, len(tokens))
    lengths = np.diff(bounds)
    ordered, sides = sizes[order], None if side is None else side[order]
    for q in range(n):
        s = sets[order[q]]
        t = -(-percent * len(s) // 100)  # no linked set needs less: the union is this set at least
        lists = np.searchsorted(heads, s)
        lists = lists[lengths[lists] > 1]
        if len(lists) < t:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        longest = int(lengths[lists[-1]])
        long = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)))
        short = lists[: len(lists) - long]
        parts = [owner[bounds[x] : bounds[x + 1]] for x in short]
        if sum(map(len, parts)) <= HEAP:
            counts = np.zeros(n, np.int64)
            for x in heapq.merge(*parts):
                counts[x] += 1
        else:
            counts = np.bincount(np.concatenate(parts), minlength=n)
        last = int(np.searchsorted(ordered, len(s) * 100 // percent, "right"))
        cand = np.flatnonzero(counts[q + 1 : last] >= t - long) + q + 1
        if sides is not None:
            cand = cand[sides[cand] != sides[q]]
        left = long
        for x in lists[len(lists) - long :]:
            if not len(cand):
                break
            left -= 1
            members = owner[bounds[x] : bounds[x + 1]]
            at = np.searchsorted(members, cand)
            at[at == len(members)] = 0
            counts[cand] += members[at] == cand
            if left % 16 == 0:
                cand = cand[counts[cand] + left >= required(len(s), ordered[cand], percent)]
        cand = cand[counts[cand] >= required(len(s), ordered[cand], percent)]
        if len(cand):
            yield int(order[q]), order[cand]


def _tile(percent: int):
    names = ["digest", "root", "links"]

    def solve(rows: list[tuple[bytes, bytes, int, int]], cross: bool) -> pa.RecordBatch:
        digests = [r[0] for r in rows]
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        copies, side = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]) if cross else None
        parent, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for q, found in search(sets, side, percent):
            links[q] += copies[found].sum()
            links[found] += copies[q]
            for r in found.tolist():
                a, b = find(q), find(r)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = [digests[find(i)] for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(roots, pa.binary()), pa.array(links)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, seen = None, [], set()
        for b in batches:
            for block, i, j, digest, s, copies, chunk in zip(*(c.to_pylist() for c in b.columns)):
                if (block, i, j) != tile:
                    if len(rows) > 1:
                        yield solve(rows, tile[1] != tile[2])
                    tile, rows, seen = (block, i, j), [], set()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, s, copies, chunk))
        if len(rows) > 1:
            yield solve(rows, tile[1] != tile[2])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            at, sets = [], []
            for row, (text, digest) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                s = shingle_set(text, words)
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    at.append(row)
                    sets.append(s.tobytes())
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array(sets, pa.binary())], ["digest", "block", "chunk", "tiles", "copies", "set"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id, n_links of every row. The id may be of any orderable type."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_map(words, percent, buckets), f"bucket int, long boolean, blob binary, id {kind}, n long, digest binary, text_key binary, node long, need int")
    both = materialise(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_reduce(), f"kind int, a long, b long, id {kind}, n long, digest binary, text_key binary, need int"), "jaccard-keys")
    features = both.where("kind = 0").select("id", "n", "digest", "text_key")
    total = features.count()
    classes = materialise(features.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"), F.max("n").alias("n")), "jaccard-classes")
    node = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")  # the digest's first eight bytes, signed
    blocks = components(block_edges(both))
    active = materialise(classes.select("digest", "text_key", "n", "copies", node.alias("node")).join(blocks, "node").select("digest", "text_key", "n", "copies", F.col("label").alias("block")), "jaccard-active")
    wanted = active.select("text_key").distinct()
    fetched = texts.join(F.broadcast(wanted), "text_key", "left_semi") if active.count() <= FETCHED else texts
    once = fetched.groupBy("text_key").agg(F.first("text").alias("text"))
    sets = once.join(with_tiles(active, percent), "text_key").select("text", "digest", "block", "chunk", "tiles", "copies")
    sets = sets.mapInArrow(_sets(words), "digest binary, block long, chunk int, tiles array<struct<i:int,j:int>>, copies long, set binary")
    tiles = sets.withColumn("tile", F.explode("tiles")).select("block", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "digest", "set", "copies", "chunk")
    solved = materialise(tiles.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_tile(percent), "digest binary, root binary, links long"), "jaccard-links")
    merged = components(solved.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = solved.groupBy("digest").agg(F.sum("links").alias("links"))
    linked = classes.join(merged, F.col("digest") == F.col("node"), "left").select("digest", "low", "copies", F.coalesce("label", "digest").alias("label"))
    lowest = linked.groupBy("label").agg(F.min("low").alias("component"), F.count("*").alias("rows"))
    named = spread_join(linked, lowest, "label", "rows", total, ["digest"]).select("digest", "copies", F.col("found.component").alias("component"))
    known = materialise(named.join(links, "digest", "left").select("digest", "copies", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-known")
    release(spark)
    out = spread_join(features, known, "digest", "copies", total, ["id"]).select("id", "n", "digest", F.col("found.component").alias("component_id"), F.col("found.n_links").alias("n_links"))
    alone = F.col("digest").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
