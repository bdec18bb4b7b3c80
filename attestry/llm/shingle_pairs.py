"""Near copies by shared shingles: every pair of texts whose 5-word shingles have a Jaccard similarity of 0.8, exactly.

SimHash fingerprints of the shingles come first: bit-sliced comparison finds those that differ in RADIUS bits or fewer,
and the shingles confirm them, so that copies are linked before anything else is compared. A radius can't promise the
rest: at similarity 0.8 fingerprints differ by 9.7 bits of 64 in the mean, with a deviation of 2.9, and buckets for such
a radius hold nearly all pairs. Further candidates come from the prefix filter: with the shingles of all texts in one
order, two texts that are alike share one of their first n - ceil(0.8 n) + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, map_batches, written
from .simhash import RADIUS, components, links

SHINGLE_WORDS = 5
#: The least similarity as a fraction, so that no rounding decides.
LIKE, OF = 4, 5
SEED = 42
#: Common shingles go last in the order, which only saves time: those that COMMON of one in SAMPLE texts have.
SAMPLE, COMMON, COMMON_MOST = 16, 8, 1_000_000
#: Nodes of candidate pairs that are broadcast: numbers of 8 bytes; with more of them the sets are shuffled.
ASKED_NODES = 1_000_000
#: Members of a bucket beyond which they are not joined into pairs, and beyond which they are dealt out in blocks.
PAIRED, BLOCK_ROWS = 64, 2048
#: Parity bits for each shingle at least, and 64-bit words of them that are compared at a time.
BITS, WORDS = 4, 1 << 20


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> tuple[int, np.ndarray]:
    """A digest of the lower-cased words, and the sorted digests of their shingles; fewer words than k are one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    node = int(np.uint64(digest(joined, SEED + 1)).view(np.int64))
    if not words:
        return node, np.zeros(0, np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(k, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    return node, np.unique(np.array([digest(joined[a:z], SEED) for a, z in zip(first, last, strict=True)], np.uint64).view(np.int64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the shingles' digests have it."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """nodes(node, fp) -> (u, v): each node with the least one of its fingerprint, and those of fingerprints that are near."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = links(firsts.select("fp"), RADIUS)
    one, two = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("u", "v"))
    return same.unionByName(near.join(one, "u").join(two, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))).distinct()


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))


def asked_for(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these nodes, as often as they come. As long as the nodes are few enough to send, the sets of all others stay where they are."""
    asked = written(nodes.distinct(), "asked")
    return sets.join(F.broadcast(asked) if fits_broadcast(asked, ASKED_NODES) else asked, "node", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v) whose sets are alike. sets may repeat a node; those of no pair are not moved."""
    pairs = written(pairs, "candidates")
    sets = asked_for(sets, pairs.select(F.explode(F.array("u", "v")).alias("node"))).dropDuplicates(["node"])
    a, b = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * common >= LIKE * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), each, "u long, v long")


def prefixes(sets: DataFrame) -> DataFrame:
    """(h, node, n): the rarest shingles of each set, n - ceil(0.8 n) + 1 of its n."""
    counted = sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    common = np.array([r.h for r in counted.orderBy(F.desc("count"), "h").limit(COMMON_MOST).collect()], np.int64)[::-1]
    known = sets.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common, kind="stable")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = known.value
        for batch in batches:
            firsts = []
            for x in batch.column("hashes"):
                h = x.values.to_numpy()
                rank = np.full(len(h), -1)
                if len(values):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    rank = np.where(values[at] == h, ranks[at], -1)
                firsts.append(h[np.lexsort((h, rank))[: len(h) - -(-LIKE * len(h) // OF) + 1]] if len(h) else h)
            sizes = np.array([len(f) for f in firsts], np.int64)
            n = pa.array(np.repeat([len(x.values) for x in batch.column("hashes")], sizes).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), sizes), pa.int64()), n], names=["h", "node", "n"])

    return map_batches(sets, each, "h long, node long, n long")


def alike_in_size() -> F.Column:
    return (OF * F.least("n", "m") >= LIKE * F.greatest("n", "m")) & (F.col("u") != F.col("v"))


def enough(shared: DataFrame) -> DataFrame:
    """(u, v) of the pairs that share enough of their prefixes, given a row for each shared shingle.

    Beyond the shared part of the prefixes at most ceil(0.8 n) - 1 shingles of one of the two are common.
    """
    counted = shared.groupBy("u", "v", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    return counted.where((LIKE + OF) * (F.col("c") + F.ceil(F.greatest("n", "m") * LIKE / OF) - 1) >= LIKE * (F.col("n") + F.col("m"))).select("u", "v")


def parity_bits(hashes: np.ndarray) -> bytes:
    """The parities of the digests in a power of two of cells: two sets differ in as many shingles as cells, or more.

    XOR of the two halves gives the parities in half as many cells.
    """
    cells = max(64, 1 << (BITS * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount(hashes & (cells - 1), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def foreign_pairs(bits: list[bytes], n: np.ndarray, root: np.ndarray, every: bool) -> list[tuple[int, int]]:
    """Pairs of members of different groups whose parities don't show that they are unlike: every one, or as many as join the groups, the likest first."""
    width, out = np.array([len(b) // 8 for b in bits]), []
    label = np.unique(root, return_inverse=True)[1]
    size = np.bincount(label)[label]
    for w in np.unique(width).tolist():  # alike sets have equally many cells, or one of them twice as many
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        own = own[np.lexsort((label[own], size[own]))]  # the largest group last, whose members need no comparison
        both, halves = np.r_[own, wide], np.frombuffer(b"".join(bits[i] for i in wide), "<u8").reshape(-1, 2, w)
        planes = np.concatenate([np.frombuffer(b"".join(bits[i] for i in own), "<u8").reshape(-1, w), halves[:, 0] ^ halves[:, 1]])
        step = max(1, WORDS // (len(both) * w))
        for at in range(0, len(own), step):
            rest = both[at:]
            if (label[rest] == label[rest[0]]).all():
                break
            asking = own[at : at + step]
            apart = np.bitwise_count(planes[at : at + len(asking), None] ^ planes[None, at:]).sum(axis=2, dtype=np.int64)
            over = (OF - LIKE) * (n[asking][:, None] + n[rest]) - (LIKE + OF) * apart
            near = (over >= 0) & (label[asking][:, None] != label[rest])
            for q in np.flatnonzero(near.any(axis=1)).tolist():
                found = np.flatnonzero(near[q])
                if not every:
                    found = found[label[rest[found]] != label[asking[q]]]
                    found = found[np.argsort(-over[q, found], kind="stable")]
                    groups, first = np.unique(label[rest[found]], return_index=True)
                    found = found[first]
                    label[np.isin(label, groups)] = label[asking[q]]
                out += [(int(asking[q]), k) for k in rest[found].tolist()]
    return out


def by_bits(members: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """members(h, node, n, root, size) of large buckets -> candidates (u, v) of different roots, see foreign_pairs.

    With every: each pair of a bucket that may be alike. Else fewer than the bucket has members. No pair is a row before
    it is compared; a bucket beyond BLOCK_ROWS is dealt out, so that any two of its blocks meet in one task.
    """

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([parity_bits(x.values.to_numpy()) for x in b.column("hashes")], pa.binary())], names=["node", "bits"])

    def each(rows: pa.Table) -> pa.Table:
        node, n, root = (rows.column(c).to_numpy() for c in ("node", "n", "root"))
        found = np.array(foreign_pairs(rows.column("bits").to_pylist(), n, root, every), np.int64).reshape(-1, 2)
        u, v = node[found[:, 0]], node[found[:, 1]]
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    bits = map_batches(asked_for(sets, members.select("node")), shorter, "node long, bits binary").dropDuplicates(["node"])
    blocks = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS)).withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("h", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "n", "root")
    return blocks.join(bits, "node").groupBy("h", "i", "j").applyInArrow(each, "u long, v long").distinct()


def unsettled(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """(h, node, n, root, size) of the buckets whose members are not all in one group."""
    rooted = buckets.select("h", "node", "n").join(components(edges).withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count(F.lit(1)).alias("size")).where("a <> z").select("h", "size")
    return written(rooted.join(split, "h"), "left")


def near_groups(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, component_id), one row for each row.

    Texts with equal words (ASCII case aside) or a Jaccard similarity of 0.8 or more of their shingles are linked;
    component_id is the smallest doc_id that a document reaches over links. Near fingerprints are confirmed first. Of each
    bucket of texts that share a shingle all are then compared with one of them if they share enough there, so that a
    group of copies costs a row for each; then all pairs that are not yet in one group are: in buckets of PAIRED members
    or fewer as rows, in larger ones by bits (by_bits), first as few as join the groups, then every one that is left.
    Nulls: a null text has no words, as an empty one; a null doc_id is a component's only without others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([fingerprint_of(f[1]) for f in found], pa.int64()), lists([f[1] for f in found])], names=["doc_id", "node", "fp", "hashes"])

    rows = written(map_batches(documents.select("doc_id", "text"), each, "doc_id long, node long, fp long, hashes array<long>"), "shingles")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")), "nodes")
    sets = rows.select("node", "hashes")
    sure = written(verified(by_fingerprint(nodes), sets), "sure")
    held = prefixes(sets).repartition("h")  # one shuffle for both uses
    shared = held.groupBy("h").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("z")).where("p.node <> z").select("h", F.col("p.node").alias("v"), F.col("p.n").alias("m"))
    buckets = written(held.join(shared, "h").distinct(), "buckets")
    pairs = enough(buckets.select(F.col("node").alias("u"), "v", "n", "m").where(alike_in_size()))
    known = components(sure)  # pairs of one group needn't be confirmed
    roots = [known.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root")) for c in ("u", "v")]
    apart = pairs.join(roots[0], "u", "left").join(roots[1], "v", "left").where("coalesce(u_root, u) <> coalesce(v_root, v)").select("u", "v")
    edges = written(sure.unionByName(verified(apart, sets)), "pairs")
    left = unsettled(buckets, edges)
    large, rest = F.col("size") > PAIRED, None
    if left.where(large).take(1):
        edges = written(edges.unionByName(verified(by_bits(left.where(large), sets, every=False), sets)), "pairs")
        left = unsettled(buckets, edges)
        rest = by_bits(left.where(large), sets, every=True)
    small = left.where(~large)
    one, two = small.select("h", F.col("node").alias("u"), "n", F.col("root").alias("r")), small.select("h", F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("s"))
    # a pair that shares a large bucket too may have too few here; it is a candidate there
    paired = enough(one.join(two, "h").where((F.col("r") != F.col("s")) & (F.col("u") < F.col("v")) & alike_in_size()))
    rest = paired if rest is None else paired.unionByName(rest).distinct()
    edges = edges.unionByName(verified(rest, sets))
    named = nodes.drop("fp").join(components(edges).withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
