"""SimHash near-duplicates: bit-sliced comparison of fingerprints within buckets, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shuffle_partitions, written

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: A bucket with more fingerprints is dealt out anew by further bits; with 56 bits fixed none has over 256.
BUCKET_ROWS = 4096
#: Fingerprints that are compared at a time: small buckets share such a pool.
POOL_ROWS = 1024
QUERY_ROWS = 256
#: Planes between two looks at which blocks are still within the radius.
LOOK_EVERY = 8
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if over half of the shingles' XXH64 have it. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle_words, len(words))
    first, last, digest = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), HASH_CHUNK):
        h = np.array([digest(joined[a:z], seed) for a, z in zip(first[at : at + HASH_CHUNK], last[at : at + HASH_CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words, seed) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_batches(documents.select("doc_id", "text"), each, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[b] holds bit b of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    width = -len(fps) % 64
    return np.packbits(np.ascontiguousarray(np.pad(bits, ((0, width), (0, 0))).T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (queries x words): which fingerprints lie within the radius of each query.

    Each plane's differences go into vertical counters by carry-save addition, 64 distances at a time. Every few planes,
    blocks in which all distances have passed the radius for every query are dropped.
    """
    words = planes.shape[1]
    live = np.arange(words)
    size = max(1, radius.bit_length())
    counter = [np.zeros((len(queries), words), np.uint64) for _ in range(size)]
    over = np.zeros((len(queries), words), np.uint64)
    varying = [b for b in range(64) if planes[b].any()]
    flat = np.uint64(sum(1 << b for b in range(64) if b not in set(varying)))
    far = np.bitwise_count(queries & flat)  # bits that no fingerprint of the pool has
    for n, b in enumerate(varying, 1):
        ask = (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))[:, None]
        carry = planes[b][None, live] ^ ask
        for c in range(size):
            both = counter[c] & carry
            counter[c] ^= carry
            carry = both
        over |= carry
        if n % LOOK_EVERY == 0 or n == len(varying):
            passed = over | greater(counter, radius)
            keep = (~passed).any(axis=0)
            if not keep.all():
                live, over, counter = live[keep], over[:, keep], [c[:, keep] for c in counter]
                if not len(live):
                    break
    out = np.zeros((len(queries), words), np.uint64)
    if len(live):
        out[:, live] = ~(over | greater(counter, radius))
    out[far > 0] = 0
    return out


def greater(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the vertical counters hold more than the radius."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for c in range(len(counter) - 1, -1, -1):
        if radius >> c & 1:
            same &= counter[c]
        else:
            more |= same & counter[c]
            same &= ~counter[c]
    return more


def groups_within(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the sorted, distinct fingerprints the index of the first one of its group."""
    planes, label = bit_planes(fps), np.arange(len(fps))
    for at in range(0, len(fps), QUERY_ROWS):
        near = within(planes, fps[at : at + QUERY_ROWS], radius)
        for q in np.flatnonzero(np.bitwise_count(near).sum(axis=1) > 1):
            members = np.flatnonzero(np.unpackbits(near[q].view(np.uint8), bitorder="little")[: len(fps)])
            labels = label[members]
            if labels.min() != labels.max():
                to = np.arange(len(fps))
                to[labels] = labels.min()
                label = to[label]
    return label


def dealt(rows: DataFrame, width: int) -> DataFrame:
    """rows(fp, path, fixed, rest of `width` bits), six times each: two of the four blocks of rest move to fixed.

    Two fingerprints that differ in at most two bits have two equal blocks of four, so they meet in at least one of the six.
    """
    w = width // 4
    block = [F.shiftrightunsigned("rest", i * w).bitwiseAND(F.lit((1 << w) - 1)) for i in range(4)]
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]

    def joined(a: Column, b: Column) -> Column:
        return F.shiftleft(a, w).bitwiseOR(b)

    tables = F.array(*[F.struct((F.col("path") * 6 + t).alias("path"), F.shiftleft("fixed", 2 * w).bitwiseOR(joined(block[i], block[j])).alias("fixed"), joined(*[block[k] for k in range(4) if k not in (i, j)]).alias("rest")) for t, (i, j) in enumerate(pairs)])
    return rows.select("fp", F.explode(tables).alias("x")).select("fp", "x.path", "x.fixed", "x.rest")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) -> (u, v): for each fingerprint of a group found in some bucket, v is the first of the group.

    Any two fingerprints within the radius (2 at most) share a bucket. Buckets over BUCKET_ROWS are dealt out anew by
    further bits, which keeps every such pair, so that no bucket grows with the input and none is capped.
    """
    if radius > 2:
        raise ValueError("buckets of two equal blocks of four hold every pair up to radius 2")
    rows, width, ready = dealt(distinct.select("fp", F.lit(1).alias("path"), F.lit(0).cast("long").alias("fixed"), F.col("fp").alias("rest")), 64), 32, []
    while True:
        hot = rows.groupBy("path", "fixed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS).select("path", "fixed") if width >= 16 else None
        if hot is None or not hot.take(1):
            ready.append(rows)
            break
        hot = written(hot, "hot")
        ready.append(rows.join(hot, ["path", "fixed"], "left_anti"))
        rows, width = dealt(rows.join(hot, ["path", "fixed"], "left_semi"), width), width // 2
    keyed = ready[0]
    for more in ready[1:]:
        keyed = keyed.unionByName(more)
    keyed = keyed.select("path", "fixed", "fp").repartition(shuffle_partitions(distinct.sparkSession), "path", "fixed").sortWithinPartitions("path", "fixed")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []

        def found() -> Iterator[pa.RecordBatch]:
            fps = np.unique(np.concatenate(pool)) if pool else np.zeros(0, np.uint64)
            pool.clear()
            if len(fps) > 1:
                first = groups_within(fps, radius)
                moved = np.flatnonzero(first != np.arange(len(fps)))
                yield pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[first[moved]].view(np.int64))], names=["u", "v"])

        held = np.zeros((0, 2), np.int64)
        left = np.zeros(0, np.uint64)
        for b in batches:
            keys = np.stack([b.column("path").to_numpy(zero_copy_only=False).astype(np.int64), b.column("fixed").to_numpy(zero_copy_only=False)], axis=1)
            keys, fps = np.concatenate([held, keys]), np.concatenate([left, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(keys)]
            for a, z in zip(starts[:-1][ends[:-1] - starts[:-1] > 1], ends[:-1][ends[:-1] - starts[:-1] > 1], strict=True):
                pool.append(fps[a:z])
                if sum(map(len, pool)) >= POOL_ROWS:
                    yield from found()
            if len(starts):
                held, left = keys[starts[-1] :], fps[starts[-1] :]
        if len(left) > 1:
            pool.append(left)
        yield from found()

    return keyed.mapInArrow(pooled, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (u, root): the smallest node that each node reaches; nodes without an edge are left out.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and beyond"). Each
    round is written, so lineage stays short. Minima are pre-aggregated; joins on a hot node are split at run time.
    """
    now, mark = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = seen


def near_duplicates(documents: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row for each row.

    Documents whose fingerprints differ in `radius` bits or fewer are linked; component_id is the smallest doc_id that a
    document reaches over links. Equal fingerprints are one node, so that copies are never paired. Nulls: a null text
    and one without words have fingerprint zero and are linked like any others; a null doc_id is never a component's id
    unless it has no other. Equal rows and ids are kept; an empty table gives none. Further columns are ignored.
    """
    rows = written(fingerprints(documents, shingle_words, seed), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), radius)).withColumnRenamed("u", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents without those whose fingerprints are near: of each component the row with the smallest doc_id."""
    return first_of_each(documents, near_duplicates(documents, **options))


def first_of_each(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents without near copies: of each component in groups(doc_id, component_id) the row with the smallest doc_id.

    Of rows that share this id the one with the least text stays. A row without an id can't be named by the decision,
    and stays.
    """
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = documents.join(gone, "doc_id", "left_anti")
    shared = documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if shared.take(1):
        first = kept.join(shared, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
        kept = kept.join(shared, "doc_id", "left_anti").unionByName(first)
    return kept.select(*documents.columns)
