"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A sketch has three sub-tables; each digest is added to one cell of each, as a count, the XOR of digests and the XOR of
their checksums. Subtracting the sketches of two versions leaves only the digests in which they differ. A cell with one
digest left (count 1 or -1, checksum right) gives it away; taking it out of its other cells uncovers more. If cells are
left in the end, both versions are sketched anew in a larger table with other hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, small, written

#: Cells of each sub-table of the fingerprint itself, and the steps in which differences of two fingerprints are peeled.
BASE_WIDTH = 4
BASE_STEPS = 8
#: A paragraph is a line; longer ones are cut after so many words.
PIECE_WORDS = 32
#: Larger tables: cells of a sub-table for each digest of both versions at first (twice as many each time), rounds of peeling.
WIDTH = 0.5
ROUNDS = 6
#: After so many failures the digests are compared as sets.
LEVELS = 6

#: Rows of one doc_id in a range, beyond which its rows are dealt out to several by the hash of their texts.
SHARE_ROWS = 10_000

# from the first word to the last one, so that blanks, tabs and carriage returns at the ends don't count
PIECE = rf"[^\x20\x09-\x0D]++(?:[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){{0,{PIECE_WORDS - 1}}}+"


def with_digests(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the distinct digests of the paragraphs that have a word; one that comes again counts anew, by how often it came before.

    The sorted digests are a column of their own first: as a part of one expression they would be made anew for each use.
    """
    sorted_ = F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    place = lambda x, i: i - F.array_position("__sorted", x).cast("int") + 1
    again = F.transform("__sorted", lambda x, i: F.when(place(x, i) > 0, F.xxhash64(x, place(x, i))).otherwise(x))
    return rows.withColumn("__sorted", sorted_).withColumn(name, F.when(F.size(F.array_distinct("__sorted")) < F.size("__sorted"), F.array_distinct(again)).otherwise(F.col("__sorted"))).drop("__sorted")


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77))


def base_cell(key: Column, table: int) -> Column:
    return F.shiftrightunsigned(key, 8 * table).bitwiseAND(F.lit(BASE_WIDTH - 1)).cast("int") + table * BASE_WIDTH


def base_sketch(keys: Column) -> Column:
    """array<struct<c: count, k: XOR of digests, h: XOR of checksums>> of 3 * BASE_WIDTH cells."""

    def cell(i: int) -> Column:
        here = F.filter(keys, lambda k: base_cell(k, i // BASE_WIDTH) == i)
        return F.struct(F.size(here).alias("c"), F.reduce(here, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(k)).alias("k"), F.reduce(here, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(check(k))).alias("h"))

    return F.array(*[cell(i) for i in range(3 * BASE_WIDTH)])


def written_out(sketch: Column) -> Column:
    """A sketch as hex digits, nothing cut: for each cell 8 of the count, 16 of the digests, 16 of the checksums."""

    def digits(x: Column, n: int) -> Column:
        return F.lpad(F.hex(x), n, "0")

    return F.lower(F.array_join(F.transform(sketch, lambda x: F.concat(digits(x["c"].cast("long"), 8), digits(x["k"], 16), digits(x["h"], 16))), ""))


def read_sketch(fingerprint: Column) -> Column:
    """The sketch of a fingerprint string: two strings are enough to peel their difference."""

    def number(at: Column, n: int) -> Column:
        high, low = (F.conv(F.substring(fingerprint, at + k, F.lit(n // 2)), 16, 10).cast("long") for k in (0, n // 2))
        return F.shiftleft(high, n * 2).bitwiseOR(low)

    return F.transform(F.sequence(F.lit(0), F.lit(3 * BASE_WIDTH - 1)), lambda i: F.struct(number(i * 40 + 1, 8).cast("int").alias("c"), number(i * 40 + 9, 16).alias("k"), number(i * 40 + 25, 16).alias("h")))


def base_difference(a: Column, b: Column) -> Column:
    """Number of digests in which two sketches differ, by peeling; null if they are too many for it."""
    zero = F.lit(0).cast("long")
    cells = F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))
    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (check(x["k"]) == x["h"]))
        one = F.element_at(pure, 1)

        def without(x: Column, i: Column) -> Column:
            hit = (i == base_cell(one["k"], 0)) | (i == base_cell(one["k"], 1)) | (i == base_cell(one["k"], 2))
            return F.when(hit, F.struct((x["c"] - one["c"]).alias("c"), x["k"].bitwiseXOR(one["k"]).alias("k"), x["h"].bitwiseXOR(one["h"]).alias("h"))).otherwise(x)

        return F.when(F.size(pure) == 0, state).otherwise(F.struct(F.transform(state["cells"], without).alias("cells"), (state["found"] + 1).alias("found")))

    def done(state: Column) -> Column:
        return F.when(F.forall(state["cells"], lambda x: (x["c"] == 0) & (x["k"] == zero) & (x["h"] == zero)), state["found"])

    # most pairs are unrelated: without a single cell to begin with, the steps needn't be tried
    begins = F.exists(cells, lambda x: (F.abs(x["c"]) == 1) & (check(x["k"]) == x["h"]))
    return F.when(a == b, F.lit(0)).when(begins, F.reduce(F.sequence(F.lit(1), F.lit(BASE_STEPS)), start, step, done))


def peeled(pairs: DataFrame, level: int) -> DataFrame:
    """pairs(g, a, b: arrays of digests) -> (g, digest, sign, left): a row for each recovered digest (sign 1: only in a,
    -1: only in b; left 0), and one for each cell that could not be emptied (left 1).

    Rows are dealt out by g once; all that follows is grouped within a task, in as many rows as there are digests.
    """
    width = F.greatest(F.lit(4), F.ceil((F.size("a") + F.size("b")) * WIDTH * 2 ** (level - 1))).cast("long")

    def cell(key: Column, table: int) -> Column:
        return F.lit(table) * F.col("w") + F.pmod(F.xxhash64(key, F.lit(level), F.lit(table)), F.col("w"))

    def signed(keys: str, sign: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))

    rows = pairs.repartition(shuffle_partitions(pairs.sparkSession), "g").select("g", width.alias("w"), F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x")).select("g", "w", F.col("x.k").alias("k"), F.col("x.s").alias("s"))
    rows = rows.select("g", "w", "k", "s", F.explode(F.array(*[cell(F.col("k"), t) for t in range(3)])).alias("cell"))
    live = (F.col("c") != 0) | (F.col("k") != 0) | (F.col("h") != 0)
    cells = rows.groupBy("g", "w", "cell").agg(F.sum("s").alias("c"), F.bit_xor("k").alias("kx"), F.bit_xor(check(F.col("k"))).alias("h")).select("g", "w", "cell", "c", F.col("kx").alias("k"), "h").where(live)
    for _ in range(ROUNDS):
        # a recovered digest is a row with cell -1; `out` is the digest that is to be taken out of a cell
        found = (F.col("cell") >= 0) & (F.abs("c") == 1) & (check(F.col("k")) == F.col("h"))
        none = F.lit(None).cast("long")
        own = F.struct("cell", F.when(F.col("cell") < 0, F.col("k")).otherwise(none).alias("out"), "c", "k", "h")
        gone = [F.struct(at.cast("long").alias("cell"), F.col("k").alias("out"), F.col("c"), F.col("k"), F.col("h")) for at in (F.lit(-1), *[cell(F.col("k"), t) for t in range(3)])]
        rows = cells.select("g", "w", F.explode(F.when(found, F.array(own, *gone)).otherwise(F.array(own))).alias("x")).select("g", "w", "x.*")
        once = rows.groupBy("g", "w", "cell", "out").agg(F.max("c").alias("c"), F.max("k").alias("k"), F.max("h").alias("h"))
        taken = F.col("out").isNotNull() & (F.col("cell") >= 0)
        kept = F.when(F.col("cell") < 0, F.col("out")).otherwise(F.lit(0).cast("long"))
        cells = once.withColumn("own", kept).groupBy("g", "w", "cell", "own").agg(F.sum(F.when(taken, -F.col("c")).otherwise(F.col("c"))).alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where(live | (F.col("cell") < 0)).drop("own")
    return cells.select("g", F.col("k").alias("digest"), F.signum("c").cast("int").alias("sign"), (F.col("cell") >= 0).cast("int").alias("left"))


def differences(pairs: DataFrame) -> DataFrame:
    """pairs(g, a, b) of distinct digests -> (g, only_a, only_b): how many digests only one of the versions has."""
    spark, done, level = pairs.sparkSession, [], 1
    pending = pairs
    while level <= LEVELS:
        counted = peeled(pending, level).groupBy("g").agg(F.count_if((F.col("left") == 0) & (F.col("sign") > 0)).alias("only_a"), F.count_if((F.col("left") == 0) & (F.col("sign") < 0)).alias("only_b"), F.sum("left").alias("left"))
        counted = written(pending.select("g").join(counted, "g", "left").fillna(0), f"peeled{level}")
        done.append(counted.where("left = 0").drop("left"))
        failed = counted.where("left > 0").select("g")
        if not failed.take(1):
            break
        pending, level = pairs.join(failed, "g", "left_semi"), level + 1
    else:
        done.append(pending.select("g", F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.size(F.array_except("b", "a")).cast("long").alias("only_b")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, keys, s, next_text, next_keys, ns): each row, its digests and sketch, and those of the row that follows in ascending doc_id; the first follows the last.

    Rows are dealt out by ranges of doc_id, whose cuts are quantiles of all ids; an id with more than SHARE_ROWS rows, as
    null may be, is dealt out further by ranges of its texts' hashes. A copy of each range's first row is also sent to
    the end of the range before. No join of texts, one shuffle.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100_000)).first()[0] or [])) if parts > 1 else []
    part = F.coalesce(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    hot = written(rows.groupBy("doc_id").count().where(F.col("count") > SHARE_ROWS).select(F.col("doc_id").alias("of"), (F.col("count") / SHARE_ROWS).cast("long").alias("shares")), "hot")
    ids = [r.of for r in hot.where("of is not null").orderBy("of").collect()]  # one for each SHARE_ROWS rows at most
    # in this order come ids below a hot one, its shares, ids above it
    share = F.when(F.col("shares").isNull(), -1).otherwise(F.floor((F.col("hash") / 2.0**64 + 0.5) * F.col("shares")))
    below = F.size(F.filter(F.lit(ids) if ids else F.array().cast("array<long>"), lambda c: c < F.col("doc_id")))
    rows = rows.join(small(hot), F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumns({"below": F.coalesce(below, F.lit(0)), "share": share.cast("long")}).drop("of", "shares")
    ranges = ["part", "below", "share"]
    firsts = rows.groupBy(*ranges).agg(F.min(F.struct("doc_id", "hash")).alias("least")).orderBy(*ranges).collect()  # a row for each range
    columns = ["doc_id", "text", "keys", "s", "next_text", "next_keys", "ns"]
    if not firsts:
        return with_digests(rows, "text", "keys").withColumn("s", base_sketch(F.col("keys"))).withColumns({"next_text": F.col("text"), "next_keys": F.col("keys"), "ns": F.col("s")}).select(*columns).limit(0)
    to = spark.createDataFrame([(r.part, r.below, r.share, *r.least, *firsts[i - 1][:3]) for i, r in enumerate(firsts)], "p int, b int, s long, id long, x long, tp int, tb int, ts long")
    at = (F.col("part") == F.col("p")) & (F.col("below") == F.col("b")) & (F.col("share") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("x"))
    heads = rows.join(small(to), at).groupBy("tp", "tb", "ts").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("hash"), F.col("tp").alias("part"), F.col("tb").alias("below"), F.col("ts").alias("share"), F.lit(1).alias("head"))
    both = with_digests(rows.withColumn("head", F.lit(0)).unionByName(heads), "text", "keys").withColumn("s", base_sketch(F.col("keys")))
    after = Window.partitionBy(*ranges).orderBy("head", F.col("doc_id").asc_nulls_first(), "hash", "text")
    return both.select("head", "doc_id", "text", "keys", "s", *[F.lead(a).over(after).alias(b) for a, b in (("text", "next_text"), ("keys", "next_keys"), ("s", "ns"))]).where("head = 0").select(*columns)


def fingerprints_and_edits(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row.

    Likeness: of the digests of both versions, the share that both have (1 if neither has any), from the number of
    digests recovered by peeling: of the two fingerprints' difference if they hold it, which needs nothing but the
    strings, else of larger tables. Paragraphs count as often as they come, white space at their ends doesn't, nor does
    their order. Nulls: a null text is an empty one; null ids come first. Rows that share an id follow each other by the
    hash of their texts. A single row follows itself; an empty table gives no rows. Further columns are ignored. A long
    text has as many digests as paragraphs; nothing is cut.
    """
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = with_digests(with_next(documents).withColumn("edited", edited), "edited", "edited_keys").withColumn("es", base_sketch(F.col("edited_keys")))
    first = written(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "s", "es", "ns", "keys", "edited_keys", "next_keys"), "sketches"
    ).withColumns({"d_edited": base_difference(F.col("s"), F.col("es")), "d_next": base_difference(F.col("s"), F.col("ns"))})
    first = written(first.select("row", "doc_id", "n_chars", "edited_sha256", written_out(F.col("s")).alias("fingerprint"), written_out(F.col("es")).alias("edited_fingerprint"), "d_edited", "d_next", F.size("keys").alias("n"), F.size("edited_keys").alias("n_edited"), F.size("next_keys").alias("n_next"), "keys", F.when(F.col("d_edited").isNull(), F.col("edited_keys")).alias("edited_keys"), F.when(F.col("d_next").isNull(), F.col("next_keys")).alias("next_keys")), "based")
    pairs = first.select(F.explode(F.array(F.struct((F.col("row") * 2).alias("g"), F.col("keys").alias("a"), F.col("edited_keys").alias("b")), F.struct((F.col("row") * 2 + 1).alias("g"), F.col("keys").alias("a"), F.col("next_keys").alias("b")))).alias("x")).select("x.*").where("b is not null")
    found = differences(pairs).select(F.expr("g div 2").alias("row"), (F.col("g") % 2).alias("of"), (F.col("only_a") + F.col("only_b")).alias("d"))
    found = found.groupBy("row").agg(F.max(F.when(F.col("of") == 0, F.col("d"))).alias("l_edited"), F.max(F.when(F.col("of") == 1, F.col("d"))).alias("l_next"))

    def near(n: str, d: str, later: str) -> Column:
        both, apart = F.col("n") + F.col(n), F.coalesce(F.col(d).cast("long"), F.col(later))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart))

    return first.join(found, "row", "left").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("n_edited", "d_edited", "l_edited").alias("near_edited"), near("n_next", "d_next", "l_next").alias("near_next"))
