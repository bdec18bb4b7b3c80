"""Token ids in Parquet list columns: delta encoding, controlled row groups and pages with indexes, selective reads."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, shuffle_partitions, small
from .units import CACHE_CHARS, ODD_SPACE, UnitCache, units

END_ID = 2
#: Rows of one doc_id beyond which they may be cut into several files.
HOT_ROWS = 10_000
#: Bytes of a row group and of a page; the page is what a reader of a few documents has to decode.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
#: New units that go to the library in one text.
JOINED_UNITS = 128
#: Punctuation that stands behind words, and how many stretches of it a worker keeps.
PUNCTUATION = '.,;:!?#$%&*()[]|<>"-/'
MOST_TAILS = 10_000
#: White space in ASCII other than blanks and line feeds.
ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(8)
def check_vocabulary(path: str) -> None:
    """Raises ValueError unless the file is a byte-level BPE without a normaliser, for which units are independent."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    split, model = found.get("pre_tokenizer") or {}, found["model"]
    if found.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("type") != "BPE" or model.get("dropout") or found.get("truncation"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")


def odd_space(text: str) -> bool:
    """Whether a text has white space other than blanks and line feeds; in ASCII there are few, and looking for each is quicker than the pattern."""
    return any(c in text for c in ODD_ASCII) if text.isascii() else ODD_SPACE.search(text) is not None


class ByteBpe:
    """The tokenizers library over cached units.

    A byte-level BPE splits off a blank with the word that follows, and a single line feed by itself, before any merge,
    so units are independent. Texts with other white space, or with runs of it, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        check_vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.feed = self.by_library(["\n"])[0]
        self.cache, self.tails = UnitCache(self.new_units), {}

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def new_units(self, found: list[str]) -> list[bytes]:
        """A word with punctuation behind it is a word and a stretch of its own: the word is often known already."""
        out: list[bytes] = [b""] * len(found)
        whole, open_at, cores = [], [], {}
        young, old, tails = self.cache.young, self.cache.old, self.tails
        for i, u in enumerate(found):
            if u.isalpha() or not (core := u.rstrip(PUNCTUATION)).isalpha():
                whole.append(i)
                continue
            tail = u[len(core) :]
            end = tails.get(tail)
            if end is None:
                if len(tails) > MOST_TAILS:
                    tails.clear()
                end = tails[tail] = self.by_library([tail])[0]
            ids = young.get(core) or old.get(core)
            if ids is None:
                open_at.append((i, core, end))
                cores[core] = None
            else:
                out[i] = ids + end
        new = [found[i] for i in whole]
        rest = list(cores.keys() - set(new)) if cores else []
        encoded = self.units_by_library(new + rest)
        for i, x in zip(whole, encoded, strict=False):  # the cores come after them
            out[i] = x
        if cores:
            ids = dict(zip(new + rest, encoded, strict=True))
            young.update((c, ids[c]) for c in rest if len(c) <= CACHE_CHARS)
            for i, core, end in open_at:
                out[i] = ids[core] + end
        return out

    def units_by_library(self, found: list[str]) -> list[bytes]:
        """New units, many in one text: a line feed between them keeps them apart and marks where each ends."""
        if not found:
            return []
        bare = [u[1:] if u[0] in "\r\n" else " " + u for u in found]
        if len(self.feed) != 4:
            bare_ids = self.by_library(bare)
        else:
            texts = ["\n".join(bare[i : i + JOINED_UNITS]) for i in range(0, len(bare), JOINED_UNITS)]
            feed, bare_ids = int.from_bytes(self.feed, "little"), []
            for raw in self.by_library(texts):
                ends = (np.flatnonzero(np.frombuffer(raw, dtype="<u4") == feed) * 4).tolist()
                bare_ids += [raw[a:z] for a, z in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)]
        return [self.feed + x if u[0] == "\n" else x for u, x in zip(found, bare_ids, strict=True)]

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        whole, found = {}, []
        for i, text in enumerate(texts):
            if text and (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "<|" in text or odd_space(text)):
                whole[i] = self.by_library([text])[0]
            if not text or i in whole:
                found.append([])
            else:
                found.append(units(text))
                found[-1][0] = "\r" + found[-1][0]  # no blank before the first word; a carriage return is odd space, so no unit starts with one
        out = self.cache.join(found)
        for i, x in whole.items():
            out[i] = x
        return out

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


@lru_cache(1)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker: its cache serves all tasks that the worker runs."""
    return ByteBpe(path)


def encoded(documents: DataFrame, vocab: str, end_id: int = END_ID) -> DataFrame:
    """Rows in ascending doc_id order with token_ids (array<int>), n_tokens, and where they start in their file."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c for c in ("lang", "source") if c in documents.columns])
    # an id with many rows, as null may be, fills several files; only then cuts need the texts, and the order is the same
    hot = documents.groupBy("doc_id").count().where(F.col("count") > HOT_ROWS).take(1)
    cuts = ["doc_id"] + [F.substring("text", 1, 64)] * bool(hot)
    rows = rows.repartitionByRange(shuffle_partitions(documents.sparkSession), *cuts).sortWithinPartitions("doc_id", "text").withColumn("file", F.spark_partition_id())
    meta = [c for c in rows.columns if c not in ("doc_id", "text", "file")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe, end, at = byte_bpe(vocab), np.array([end_id], dtype="<u4").tobytes(), 0
        for b in batches:
            ids = [x + end for x in bpe.all(b.column("text").to_pylist())]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in meta], pa.array(n), pa.array(at + ends - n, pa.int64()), lists, b.column("file")], names=["doc_id", *meta, "n_tokens", "start_in_file", "token_ids", "file"])
            at += int(ends[-1]) if len(ends) else 0

    return map_batches(rows, encode, "doc_id long, " + "".join(f"{c} string, " for c in meta) + "n_tokens long, start_in_file long, token_ids array<int>, file int")


def write_token_files(documents: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID) -> str:
    """Writes documents(doc_id, text, ...) as token files under path, and returns path.

    Format: Parquet, version-2 pages; ids and offsets delta-encoded, strings by dictionary; row groups of
    ROW_GROUP_BYTES, pages of PAGE_BYTES, with column and offset indexes, so that a filter on doc_id, lang or source
    reads only the pages that hold such rows, and a read of metadata never touches ids. File k holds ids before file k+1.
    Nulls: a null text is an empty document (its end id only); a null doc_id sorts first; equal ids are separate
    documents, in order of their texts. An empty table gives a folder without rows. Long texts are encoded whole.
    Strings of special tokens follow the library's default: `<|endoftext|>` in a text becomes that token.
    """
    check_vocabulary(vocab or vocabulary())
    encoded(documents, vocab or vocabulary(), end_id).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#token_ids.list.element", "false").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", 1000).parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files with `start`, the number of ids in all documents before; prune columns and filter as usual."""
    files = spark.read.parquet(path)
    from pyspark.sql import Window

    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("file", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return files.join(small(offsets), "file").withColumn("start", F.col("off") + F.col("start_in_file")).drop("off", "start_in_file", "file")


def crc_of_ids(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows with token_ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("token_ids")
            raw = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8).data
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            to = np.cumsum(n) * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n), pa.array([zlib.crc32(raw[z - 4 * k : z]) for z, k in zip(to.tolist(), n.tolist(), strict=True)], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("doc_id", "start", "token_ids"), crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, vocab: str | None = None) -> DataFrame:
    """Writes token files in the shared folder and returns the digest of what is read back."""
    spark = documents.sparkSession
    return crc_of_ids(read_token_files(spark, write_token_files(documents, new_path(spark, "tokens"), vocab)))
