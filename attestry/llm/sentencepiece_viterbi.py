"""SentencePiece encoding by a streaming Viterbi search over the lattice of pieces, and decoding.

The search keeps one best path for each of the last `longest piece` boundaries. Whenever the back-pointers of all of them
meet in one boundary, the ids up to there are final and are handed out; nothing before it is kept. Paths of a unigram
model are ranked by the sum of their scores. A BPE model has no such sum: there a step is admissible only if the merges
by rank keep its two pieces apart, and for each boundary exactly one admissible path exists, so that the same search
gives the ids of the library's merge loop.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .units import UnitCache, units

SPACE = "▁"
#: What an unknown character costs a unigram path beyond the worst piece, as in the library.
UNKNOWN_COST = 10.0
#: Pairs of pieces whose admissibility a worker keeps.
MEMO_PAIRS = 2_000_000


# Field numbers of the model file, and what its model types are.
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, SUFFIX_BLANKS = 3, 24
CHARACTER_MAP, DUMMY_PREFIX, SQUEEZES_BLANKS, ESCAPES_BLANKS, RULES = 2, 3, 4, 5, 6
KINDS = {1: "unigram", 2: "bpe"}


def message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = varint() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


def checked_kind(path: str) -> str:
    """The model's type; raises ValueError if it normalises texts in a way that the search here doesn't follow."""
    with open(path, "rb") as f:
        parts = {n: dict(message(v)) for n, v in message(f.read()) if n in (TRAINER, NORMALIZER)}
    trainer, rules = parts.get(TRAINER, {}), parts.get(NORMALIZER, {})
    wrong = [name for name, bad in (("a character map", rules.get(CHARACTER_MAP)), ("rules", rules.get(RULES)), ("no blank in front", not rules.get(DUMMY_PREFIX, 1)), ("blanks removed", rules.get(SQUEEZES_BLANKS, 1)), ("blanks not escaped", not rules.get(ESCAPES_BLANKS, 1)), ("blanks behind words", trainer.get(SUFFIX_BLANKS, 0))) if bad]
    kind = KINDS.get(trainer.get(MODEL_TYPE, 1))
    if wrong or kind is None:
        raise ValueError(f"{path}: not supported: {', '.join(wrong) or 'its model type'}")
    return kind


class Model:
    """Pieces of a SentencePiece model file. kind: "bpe" or "unigram", by default what the file says."""

    def __init__(self, path: str, kind: str | None = None) -> None:
        import sentencepiece

        found = checked_kind(path)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.pieces, self.ids, self.score = kind or found, [], {}, []
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            self.pieces.append(piece)
            self.score.append(library.get_score(i))
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = library.unk_id()
        self.fallback = library.is_byte(self.bytes[0])
        self.longest = max(map(len, self.ids))
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0)
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.memo: dict[int, bool] = {}
        self.raw = [b"" if library.is_control(i) else bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def merged(self, text: str) -> list[str]:
        """The merge loop on a short string: the adjacent pair with the best piece first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def admissible(self, before: int, piece: int) -> bool:
        """Whether the merges leave `piece` whole after `before` (-1: at the start, or after an unknown character)."""
        key = (before + 1) << 24 | piece
        found = self.memo.get(key)
        if found is None:
            parts = [self.pieces[piece]] if before < 0 else [self.pieces[before], self.pieces[piece]]
            found = self.merged("".join(parts)) == parts
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            self.memo[key] = found
        return found

    def encode(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters (blanks already replaced by SPACE), handed out as soon as they are final."""
        bpe, ids, score, longest, tails, memo = self.kind == "bpe", self.ids, self.score, self.longest, self.tails, self.memo
        # boundary -> (path score, boundary before, piece id or -1, unknown character)
        back: dict[int, tuple[float, int, int, str]] = {0: (0.0, -1, -1, "")}
        window, j, final = "", 0, 0
        for c in chars:
            window, j = (window + c)[-longest:], j + 1
            best = None
            for n in range(1, len(window) + 1):
                tail = window[-n:]
                if tail not in tails:  # no longer piece ends here either
                    break
                piece = ids.get(tail)
                if piece is None or j - n not in back:
                    continue
                before = back[j - n]
                if bpe:
                    keeps = memo.get((before[2] + 1) << 24 | piece)
                    if self.admissible(before[2], piece) if keeps is None else keeps:
                        best = (0.0, j - n, piece, "")
                        break
                elif best is None or before[0] + score[piece] > best[0]:
                    best = (before[0] + score[piece], j - n, piece, "")
            if c not in ids and j - 1 in back:
                cost = back[j - 1][0] + self.worst - UNKNOWN_COST
                if best is None or not bpe and cost > best[0]:
                    best = (cost, j - 1, -1, c)
            if best is not None:
                back[j] = best
            if j - final > 2 * longest:
                meets = self.meeting(back, j, final)
                if meets > final:
                    yield from self.path(back, meets, final)
                    keep = range(meets, j + 1)
                    back = {k: back[k] for k in keep if k in back}
                    final = meets
        if j:
            yield from self.path(back, j, final)

    def meeting(self, back: dict, j: int, final: int) -> int:
        """The last boundary that the paths to all live boundaries share."""
        at = {k for k in range(max(final, j - self.longest + 1), j + 1) if k in back}
        while len(at) > 1:
            last = max(at)
            at.discard(last)
            at.add(max(final, back[last][1]))
        return at.pop()

    def path(self, back: dict, to: int, since: int) -> list[int]:
        out: list[int] = []
        while to > since:
            _, before, piece, unknown = back[to]
            if piece >= 0:
                out.append(piece)
            elif self.fallback:
                out.extend(self.bytes[b] for b in reversed(unknown.encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            to = before
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces become their bytes, the first blank goes."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Whole texts. No piece spans a blank inside, or a line feed: there all paths meet, so such units can be cached."""

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.model.ids)
        self.by_unit = self.model.kind == "bpe" and not inner
        self.cache = UnitCache(lambda found: [self.stream(u if u[0] == "\n" else SPACE + u) for u in found])

    def stream(self, text: str) -> bytes:
        return np.fromiter(self.model.encode(text), dtype="<u4").tobytes()

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        streamed, found = {}, []
        for i, text in enumerate(texts):
            if text and (not self.by_unit or text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or SPACE in text):
                streamed[i] = self.stream(SPACE + text.replace(" ", SPACE))
            found.append([] if not text or i in streamed else units(text))
        out = self.cache.join(found)
        for i, x in streamed.items():
            out[i] = x
        return out

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker: its cache serves all tasks that the worker runs."""
    return Encoder(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(documents: DataFrame, model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> keep columns (doc_id), token_ids (array<int>), n_tokens, ids_crc32 (little-endian
    32-bit), decoded_chars and round_trip: whether decoding gives the text back.

    One narrow pass without a shuffle. Nulls: a null text is encoded as an empty one (no ids); a null doc_id stays null.
    Equal rows stay separate; an empty table gives no rows; a text of any length is a stream with a bounded window. The
    character U+2581 stands for a blank, as in the library, so a text that holds it doesn't come back the same. A model
    file that normalises texts raises ValueError. keep: columns of documents that stay; clashing names are theirs to avoid.
    """
    path, kept = model or model_path(), keep or ["doc_id"]
    checked_kind(path)
    rows = documents.select(*kept, F.coalesce("text", F.lit("")).alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            texts = b.column("__text").to_pylist()
            raw = encoder.all(texts)
            n = np.array([len(x) // 4 for x in raw], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            back = [encoder.model.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], lists, pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())],
                names=[*kept, "token_ids", "n_tokens", "ids_crc32", "decoded_chars", "round_trip"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return map_batches(rows, each, f"{fields}, token_ids array<int>, n_tokens long, ids_crc32 long, decoded_chars long, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds `text`, the decoded token_ids, in place of any such column.

    Null ids give null, no ids an empty text; an id that the model doesn't have raises IndexError. Equal rows stay
    separate; an empty table gives no rows; other columns stay.
    """
    path, encoded = model or model_path(), encoded.drop("text")
    checked_kind(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Model(path)
        for b in batches:
            texts = [None if x is None else found.decode(x) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, each, f"{fields}, text string")
