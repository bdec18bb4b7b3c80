"""How much of a quote can be found again in a text, for whole batches: windows are gathered first, scored after."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of an anchor, places of each that are looked at, and the shortest quote.
ANCHOR = 4
HITS = 50
LEAST_CHARS = 8
#: Scored pairs that are remembered within a batch.
KEPT = 64


def windows(quote: str, text: str) -> list[tuple[int, int]]:
    """Spans of the text in which the quote may stand: around its first, middle and last characters, a fifth longer each way."""
    size, spans = len(quote), {}
    for place in (0, size // 2 - 2, size - ANCHOR):
        anchor = quote[place : place + ANCHOR]
        shift = quote.index(anchor)
        for hit in islice(re.finditer(f"(?={re.escape(anchor)})", text), HITS):
            begin = hit.start() - shift
            spans[max(0, begin - size // 5), begin + size + size // 5] = None
    return list(spans)


def found_share(quote: str, part: str) -> float:
    """Share of the quote's characters that stand in matching blocks."""
    return sum(block.size for block in SequenceMatcher(a=quote, b=part, autojunk=False).get_matching_blocks()) / len(quote)


def best_ratio(quote: str | None, text: str | None) -> float:
    """The largest share over all windows; 0 for quotes under LEAST_CHARS and nulls."""
    if text is None or len(quote or "") < LEAST_CHARS:
        return 0.0
    return max((found_share(quote, part) for part in {text[a:z] for a, z in windows(quote, text)}), default=0.0)


@F.arrow_udf(T.DoubleType())
def fuzzy_ratio(quotes: pa.Array, texts: pa.Array) -> pa.Array:
    """One text at a time becomes a Python string; a pair that comes again among the last KEPT ones is not scored again."""
    known: dict[tuple[str | None, str | None], float] = {}
    out = []
    for quote, text in zip(quotes, texts, strict=True):
        pair = (quote.as_py(), text.as_py())
        if pair not in known:
            if len(known) >= KEPT:
                known.clear()
            known[pair] = best_ratio(*pair)
        out.append(known[pair])
    return pa.array(out, pa.float64())
