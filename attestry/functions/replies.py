"""The JSON object in a language model's reply."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How replies mark their reasoning and fence their JSON.
REASONING = re.compile(r"<think>.*?</think>", re.S | re.I)
FENCED = re.compile(r"```(?:json)?\s*(\{.*\})\s*```", re.S)
#: What matters for balance: a whole string (an open one runs to the end), or a brace.
PARTS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.S)


def first_object(reply: str | None) -> str | None:
    """Text of the first balanced object after any reasoning block, if it is JSON; else null."""
    text = REASONING.sub("", reply or "")
    text = text.split("</think>", 1)[-1]
    if m := FENCED.search(text):
        text = m[1]
    start, depth = text.find("{"), 0
    if start < 0:
        return None
    for part in PARTS.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if not depth:
            found = text[start : part.end()]
            try:
                json.loads(found)
            except ValueError:
                return None
            return found
    return None


@F.pandas_udf(T.StringType())
def reply_json(replies: pd.Series) -> pd.Series:
    return replies.map(first_object)
