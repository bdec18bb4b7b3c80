"""Chat completions as a column: prompts in, replies out, through an injected client."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any
from urllib import error, parse, request

import pandas as pd
from pyspark.sql import DataFrame

#: What a service can be asked with: type and value if none is given; None means that it isn't sent.
OPTIONS: dict[str, tuple[type, Any]] = {"base_url": (str, ""), "model": (str, ""), "temperature": (float, 0.0), "max_tokens": (int, None), "json_mode": (bool, False), "extra": (dict, None), "timeout": (int, 900), "key_variable": (str, "ATTESTRY_CHAT_KEY")}
#: Options that are taken from the environment where they aren't given, and have to be there.
REQUIRED = {"base_url": "ATTESTRY_CHAT_URL", "model": "ATTESTRY_CHAT_MODEL"}


def checked_options(given: Mapping[str, Any], environ: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """The options with defaults filled in; unknown names, wrong types and missing ones raise ValueError."""
    if unknown := sorted(given.keys() - OPTIONS.keys()):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    out = {}
    for name, (kind, default) in OPTIONS.items():
        value = given.get(name)
        if value is None:
            value = environ.get(REQUIRED[name], "") if name in REQUIRED else default
        if name in REQUIRED and not value:
            raise ValueError(f"{name} is neither given nor in {REQUIRED[name]}")
        if kind is float and isinstance(value, int):
            value = float(value)
        if value is not None and not isinstance(value, kind):
            raise ValueError(f"{name} must be of type {kind.__name__}")
        out[name] = value
    return out


@dataclass(frozen=True)
class Retry:
    """Which answers are worth another attempt, and how long to wait before each."""

    statuses: frozenset[int] = frozenset((408, 429, 500, 502, 503, 504))
    waits: tuple[float, ...] = (3.0, 6.0)

    def worth(self, problem: Exception) -> bool:
        return problem.code in self.statuses if isinstance(problem, error.HTTPError) else isinstance(problem, (error.URLError, TimeoutError, ConnectionError))

    def run(self, call: Callable[[], str]) -> str:
        for wait in (*self.waits, None):
            try:
                return call()
            except (error.URLError, TimeoutError, ConnectionError) as problem:
                if wait is None or not self.worth(problem):
                    raise RuntimeError(f"chat service: HTTP {problem.code}" if isinstance(problem, error.HTTPError) else "the chat service can't be reached") from problem
                time.sleep(wait)
        raise AssertionError


class ChatClient:
    """messages -> the reply's text. It travels to the executors; the key is only read there, from their environment."""

    def __init__(self, options: Mapping[str, Any], retry: Retry = Retry()) -> None:
        self.options, self.retry = dict(options), retry

    def body(self, messages: list[dict]) -> dict:
        o = self.options
        sent = {"model": o["model"], "temperature": o["temperature"], "max_tokens": o["max_tokens"], "response_format": {"type": "json_object"} if o["json_mode"] else None, **(o["extra"] or {})}
        return {"messages": messages} | {k: v for k, v in sent.items() if v is not None}

    def __call__(self, messages: list[dict]) -> str:
        return self.retry.run(lambda: self.once(messages))

    def once(self, messages: list[dict]) -> str:
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.options["key_variable"]):
            headers["Authorization"] = f"Bearer {key}"
        asked = request.Request(self.options["base_url"].rstrip("/") + "/chat/completions", json.dumps(self.body(messages)).encode(), headers)
        with request.urlopen(asked, timeout=self.options["timeout"]) as answer:
            return json.load(answer)["choices"][0]["message"].get("content") or ""

    def provenance(self) -> str:
        """What is stored beside results, as JSON: the host and what was asked for; no address and no key."""
        kept = {k: self.options[k] for k in ("model", "temperature", "max_tokens", "json_mode", "extra")}
        return json.dumps({"host": parse.urlsplit(self.options["base_url"]).netloc, **kept}, sort_keys=True)


def replies(prompts: DataFrame, client: Callable[[list[dict]], str], accept: Callable[[str], list[str]] | None = None, attempts: int = 3, workers: int = 2, repair: Callable[[list[str]], str] | None = None) -> DataFrame:
    """prompts(id, prompt) -> (id, reply, status, attempts, error), `workers` calls at a time.

    accept(reply) returns what is wrong with it; a wrong reply goes back with a repair message. A failed row has a
    status and doesn't fail the others.
    """

    def answered(prompt: str) -> tuple[str | None, int, str]:
        talk, reply, wrong = [{"role": "user", "content": prompt}], None, []
        for n in range(1, attempts + 1):
            try:
                reply = client(talk)
                wrong = accept(reply) if accept else []
            except Exception as e:  # the row's own failure is its result
                return reply, n, f"{type(e).__name__}: {e}"
            if not wrong:
                return reply, n, ""
            talk += [{"role": "assistant", "content": reply}, {"role": "user", "content": (repair or repair_message)(wrong)}]
        return reply, attempts, "; ".join(wrong)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *answered(p)) for i, p in zip(frame["id"], frame["prompt"], strict=True)]
            yield pd.DataFrame([(i, reply, "failed" if wrong else "ok", n, wrong) for i, reply, n, wrong in rows], columns=["id", "reply", "status", "attempts", "error"])

    return prompts.select("id", "prompt").repartition(workers).mapInPandas(run, "id string, reply string, status string, attempts int, error string")


def repair_message(errors: list[str], most: int = 25) -> str:
    return "The reply can't be used. Put right what follows and answer with the whole JSON object again:\n" + "\n".join(f"- {e}" for e in errors[:most])
