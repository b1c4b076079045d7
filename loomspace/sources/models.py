"""Embedders and text generators: HTTP clients with a transport that can be replaced, and offline stand-ins."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sends a JSON body to a URL and gives the answer's body.
Transport = Callable[[str, bytes], bytes]


#: Seconds that a request may take, and how often one is sent that fails on the way or is refused by a busy server.
TIMEOUT, TRIES = 120.0, 3


def post(url: str, body: bytes, timeout: float = TIMEOUT, tries: int = TRIES) -> bytes:
    """The answer to a JSON body. Timeouts, broken connections and answers 429 and 5xx are tried again after a pause that doubles; other answers are errors at once."""
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                return answer.read()
        except OSError as e:
            passing = not isinstance(e, urllib.error.HTTPError) or e.code == 429 or e.code >= 500
            if not left or not passing:
                raise
            time.sleep(2.0 ** (tries - 1 - left))
    raise ValueError("tries has to be 1 or more")


class HttpEmbedder:
    """POST {base}/api/embed with model and input; the first vector of the answer. No vector is an error."""

    def __init__(self, base_url: str, model: str, transport: Transport = post):
        self.url, self.model, self.transport = f"{base_url}/api/embed", model, transport

    def body(self, text: str) -> bytes:
        return json.dumps({"model": self.model, "input": text}).encode()

    @staticmethod
    def first(answer: bytes) -> list[float]:
        vectors = json.loads(answer)["embeddings"]
        if not vectors:
            raise ValueError("the answer holds no embedding")
        return vectors[0]

    def __call__(self, text: str) -> list[float]:
        return self.first(self.transport(self.url, self.body(text)))


class HttpGenerator:
    """POST {base}/api/chat without streaming; the content of the answer's message."""

    def __init__(self, base_url: str, model: str, transport: Transport = post):
        self.url, self.model, self.transport = f"{base_url}/api/chat", model, transport

    def body(self, prompt: str) -> bytes:
        return json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False}).encode()

    def __call__(self, prompt: str) -> str:
        return json.loads(self.transport(self.url, self.body(prompt)))["message"]["content"]


class Extract:
    """Offline generator: the first line of the excerpts, or the description, of a prompt; no model, so nothing can be made up."""

    def __call__(self, prompt: str) -> str:
        for mark, end in (("TEXT EXCERPTS:\n", "\n"), ("Description: ", "\n"), ("FACTS:\n", "\n\nQUESTION")):
            if mark in prompt:
                found = prompt.split(mark, 1)[1].split(end, 1)[0].strip()
                return " ".join(found.split()[:3]) if mark.startswith("Desc") else found
        return ""


def hashed_embedding(term: F.Column, dimension: int = 64):
    """Offline embedding in SQL functions alone: component j is read from md5(term:j), then the vector is brought to length 1. It carries no meaning."""
    parts = [(F.conv(F.substring(F.md5(F.concat(term, F.lit(f":{j}"))), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - 1) for j in range(dimension)]
    return F.transform(F.array(F.array(*parts)), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))))[0]


def mapped(rows: DataFrame, column: str, function: Callable[[str], object], name: str, kind: str) -> DataFrame:
    """rows with `name`: the function of each value of `column`, called in the executors, one batch at a time. The first failure fails the run."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` {kind}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(**{name: [function(x) for x in part[column]]})

    return rows.mapInPandas(run, schema)
