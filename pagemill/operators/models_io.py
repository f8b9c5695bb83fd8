"""Calls of external models, one page a call, through a client that the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.routing import failed_text

RESULT = "source_path string, page_number int, prompt_hash bigint, markdown string, provider string, input_tokens bigint, output_tokens bigint, error string"


class ModelError(Exception):
    """A refusal of the provider; only this leads to the fallback."""


@dataclass(frozen=True)
class Answer:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


#: model name, prompt, content -> answer. It runs on executors, so it must be picklable and open its own connections.
Client = Callable[[str, str, bytes], Answer]


def echo(model: str, prompt: str, content: bytes) -> Answer:
    """A client without a network: the content itself, a token for each four bytes."""
    text = content.decode("utf-8", "replace")
    return Answer(text, len(prompt) // 4, len(content) // 4)


#: What a model is told before the prompt of a page.
SYSTEM = "You turn pages into Markdown. Give the page's own text and nothing else."


def parsed_reply(reply: dict) -> Answer:
    """The answer in a chat completion; counts that are missing are none."""
    used = reply.get("usage") or {}
    return Answer(reply["choices"][0]["message"]["content"] or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0))


@dataclass(frozen=True)
class Endpoint:
    """Where a model is asked, by its name in the catalogue. Keys are read where the call is made."""

    name: str
    model_id: str
    base_url: str
    key_env: str
    max_tokens: int = 8192
    temperature: float = 0.1
    input_price: float = 0.0
    output_price: float = 0.0


@dataclass(frozen=True)
class HttpClient:
    """A client of chat completions over HTTP. Pictures go as addresses that hold them, scaled to ``most`` pixels; text goes as text, with the
    prompt as instruction. A status other than 200 is a ModelError; a timeout or a reply that can't be read is another error."""

    endpoints: dict[str, Endpoint]
    timeout: float = 60.0
    most: int = 4096

    def payload(self, to: Endpoint, prompt: str, content: bytes) -> dict:
        from pagemill.sources.decoders import image_size
        from pagemill.sources.pictures import data_url, fitted

        if image_size(content) is None:
            messages = [{"role": "system", "content": prompt}, {"role": "user", "content": content.decode("utf-8", "replace")}]
        else:
            parts = [{"type": "image_url", "image_url": {"url": data_url(fitted(content, self.most))}}, {"type": "text", "text": prompt}]
            messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": parts}]
        return {"model": to.model_id, "messages": messages, "max_tokens": to.max_tokens, "temperature": to.temperature}

    def __call__(self, model: str, prompt: str, content: bytes) -> Answer:
        import json
        from urllib import error, request

        from pagemill.sources.catalogue import key_of

        to = self.endpoints[model]
        body = json.dumps(self.payload(to, prompt, content)).encode("utf-8")
        asked = request.Request(f"{to.base_url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key_of(to.key_env)}", "Content-Type": "application/json"})
        try:
            with request.urlopen(asked, timeout=self.timeout) as got:
                return parsed_reply(json.loads(got.read()))
        except error.HTTPError as e:
            raise ModelError(f"{to.name} API error: {e.code} - {e.read().decode('utf-8', 'replace')}") from None


@dataclass(frozen=True)
class Models:
    """A client with the model it asks first and the one it asks after a refusal."""

    client: Client
    primary: str
    fallback: str | None = None
    prices: tuple[tuple[str, float, float], ...] = ()  # model, input and output price in dollars per million tokens


def configured(catalogue: dict, override: str = "", timeout: float = 60.0, most: int = 4096) -> Models:
    """The models that a catalogue's keys allow: ``override`` alone, else the primary with its fallback, else the fallback alone.

    A model of ``override`` that is missing or has no key is an error, and so is a catalogue none of whose two models has one.
    """
    from pagemill.sources.catalogue import key_of

    ends = {}
    for name, m in catalogue.get("models", {}).items():
        p = catalogue.get("providers", {}).get(m["provider"])
        if p and key_of(p["api_key_env"]):
            price = m.get("pricing", {})
            ends[name] = Endpoint(f"{m['provider']}/{name}", m["model_id"], p["base_url"], p["api_key_env"], int(m.get("max_tokens", 8192)), float(m.get("temperature", 0.1)), float(price.get("input", 0.0)), float(price.get("output", 0.0)))
    defaults = catalogue.get("defaults", {})
    if override:
        if override not in ends:
            raise ValueError(f"Model '{override}' not found or not configured. Available models: {', '.join(catalogue.get('models', {}))}")
        order = [override]
    else:
        order = [n for n in (defaults.get("primary"), defaults.get("fallback")) if n in ends]
        if not order:
            raise ValueError("No model provider is configured: set the key of one in the environment")
    return Models(HttpClient(ends, timeout, most), order[0], order[1] if len(order) > 1 else None, tuple((n, e.input_price, e.output_price) for n, e in ends.items()))


def extracted(pages: DataFrame, client: Client, primary: str, fallback: str | None = None, at_once: int = 10, done=None) -> DataFrame:
    """Pages (source_path, page_number, prompt, content) read by a model, ``at_once`` calls a task.

    A ModelError goes on to ``fallback``; any other failure becomes the page's text and error with provider 'error'. Write the result to a
    table before it is read twice, and take off pages already there with ``unanswered``: a retried task asks again. ``done`` is an accumulator
    that counts the pages.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RESULT))

    def ask(row: tuple) -> tuple:
        path, page, h, prompt, content = row
        for model in filter(None, (primary, fallback)):
            try:
                a = client(model, prompt, content or b"")
                return path, page, h, a.text, model, a.input_tokens, a.output_tokens, None
            except ModelError as e:
                error = str(e)
            except Exception as e:  # a page's failure stays with the page
                error = str(e) or type(e).__name__
                break
        return path, page, h, None, "error", 0, 0, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
                if rows:
                    answers = list(zip(*pool.map(ask, rows)))
                    if done is not None:
                        done.add(len(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(answers, schema)], schema=schema)

    asked = pages.select("source_path", "page_number", F.xxhash64("prompt").alias("prompt_hash"), "prompt", "content").mapInArrow(run, RESULT)
    return asked.withColumn("markdown", F.when(F.col("error").isNotNull(), failed_text(F.col("error"))).otherwise(F.col("markdown")))


def unanswered(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages without an answer to their prompt yet."""
    keyed = pages.withColumn("prompt_hash", F.xxhash64("prompt"))
    return keyed.join(answers.filter("error is null").select("source_path", "page_number", "prompt_hash"), ["source_path", "page_number", "prompt_hash"], "left_anti").drop("prompt_hash")


def measured(client: Client) -> Client:
    """``client`` with the seconds of each call on stderr."""

    def call(model: str, prompt: str, content: bytes) -> Answer:
        import sys

        begin = time.monotonic()
        try:
            return client(model, prompt, content)
        finally:
            print(f"{model}: {time.monotonic() - begin:.2f} s", file=sys.stderr)

    return call
