"""Language-model adapters, and calls of them over tables.

An adapter completes one prompt.  Calls are paid, slow and not repeatable, so a table of prompts goes through
``complete_all``, which keeps a log of replies by a hash of all that a call depends on.  A task asks for one prompt, or for ``per_task`` of them, and its replies are in the
log when the task ends, whatever becomes of the job; so a task that is lost repeats its own calls only, and a run that failed goes on, in the same
folder, with the prompts that have no reply yet.  Equal prompts are asked once.
"""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import Files

log = logging.getLogger("memspool.models")
TIMEOUT_S = 600


class Adapter(Protocol):
    name: str
    model: str

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str: ...


@dataclass
class ScriptedAdapter:
    """Replies by rule: the first rule whose key is in the prompt; for tests and offline runs.

    A reply is a text or a function of the prompt and the system prompt.
    """

    rules: list[tuple[str, str | Callable[[str, str | None], str]]]
    default: str = "{}"
    name: str = "scripted"
    model: str = "scripted"
    #: Its calls cost nothing.
    per_task: int = 1000

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        for key, reply in self.rules:
            if key in prompt:
                return reply(prompt, system) if callable(reply) else reply
        return self.default


@dataclass
class HttpAdapter:
    """One blocking POST for each prompt, without retries; what a provider expects is in three functions."""

    name: str
    model: str
    url: str
    body: Callable[[str, str, str | None, bool], dict]
    answer: Callable[[dict], str]
    headers: dict[str, str] = field(default_factory=dict)
    timeout_s: float = TIMEOUT_S

    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str:
        began = time.monotonic()
        data = json.dumps(self.body(self.model, prompt, system, json_mode)).encode()
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json", **self.headers}, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
            out = self.answer(json.load(reply))
        log.info("model call: %s %s, %d characters in, %d out, %.1f s", self.name, self.model, len(prompt), len(out), time.monotonic() - began)
        return out


def _local_body(model: str, prompt: str, system: str | None, json_mode: bool) -> dict:
    body: dict = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": 0, "num_predict": 4096}}
    return body | ({"system": system} if system else {}) | ({"format": "json"} if json_mode else {})


def _chat_body(model: str, prompt: str, system: str | None, json_mode: bool) -> dict:
    said = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
    return {"model": model, "messages": said, "temperature": 0} | ({"response_format": {"type": "json_object"}} if json_mode else {})


def _messages_body(model: str, prompt: str, system: str | None, json_mode: bool) -> dict:
    asked = prompt + "\nAnswer with valid JSON alone, without code fences." * json_mode
    return {"model": model, "max_tokens": 2048, "messages": [{"role": "user", "content": asked}]} | ({"system": system} if system else {})


def adapter_from_env(env: dict[str, str] | None = None) -> HttpAdapter:
    """The adapter that ``MEMSPOOL_ADAPTER`` (ollama, openai or anthropic), ``_MODEL``, ``_BASE_URL`` and ``_API_KEY`` describe."""
    e = os.environ if env is None else env
    kind, key = e.get("MEMSPOOL_ADAPTER", "ollama"), e.get("MEMSPOOL_API_KEY", "")
    base, model = e.get("MEMSPOOL_BASE_URL", "").rstrip("/"), e.get("MEMSPOOL_MODEL", "")
    if kind == "ollama":
        return HttpAdapter(kind, model or "llama3.1:8b", (base or "http://localhost:11434") + "/api/generate", _local_body, lambda r: str(r["response"]))
    if kind == "openai":
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        return HttpAdapter(kind, model or "gpt-4o-mini", (base or "https://api.openai.com/v1") + "/chat/completions", _chat_body, lambda r: str(r["choices"][0]["message"]["content"]), headers)
    if kind == "anthropic":
        if not model:
            raise ValueError("set MEMSPOOL_MODEL for this adapter")
        headers = {"x-api-key": key, "anthropic-version": "2023-06-01"}
        text = lambda r: "".join(b["text"] for b in r["content"] if b["type"] == "text")
        return HttpAdapter(kind, model, (base or "https://api.anthropic.com") + "/v1/messages", _messages_body, text, headers)
    raise ValueError(f"unknown adapter: {kind}")


LOG = T.StructType([T.StructField("call", T.StringType()), T.StructField("reply", T.StringType())])


def call_key(adapter: Adapter, json_mode: bool, system: Column) -> Column:
    """A hash of all that a reply depends on."""
    parts = [F.lit(adapter.name), F.lit(adapter.model), F.lit(str(json_mode)), F.coalesce(system, F.lit("")), F.col("prompt")]
    return F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256)


def logged(spark: SparkSession, log: str) -> DataFrame:
    """``call, reply`` of a log, one reply for each call."""
    return spark.read.schema(LOG).parquet(log).groupBy("call").agg(F.min("reply").alias("reply")) if Files(spark).exists(log) else spark.createDataFrame([], LOG)


def complete_all(
    prompts: DataFrame, adapter: Adapter, path: str, json_mode: bool = False, concurrency: int | None = None, log: str | None = None, per_task: int | None = None
) -> DataFrame:
    """``prompts`` (with ``prompt`` and perhaps ``system``) and ``reply``, written to ``path`` and read back.

    ``log`` is the folder of the call log, by default one beside ``path``.  ``concurrency`` bounds the calls at a time.  ``per_task`` is by default what the adapter says, or 1.
    """
    spark = prompts.sparkSession
    per_task = per_task or getattr(adapter, "per_task", 1)
    log = log or f"{path}-calls"
    system = F.col("system") if "system" in prompts.columns else F.lit(None).cast("string")
    keyed = prompts.withColumn("__call", call_key(adapter, json_mode, system))
    keyed.write.mode("overwrite").parquet(f"{path}-asked")
    keyed = spark.read.schema(keyed.schema).parquet(f"{path}-asked")
    once = keyed.groupBy(F.col("__call").alias("call")).agg(F.min(F.struct("prompt", system.alias("system"))).alias("p")).select("call", "p.prompt", "p.system")
    due = once.join(logged(spark, log), "call", "left_anti")
    n = due.count()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for call, prompt, said in zip(f["call"], f["prompt"], f["system"]):
                yield pd.DataFrame({"call": [call], "reply": [adapter.complete(prompt, said or None, json_mode)]})

    waves = max(1, -(-n // (concurrency * per_task))) if concurrency else 1
    tasks = concurrency or max(1, -(-n // per_task))
    for k in range(waves if n else 0):
        wave = due.where(F.pmod(F.xxhash64("call"), F.lit(waves)) == k).repartition(tasks)
        # a task's file is in place when the task is committed, and not only when the job is
        wave.mapInPandas(ask, LOG).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(log)
    replies = logged(spark, log)
    out = keyed.join(replies, keyed["__call"] == replies["call"]).select(*prompts.columns, "reply")
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])
    out.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
