"""Calls of a service or a model from the executors: one client a worker, retries, failures kept as rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A client takes a request and gives (status, body); a body is a dict, or a text that is no JSON.
Client = Callable[[dict], tuple[int, object]]
#: A model takes a prompt, a temperature and a top_p and gives a text.
Model = Callable[[str, float, float], str]


class NotConfigured(Exception):
    """A model that can't be used as it is set up."""


_made: dict = {}


def _one(factory):
    """What the factory makes, once a worker for a factory given by name."""
    if _made.get("factory") is not factory:
        _made.update(factory=factory, value=factory())
    return _made["value"]


def failure_reason(error: Exception) -> str:
    """no_key, timeout, api_error or other: as :func:`terms.provider_error` has it."""
    message = str(error)
    low = message.lower()
    if isinstance(error, NotConfigured):
        return "no_key" if "api_key" in low or "not configured" in low else "api_error"
    if "429" in message or "RESOURCE_EXHAUSTED" in message:
        return "api_error"
    return "timeout" if "timeout" in low or "timed out" in low else "other"


def run_cases(cases: DataFrame, make_client: Callable[[], Client], *, k: int = 4) -> DataFrame:
    """(index, id, src, tgt, text, status, ok, response) of cases (id, src, tgt, text): what the service answered each.

    ``make_client`` is sent to the executors and called once a worker.  A request that fails is a row of status 0 with
    the error in its response, so a broken service ends no job.  ``response`` is JSON.  ``index`` is the cases' own
    column, or a growing number with gaps; a null id becomes case_index.
    """
    index = F.col("index").cast("long") if "index" in cases.columns else F.monotonically_increasing_id() + 1
    d = cases.select(index.alias("index"), F.col("id").cast("string").alias("id"), "src", "tgt", "text")

    def run(batches):
        client = _one(make_client)
        for b in batches:
            for first in range(0, b.num_rows, 64):
                part, status, bodies, ids = b.slice(first, 64), [], [], []
                for row in part.to_pylist():
                    try:
                        code, body = client({"text": row["text"], "src": row["src"], "tgt": row["tgt"], "k": k})
                        body = body if isinstance(body, dict) else {"raw": str(body)}
                    except Exception as e:
                        code, body = 0, {"detail": f"request_error: {e}"}
                    status.append(int(code))
                    bodies.append(json.dumps(body, ensure_ascii=False))
                    ids.append(row["id"] if row["id"] is not None else f"case_{row['index']}")
                cols = [part.column(0), pa.array(ids, pa.string()), *(part.column(i) for i in (2, 3, 4)), pa.array(status, pa.int32()), pa.array([s == 200 for s in status], pa.bool_()), pa.array(bodies, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["index", "id", "src", "tgt", "text", "status", "ok", "response"])

    return d.mapInArrow(run, "index long, id string, src string, tgt string, text string, status int, ok boolean, response string")


def generate(prompts: DataFrame, models: list[tuple[str, Callable[[], Model]]], *, key: str = "id", prompt: str = "prompt", temperature: str = "temperature", fallback: str = "fallback", top_p: float = 0.95, retries: int = 2, pause: float = 1.0) -> DataFrame:
    """(key, text, model, reason) of prompts: the text of the first of ``models`` that gives one.

    A model whose quota is used up is tried ``retries`` times more, with pauses of ``pause`` seconds; any other failure
    goes on to the next.  If none gives a text it is that of column ``fallback``, model is null, and reason that of
    the last failure; else reason is null.
    """
    d = prompts.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(temperature).cast("double").alias("temperature"), F.col(fallback).alias("fallback"))

    def run(batches):
        own = [(name, None, factory) for name, factory in models]
        made: dict[str, Model] = {}

        def ask(row) -> tuple:
            reason = "other"
            for name, _, factory in own:
                for tried in range(retries + 1):
                    try:
                        if name not in made:
                            made[name] = factory()
                        text = made[name](row["prompt"], row["temperature"], top_p)
                        if text and text.strip():
                            return text.strip(), name, None
                        reason = "other"
                        break
                    except Exception as e:
                        reason = failure_reason(e)
                        quota = "429" in str(e) or "RESOURCE_EXHAUSTED" in str(e)
                        if not quota or tried == retries:
                            break
                        time.sleep(pause)
            return row["fallback"], None, reason

        for b in batches:
            for first in range(0, b.num_rows, 64):
                part = b.slice(first, 64)
                rows = [ask(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], pa.string()) for i in range(3)]], names=["key", "text", "model", "reason"])

    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, text string, model string, reason string").withColumnRenamed("key", key)
