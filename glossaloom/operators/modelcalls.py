"""Batch calls of caller-supplied models: prompts in, replies out, failures as a column."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_model(
    rows: DataFrame,
    prompt_col: str,
    model_fn: Callable[[list[str]], Sequence[str]],
    batch_size: int = 20,
    attempts: int = 1,
    pause_seconds: float = 0.0,
) -> DataFrame:
    """Add ``reply`` and ``error`` to ``rows`` by calling ``model_fn`` on batches of prompts.

    ``model_fn`` runs in the tasks, so partitions are called in parallel; a batch that still fails after
    ``attempts`` tries leaves ``reply`` null and the message in ``error``.
    """
    schema = T.StructType(rows.schema.fields + [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size].copy()
                replies, error = [None] * len(part), None
                for attempt in range(max(attempts, 1)):
                    try:
                        replies, error = list(model_fn(part[prompt_col].tolist())), None
                        break
                    except Exception as exc:  # noqa: BLE001 - any model failure becomes a column
                        error = f"{type(exc).__name__}: {exc}"
                        if pause_seconds and attempt + 1 < attempts:
                            time.sleep(pause_seconds)
                part["reply"], part["error"] = replies, error
                yield part

    return rows.mapInPandas(run, schema)


def apply_rowwise(rows: DataFrame, input_cols: list[str], output: str, fn: Callable[..., list[Any]]) -> DataFrame:
    """Add array column ``output`` (DDL ``name type``) from ``fn(*column lists) -> list``, batch by batch."""
    name, ddl = output.split(" ", 1)
    schema = T.StructType(rows.schema.fields + T.StructType.fromDDL(f"{name} {ddl}").fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.copy()
            frame[name] = pd.Series(fn(*[frame[c].tolist() for c in input_cols]), index=frame.index, dtype="object")
            yield frame

    return rows.mapInPandas(run, schema)


def unfence(reply: Column) -> Column:
    """A reply without the Markdown fence around it."""
    body = F.regexp_replace(reply, r"(?U)^\s+|\s+$", "")
    return F.when(
        body.startswith("```"), F.regexp_replace(body, r"(?m)^[ \t]*```.*\n?", "")
    ).otherwise(body)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(replies: pd.Series) -> pd.Series:
    """The JSON objects of a reply as JSON text: from an array, a wrapped list, or the whole objects of a cut one."""
    decoder = json.JSONDecoder()

    def whole_objects(text: str) -> list[dict]:
        found, at = [], text.find("{")
        while at >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                found.append(value)
                at = text.find("{", end)
            except ValueError:
                at = text.find("{", at + 1)
        return found

    def items(text: str | None) -> list[str]:
        if text is None:
            return []
        try:
            value = json.loads(text)
        except ValueError:
            start, end = text.find("["), text.rfind("]")
            try:
                value = json.loads(text[start : end + 1]) if 0 <= start < end else whole_objects(text)
            except ValueError:
                value = whole_objects(text)
        if isinstance(value, dict):
            value = value.get("results") or value.get("candidates") or [value]
        return [json.dumps(v) for v in value if isinstance(v, dict)] if isinstance(value, list) else []

    return replies.map(items)
