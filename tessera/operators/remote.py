"""Calls of a model over batches of rows: retries, and smaller batches when memory runs out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def retried(call: Callable, waits: tuple[float, ...] = (2, 4), sleep: Callable = time.sleep):
    """call(), tried once more after each wait; None when all tries failed."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception:  # whatever a provider raises
            if wait is None:
                return None
            sleep(wait)


def bisected(items: list, call: Callable[[list], list]) -> list:
    """call(items); on MemoryError by halves, down to one item, whose answer is then an error text.
    Halves are kept on a list, so no depth limit applies."""
    done, todo = [], [items]
    while todo:
        part = todo.pop()
        if not part:
            continue
        try:
            done += call(part)
        except MemoryError as e:
            if len(part) == 1:
                done.append(f"ERROR: {e}")
            else:
                todo += [part[len(part) // 2:], part[: len(part) // 2]]
    return done


def generate(rows: DataFrame, call: Callable[[list], list], size: int = 128) -> DataFrame:
    """(id, answer) of rows (id, prompt): ``call`` on batches of ``size``, halved on MemoryError; any
    other failure makes error answers of its batch and spares the others."""

    def answered(prompts: list) -> list:
        try:
            return bisected(prompts, call)
        except Exception as e:
            return [f"ERROR: {e}"] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at:at + size]
                yield pd.DataFrame({"id": part["id"], "answer": answered(list(part["prompt"]))})

    return rows.select("id", "prompt").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, answer string")


AXES = "category string, difficulty int, divergence int"


def question_labels(raw: Column) -> Column:
    """(category, difficulty, divergence, error) of a reply: all three or, with an error, none. The two
    grades are from 1 to 5."""
    parsed = lambda json: F.from_json(json, AXES)

    def judged(x):
        error = F.when(x.isNull(), "ValueError: no JSON in the reply")
        for axis in ("category", "difficulty", "divergence"):
            error = error.when(x[axis].isNull(), f"ValueError: no {axis} in the reply")
        for axis in ("difficulty", "divergence"):
            error = error.when(~x[axis].between(1, 5), f"ValueError: {axis} out of range")
        return tx.let(error, lambda e: F.struct(*(F.when(e.isNull(), x[axis]).alias(axis) for axis in ("category", "difficulty", "divergence")), e.alias("error")))

    return tx.let(parsed(tx.find_json(raw)), judged)
