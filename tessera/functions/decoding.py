"""Token budgets and sampling settings of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Context without an output cap, default context and room for the prompt, sampling.
UNCAPPED, CONTEXT, TEMPERATURE, TOP_P = 32768, 4096, 0.7, 0.9


def budget(listed: Column, override: Column, asked: Column, limit: Column) -> Column:
    """(max_tokens, max_len). ``listed``: the model has an override; a null one means uncapped. The
    context is never above the model's limit, if that is known."""
    tokens = F.when(listed, override).otherwise(asked)
    room = F.when(listed, F.when(override.isNull(), UNCAPPED).otherwise(override + CONTEXT)).otherwise(CONTEXT)
    return F.struct(tokens.cast("int").alias("max_tokens"), F.least(room, F.when(limit > 0, limit)).cast("int").alias("max_len"))


def sampling(asked: Column, samples: Column, own: Column, default: float) -> Column:
    """The caller's value, else the model's own if it samples (and that isn't 0), else the default."""
    return F.coalesce(asked, F.when(samples & (own != 0), own), F.lit(default))
