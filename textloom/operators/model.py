"""Calls to a model: prices, a key for equal calls, the cap on what they may cost, and answers kept for the next time."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import ledger
from textloom.sources.tables import upsert, written

#: US dollars for a million tokens in and out, by the start of a model's name; a user's own table takes its place.
PRICES = {"small": (1.00, 5.00), "medium": (2.00, 10.00), "large": (5.00, 25.00)}
# The price of any other model, and what a write into and a read from a provider's cache of prompts cost in
# relation to tokens in.
OTHER_PRICE = (1.00, 5.00)
CACHE_WRITE, CACHE_READ = 1.25, 0.10
VERSION = "1"


class CapExceeded(RuntimeError):
    """The next calls could cost more than is left."""


@dataclass(frozen=True)
class Settings:
    """What a run takes from its surroundings."""

    model: str = "small"
    induction_model: str = "medium"
    cost_cap: float = ledger.COST_CAP

    @classmethod
    def read(cls, values: dict[str, str] | None = None, prefix: str = "TEXTLOOM_") -> Settings:
        """From values such as the environment's: MODEL, INDUCTION_MODEL, COST_CAP; what is empty or no number stays as it is by default."""
        values = dict(os.environ) if values is None else values
        get = lambda name: values.get(prefix + name, "").strip()
        try:
            cap = float(get("COST_CAP"))
        except ValueError:
            cap = cls.cost_cap
        return cls(get("MODEL") or cls.model, get("INDUCTION_MODEL") or cls.induction_model, cap)


def price(model: Column, out: bool = False, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """US dollars for a million tokens of a model, by the first known start of its name."""
    found = F.lit(None).cast("double")
    for name, pair in reversed(prices.items()):
        found = F.when(F.startswith(model, F.lit(name)), pair[out]).otherwise(found)
    return F.coalesce(found, F.lit(OTHER_PRICE[out]))


def usd(model: Column, tokens_in: Column, tokens_out: Column, cache_write: Column | None = None, cache_read: Column | None = None, prices: dict[str, tuple[float, float]] = PRICES) -> Column:
    """What a call costs."""
    read_in = tokens_in.cast("double")
    for tokens, share in ((cache_write, CACHE_WRITE), (cache_read, CACHE_READ)):
        if tokens is not None:
            read_in = read_in + tokens * share
    return (read_in * price(model, False, prices) + tokens_out * price(model, True, prices)) / 1_000_000


def call_key(model: Column, system: Column, user: Column, schema: Column | None = None, version: str = VERSION) -> Column:
    """The same for equal calls: a digest of their parts as JSON with sorted keys, nulls included."""
    parts = {"model": model, "schema": F.lit(None).cast("string") if schema is None else schema, "system": system, "user": user, "v": F.lit(version)}
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def complete(calls: DataFrame, cache: DataFrame, annotate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], spent: float, settings: Settings, most_out: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, the cache that holds them, and what new ones cost, of calls (call_id, model, system, user).

    Only calls whose key the cache (cache_key, model, response, tokens_in,
    tokens_out, created_at) lacks reach `annotate`, a function for mapInPandas
    from (cache_key, model, system, user) to (cache_key, response, tokens_in,
    tokens_out); equal calls reach it once. Before any does, the costs at worst
    (estimated tokens in, `most_out` out) of all of them are added to what is
    spent; CapExceeded if that passes the cap. Answers are written before they
    are used, so nothing is paid for twice. A cached answer costs nothing.
    """
    keyed = calls.withColumn("cache_key", call_key(F.col("model"), F.col("system"), F.col("user")))
    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"]).select("cache_key", "model", "system", "user")
    worst = usd(F.col("model"), T.token_estimate(F.concat("system", "user")), F.lit(most_out))
    next_usd = missing.agg(F.coalesce(F.sum(worst), F.lit(0.0)).alias("usd")).first()["usd"]
    if spent + next_usd > settings.cost_cap:
        raise CapExceeded(f"{spent:.4f} USD are spent and the next calls may cost {next_usd:.4f}, over the cap of {settings.cost_cap:.2f}")
    found = missing.mapInPandas(annotate, "cache_key string, response string, tokens_in long, tokens_out long")
    found = written(found.join(missing.select("cache_key", "model"), "cache_key").withColumn("created_at", F.current_timestamp()).select("cache_key", "model", "response", "tokens_in", "tokens_out", "created_at"), "answers")
    cached = upsert(cache, found, ["cache_key"])
    answers = keyed.join(cached.select("cache_key", "response", "tokens_in", "tokens_out"), "cache_key", "left").join(found.select("cache_key", F.lit(True).alias("_new")), "cache_key", "left")
    costs = found.select(F.col("cache_key").alias("call_id"), "model", "tokens_in", "tokens_out", usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out")).alias("usd"), F.col("created_at").alias("ts"))
    return answers.select("call_id", "cache_key", "response", F.coalesce("_new", F.lit(False)).alias("new")), cached, costs
