"""Encodings and entropies of messages."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ieee import log_return


def encode_tick_rule(sign: str) -> Column:
    """Letter of a sign: 1 is a, -1 is b, 0 is c; anything else fails."""
    s = F.col(sign)
    other = F.raise_error(F.lit("a tick rule is -1, 0 or 1")).cast("string")
    return F.when(s == 1, "a").when(s == -1, "b").when(s == 0, "c").otherwise(other)


def quantile_codes(df: DataFrame, value: str, letters: int) -> list[tuple[float, str]]:
    """(value, letter) at evenly spaced quantiles from 0.01 to 1; only the picked ranks reach the driver."""
    n = df.where(F.col(value).isNotNull()).count()
    if n == 0 or letters < 1:
        raise ValueError("nothing to encode")
    qs = [0.01 + (1 - 0.01) * i / max(letters - 1, 1) for i in range(letters)]
    ranks = [int(math.floor(q * (n - 1) + 0.5)) for q in qs]
    exact = df.agg(F.percentile(value, [r / max(n - 1, 1) for r in ranks]).alias("v")).first()["v"]
    return [(float(v), chr(i)) for i, v in enumerate(exact)]


def sigma_codes(df: DataFrame, value: str, step: float) -> list[tuple[float, str]]:
    """(value, letter) from the minimum in steps below the maximum; 256 letters at most."""
    one = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    n = max(0, math.ceil((one["hi"] - one["lo"]) / step))
    if n > 256:
        raise ValueError("more than 256 letters")
    return [(one["lo"] + i * step, chr(i)) for i in range(n)]


def nearest_letter(value: Column, codes: list[tuple[float, str]]) -> Column:
    """Letter of the nearest code, the first on ties."""
    best = F.array_min(F.array(*[F.struct(F.abs(value - k).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (k, c) in enumerate(codes)]))
    return best["c"]


def messages(df: DataFrame, letter: Column, *, by: str = "symbol", order: str = "ts") -> DataFrame:
    """(symbol, message): letters in order."""
    rows = df.select(by, F.struct(F.col(order).alias("o"), letter.alias("c")).alias("s"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]), "").alias("message"))


def lempel_ziv(message: str) -> float:
    """Distinct phrases over the length."""
    seen: set[str] = set()
    i = 0
    while i < len(message):
        j = i + 1
        while j <= len(message) and message[i:j] in seen:
            j += 1
        seen.add(message[i:j])
        i = j
    return len(seen) / len(message) if message else 0.0


def word_shares(message: str, length: int) -> dict[str, float]:
    """Shares of the words of a length; the last word is left out."""
    counts = Counter(message[i : i + length] for i in range(len(message) - length))
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()}


def plug_in(message: str, length: int) -> float:
    return -sum(p * math.log2(p) for p in word_shares(message, length).values()) / length


def match_length(message: str, i: int, window: int) -> int:
    """One more than the longest match of what starts at i with what starts in the window before it."""
    longest = 0
    for size in range(1, window + 1):
        if i + size > len(message):
            break
        if message.find(message[i : i + size], max(0, i - window), i + size - 1) < 0:
            break
        longest = size
    return longest + 1


def earlier_matches(message: str) -> np.ndarray:
    """For each position, the length of the longest match of what starts there with what starts anywhere before it: from
    sorted suffixes (doubled prefixes) and the common prefixes of neighbours, unlinked from the last position on."""
    n = len(message)
    rank = np.unique(np.array([ord(c) for c in message]), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        pair = rank * (n + 1)
        pair[: max(n - step, 0)] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) > 0)])
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    place, suffix = rank.tolist(), order.tolist()
    common = [0] * (n + 1)  # of a sorted suffix and the one before it
    k = 0
    for i in range(n):
        if place[i] == 0:
            k = 0
            continue
        j = suffix[place[i] - 1]
        while i + k < n and j + k < n and message[i + k] == message[j + k]:
            k += 1
        common[place[i]] = k
        k = max(k - 1, 0)
    before, after = list(range(-1, n)), list(range(1, n + 2))
    out = np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        p = place[i]
        out[i] = max(common[p], common[after[p]])
        common[after[p]] = min(common[p], common[after[p]])
        before[after[p]] = before[p]
        if before[p] >= 0:
            after[before[p]] = after[p]
    return out


def kontoyiannis(message: str, window: int = 0) -> float:
    """Mean of log2(n + 1) over match lengths, with a growing window (0) or a sliding one."""
    n = len(message)
    if n < 2:
        return 0.0
    if window:
        window = min(window, n // 2)
        points = range(window, n - window + 1)
    else:
        points = range(1, n // 2 + 1)
        longest = earlier_matches(message).tolist()
    terms = [math.log2((window or i) + 1) / (match_length(message, i, window) if window else min(longest[i], i) + 1) for i in points]
    return sum(terms) / len(terms) if terms else 0.0


def shannon(df: DataFrame, message: str = "message", *, by: str = "symbol") -> DataFrame:
    """(symbol, shannon) in bits, by counting letters."""
    letters = df.select(by, F.explode(F.split(message, "")).alias("c")).where(F.col("c") != "")
    counts = letters.groupBy(by, "c").agg(F.count("*").cast("double").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return totals.select(by, (F.log2("t") - F.col("s") / F.col("t")).alias("shannon"))


ENTROPIES = {
    "lempel_ziv": lempel_ziv,
    "plug_in_1": lambda m: plug_in(m, 1),
    "plug_in_2": lambda m: plug_in(m, 2),
    "kontoyiannis": kontoyiannis,
    "kontoyiannis_window": lambda m: kontoyiannis(m, 20),
}


def entropies(df: DataFrame, message: str = "message", *, by: str = "symbol") -> DataFrame:
    """(symbol, shannon and the entropies of ENTROPIES)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({by: rows[by]} | {n: rows[message].map(f) for n, f in ENTROPIES.items()})

    schema = T.StructType([df.schema[by], *(T.StructField(n, T.DoubleType()) for n in ENTROPIES)])
    return shannon(df, message, by=by).join(df.select(by, message).mapInPandas(run, schema), by)


def _in_bars(ticks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Ticks (symbol, bar_end, _n, ts, price, volume, sign, price_diff, log_ret) with the first boundary (symbol, last) at or
    after them, by one sort; ticks after the last boundary drop out. Differences go on across bars and are 0 at first."""
    from pyspark.sql import Window

    from .bars import trade_sign

    w = Window.partitionBy("symbol").orderBy("ts", "ord")
    before = F.lag("price").over(w)
    numbered = trade_sign(ticks).withColumns(
        {
            "_n": F.row_number().over(w) - 1,
            "price_diff": F.coalesce(F.col("price") - before, F.lit(0.0)),
            "log_ret": F.coalesce(log_return(F.col("price"), before), F.lit(0.0)),
        }
    )
    held = F.struct("ts", "price", "volume", F.coalesce("sign", F.lit(0.0)).alias("sign"), "price_diff", "log_ret")
    rows = numbered.select("symbol", F.col("_n").cast("long").alias("_n"), held.alias("_t"), F.lit(None).cast("long").alias("_m"))
    last = F.col("last").cast("long")
    marks = boundaries.select("symbol", last.alias("_n"), F.lit(None).cast(rows.schema["_t"].dataType).alias("_t"), last.alias("_m"))
    ahead = Window.partitionBy("symbol").orderBy(F.desc("_n"), F.col("_m").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.unionByName(marks).withColumn("bar_end", F.last("_m", True).over(ahead)).where(F.col("_t").isNotNull() & F.col("bar_end").isNotNull())
    return placed.select("symbol", "bar_end", "_n", "_t.*")


def _message(letter: Column) -> Column:
    """Letters of a bar in order of their ticks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", letter.alias("c")))), lambda s: s["c"]), "")


def _tick_letter() -> Column:
    return F.when(F.col("sign") == 1, "a").when(F.col("sign") == -1, "b").otherwise("c")


BAR_KEY = ["symbol", "bar_end"]


def bar_features(ticks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Features of bars that end at given tick numbers (symbol, last): mean tick size, tick rule sum, VWAP and the
    message of tick signs."""
    return _in_bars(ticks, boundaries).groupBy(*BAR_KEY).agg(
        F.max("ts").alias("ts"), F.avg("volume").alias("average_tick_size"), F.sum("sign").alias("tick_rule_sum"),
        F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), _message(_tick_letter()).alias("message"),
    )


Codes = list[tuple[float, str]]


def tick_features(ticks: DataFrame, boundaries: DataFrame, *, volume_codes: Codes | None = None, return_codes: Codes | None = None) -> DataFrame:
    """All features of each bar: those of `bar_features`, the Kyle, Amihud and Hasbrouck coefficients of its trades, and
    shannon and the entropies of ENTROPIES of the message of tick signs and, where codes are given, of the messages of
    volumes and log returns (columns tick_*, volume_*, return_*)."""
    rows = _in_bars(ticks, boundaries)
    dollars = F.col("price") * F.col("volume")
    signed, rooted, size = F.col("volume") * F.col("sign"), F.sqrt(dollars) * F.col("sign"), F.abs("log_ret")
    letters = {"tick": _tick_letter()}
    if volume_codes:
        letters["volume"] = nearest_letter(F.col("volume"), volume_codes)
    if return_codes:
        letters["return"] = nearest_letter(F.col("log_ret"), return_codes)
    bars = rows.groupBy(*BAR_KEY).agg(
        F.max("ts").alias("ts"), F.avg("volume").alias("average_tick_size"), F.sum("sign").alias("tick_rule_sum"), F.try_divide(F.sum(dollars), F.sum("volume")).alias("vwap"),
        F.coalesce(F.try_divide(F.sum(signed * F.col("price_diff")), F.sum(signed * signed)), F.lit(0.0)).alias("kyle"),
        F.coalesce(F.try_divide(F.sum(dollars * size), F.sum(dollars * dollars)), F.lit(0.0)).alias("amihud"),
        F.coalesce(F.try_divide(F.sum(rooted * size), F.sum(rooted * rooted)), F.lit(0.0)).alias("hasbrouck"),
        *[_message(c).alias(f"_{k}") for k, c in letters.items()],
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("message")) for k in letters])).alias("m")
    told = bars.select(*BAR_KEY, kinds).select(F.struct(*BAR_KEY, "m.kind").alias("_of"), "m.message")
    measured = entropies(told, by="_of")
    names = ["shannon", *ENTROPIES]
    wide = measured.groupBy("_of.symbol", "_of.bar_end").agg(*[F.max(F.when(F.col("_of.kind") == k, F.col(n))).alias(f"{k}_{n}") for k in letters for n in names])
    return bars.drop(*[f"_{k}" for k in letters]).join(wide, BAR_KEY)
