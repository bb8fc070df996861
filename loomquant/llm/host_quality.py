"""Quality rules with host-level evidence.

Each document gets counts over its whole text and a few rules on them. Hard rules reject on their own. Failures of
soft rules are summed by host (`source`), each host's failure rate is shrunk towards all hosts by a beta prior
whose two parameters come from the hosts' own rates (method of moments), and the host's tier is joined back: the
better the host, the more soft failures a document may have. A document without any failure always stays.

Failures are summed per host with partial aggregation, so a host that owns a third of all rows costs one row per
task. Host tiers are broadcast up to `max_broadcast_hosts` hosts and joined by shuffle (which AQE splits where
skewed) beyond that.

Defined results: null or empty texts and texts without words count zero everywhere and fail; null hosts are one
host; repeated rows are judged one by one; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut_lineage
from .words import IS_WORD, SPACE, as_bytes, bounded, column, inside_rows, lean, mix, rolling, row_sums, split_words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: How many soft failures a document of a trusted, a watched and a blocked host may have.
ALLOWED = {"trusted": 2, "watched": 1, "blocked": 0}


def repeated_words(hashes: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Per row, the words inside windows that the row holds twice or more."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(len(rows) - 1, dtype=np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    keys = mix(rolling(hashes, window) + row[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside_rows(rows, window, n))
    order = np.argsort(keys[at], kind="stable")
    ranked = keys[at][order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + window] -= 1
    return row_sums(np.cumsum(edge)[:-1] > 0, rows)


def _duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return len(lines), len(lines) - len(set(lines))


def _counter(keep: list[str], prefix: str):
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    codepoint_of_word = IS_WORD["space"].copy()
    codepoint_of_word[0x80:0xC0] = False

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off = as_bytes(column(batch, "text"))
            words = split_words(raw, off)
            lines = [_duplicate_lines(raw[off[r] : off[r + 1]].tobytes()) for r in range(len(off) - 1)]
            counts = [
                np.diff(words.rows),
                row_sums(codepoint_of_word[raw], off),
                row_sums(symbol[raw], off),
                np.array([x[1] for x in lines], dtype=np.int64),
                repeated_words(words.hashes, words.rows, REPEAT_WINDOW),
                np.array([x[0] for x in lines], dtype=np.int64),
            ]
            arrays = [column(batch, c) for c in keep] + [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *(prefix + c for c in COUNTS)])

    return run


def with_counts(docs: DataFrame, keep: list[str], prefix: str = "") -> DataFrame:
    """`keep` columns with the counts of COUNTS."""
    source = [*keep, *(["text"] if "text" not in keep else [])]
    fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + c, T.LongType()) for c in COUNTS]
    return docs.select(*source).mapInArrow(_counter(keep, prefix), T.StructType(fields))


def base_failed(prefix: str = "") -> Column:
    words, repeat = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)


def soft_failures(prefix: str = "") -> Column:
    """How many soft rules fail: mean word length outside 3 to 10, symbols over a tenth of the words, duplicate
    lines over three tenths of the lines, repeated words over a tenth."""
    c = {x: F.col(prefix + x) for x in COUNTS}
    rules = [
        (c["word_chars"] < 3 * c["n_words"]) | (c["word_chars"] > 10 * c["n_words"]),
        10 * c["n_symbols"] > c["n_words"],
        10 * c["n_dup_lines"] > 3 * c["n_word_lines"],
        10 * c["n_repeat_words"] > c["n_words"],
    ]
    total = F.lit(0)
    for rule in rules:
        total = total + rule.cast("int")
    return total


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Moments of the failure rates of `hosts` (n, failed), weighted by n: one row reaches the driver."""
    one = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts")).first()
    if not one["n"]:
        return 1.0, 1.0
    mean = one["failed"] / one["n"]
    spread = hosts.agg(F.sum(F.col("n") * (F.col("failed") / F.col("n") - mean) ** 2).alias("s")).first()["s"]
    variance, noise = spread / one["n"], mean * (1 - mean)
    between = variance - noise * one["hosts"] / one["n"]  # without what binomial sampling adds
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def host_tiers(counted: DataFrame, host: str, prefix: str = "", *, watch: float = 1.5, block: float = 0.5) -> DataFrame:
    """(host, n, failed, rate, tier): hosts whose shrunk rate is `block` or more are blocked, those over `watch`
    times the mean of the prior watched."""
    failed = (base_failed(prefix) | (soft_failures(prefix) > 0)).cast("long")
    sums = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(failed).alias("failed"))
    hosts = cut_lineage(sums)
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    tier = F.when(rate >= block, "blocked").when(rate > watch * a / (a + b), "watched").otherwise("trusted")
    return hosts.select("host", "n", "failed", rate.alias("rate"), tier.alias("tier"))


def judge(
    docs: DataFrame, *, keep: list[str], host: str = "source", prefix: str = "", max_broadcast_hosts: int = 100_000
) -> DataFrame:
    """`keep` columns with the counts, base_failed and kept (named with `prefix`)."""
    if host in keep:
        counted = with_counts(docs, keep, prefix)
    else:
        counted = with_counts(docs, [*keep, host], prefix)
    mark = prefix or "__"
    tiers = host_tiers(counted, host, prefix)
    lists = tiers.where(F.col("tier") != "trusted").select(
        F.col("host").alias(mark + "host"), F.col("tier").alias(mark + "tier")
    )
    if tiers.count() <= max_broadcast_hosts:
        lists = F.broadcast(lists)
    joined = counted.join(lists, F.col(host).eqNullSafe(F.col(mark + "host")), "left")
    allowed = F.coalesce(
        *[F.when(F.col(mark + "tier") == t, F.lit(n)) for t, n in ALLOWED.items()], F.lit(ALLOWED["trusted"])
    )
    kept = ~base_failed(prefix) & (soft_failures(prefix) <= allowed)
    return joined.select(
        *keep,
        *(prefix + c for c in COUNTS),
        base_failed(prefix).alias(prefix + "base_failed"),
        kept.alias(prefix + "kept"),
    )
