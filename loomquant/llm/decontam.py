"""Benchmark decontamination with an FM-index for each shard of training text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A test phrase is every run of
`window` item words; an item with fewer (but some) words is one phrase. Each task lays the words of the documents
it reads out in shards of bounded length, in the alphabet of the phrases (any other word acts as a separator),
builds an FM-index of each shard, finds all phrases by backward search over wavelet-tree ranks, locates
occurrences through sampled suffix positions and merges them into removal spans. There is no shuffle.

The phrases reach the tasks in blocks of a fixed number (`block_windows`), so what a task holds does not follow
the benchmark; further blocks are further passes, cut by `checkpoint()`. Words are compared by 64-bit hash.

Defined results: null or empty texts and texts without words have no hits; repeated rows are judged one by one;
a null item_id counts as the name "null"; equal item_ids count once; an empty benchmark or document table gives
no hits or no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .storage import cut_lineage
from .words import as_bytes, bounded, lean, split_words

SHARD_SYMBOLS = 1 << 17
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))


class PhraseBlock:
    """Distinct phrases as rows of symbols, with the items that each one comes from."""

    def __init__(self, phrases: dict[tuple[int, ...], set[str]]):
        words = sorted({w for p in phrases for w in p})
        self.vocab = np.array(words, dtype=np.uint64)
        symbol = {w: i + 1 for i, w in enumerate(words)}
        self.lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.patterns = np.zeros((len(phrases), self.longest), dtype=np.int64)
        for i, p in enumerate(phrases):
            self.patterns[i, : len(p)] = [symbol[w] for w in p]
        self.names = sorted(set().union(*phrases.values())) if phrases else []
        number = {x: i for i, x in enumerate(self.names)}
        self.items = [sorted(number[x] for x in s) for s in phrases.values()]

    def occurrences(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, index of its first word) of all occurrences in the words of a batch."""
        none = np.empty(0, np.int64)
        if not len(self.vocab) or not len(hashes):
            return none, none
        at = np.searchsorted(self.vocab, hashes)
        at[at == len(self.vocab)] = 0
        symbol = np.where(self.vocab[at] == hashes, at + 1, 0)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        laid = np.zeros(len(hashes) + len(rows), dtype=np.int64)
        laid[np.arange(len(hashes)) + row] = symbol
        word = np.zeros(len(laid), dtype=np.int64)
        word[np.arange(len(hashes)) + row] = np.arange(len(hashes))
        kept = laid > 0
        kept[1:] |= laid[:-1] > 0  # one separator after each run
        laid, word = laid[kept], word[kept]
        found_phrase, found_word = [], []
        for a in range(0, len(laid), SHARD_SYMBOLS):
            shard = laid[a : a + SHARD_SYMBOLS + self.longest]
            if not shard.any():
                continue
            index = FMIndex(np.append(shard, 0), len(self.vocab) + 1)
            lo, hi = index.search(self.patterns, self.lengths)
            count = hi - lo
            phrase = np.repeat(np.arange(len(count)), count)
            if not len(phrase):
                continue
            first = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            start = index.locate(first + np.arange(len(phrase)))
            own = start < SHARD_SYMBOLS  # what begins in the overlap belongs to the next shard
            found_phrase.append(phrase[own])
            found_word.append(word[a : a + SHARD_SYMBOLS + self.longest][start[own]])
        if not found_phrase:
            return none, none
        return np.concatenate(found_phrase), np.concatenate(found_word)


def phrase_blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[PhraseBlock]:
    """Streams the items through the driver and yields blocks of at most `block_windows` phrases (and one item)."""
    phrases: dict[tuple[int, ...], set[str]] = {}
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
    for name, text in items.toLocalIterator():
        raw, off = as_bytes(pa.array([text], pa.string()))
        hashes = split_words(raw, off, "alnum", lower=True).hashes.tolist()
        for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
            phrases.setdefault(tuple(hashes[i : i + window]), set()).add(name)
        if len(phrases) >= block_windows:
            yield PhraseBlock(phrases)
            phrases = {}
    yield PhraseBlock(phrases)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


def _scanner(block: PhraseBlock, keep: list[str], names: tuple[str, str, str, str], cut: bool):
    spans_col, items_col, words_col, cut_col = names

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off = as_bytes(batch.column(batch.schema.get_field_index("text")))
            words = split_words(raw, off, "alnum", lower=True)
            phrase, first = block.occurrences(words.hashes, words.rows)
            n, n_rows = len(words.hashes), len(off) - 1
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + block.lengths[phrase], -1)
            row_at = np.searchsorted(words.rows, first, "right") - 1
            items: dict[int, set[str]] = {}
            for r, p in set(zip(row_at.tolist(), phrase.tolist(), strict=True)):
                items.setdefault(r, set()).update(block.names[i] for i in block.items[p])
            earlier = spans_col in batch.schema.names
            if earlier:
                past = batch.column(batch.schema.get_field_index(spans_col)).to_pylist()
                for r, spans in enumerate(past):
                    for s in spans:
                        edge[words.rows[r] + s["first"]] += 1
                        edge[words.rows[r] + s["past"]] -= 1
                for r, known in enumerate(batch.column(batch.schema.get_field_index(items_col)).to_pylist()):
                    if known:
                        items.setdefault(r, set()).update(known)
            hit = np.cumsum(edge)[:n] > 0
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1]
            closes[:-1] &= ~hit[1:]
            inner = words.rows[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            opens[inner] = hit[inner]
            closes[inner - 1] = hit[inner - 1]
            s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            bounds = np.searchsorted(s, words.rows)
            base = np.repeat(words.rows[:-1], np.diff(bounds))
            spans = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()),
                pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["first", "past"]),
            )
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [spans, pa.array([sorted(items.get(r, ())) for r in range(n_rows)], pa.list_(pa.string()))]
            columns += [pa.array(np.diff(words.rows))]
            labels = [*keep, spans_col, items_col, words_col]
            if cut:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    own = range(bounds[r], bounds[r + 1])
                    at = [(int(words.starts[s[i]] - off[r]), int(words.ends[e[i] - 1] - off[r])) for i in own]
                    texts[r] = _cut(raw[off[r] : off[r + 1]].tobytes(), at).decode()
                columns.append(pa.array(texts, pa.string()))
                labels.append(cut_col)
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: list[str],
    window: int = 10,
    block_windows: int = 200_000,
    cut: bool = False,
    prefix: str = "",
) -> DataFrame:
    """`keep` columns of `docs` with `spans` (merged word ranges, end exclusive), `items` (sorted names of the
    items with occurring phrases), `n_words`, and with `cut` also `clean_text` (the text without the bytes of its
    spans). `prefix` goes before these names where `keep` holds names that would clash."""
    names = tuple(prefix + x for x in ("spans", "items", "n_words", "clean_text"))
    kept = [docs.schema[c] for c in keep]
    found = None
    source = [*keep, *(["text"] if "text" not in keep else [])]
    blocks = phrase_blocks(benchmark, window, block_windows)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        if after is not None and not len(after.lengths):
            after = None
        frame = docs.select(*source) if found is None else found
        fields = [*kept, *([docs.schema["text"]] if after is not None and "text" not in keep else [])]
        fields += [T.StructField(names[0], SPANS), T.StructField(names[1], T.ArrayType(T.StringType()))]
        fields += [T.StructField(names[2], T.LongType())]
        last = after is None
        fields += [T.StructField(names[3], T.StringType())] if cut and last else []
        run = _scanner(block, keep if last else source, names, cut and last)
        found = frame.mapInArrow(run, T.StructType(fields))
        if not last:
            found = cut_lineage(found)
        block = after
    return found
