"""Line deduplication over range-partitioned line hashes.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. Keys of at least `min_chars`
code points that `min_docs` documents or more hold lose all lines except those of the largest doc_id.

Occurrences (128-bit key hash, doc_id, position) are range-partitioned and sorted by key, document (descending)
and position. Ranges are cut on the whole tuple, so one key that a third of all documents hold spreads over many
partitions. Each task streams its range: the first document of a key keeps its lines, the second waits until
another document shows up, later ones drop at once. Only the first and the last key of a partition can go on
elsewhere; their rows are settled by a summary of at most six rows for each partition. The result is a compressed
keep bitmap for each document that loses lines; hashes are sorted without their texts, and texts are shuffled once, to meet
the bitmaps.

Defined results: null or empty text is one empty line; a null doc_id counts as one document below all others;
rows that share a doc_id are one document for counting, each judged on its own lines; an empty table gives no rows. doc_id must be castable to long.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut_lineage
from .words import SPACE, as_bytes, bounded, column, lean

NO_ID = -(1 << 63)
DROP, OPEN, SUMMARY = 0, 1, 2
STREAM_SCHEMA = "kind int, h1 long, h2 long, doc long, tag long, pos long"


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc (doc_id, with null as the least value) and tag (hash of the text) tell rows apart across jobs."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text"
    )


def _occurrences(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            raw, off = as_bytes(column(batch, "text"))
            digests, row, pos = [], [], []
            for r in range(len(off) - 1):
                for k, line in enumerate(raw[off[r] : off[r + 1]].tobytes().lower().split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    row.append(r)
                    pos.append(k)
            if digests:
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                at = np.array(row)
                arrays = [halves[:, 0], halves[:, 1]]
                arrays += [column(batch, c).to_numpy(zero_copy_only=False)[at] for c in ("doc", "tag")]
                arrays.append(np.array(pos, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["h1", "h2", "doc", "tag", "pos"])

    return run


class _Stream:
    """Decides the rows of one sorted partition with the state of a single key."""

    def __init__(self) -> None:
        self.key = None
        self.first = True  # the key is the partition's first one
        self.order = 0  # how many documents of the key have passed
        self.doc = 0
        self.top: list[int] = []  # its largest documents, three at most
        self.waiting: list[np.ndarray] = []  # lines of its second document

    @staticmethod
    def rows(kind: int, table: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(table), kind, np.int32)), *(pa.array(table[:, i]) for i in range(5))]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "h1", "h2", "doc", "tag", "pos"])

    def summary(self) -> Iterator[pa.RecordBatch]:
        if self.top:
            yield self.rows(SUMMARY, np.array([[*self.key, d, 0, 0] for d in self.top], dtype=np.int64))

    def feed(self, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(table)
        new_key, new_doc = np.zeros(n, bool), np.zeros(n, bool)
        new_key[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
        new_key[0] = self.key != (table[0, 0], table[0, 1])
        new_doc[1:] = table[1:, 2] != table[:-1, 2]
        new_doc[0] = table[0, 2] != self.doc
        new_doc |= new_key
        passed = np.cumsum(new_doc)
        starts = np.flatnonzero(new_key)
        group = np.cumsum(new_key)  # 0: the key that the last batch ended with
        base = np.concatenate([[-self.order], passed[starts] - 1])
        order = passed - base[group]
        last = np.concatenate([starts - 1, [n - 1]])  # last row of each group
        reach = np.where(last >= 0, order[np.maximum(last, 0)], self.order)
        opening = np.zeros(len(base), bool)  # group is the partition's first key
        if self.key is None:
            opening[1] = True
        else:
            opening[0] = self.first
        open_rows = opening[group]
        if open_rows.any():
            yield self.rows(OPEN, table[open_rows])
        drop = ~open_rows & ((order >= 3) | ((order == 2) & (reach[group] >= 3)))
        if drop.any():
            yield self.rows(DROP, table[drop])
        if self.waiting and reach[0] >= 3:
            yield self.rows(DROP, np.concatenate(self.waiting))
            self.waiting = []
        if self.key is not None:
            self.top += table[(group == 0) & new_doc & (order <= 3), 2].tolist()
        if len(starts):  # the key at hand has ended
            if self.key is not None and self.first:
                yield from self.summary()
            final = len(base) - 1
            if self.key is None and final > 1:
                self.key = (int(table[0, 0]), int(table[0, 1]))
                self.top = table[(group == 1) & new_doc & (order <= 3), 2].tolist()
                yield from self.summary()
            self.first = self.key is None
            self.key = (int(table[-1, 0]), int(table[-1, 1]))
            self.top = table[(group == final) & new_doc & (order <= 3), 2].tolist()
            self.waiting = []
        self.order, self.doc = int(order[-1]), int(table[-1, 2])
        if not self.first and self.order == 2:
            held = (group == group[-1]) & (order == 2)
            if held.any():
                self.waiting.append(table[held])

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self.summary()
        if self.waiting:
            yield self.rows(OPEN, np.concatenate(self.waiting))


@lean
def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = _Stream()
    for batch in batches:
        if batch.num_rows:
            names = ("h1", "h2", "doc", "tag", "pos")
            yield from stream.feed(np.stack([column(batch, c).to_numpy(zero_copy_only=False) for c in names], axis=1))
    yield from stream.close()


@lean
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for dropped in column(batch, "dropped"):
            at = np.unique(dropped.values.to_numpy())
            keep = np.ones((int(at[-1]) // 8 + 1) * 8, dtype=np.uint8)
            keep[at] = 0
            packed.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        arrays = [column(batch, "doc"), column(batch, "tag"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "tag", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, keep_bitmap) of the rows that lose lines. Bit i of the unzipped bitmap (least significant first) is
    1 where line i stays; lines beyond the bitmap's end stay."""
    if min_docs != 3:
        raise ValueError("the stream holds back one document: min_docs is 3")
    by = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    found = with_row_key(docs).mapInArrow(_occurrences(min_chars), "h1 long, h2 long, doc long, tag long, pos long")
    ranged = found.repartitionByRange(*by).sortWithinPartitions(*by)
    decided = cut_lineage(ranged.mapInArrow(_stream, STREAM_SCHEMA))
    # at most six rows for each partition
    edges = decided.where(F.col("kind") == SUMMARY).groupBy("h1", "h2")
    edges = edges.agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs)
    settled = decided.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"])
    settled = settled.where(F.col("doc") != F.col("keeper"))
    drops = decided.where(F.col("kind") == DROP).select("doc", "tag", "pos").unionAll(settled.select("doc", "tag", "pos"))
    grouped = drops.groupBy("doc", "tag").agg(F.collect_list("pos").alias("dropped"))
    return grouped.mapInArrow(_pack, "doc long, tag long, keep_bitmap binary")


def _apply(keep: list[str], prefix: str, text_out: bool):
    """Digests (and with `text_out` texts) of what a bitmap keeps."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, prefix + "text"):
            raw, off = as_bytes(column(batch, prefix + "text"))
            n_lines, n_dropped, shas, texts = [], [], [], []
            there = column(batch, prefix + "text").is_valid().to_pylist()
            for r, bitmap in enumerate(column(batch, prefix + "keep_bitmap").to_pylist()):
                data = raw[off[r] : off[r + 1]].tobytes()
                n = data.count(b"\n") + 1
                gone = 0
                if bitmap is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
                    lines = data.split(b"\n")
                    kept = [x for x, b in zip(lines, bits.tolist(), strict=False) if b] + lines[len(bits) :]
                    gone = n - len(kept)
                    data = b"\n".join(kept)
                n_lines.append(n)
                n_dropped.append(gone)
                shas.append(hashlib.sha256(data).hexdigest())
                if text_out:
                    texts.append(data.decode() if there[r] else None)
            arrays = [column(batch, c) for c in keep]
            arrays += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())]
            names = [*keep, *(prefix + c for c in ("n_lines", "n_dropped", "kept_sha256"))]
            if text_out:
                arrays.append(pa.array(texts, pa.string()))
                names.append(prefix + "kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def dedup_lines(
    docs: DataFrame, *, keep: list[str], min_chars: int = 20, text_out: bool = False, prefix: str = ""
) -> DataFrame:
    """`keep` columns of all rows with n_lines, n_dropped, kept_sha256 and with `text_out` kept_text (these named with
    `prefix`)."""
    own = [F.col(c).alias(c) for c in keep]
    keyed = docs.select(
        *own,
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
        F.xxhash64("text").alias("__tag"),
        F.col("text").alias((prefix or "__") + "text"),
    )
    inner = prefix or "__"
    marks = keep_bitmaps(docs, min_chars=min_chars).select(
        F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("keep_bitmap").alias(inner + "keep_bitmap")
    )
    joined = keyed.join(marks, ["__doc", "__tag"], "left").drop("__doc", "__tag")
    extra = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())]
    extra += [("kept_text", T.StringType())] if text_out else []
    fields = [docs.schema[c] for c in keep] + [T.StructField(inner + n, t) for n, t in extra]
    out = joined.mapInArrow(_apply(keep, inner, text_out), T.StructType(fields))
    return out if prefix else out.withColumnsRenamed({inner + n: n for n, _ in extra})
