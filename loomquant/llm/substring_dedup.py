"""Incremental substring deduplication with a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts, word for
word, in a document with a smaller doc_id, or in any document of an earlier batch.

The index holds fingerprints of windows: of each window, the least hash of its `gram`-word sequences (winnowing), so
equal windows have equal fingerprints while a document keeps only some two for every window's length. It is a log of
immutable runs in a folder, each bucketed and sorted by fingerprint, with (fingerprint, document) entries and the
compressed texts of its batch. `FingerprintIndex.add` takes a batch: its fingerprints are sorted once and merge-joined with
each run as it lies (runs are neither shuffled nor sorted again); documents of the batch that share a fingerprint with
each other or with a run, and the documents of the runs that they share it with, are verified: their full windows
under these fingerprints are compared by two hashes, 76 bits together within a bucket. What the batch then still holds
first becomes a run (a passage that a third of all documents hold leaves one entry), and when `fanout` runs of a size tier have
gathered they are merged into one of the next tier. `FingerprintIndex.open` goes on with an index from its folder.

`dedup_substrings` feeds a table to an index in batches of ascending doc_id. A fingerprint that many documents of a batch
hold is pre-aggregated in each task and joined back by a join that AQE splits where skewed. Of such a window, each task
settles all documents but its own least one, so a bucket gets one document from each task.

Defined results: null texts have no words; rows that share a doc_id are one document (they never remove words from
each other, in one batch or over several) and are judged on their own text; null doc_ids count as one document below all
others; an empty table gives no rows; other columns pass through. doc_id must be castable to long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .line_dedup import NO_ID, with_row_key
from .storage import shared_folder, stored
from .words import as_bytes, bounded, column, inside_rows, lean, mix, rolling, split_words



def fingerprints(hashes: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the batch (by index of its first word): whether it is inside a row, and its fingerprint.
    The fingerprint is the least gram hash of the window; returned are window starts, fingerprints and rows."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none
    grams = rolling(hashes, gram)
    span = window - gram + 1  # grams of one window
    # sliding minimum by doubling
    least, width = grams, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    start = np.flatnonzero(inside_rows(rows, window, n))
    row = np.searchsorted(rows, start, "right") - 1
    return start, least[start], row


def _fingerprint_rows(window: int, gram: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            words = split_words(*as_bytes(column(batch, "text")))
            start, fp, row = fingerprints(words.hashes, words.rows, window, gram)
            if not len(start):
                continue
            new = np.ones(len(start), dtype=bool)  # neighbours mostly share theirs
            new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
            docs = column(batch, "doc").to_numpy(zero_copy_only=False)[row[new]]
            tags = column(batch, "tag").to_numpy(zero_copy_only=False)[row[new]]
            arrays = [pa.array(fp[new].view(np.int64)), pa.array(docs), pa.array(tags)]
            yield pa.RecordBatch.from_arrays(arrays, ["fp", "doc", "tag"])

    return run


class FingerprintIndex:
    """A log of sorted immutable runs in a folder (of the shared folder, unless named)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, window: int = 50, gram: int = 8, fanout: int = 4):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.folder = folder or f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.version = 0
        self.runs: list[tuple[int, str, int]] = []  # tier, folder, buckets
        self.texts: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier session has left in `folder`."""
        log = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/log").orderBy(F.desc("version")).first()
        index = cls(spark, folder, window=log["window"], gram=log["gram"], fanout=log["fanout"])
        index.version, index.texts = log["version"], list(log["texts"])
        index.runs = [(r["tier"], r["path"], r["buckets"]) for r in log["runs"]]
        return index

    def _commit(self) -> None:
        """A new version of the log; readers of older ones are not disturbed, as files are never changed."""
        self.version += 1
        row = (self.version, self.window, self.gram, self.fanout, self.runs, self.texts)
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _write(self, entries: DataFrame, tier: int) -> tuple[int, str, int]:
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        sorted_ = entries.repartition(buckets, "fp").sortWithinPartitions("fp", "doc")
        sorted_.write.bucketBy(buckets, "fp").sortBy("fp").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # of the catalogue only: the files stay
        return tier, path, buckets

    def _run(self, run: tuple[int, str, int]) -> DataFrame:
        """Entries (fp, doc, tag) of a run, known to be bucketed and sorted."""
        _, path, buckets = run
        name = path.rsplit("/", 1)[1]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, doc BIGINT, tag BIGINT) USING parquet "
            f"CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def fingerprints_of(self, docs: DataFrame) -> DataFrame:
        """(fp, doc, tag) of a batch of documents."""
        return with_row_key(docs).mapInArrow(_fingerprint_rows(self.window, self.gram), "fp long, doc long, tag long")

    def entries(self) -> DataFrame:
        """(fp, doc, tag) over all runs."""
        if not self.runs:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*[r[1] for r in self.runs])

    def earlier(self, fps: DataFrame) -> DataFrame:
        """Entries of all runs with a fingerprint of `fps`: one merge join for each run."""
        out = self.spark.createDataFrame([], ENTRY_SCHEMA)
        for run in self.runs:
            out = out.unionAll(self._run(run).hint("merge").join(fps.hint("merge"), "fp").select("fp", "doc", "tag"))
        return out

    def append(self, entries: DataFrame, texts: str | None = None) -> None:
        """Adds entries as one run of the lowest tier, and merges the runs of every tier that is full."""
        self.runs.append(self._write(entries, 0))
        if texts:
            self.texts.append(texts)
        tier = 0
        while len(full := [r for r in self.runs if r[0] == tier]) >= self.fanout:
            merged = self.spark.read.schema(ENTRY_SCHEMA).parquet(*[r[1] for r in full])
            self.runs = [r for r in self.runs if r[0] != tier] + [self._write(merged, tier + 1)]
            tier += 1
        self._commit()

    def add(self, docs: DataFrame, *, keep: list[str], text_out: bool = False, prefix: str = "") -> DataFrame:
        """Takes a batch in. Returns its `keep` columns with n_words, n_removed, kept_sha256 (kept words joined by one
        space) and with `text_out` kept_text."""
        spark, window, gram = self.spark, self.window, self.gram
        own = docs.select(
            *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)],
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__doc"),
            F.xxhash64("text").alias("__tag"),
            F.col("text").alias("__text"),
        )
        kept = [T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
        keys = [T.StructField("__doc", T.LongType()), T.StructField("__tag", T.LongType())]
        found_words = [T.StructField("__n_words", T.LongType()), T.StructField("__sha", T.StringType()), T.StructField("__z", T.BinaryType())]
        names = [f.name for f in kept]
        folder = f"{self.folder}/texts_{uuid.uuid4().hex}"
        first = T.StructType([*kept, *keys, *found_words])
        own.mapInArrow(_first_pass(names), first).write.parquet(folder)
        passed = spark.read.schema(first).parquet(folder)

        with self._sorted_runs():
            found = stored(self.fingerprints_of(docs).repartition("fp"))
            by_fp = found.groupBy("fp").agg(F.min("doc").alias("least"), F.max("doc").alias("greatest"))
            past = stored(self.earlier(by_fp.select("fp")))
        several = by_fp.where(F.col("least") < F.col("greatest")).select("fp")
        shared = several.unionAll(past.select("fp")).distinct()
        held = found.join(shared, "fp").select("fp", "doc", "tag", F.lit(False).alias("past"))
        held = held.unionAll(past.select("fp", "doc", "tag", F.lit(True).alias("past")))
        marked = held.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("past").alias("__past")).agg(
            F.collect_set("fp").alias("__fps")
        )
        texts = passed.select("__doc", "__tag", "__z", F.lit(False).alias("__past"))
        if self.texts:
            older = spark.read.schema("__doc long, __tag long, __z binary").parquet(*self.texts)
            texts = texts.unionAll(older.select("__doc", "__tag", "__z", F.lit(True).alias("__past")))
        # rows that repeat doc_id and text have one text
        some = marked.join(texts, ["__doc", "__tag", "__past"]).dropDuplicates(["__doc", "__tag", "__past"])
        some = stored(some.select("__doc", "__tag", "__past", "__z", "__fps"))
        words = passed.join(marked.where("not __past"), ["__doc", "__tag"], "left_semi").agg(F.sum("__n_words")).first()[0] or 0
        n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(words) // PER_BUCKET))

        def dealt(frame: DataFrame) -> DataFrame:
            return frame.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")

        blocks = some.mapInArrow(_window_blocks(window, gram, n_buckets), BLOCK)
        later = dealt(dealt(blocks).mapInArrow(_resolve(n_buckets), BLOCK))
        starts = later.mapInArrow(_gather, "__doc long, __tag long, __at binary")
        losing = some.where("not __past").select("__doc", "__tag", "__z").join(starts, ["__doc", "__tag"])
        removed = "__doc long, __tag long, __n_removed long, __new_sha string, __left binary, __dead array<bigint>"
        cut = stored(losing.mapInArrow(_remove(window, gram, text_out), removed))

        dead = cut.select(F.col("__doc").alias("doc"), F.col("__tag").alias("tag"), F.explode("__dead").alias("fp"))
        self.append(found.join(dead, ["fp", "doc", "tag"], "left_anti").select("fp", "doc", "tag").distinct(), folder)

        out = passed.select(*names, "__doc", "__tag", "__n_words", "__sha", *(["__z"] if text_out else []))
        out = out.join(cut.drop("__dead"), ["__doc", "__tag"], "left")
        more = [
            F.col("__n_words").alias(prefix + "n_words"),
            F.coalesce("__n_removed", F.lit(0)).cast("long").alias(prefix + "n_removed"),
            F.coalesce("__new_sha", "__sha").alias(prefix + "kept_sha256"),
        ]
        columns = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]
        if not text_out:
            return out.select(*columns, *more)
        kept_text = F.coalesce("__left", "__z")
        fields = [docs.schema[c] for c in keep] + [T.StructField(prefix + c, t) for c, t in COUNTS]
        whole = out.select(*columns, *more, kept_text.alias("__z"))
        return whole.mapInArrow(_texts(prefix), T.StructType([*fields, T.StructField(prefix + "kept_text", T.StringType())]))

    @contextmanager
    def _sorted_runs(self):
        """Lets Spark rely on the order within bucket files: each bucket of a run is one sorted file."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)


ENTRY_SCHEMA = "fp long, doc long, tag long"
LOG_SCHEMA = (
    "version int, window int, gram int, fanout int, "
    "runs array<struct<tier:int,path:string,buckets:int>>, texts array<string>"
)
COUNTS = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
PER_BUCKET = 1 << 21


BLOCK = "bucket int, doc binary, tag binary, past binary, h1 binary, h2 binary, row binary, at binary"
FLUSH = 250_000


def _later(h1, h2, doc, past) -> tuple[np.ndarray, np.ndarray]:
    """An order by (h1, h2, earlier batches first, doc), and which of the windows in it lose their words: the first one
    of their group is of another document."""
    order = np.lexsort((doc, ~past, h2, h1))
    h1, h2, doc, past = h1[order], h2[order], doc[order], past[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, ~past & (doc != doc[first])


def _starts_blocks(doc, tag, row, at, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Window starts that lose their words as blocks, one for each bucket of documents."""
    if not len(row):
        return
    target = mix(doc.view(np.uint64))[row] % np.uint64(n_buckets)
    order = np.lexsort((at, row, target))
    target, row, at = target[order], row[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for a, b in zip(edge, [*edge[1:], len(row)], strict=True):
        used, local = np.unique(row[a:b], return_inverse=True)
        yield _block(int(target[a]), doc[used], tag[used], None, None, None, local, at[a:b])


def _block(bucket: int, doc, tag, past, h1: bytes | None, h2: bytes | None, local, at) -> pa.RecordBatch:
    narrow = len(doc) < 1 << 16
    numbers = (b"2" if narrow else b"4") + local.astype("<u2" if narrow else "<u4").tobytes()
    flags = None if past is None else past.astype(np.uint8).tobytes()
    values = [doc.astype("<i8").tobytes(), tag.astype("<i8").tobytes(), flags, h1, h2, numbers, at.astype("<i4").tobytes()]
    arrays = [pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
    return pa.RecordBatch.from_arrays(arrays, BLOCK_NAMES)


def _unblock(batch: pa.RecordBatch, r: int, rows: int) -> tuple:
    """doc, tag, row (from `rows` on) and at of a block."""
    doc, tag, row, at = (column(batch, c)[r].as_py() for c in ("doc", "tag", "row", "at"))
    local = np.frombuffer(row[1:], "<u2" if row[:1] == b"2" else "<u4").astype(np.int64) + rows
    return np.frombuffer(doc, "<i8"), np.frombuffer(tag, "<i8"), local, np.frombuffer(at, "<i4")


class _Windows:
    """Gathers windows of a task. A window that the task has in an earlier document too loses its words at once; only
    those of the least document go out, in blocks, one for each bucket."""

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self.parts: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.pasts: list[np.ndarray] = []
        self.rows = self.held = 0

    def add(self, h1, h2, row, at, doc, tag, past) -> None:
        self.parts.append((h1, h2, row + self.rows, at))
        self.docs.append(doc)
        self.tags.append(tag)
        self.pasts.append(past)
        self.rows += len(doc)
        self.held += len(h1)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        h1, h2, row, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc, tag, past = (np.concatenate(x) for x in (self.docs, self.tags, self.pasts))
        self.__init__(self.n_buckets)
        order, later = _later(h1, h2, doc[row], past[row])
        h1, h2, row, at = h1[order], h2[order], row[order], at[order]
        yield from _starts_blocks(doc, tag, row[later], at[later], self.n_buckets)
        h1, h2, row, at = (x[~later] for x in (h1, h2, row, at))
        bucket = (h1 % np.uint64(self.n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")  # within a bucket still by h1
        edge = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        for a, b in zip(edge, [*edge[1:], len(by)], strict=True):
            own = by[a:b]
            used, local = np.unique(row[own], return_inverse=True)
            gaps = np.diff(h1[own] >> np.uint64(20), prepend=np.uint64(0))
            wide = int(gaps.max()) >= 1 << 32
            packed = (b"8" if wide else b"4") + gaps.astype("<u8" if wide else "<u4").tobytes()
            checks = (h2[own] >> np.uint64(32)).astype("<u4").tobytes()
            yield _block(int(bucket[own[0]]), doc[used], tag[used], past[used], packed, checks, local, at[own])


BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _window_blocks(window: int, gram: int, n_buckets: int):
    """Blocks of the windows whose fingerprint is shared."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, opener = _Windows(n_buckets), zstandard.ZstdDecompressor()
        for batch in bounded(batches, "__z", 1 << 18):
            texts = [opener.decompress(z) for z in column(batch, "__z").to_pylist()]
            raw, off = as_bytes(pa.array(texts, pa.binary()))
            words = split_words(raw, off)
            start, fp, row = fingerprints(words.hashes, words.rows, window, gram)
            wanted = np.unique(column(batch, "__fps").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if not len(start) or not len(wanted):
                continue
            at = np.searchsorted(wanted, fp)
            at[at == len(wanted)] = 0
            hit = wanted[at] == fp
            start, row = start[hit], row[hit]
            second = split_words(raw, off, seed=2)
            h1, h2 = rolling(words.hashes, window)[start], rolling(second.hashes, window, 1)[start]
            ids = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("__doc", "__tag", "__past")]
            windows.add(h1, h2, row, start - words.rows[row], *ids)
            if windows.held >= FLUSH:
                yield from windows.flush()
        yield from windows.flush()

    return run


def _resolve(n_buckets: int):
    """Per bucket: the windows of all documents but the least that holds them, as blocks by document."""

    def decide(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, tag, row, at, past, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
        order, later = _later(h1, h2, doc[row], past[row])
        row, at = row[order], at[order]
        yield from _starts_blocks(doc, tag, row[later], at[later], n_buckets)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, rows = None, 0
        for batch in batches:
            for r in range(batch.num_rows):
                bucket, flags, h1, h2 = (column(batch, c)[r].as_py() for c in ("bucket", "past", "h1", "h2"))
                if h1 is None:  # decided in its task
                    yield batch.slice(r, 1)
                    continue
                if bucket != number and held:
                    yield from decide(held)
                    held, rows = [], 0
                number = bucket
                sums = np.cumsum(np.frombuffer(h1[1:], "<u8" if h1[:1] == b"8" else "<u4").astype(np.uint64))
                block = _unblock(batch, r, rows)
                held.append((*block, np.frombuffer(flags, np.uint8) > 0, sums, np.frombuffer(h2, "<u4")))
                rows += len(block[0])
        if held:
            yield from decide(held)

    return run


@lean
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket of documents: one row for each with its window starts."""
    held: list[tuple] = []
    number, rows = None, 0

    def told() -> pa.RecordBatch:
        doc, tag, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, tag[row], doc[row]))
        row, at = row[order], at[order]
        who = np.stack([doc[row], tag[row]], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]).any(axis=1)]))
        lists = [np.unique(at[a:b]).astype("<i4").tobytes() for a, b in zip(edge, [*edge[1:], len(at)], strict=True)]
        arrays = [pa.array(who[edge, 0]), pa.array(who[edge, 1]), pa.array(lists, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["__doc", "__tag", "__at"])

    for batch in batches:
        for r, bucket in enumerate(column(batch, "bucket").to_pylist()):
            if bucket != number and held:
                yield told()
                held, rows = [], 0
            number = bucket
            held.append(_unblock(batch, r, rows))
            rows += len(held[-1][0])
    if held:
        yield told()


def _first_pass(keep: list[str]):
    """What needs no other document: words, digest of the whole, and the compressed text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in bounded(batches, "__text"):
            raw, off = as_bytes(column(batch, "__text"))
            n_words, shas, packed = [], [], []
            for r in range(len(off) - 1):
                data = raw[off[r] : off[r + 1]].tobytes()
                words = data.split()  # of bytes: at space, \t, \n, \v, \f and \r
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                packed.append(packer.compress(data))
            arrays = [column(batch, c) for c in (*keep, "__doc", "__tag")]
            arrays += [pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "__doc", "__tag", "__n_words", "__sha", "__z"])

    return run


def _remove(window: int, gram: int, text_out: bool):
    """Of documents that lose words: how many, the digest of the rest, and the fingerprints none of whose windows stays."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            n_removed, shas, left, dead = [], [], [], []
            for z, starts in zip(column(batch, "__z").to_pylist(), column(batch, "__at").to_pylist(), strict=True):
                raw, off = as_bytes(pa.array([opener.decompress(z)], pa.binary()))
                words = raw.tobytes().split()
                at = np.frombuffer(starts, "<i4")
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                n_removed.append(int(gone.sum()))
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                shas.append(hashlib.sha256(kept).hexdigest())
                left.append(packer.compress(kept) if text_out else None)
                split = split_words(raw, off)
                start, fp, _ = fingerprints(split.hashes, split.rows, window, gram)
                stays = ~np.isin(start, at)
                dead.append(np.setdiff1d(fp[~stays], fp[stays]).view(np.int64))
            arrays = [column(batch, c) for c in ("__doc", "__tag")]
            arrays += [pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(left, pa.binary())]
            arrays.append(pa.array(dead, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["__doc", "__tag", "__n_removed", "__new_sha", "__left", "__dead"])

    return run


def _texts(prefix: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "__z", 1 << 19):
            texts = [b" ".join(opener.decompress(z).split()).decode() for z in column(batch, "__z").to_pylist()]
            others = [c for c in batch.schema.names if c != "__z"]
            arrays = [*(column(batch, c) for c in others), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*others, prefix + "kept_text"])

    return run


def dedup_substrings(
    docs: DataFrame,
    *,
    keep: list[str],
    window: int = 50,
    gram: int = 8,
    n_batches: int = 2,
    text_out: bool = False,
    prefix: str = "",
    index: FingerprintIndex | None = None,
) -> DataFrame:
    """`keep` columns with n_words, n_removed, kept_sha256 (kept words joined by one space) and with `text_out`
    kept_text. Documents enter the index (a new one, or the one given) in `n_batches` batches of ascending doc_id."""
    index = index or FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    shares = [k / n_batches for k in range(1, n_batches)]
    cuts = docs.select(F.percentile_approx(key, F.array(*map(F.lit, shares))).alias("cuts")).first()["cuts"] if shares else []
    out = None
    for low, high in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        inside = (F.lit(True) if low is None else key > low) & (F.lit(True) if high is None else key <= high)
        part = index.add(docs.where(inside), keep=keep, text_out=text_out, prefix=prefix)
        out = part if out is None else out.unionAll(part)
    return out
