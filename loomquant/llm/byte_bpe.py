"""Byte-level BPE: ranked merges folded over the bytes of distinct words by Spark's higher-order functions.

Each word of the whole table is folded once, however many documents and tasks have it. A first Arrow function splits
texts by the tokenizer's pattern and numbers the distinct words of a block of documents; documents become arrays of
these numbers. Words that are tokens themselves need no fold; the others go, as blocks, to buckets by their hash. There a
second Arrow function tells distinct words apart and hands them over as arrays of byte ranks. The fold runs in the JVM on
these: `aggregate` repeats "merge the leftmost adjacent pair of least rank", looking pair ranks up in a literal map (an
array of hash slots, since a literal MAP is searched linearly), and decoding concatenates the tokens' binary pieces. A
third function sends each block what its words have become, and a last one puts the documents of a block together. A block
ends after `max_words` distinct words or `BLOCK_BYTES` of numbers, which bounds memory without changing results; nothing
is broadcast but rank table and pieces, whose size the vocabulary fixes.

Defined results: null and empty texts have no tokens; repeated rows are encoded one by one; an empty table gives no
rows; other columns pass through. Ranks above 131,071 raise an error. Words of more than `long_bytes` bytes are merged by the
same rule in Python with a heap, as the fold takes time quadratic in the length of a word.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .words import bounded, column, give_back, lean

RANK_BITS = 17
LEFT = 1 << RANK_BITS
NO_RANK = 1 << 20
BLOCK_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str

    def __getstate__(self) -> dict:
        """What is derived stays behind: a task derives what it needs."""
        return {"ranks": self.ranks, "pattern": self.pattern}

    @cached_property
    def pieces(self) -> list[bytes]:
        """Bytes of each id."""
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Rank of the token that two tokens make, by their ids."""
        out = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    out[left, right] = rank
        return out

    @cached_property
    def slots(self) -> list[int]:
        return rank_table(self.pairs)

    def byte_ranks(self) -> list[int]:
        return [self.ranks[bytes([b])] for b in range(256)]


def merge(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word by a heap of pairs: the leftmost pair of least rank first."""
    ids = [vocabulary.ranks[bytes([b])] for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    alive = [True] * len(ids)
    pairs = vocabulary.pairs
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if not alive[i] or j >= len(ids) or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(ids)
            if a >= 0 and b < len(ids) and (r := pairs.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x, there in zip(ids, alive, strict=True) if there]


def rank_table(pairs: dict[tuple[int, int], int]) -> list[int]:
    """A flat hash table of key << RANK_BITS | rank in which every key stands in one of two slots (0: free)."""
    if any(max(pair) >= LEFT or rank >= LEFT for pair, rank in pairs.items()):
        raise ValueError(f"ranks must stay below {LEFT}")
    size = 1 << (2 * max(1, len(pairs))).bit_length()
    out = [0] * size
    for (left, right), rank in pairs.items():
        item, slot = ((left * LEFT + right) << RANK_BITS) | rank, _slots(left, right, size)[0]
        for _ in range(1000):
            item, out[slot] = out[slot], item
            if not item:
                break
            one, two = _slots((item >> RANK_BITS) // LEFT, (item >> RANK_BITS) % LEFT, size)
            slot = two if slot == one else one
        else:
            raise ValueError("the pairs of this vocabulary don't fit the table")
    return out


def _slots(left: int, right: int, size: int) -> tuple[int, int]:
    return (left * 40_503 + right * 9_973) & (size - 1), (left * 7_919 + right * 65_537 + 17) & (size - 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, table: Column, size: int) -> Column:
    """Ids of a word given as its bytes' ids and the ranks of their adjacent pairs. The state holds the ids and the
    ranks of adjacent pairs, NO_RANK where a pair is no token."""

    def pair_rank(left: Column, right: Column) -> Column:
        key = left * F.lit(LEFT) + right
        one = F.get(table, (left * F.lit(40_503) + right * F.lit(9_973)).bitwiseAND(F.lit(size - 1)))
        two = F.get(table, (left * F.lit(7_919) + right * F.lit(65_537) + F.lit(17)).bitwiseAND(F.lit(size - 1)))

        def rank(item: Column, other: Column) -> Column:
            return F.when(F.shiftright(item, RANK_BITS) == key, item.bitwiseAND(F.lit(LEFT - 1))).otherwise(other)

        return rank(one, rank(two, F.lit(NO_RANK)))

    ids, ranks = word["ids"], word["ranks"]
    n = F.size(ids)
    start = F.struct(ids.alias("ids"), ranks.alias("ranks"))

    def step(state: Column, _: Column) -> Column:
        return _let(
            F.array_min(state["ranks"]),
            lambda least: F.when(least == NO_RANK, state).otherwise(
                _let(F.array_position(state["ranks"], least).cast("int"), lambda p: merged(state, least, p))
            ),
        )

    def merged(state: Column, least: Column, p: Column) -> Column:
        ids, old = state["ids"], state["ranks"]
        none = F.array().cast("array<bigint>")
        left = F.when(p > 1, F.array(pair_rank(F.get(ids, p - 2), least))).otherwise(none)
        right = F.when(p + 1 < F.size(ids), F.array(pair_rank(least, F.get(ids, p + 1)))).otherwise(none)
        before = F.when(p > 2, F.slice(old, F.lit(1), p - 2)).otherwise(none)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), p - 1), F.array(least), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
            F.concat(before, left, right, F.slice(old, p + 2, F.size(old) + 1)).alias("ranks"),
        )

    return F.when(n < 2, ids).otherwise(F.aggregate(F.slice(ids, F.lit(2), n), start, step)["ids"])


def pieces_of(ids: Column, blob: Column, ends: Column) -> Column:
    """The bytes that ids stand for: their pieces, cut out of `blob`, one after the other."""

    def piece(i: Column) -> Column:
        start = F.get(ends, i)
        return F.substring(blob, start + 1, F.get(ends, i + 1) - start)

    return F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, piece(i.cast("int"))))


class _Numbers(dict):
    """Word to its number in the block, in order of first use."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


DOC, KNOWN, WORDS = 0, 1, 2


_PACKER, _OPENER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(raw: bytes) -> bytes:
    return _PACKER.compress(raw)


def _open(packed: bytes) -> bytes:
    return _OPENER.decompress(packed)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well."""
    return _pack(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _open_numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(_open(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _pack_lists(sizes: np.ndarray, joined: bytes) -> bytes:
    """Lists of bytes, as their number, sizes and contents."""
    return _pack(len(sizes).to_bytes(4, "little") + np.asarray(sizes).astype("<u4").tobytes() + joined)


def _open_lists(packed: bytes) -> tuple[np.ndarray, bytes]:
    """Ends of the lists (with a leading zero) and their contents."""
    raw = _open(packed)
    n = int.from_bytes(raw[:4], "little")
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)]), raw[4 + 4 * n :]


def _split(vocabulary: Vocabulary, keep: list[str], schema: pa.Schema, max_words: int, n_buckets: int):
    """Documents as numbers of their block's words, what is known of these, and the words that need a fold by bucket."""
    names = [*schema.names[: len(keep)], "__key", "__kind", "__block", "__data"]

    def rows(n: int, kept: list | None, key, kind: int, block: int, data: list[bytes]) -> pa.RecordBatch:
        arrays = kept or [pa.nulls(n, schema.field(i).type) for i in range(len(keep))]
        arrays = [*arrays, pa.array(key, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(data, pa.binary())], names)

    def finished(numbers: _Numbers, block: int) -> Iterator[pa.RecordBatch]:
        words = [w.encode() for w in numbers.words]
        known = np.fromiter((vocabulary.ranks.get(w, -1) for w in words), np.int64, len(words))
        fold = np.flatnonzero(known < 0)
        bucket = np.fromiter((zlib.crc32(words[i]) for i in fold.tolist()), np.int64, len(fold)) % n_buckets
        known[fold] = -1 - bucket
        yield rows(1, None, [block], KNOWN, block, [_pack_numbers((known & 0xFFFFFFFF).astype(np.uint32))])
        by = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        keys, data = [], []
        for a, b in zip(edge, [*edge[1:], len(by)], strict=True):
            some = [words[i] for i in fold[by[a:b]].tolist()]
            keys.append(-1 - int(bucket[by[a]]))
            data.append(_pack_lists(np.array([len(w) for w in some]), b"".join(some)))
        if keys:
            yield rows(len(keys), None, keys, WORDS, block, data)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(vocabulary.pattern).findall
        numbers, held = _Numbers(), 0
        block = TaskContext.get().partitionId() << 32
        for batch in bounded(batches, limit=1 << 20):
            codes = [
                np.fromiter(map(numbers.__getitem__, find(text) if text else ()), np.uint32)
                for text in column(batch, "text").to_pylist()
            ]
            n = batch.num_rows
            yield rows(n, [column(batch, c) for c in keep], [block] * n, DOC, block, [_pack_numbers(c) for c in codes])
            held += sum(4 * len(c) for c in codes)
            if len(numbers) >= max_words or held >= BLOCK_BYTES:
                yield from finished(numbers, block)
                numbers, held, block = _Numbers(), 0, block + 1
        if numbers:
            yield from finished(numbers, block)

    return run


_NESTED = pa.struct([("ids", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
_ASKED = [("bucket", pa.int64()), ("seq", pa.int32()), ("block", pa.int64()), ("asked", pa.binary())]
_ASKED += [("words", pa.list_(_NESTED)), ("longs", pa.list_(pa.binary()))]
CHUNK = 500


def _distinct(vocabulary: Vocabulary, long_bytes: int):
    """Per bucket its distinct words, CHUNK to a row, and for each block which of them it asked for. Rows of a bucket are
    numbered, so that the next function can tell whether any is missing or out of order."""
    byte_ranks = np.array(vocabulary.byte_ranks(), dtype=np.int64)
    of_bytes = np.full((256, 256), NO_RANK, dtype=np.int64)
    for (left, right), rank in vocabulary.pairs.items():
        if len(vocabulary.pieces[left]) == len(vocabulary.pieces[right]) == 1:
            of_bytes[vocabulary.pieces[left][0], vocabulary.pieces[right][0]] = rank
    schema = pa.schema(_ASKED)

    def nested(words: list[bytes]) -> pa.Array:
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
        inner = np.ones(len(raw), dtype=bool)  # bytes followed by another one of their word
        inner[ends[1:][np.diff(ends) > 0] - 1] = False
        pair_ends = np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - 1, 0))]).astype(np.int32)
        at = np.flatnonzero(inner)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(byte_ranks[raw], pa.int64()))
        ranks = pa.ListArray.from_arrays(pa.array(pair_ends), pa.array(of_bytes[raw[at], raw[at + 1]], pa.int64()))
        return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays([ids, ranks], names=["ids", "ranks"]))

    def row(bucket: int, seq: int, block: int | None, asked: bytes | None, words: pa.Array | None, longs) -> pa.RecordBatch:
        words = pa.nulls(1, schema.field("words").type) if words is None else words
        plain = zip((bucket, seq, block, asked), schema.types[:4], strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in plain), words, pa.array([longs], schema.types[5])], schema=schema)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            columns = (column(batch, c).to_pylist() for c in ("__key", "__kind", "__block", "__data"))
            for key, kind, block, data in zip(*columns, strict=True):
                if kind == WORDS:
                    of_bucket.setdefault(-1 - key, []).append((block, data))
        for bucket in sorted(of_bucket):
            numbers: dict[bytes, int] = {}
            asked = []
            for block, data in sorted(of_bucket.pop(bucket)):
                ends, raw = _open_lists(data)
                at = ends.tolist()
                some = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(at, at[1:], strict=False)]
                asked.append((block, _pack_numbers(np.array(some))))
            words, seq = list(numbers), 0
            for a in range(0, len(words), CHUNK):
                some = words[a : a + CHUNK]
                longs = [w if len(w) > long_bytes else None for w in some]
                yield row(bucket, seq, None, None, nested([w if len(w) <= long_bytes else b"" for w in some]), longs)
                seq += 1
            for block, which in asked:
                yield row(bucket, seq, block, which, None, None)
                seq += 1

    return run


REPLY = "__key long, __bucket long, __ids binary, __bytes binary"


def _reply(vocabulary: Vocabulary):
    """For each block and bucket the ids and the bytes of the words that it asked for."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, 0
        ids: list[bytes] = []
        decoded: list[bytes] = []
        for batch in batches:
            out: list[tuple] = []
            columns = [column(batch, c) for c in ("bucket", "seq", "block", "asked", "longs")]
            ids_of, bytes_of = (column(batch, "folded").field(c) for c in ("ids", "bytes"))
            for r in range(batch.num_rows):
                bucket, seq, block, asked = (c[r].as_py() for c in columns[:4])
                if bucket != now:
                    now, due, ids, decoded = bucket, 0, [], []
                if seq != due:
                    raise RuntimeError(f"row {seq} of bucket {bucket} came where row {due} was due")
                due += 1
                if block is None:
                    lists = ids_of[r].values
                    data = lists.flatten().to_numpy().astype("<u4").tobytes()
                    ends = np.concatenate([[0], 4 * np.cumsum(lists.value_lengths().to_numpy())]).tolist()
                    folded = zip(ends, ends[1:], bytes_of[r].as_py(), columns[4][r].as_py(), strict=False)
                    for a, b, text, word in folded:
                        if word is None:
                            ids.append(data[a:b])
                            decoded.append(text)
                        else:
                            own = merge(word, vocabulary)
                            ids.append(np.array(own, dtype="<u4").tobytes())
                            decoded.append(b"".join([vocabulary.pieces[i] for i in own]))
                else:
                    which = _open_numbers(asked).tolist()
                    packed = []
                    for of in (ids, decoded):
                        some = [of[i] for i in which]
                        packed.append(_pack_lists(np.array([len(x) for x in some]), b"".join(some)))
                    out.append((block, bucket, *packed))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["__key", "__bucket", "__ids", "__bytes"])

    return run


def _assemble(vocabulary: Vocabulary, keep: list[str], schema: pa.Schema, ids_out: bool):
    """The documents of a block from its words' numbers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = left["__kind"].to_numpy()
        docs = left.filter(pa.array(kinds == DOC))
        known = left.filter(pa.array(kinds == KNOWN))["__data"].to_pylist()
        if not docs.num_rows:
            return schema.empty_table()
        ranks = _open_numbers(known[0]).view(np.int32) if known else np.empty(0, np.int32)
        ids: list[bytes] = [b""] * len(ranks)
        decoded: list[bytes] = [b""] * len(ranks)
        for i in np.flatnonzero(ranks >= 0).tolist():
            ids[i], decoded[i] = int(ranks[i]).to_bytes(4, "little"), vocabulary.pieces[ranks[i]]
        folded = np.flatnonzero(ranks < 0)
        by = folded[np.argsort(-1 - ranks[folded], kind="stable")]  # by bucket, then in order of first use
        buckets = -1 - ranks[by]
        answered = 0
        for bucket, *packed in zip(*(right[c].to_pylist() for c in ("__bucket", "__ids", "__bytes")), strict=True):
            a, b = np.searchsorted(buckets, [bucket, bucket + 1]).tolist()
            for of, data in zip((ids, decoded), packed, strict=True):
                ends, raw = _open_lists(data)
                at = ends.tolist()
                for i, start, end in zip(by[a:b].tolist(), at, at[1:], strict=False):
                    of[i] = raw[start:end]
            answered += b - a
        if answered != len(by):
            raise RuntimeError(f"{len(by) - answered} words of a block have no ids")
        n_tokens, ids_sha, decoded_sha, ids_all = [], [], [], []
        for data in docs["__data"].to_pylist():
            code = _open_numbers(data).tolist()
            own = b"".join(map(ids.__getitem__, code))
            n_tokens.append(len(own) // 4)
            ids_sha.append(hashlib.sha256(own).hexdigest())
            decoded_sha.append(hashlib.sha256(b"".join(map(decoded.__getitem__, code))).hexdigest())
            if ids_out:
                ids_all.append(np.frombuffer(own, "<u4").astype(np.int32))
        arrays = [docs[c] for c in docs.column_names[: len(keep)]]
        arrays += [pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
        arrays += [pa.array(ids_all, pa.list_(pa.int32()))] if ids_out else []
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    *,
    keep: list[str],
    prefix: str = "",
    ids_out: bool = False,
    max_words: int = 1 << 18,
    long_bytes: int = 2048,
) -> DataFrame:
    """`keep` columns with n_tokens, the digest of the ids (little-endian unsigned 32 bits), the digest of the bytes
    they decode to, and with `ids_out` the ids."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    more = [("__key", T.LongType()), ("__kind", T.IntegerType()), ("__block", T.LongType()), ("__data", T.BinaryType())]
    split_schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in more)])
    source = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], "text")
    names = [f.name for f in kept]
    split = _split(vocabulary, names, to_arrow_schema(split_schema), max_words, 4 * n)
    # read twice, written once: both readers have the same exchange
    dealt = source.mapInArrow(split, split_schema).repartition(n, "__key")

    longs = T.ArrayType(T.LongType())
    words = T.ArrayType(T.StructType([T.StructField("ids", longs), T.StructField("ranks", longs)]))
    plain = [("bucket", T.LongType()), ("seq", T.IntegerType()), ("block", T.LongType()), ("asked", T.BinaryType())]
    asked_schema = T.StructType([*(T.StructField(k, t) for k, t in plain), T.StructField("words", words), T.StructField("longs", T.ArrayType(T.BinaryType()))])
    asked = dealt.mapInArrow(_distinct(vocabulary, long_bytes), asked_schema)
    # what the vocabulary gives are scalar subqueries, which the optimizer puts where their columns are used, once each: as
    # literals they would be in the text of every plan and of its events on the driver
    edges = np.concatenate([[0], np.cumsum([len(p) for p in vocabulary.pieces])]).astype(np.int32)
    given = {
        "slots": pa.array([vocabulary.slots], pa.list_(pa.int64())),
        "ends": pa.array([edges], pa.list_(pa.int32())),
        "blob": pa.array([b"".join(vocabulary.pieces)], pa.binary()),
    }
    size = len(vocabulary.slots)

    def decoded(ids: Column) -> Column:
        return _let(F.col("ends"), lambda e: _let(F.col("blob"), lambda b: F.transform(ids, lambda i: pieces_of(i, b, e))))

    folded = _let(F.col("slots"), lambda t: F.transform("words", lambda w: fold_merges(w, t, size)))
    both = _let(folded, lambda ids: F.struct(ids.alias("ids"), decoded(ids).alias("bytes")))
    told = asked.withColumns({c: spark.createDataFrame(pa.table({c: values})).scalar() for c, values in given.items()})
    merged = told.select("bucket", "seq", "block", "asked", both.alias("folded"), "longs")
    give_back()
    replies = merged.mapInArrow(_reply(vocabulary), REPLY)

    extra = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    extra += [("ids", T.ArrayType(T.IntegerType()))] if ids_out else []
    out = T.StructType([*kept, *(T.StructField(prefix + c, t) for c, t in extra)])
    both = dealt.groupBy("__key").cogroup(replies.repartition(n, "__key").groupBy("__key"))
    whole = both.applyInArrow(_assemble(vocabulary, names, to_arrow_schema(out), ids_out), out)
    return whole.select(*[F.col(a).alias(b) for a, b in zip(names, keep, strict=True)], *[prefix + c for c, _ in extra])
