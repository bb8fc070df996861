"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets are linked when 100 * intersection >= 75 * union, which is 7 * |symmetric difference| <= |x| + |y|. With
y the smaller of the two, at most H = 2 * |x| // 7 shingles differ. Sizes are cut into bands of ratio 4/3, and each band
cuts the universe of shingle hashes into segments of its own. A set is indexed under its own band and under the next one
if larger partners can be there, and looks up its own band only, so the larger of a pair finds the smaller.

What a set does with each of its segments has a value: 0 skips it, 1 looks up the segment's whole subset, and 2 also
the one-deletion neighbourhood (the subset without each of its shingles), which finds partners that differ there in one
shingle at most. Whole subsets and deletions share one index. If the values of a set add up to more than H, any partner is
found. Which values they are is decided by cost: the index counts how many sets hold each signature, those that nobody
else holds are free, and of the others a set takes the least frequent ones until its values suffice (so passages that
many documents share are skipped, and neighbourhoods of rare segments stand in for them). Sets below `DELETIONS_TO`
shingles have neighbourhoods; above that an entry for every shingle would triple the index, so values are 0 or 1, and
bands have a quarter more segments than they need.

A set whose shingles fall into too few segments for its H (`units` <= H; rarer than one in ten thousand) goes through
the same join once more with every shingle a segment of its own, against the sets of the sizes in question.

Signatures travel as blocks, one row for each task and bucket. Signatures that one task alone sees often are dealt
over several buckets. Within a bucket, signatures of up to `COLD` sets yield pairs; more frequent ones yield their
members, which are handled in steps: signatures with equal members collapse into one; members are compared with two
leaders of each signature; sets left in different components stay only if 3/4 of their shingles are known to other
components (no partner is possible below that), are compared with the best-known leader of each signature, and then with
each other by what they lack and have beside that leader. A group of g near copies costs about g comparisons.
Every candidate pair is verified on the shingle sets of its whole texts (64-bit hashes
of shingles; equal texts by 128 bits of their sets, candidates by 64).

Defined results: null texts, empty ones and those without words have no shingles and are linked with nothing; rows that
share a doc_id are verified one by one and come out with one component each; null doc_ids count as the least id and
come out as null; an empty table gives no rows. doc_id must be castable to long.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .line_dedup import NO_ID, with_row_key
from .storage import stored
from .words import U64, as_bytes, bounded, column, lean, mix, rolling, split_words

SHINGLE = 5
COLD = 24
DELETIONS_TO = 118
LEAST_INDEXED = 3
FLUSH = 500_000
LOCALLY_HOT = 1024
SALTS = 16
SIG_BITS = 39
PER_BUCKET = 1 << 20
#: Parts of an entry's code: whether the set looks it up, a one-deletion signature, a segment that has such, segment
#: number, and the size class (logarithm to the base of 1.02, modulo 128: partners are 15 classes apart at most).
OWN, DELETION, MULTI, SEGMENT, CLASS = 1, 2, 4, 3, 9
APART = 15


def most_different(n: int) -> int:
    """Greatest symmetric difference between a set of n shingles and a linked one that is not larger."""
    return 2 * n // 7


def linked(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= 75 * (a + b - shared) and shared > 0


def _bands() -> np.ndarray:
    starts = [LEAST_INDEXED + 1]
    while starts[-1] < 1 << 40:
        starts.append(4 * (starts[-1] - 1) // 3 + 1)
    return np.array(starts, dtype=np.int64)


BANDS = _bands()


def segments_of_band(band: int) -> int:
    largest = int(BANDS[band + 1]) - 1
    needed = most_different(largest) + 1
    if BANDS[band] >= DELETIONS_TO:
        return int(np.ceil(1.25 * needed + np.sqrt(needed)))
    return 1 if needed <= 2 else max(8, -(-largest // 3))


def band_of(n: int) -> int:
    return int(np.searchsorted(BANDS, n, "right")) - 1


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(1.02)) % 128


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = split_words(*as_bytes(texts), lower=True)
    rolled = rolling(words.hashes, SHINGLE)
    out = []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(rolling(words.hashes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.empty(0, U64))
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    one, two = mix(shingles), mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5))
    both = mix(np.array([one.sum(dtype=U64), two.sum(dtype=U64) + U64(len(shingles))], dtype=U64)).view(np.int64)
    return int(both[0]), int(both[1])


def _cut(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The band's segment of each shingle, and where the non-empty segments begin (sorted hashes are in their order)."""
    segment = ((shingles >> U64(32)) * U64(segments_of_band(band))) >> U64(32)
    return segment, np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))


def units(shingles: np.ndarray) -> int:
    """The most that the values of a set's own segments can add up to."""
    band = band_of(len(shingles))
    if band < 0:
        return 0
    first = _cut(shingles, band)[1]
    if BANDS[band] >= DELETIONS_TO:
        return len(first)
    return len(first) + int((np.diff(np.append(first, len(shingles))) > 1).sum())


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set with their codes."""
    n = len(shingles)
    hashes, codes = [], []
    if n < LEAST_INDEXED:
        return np.empty(0, U64), np.empty(0, np.uint16)
    mixed = mix(shingles)
    own = band_of(n)
    base = size_class(n) << CLASS
    for band in (own, own + 1):
        if band < 0 or (band > own and 4 * n // 3 < BANDS[band]):
            continue
        segment, first = _cut(shingles, band)
        salt = mix(np.array([band], dtype=U64))[0]
        sums = np.add.reduceat(mixed, first)
        named = segment[first] + salt
        code = base | (OWN if band == own else 0)
        if BANDS[band] >= DELETIONS_TO:
            hashes.append(mix(sums ^ mix(named)))
            codes.append(np.full(len(first), code, dtype=np.uint16))
            continue
        long = np.diff(np.append(first, n)) > 1
        number = segment[first].astype(np.uint16) << SEGMENT
        hashes.append(mix(sums ^ mix(named)))
        codes.append(number | np.where(long, MULTI, 0).astype(np.uint16) | np.uint16(code))
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        inside = long[which]
        which = which[inside]
        hashes.append(mix((sums[which] - mixed[inside]) ^ mix(named[which])))
        codes.append(number[which] | np.uint16(code | DELETION | MULTI))
    return np.concatenate(hashes), np.concatenate(codes)


def each_shingle(shingles: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle as a segment of its own."""
    code = (size_class(len(shingles)) << CLASS) | (OWN if own else 0)
    return mix(shingles ^ U64(0x5BD1E995)), np.full(len(shingles), code, dtype=np.uint16)


@lean
def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        sets = shingle_sets(column(batch, "text"))
        keys = np.array([set_key(s) for s in sets], dtype=np.int64).reshape(-1, 2)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        most = np.array([units(s) for s in sets], dtype=np.int64)
        arrays = [column(batch, "doc"), column(batch, "tag"), *(pa.array(x) for x in (sizes, keys[:, 0], keys[:, 1], most))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "tag", "n", "k1", "k2", "units"])


BLOCK = "bucket int, hot boolean, node binary, at binary, code binary, sig binary, marks binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


class _Blocks:
    """Gathers the entries of a task and lets them out as blocks, one for each bucket. An entry names its set by `width`
    numbers, which a block holds once for each set if that is shorter."""

    def __init__(self, n_buckets: int, width: int = 1):
        self.n_buckets, self.width = n_buckets, width
        self.flushes = 0
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[tuple[int, ...], int] = {}
        self.sigs: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.ats: list[np.ndarray] = []
        self.held = 0

    def add(self, node: tuple[int, ...], hashes: np.ndarray, codes: np.ndarray) -> None:
        if node in self.nodes or not len(hashes):  # a copy in the same task
            return
        number = self.nodes[node] = len(self.nodes)
        self.sigs.append(hashes)
        self.codes.append(codes)
        self.ats.append(np.full(len(hashes), number, dtype=np.uint32))
        self.held += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        sig, at, code = np.concatenate(self.sigs), np.concatenate(self.ats), np.concatenate(self.codes)
        nodes = np.array(list(self.nodes), dtype=np.int64).reshape(-1, self.width)
        self.clear()
        order = np.argsort(sig, kind="stable")
        sig, at, code = sig[order], at[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        hot = np.repeat(count >= LOCALLY_HOT, count)
        salt = self.flushes % SALTS
        self.flushes += 1
        marks = sig[first[count >= LOCALLY_HOT]]
        cold = ~hot
        if hot.any():
            bucket = (sig[cold] % U64(self.n_buckets)).astype(np.int32)
            yield from self._blocks(False, bucket, sig[cold], at[cold], code[cold], nodes, marks)
            moved = (mix(sig[hot] + U64(salt)) % U64(self.n_buckets)).astype(np.int32)
            yield from self._blocks(True, moved, sig[hot], at[hot], code[hot], nodes, marks[:0])
        else:
            yield from self._blocks(False, (sig % U64(self.n_buckets)).astype(np.int32), sig, at, code, nodes, marks)

    def _blocks(self, hot: bool, bucket, sig, at, code, nodes, marks) -> Iterator[pa.RecordBatch]:
        short = sig >> U64(64 - SIG_BITS)  # the bucket keeps further bits
        order = np.lexsort((short, bucket))
        bucket, short, at, code = bucket[order], short[order], at[order], code[order]
        home = (marks % U64(self.n_buckets)).astype(np.int32)
        marks = (marks >> U64(64 - SIG_BITS)).astype("<u8")
        for number in np.union1d(bucket, home).tolist():
            a, b = np.searchsorted(bucket, number, "left"), np.searchsorted(bucket, number, "right")
            used, local = np.unique(at[a:b], return_inverse=True)
            narrow = len(used) < 1 << 16
            if len(used) * 8 * self.width + (b - a) * (2 if narrow else 4) < (b - a) * 8 * self.width:
                table, numbers = nodes[used], (b"2" if narrow else b"4") + local.astype("<u2" if narrow else "<u4").tobytes()
            else:
                table, numbers = nodes[at[a:b]], b"0"
            gaps = np.diff(short[a:b], prepend=U64(0))
            wide = len(gaps) > 0 and int(gaps.max()) >= 1 << 32
            values = [
                table.astype("<i8").tobytes(),
                numbers,
                code[a:b].astype("<u2").tobytes(),
                (b"8" if wide else b"4") + gaps.astype("<u8" if wide else "<u4").tobytes(),
                marks[home == number].tobytes(),
            ]
            arrays = [pa.array([number], pa.int32()), pa.array([hot]), *(pa.array([v], pa.binary()) for v in values)]
            yield pa.RecordBatch.from_arrays(arrays, BLOCK_NAMES)


class _Bucket:
    """The entries of one bucket from all tasks."""

    def __init__(self, number: int, hot: bool, width: int):
        self.number, self.hot, self.width = number, hot, width
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.marks: list[np.ndarray] = []

    def add(self, node: bytes, at: bytes, code: bytes, sig: bytes, marks: bytes) -> None:
        table = np.frombuffer(node, "<i8").reshape(-1, self.width)
        if at[:1] != b"0":
            table = table[np.frombuffer(at[1:], "<u2" if at[:1] == b"2" else "<u4")]
        gaps = np.frombuffer(sig[1:], "<u8" if sig[:1] == b"8" else "<u4").astype(U64)
        self.parts.append((table, np.frombuffer(code, "<u2"), np.cumsum(gaps, dtype=U64)))
        self.marks.append(np.frombuffer(marks, "<u8"))

    def gathered(self) -> tuple[np.ndarray, ...]:
        """Signature, set and code of each entry by (signature, set), copies from several tasks dropped; first entry and
        number of entries of each signature, and whether it is known to be frequent elsewhere."""
        columns = [list(x) for x in zip(*self.parts, strict=True)]
        self.parts = []
        node, code, sig = (np.concatenate(columns.pop(0)) for _ in range(3))
        order = np.lexsort((node[:, 0], sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:, 0] != node[:-1, 0])
        sig, node, code = sig[fresh], node[fresh], code[order[fresh]]
        del order, fresh
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(sig)))
        also_hot = np.isin(sig[first], np.concatenate(self.marks)) | self.hot
        return sig, node, code, first, count, also_hot

    def found(self) -> Iterator[pa.RecordBatch]:
        """Tallies of what sets look up, members of frequent signatures, and pairs from the others."""
        sig, node, code, first, count, also_hot = self.gathered()
        if not len(sig):
            return
        node = node[:, 0]
        size = np.where(also_hot, np.maximum(count, LOCALLY_HOT), count)
        mine = np.flatnonzero(np.repeat((count > 1) | also_hot, count) & ((code & OWN) > 0))
        if len(mine):
            of = np.searchsorted(first, mine, "right") - 1
            some = code[mine]
            # tells signatures apart across buckets; segments of sets that have deletions go by number
            whole = (sig[mine].astype(np.int64) << 16) | (self.number & 0xFFFF)
            segment = ((some >> SEGMENT) & 63).astype(np.int64)
            yield _rows(
                TALLY,
                len(mine),
                sig=np.where((some & (MULTI | DELETION)) > 0, segment, whole),
                x=node[mine],
                count=size[of],
                deletion=(some & DELETION) > 0,
                multi=(some & MULTI) > 0,
            )
            del of, some, whole, segment
        del mine
        hot = np.flatnonzero(np.repeat(also_hot | (count > COLD), count))
        if len(hot):
            of = np.searchsorted(first, hot, "right") - 1
            yield _rows(HOT, len(hot), sig=sig[hot].view(np.int64), x=node[hot], count=size[of], own=(code[hot] & OWN) > 0)
            del of
        del hot, sig
        yield from self.pairs(node, code, first[~also_hot], count[~also_hot])

    def pairs(self, node, code, first, count) -> Iterator[pa.RecordBatch]:
        own, deletion, size = (code & OWN) > 0, (code & DELETION) > 0, (code >> CLASS).astype(np.int64)
        xs, ys, counts = [], [], []
        for c in range(2, COLD + 1):
            at = first[count == c]
            for i in range(c - 1):
                for j in range(i + 1, c) if len(at) else ():
                    a, b = at + i, at + j
                    larger = ((size[a] - size[b] + 64) & 127) - 64
                    possible = (abs(larger) <= APART) & ~(deletion[a] & deletion[b])
                    for p, q, may in ((a, b, larger >= 0), (b, a, larger <= 0)):
                        good = possible & may & own[p]
                        xs.append(node[p[good]])
                        ys.append(node[q[good]])
                        counts.append(np.full(int(good.sum()), c, dtype=np.int64))
        if not xs:
            return
        x, y, c = np.concatenate(xs), np.concatenate(ys), np.concatenate(counts)
        by = np.lexsort((c, y, x))
        x, y, c = x[by], y[by], c[by]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        yield _rows(PAIR, int(new.sum()), x=x[new], y=y[new], count=c[new])

    def across(self, n_parts: int) -> Iterator[pa.RecordBatch]:
        """How many entries of each set are signatures that a second component holds (or may hold elsewhere), as one
        row for each part of the sets."""
        _, node, _, first, count, also_hot = self.gathered()
        if not len(node):
            return
        several = np.minimum.reduceat(node[:, 1], first) != np.maximum.reduceat(node[:, 1], first)
        who, times = np.unique(node[np.repeat(several | also_hot, count), 0], return_counts=True)
        part = (mix(who.view(U64)) % U64(n_parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.diff(part[by], prepend=-1))
        held = [by[a:b] for a, b in zip(edge, [*edge[1:], len(by)], strict=True)]
        packed = [[x[h].astype("<i8").tobytes() for h in held] for x in (who, times)]
        arrays = [pa.array(part[by[edge]], pa.int32()), *(pa.array(x, pa.binary()) for x in packed)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "x", "times"])


@lean
def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, wide) summed over the buckets, from rows sorted by part."""
    part, held = None, []

    def told() -> pa.RecordBatch:
        who, times = (np.concatenate(x) for x in zip(*held, strict=True))
        sets, number = np.unique(who, return_inverse=True)
        total = np.bincount(number, weights=times).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sets), pa.array(total)], ["x", "wide"])

    for batch in batches:
        rows = zip(*(column(batch, c).to_pylist() for c in ("part", "x", "times")), strict=True)
        for number, who, times in rows:
            if number != part and held:
                yield told()
                held = []
            part = number
            held.append((np.frombuffer(who, "<i8"), np.frombuffer(times, "<i8")))
    if held:
        yield told()


def _over_buckets(width: int, each: Callable[[_Bucket], Iterator[pa.RecordBatch]]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            columns = [column(batch, c) for c in BLOCK_NAMES]
            for r in range(batch.num_rows):
                number, hot, *data = (c[r].as_py() for c in columns)
                if bucket is None or (bucket.number, bucket.hot) != (number, hot):
                    if bucket is not None:
                        yield from each(bucket)
                    bucket = _Bucket(number, hot, width)
                bucket.add(*data)
        if bucket is not None:
            yield from each(bucket)

    return run


FOUND = "kind int, sig long, x long, y long, count int, own boolean, deletion boolean, multi boolean"
PAIR, TALLY, HOT = 0, 1, 2


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {"sig": pa.int64(), "x": pa.int64(), "y": pa.int64(), "count": pa.int32()}
    types |= {"own": pa.bool_(), "deletion": pa.bool_(), "multi": pa.bool_()}
    arrays = [pa.array(np.full(n, kind, np.int32))]
    for name, kind_of in types.items():
        got = columns.get(name)
        arrays.append(pa.nulls(n, kind_of) if got is None else pa.array(got).cast(kind_of))
    return pa.RecordBatch.from_arrays(arrays, ["kind", *types])


def _sign(n_buckets: int, signer: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(n_buckets)
        for batch in bounded(batches):
            for shingles in shingle_sets(column(batch, "text")):
                if len(shingles):
                    blocks.add(set_key(shingles)[:1], *signer(shingles))
                if blocks.held >= FLUSH:
                    yield from blocks.flush()
        yield from blocks.flush()

    return run


def tokens_of(low: int, high: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Signs sets of `low` to `high` shingles by every shingle; those with too few segments look theirs up."""

    def sign(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not low <= len(shingles) <= high:
            return np.empty(0, U64), np.empty(0, np.uint16)
        return each_shingle(shingles, is_poor(len(shingles), units(shingles)))

    return sign


def is_poor(n: int, most: int) -> bool:
    return n > LEAST_INDEXED and most <= most_different(n)


def _opened(opener: zstandard.ZstdDecompressor, packed: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of compressed texts."""
    return shingle_sets(pa.array([opener.decompress(z) for z in packed], pa.binary()).cast(pa.string()))


def _sign_members(n_buckets: int):
    """Every shingle of the sets x in component `of`."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, opener = _Blocks(n_buckets, 2), zstandard.ZstdDecompressor()
        for batch in bounded(batches, "z", 1 << 18):
            nodes = zip(column(batch, "x").to_pylist(), column(batch, "of").to_pylist(), strict=True)
            for node, shingles in zip(nodes, _opened(opener, column(batch, "z").to_pylist()), strict=True):
                blocks.add(node, *each_shingle(shingles, False))
                if blocks.held >= FLUSH:
                    yield from blocks.flush()
        yield from blocks.flush()

    return run


@lean
def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in bounded(batches):
        raw, off = as_bytes(column(batch, "text"))
        data = [packer.compress(raw[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        arrays = [column(batch, "doc"), column(batch, "tag"), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "tag", "z"])


REMEMBERED = 32


class _Remembered:
    """Shingle sets of compressed texts; the last ones are kept, as pairs with a leader come in a row."""

    def __init__(self) -> None:
        self.opener = zstandard.ZstdDecompressor()
        self.known: OrderedDict[bytes, np.ndarray] = OrderedDict()

    def pairs(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sides = [column(batch, c).to_pylist() for c in ("za", "zb")]
        for at in range(0, batch.num_rows, 100):
            pairs = list(zip(*(side[at : at + 100] for side in sides), strict=True))
            fresh = [z for z in dict.fromkeys(z for pair in pairs for z in pair) if z not in self.known]
            sets = dict(self.known) | dict(zip(fresh, _opened(self.opener, fresh), strict=True))
            for za, zb in pairs:
                yield sets[za], sets[zb]
            for z in (z for pair in pairs[-REMEMBERED:] for z in pair):
                self.known[z] = sets[z]
                self.known.move_to_end(z)
            while len(self.known) > REMEMBERED:
                self.known.popitem(last=False)


def _held(some: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of `some` are in the sorted set `by`."""
    place = np.searchsorted(by, some)
    place[place == len(by)] = 0
    return by[place] == some


@lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs."""
    remembered = _Remembered()
    for batch in batches:
        good = [
            4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and linked(len(a), len(b), int(_held(a, b).sum()))
            for a, b in remembered.pairs(batch)
        ]
        yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set beside its leader; `lacks` is a bitmap over the leader's shingles."""
    remembered = _Remembered()
    names = ["x", "y", "n", "ny", "wide", "a", "b"]
    for batch in batches:
        told: list[tuple] = []
        for own, lead in remembered.pairs(batch):
            lacks = ~_held(lead, own)
            shared = int((~lacks).sum())
            bits = np.packbits(np.pad(lacks, (0, -len(lacks) % 64))).view(np.int64)
            told.append((linked(len(own), len(lead), shared), len(lead) - shared, len(own) - shared, bits))
        columns = [[t[i] for t in told] for i in range(4)]
        arrays = [column(batch, c) for c in names]
        arrays += [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "linked", "less", "more", "lacks"])


class JaccardJoin:
    """The join over one table of documents; intermediate tables are in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.keyed = with_row_key(docs)
        self.sets = stored(self.keyed.mapInArrow(_sets_of, "doc long, tag long, n long, k1 long, k2 long, units long"))
        full = self.sets.where(F.col("n") > 0)
        one = full.groupBy("k1", "k2").agg(F.min(F.struct("doc", "tag")).alias("rep"), F.first("n").alias("n"), F.first("units").alias("units"))
        id_ = F.struct(F.col("rep.doc").alias("rep"), F.col("rep.tag").alias("rep_tag")).alias("id")
        self.classes = stored(one.select("k1", "k2", id_, "n", "units"))
        spark = docs.sparkSession
        shingles = self.classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.n_buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(shingles) // PER_BUCKET))

    def dealt(self, blocks: DataFrame) -> DataFrame:
        return blocks.repartition(self.n_buckets, "bucket", "hot").sortWithinPartitions("bucket", "hot")

    def found(self, signer) -> DataFrame:
        """What the buckets found: candidate pairs, tallies of signature frequencies and frequent signatures."""
        blocks = self.keyed.select("text").mapInArrow(_sign(self.n_buckets, signer), BLOCK)
        return stored(self.dealt(blocks).mapInArrow(_over_buckets(1, _Bucket.found), FOUND))

    def limits(self, found: DataFrame, most: str) -> DataFrame:
        """(x, top): the frequency up to which a set looks signatures up; sets that are done with what nobody else
        holds are not in it. `most` is the column with what the values of all segments add up to."""
        tally = found.where(F.col("kind") == TALLY).groupBy("x", "sig")
        tally = tally.agg(
            F.max(F.when(~F.col("deletion"), F.col("count"))).alias("one"),
            F.max(F.when(F.col("deletion"), F.col("count"))).alias("two"),
            F.max("multi").alias("multi"),
        )
        costs = F.array("one", F.when(F.col("multi"), F.greatest("one", "two")))
        costs = tally.select("x", F.filter(costs, lambda c: c.isNotNull()).alias("c")).groupBy("x")
        costs = costs.agg(F.sort_array(F.flatten(F.collect_list("c"))).alias("costs"))  # two for a segment at most
        sizes = self.classes.groupBy(F.col("k1").alias("x")).agg(F.max("n").alias("n"), F.min(most).alias("most"))
        need = F.floor(2 * F.col("n") / 7) + 1 - (F.col("most") - F.size("costs"))
        costs = costs.join(sizes, "x").withColumn("need", need.cast("int")).where(F.col("need") > 0)
        return costs.select("x", F.element_at("costs", F.least("need", F.size("costs"))).alias("top"))

    def looked_up(self, found: DataFrame, most: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs (x, y) from signatures of few sets, lookups (sig, x) of frequent ones, and members (sig, x) of all
        frequent ones."""
        limits = stored(self.limits(found, most))
        cold = found.where(F.col("kind") == PAIR).join(limits, "x").where(F.col("count") <= F.col("top")).select("x", "y")
        hot = found.where(F.col("kind") == HOT).select("sig", "x", "count", "own")
        asks = stored(hot.where("own").join(limits, "x").where(F.col("count") <= F.col("top")).select("sig", "x"))
        return cold, asks, hot.select("sig", "x")

    def passes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same over segments and, where sets have too few of them, over single shingles."""
        parts = [self.looked_up(self.found(signatures), "units")]
        poor = self.classes.where((F.col("n") > LEAST_INDEXED) & (F.col("units") <= F.floor(2 * F.col("n") / 7)))
        sizes = poor.agg(F.min("n"), F.max("n")).first()
        if sizes[0] is not None:
            parts.append(self.looked_up(self.found(tokens_of(3 * sizes[0] // 4, -(-4 * sizes[1] // 3))), "n"))
        return tuple(a if len(parts) == 1 else a.unionAll(parts[1][i]) for i, a in enumerate(parts[0]))

    @staticmethod
    def collapsed(asks: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of frequent signatures that are looked up and have equal members one stays. Returns its members (sig, x), and
        each set that looks any of them up with two leaders of it (x, lo, hi)."""
        told = [F.sum(F.shiftright(F.xxhash64(F.lit(k), "x"), 31)).alias(f"d{k}") for k in (1, 2)]
        digests = hot.groupBy("sig").agg(F.count("*").alias("c"), *told, F.min("x").alias("lo"), F.max("x").alias("hi"))
        wanted = digests.join(asks.select("sig").distinct(), "sig")
        same = Window.partitionBy("c", "d1", "d2", "lo", "hi")
        named = stored(wanted.select("sig", "lo", "hi", F.min("sig").over(same).alias("rep")))
        members = stored(hot.join(named.where(F.col("sig") == F.col("rep")), "sig", "left_semi"))
        return members, stored(asks.join(named, "sig").select("x", "lo", "hi").distinct())

    def zipped(self) -> DataFrame:
        """Compressed texts by id."""
        texts = self.keyed.mapInArrow(_zip_texts, "doc long, tag long, z binary")
        return texts.select(F.struct(F.col("doc").alias("rep"), F.col("tag").alias("rep_tag")).alias("id"), "z")

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Links (a, b) among `pairs` (x, y)."""
        x = texts.select("x", F.col("id").alias("a"), F.col("z").alias("za"))
        y = texts.select(F.col("x").alias("y"), F.col("id").alias("b"), F.col("z").alias("zb"))
        both = pairs.join(x, "x").join(y, "y").select("a", "b", "za", "zb")
        schema = T.StructType(both.schema.fields[:2])
        return stored(both.mapInArrow(_verify, schema))

    def labels(self) -> DataFrame:
        """(node, component) of the representatives that have links."""
        cold, asks, hot = self.passes()
        cold = stored(cold)
        members, led = self.collapsed(asks, hot)
        starred = [led.select("x", F.col(c).alias("y")).where(F.col("x") != F.col("y")) for c in ("lo", "hi")]
        pairs = cold.unionAll(starred[0]).unionAll(starred[1])
        pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        involved = pairs.select("x").unionAll(pairs.select("y")).unionAll(members.select("x")).distinct()
        named = self.classes.select(F.col("k1").alias("x"), "id", "n").join(involved, "x")
        texts = stored(named.join(self.zipped(), "id").select("x", "id", "n", "z"))
        links = self.verified(pairs, texts)
        placed = self.apart(connected_components(links), texts, members)
        if placed.isEmpty():
            return connected_components(links)
        beside = self.beside_leaders(placed, texts)
        links = links.unionAll(beside.where("linked").select("a", "b"))
        left = self.across(connected_components(links), beside)
        return connected_components(links if left.isEmpty() else links.unionAll(self.verified(left, texts)))

    def apart(self, labels: DataFrame, texts: DataFrame, members: DataFrame) -> DataFrame:
        """(sig, x, n, of, wide): members of frequent signatures. `wide` counts the shingles that sets of other components
        hold too; with less than 3/4 of its own a set has no partner there and is left out."""
        known = texts.select("x", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left")
        known = known.select("x", "n", F.xxhash64(F.coalesce("component", "id")).alias("of"))
        placed = stored(members.join(known, "x"))
        several = placed.select("x", "of").distinct()
        blocks = texts.join(several, "x").select("x", "of", "z").mapInArrow(_sign_members(self.n_buckets), BLOCK)
        n = self.n_buckets
        counted = self.dealt(blocks).mapInArrow(_over_buckets(2, lambda b: b.across(n)), "part int, x binary, times binary")
        wide = counted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_sum_parts, "x long, wide long")
        return stored(placed.join(wide, "x").where(4 * F.col("wide") >= 3 * F.col("n")))

    def beside_leaders(self, placed: DataFrame, texts: DataFrame) -> DataFrame:
        """Sets beside the leader of each of their signatures that spans several components, the member with the largest share of its shingles
        known elsewhere: whether they are linked, how many shingles of the leader x lacks and which, and how many more x has."""
        best = F.max_by("x", F.struct(F.col("wide") / F.col("n"), "x")).alias("y")
        ends = placed.groupBy("sig").agg(best, F.min("of").alias("lo"), F.max("of").alias("hi"))
        led = placed.join(ends.where("lo != hi").select("sig", "y"), "sig").select("x", "y", "n", "of", "wide").distinct()
        x = texts.select("x", F.col("id").alias("a"), F.col("z").alias("za"))
        y = texts.select(F.col("x").alias("y"), F.col("id").alias("b"), F.col("n").alias("ny"), F.col("z").alias("zb"))
        both = led.join(x, "x").join(y, "y").select("x", "y", "n", "ny", "wide", "a", "b", "za", "zb")
        more = [("linked", T.BooleanType()), ("less", T.LongType()), ("more", T.LongType()), ("lacks", T.ArrayType(T.LongType()))]
        schema = T.StructType([*both.schema.fields[:-2], *(T.StructField(n, t) for n, t in more)])
        return stored(both.mapInArrow(_compare, schema))

    def across(self, labels: DataFrame, beside: DataFrame) -> DataFrame:
        """Pairs of sets beside one leader that are in different components and may be linked. What differs from the
        leader in both or neither is common to both; two sets that differ from it in nothing common are linked only
        if both are linked with it, so one of each pair is not in its component."""
        node = labels.withColumnRenamed("component", "c")
        of = beside.join(node.withColumnRenamed("node", "a"), "a", "left").withColumn("of", F.xxhash64(F.coalesce("c", "a"))).drop("c")
        of = of.join(node.withColumnRenamed("node", "b"), "b", "left").withColumn("lead_of", F.xxhash64(F.coalesce("c", "b")))
        # shingles beside the leader's that sets of other components may hold; outside its component x holds no
        # shingle alone that the leader has
        loose = F.when(F.col("of") == F.col("lead_of"), F.least("more", "wide")).otherwise(
            F.greatest(F.lit(0), F.col("more") - (F.col("n") - F.col("wide")))
        )
        rows = stored(of.select("x", "y", "n", "ny", "of", "lead_of", "wide", "less", "lacks", loose.alias("loose")))
        others = rows.select("y", *[F.col(c).alias("o_" + c) for c in ("x", "n", "of", "wide", "less", "lacks", "loose")])
        outside = rows.where(F.col("of") != F.col("lead_of"))
        n, m = F.col("n"), F.col("o_n")
        neither = F.aggregate(
            F.zip_with("lacks", "o_lacks", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, c: s + c
        )
        common = F.col("ny") - F.col("less") - F.col("o_less") + neither + F.least("loose", "o_loose")
        may = (F.col("of") != F.col("o_of")) & (4 * F.least(n, m) >= 3 * F.greatest(n, m))
        may = may & (7 * F.least("wide", "o_wide") >= 3 * (n + m)) & (7 * common >= 3 * (n + m))
        pairs = outside.join(others, "y").where(may)
        return stored(pairs.select(F.least("x", "o_x").alias("x"), F.greatest("x", "o_x").alias("y")).distinct())

    def components(self) -> DataFrame:
        """(doc, tag, n, component, keeper) of all rows: component is the least doc reachable, and keeper tells the one
        text of each component, or a row without shingles."""
        classes = self.classes.join(self.labels().withColumnRenamed("node", "id"), "id", "left")
        classes = classes.select("k1", "k2", F.coalesce("component", "id").alias("least"))
        out = self.sets.join(classes, ["k1", "k2"], "left")
        some = F.col("n") > 0
        return out.select(
            "doc",
            "tag",
            "n",
            F.when(some, F.col("least.rep")).otherwise(F.col("doc")).alias("component"),
            (~some | ((F.col("doc") == F.col("least.rep")) & (F.col("tag") == F.col("least.rep_tag")))).alias("keeper"),
        )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows."""

    def real(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    found = JaccardJoin(docs).components()
    return found.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of `docs` of which one stays for each component (the least doc_id's; of rows that repeat doc_id and text,
    one). Rows without shingles all stay."""
    mark = "__near"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    doc, tag, n, nth = (f"{mark}_{c}" for c in ("doc", "tag", "n", "nth"))
    marks = JaccardJoin(docs).components().where("keeper").groupBy(F.col("doc").alias(doc), F.col("tag").alias(tag)).agg(F.max("n").alias(n))
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(doc), F.xxhash64("text").alias(tag))
    order = F.row_number().over(Window.partitionBy(doc, tag).orderBy(F.xxhash64(*docs.columns)))
    joined = keyed.join(marks, [doc, tag]).withColumn(nth, order)
    return joined.where((F.col(nth) == 1) | (F.col(n) == 0)).select(*docs.columns)
