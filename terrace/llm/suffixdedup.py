"""Removal of repeated passages by bucket-pointer refinement over sparse suffixes.

Every window of LENGTH bytes is represented by one suffix: of the Q-grams
that start in it, the one that hashes lowest. Equal windows have equal
representatives, so windows whose representatives' Q-grams differ can't be
equal. Windows in a row with one representative form a block.

1. Initial buckets: the Q-grams of representatives. A bucket that lies in
   one document is done; only the blocks of the others go on, as bytes.
2. Inside a bucket, equal blocks are settled whole: only one of the smallest
   document goes on.
3. Where different blocks are left, all their suffixes are sorted into
   buckets by their first FIRST bytes, and buckets that hold several
   documents are refined by the bucket pointers of the suffixes at later
   offsets. Each level's pointers serve the next, until they cover LENGTH
   bytes. Windows of one bucket are then equal, and those of other documents
   than the smallest are removed.

Hashes only choose which blocks meet; whatever is removed has been compared
byte by byte. A Q-gram that many blocks share is dealt out by the bytes of
each window instead, so no task gets all its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

LENGTH, Q = 50, 20
WINDOW = LENGTH - Q + 1
#: Bytes of the first sort's keys, and how many bytes each level of refinement covers.
FIRST, LEVELS = 8, (16, 32, LENGTH)
#: Bytes hashed at once; representatives and blocks that a task holds before it sends them on; bytes refined at once.
CHUNK, FLUSH, HELD, REFINED = 1 << 18, 1_000_000, 300_000, 1 << 19
#: Bytes of text whose blocks make up one group in memory.
GROUP = 8 << 20
#: Blocks with one Q-gram, held by a task at once or in all, from which its windows are dealt one by one.
HOT, HOT_EVERYWHERE = 16, 1024
#: Bits of a Q-gram's hash that count.
BITS = 48
_U = np.uint64
_LOWEST = -(1 << 63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Hashes:
    """Hashes of all Q-grams of one chunk of bytes."""

    R = 0x5851F42D4C957F2D
    _up = _down = _byte = None

    def __init__(self, data: np.ndarray):
        cls = type(self)
        if cls._up is None or len(cls._up) <= len(data):
            n = max(len(data) + 1, CHUNK + 4 * LENGTH)
            cls._up, cls._down = _powers(self.R, n), _powers(pow(self.R, -1, 1 << 64), n)
            cls._byte = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, _U)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, _U)
            np.cumsum(self._byte[data] * self._up[: len(data)], out=self.sums[1:])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - Q
        if n <= 0:
            return np.zeros(0, _U)
        with np.errstate(over="ignore"):
            return _mix((self.sums[Q:] - self.sums[:n]) * self._down[:n])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(32))
        x *= _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(29))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, the first row included."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


#: Bits that tell places in a chunk apart.
_AT = 19


@lru_cache(2)
def _rank(n: int) -> np.ndarray:
    """How seldom powers of two divide each place below ``n``, shifted past the places."""
    if n >> _AT:
        raise ValueError(f"chunks have fewer than 2**{_AT} bytes")
    at = np.arange(n, dtype=np.int64)
    power = np.where(at == 0, 1 << _AT, at & -at)
    return (_AT - np.log2(power).astype(np.int64)).astype(_U) << _U(_AT)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _chunks(lengths: np.ndarray, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splits documents, end to end, into chunks: first byte, and of each part the document and its bytes.

    Parts of a long document overlap by LENGTH - 1 bytes, so each window is in
    one of them; where it is split depends on that document alone.
    """
    ends = np.cumsum(lengths)
    docs, sizes, begin, total = [], [], 0, 0
    for d, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
        start = end - n
        if total and total + n > chunk:
            yield begin, np.array(docs), np.array(sizes)
            docs, sizes, total = [], [], 0
        while n > chunk:
            yield start, np.array([d]), np.array([chunk])
            start, n = start + chunk - LENGTH + 1, n - chunk + LENGTH - 1
        if not total:
            begin = start
        docs.append(d)
        sizes.append(n)
        total += n
    if total:
        yield begin, np.array(docs), np.array(sizes)


def find_blocks(data: np.ndarray, lengths: np.ndarray, chunk: int = CHUNK, bits: int = BITS) -> list[np.ndarray]:
    """Of all documents, end to end: key of the representative's Q-gram, document, first window, windows.

    Keys are ``bits`` bits of a second hash: the representatives' own hashes
    are all low, being the lowest of their windows. Where a window's lowest
    Q-gram occurs in it several times, the place that the highest power of two
    divides stands for it, so runs of one byte make few blocks too.
    """
    first = np.cumsum(lengths) - lengths
    rank = _rank(chunk)
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    for begin, docs, sizes in _chunks(lengths, chunk):
        part = data[begin : begin + int(sizes.sum())]
        if len(part) < LENGTH:
            continue
        grams = _Hashes(part).grams()
        lowest = _sliding_min(grams, WINDOW)
        place = np.arange(len(part))
        inside = place - np.repeat(np.cumsum(sizes) - sizes, sizes)  # the document's, wherever it lies
        ties = rank[inside[: len(grams)]] | place[: len(grams)].astype(_U)
        at = (_sliding_min((grams >> _U(24) << _U(24)) | ties, WINDOW) & _U((1 << _AT) - 1)).astype(np.int64)
        n = len(at)
        windows = np.flatnonzero(inside[:n] + LENGTH <= np.repeat(sizes, sizes)[:n])
        if not len(windows):
            continue
        at, lowest = at[windows], lowest[windows]
        new = _runs(at, lowest, windows - np.arange(len(windows)))
        lo = windows[new]
        count = np.diff(np.append(new, len(windows)))
        owner = docs[np.repeat(np.arange(len(sizes)), sizes)[lo]]
        with np.errstate(over="ignore"):
            key = _mix(lowest[new] * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits) << _U(64 - bits)
        for k, x in enumerate((key, owner, begin + lo - first[owner], count)):
            out[k].append(x)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, (_U, np.int64, np.int64, np.int64))]


# What tasks send: packed rows by group. Groups from ``groups`` on hold ranges of documents.
_SENT = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
_SENT_DDL = "bucket int, n long, blob binary"
_WHOLE = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("ranges", pa.list_(pa.int64()))])
_WHOLE_DDL = "id long, mark long, ranges array<long>"
_ANNOUNCED = [_U, np.int64, np.int64, np.int64, np.uint8]
_RANGES = [np.int64, np.int64, np.int64]


def _pack(columns: list[np.ndarray], rest: bytes = b"") -> bytes:
    """Bytes of like weight side by side, then ``rest``, compressed."""
    raw = b"".join([*(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), rest])
    return zstandard.ZstdCompressor(level=3 if rest else 1).compress(raw)


def _unpack(blob: bytes, n: int, kinds: list, rest: bool = False) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind))
        at += size
    return [*out, np.frombuffer(raw, np.uint8, -1, at)] if rest else out


def _share(key: np.ndarray, groups: int) -> np.ndarray:
    """The group of each 64-bit key, of which the upper half counts."""
    return ((key >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)


class _Sender:
    """Gathers packed rows into batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, bucket: int, n: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        self.rows.append((bucket, n, blob))
        self.size += len(blob)
        if self.size > 4 << 20:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield arrow.batch(_SENT, *map(list, zip(*self.rows)))
            self.rows, self.size = [], 0


def _deal(group: np.ndarray, columns: list[np.ndarray], base: int = 0, pieces: bytes | None = None, start: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by group, packed for each; with ``pieces``, the bytes of each from its start too (count is the last column)."""
    sender = _Sender()
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist() if len(group) else []
    for lo, hi in zip(edges, edges[1:]):
        rest = b"" if pieces is None else _cut_out(pieces, start[lo:hi], columns[-1][lo:hi].astype(np.int64) + (LENGTH - 1))
        yield from sender.add(base + int(group[lo]), hi - lo, _pack([c[lo:hi] for c in columns], rest))
    yield from sender.end()


def _cut_out(data: bytes, start: np.ndarray, size: np.ndarray) -> bytes:
    return b"".join([data[a:z] for a, z in zip(start.tolist(), (start + size).tolist())])


def _code(lo: np.ndarray, count: np.ndarray, hot: np.ndarray | int = 0) -> np.ndarray:
    return lo.astype(np.int64) * 128 + count.astype(np.int64) * 2 + hot


def _ranges(ids: np.ndarray, marks: np.ndarray, codes: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Ranges by groups of documents, so that their rows are few however many buckets they come from."""
    with np.errstate(over="ignore"):
        group = _share(_mix(_mix(ids.astype(np.int64).view(_U)) + marks.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)), groups)
    order = np.lexsort((codes, ids, group))
    yield from _deal(group[order], [x[order] for x in (ids, marks, codes)], groups)


def _whole(table: pa.Table) -> pa.Table:
    """One group's ranges by document."""
    parts = [_unpack(blob.as_py(), n, _RANGES) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
    ids, marks, codes = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((codes, marks, ids))
    ids, marks, codes = ids[order], marks[order], codes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    at = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(codes, pa.int64()))
    return pa.Table.from_batches([arrow.batch(_WHOLE, ids[at], marks[at], lists)])


def _announce(groups: int, chunk: int, bits: int):
    """Announces each block's Q-gram by its group. Frequent Q-grams leave a task once or twice; their blocks are asked for at once."""

    def send(key: np.ndarray, ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, key))
        key, ids, marks, lo, count = (c[order] for c in (key, ids, marks, lo, count))
        start = _runs(key)
        n = np.diff(np.append(start, len(key)))
        often = n >= HOT
        hot = np.repeat(often, n)
        yield from _ranges(ids[hot], marks[hot], _code(lo[hot], count[hot], 1), groups)
        # in their place rows of the smallest and the largest id, with a count of 0
        first, last = start[often], (start + n - 1)[often]
        rows = np.concatenate([np.flatnonzero(~hot), first, last])
        count = np.append(count[~hot], np.zeros(2 * len(first), np.int64)).astype(np.uint8)
        order = np.argsort(key[rows], kind="stable")
        rows, count = rows[order], count[order]
        yield from _deal(_share(key[rows], groups), [key[rows], ids[rows], marks[rows], lo[rows], count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = arrow.utf8(b.column(2))
            key, owner, lo, count = find_blocks(data, np.diff(offsets), chunk, bits)
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            held.append([key, ids[owner], marks[owner], lo, count])
            size += len(key)
            if size >= FLUSH:
                columns = [np.concatenate(c) for c in zip(*held)]
                held, size = [], 0
                yield from send(*columns)
        if size:
            yield from send(*[np.concatenate(c) for c in zip(*held)])

    return run


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), _SENT)


def _shared(groups: int):
    """Of a group of Q-grams, asks for the blocks of those that several documents hold."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:
            return table
        parts = [_unpack(blob.as_py(), n, _ANNOUNCED) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
        grams, ids, marks, lo, count = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(grams, kind="stable")
        grams, ids, marks, lo, count = (c[order] for c in (grams, ids, marks, lo, count))
        start = _runs(grams)
        several = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start)
        n = np.diff(np.append(start, len(grams)))
        hot = (np.minimum.reduceat(count, start) == 0) | (n >= HOT_EVERYWHERE)  # alike for all tasks
        asked = np.repeat(several, n) & (count > 0)
        return _table(_ranges(ids[asked], marks[asked], _code(lo, count, np.repeat(hot, n))[asked], groups))

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def _places(start: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of words that cover pieces of LENGTH to LENGTH + WINDOW - 1 bytes."""
    for k in range(0, LENGTH - 7, 8):
        yield start + k
    for k in range(8, LENGTH + WINDOW - LENGTH // 8 * 8, 8):
        yield start + size - k


def _content(words: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    out = size.astype(_U)
    with np.errstate(over="ignore"):
        for at in _places(start, size):
            out = (out ^ words[at]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(31)
    return _mix(out) >> _U(64 - bits) << _U(64 - bits)


def _settle(data: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of pieces by key, content and id; and which of them, so ordered, equal a piece of a smaller id."""
    words, size = _words(data), count.astype(np.int64) + (LENGTH - 1)
    content = _content(words, start, size, min(bits, 64))
    order = np.lexsort((ids, size, content, key))
    key, content, size, start, ids = (c[order] for c in (key, content, size, start, ids))
    heads = _runs(key, content, size)
    head = np.repeat(heads, np.diff(np.append(heads, len(order))))
    settled = ids > ids[head]
    some = np.flatnonzero(settled)
    if len(some):
        same = np.ones(len(some), bool)
        for a, b in zip(_places(start[some], size[some]), _places(start[head[some]], size[some])):
            same &= words[a] == words[b]
        settled[some] = same
    return order, settled


_PIECES = [np.uint32, np.int64, np.int64, np.int64, np.uint8]


def _send_pieces(groups: int, chunk: int, bits: int):
    """Sends the blocks that are asked for, as bytes, to their Q-gram's group, those of frequent Q-grams window by window."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        raw = b"".join([h[0] for h in held])
        data = np.frombuffer(raw, np.uint8)
        key, ids, marks, lo, count, hot = (np.concatenate(c) for c in zip(*(h[1] for h in held)))
        size = count + LENGTH - 1
        start = np.cumsum(size) - size
        order, settled = _settle(data, key, start, count, ids, bits)
        cut, rest, often = order[settled], order[~settled & ~hot[order]], order[~settled & hot[order]]
        yield from _ranges(ids[cut], marks[cut], _code(lo[cut], count[cut]), groups)
        yield from deal(raw, *(c[rest] for c in (key, ids, marks, lo, count, start)))
        for a in range(0, len(often), 1 << 15):
            some = often[a : a + (1 << 15)]
            each = np.repeat(some, count[some])
            step = np.arange(len(each)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            yield from windows(raw, data, ids[each], marks[each], lo[each] + step, start[each] + step)

    def windows(raw: bytes, data: np.ndarray, ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        one = np.ones(len(ids), np.int64)
        key = _content(_words(data), start, one + (LENGTH - 1), bits)
        order, settled = _settle(data, key, start, one, ids, bits)
        cut, rest = order[settled], order[~settled]
        yield from _ranges(ids[cut], marks[cut], _code(lo[cut], one[cut]), groups)
        yield from deal(raw, *(c[rest] for c in (key, ids, marks, lo, one, start)))

    def deal(raw: bytes, key: np.ndarray, ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, count: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(key, kind="stable")
        short = (key[order] >> _U(64 - bits)).astype(np.uint32)
        yield from _deal(_share(key[order], groups), [short, ids[order], marks[order], lo[order], count[order].astype(np.uint8)], 0, raw, start[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = arrow.utf8(b.column(2))
            lists = b.column(3)
            codes = lists.flatten().to_numpy()
            asked = np.repeat(np.arange(len(lists)) << 40, np.diff(lists.offsets.to_numpy())) | (codes >> 7)
            key, owner, lo, count = find_blocks(data, np.diff(offsets), chunk, bits)
            at = np.minimum(np.searchsorted(asked, owner << 40 | lo), len(asked) - 1)
            hit = asked[at] == (owner << 40 | lo)
            key, owner, lo, count, hot = key[hit], owner[hit], lo[hit], count[hit], (codes[at[hit]] & 1).astype(bool)
            ids, marks, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), data.tobytes()
            for a in range(0, len(key), HELD):
                part = slice(a, a + HELD)
                pieces = _cut_out(raw, offsets[owner[part]] + lo[part], count[part] + LENGTH - 1)
                held.append((pieces, [key[part], ids[owner[part]], marks[owner[part]], lo[part], count[part], hot[part]]))
                size += len(held[-1][1][0])
                if size >= HELD:
                    full, held, size = held, [], 0
                    yield from send(full)
        if size:
            yield from send(held)

    return run


def refine(text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the suffixes of pieces that lie end to end.

    Returns place and piece of each window that equals a window of a piece
    with a smaller id. A suffix's bucket pointer is its bucket's first place
    in the order found so far. A bucket of one id is done and keeps its
    pointer.
    """
    piece = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))
    owner = ids[piece]
    pointer = np.full(len(text), -1)

    def number(at: np.ndarray, key: np.ndarray, base: np.ndarray | None) -> np.ndarray:
        """Sorts suffixes by key, sets their pointers, and returns those whose buckets hold several ids."""
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        heads = _runs(key)
        n = np.diff(np.append(heads, len(at)))
        if base is None:
            first = heads
        else:  # a bucket's parts number on from its own pointer
            base = base[order]
            opening = np.maximum.accumulate(np.where(np.append(True, base[1:] != base[:-1]), np.arange(len(at)), 0))
            first = (base + np.arange(len(at)) - opening)[heads]
        pointer[at] = np.repeat(first, n)
        several = np.minimum.reduceat(owner[at], heads) < np.maximum.reduceat(owner[at], heads)
        return at[np.repeat(several, n)]

    covered = FIRST
    active = np.flatnonzero(left >= covered)
    active = number(active, _words(text)[active], None)
    for level in LEVELS:
        active = active[left[active] >= level]
        if not len(active):
            return active, active
        base = pointer[active]
        # all suffixes at the later offset have pointers of ``covered`` bytes
        active = number(active, base * len(text) + pointer[active + level - covered], base)
        covered = level
    least = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(least, pointer[active], owner[active])
    repeated = np.sort(active[owner[active] > least[pointer[active]]])
    return repeated, piece[repeated]


def _refined(groups: int, bits: int):
    """Settles a group's equal pieces, and refines the suffixes of Q-grams that still hold several documents."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() >= groups:
            return table
        parts = [_unpack(blob.as_py(), n, _PIECES, True) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
        grams, ids, marks, lo, count, data = (np.concatenate(c) for c in zip(*parts))
        raw = data.tobytes()
        del parts
        count = count.astype(np.int64)
        size = count + LENGTH - 1
        start = np.cumsum(size) - size
        order, settled = _settle(data, grams, start, count, ids, bits)
        cut = order[settled]
        out = list(_ranges(ids[cut], marks[cut], _code(lo[cut], count[cut]), groups))
        order = order[~settled]
        heads = _runs(grams[order])
        n = np.diff(np.append(heads, len(order)))
        several = np.minimum.reduceat(ids[order], heads) < np.maximum.reduceat(ids[order], heads)
        order, n = order[np.repeat(several, n)], n[several]
        # whole Q-grams at a time, up to REFINED bytes
        ends = np.cumsum(n)
        weight = np.cumsum(size[order])[ends - 1] if len(n) else ends
        turn = _runs(weight // REFINED) if len(n) else np.zeros(0, np.int64)
        edges = [0, *ends[turn[1:] - 1].tolist(), len(order)] if len(n) else [0]
        found = []
        for a, b in zip(edges, edges[1:]):
            mine = order[a:b]
            own = size[mine]
            at, piece = refine(np.frombuffer(_cut_out(raw, start[mine], own), np.uint8), own, ids[mine])
            if len(at):
                first = _runs(piece, at - np.arange(len(at)))  # windows in a row
                where = mine[piece[first]]
                low = lo[where] + at[first] - (np.cumsum(own) - own)[piece[first]]
                found.append((ids[where], marks[where], _code(low, np.diff(np.append(first, len(at))))))
        if found:
            out += _ranges(*(np.concatenate(c) for c in zip(*found)), groups)
        return _table(out)

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """Removes each byte that a LENGTH-byte string covers which also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings never cross documents and are judged on
    the input. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    with ``with_kept`` also removed (array of [start, stop)) and kept (bytes).
    Null texts are empty; texts under LENGTH bytes lose nothing; null ids
    count as one id below all others; rows of one id, whatever their texts,
    do not shorten each other; only the two named columns are read; an empty
    table gives none. ``chunk`` (bytes hashed at once) and ``bits`` (of
    hashes, 8 to 64) change the work, not the result.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    raw = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_LOWEST)).alias("id")
    found = raw.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n").alias("n"), F.sum("size").alias("size")).first()
    groups = 1 + (found["size"] or 0) // GROUP  # a group of rows is held in memory
    # Rows of one id differ by their texts' hashes; where ids are unique, a constant does.
    shared_ids = (found["n"] or 0) > 1
    docs = raw.select("doc_id", key, (F.xxhash64("text") if shared_ids else F.lit(0).cast("long")).alias("mark"), "text")
    whole = lambda marks: marks.groupBy("bucket").applyInArrow(_whole, _WHOLE_DDL)

    announced = docs.select("id", "mark", "text").mapInArrow(_announce(groups, chunk, bits), _SENT_DDL)
    asked = scratch.table(announced.groupBy("bucket").applyInArrow(_shared(groups), _SENT_DDL), "asked")
    done = scratch.made[-1:]
    wanted = docs.select("id", "mark", "text").join(whole(asked), ["id", "mark"])
    if shared_ids:
        wanted = wanted.dropDuplicates(["id", "mark"])
    pieces = wanted.mapInArrow(_send_pieces(groups, chunk, bits), _SENT_DDL)
    cuts = scratch.table(pieces.groupBy("bucket").applyInArrow(_refined(groups, bits), _SENT_DDL), "cuts")
    scratch.drop(spark, done)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_kept:
        fields += [("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
        ddl += ", removed array<array<long>>, kept binary"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, codes in zip(b.column(0).to_pylist(), arrow.byte_values(b.column(1)), b.column(2)):
                spans, kept, gone = [], text, 0
                if codes.is_valid:
                    codes = np.sort(codes.values.to_numpy())
                    lo, hi = codes >> 7, (codes >> 7) + (codes >> 1 & 63) - 1 + LENGTH
                    hi = np.maximum.accumulate(hi)
                    new = np.append(True, lo[1:] > hi[:-1])
                    starts, stops = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                    spans = np.stack([starts, stops], 1).tolist()
                    gone = int((stops - starts).sum())
                    kept = b"".join(text[a:z] for a, z in zip([0, *stops.tolist()], [*starts.tolist(), len(text)]))
                rows.append((doc_id, len(text), gone, len(spans), hashlib.sha256(kept).hexdigest(), *([spans, kept] if with_kept else [])))
            if rows:
                yield arrow.batch(schema, *map(list, zip(*rows)))

    return docs.join(whole(cuts), ["id", "mark"], "left").select("doc_id", "text", "ranges").mapInArrow(cut, ddl)
