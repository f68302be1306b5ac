"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

Counting runs in Spark. First the words are counted, and numbered so that
frequent ones have small numbers; then n-grams of those numbers are counted,
one level at a time. Each level ends up as sorted hash arrays, a file for
each bucket, in the folder that all nodes share; the workers that count and
score map those files into memory.

N-grams are dealt by their contexts, so a context's totals are found in one
place. Contexts of frequent words alone are dealt by the whole n-gram, and
their totals added up in a second step.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch, words
from terrace.llm.suffixdedup import _pack, _runs, _unpack

#: Training tokens that a task holds before it sends their n-grams on.
FLUSH = 800_000
#: Bytes of text whose n-grams of one level make up one bucket in memory.
GROUP = 6 << 20
#: Bytes of text that are looked up at once.
PART = 4 << 20
#: Words that make up one in so many tokens, or half as many, are frequent: twice this number of words at most.
FREQUENT = 1000
#: Files of frequent contexts, whose number the number of frequent words bounds.
HOT_FILES = 16
_U = np.uint64
END = _U(xxhash.xxh64_intdigest(b" end"))
#: The number of what stands before a text; words are numbered from 1.
BEGIN = 0


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    with np.errstate(over="ignore"):
        x = h * _U(0x9E3779B97F4A7C15) + (w ^ (w >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(32)
        x *= _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _in_order(bucket: np.ndarray, n: int) -> np.ndarray:
    """A stable order, by radix where numbers are short."""
    return np.argsort(bucket.astype(np.uint16) if n < 1 << 16 else bucket, kind="stable")


def held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def _words(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, or of the wanted ones, each closed by the end token; and how many each has."""
    found, offsets = words.hashes(*arrow.utf8(texts))
    out = np.insert(found, offsets[1:], END)
    n = np.diff(offsets) + 1
    if wanted is None:
        return out, n
    return out[np.repeat(wanted, n)], n[wanted]


_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])
_BLOB_DDL = "bucket int, kind string, n long, blob binary"


def _rows(kind: str, group: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by group, packed for each; the first column is sorted in each, and sent as differences."""
    edges = np.append(_runs(group), len(group)).tolist() if len(group) else []
    rows, size = [], 0
    for lo, hi in zip(edges, edges[1:]):
        first = np.diff(columns[0][lo:hi], prepend=columns[0].dtype.type(0))
        rows.append((int(group[lo]), kind, hi - lo, _pack([first, *(c[lo:hi] for c in columns[1:])])))
        size += len(rows[-1][-1])
        if size > 4 << 20:
            yield arrow.batch(_BLOB, *map(list, zip(*rows)))
            rows, size = [], 0
    if rows:
        yield arrow.batch(_BLOB, *map(list, zip(*rows)))


def _read(table: pa.Table, kinds: list) -> list[np.ndarray]:
    parts = [_unpack(blob.as_py(), n, kinds) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=p[0].dtype)
    return [np.concatenate(c) for c in zip(*parts)]


def _stats(bucket: int, numbers: list[int]) -> pa.RecordBatch:
    return arrow.batch(_BLOB, [bucket], ["stats"], [0], [np.array(numbers, "<i8").tobytes()])


def _histogram(count: np.ndarray) -> list[int]:
    """How many, their sum, and how many of 1, 2, 3 and 4."""
    return [len(count), int(count.sum()), *np.bincount(np.minimum(count, 5), minlength=6)[1:5].tolist()]


def _write(path: str, arrays: list[np.ndarray]) -> None:
    """A whole file or none, even where two attempts of a task write it. The end of the file says what it holds."""
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    arrays = [a if a.dtype.kind == "u" else a.astype(f"<u{max(1, np.min_scalar_type(int(a.max(initial=0))).itemsize)}") for a in arrays]
    head, at = [], 0
    with open(own, "wb") as f:
        for a in arrays:
            head.append(f"{a.itemsize},{len(a)},{at}")
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
            at += a.nbytes + -a.nbytes % 8
        end = ";".join(head).encode()
        f.write(end + len(end).to_bytes(8, "little"))
    os.replace(own, path)


def _map(path: str) -> list[np.ndarray]:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n = int.from_bytes(raw[-8:].tobytes(), "little")
    head = [tuple(map(int, x.split(","))) for x in raw[-8 - n : -8].tobytes().decode().split(";")]
    return [raw[at : at + size * n].view(f"<u{size}") for size, n, at in head]


def _table(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of a sorted hash table: cells of the keys' first bits, 32 more bits of each key in order, and its values.

    Values go by a code of one byte for the commonest combinations; code 255
    refers to the arrays at the end. Together with the bucket, cell and rest
    tell some 50 bits of a key or more: a missing key is taken for another one
    time in 2**28.
    """
    order = np.argsort(keys)
    keys, values = keys[order], [v[order].astype(np.int64) for v in values]
    bits = max(1, len(keys).bit_length() - 4)
    cells = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U)).astype(np.uint32 if len(keys) < 1 << 32 else _U)
    rest = (keys >> _U(32 - bits)).astype(np.uint32)
    folded = np.zeros(len(keys), _U)
    for v in values:
        folded = _mix(folded, v.view(_U))
    kinds, first, back, n = np.unique(folded, return_index=True, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:255]
    code_of = np.full(len(kinds), 255, np.uint8)
    code_of[common] = np.arange(len(common))
    code = code_of[back]
    rare = np.flatnonzero(code == 255)
    return [cells, rest, code, *(v[first[common]] for v in values), rare, *(v[rare] for v in values)]


class _Lookup:
    """Reads what ``_table`` made."""

    def __init__(self, arrays: list[np.ndarray]):
        self.cells, self.rest, self.code = arrays[:3]
        k = (len(arrays) - 4) // 2
        self.common, self.rare, self.others = arrays[3 : 3 + k], arrays[3 + k], arrays[4 + k :]
        self.bits = (len(self.cells) - 1).bit_length() - 1
        self.steps = int(np.diff(self.cells.astype(np.int64)).max(initial=0)).bit_length()

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values of each key, 0 where it is absent."""
        if not len(self.rest):
            return [np.zeros(len(keys), np.int64) for _ in self.common]
        cell = (keys >> _U(64 - self.bits)).astype(np.int64)
        rest = (keys >> _U(32 - self.bits)).astype(np.uint32)
        lo, end, last = self.cells[cell].astype(np.int64), self.cells[cell + 1].astype(np.int64), len(self.rest) - 1
        hi = end
        for _ in range(self.steps):
            middle = (lo + hi) >> 1
            less = (middle < hi) & (self.rest[np.minimum(middle, last)] < rest)
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
        at = np.minimum(lo, last)
        hit = (lo < end) & (self.rest[at] == rest)
        code = self.code[at].astype(np.int64)
        rare = np.flatnonzero(hit & (code == 255))
        where = np.searchsorted(self.rare, at[rare]) if len(rare) else rare
        out = []
        for common, others in zip(self.common, self.others):
            value = np.where(hit, common[np.minimum(code, len(common) - 1)].astype(np.int64), 0)
            value[rare] = others[where]
            out.append(value)
        return out


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; mapping files needs one."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be mounted on all nodes: {uri}")
    return unquote(parts.path)


@dataclass(frozen=True)
class Vocabulary:
    """Where the counted words lie, and how many are frequent."""

    folder: str
    buckets: int
    filled: frozenset[int]
    words: int
    tokens: int
    frequent: int

    @property
    def kind(self) -> type:
        return np.uint32 if self.words + 2 < 1 << 32 else _U

    @property
    def unknown(self) -> int:
        return int(np.iinfo(self.kind).max)


@dataclass(frozen=True)
class KneserNey:
    """A counted model: its words, which buckets its levels fill, and their discounts."""

    vocabulary: Vocabulary
    order: int
    filled: tuple[frozenset[int], ...]
    hot: tuple[frozenset[int], ...]
    discounts: tuple[tuple[float, float, float], ...]
    unigrams: tuple[int, int, int, int]

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens


class _Numbers:
    """Looks words up in the files of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.files = vocabulary, {}
        self.first = np.load(f"{vocabulary.folder}/first.npy") if vocabulary.words else None

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; the greatest number and 0 where it was not seen."""
        v = self.vocabulary
        asked, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(asked), v.unknown, v.kind), np.zeros(len(asked), np.int64)
        bucket = _bucket(asked, v.buckets)  # ascending, as the hashes are
        edges = np.append(_runs(bucket), len(asked)).tolist() if len(asked) else []
        for lo, hi in zip(edges, edges[1:]):
            b = int(bucket[lo])
            if b not in v.filled:
                continue
            if b not in self.files:
                self.files[b] = _map(f"{v.folder}/words-{b}")
            there, raw, rank = self.files[b]
            at = np.minimum(np.searchsorted(there, asked[lo:hi]), len(there) - 1)
            hit = np.flatnonzero(there[at] == asked[lo:hi])
            at = at[hit]
            count[lo + hit] = raw[at]
            number[lo + hit] = self.first[b, _power(raw[at])] + rank[at].astype(np.int64)
        return number[back], count[back]


def _power(count: np.ndarray) -> np.ndarray:
    """The greatest power of two that a count reaches."""
    return np.frexp(count.astype(np.float64))[1] - 1


_LOADED: dict[str, object] = {}


def _loaded(key: str, make):
    """One reader for each worker process and model."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def _trains(ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    return np.array([not held_out(i, modulus, remainder) for i in ids.to_pylist()], bool)


def _count_words(buckets: int, modulus: int, remainder: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            return _rows("words", _bucket(found, buckets), [found, count.astype(_U)])

        for b in (part for whole in batches for part in arrow.parts(whole, 1, PART)):
            held.append(_words(b.column(1), _trains(b.column(0), modulus, remainder))[0])
            size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _merge_words(folder: str):
    """One bucket of words: hashes, counts, and each word's rank among those whose counts reach the same power of two."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, counts = _read(table, [_U, _U])
        found, back = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, back, counts.astype(np.int64))
        power = _power(total)
        order = np.argsort(power, kind="stable")
        of_power = np.bincount(power, minlength=64)
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found)) - np.repeat(np.cumsum(of_power) - of_power, of_power)
        bucket = key[0].as_py()
        _write(f"{folder}/words-{bucket}", [found, total, rank])
        return pa.Table.from_batches([_stats(bucket, [*_histogram(total), *of_power.tolist()])])

    return run


def _grams(flat: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of all n-grams of some texts, the farthest word first."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns = [flat]
    for back in range(1, order):
        before = np.full(len(flat), BEGIN, flat.dtype)
        inside = np.flatnonzero(place >= back)
        before[inside] = flat[inside - back]
        columns.insert(0, before)
    return columns


def _merge(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with equal columns become one, with their sum, in order of the columns."""
    keys = columns
    if columns[0].itemsize == 4:  # two columns at once
        keys = [a.astype(_U) << _U(32) | b for a, b in zip(columns[::2], columns[1::2])] + columns[len(columns) // 2 * 2 :]
    order = np.lexsort(keys[::-1])
    columns = [c[order] for c in columns]
    at = _runs(*columns)
    return [c[at] for c in columns], np.add.reduceat(count[order], at) if len(at) else count


def _hash(context: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    for c in context:
        out = _mix(out, c.astype(_U))
    return out


def _often(context: list[np.ndarray], frequent: int, n: int) -> np.ndarray:
    """Contexts of frequent words, or of what stands before a text, alone."""
    out = np.ones(n, bool)
    for c in context:
        out &= c <= frequent
    return out


def _dealt(columns: list[np.ndarray], frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts and n-grams, which contexts are frequent, and by what the n-gram is dealt."""
    n = len(columns[0])
    context = _hash(columns[:-1], n)
    gram, often = _mix(context, columns[-1].astype(_U)), _often(columns[:-1], frequent, n)
    return context, gram, often, np.where(often, gram, context)


def _send(columns: list[np.ndarray], count: np.ndarray, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Merged rows by bucket."""
    group = _bucket(_dealt(columns, v.frequent)[3], v.buckets)
    order = _in_order(group, v.buckets)
    return _rows("grams", group[order], [*(c[order] for c in columns), count[order].astype(_U)])


def _count(order: int, v: Vocabulary, modulus: int, remainder: int):
    """Counts the n-grams of the highest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = _loaded(f"numbers {v.folder}", lambda: _Numbers(v)), [], 0

        def flush():
            columns = _grams(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), order)
            return _send(*_merge(columns, np.ones(len(columns[0]), np.int64)), v)

        for b in (part for whole in batches for part in arrow.parts(whole, 1, PART)):
            flat, n = _words(b.column(1), _trains(b.column(0), modulus, remainder))
            held.append((numbers(flat)[0], n))
            size += len(flat)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _level(level: int, v: Vocabulary):
    """Merges one bucket of one level, writes its arrays, and passes on what the level below counts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *columns, count = _read(table, [v.kind] * level + [_U])
        del table
        columns, count = _merge(columns, count.astype(np.int64))
        bucket = key[0].as_py()
        out = [_stats(bucket, _histogram(count))]
        if level == 1:
            _write(f"{v.folder}/1-{bucket}", [columns[0], count])
            return pa.Table.from_batches(out)
        at = _runs(*columns[:-1])
        context = [c[at] for c in columns[:-1]]
        hashes, often = _hash(context, len(at)), _often(context, v.frequent, len(at))
        grams = _mix(np.repeat(hashes, np.diff(np.append(at, len(count)))), columns[-1].astype(_U))
        totals = [np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2, count >= 3)]
        _write_tables(f"{v.folder}/{level}-{bucket}", (grams, [count]), (hashes[~often], [t[~often] for t in totals]))
        del grams, context
        if often.any():
            order = np.flatnonzero(often)[np.argsort(hashes[often])]
            out += _rows("hot", _bucket(hashes[order], HOT_FILES), [hashes[order], *(t[order].astype(_U) for t in totals)])
        del hashes, totals
        lower, ones = _merge(columns[1:], np.ones(len(count), np.int64))
        out += _send(lower, ones, v)
        return pa.Table.from_batches(out)

    return run


def _write_tables(path: str, *tables: tuple[np.ndarray, list[np.ndarray]]) -> None:
    arrays = [_table(_mix(keys, keys), values) for keys, values in tables]
    _write(path, [np.array([len(a) for a in arrays], np.uint8), *(x for a in arrays for x in a)])


def _map_tables(path: str) -> list[_Lookup]:
    n, *arrays = _map(path)
    out = []
    for k in n.tolist():
        out.append(_Lookup(arrays[:k]))
        arrays = arrays[k:]
    return out


def _hot(level: int, folder: str):
    """Adds up one file of frequent contexts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, *totals = _read(table, [_U] * 5)
        order = np.argsort(hashes, kind="stable")
        at = _runs(hashes[order])
        bucket = key[0].as_py()
        _write_tables(f"{folder}/hot-{level}-{bucket}", (hashes[order][at], [np.add.reduceat(t[order].astype(np.int64), at) for t in totals]))
        return pa.Table.from_batches([_stats(bucket, [len(at)])])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; one half each where counts are too few."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return tuple(min(max(x, 0.0), k + 1.0) for k, x in enumerate(d))


def _collected(rows: DataFrame) -> dict[int, np.ndarray]:
    """Some numbers for each bucket."""
    return {r["bucket"]: np.frombuffer(r["blob"], "<i8") for r in rows.where("kind = 'stats'").select("bucket", "blob").collect()}


def train(df: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> KneserNey:
    """Counts the n-grams of all texts but those held out.

    Null texts are one end token; a null id trains; rows may repeat; other
    columns are ignored; an empty table gives a model without words. Each task
    first merges its own n-grams, so a frequent one leaves it once for every
    FLUSH tokens; the number of buckets follows from the bytes of text.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP
    folder = local_path(scratch.folder(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    words = docs.mapInArrow(_count_words(buckets, modulus, remainder), _BLOB_DDL).groupBy("bucket").applyInArrow(_merge_words(folder), _BLOB_DDL)
    stats = _collected(words)
    total = sum(stats.values(), np.zeros(6 + 64, np.int64))
    of_power = np.zeros((64, buckets), np.int64)
    for b, x in stats.items():
        of_power[:, b] = x[6:]
    downward = of_power[::-1].reshape(-1)
    first = (1 + np.cumsum(downward) - downward).reshape(64, buckets)[::-1].T
    np.save(f"{folder}/first.npy", first)
    least = int(_power(np.array([max(1, total[1] / FREQUENT)]))[0])
    v = Vocabulary(folder, buckets, frozenset(stats), int(total[0]), int(total[1]), int(of_power[least:].sum()))
    if order == 1:
        seen, (n, tokens, n1, n2, n3, n4) = [discounts(*map(int, total[2:6]))], map(int, total[:6])
        return KneserNey(v, 1, (frozenset(),), (frozenset(),), tuple(seen), (tokens, n1, n2, n - n1 - n2))
    rows = docs.mapInArrow(_count(order, v, modulus, remainder), _BLOB_DDL)
    filled, found, hot, unigrams = [], [], [], (0, 0, 0, 0)
    above: list[str] = []
    for level in range(order, 0, -1):
        merged = scratch.table(rows.where("kind = 'grams'").groupBy("bucket").applyInArrow(_level(level, v), _BLOB_DDL), f"level-{level}")
        mine = scratch.made[-1:]
        stats = _collected(merged)
        n, tokens, n1, n2, n3, n4 = map(int, sum(stats.values(), np.zeros(6, np.int64)))
        filled.append(frozenset(stats))
        found.append(discounts(n1, n2, n3, n4))
        hot.append(frozenset(_collected(merged.where("kind = 'hot'").groupBy("bucket").applyInArrow(_hot(level, folder), _BLOB_DDL))) if level > 1 else frozenset())
        unigrams = (tokens, n1, n2, n - n1 - n2)
        scratch.drop(spark, above)
        rows, above = merged, mine
    scratch.drop(spark, above)
    return KneserNey(v, order, tuple(filled[::-1]), tuple(hot[::-1]), tuple(found[::-1]), unigrams)


class _Reader:
    """Looks words and n-grams up, bucket by bucket."""

    def __init__(self, model: KneserNey):
        self.model, self.numbers = model, _Numbers(model.vocabulary)
        self.files: dict[str, list] = {}

    def tables(self, name: str, read=_map_tables) -> list:
        if name not in self.files:
            self.files[name] = read(f"{self.model.vocabulary.folder}/{name}")
        return self.files[name]

    @staticmethod
    def buckets(by: np.ndarray, n: int, filled: frozenset[int]) -> Iterator[tuple[int, np.ndarray]]:
        bucket = _bucket(by, n)
        order = _in_order(bucket, n)
        edges = np.append(_runs(bucket[order]), len(order)).tolist() if len(order) else []
        for lo, hi in zip(edges, edges[1:]):
            if (b := int(bucket[order[lo]])) in filled:
                yield b, order[lo:hi]

    def continuations(self, words: np.ndarray) -> np.ndarray:
        asked, back = np.unique(words, return_inverse=True)
        out = np.zeros(len(asked), np.int64)
        by = _dealt([asked], self.model.vocabulary.frequent)[3]
        for b, mine in self.buckets(by, self.model.vocabulary.buckets, self.model.filled[0]):
            there, count = self.tables(f"1-{b}", _map)
            at = np.minimum(np.searchsorted(there, asked[mine]), len(there) - 1)
            out[mine] = np.where(there[at] == asked[mine], count[at], 0)
        return out[back]

    def level(self, level: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        """Count of each n-gram; total, and numbers of counts 1, 2 and more, of its context."""
        m, n = self.model, len(columns[0])
        context, gram, often, by = _dealt(columns, m.vocabulary.frequent)
        out = [np.zeros(n, np.int64) for _ in range(5)]
        context, gram = _mix(context, context), _mix(gram, gram)
        for b, mine in self.buckets(by, m.vocabulary.buckets, m.filled[level - 1]):
            grams, contexts = self.tables(f"{level}-{b}")
            for x, value in zip(out, grams(gram[mine]) + contexts(context[mine])):
                x[mine] = value
        some = np.flatnonzero(often)
        asked, back = np.unique(_hash([c[some] for c in columns[:-1]], len(some)), return_inverse=True)
        totals = [np.zeros(len(asked), np.int64) for _ in range(4)]
        for b, mine in self.buckets(asked, HOT_FILES, m.hot[level - 1]):
            for x, value in zip(totals, self.tables(f"hot-{level}-{b}")[0](_mix(asked[mine], asked[mine]))):
                x[mine] = value
        for x, value in zip(out[1:], totals):
            x[some] = value[back]
        return out

    def score(self, columns: list[np.ndarray], raw: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last word."""
        m = self.model
        p = np.full(len(raw), 1 / (m.vocabulary.words + 1))
        for level in range(1, m.order + 1):
            d1, d2, d3 = m.discounts[level - 1]
            if level == 1:
                count = raw if m.order == 1 else self.continuations(columns[-1])
                total, n1, n2, n3 = (np.full(len(raw), x, np.int64) for x in m.unigrams)
            else:
                count, total, n1, n2, n3 = self.level(level, columns[-level:])
            known = total > 0
            less = np.choose(np.minimum(count, 3), [0.0, d1, d2, d3])
            kept = d1 * n1 + d2 * n2 + d3 * n3
            p[known] = ((count - less + kept * p) / np.maximum(total, 1))[known]
        return np.log10(p)


def score(df: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Scores each text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are log10 probabilities of the whole text and its end token;
    perplexity is for each token. Null and empty texts are the end token
    alone; a null id trains; repeated rows score alike; other columns are
    ignored; an untrained model gives every token probability one. One narrow
    pass that maps the model's files from the shared folder.
    """
    scratch.prepare(df.sparkSession)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]
    schema = pa.schema(fields)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _loaded(f"model {model.vocabulary.folder}", lambda: _Reader(model))
        below = model.tokens + model.vocabulary.words + 1
        for b in (part for whole in batches for part in arrow.parts(whole, 1, PART)):
            found, n = _words(b.column(1))
            flat, raw = reader.numbers(found)
            log_p = reader.score(_grams(flat, n, model.order), raw)
            at = np.cumsum(n) - n
            base = np.add.reduceat(np.log10((raw + 1) / below), at)
            total = np.add.reduceat(log_p, at)
            out = ~_trains(b.column(0), modulus, remainder)
            yield arrow.batch(schema, b.column(0), out, n, np.add.reduceat((raw > 0).astype(np.int64), at), np.full(len(n), model.tokens), base, total, 10 ** (-total / n))

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
