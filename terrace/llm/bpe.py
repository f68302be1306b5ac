"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever joins two neighbouring pieces into a longer vocabulary
token, so no token spans a byte pair that occurs inside none of them. Such
pairs are certain cuts: the fragments between them are encoded on their own
and their ids are concatenated, which gives the ids of the whole.

On top of that, a space followed by a non-space always starts a new word of
the byte-level pattern, so a text is first split at spaces; each chunk is
looked up, and only unseen chunks are matched, cut and merged.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

#: The pattern of byte-level BPE vocabularies of this kind (fixed value).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker remembers of chunks, words and fragments each, in each of two generations.
MEMORY = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Keys over this length are not remembered, so that entries bound a worker's bytes too.
LONGEST_KEY = 64


class _Memo(dict):
    """Computes what it does not hold; when full, it keeps what has been asked for since the last time."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers JSON file.

    With ``library``, unseen chunks are merged by a compiled library with the
    same pattern and merges. It takes ids for ranks, so this needs a
    vocabulary whose ids follow its merges; for others nothing changes.
    """

    def __init__(self, path: str, library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[vocab[a], vocab[b]] = (k, vocab[a + b])
        self._shift = size.bit_length()
        self._order = {a << self._shift | b: k for (a, b), (k, _) in self.rank.items()}
        self._made = [0] * (1 + max((k for k, _ in self.rank.values()), default=-1))
        for k, new in self.rank.values():
            self._made[k] = new
        inside = {t[i : i + 2] for t in vocab for i in range(len(t) - 1)}
        self.inside = inside
        self._word = regex.compile(WORD)
        self._odd_space = re.compile(r" (?=\s)| \Z")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fragments = _Memo(lambda b: np.array(self.merge(b), "<u4").tobytes())
        self._words = _Memo(self._encode_word)
        self._spaced = _Memo(lambda chunk: self._encode_chunk(" " + chunk))
        merged = [new for _, new in self.rank.values()]
        if library and merged == sorted(merged):
            import tiktoken

            ids = tiktoken.Encoding("merges", pat_str=WORD, mergeable_ranks=vocab, special_tokens={})
            self._encode_chunk = lambda chunk: array("I", ids.encode_ordinary(chunk)).tobytes()
            self._spaced.size = 300_000  # words and fragments need no room

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of ``word`` between its certain cuts."""
        if word in self.inside or len(word) < 2:
            return [word]
        inside, out, start = self.inside, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Merges the lowest-ranked pair, the leftmost of equals, until none is left.

        What a merge makes ranks after it, so only the ranks beside it change.
        Short fragments keep a list of ranks; long ones a heap and linked
        neighbours, so a long run without cuts costs n log n.
        """
        ids = [self.byte_ids[b] for b in fragment]
        if len(ids) > 64:
            return self._merge_long(ids)
        get, shift, none = self._order.get, self._shift, len(self._made)
        ranks = [get(a << shift | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = self._made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << shift | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << shift | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        import heapq

        n, rank = len(ids), self.rank
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if r := rank.get((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[after[j]]))
            if (p := before[i]) >= 0 and (r := rank.get((ids[p], new))):
                heapq.heappush(heap, (r[0], p, r[1], ids[p], new))
        return [x for x, alive in zip(ids, live) if alive]

    def _encode_word(self, word: str) -> bytes:
        return b"".join([self._fragments[f] for f in self.cuts(word.encode("utf-8"))])

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._word.findall(chunk)))

    def _encode_plain(self, text: str) -> bytes:
        if self._odd_space.search(text):
            return self._encode_chunk(text)
        first, *rest = text.split(" ")
        return (self._encode_chunk(first) if first else b"") + b"".join(map(self._spaced.__getitem__, rest))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self._special or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode_plain(p) for p in self._special.split(text) if p])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, "<u4").tobytes()).decode("utf-8")


_LOADED: dict[tuple[str, bool], ByteBPE] = {}


def vocabulary(path: str, library: bool = False) -> ByteBPE:
    """One vocabulary for each worker process and path."""
    if (path, library) not in _LOADED:
        _LOADED[path, library] = ByteBPE(path, library)
    return _LOADED[path, library]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes and decodes each text: id, n_tokens, ids (array), ids_sha256, decoded_sha256, decoded.

    Null and empty texts have no ids and decode to the empty text. Null ids,
    repeated rows and an empty table pass through; other columns are ignored.
    One narrow pass: no shuffle, whatever the keys are.
    """
    scratch.prepare(df.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for b in batches:
            n, sha, back, ids_out, texts = [], [], [], [], []
            for text in arrow.strings(b.column(1)):
                ids = bpe.encode_bytes(text)
                decoded = bpe.decode_bytes(ids)
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_out.append(np.frombuffer(ids, "<i4"))
                    texts.append(decoded.decode("utf-8"))
            columns = [b.column(0), n, sha, back] + ([ids_out, texts] if with_ids else [])
            yield arrow.batch(schema, *columns)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
