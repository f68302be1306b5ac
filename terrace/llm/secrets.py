"""Secret scans: fixed patterns, and a randomness test battery over opaque tokens.

The battery gives each token a p-value of being random. What counts as a
secret is a discovery against the opposite hypothesis, that the token is
structured: every document's own words and bytes, joined and encoded in the
ways identifiers are, show how random structured tokens of an encoding and a
length look, and the share of false ones among the reported is controlled.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Opaque tokens have this many characters at least; shorter ones leave the tests no power.
SHORTEST = 20
#: "=" is padding at a token's end and parts names from values elsewhere.
_PADDING = r"(?:=+(?![A-Za-z0-9+/_=-]))?"
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST + _PADDING)
#: What "_" and "-" part in a token that no encoding holds because of "+" or "/".
_PART = re.compile(r"[A-Za-z0-9+/]{%d,}" % SHORTEST + _PADDING)
#: Lower ends of the length classes, within which false discoveries are controlled.
CLASSES = (20, 28, 40, 64, 128)
#: Share of structured tokens among those reported.
FDR = 0.05
#: Histogram bins for each tenfold of a p-value, and the smallest exponent told apart.
BINS, DEEPEST = 20, 40

_TO_CLASS = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 32 for b in range(256))
_TO_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the narrowest; a token's is the first that holds all its symbols.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Encodings of bytes, which the battery decodes. Base64 of short texts often has letters and digits only.
_BYTES = {"hex": 16, "HEX": 16, "base62": 64, "base64": 64, "base64url": 64}
_KINDS = tuple(ENCODINGS)
#: Words that stand by themselves.
_PROSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]+(?![A-Za-z0-9+/_=-])")
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


_CLASS = {c: k for k, s in (("d", _DIGITS), ("u", _UPPER), ("l", _LOWER), ("s", "+/-_")) for c in s}
#: Shares of digits, capitals, small letters and signs in each alphabet.
_CLASSES = {k: {c: n / len(v) for c, n in Counter(_CLASS[x] for x in v).items()} for k, v in ENCODINGS.items()}


def infer_encoding(token: str) -> str | None:
    symbols = set(token)
    return next((k for k, s in _SETS.items() if symbols <= s), None)


def _chi2_tail(x: float, dof: int) -> float:
    """P(chi-squared >= x), by the cube-root normal approximation."""
    if dof < 1 or x <= 0:
        return 1.0
    z = ((x / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _decoded(body: str, kind: str) -> bytes:
    if _BYTES[kind] == 16:
        return bytes.fromhex(body[: len(body) // 2 * 2])
    return base64.b64decode(body[: len(body) // 4 * 4].replace("-", "+").replace("_", "/"))


def battery(token: str) -> float:
    """Combined p-value of "symbols are drawn evenly and independently from the inferred encoding".

    Chi-squared of symbol counts and of character-class counts (the worse of
    both, doubled), a runs test of indices above and below the alphabet's
    middle, lag-1 serial correlation and, for encodings of bytes, chi-squared
    of the decoded bytes' highest bits, joined by Fisher's method. 0 where no
    encoding fits.
    """
    body = token.rstrip("=")
    kind = infer_encoding(body)
    n = len(body)
    if kind is None or n < SHORTEST:
        return 0.0
    alphabet = ENCODINGS[kind]
    k = len(alphabet)
    counts = Counter(body)
    even = n / k
    chi = sum((c - even) ** 2 for c in counts.values()) / even + (k - len(counts)) * even
    classes = _CLASSES[kind]
    by_class = dict.fromkeys(classes, 0)
    for c, m in counts.items():
        by_class[_CLASS[c]] += m
    chi_class = sum((by_class[c] - n * share) ** 2 / (n * share) for c, share in classes.items())
    p_even = min(1.0, 2 * min(_chi2_tail(chi, k - 1), _chi2_tail(chi_class, len(classes) - 1) if len(classes) > 1 else 1.0))
    place = _PLACE[kind]
    at = [place[c] for c in body]
    high = [2 * i >= k for i in at]
    n1 = sum(high)
    n0 = n - n1
    if n1 and n0:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(at) / n
    spread = sum((i - middle) ** 2 for i in at)
    if spread > 0:
        r = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / spread
        p_serial = math.erfc(abs(r) * math.sqrt(n / 2))
    else:
        p_serial = 2.0 ** (1 - n)
    tests = [p_even, p_runs, p_serial]
    if kind in _BYTES:
        raw = _decoded(body, kind)
        bits = sum(b >> 7 for b in raw)
        tests.append(_chi2_tail((2 * bits - len(raw)) ** 2 / len(raw), 1))
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(tests)))


def structured(text: str) -> list[str]:
    """Tokens as programs and people make them of words, numbers and bytes: one of each kind, from a text's own.

    Where they start, and which of the length classes each has, follows from
    the text's checksum. Texts of fewer than four words give none.
    """
    words = _PROSE.findall(text)
    if len(words) < 4:
        return []
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    first = seed % len(words)

    def size(kind: int) -> int:
        low = CLASSES[(seed >> 4) % len(CLASSES) - kind % len(CLASSES)]
        return low + (seed >> 8) % (low // 4 + 1)

    def take(kind: int, shape, joint: str = "") -> str:
        n, out, k = size(kind), "", 0
        while len(out) < n:
            out += (joint if out else "") + shape(words[(first + k) % len(words)], k)
            k += 1
        return out[:n].rstrip("-_")

    def raw(n: int) -> bytes:
        return take(0, lambda w, k: w, " ").encode().ljust(n, b" ")[:n] if n <= size(0) else (" ".join(words[first:] + words[:first]) * (1 + n // 8)).encode()[:n]

    number = lambda k: str(1900 + (seed + 37 * k) % 200)
    return [
        take(0, lambda w, k: w.lower()),
        take(1, lambda w, k: w.lower() if not k else w.title()),
        take(2, lambda w, k: w.title() + (number(k) if k % 2 else "")),
        take(3, lambda w, k: w.lower() + (number(k) if k % 3 == 2 else ""), "_"),
        take(4, lambda w, k: w.title() if k % 2 else w.lower(), "-"),
        take(5, lambda w, k: w.upper() + (number(k) if k % 3 == 2 else "")),
        base64.b64encode(raw(size(6)))[: size(6)].decode(),
        base64.b64encode(raw(size(7) // 4 * 3)).decode(),
        raw(size(8) // 2 + 1).hex()[: size(8)],
        raw(size(9) // 2 + 1).hex().upper()[: size(9)],
        take(0, lambda w, k: w.lower() + (number(k) if k % 2 else "")),
        take(1, lambda w, k: w.lower() if k % 3 else w.title(), "/"),
        take(2, lambda w, k: w.upper()),
    ]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of the fixed patterns, by start and kind."""
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_TO_HEX):
        found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def opaque_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p) of long tokens that touch no fixed span."""
    if b"x" * SHORTEST not in text.encode("utf-8", "surrogatepass").translate(_TO_CLASS):
        return []
    spans = []
    for m in _OPAQUE.finditer(text):
        mixed = infer_encoding(m[0].rstrip("=")) is None
        spans += [(x.start(), x.end()) for x in (_PART.finditer(text, m.start(), m.end()) if mixed else (m,))]
    # both lists go by start; ends of fixed spans need not, so their greatest so far is kept
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= a:
            out.append((a, b, battery(text[a:b])))
    return out


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def _bin(p: float) -> int:
    return min(DEEPEST * BINS, int(-math.log10(p) * BINS)) if p > 0 else DEEPEST * BINS


def _cell(token: str) -> tuple[int, int]:
    """Length class and number of the encoding; the one past the last where none fits, or for digits alone."""
    kind = infer_encoding(token.rstrip("="))
    return length_class(len(token)), _KINDS.index(kind) if kind not in (None, "decimal") else len(_KINDS)


def discoveries(found: list[tuple[int, int, int, int]], null: list[tuple[int, int, int, int]], fdr: float) -> dict[tuple[int, int], int]:
    """Of each length class and encoding, the last bin whose tokens are reported.

    Rows are class, encoding, bin, number. A token's p-value under "it is
    structured" is the share of structured tokens of its class and encoding
    that look as random; Benjamini and Hochberg's step-up rule goes over all
    tokens of a class.
    """
    out: dict[tuple[int, int], int] = {}
    for klass in {r[0] for r in found}:
        mine = Counter()
        for k, kind, at, n in found:
            if k == klass:
                mine[kind, at] += n
        share = {}
        for kind in {kind for kind, _ in mine if kind < len(_KINDS)}:
            base = sorted((at, n) for k, x, at, n in null if k == klass and x == kind)
            total = sum(n for _, n in base)
            for at in sorted(a for x, a in mine if x == kind):
                share[kind, at] = (1 + sum(n for a, n in base if a <= at)) / (1 + total)
        total, seen, limit = sum(mine.values()), 0, -1.0
        ranked = sorted(share.items(), key=lambda x: x[1])
        for k, (cell, p) in enumerate(ranked):
            seen += mine[cell]
            if (k + 1 == len(ranked) or ranked[k + 1][1] > p) and p <= fdr * seen / total:
                limit = p
        for (kind, at), p in share.items():
            if p <= limit:
                out[klass, kind] = max(at, out.get((klass, kind), -1))
    return out


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """``discoveries`` over all documents' tokens and structured tokens, from histograms whose size does not depend on the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("real", pa.bool_()), ("klass", pa.int32()), ("kind", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
        counts: Counter = Counter()
        for b in batches:
            for text in arrow.strings(b.column(0)):
                for s, e, p in opaque_tokens(text, base_spans(text)):
                    counts[(True, *_cell(text[s:e]), _bin(p))] += 1
                for token in structured(text):
                    if len(token) >= SHORTEST:
                        counts[(False, *_cell(token), _bin(battery(token)))] += 1
        if counts:
            yield arrow.batch(schema, *map(list, zip(*counts)), list(counts.values()))

    rows = docs.select("text").mapInArrow(run, "real boolean, klass int, kind int, bin int, n long").groupBy("real", "klass", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    split = lambda real: [(r["klass"], r["kind"], r["bin"], r["n"]) for r in rows if r["real"] == real]
    return discoveries(split(True), split(False), fdr)


def all_spans(text: str, limits: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    extra = [(a, b, 3) for a, b, p in opaque_tokens(text, base) if _bin(p) <= limits.get(_cell(text[a:b]), -1)]
    return sorted(base + extra, key=lambda s: (s[0], s[2])) if extra else base


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Spans of secrets: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Positions are code points, ends exclusive. Fixed patterns always count. A
    long opaque token that touches none of them counts when it looks more
    random than structured tokens do, at the false-discovery rate ``fdr``
    within its length class. Digits alone never count: numbers look random.
    Null and empty texts have no spans; an empty table gives none. Rows pass
    one by one, whatever their ids, repeated ones alike; only the two named
    columns are read. Two narrow passes over the texts, and between them
    histograms of fixed size.
    """
    scratch.prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    limits = thresholds(docs, fdr)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t, limits) for t in arrow.strings(b.column(1))]
            counts = [[sum(s[2] == k for s in x) for x in found] for k in range(4)]
            base = [hashlib.sha256(_join([s for s in x if s[2] < 3]).encode()).hexdigest() for x in found]
            yield arrow.batch(schema, b.column(0), *counts, base, [_join(x) for x in found])

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``mark``; overlapping spans become one.

    All other columns, whatever their names, and rows without secrets stay as
    they are; null texts stay null, empty ones empty; repeated rows change
    alike; an empty table stays empty.
    """
    scratch.prepare(df.sparkSession)
    limits = thresholds(df.select(F.col(text_col).cast("string").alias("text")), fdr)

    @F.pandas_udf("string")
    def cleaned(texts):
        import pandas as pd

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, b, _ in all_spans(text, limits):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        return pd.Series([one(t) for t in texts], dtype=object)

    return df.withColumn(text_col, cleaned(F.col(text_col)))
