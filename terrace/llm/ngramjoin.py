"""N-gram Jaccard join with prefix trees.

Documents are sets of hashed word n-grams in one global order, by the count
of an n-gram's rarest word, then by hash. Two sets that are alike enough
share an n-gram among the first few of either; documents that share one meet
in a group. In each group the sets stand in a prefix tree, common n-grams
first, so that like sets share nodes; each set walks the tree, carries its
overlap along shared paths, and leaves a subtree when the lengths that remain
cannot reach the overlap that any set below would need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import arrow, scratch, words

#: Counters of words; their number does not depend on the input.
COUNTERS = 1 << 20
SLICE = 1 << 14
#: Documents, and n-grams of theirs, of a group that one task holds in a tree; larger groups are cut into blocks that meet
#: pairwise.
BLOCK, ELEMENTS = 1500, 2_000_000
#: N-grams of all sets whose first elements make up one bucket in memory.
GROUP = 2_000_000
_U = np.uint64


class Shingler:
    """Sets of texts as sorted 64-bit keys: six bits of rarity level, then the n-gram's hash."""

    def __init__(self, n: int, levels: np.ndarray):
        self.n, self.levels = n, levels
        self.factors = [_U(xxhash.xxh64_intdigest(b"factor %d" % k) | 1) for k in range(n)]

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        found, offsets = words.hashes(*arrow.utf8(texts))
        rank = self.levels[(found & _U(COUNTERS - 1)).astype(np.int64)]
        return [self.keys(found[a:z], rank[a:z]) for a, z in zip(offsets.tolist(), offsets[1:].tolist())]

    def keys(self, w: np.ndarray, rank: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        size = min(self.n, len(w))
        m = len(w) - size + 1
        level = rank[:m]
        with np.errstate(over="ignore"):
            x = np.full(m, size, _U)
            for k in range(size):
                x += w[k : k + m] * self.factors[k]
                level = np.minimum(level, rank[k : k + m])
            x ^= x >> _U(33)
            x *= _U(0xFF51AFD7ED558CCD)
            x ^= x >> _U(33)
            x *= _U(0xC4CEB9FE1A85EC53)
            x ^= x >> _U(33)
        return np.unique((level.astype(_U) << _U(58)) | (x >> _U(6)))


def word_levels(docs: DataFrame) -> np.ndarray:
    """Half powers of two of the counts of all words, in COUNTERS hashed counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            found, _ = words.hashes(*arrow.utf8(b.column(0)))
            total += np.bincount((found & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        for k in range(COUNTERS // SLICE):
            part = total[k * SLICE : (k + 1) * SLICE]
            if part.any():
                yield arrow.batch(schema, [k], [part.astype("<u4" if part.max() < 1 << 32 else "<i8").tobytes()])

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(blob, "<u4" if len(blob) == 4 * SLICE else "<i8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(merge, "part int, counts binary").collect()  # COUNTERS numbers
    out = np.zeros(COUNTERS, np.int64)
    for r in parts:
        out[r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(63, 2 * np.log2(out + 1)).astype(np.uint8)


def margin(n: int, percent: int) -> int:
    """Elements of their first ones that alike sets share at least: a twentieth of the overlap they need, or one."""
    return max(1, -(-percent * n // 100) // 20)


def prefix_length(n: int, percent: int) -> int:
    """Of two alike sets, so many first elements of either share ``margin`` of the smaller at least.

    They share ``need`` elements at least, and all but ``n - need`` of either
    are shared; so of ``n - need + k`` first elements, k of the smaller k are.
    """
    return n - -(-percent * n // 100) + margin(n, percent)


class PrefixTree:
    """Sets in lexicographic order of their keys, and the tree over their common beginnings.

    All sets walk the tree together: at each node there is a vector of the
    overlaps, with the node's path, of the sets that may still find a partner
    below it.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, n = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.start = np.append(0, np.cumsum(self.sizes))
        flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        distinct, ranks = np.unique(flat, return_inverse=True)
        self.ranks, self.width = ranks.astype(np.int32), len(distinct) + 1
        del ranks, flat
        owner = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        # who has a key, by key; and all (set, key) pairs in order, to count a set's keys up to one
        self.holders = owner[np.argsort(self.ranks, kind="stable")]
        self.bounds = np.append(0, np.cumsum(np.bincount(self.ranks, minlength=len(distinct))))
        self.pairs = owner.astype(np.int64) * self.width + self.ranks
        common = np.zeros(n + 1, np.int64)
        for k in range(1, n):
            x, y = sets[k - 1], sets[k]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common[k] = differ[0] if len(differ) else m
        # node: first set, after last set, depth above its edge, depth, children
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []
        stack: list[tuple[int, int, int, int]] = [(0, n, 0, -1)] if n else []
        while stack:
            lo, hi, above, parent = stack.pop()
            depth = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.sizes[lo])
            if parent >= 0:
                self.nodes[parent][4].append(len(self.nodes))
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == depth)).tolist(), hi]
                stack += [(x, y, depth, len(self.nodes)) for x, y in zip(cuts, cuts[1:])]
            self.nodes.append((lo, hi, above, depth, []))

    def _seen(self, edge: np.ndarray) -> np.ndarray:
        """How many of an edge's keys each set has."""
        edge = edge.astype(np.int64)
        lo, n = self.bounds[edge], self.bounds[edge + 1] - self.bounds[edge]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.holders[at], minlength=len(self.sizes))

    def _reachable(self, who: np.ndarray, overlap: np.ndarray, last: int, depth: int, short: int, long: int) -> np.ndarray:
        """Which sets may be alike to one of ``short`` to ``long`` keys, ``depth`` of them seen up to key ``last``."""
        left = self.start[who + 1] - np.searchsorted(self.pairs, who * self.width + last, "right") if last >= 0 else self.sizes[who]
        best = np.clip(depth + left, short, long)
        total = overlap + np.minimum(left, best - depth)
        return 100 * total >= self.percent * (self.sizes[who] + best - total)

    def links(self, met: Callable[[int, np.ndarray], None] | None = None) -> list[tuple[int, int]]:
        """Pairs that join all components of the sets.

        Sets of one component do not walk to each other, unless ``met`` is
        given: it gets, for each set, all alike sets of smaller numbers.
        """
        n = len(self.sizes)
        label = np.arange(n)
        members = {k: [k] for k in range(n)}
        out: list[tuple[int, int]] = []
        everyone = np.flatnonzero(self.sizes)
        stack = [(0, everyone, np.zeros(len(everyone), np.int64))] if n else []
        while stack:
            node, who, overlap = stack.pop()
            lo, hi, above, depth, children = self.nodes[node]
            short, long = int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
            below = label[lo:hi]
            keep = who < hi - 1
            if met is None and (below == below[0]).all():
                keep &= label[who] != below[0]
            who, overlap = who[keep], overlap[keep]
            at, step = above, 32
            while len(who) and at < depth:
                edge = self.ranks[self.start[lo] + at : self.start[lo] + min(at + step, depth)]
                overlap = overlap + self._seen(edge)[who]
                at += len(edge)
                step *= 4
                keep = self._reachable(who, overlap, int(edge[-1]), at, short, long)
                who, overlap = who[keep], overlap[keep]
            if not len(who):
                continue
            if hi - lo > 1:
                stack += [(c, who, overlap) for c in reversed(children)]
                continue
            alike = 100 * overlap >= self.percent * (self.sizes[who] + self.sizes[lo] - overlap)
            if met is not None and alike.any():
                met(lo, who[alike])
            for x in who[alike & (label[who] != label[lo])].tolist():
                self._join(x, lo, label, members, out)
        return out

    @staticmethod
    def _join(a: int, b: int, label: np.ndarray, members: dict[int, list[int]], out: list) -> None:
        p, q = int(label[a]), int(label[b])
        if p != q:
            out.append((a, b))
            if len(members[p]) < len(members[q]):
                p, q = q, p
            label[members[q]] = p
            members[p] += members.pop(q)


_POSTINGS = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])


def _post(buckets: int, flush: int = 1_000_000):
    """(rep, n, prefix) rows to (key, rep, n) by key, packed by bucket."""
    from terrace.llm.suffixdedup import _pack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            keys, reps, n = (np.concatenate(c) for c in zip(*held))
            with np.errstate(over="ignore"):
                spread = (keys * _U(0x9E3779B97F4A7C15)) >> _U(32)
            bucket = (spread * _U(buckets) >> _U(32)).astype(np.int64)
            order = np.lexsort((keys, bucket))
            keys, reps, n, bucket = keys[order], reps[order], n[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = int(ends[b]), int(ends[b + 1])
                if hi > lo:
                    yield arrow.batch(_POSTINGS, [b], [hi - lo], [_pack([keys[lo:hi], reps[lo:hi], n[lo:hi]])])

        for b in batches:
            for rep, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                keys = np.frombuffer(raw, _U)
                held.append((keys, np.full(len(keys), rep), np.full(len(keys), n)))
                size += len(keys)
                if size >= flush:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return run


_MEETINGS_KINDS = [np.int64, np.int64, np.int32, np.int64]


def _meet(percent: int, buckets: int):
    """Of each key that several documents of like sizes hold: each with the smallest of them, and how often.

    Rows are packed by groups of documents, as many as there are buckets.
    """
    from terrace.llm.suffixdedup import _pack, _unpack

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(blob.as_py(), n, [_U, np.int64, np.int64]) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
        keys, reps, sizes = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((sizes, keys))
        keys, reps, sizes = keys[order], reps[order], sizes[order]
        # by size, a gap that no alike pair can span ends a run
        gap = (keys[1:] != keys[:-1]) | (percent * sizes[1:] > 100 * sizes[:-1])
        start = np.flatnonzero(np.append(True, gap))
        n = np.diff(np.append(start, len(keys)))
        shared = np.repeat(n > 1, n)
        leaders, reps, sizes = np.repeat(np.minimum.reduceat(reps, start), n)[shared], reps[shared], sizes[shared]
        if not len(reps):
            return _POSTINGS.empty_table()
        order = np.lexsort((leaders, reps))
        leaders, reps, sizes = leaders[order], reps[order], sizes[order]
        at = np.flatnonzero(np.append(True, (reps[1:] != reps[:-1]) | (leaders[1:] != leaders[:-1])))
        times = np.diff(np.append(at, len(reps)))
        columns = [leaders[at], reps[at], times.astype(np.int32), np.minimum.reduceat(sizes, at)]
        with np.errstate(over="ignore"):
            group = ((columns[1].astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)) * _U(buckets) >> _U(32)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order].astype(np.int64), np.arange(buckets + 1))
        out = [arrow.batch(_POSTINGS, [b], [int(ends[b + 1] - ends[b])], [_pack([c[order][ends[b] : ends[b + 1]] for c in columns])]) for b in np.flatnonzero(np.diff(ends)).tolist()]
        return pa.Table.from_batches(out, _POSTINGS)

    return run


def _settle(percent: int):
    """Keeps documents that share as many first elements as an alike partner asks for; their leaders, once each."""
    from terrace.llm.suffixdedup import _unpack

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(blob.as_py(), n, _MEETINGS_KINDS) for n, blob in zip(table.column("n").to_pylist(), table.column("blob"))]
        leaders, reps, times, sizes = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((leaders, reps))
        leaders, reps, times, sizes = leaders[order], reps[order], times[order], sizes[order]
        start = np.flatnonzero(np.append(True, reps[1:] != reps[:-1]))
        # the margin of the smallest set that may be alike to the document's smallest
        least = np.maximum(1, percent * np.minimum.reduceat(sizes, start) // 100 * percent // 100 // 20)
        keep = np.repeat(np.add.reduceat(times.astype(np.int64), start) >= least, np.diff(np.append(start, len(reps))))
        keep[1:] &= (reps[1:] != reps[:-1]) | (leaders[1:] != leaders[:-1])
        return pa.table({"leader": pa.array(leaders[keep], pa.int64()), "rep": pa.array(reps[keep], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the graph of edges (a, b); a node without edges has no row.

    Each round takes the smallest label among neighbours and then that
    label's own label, so labels run along a path of n nodes in about log n
    rounds. A round's table is written, and only the sum of its labels comes
    to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, "edges")
    labels = scratch.table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
        before = total
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, "a").select("a", F.least("c", "m").alias("c"))
        jump = labels.select(F.col("a").alias("c"), F.col("c").alias("d"))
        labels = scratch.table(step.join(jump, "c", "left").select("a", F.least("c", F.coalesce("d", "c")).alias("c")), "labels")


def near_groups(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count: bool = True) -> DataFrame:
    """Components of documents whose word n-gram sets have a Jaccard of ``percent`` / 100 or more.

    Returns doc_id, n_shingles, component_id, the smallest id that links
    reach, and, with ``count``, n_links, how many other rows the row itself
    links with, equal sets among them. Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased;
    with fewer than n words, all of them are one n-gram; null, empty and blank
    texts have empty sets, which link with nothing. Documents with equal sets
    are one class, told by a 128-bit digest, and only its smallest id joins.
    Rows of one id are one node, whose sets link it each; n_shingles is each
    row's own. A row without an id has a null component and links with
    nothing. Only the two named columns are read.

    A pair of classes may meet in several groups; that of the smallest leader
    they share, and in it that of their own blocks, counts it. Sets are compared by 58-bit hashes of their n-grams.
    """
    spark = df.sparkSession
    scratch.prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(word_levels(docs))  # COUNTERS bytes

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("prefix", pa.binary())])
        shingler = Shingler(n, levels.value)
        for b in batches:
            sets = shingler.sets(b.column(1))
            digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield arrow.batch(schema, b.column(0), [len(s) for s in sets], digests, [s[: prefix_length(len(s), percent)].tobytes() if len(s) else None for s in sets])

    described = scratch.table(docs.mapInArrow(describe, "doc_id long, n long, digest binary, prefix binary"), "described")
    buckets = 1 + (described.agg(F.sum("n")).first()[0] or 0) // GROUP
    useful = described.where("doc_id IS NOT NULL AND n > 0")
    sized = useful.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"))
    own = sized.groupBy("rep").agg(F.collect_list(F.struct("digest", "rows")).alias("own"), F.sum("n").alias("elements"))
    classes = useful.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    posted = classes.select("rep", "n", "prefix").mapInArrow(_post(buckets), "bucket int, n long, blob binary")
    met = posted.groupBy("bucket").applyInArrow(_meet(percent, buckets), "bucket int, n long, blob binary")
    meetings = scratch.table(met.groupBy("bucket").applyInArrow(_settle(percent), "leader long, rep long"), "meetings")

    # A group over BLOCK documents or ELEMENTS n-grams is cut into k blocks by id hash, and each pair of blocks is a group.
    weights = meetings.join(own.select("rep", F.size("own").alias("sets"), "elements"), "rep")  # ids may have different texts
    size = weights.groupBy("leader").agg(F.sum("sets").alias("size"), F.sum("elements").alias("elements")).where("size > 1")
    size = size.select("leader", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("elements") / ELEMENTS)).cast("int").alias("k"))
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    seats = meetings.join(size, "leader").select("leader", "rep", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    groups = seats.select("rep", F.struct("leader", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("i").alias("block")).alias("g"))
    wanted = groups.groupBy("rep").agg(F.collect_list("g").alias("groups")).join(own.drop("elements"), "rep")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("digest", pa.binary()), ("rows", pa.int64()), ("before", pa.binary()), ("keys", pa.binary())])
        shingler = Shingler(n, levels.value)
        for b in batches:
            rows, held = [], 0
            for rep, keys, where, mine in zip(b.column(0).to_pylist(), shingler.sets(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                digest = xxhash.xxh128_digest(keys.tobytes())
                copies = {c["digest"]: c["rows"] for c in mine}.get(digest)
                if copies is None:  # another id stands for this text
                    continue
                keys = np.sort(~keys).astype(">u8").tobytes()  # common n-grams first
                leaders = np.unique([g["leader"] for g in where])
                for g in where:
                    before = leaders[: np.searchsorted(leaders, g["leader"])].tobytes() if count else b""
                    rows.append((g["leader"], g["i"], g["j"], g["block"], rep, digest, copies, before, keys))
                    held += len(keys) + len(before)
                    if held > 8 << 20:
                        yield arrow.batch(schema, *map(list, zip(*rows)))
                        rows, held = [], 0
            if rows:
                yield arrow.batch(schema, *map(list, zip(*rows)))

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ("keys", "rep", "digest", "rows", "block", "before")
        seats = sorted(set(zip(*(table.column(c).to_pylist() for c in names))))
        tree = PrefixTree([np.frombuffer(x[0], ">u8").astype(_U) for x in seats], percent)
        linked = np.zeros(len(seats), np.int64)
        if count:
            rows, block = np.array([x[3] for x in seats]), np.array([x[4] for x in seats])
            before = [np.frombuffer(x[5], np.int64).tolist() for x in seats]
            with_leader: dict[int, list[int]] = {}
            for k, leaders in enumerate(before):
                for x in leaders:
                    with_leader.setdefault(x, []).append(k)
            holders = {x: np.array(k) for x, k in with_leader.items() if len(k) > 1}
            low, high = key[1].as_py(), key[2].as_py()

            def met(k: int, others: np.ndarray) -> None:
                p, q = np.minimum(block[others], block[k]), np.maximum(block[others], block[k])
                elsewhere = np.zeros(len(seats), bool)
                for x in before[k]:
                    if x in holders:
                        elsewhere[holders[x]] = True
                here = others[(p == low) & (q == high) & ~elsewhere[others]]
                linked[here] += rows[k]
                linked[k] += rows[here].sum()

            found = tree.links(met)
        else:
            found = tree.links()
        some = np.flatnonzero(linked).tolist()
        a = [seats[x][1] for x, _ in found] + [None] * len(some)
        b = [seats[y][1] for _, y in found] + [None] * len(some)
        digests, counts = [None] * len(found) + [seats[k][2] for k in some], [None] * len(found) + linked[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "digest": pa.array(digests, pa.binary()), "links": pa.array(counts, pa.int64())})

    # ids that several rows share bring each of their texts
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text")
    # candidates grow with the input, so they are never broadcast: one plan at every size
    laid = texts.join(wanted.hint("merge"), "rep").select("rep", "text", "groups", "own").mapInArrow(lay_out, "leader long, i int, j int, block int, rep long, digest binary, rows long, before binary, keys binary")
    joined = scratch.table(laid.groupBy("leader", "i", "j").applyInArrow(join, "a long, b long, digest binary, links long"), "links")
    edges = joined.where("a IS NOT NULL").select("a", "b")
    same = useful.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    copies = same.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(copies))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    if not count:
        return out.select("doc_id", "n_shingles", "component_id")
    others = joined.where("digest IS NOT NULL").groupBy("digest").agg(F.sum("links").alias("links"))
    links = sized.drop("n").join(others, "digest", "left").select("digest", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    return out.join(links, "digest", "left").select("doc_id", "n_shingles", "component_id", n_links.alias("n_links"))


def drop_near_copies(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, but of each group of near copies only the smallest id's.

    Rows without an id, and with null, empty or blank texts, are in no group
    and stay, as do all rows that share a group's smallest id. Columns may
    have any names; an empty table stays empty.
    """
    groups = near_groups(df, n, percent, id_col, text_col, count=False)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
