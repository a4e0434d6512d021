"""N-gram Jaccard join of all documents, through a prefix tree of globally ordered n-gram sets.

A document's set holds the hashes of its distinct n-grams of words in ascending
order, the one global order. Equal sets are one node from the start.

The first levels of the tree are dealt over the cluster. The order is cut into
segments; a branch is one segment's n-grams, and two sets stand on the same branch if
they agree there. Sets whose sizes allow a link differ in at most d n-grams (d from
the remaining-length bound), hence in at most d segments; with more than d segments
every linked pair meets on a branch. Sizes are grouped so that partners are in one or
the next group, and a set is entered for both. Branches with a single set are dropped
where they are counted; unlike single frequent n-grams, a branch is seldom shared by
texts that merely quote the same passage.

The sets of each branch, named by its smallest set, are built into a path-compressed
trie, down to every place where two sets part. A set that traverses it counts what it
shares with an edge once for all sets below, and leaves a subtree when the shared
n-grams plus what can remain fall short of the least overlap, or when all its sets are
already in its component. First the
smallest set of each branch traverses the tries of the others, in chunks; that
connects most copies. Where a branch still holds several components, the sets outside
its largest one traverse all its chunks, so that no link between components is lost.

Edge cases: a null, empty or blank text has an empty set and is linked with nothing;
fewer words than n are one n-gram; documents without an id are measured, and linked
with nothing; rows with one id count as one document each, linked if their sets are;
an empty table gives no rows; extra columns are not read. Sets are named by 64 bits and
compared by 48 bits of each n-gram's hash: among a billion different sets the chance
that any two share a name is about one in forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, mix, spread, window_hashes, within
from .components import components
from .tables import materialize, partitions_for, text_size

_U = np.uint64
#: Sets of a branch that one trie holds.
CHUNK = 1024
#: Text bytes whose branches one reducing task gathers.
_BUCKET_BYTES = 16 << 20
#: N-grams of one edge of the trie; a longer run is a chain of edges, so that its bound is looked at on the way.
EDGE = 64


class Jaccard:
    """Links at p * union <= q * intersection: sizes, bounds and segments, all in whole numbers."""

    def __init__(self, p: int, q: int) -> None:
        self.p, self.q = p, q
        self.low = [1]

    def group(self, n: np.ndarray) -> np.ndarray:
        while self.low[-1] <= int(n.max(initial=0)):
            self.low.append(self.low[-1] * self.q // self.p + 1)
        return np.searchsorted(np.array(self.low), n, "right") - 1

    def bound(self, group: np.ndarray) -> np.ndarray:
        """The most n-grams in which linked sets differ if the smaller is of this group."""
        high = np.array(self.low)[group] * self.q // self.p
        return high * (self.q - self.p) // self.p

    @staticmethod
    def segments(d):
        """Segments for sets that differ in at most d n-grams: some more than d, so that a pair agrees in several."""
        return d + 2 + d // 10


def block_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-gram sets of a block's rows one after another, and their offsets."""
    _, _, words, first = block.words(lower=True)
    size = np.diff(first)
    spot = within(first, n) if len(words) else np.zeros(0, np.int64)
    grams = window_hashes(words, n)[spot] if len(spot) else np.zeros(0, _U)
    at = np.searchsorted(spot, first)
    sets = []
    for row in range(len(block)):
        own = grams[at[row] : at[row + 1]]
        if len(own):
            own = np.sort(own)
            own = own[np.r_[True, own[1:] != own[:-1]]]
        elif size[row]:
            run = words[first[row] : first[row + 1]]
            own = mix(window_hashes(run, len(run)) + _U(len(run)))
        sets.append(own)
    return np.concatenate([np.zeros(0, _U), *sets]), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_names(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, equal for equal sets."""
    size = np.diff(offsets).astype(_U)
    return mix(_sum_by(mix(grams + _U(1)), offsets) + size), mix(_sum_by(mix(grams ^ _U(0xC2B2AE3D27D4EB4F)), offsets) - size)


def branches(grams: np.ndarray, offsets: np.ndarray, rule: Jaccard) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the branches on which each set stands, and the set of each key."""
    n = np.diff(offsets)
    group = rule.group(n)
    keys, rows = [], []
    coded = mix(grams + _U(0x51ED270B))
    for step in (0, 1):
        # as the smaller or equal partner in its own group, then as the larger one of a pair from the group below
        level = group - step
        live = (n > 0) & (level >= 0)
        d = np.where(live, rule.bound(np.maximum(level, 0)), 0)
        m = np.where(d > 0, rule.segments(d), 1)
        row = np.repeat(np.arange(len(n)), n)
        segment = ((grams >> _U(32)) * m[row].astype(_U)) >> _U(32)
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
        begin = np.flatnonzero(fresh)
        total = _sum_by(coded, np.r_[begin, len(grams)])
        salt = mix(level[row[begin]].astype(_U) * _U(0x100000001B3) + segment[begin] + _U(7))
        ok = live[row[begin]]
        keys.append(mix(total + salt)[ok])
        rows.append(row[begin][ok])
        # sets with so many empty segments that a partner might agree with them only there stand on those, too
        empty = m - np.bincount(row[begin], minlength=len(n))
        for r in np.flatnonzero(live & (empty >= m - d) & (d > 0)):
            have = np.zeros(m[r], bool)
            have[segment[offsets[r] : offsets[r + 1]].astype(np.int64)] = True
            gaps = np.flatnonzero(~have).astype(_U)
            keys.append(mix(mix(_U(level[r]) * _U(0x100000001B3) + gaps + _U(7)) + _U(0)))
            rows.append(np.full(len(gaps), r))
    return np.concatenate(keys), np.concatenate(rows)


class Trie:
    """Path-compressed trie of distinct ordered sets, level by level in flat arrays.

    A node has the n-grams that all sets below it share in a row, the depth at which
    they end, the shortest and longest set below, and its children, which lie side by
    side; the sets below it are a range of the sorted sets.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = np.array(sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes()), np.int64)
        ranked = [sets[k] for k in self.order]
        shared = np.zeros(len(ranked), np.int64)
        for i in range(1, len(ranked)):
            a, b = ranked[i - 1], ranked[i]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            shared[i] = at if n and differ[at] else n
        sizes = np.array([len(s) for s in ranked], np.int64)
        grams, nodes, level = [], [], [(0, len(ranked), 0, -1)]
        self.children: list[tuple[int, int]] = []
        while level:
            below = []
            for low, high, at, parent in level:
                cuts = [low, *(np.flatnonzero(shared[low + 1 : high] <= at) + low + 1).tolist(), high]
                if parent >= 0:
                    self.children[parent] = (len(nodes), len(nodes) + len(cuts) - 1)
                else:
                    self.roots = (0, len(cuts) - 1)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    whole = int(sizes[a]) if b - a == 1 else int(shared[a + 1 : b].min())
                    end = min(whole, at + EDGE)
                    grams.append(ranked[a][at:end])
                    leaf = b - a == 1 and end == whole
                    if not leaf:
                        below.append((a, b, end, len(nodes)))
                    nodes.append((a, b, end, int(sizes[a:b].min()), int(sizes[a:b].max()), leaf))
                    self.children.append((0, 0))
            level = below
        self.low, self.high, self.depth, self.shortest, self.longest, leaves = np.array(nodes, np.int64).reshape(-1, 6).T
        self.leaf = leaves > 0
        self.at = np.r_[0, np.cumsum([len(g) for g in grams])].astype(np.int64)
        self.grams = np.concatenate([np.zeros(0, _U), *grams])
        # n-grams by number, so that a probe looks them up in a table of its own
        known, number = np.unique(np.concatenate([np.zeros(0, _U), *sets]), return_inverse=True)
        self.own = np.split(number, np.cumsum([len(s) for s in sets])[:-1])
        self.number, self.mark = np.searchsorted(known, self.grams), np.zeros(len(known), bool)
        self.kids = np.array(self.children, np.int64).reshape(-1, 2)

    def similar(self, probe: np.ndarray, x: int, component: np.ndarray, rule: Jaccard) -> np.ndarray:
        """Sets linked with the probe, which is set x, and of another component than its own.

        A level of the trie at a time: what is left of the level before is counted,
        bounded and led on to its children together.
        """
        open_ = np.r_[0, np.cumsum((component != component[x])[self.order])]
        self.mark[self.own[x]] = True
        live, shared = np.arange(*self.roots), np.zeros(self.roots[1] - self.roots[0], np.int64)
        found = [np.zeros(0, np.int64)]
        while len(live):
            some = open_[self.high[live]] > open_[self.low[live]]
            live, shared = live[some], shared[some]
            need = -(-rule.p * (len(probe) + self.shortest[live]) // (rule.p + rule.q))
            fits = need <= np.minimum(len(probe), self.longest[live])
            live, shared, need = live[fits], shared[fits], need[fits]
            if not len(live):
                break
            count = self.at[live + 1] - self.at[live]
            hit = np.r_[0, np.cumsum(self.mark[self.number[spread(self.at[live], count)]])]
            stop = np.cumsum(count)
            shared = shared + hit[stop] - hit[stop - count]
            last = np.where(count > 0, np.searchsorted(probe, self.grams[self.at[live + 1] - 1], "right"), 0)
            rest = np.minimum(len(probe) - last, self.longest[live] - self.depth[live])
            ok = shared + rest >= need
            live, shared = live[ok], shared[ok]
            leaf = self.leaf[live]
            n = self.shortest[live[leaf]]
            linked = rule.q * shared[leaf] >= rule.p * (len(probe) + n - shared[leaf])
            found.append(self.order[self.low[live[leaf]][linked]])
            kids = self.kids[live[~leaf]]
            many = kids[:, 1] - kids[:, 0]
            shared = np.repeat(shared[~leaf], many)
            live = spread(kids[:, 0], many)
        self.mark[self.own[x]] = False
        return np.concatenate(found)


def trie_links(sets: list[np.ndarray], rule: Jaccard, labels: list[int], probes: list[int]) -> list[tuple[int, int]]:
    """Links from the probing sets to others, enough to connect what their links connect; sets with one label are connected."""
    trie, links = Trie(sets), []
    _, component = np.unique(np.array(labels, np.int64), return_inverse=True)
    for x in probes:
        for y in trie.similar(sets[x], x, component, rule).tolist():
            if component[y] != component[x]:
                links.append((x, y))
                component[component == component[y]] = component[x]
    return links


def measured(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, and the two names of each document's set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, offsets = block_sets(block, n)
                a, b = set_names(grams, offsets)
                size = np.diff(offsets)
                void = size == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(size, pa.int64()), pa.array(a.view(np.int64), mask=void), pa.array(b.view(np.int64), mask=void)], names=["doc_id", "n_shingles", "set_a", "set_b"])

    return _plain(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def _entered(docs: DataFrame, n: int, rule: Jaccard, buckets: int) -> DataFrame:
    """bucket, packed keys, and the sets' names with their numbers of keys: every set on all its branches, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, name = np.concatenate(keys), np.concatenate(names)
            bucket = (key % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, begin = np.unique(bucket[order], return_index=True)
            rest = ((key[order] // _U(buckets)) & _U((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            # a set's name stands once for all its keys in a bucket
            bucket, name = bucket[order], name[order]
            fresh = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])])
            count = np.diff(np.r_[fresh, len(order)]).astype("<u4")
            ends = [*begin[1:].tolist(), len(order)]
            spans = np.searchsorted(fresh, [*begin.tolist(), len(order)]).tolist()
            runs = list(zip(spans[:-1], spans[1:], strict=True))
            own = name[fresh].astype("<u8")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([rest[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)], pa.binary()),
                    pa.array([own[a:b].tobytes() for a, b in runs], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in runs], pa.binary()),
                ],
                names=["bucket", "branches", "names", "counts"],
            )

        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, offsets = block_sets(block, n)
                name = set_names(grams, offsets)[0]
                fresh = np.zeros(len(name), bool)
                for r, x in enumerate(name.tolist()):
                    if x not in seen and offsets[r + 1] > offsets[r]:
                        seen.add(x)
                        fresh[r] = True
                key, row = branches(grams, offsets, rule)
                take = fresh[row]
                keys.append(key[take])
                names.append(name[row[take]])
                held += int(take.sum())
                if held > 1_500_000:
                    yield flush()
                    keys, names, held = [], [], 0
        if held:
            yield flush()

    return _plain(docs).where("doc_id is not null").mapInArrow(run, "bucket int, branches binary, names binary, counts binary")


def candidates(docs: DataFrame, n: int, rule: Jaccard) -> DataFrame:
    """leader and member: sets on a common branch, by the branch's smallest set."""
    buckets = partitions_for(docs.sparkSession, text_size(docs, "text"), _BUCKET_BYTES)

    def meet(table: pa.Table) -> pa.Table:
        joined = {c: b"".join(table.column(c).to_pylist()) for c in ("branches", "names", "counts")}
        raw = np.frombuffer(joined["branches"], np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        key = key.view("<u8").ravel()
        name = np.repeat(np.frombuffer(joined["names"], "<u8"), np.frombuffer(joined["counts"], "<u4"))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        key, name = key[shared], name[order][shared]
        if not len(key):
            return pa.table({"leader": pa.array([], pa.int64()), "member": pa.array([], pa.int64())})
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        leader = np.repeat(np.minimum.reduceat(name, begin), np.diff(np.r_[begin, len(key)]))
        pairs = np.unique(np.stack([leader, name], 1)[leader != name], axis=0)
        return pa.table({"leader": pairs[:, 0].astype("<u8").view(np.int64), "member": pairs[:, 1].astype("<u8").view(np.int64)})

    return _entered(docs, n, rule, buckets).groupBy("bucket").applyInArrow(meet, "leader long, member long").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """name and packed 48-bit n-grams of the wanted (name, doc_id) sets."""
    own = _plain(docs).join(wanted, "doc_id").select("doc_id", "text", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, offsets = block_sets(block, n)
                names = set_names(grams, offsets)[0].view(np.int64)
                asked = batch.column(2).slice(block.first, len(block)).to_numpy()
                short = np.ascontiguousarray((grams >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                hit = np.flatnonzero(names == asked)
                yield pa.RecordBatch.from_arrays([pa.array(asked[hit], pa.int64()), pa.array([short[offsets[r] : offsets[r + 1]].tobytes() for r in hit], pa.binary())], names=["name", "grams"])

    return own.mapInArrow(run, "name long, grams binary").dropDuplicates(["name"])


def _verified(blocks_of: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """Links (a, b) from the probing sets of each block, given as rows (block, name, label, probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, labels, probes, grams = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            apart = []
            for raw in grams:
                wide = np.zeros((len(raw) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                apart.append(wide.view("<u8").ravel())
            found = trie_links(apart, rule, labels, probes)
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for b, name, label, probe, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if b != block:
                    if len(names) > 1 and probes:
                        yield flush()
                    block, names, labels, probes, grams = b, [], [], [], []
                if probe:
                    probes.append(len(names))
                names.append(name)
                labels.append(label)
                grams.append(raw)
        if len(names) > 1 and probes:
            yield flush()

    rows = blocks_of.join(sets, "name").select("block", "name", "label", "probe", "grams")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def set_components(docs: DataFrame, sizes: DataFrame, n: int, rule: Jaccard) -> DataFrame:
    """name and component of every set that is linked with a different one."""
    pairs = materialize(candidates(docs, n, rule))
    # written first, so that its join to a hot branch's sets can be split
    count = materialize(pairs.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")))
    members = pairs.select("leader", F.col("member").alias("name")).join(count, "leader").withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")))
    # each chunk of a branch has its smallest set with it
    led = count.select("leader", F.col("leader").alias("name"), "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = materialize(members.unionByName(led))
    sets = materialize(_sets_of(docs, dealt.select("name").distinct().join(sizes, "name"), n))
    block = F.xxhash64("leader", "chunk").alias("block")
    links = materialize(_verified(dealt.select(block, "name", F.col("name").alias("label"), (F.col("name") == F.col("leader")).alias("probe")), sets, rule))
    label = components(links)
    # where a branch holds several components, what is outside its largest one meets all its sets
    named = dealt.join(label.withColumnRenamed("node", "name"), "name", "left").select("leader", "name", "chunks", "chunk", F.coalesce("component", "name").alias("label"))
    named = materialize(named)
    sums = named.dropDuplicates(["leader", "name"]).groupBy("leader", "label").agg(F.count("*").alias("n"))
    mixed = materialize(sums.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("kinds"), F.sum("n").alias("all")).where("kinds > 1 and `all` > 2").select("leader", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK).alias("parts")))
    rows = materialize(named.join(mixed, "leader"))
    if rows.isEmpty():
        return label
    cell = F.xxhash64("leader", "chunk", "part").alias("block")
    targets = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    probing = rows.where("label <> main").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "name"), F.col("parts"))).drop("chunk").dropDuplicates(["leader", "name"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    both = targets.select(cell, "name", "label", F.lit(False).alias("probe")).unionByName(probing.select(cell, "name", "label", F.lit(True).alias("probe")))
    more = materialize(_verified(both.groupBy("block", "name").agg(F.any_value("label").alias("label"), F.max("probe").alias("probe")), sets, rule))
    return label if more.isEmpty() else components(links.unionByName(more))


def groups(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents with the same set), for every row of docs.

    Two documents link when q * intersection >= p * union of their n-gram sets;
    component_id is the smallest doc_id that links reach.
    """
    rule = Jaccard(p, q)
    own = materialize(measured(docs, n))
    heads = own.where("set_a is not null and doc_id is not null").groupBy(F.col("set_a").alias("name")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))
    heads = materialize(heads)
    named = set_components(docs, heads.select("name", "doc_id"), n, rule).withColumnRenamed("node", "name")
    ends = heads.join(named, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = ends.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    mapped = ends.join(least, "component").select(F.col("name").alias("set_a"), "component_id", "n_copies")
    return own.join(mapped, "set_a", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
