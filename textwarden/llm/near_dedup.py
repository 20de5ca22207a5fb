"""Near-duplicate groups of documents by HyperMinHash sketches and an exact check of every link.

A document's set holds its distinct 5-word shingles as 64-bit hashes. The top seven bits of a hash name one of 128
buckets; a bucket's register keeps the least remainder of its hashes as a leading-zero count and mantissa bits, 16 bits
in all. Equal sets are one class, a node named by the class's digest, so copies are never expanded into pairs and
identifiers need not be unique.

1. Bands. Four compressed registers make a band key; bands without any shingle are left out. Nodes that share a key with
   more than SMALL are dealt again by the pair of the band and each of the next STEPS bands, which parts those that
   share a passage from near copies.
2. Clusters. What stands under a key that is large even then forms clusters (connected by their keys). A cluster is cut
   into blocks of bounded size at random; members are compared with their block and with PIVOTS of the cluster, which
   links nearly all that can be linked. Members outside the cluster's largest component then look for partners by rare
   shingles: in any common order of shingles, the first one that two sets share stands early enough in both to leave room
   for the overlap that their sizes ask for. Ordered by their number among the pivots, what a whole cluster shares comes
   last, so documents that only share a passage don't meet. No link is lost, and sets are sent once.
3. Pairs. Small keys give all their pairs of fitting sizes, but those within one cluster, and rare shingles give
   theirs. The compressed registers
   give a Jaccard estimate corrected for accidental collisions; pairs far below the threshold (by ESTIMATE_SIGMAS
   standard errors) go.
4. Verification on the full sets: first the best partner of every node, then the pairs whose ends are still in
   different components. Pairs within one component can't change the result.

Cases: null and blank texts have an empty set and are linked with nothing; texts with fewer than five words have their
whole word sequence as their only shingle; null identifiers have the component of their text's class and aren't kept
(its smallest identifier; null if there is none); repeated identifiers are rows of their own, with equal or different
texts; an empty table gives an empty result. survivors() keeps one row of each group and every row without words, also
where identifiers are null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import attach, released, written
from textwarden.llm.graph import components

WORDS, BUCKET_BITS, BAND = 5, 7, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
MANTISSA = 10
EMPTY = 0xFFFF
#: Two different minima agree in lz and ten mantissa bits with a probability of about (1/3) / 2**10.
COLLISION = 1 / 3 / 1024
ESTIMATE_SIGMAS = 5.0
SMALL, STEPS = 16, 6
#: Bounds of a block: documents and shingles; and the members of a cluster that all others are compared with at first.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 256, 60_000, 32
#: Bytes of sets that a bucket of pairs should hold while they are verified.
VERIFY_BYTES = 8 << 20
#: Identifiers that a broadcast filter may hold (8 bytes each); more are joined in a shuffle.
BROADCAST_IDS = 2_000_000
CACHE = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(width, len(words)), np.uint64)
        for k in range(min(width, len(words))):
            out = out * _PRIME + h[k : k + n]
        return np.unique(_mix(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 compressed registers of 16 bits from a sorted set: leading zeros of the least remainder, then its mantissa."""
    out = np.full(BUCKETS, EMPTY, "<u2")
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rest = (hashes[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64) + 1.0
        part, power = np.frexp(rest)
        zeros = np.clip(64 - BUCKET_BITS + 1 - power, 0, 62).astype(np.uint16)
        out[bucket[first]] = (zeros << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of compressed registers; 0 for bands without any shingle, others odd."""
    empty = (regs.reshape(BANDS, BAND) == EMPTY).all(axis=1).tolist()
    raw, size = regs.tobytes(), 2 * BAND
    keys = [xxhash.xxh3_64_intdigest(raw[size * k : size * k + size], k) | 1 if not empty[k] else 0 for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of paired rows of compressed registers, and how many buckets each used."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    raw = equal / np.maximum(used, 1)
    return np.clip((raw - COLLISION) / (1 - COLLISION), 0, 1), used


PROFILE_SQL = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary"
KEYS = ["n_shingles", "d1", "d2"]


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@released
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(text)
            rows.append((doc_id, len(s), *_digest(s), registers(s).tobytes()))
        if rows:
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", *KEYS, "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = [band_keys(np.frombuffer(x, "<u2")) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands, pa.list_(pa.int64()))], names=["node", "n_shingles", "least", "sketch", "bands"])


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            found = [shingle_set(t) for t in batch.column(0).slice(start, 256).to_pylist()]
            digests = zip(*map(_digest, found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in found], pa.int64()), *(pa.array(d, pa.int64()) for d in digests), pa.array([x.tobytes() for x in found], pa.binary())], names=[*KEYS, "shingles"])


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BUCKETS) for i in (2, 3))
            est, used = estimates(a, b)
            t = percent / 100
            keep = est >= t - ESTIMATE_SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            kept = batch.select([0, 1]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(est[keep])], names=["a", "b", "estimate"])

    return run


def _verified(percent: int):
    """The pairs of a bucket that are links; the sets of its nodes come once each."""

    def run(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
        column = nodes.column("shingles")
        sets = {node: np.frombuffer(column[i].as_buffer(), np.uint64) for i, node in enumerate(nodes.column("node").to_pylist())}
        keep = []
        for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            s, t = sets[x], sets[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= percent * (len(s) + len(t) - both))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): sizes of the intersections of the sets at these places."""
    size = np.array([len(x) for x in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.zeros((len(left), len(right)), np.float32)
    rows, columns = np.full(len(sets), -1), np.full(len(sets), -1)
    rows[left], columns[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):  # shingles in stripes, so that the matrices stay small
        at = slice(np.searchsorted(code, first), np.searchsorted(code, first + 8192))
        c, o = code[at] - first, owner[at]
        x, y = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
        in_left, in_right = rows[o] >= 0, columns[o] >= 0
        x[rows[o[in_left]], c[in_left]] = 1
        y[columns[o[in_right]], c[in_right]] = 1
        shared += x @ y.T
    return shared.astype(np.int64)


def _members(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes, sets and which of them are pivots; a pivot that stands in its own block counts once."""
    ids = table.column("node").to_numpy()
    pivots = set(ids[table.column("pivot").to_numpy(zero_copy_only=False)].tolist())
    ids, once = np.unique(ids, return_index=True)
    column = table.column("shingles")
    return ids, [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in once], np.array([i in pivots for i in ids.tolist()], bool)


def _cells(percent: int):
    """The links of a block's members and the cluster's pivots as a spanning forest."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, sets, _ = _members(table)
        size, every = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
        both = _shared(sets, every, every)
        link = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1)
        root = {i: i for i in ids.tolist()}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in np.argwhere(link):
            u, v = int(ids[i]), int(ids[j])
            ru, rv = find(u), find(v)
            if ru != rv:
                root[max(ru, rv)] = min(ru, rv)
                out.append((min(u, v), max(u, v)))
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=names)

    return run


def _rare(percent: int):
    """The first shingles of a block's members, by their number among the cluster's pivots, then by their hash.

    A partner that is no larger shares at least 2 * percent / (100 + percent) of its own size, one that is no smaller at
    least percent / 100; early marks the places up to the first bound, rows end at the second.
    """
    names = pa.schema([("cluster", pa.int64()), ("node", pa.int64()), ("shingle", pa.int64()), ("place", pa.int32()), ("early", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        own = set(table.filter(pc.invert(table.column("pivot"))).column("node").to_pylist())
        ids, sets, pivots = _members(table)
        known, number = np.unique(np.concatenate([x for x, p in zip(sets, pivots, strict=True) if p]), return_counts=True)
        nodes, shingles, places, early = [], [], [], []
        for i, x in zip(ids.tolist(), sets, strict=True):
            if i in own:
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                often = np.where(known[at] == x, number[at], 0)
                last = len(x) - -(-percent * len(x) // 100) + 1
                nodes.append(np.full(last, i, np.int64))
                shingles.append(x[np.lexsort((x, often))[:last]])
                places.append(np.arange(last))
                early.append(places[-1] <= len(x) - -(-2 * percent * len(x) // (100 + percent)))
        columns = [np.concatenate(c) for c in (nodes, shingles, places, early)]
        kinds = names.types
        cluster = np.full(len(columns[0]), table.column("cluster")[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((cluster, columns[0], columns[1].view(np.int64), *columns[2:]), kinds, strict=True)], schema=names)

    return run


class _Linker:
    """Verified links between nodes and their components."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int, name):
        self.docs, self.reps, self.percent, self.name = docs, reps, percent, name
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def with_comps(self, rows: DataFrame, node: str, out: str) -> DataFrame:
        if self.comps is None:
            return rows.withColumn(out, F.col(node))
        found = rows.join(self.comps.select(F.col("node").alias(node), F.col("comp").alias(out)), node, "left")
        return found.withColumn(out, F.coalesce(out, node))

    def add(self, links: DataFrame) -> None:
        """links (a, b), written."""
        if not links.isEmpty():
            found = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
            self.links = found if self.links is None else self.links.unionByName(found)
            self.comps = written(components(self.links), "components")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes (node, distinct), from the texts of rows with the least identifier of each."""
        wanted = written(nodes.join(self.reps.select("node", "least"), "node"), "wanted")
        few = wanted.count() <= BROADCAST_IDS
        ids = wanted.select(F.col("least").alias("_id")).distinct()
        texts = self.docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        found = texts.mapInArrow(_sets, "n_shingles long, d1 long, d2 long, shingles binary").select(self.name().alias("node"), "shingles")
        # Other texts under the same identifier go; equal ones count once.
        keys = wanted.select("node")
        return written(found.join(F.broadcast(keys) if few else keys, "node", "left_semi"), "sets").dropDuplicates(["node"])

    def compare_clusters(self, members: DataFrame) -> DataFrame | None:
        """members (node, cluster): links what their blocks and pivots show; returns the pairs (a, b) that are left to test."""
        sized = members.join(self.reps.select("node", "n_shingles"), "node")
        size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        need = written(sized.groupBy("cluster").agg(size.alias("blocks"), F.count(F.lit(1)).alias("members")), "cluster-sizes")
        total, dice = members.count(), F.xxhash64("node")
        placed = attach(sized, need, ["cluster"], "members", total)
        placed = written(placed.select("node", "n_shingles", "cluster", "blocks", F.pmod(dice, F.col("blocks")).cast("int").alias("block")), "cluster-blocks")
        sets = written(self.sets_of(placed.select("node").distinct()), "cluster-sets")
        pivots = placed.groupBy("cluster", "blocks", F.pmod(dice, F.lit(PIVOTS)).alias("turn")).agg(F.min_by("node", dice).alias("node"))
        pivots = pivots.select("node", "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        rows = placed.select("node", "cluster", "block").withColumn("pivot", F.lit(False)).unionByName(pivots.withColumn("pivot", F.lit(True)))
        rows = written(rows, "cluster-rows")
        cells = lambda some: some.join(sets, "node").groupBy("cluster", "block")
        self.add(written(cells(rows).applyInArrow(_cells(self.percent), "a long, b long"), "links"))

        told = written(self.with_comps(placed.select("node", "n_shingles", "cluster"), "node", "comp"), "cluster-components")
        sizes = told.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = written(sizes.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("comps")).where("comps > 1"), "cluster-main")
        if main.isEmpty():
            return None
        told = attach(told, main, ["cluster"], "members", total).where("main IS NOT NULL").select("node", "n_shingles", "comp", (F.col("comp") == F.col("main")).alias("in_main"))
        rare = cells(rows.join(main.select("cluster"), "cluster", "left_semi")).applyInArrow(_rare(self.percent), "cluster long, node long, shingle long, place int, early boolean")
        rare = rare.join(told, "node")
        shared = rare.groupBy("cluster", "shingle").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.max("early").alias("met")).where("one <> other AND met")
        rare = written(rare.join(shared.select("cluster", "shingle"), ["cluster", "shingle"], "left_semi"), "rare")
        # x is the larger one; least is the overlap that both sizes ask for.
        least = f"ceil({self.percent} * (x.n_shingles + y.n_shingles) / {100 + self.percent})"
        fits = f"(x.n_shingles > y.n_shingles OR (x.n_shingles = y.n_shingles AND x.node > y.node)) AND x.place <= x.n_shingles - {least} AND y.place <= y.n_shingles - {least}"
        found = rare.alias("x").join(rare.where("early").alias("y"), F.expr(f"x.cluster = y.cluster AND x.shingle = y.shingle AND x.comp <> y.comp AND NOT (x.in_main AND y.in_main) AND {fits}"))
        return found.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b"))

    def test(self, pairs: DataFrame) -> None:
        """pairs (a, b) of nodes of fitting sizes."""
        side = lambda x: self.reps.select(F.col("node").alias(x), F.col("sketch").alias(f"s_{x}"))
        sketched = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
        likely = written(sketched.mapInArrow(_estimated(self.percent), "a long, b long, estimate double"), "likely")
        if likely.isEmpty():
            return
        ids = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        sets = written(self.sets_of(written(ids, "likely-nodes")), "likely-sets")
        best = written(likely.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")).select("a", "b"), "best")
        self.add(self._verified(best, sets))
        rest = likely.select("a", "b").join(best, ["a", "b"], "left_anti")
        apart = self.with_comps(self.with_comps(rest, "a", "_ca"), "b", "_cb").where("_ca <> _cb").select("a", "b")
        self.add(self._verified(written(apart, "apart"), sets))

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links among pairs (written). Pairs are dealt into buckets of about VERIFY_BYTES of sets by a hash of both
        ends, and each bucket gets the set of a node once, however many of its pairs name it."""
        mean = sets.agg(F.avg(F.octet_length("shingles"))).first()[0] or 0
        buckets = max(1, int(2 * pairs.count() * mean // VERIFY_BYTES))
        placed = pairs.withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))
        ends = placed.select("bucket", F.col("a").alias("node")).unionByName(placed.select("bucket", F.col("b").alias("node"))).distinct()
        nodes = ends.join(sets, "node").select(F.col("bucket").alias("of"), "node", "shingles")
        return written(placed.groupBy("bucket").cogroup(nodes.groupBy("of")).applyInArrow(_verified(self.percent), "a long, b long"), "links")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with a column key: those of keys of two or more, with n and the smallest member as pivot."""
    total = rows.count()
    full = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1"), "keys")
    return written(attach(rows, full, ["key"], "n", total).where("n IS NOT NULL"), "keyed")


def _named(classes: DataFrame):
    """The node of a class: half of its digest, or a mix of both halves where two classes share that half."""
    shared = [r.d1 for r in classes.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1").collect()]
    return lambda: F.when(F.col("d1").isin(shared), F.xxhash64("d1", "d2", "n_shingles")).otherwise(F.col("d1")) if shared else F.col("d1")


def _groups(docs: DataFrame, percent: int) -> DataFrame:
    """docs (doc_id, text) to a row for each: doc_id, n_shingles, d1, d2, comp (a node, null without words), component_id."""
    profile = written(docs.mapInArrow(_profile, PROFILE_SQL), "profiles")
    classes = written(profile.groupBy(*KEYS).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")), "classes")
    name = _named(classes)
    filled = classes.where("n_shingles > 0").select(name().alias("node"), "n_shingles", "least", "sketch")
    reps = written(filled.mapInArrow(_bands, "node long, n_shingles long, least long, sketch binary, bands array<long>"), "reps")
    linker = _Linker(docs, reps, percent, name)

    one = _keyed(reps.select("node", "n_shingles", F.posexplode("bands").alias("at", "key")).where("key <> 0"))
    hot = one.where(F.col("n") > SMALL).groupBy("node").agg(F.collect_list("at").alias("hot"))
    step = f"flatten(transform(hot, at -> transform(sequence(1, {STEPS}), i -> xxhash64(at, bands[at], (at + i) % {BANDS}, bands[(at + i) % {BANDS}]))))"
    two = _keyed(hot.join(reps.select("node", "n_shingles", "bands"), "node").select("node", "n_shingles", F.explode(F.expr(step)).alias("key")))
    stars = two.where((F.col("n") > SMALL) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("node").alias("v"))
    clusters = written(components(stars).select("node", F.col("comp").alias("cluster")), "clusters")
    far = None if clusters.isEmpty() else linker.compare_clusters(clusters)

    small = one.where(F.col("n") <= SMALL).select("key", "node", "n_shingles").unionByName(two.where(F.col("n") <= SMALL).select("key", "node", "n_shingles"))
    marked = small.join(clusters, "node", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n_shingles", "cluster"))).alias("m"))
    fits = f"least(x.n_shingles, y.n_shingles) * 100 >= greatest(x.n_shingles, y.n_shingles) * {percent} AND NOT coalesce(x.cluster = y.cluster, false)"
    pairs = marked.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {fits}), y -> struct(x.node AS a, y.node AS b))))")).alias("p")).select("p.*")
    linker.test(pairs if far is None else pairs.unionByName(far))

    owned = linker.with_comps(classes.where("n_shingles > 0").select(*KEYS, name().alias("node"), "least", "copies"), "node", "comp")
    least = owned.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(owned.join(least, "comp").select(*KEYS, "comp", "component_id", "copies"), "named")
    found = attach(profile.where("n_shingles > 0").select("doc_id", *KEYS), named, KEYS, "copies", profile.count()).drop("copies")
    alone = profile.where("n_shingles = 0").select("doc_id", *KEYS, F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return found.select(alone.columns).unionByName(alone)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Links have 100 * intersection >= percent * union."""
    found = _groups(_plain(docs, id_col, text_col), percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def survivors(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one per group and all without words, with all columns of docs."""
    plain = _plain(docs, id_col, text_col)
    groups = written(_groups(plain, percent), "groups")
    first = groups.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")).alias("w"))
    kept = written(first.select("w.doc_id", "w.d1", "w.d2"), "kept")
    stay = kept.select("doc_id").unionByName(groups.where("comp IS NULL").select("doc_id")).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_near_id"))
    repeated = written(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_near_id")), "repeated")
    key = F.col(id_col).cast("long")
    if repeated.isEmpty():
        return docs.join(stay, key == F.col("_near_id"), "left_semi")
    # Identifiers that don't name one row: the row is chosen by its text as well.
    plainly = docs.join(repeated, key.eqNullSafe(F.col("_near_id")), "left_anti").join(stay, key == F.col("_near_id"), "left_semi")
    unclear = docs.join(repeated, key.eqNullSafe(F.col("_near_id")), "left_semi")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    told = _plain(unclear, id_col, text_col).where("text IS NOT NULL").distinct().mapInArrow(_told, "doc_id long, sha string, n_shingles long, d1 long, d2 long")
    wins = told.alias("t").join(kept.alias("k"), F.expr("t.doc_id <=> k.doc_id AND t.d1 = k.d1 AND t.d2 = k.d2"), "left_semi").where("n_shingles > 0")
    wins = wins.groupBy("doc_id", "d1", "d2").agg(F.min("sha").alias("sha"))
    wins = written(wins.select(F.col("doc_id").alias("_near_id"), F.col("sha").alias("_near_sha")), "winners")
    chosen = unclear.join(wins, key.eqNullSafe(F.col("_near_id")) & (sha == F.col("_near_sha")), "left_semi")
    chosen = chosen.withColumn("_near_sha", sha).dropDuplicates([id_col, "_near_sha"]).drop("_near_sha")
    wordless = unclear.where(F.coalesce(F.col(text_col), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))
    return plainly.unionByName(chosen).unionByName(wordless)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(text)
            rows.append((doc_id, hashlib.sha256(text.encode()).hexdigest(), len(s), *_digest(s)))
        if rows:
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "sha", *KEYS])
