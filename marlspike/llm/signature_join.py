"""Set-similarity join by signature trees (operator 2).

Texts become sets of word shingles; two link when 100 * |A n B| >= t * |A u B|.

1. Equal sets are one class, so copies cost nothing afterwards.
2. Classes that can link at all are brought together. A pair that links
   differs in at most k tokens, k following from t and the sizes. Tokens are
   dealt into m > k parts by hash, so a linking pair agrees in some whole part:
   the part's hash is a key that both emit. (m leaves room for parts that are
   empty by chance; only a class with many empty parts emits those.) Within the
   group of classes that share a key, a signature tree over bitmaps and sizes
   keeps the pairs that can link; classes connected by such pairs, directly or
   through others, form a cluster. Nothing is lost.
3. Each cluster is joined with itself by signature trees. A leaf holds a few
   sets; every node holds the OR and the AND of its sets' token bitmaps and
   their range of sizes. A dual traversal drops node pairs whose largest
   possible overlap (or size ratio) is too small, and counts exact overlaps of
   what is left. Large clusters are cut into blocks and joined by block pairs,
   so that no task holds more than two blocks.

Only classes of clusters with two members or more have their sets built a
second time; sets are never stored for the whole corpus.

Sets are named by 64 bits, as are shingles; sets of the same name count as
equal. Documents are found again by a handle of 128 bits.

Defined cases: null, empty or blank texts have an empty set and link with
nothing; a text with fewer words than a shingle has one shingle, its whole
sequence; a text of any length is one set; a null doc_id takes part and is
ignored when the smallest is sought; a pair that ties with the threshold links;
repeated rows are copies; an empty table gives an empty result. Only the named
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, handle, many_to_one, materialize, partitions, small_batches
from .textnum import U, Words, mix, pieces, splitmix

BITS = 512
LEAF, FAN = 32, 8
#: A cluster beyond either is cut into blocks.
BLOCK_SETS, BLOCK_TOKENS = 4096, 3_000_000
#: Above this many distinct shared tokens, sets of a cluster are compared pair by pair.
DENSE_COLUMNS = 16_384
#: A list of documents up to this length (some 60 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Partitions that part keys are dealt to at most.
MOST_TASKS = 20_000


def size_classes(t: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest size, parts, empty parts allowed) of each size class, for threshold ``t`` percent."""
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, low[-1] * 3 // 2))
    low = np.array(low)
    k = 2 * (low[1:] - 1) * (100 - t) // (100 + t)
    slack = np.where(k > 0, 2 + k // 12, 0)
    return low[:-1], k + 1 + slack, slack


def _signature(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; ``bounds`` are the sets' limits in ``g``."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(g) + 1, U)
        np.cumsum(mix(g + U(0x51ED2701)), dtype=U, out=total[1:])
        return mix((total[bounds[1:]] - total[bounds[:-1]]) ^ (np.diff(bounds).astype(U) * U(0x9E3779B97F4A7C15)))


def part_keys(g: np.ndarray, bounds: np.ndarray, t: int, classes) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number): the part keys of each set, in its own size class and, if it may have larger partners, the next."""
    low, parts, slack = classes
    size = np.diff(bounds)
    which = np.flatnonzero(size)
    own = np.searchsorted(low, size[which], "right") - 1
    up = which[100 * size[which] // t >= low[own + 1]]
    sets = np.concatenate([which, up])
    cls = np.concatenate([own, np.searchsorted(low, size[up], "right")])
    m = parts[cls]
    base = np.concatenate([[0], np.cumsum(m)])
    n = size[sets]
    row = np.repeat(np.arange(len(sets)), n)
    place = np.repeat(bounds[sets] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    token = mix(g[place] ^ U(0xA5A5A5A5))
    slot = base[row] + ((token >> U(20)) % m[row].astype(U)).astype(np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(base[-1], U)
        np.add.at(total, slot, mix(token + U(77)))
        full = np.bincount(slot, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        part = np.arange(base[-1]) - base[owner]
        empties = m - np.add.reduceat(full, base[:-1]) if len(sets) else m
        use = full | (empties > slack[cls])[owner]
        key = mix(total ^ mix((cls[owner].astype(U) << U(40)) + part.astype(U) + U(5)))
    return key[use], sets[owner[use]]


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    g, doc = w.shingles(w.hashes(), k)
    return g, np.searchsorted(doc, np.arange(w.n + 1))


def signatures(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, _at (a handle), n, vid (its set's name, null if empty), bits (its token bitmap)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), handle(doc_id, text).alias("_at"), F.col(text).alias("text"))

    def run(batches):
        for b in pieces(batches):
            g, bounds = _sets(b.column(2), k)
            n = np.diff(bounds)
            bits = pa.array([_bitmap(g[x:y]) if y > x else None for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(_signature(g, bounds).view(np.int64), mask=n == 0), bits], names=["doc_id", "_at", "n", "vid", "bits"])

    return rows.mapInArrow(run, "doc_id long, _at struct<a:long,b:long>, n long, vid long, bits binary")


def _bitmap(tokens: np.ndarray) -> bytes:
    """One bit or more a token: 256 to 65,536 bits, the next power of two from the set's size on."""
    width = min(max(256, 1 << (len(tokens) - 1).bit_length()), 1 << 16)
    bits = np.zeros(width, bool)
    bits[(tokens >> U(13)).astype(np.int64) % width] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: bytes, size: int) -> bytes:
    """The bitmap at a smaller width: its halves put over one another."""
    while len(bits) > size:
        h = len(bits) // 2
        bits = (int.from_bytes(bits[:h], "little") | int.from_bytes(bits[h:], "little")).to_bytes(h, "little")
    return bits


def pruned_pairs(size: list[int], bits: list[bytes], side: list[int] | None, t: int) -> list[tuple[int, int]]:
    """A spanning forest of the members whose sizes and bitmaps allow a link (with ``side``: only between 0 and 1).

    Up to ``LEAF`` members are compared one by one, more through a signature tree."""
    n = len(size)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    width = min(map(len, bits))
    if n <= LEAF:
        num = [int.from_bytes(_fold(b, width), "little") for b in bits]
        for i in range(n):
            for j in range(i + 1, n):
                if side is not None and side[i] == side[j]:
                    continue
                a, b = size[i], size[j]
                if 100 * min(a, b) < t * max(a, b) or find(i) == find(j):
                    continue
                if min(a - (num[i] & ~num[j]).bit_count(), b - (num[j] & ~num[i]).bit_count()) * (100 + t) >= t * (a + b):
                    out.append((i, j))
                    parent[find(i)] = find(j)
        return out
    sizes = np.array(size, np.int64)
    maps = np.frombuffer(b"".join(_fold(b, width) for b in bits), np.uint64).reshape(n, -1)
    part = np.zeros(n, int) if side is None else np.array(side)
    tree = lambda which: _Tree(which[np.lexsort((maps[which, 0], sizes[which]))], maps, sizes)
    a = tree(np.flatnonzero(part == 0))
    b = a if side is None else tree(np.flatnonzero(part == 1))
    for i, j in zip(*(x.tolist() for x in _node_pairs(a, b, t, side is None))):
        x, y = a.order[i * LEAF : (i + 1) * LEAF], b.order[j * LEAF : (j + 1) * LEAF]
        if len({find(int(z)) for z in x} | {find(int(z)) for z in y}) == 1:
            continue
        sx, sy = sizes[x][:, None], sizes[y][None]
        most = np.minimum(sx - _ones(maps[x][:, None] & ~maps[y][None]), sy - _ones(maps[y][None] & ~maps[x][:, None]))
        ok = (most * (100 + t) >= t * (sx + sy)) & (100 * np.minimum(sx, sy) >= t * np.maximum(sx, sy))
        for p, q in zip(*(z.tolist() for z in np.nonzero(ok))):
            u, v = find(int(x[p])), find(int(y[q]))
            if u != v:
                out.append((int(x[p]), int(y[q])))
                parent[u] = v
    return out


def shared_keys(docs: DataFrame, k: int, t: int, text: str, tokens: int) -> DataFrame:
    """(group, i, j, block, vid): groups of classes that share a key, each different group once.

    Keys are made from the texts and dealt straight into ``lots``, packed to 12
    bytes an entry (32 bits of the key, the class); a lot holds about two
    million, and a task goes through its lots one after another. Equal 32 bits
    of unequal keys only add a candidate. A group beyond ``BLOCK_SETS`` members
    is dealt out as pairs (i, j) of blocks.
    """
    classes = size_classes(t)
    lots = max(partitions(docs.sparkSession), -(-tokens // 4_000_000))
    tasks = max(partitions(docs.sparkSession), min(lots, MOST_TASKS))
    most = BLOCK_SETS

    def emit(batches):
        seen: set[int] = set()
        held: list[tuple] = []

        def flush():
            key, vid = (np.concatenate(x) for x in zip(*held))
            lot = (key % U(lots)).astype(np.int64)
            order = np.argsort(lot, kind="stable")
            cut = np.searchsorted(lot[order], np.arange(lots + 1))
            low, vid = (key[order] >> U(32)).astype(np.uint32), vid[order]
            rows = [(p, low[a:b].tobytes(), vid[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["lot", "x", "y"])

        for b in pieces(batches):
            g, bounds = _sets(b.column(0), k)
            vid = _signature(g, bounds).view(np.int64)
            fresh = np.zeros(len(vid), bool)
            for d, v in enumerate(vid.tolist()):
                fresh[d] = v not in seen
                seen.add(v)
            key, owner = part_keys(g, bounds, t, classes)
            use = fresh[owner]
            held.append((key[use], vid[owner[use]]))
            if sum(len(x[0]) for x in held) >= 1_000_000:
                yield from flush()
                held.clear()
        if held and sum(len(x[0]) for x in held):
            yield from flush()

    def meet(batches):
        now, held = None, []
        for b in batches:
            for lot, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                if lot != now and held:
                    yield from solve(held)
                    held = []
                now = lot
                held.append((np.frombuffer(x, np.uint32), np.frombuffer(y, np.int64)))
        if held:
            yield from solve(held)

    def solve(held):
        key, vid = (np.concatenate(z) for z in zip(*held))
        order = np.lexsort((vid, key))
        key, vid = key[order], vid[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (vid[1:] != vid[:-1])
        key, vid = key[new], vid[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(start, len(key)))
        with np.errstate(over="ignore"):  # a group is named by its members, so that keys with the same members are one group
            name = mix(np.add.reduceat(mix(vid.view(np.uint64)), start) + n.astype(U)).view(np.int64)
        first = np.unique(name, return_index=True)[1]
        first = first[n[first] > 1]
        blocks = -(-n[first] // most)
        small = first[blocks == 1]
        place = np.repeat(start[small] - np.concatenate([[0], np.cumsum(n[small])[:-1]]), n[small]) + np.arange(n[small].sum())
        zero = np.zeros(len(place), np.int32)
        yield _groups(np.repeat(name[small], n[small]), zero, zero, zero, vid[place])
        for f, c in zip(first[blocks > 1].tolist(), blocks[blocks > 1].tolist()):
            own = vid[start[f] : start[f] + n[f]]
            block = (mix(own.view(np.uint64)) % U(c)).astype(np.int32)
            for o in range(c):
                yield _groups(np.full(len(own), name[f]), np.minimum(block, o).astype(np.int32), np.maximum(block, o).astype(np.int32), block, own)

    rows = docs.select(F.col(text).alias("text")).mapInArrow(emit, "lot int, x binary, y binary")
    return rows.repartition(tasks, "lot").sortWithinPartitions("lot").mapInArrow(meet, "group long, i int, j int, block int, vid long").distinct()


def _groups(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["group", "i", "j", "block", "vid"])


def candidates(groups: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """(a, b): in each group, pairs that sizes and bitmaps allow to link, as many as keep all such members connected."""
    keys = ["group", "i", "j"]
    rows = groups.join(classes.select("vid", "n", "bits"), "vid").select(*keys, "block", "vid", "n", "bits")
    rows = rows.repartition(partitions(groups.sparkSession), *keys).sortWithinPartitions(*keys, "vid")

    def run(batches):
        open_key, held, out = None, [], []

        def done():
            side = None if open_key[1] == open_key[2] else [int(x[0] == open_key[2]) for x in held]
            if len(held) > 1:
                out.extend((held[a][1], held[b][1]) for a, b in pruned_pairs([x[2] for x in held], [x[3] for x in held], side, t))

        for b in batches:
            for g, i, j, *member in zip(*(b.column(c).to_pylist() for c in range(7))):
                if (g, i, j) != open_key:
                    if held:
                        done()
                    open_key, held = (g, i, j), []
                held.append(member)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])
                out.clear()
        if held:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


class _Tree:
    """Signature tree over some of a cluster's sets: levels of (OR, AND, smallest, largest, members from, to)."""

    def __init__(self, order, bitmap, size):
        self.order = order
        lo, hi = [], []
        ors, ands, starts, ends = [], [], [], []
        for s in range(0, len(order), LEAF):
            own = order[s : s + LEAF]
            ors.append(np.bitwise_or.reduce(bitmap[own], 0))
            ands.append(np.bitwise_and.reduce(bitmap[own], 0))
            lo.append(size[own].min())
            hi.append(size[own].max())
            starts.append(s)
            ends.append(s + len(own))
        self.levels = [(np.array(ors), np.array(ands), np.array(lo), np.array(hi))]
        while len(self.levels[-1][2]) > 1:
            o, a, lo, hi = self.levels[-1]
            cut = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(o, cut, 0), np.bitwise_and.reduceat(a, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1).astype(np.int64)


def _node_pairs(a: _Tree, b: _Tree, t: int, same: bool):
    """Leaf pairs (i, j) that may hold links; i <= j if both trees are one."""
    level = max(len(a.levels), len(b.levels)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        oa, aa, la, ha = a.levels[min(level, len(a.levels) - 1)]
        ob, ab, lb, hb = b.levels[min(level, len(b.levels) - 1)]
        keep = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            most = np.minimum(ha[x] - _ones(aa[x] & ~ob[y]), hb[y] - _ones(ab[y] & ~oa[x]))
            most = np.minimum(most, np.minimum(ha[x], hb[y]))
            ok = most * (100 + t) >= t * (la[x] + lb[y])
            ok &= (100 * ha[x] >= t * lb[y]) & (100 * hb[y] >= t * la[x])
            keep[s : s + (1 << 16)] = ok
        i, j = i[keep], j[keep]
        if level == 0:
            return i, j
        level -= 1
        fa, fb = (FAN if level < len(x.levels) - 1 else 1 for x in (a, b))
        x, y = np.broadcast_arrays((i * fa)[:, None, None] + np.arange(fa)[:, None], (j * fb)[:, None, None] + np.arange(fb))
        i, j = x.ravel(), y.ravel()
        ok = (i < len(a.levels[min(level, len(a.levels) - 1)][2])) & (j < len(b.levels[min(level, len(b.levels) - 1)][2]))
        if same:
            ok &= i <= j
        i, j = i[ok], j[ok]


def cluster_links(sets: list[np.ndarray], side: np.ndarray, t: int, within: bool, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each set of a cluster: its local component's smallest number and the weights of its partners.

    ``within``: all pairs; else only pairs of a set with side 0 and one with side 1.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    column, seen = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    shared = seen[column] > 1
    name = np.cumsum(seen > 1) - 1
    column, row = name[column[shared]], owner[shared]
    n_columns = int((seen > 1).sum())
    limits = np.searchsorted(row, np.arange(n + 1))

    bits = np.zeros((n, BITS), bool)
    bits[owner, (flat >> U(13)).astype(np.int64) % BITS] = True
    bitmap = np.packbits(bits, 1).view(np.uint64)
    first = np.array([s[0] for s in sets])

    def tree(which):
        return _Tree(which[np.lexsort((first[which], size[which]))], bitmap, size)

    a = tree(np.arange(n) if within else np.flatnonzero(side == 0))
    b = a if within else tree(np.flatnonzero(side == 1))
    parent, links = list(range(n)), np.zeros(n, np.int64)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    dense: dict[tuple, np.ndarray] = {}

    def matrix(which_tree, leaf, members):
        """0/1 rows of a leaf's sets over the shared tokens; the last few are kept."""
        if (found := dense.get((which_tree, leaf))) is None:
            if len(dense) > 64:
                dense.clear()
            found = dense[which_tree, leaf] = np.zeros((len(members), n_columns), np.float32)
            for r, x in enumerate(members):
                found[r, column[limits[x] : limits[x + 1]]] = 1
        return found

    for i, j in zip(*(x.tolist() for x in _node_pairs(a, b, t, within))):
        x, y = a.order[i * LEAF : (i + 1) * LEAF], b.order[j * LEAF : (j + 1) * LEAF]
        sx, sy = size[x][:, None], size[y][None]
        most = np.minimum(sx - _ones(bitmap[x][:, None] & ~bitmap[y][None]), sy - _ones(bitmap[y][None] & ~bitmap[x][:, None]))
        maybe = most * (100 + t) >= t * (sx + sy)
        if within and i == j:
            maybe &= np.triu(np.ones(maybe.shape, bool), 1)
        if not maybe.any():
            continue
        if n_columns <= DENSE_COLUMNS:
            both = (matrix(0, i, x) @ matrix(0 if within else 1, j, y).T).astype(np.int64)
        else:
            both = np.zeros(maybe.shape, np.int64)
            for p, q in zip(*np.nonzero(maybe)):
                cp, cq = (column[limits[z] : limits[z + 1]] for z in (x[p], y[q]))
                both[p, q] = len(np.intersect1d(cp, cq, assume_unique=True))
        linked = maybe & (100 * both >= t * (sx + sy - both))
        links[x] += linked @ weight[y]
        np.add.at(links, y, linked.T @ weight[x])
        for p, q in zip(*np.nonzero(linked)):
            rp, rq = find(int(x[p])), find(int(y[q]))
            if rp != rq:
                parent[max(rp, rq)] = min(rp, rq)
    return np.array([find(x) for x in range(n)]), links


def _clusters(docs: DataFrame, classes: DataFrame, k: int, t: int, text: str) -> DataFrame:
    """(cluster, blocks, _at, vid, n, n_docs) of every class that may link with another."""
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    candidate = connected_components(candidates(shared_keys(docs, k, t, text, tokens), classes, t))
    members = candidate.select(F.col("v").alias("vid"), F.col("component").alias("cluster")).join(classes.drop("bits"), "vid")
    members = materialize(members, "members")
    of = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("w") / BLOCK_TOKENS), F.lit(1)).cast("int")
    of = materialize(of.select("cluster", "c", blocks.alias("blocks")), "cluster-sizes")
    return materialize(many_to_one(members, of, "cluster", "c"), "clusters")


def _with_texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` with their documents' texts, by handle."""
    texts = docs.select(handle(doc_id, text).alias("_at"), F.col(text).alias("text"))
    if wanted.count() <= BROADCAST_ROWS:
        return texts.join(F.broadcast(wanted), "_at")
    return texts.join(wanted, "_at")


def _tree_join(members: DataFrame, docs: DataFrame, k: int, t: int, doc_id: str, text: str) -> DataFrame:
    """(vid, root, links) from each cluster, or each pair of a large cluster's blocks."""
    rows = _with_texts(docs, doc_id, text, members)
    schema = "cluster long, blocks int, vid long, n_docs long, tokens array<long>"

    def build(batches):
        for b in pieces(batches):
            b = pa.RecordBatch.from_arrays([b.column(c) for c in ("cluster", "blocks", "vid", "n_docs", "text")], names=["cluster", "blocks", "vid", "n_docs", "text"])
            g, bounds = _sets(b.column(4), k)
            own = _signature(g, bounds).view(np.int64) == b.column(2).to_numpy()  # a handle may stand for several texts
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(g.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), tokens], names=["cluster", "blocks", "vid", "n_docs", "tokens"]).filter(pa.array(own))

    sets = rows.select("cluster", "blocks", "vid", "n_docs", "text").mapInArrow(build, schema)
    block = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = sets.withColumn("block", block).withColumn("p", F.explode(pairs)).select("cluster", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "vid", "n_docs", "tokens")
    keys = ["cluster", "i", "j"]
    dealt = dealt.repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys, "vid")

    def solve(batches):
        open_key, held = None, {}

        def done():
            if len(held) > 1:
                vid = np.array(list(held))
                side = np.array([x[0] for x in held.values()])
                root, links = cluster_links([x[2] for x in held.values()], (side == open_key[2]).astype(int), t, open_key[1] == open_key[2], np.array([x[1] for x in held.values()]))
                yield pa.RecordBatch.from_arrays([pa.array(vid), pa.array(vid[root]), pa.array(links)], names=["vid", "root", "links"])

        for b in batches:
            keys3 = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            block, vid, docs_of = (b.column(i).to_pylist() for i in (3, 4, 5))
            tokens = b.column(6)
            flat, off = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
            for r, key in enumerate(keys3):
                if key != open_key:
                    yield from done()
                    open_key, held = key, {}
                held[vid[r]] = (block[r], docs_of[r], flat[off[r] : off[r + 1]].copy())
        if held:
            yield from done()

    return dealt.mapInArrow(solve, "vid long, root long, links long")


def near_duplicates(docs: DataFrame, k: int = 5, t: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _at (its handle), component (a name; null for empty sets), n_shingles, component_id and n_links of every document."""
    signed = materialize(signatures(docs, k, doc_id, text), "signatures")
    slim = signed.drop("bits")
    classes = materialize(signed.where("vid is not null").groupBy("vid").agg(F.max("bits").alias("bits"), F.min("doc_id").alias("low"), F.min("_at").alias("_at"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_docs")), "classes")
    members = _clusters(docs, classes, k, t, text).select("cluster", "blocks", "_at", "vid", "n_docs")
    found = materialize(_tree_join(members, docs, k, t, doc_id, text), "links")
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    if members.where("blocks > 1").limit(1).count():
        root = connected_components(found.select(F.col("vid").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("vid"), F.col("component").alias("root"))
    else:
        root = found.select("vid", "root")
    named = classes.drop("bits").join(root, "vid", "left").join(links, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    named = materialize(named.select("vid", "root", "low", "n_docs", "links"), "named")
    # a component may hold very many classes, and a class very many copies: counted first, then joined back
    low = materialize(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("c")), "lowest")
    named = many_to_one(named, low, "root", "c").select("vid", "root", "component_id", "n_docs", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    named = materialize(named, "named")
    full = many_to_one(slim.where("vid is not null"), named, "vid", "n_docs")
    none = slim.where("vid is null").select("*", *[F.lit(None).cast("long").alias(c) for c in ("root", "component_id", "n_links")])
    out = full.unionByName(none)
    return out.select("doc_id", "_at", F.col("root").alias("component"), F.col("n").alias("n_shingles"), F.when(F.col("vid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def oracle(k: int, t: int) -> str:
    """The same sets, links and components by plain SQL (small tables only: it counts every pair that shares a shingle)."""
    gram = " || ' ' || ".join(f"w[i + {j + 1}]" for j in range(k))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {t} * (x.n + y.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id"""
