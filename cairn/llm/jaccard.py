"""N-gram Jaccard join: shared rare shingles name who may meet, an R-tree of count vectors admits pairs, exact sets verify.

Two sets that reach the threshold share a shingle among the first few of each, in any one order of all shingles. The
order puts the commonest shingles of a sample last, which only saves work: every order gives the same links. Equal
sets are one set from the start. Each shared shingle is one stretch of the leading coordinate of an R-tree over count
vectors; its nodes and points admit a pair where the summed minima of the coordinates allow the overlap. What the
trees admit joins sets to clusters, and the sets of a cluster meet in tiles, once more through a tree, where exact
intersections decide. Pairs are never rows: trees and tiles give a row for each set at most.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import components, exchange, store, textkit

U = np.uint64
#: Coordinates of a small set's count vector; larger sets have more, up to MOST_GROUPS, of about FILL shingles each.
GROUPS, MOST_GROUPS, FILL = 64, 2048, 16
#: A coordinate that doesn't fit a byte counts as so many, which only loosens the bound.
FULL, OVER = 255, 1 << 20
#: Points of a leaf and children of an inner node.
FAN = 16
#: A shingle asked for more often is dealt out by shingle and set.
HOT = 4000
#: The sets of a shingle are searched in tiles of two parts of about so many sets.
TILE = 2048
#: The sets of a cluster are verified in tiles of two blocks of about so many shingles.
BLOCK = 1 << 18
#: Pairs whose vectors are compared at once, and points that search a tree at once.
STEP, QUERIES = 1 << 15, 1 << 10
#: Earlier shared shingles that a set carries to each of its shingles.
EARLIER = ["e0", "e1"]
#: Sampled documents and the most shingles put last because of them.
SAMPLE, LAST = 4000, 100_000


def least_kept(n, percent):
    """Shingles of n that a partner has to share at least."""
    return -(-n * percent // 100)


def least_shared(a, b, percent):
    """100 * shared >= percent * union, solved for shared."""
    return -(-(a + b) * percent // (100 + percent))


def set_hash(x):
    if not len(x):
        return 0
    return textkit.mix_int(int(textkit.mix(x + U(1)).sum(dtype=np.uint64)) + int(np.bitwise_xor.reduce(textkit.mix(x))) * textkit.BASE + len(x)) or 1


def prefix(x, last, percent):
    """The shingles that a partner must share one of, in the common order."""
    size = len(x) - least_kept(len(x), percent) + 1
    if not len(last):
        return x[:size]
    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
    return np.concatenate([x[~late], x[late]])[:size]


class Chunk:
    """The distinct sets of a chunk of documents."""

    def __init__(self, table, k):
        self.found, self.sets = {}, {}
        self.hash = np.zeros(len(table), np.uint64)
        self.size = np.zeros(len(table), np.int64)
        for row, x in textkit.shingle_sets(table.column("text"), k):
            h = set_hash(x)
            self.hash[row], self.size[row] = h, len(x)
            if len(x) and h not in self.sets:
                self.sets[h] = x

    def keys(self, last, percent):
        """(key, set hash, set size, rank of the key in its prefix) of all prefixes."""
        key, owner, size, rank = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for h, x in self.sets.items():
            p = prefix(x, last, percent)
            key.append(p)
            owner.append(np.full(len(p), h, np.uint64))
            size.append(np.full(len(p), len(x)))
            rank.append(np.arange(len(p)))
        return np.concatenate(key), np.concatenate(owner), np.concatenate(size), np.concatenate(rank)


def common_shingles(docs: DataFrame, k: int):
    """Sorted hashes of shingles that several documents of a bounded sample share."""
    n = docs.count()
    near = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) <= int((1 << 24) * min(1.0, SAMPLE / max(1, n))))

    def count(batches):
        for b in batches:
            sets = [x for _, x in textkit.shingle_sets(b.column(0), k)]
            found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    rows = near.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 3")
    got = [r.h for r in rows.orderBy(F.desc("n"), "h").limit(LAST).select("h").collect()]
    return np.sort(np.array(got, np.int64).view(np.uint64))


def count_vector(x):
    """Counts of x by the leading bits of its hashes, a byte each."""
    groups = GROUPS
    while groups < MOST_GROUPS and groups * FILL < len(x):
        groups *= 2
    at = (x >> U(65 - groups.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=groups), FULL).astype(np.uint8)


def unpacked_vectors(column):
    """(matrix of the vectors folded to GROUPS coordinates, the whole vectors)."""
    whole = []
    folded = np.empty((len(column), GROUPS), np.int32)
    for i, v in enumerate(column):
        v = np.frombuffer(v.as_buffer(), np.uint8).astype(np.int32)
        v[v == FULL] = OVER
        whole.append(v)
        folded[i] = v.reshape(GROUPS, -1).sum(1)
    return folded, whole


def overlap_bound(x, y):
    """The summed minima of two whole vectors, at the coarser one's coordinates."""
    m = min(len(x), len(y))
    return int(np.minimum(x.reshape(m, -1).sum(1), y.reshape(m, -1).sum(1)).sum())


def allowed(rows, whole, n, percent):
    """Which pairs (rows of indices) the whole vectors allow; vectors of GROUPS coordinates have been compared already."""
    need = least_shared(n[rows[:, 0]].astype(np.int64), n[rows[:, 1]].astype(np.int64), percent)
    return np.array([min(len(whole[a]), len(whole[b])) == GROUPS or overlap_bound(whole[a], whole[b]) >= t for (a, b), t in zip(rows.tolist(), need.tolist())], bool)


class Tree:
    """A packed R-tree of points (key, size, count vector): leaves of FAN points, inner nodes of FAN children, up to FAN roots.

    A node holds the ranges of its points' keys and sizes and their greatest counts. seen and admitted tell the pairs
    of points that were compared and those whose summed minima allow the threshold.
    """

    def __init__(self, key, size, points):
        heaviest = points.argmax(1) if len(points) else np.empty(0, np.int64)
        self.order = np.lexsort((heaviest, size, key))
        self.key, self.size, self.points = key[self.order], size[self.order].astype(np.int64), points[self.order]
        self.levels, self.seen, self.admitted = [], 0, 0
        lo, hi, least, most, top = self.key, self.key, self.size, self.size, self.points
        while len(lo) > FAN or not self.levels and len(lo):
            at = np.arange(0, len(lo), FAN)
            end = np.minimum(at + FAN, len(lo)) - 1
            lo, hi, least, most, top = lo[at], hi[end], np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((lo, hi, least, most, top))

    def _meets(self, q, x, level, percent):
        """Which nodes x (points below all levels) may hold partners of the points q."""
        key, size = self.key[q], self.size[q]
        if level < 0:
            ok = (self.key[x] == key) & (x < q) & (self.size[x] * 100 >= size * percent)
            return ok
        lo, hi, least, most, _ = self.levels[level]
        return (lo[x] <= key) & (hi[x] >= key) & (x * FAN ** (level + 1) < q) & (least[x] * percent <= 100 * size) & (most[x] * 100 >= size * percent)

    def _allowed(self, q, x, level, percent):
        """Which of them the summed minima of the counts leave."""
        least, top = (self.size, self.points) if level < 0 else (self.levels[level][2], self.levels[level][4])
        out = np.empty(len(q), bool)
        for at in range(0, len(q), STEP):
            a, b = q[at : at + STEP], x[at : at + STEP]
            out[at : at + STEP] = np.minimum(self.points[a], top[b]).sum(1, dtype=np.int64) >= least_shared(least[b], self.size[a], percent)
        return out

    def join(self, percent, may=None):
        """Yields (p, q), rows as given, of equal keys: all pairs that the vectors allow, each once. may(p, q) is asked before they are compared."""
        if not self.levels:
            return
        roots = np.arange(len(self.levels[-1][0]))
        for start in range(0, len(self.order), QUERIES):
            q = np.arange(start, min(start + QUERIES, len(self.order)))
            q, x = np.repeat(q, len(roots)), np.tile(roots, len(q))
            for level in range(len(self.levels) - 1, -2, -1):
                ok = self._meets(q, x, level, percent)
                q, x = q[ok], x[ok]
                if level < 0 and may is not None and len(q):
                    ok = may(self.order[x], self.order[q])
                    q, x = q[ok], x[ok]
                if level < 0:
                    self.seen += len(q)
                ok = self._allowed(q, x, level, percent)
                q, x = q[ok], x[ok]
                if level >= 0:
                    below = len(self.levels[level - 1][0]) if level else len(self.order)
                    q, x = np.repeat(q, FAN), (x[:, None] * FAN + np.arange(FAN)).ravel()
                    ok = x < below
                    q, x = q[ok], x[ok]
            self.admitted += len(q)
            if len(q):
                yield self.order[x], self.order[q]


def forest(n, a, b):
    """The least node that each of n nodes reaches by the edges a, b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label[label], label):
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def first_meeting(p, q, n, rank, earlier, percent):
    """Which pairs (p, q) of rows of one shingle are to be given out there.

    Sets that share t shingles share one among the first n - t + 1 of each, so later places need no look. Where the
    shingles just before this one have one in common, the pair has been given out there or earlier; at the first
    common shingle nothing before it is common, so no pair is lost.
    """
    need = least_shared(n[p].astype(np.int64), n[q].astype(np.int64), percent)
    ok = (rank[p] <= n[p] - need) & (rank[q] <= n[q] - need)
    for x in earlier:
        for y in earlier:
            ok &= (x[p] != y[q]) | (x[p] == 0)
    return ok


def _meet(percent: int):
    """Finds, among the rows of a deal, sets that the trees join: a row (a, b) for each set but one of every group."""

    def meet(key, table):
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        k, i, j, own, sh, n, rank = (get(c) for c in ("key", "i", "j", "own", "sh", "n", "rank"))
        earlier = [get(c) for c in EARLIER]
        v, whole = unpacked_vectors(table.column("vector"))
        order = np.lexsort((j, i, k))
        new = np.concatenate([[False], (np.diff(k[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new)
        found, at = np.unique(sh, return_inverse=True)
        large = np.array([len(x) for x in whole]) > GROUPS
        label = np.arange(len(found))
        may = lambda p, q: ((i[p] == j[p]) | (own[p] != own[q])) & (label[at[p]] != label[at[q]]) & first_meeting(p, q, n, rank, earlier, percent)
        for p, q in Tree(place, n, v).join(percent, may):
            finer = large[p] & large[q]
            for x, y in zip(p[finer].tolist(), q[finer].tolist()):
                if label[at[x]] != label[at[y]] and overlap_bound(whole[x], whole[y]) >= least_shared(int(n[x]), int(n[y]), percent):
                    label[label == max(label[at[x]], label[at[y]])] = min(label[at[x]], label[at[y]])
            p, q = label[at[p[~finer]]], label[at[q[~finer]]]
            label = forest(len(found), p, q)[label]
        moved = np.flatnonzero(label != np.arange(len(found)))
        return pa.table({"a": pa.array(found[moved]), "b": pa.array(found[label[moved]])})

    return meet


def _joined(entries: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all sets which a tree admits as a pair, of entries(key, sh, n, rank, sets, *EARLIER)."""
    hot = entries.filter("sets = 0")
    sizes = hot.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("sets"))
    x = entries.filter("sets > 1").unionByName(hot.drop("sets").join(sizes.filter("sets > 1"), "key"))
    x = x.withColumn("parts", F.ceil(F.col("sets") / TILE).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64("sh"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sh", "n", "rank", *EARLIER).join(vectors.select("sh", "vector"), "sh")
    x = x.withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(4 * store.partitions(entries.sparkSession))).cast("int"))
    return x.groupBy("deal").applyInArrow(_meet(percent), "a long, b long")


def _linked(percent: int):
    """Verifies the tiles of a deal: (sh, to, links) of each set with a link, where links counts the documents of its partners."""

    def link(key, table):
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        tile, own, whole, sh, docs = (get(c) for c in ("tile", "own", "whole", "sh", "docs"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        n = np.array([len(x) for x in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        v = unpacked_vectors(pa.chunked_array([pa.array([count_vector(x).tobytes() for x in sets], pa.binary())]))[0]
        label, links, mark = np.arange(len(sh)), np.zeros(len(sh), np.int64), np.zeros(len(names), np.int32)
        for p, q in Tree(np.unique(tile, return_inverse=True)[1], n, v).join(percent, lambda p, q: whole[p] | (own[p] != own[q])):
            edge = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))  # the partners of each q stand together
            shared = np.empty(len(p), np.int64)
            for a, z in zip(edge, [*edge[1:], len(q)]):
                mine = ids[at[q[a]] : at[q[a] + 1]]
                mark[mine] = 1
                theirs = np.concatenate([ids[at[x] : at[x + 1]] for x in p[a:z].tolist()])
                size = n[p[a:z]]
                shared[a:z] = np.add.reduceat(mark[theirs], np.cumsum(size) - size)
                mark[mine] = 0
            ok = shared >= least_shared(n[p], n[q], percent)
            p, q = p[ok], q[ok]
            np.add.at(links, p, docs[q])
            np.add.at(links, q, docs[p])
            label = forest(len(sh), label[p], label[q])[label]
        out = np.flatnonzero(links)
        return pa.table({"sh": pa.array(sh[out]), "to": pa.array(sh[label[out]]), "links": pa.array(links[out])})

    return link


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id and n_links of every document.

    Words are what lies between white space in the whole text, A-Z lower-cased; a set holds the distinct k-word
    shingles, for fewer words the whole sequence as one. Documents link when 100 * intersection >= percent * union;
    component_id is the least doc_id that links reach, and n_links the number of other documents (rows) that this one
    links to, those with an equal set included. Empty sets (null, empty and wordless texts) link with nothing
    and are their own component. The tiles of m near copies that are no copies hold m * m / 2 pairs, as counting their links asks for. Repeated rows each get their row; an empty table gives an empty table; other columns
    are ignored.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = common_shingles(x, k)
    chunks = exchange.chunk_count(x)
    ranges = max(16, chunks // 2)
    x = store.bucketed(exchange.in_chunks(x, chunks), "chunks", "chunk", min(chunks, 10_000))

    def members(key, table):
        c = Chunk(table, k)
        empty = count_vector(np.empty(0, np.uint64)).tobytes()
        vector = {h: count_vector(s).tobytes() for h, s in c.sets.items()}
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array(c.size), "sh": pa.array(c.hash.view(np.int64)), "vector": pa.array([vector.get(h, empty) for h in c.hash.tolist()], pa.binary())})

    def ask_keys(key, table):
        found, n = np.unique(Chunk(table, k).keys(last, percent)[0], return_counts=True)
        return pa.Table.from_batches([exchange.pack(found, {"n": np.minimum(n, 255).astype(np.uint8)}, ranges, key[0].as_py())])

    def answer_keys(key, table):
        h, _, at = exchange.grouped(exchange.unpacked(table, "hashes", np.uint64))
        _, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, np.concatenate(exchange.unpacked(table, "n", np.uint8)))[inverse]
        status = ((total > 1).astype(np.uint8) + (total > HOT)).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "answer": pa.array([status[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())})

    def ask_sets(key, table, answers):
        key_of, owner, size, rank = Chunk(table, k).keys(last, percent)
        got = exchange.unpacked(answers.sort_by("part"), "answer", np.uint8)
        status = np.concatenate(got)[np.unique(key_of, return_inverse=True)[1]] if got else np.empty(0, np.uint8)
        keep = np.flatnonzero(status > 0)
        key_of, owner, size, rank, status = key_of[keep], owner[keep], size[keep], rank[keep], status[keep]
        nth = np.zeros(len(keep), np.int64)  # place among the shared keys of the set
        order = np.lexsort((rank, owner))
        if len(order):
            new = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        earlier = {}
        for back, name in enumerate(EARLIER, 1):
            earlier[name] = np.zeros(len(keep), np.uint64)
            earlier[name][order[back:]] = np.where(nth[order[back:]] >= back, key_of[order[:-back]], U(0))
        route = key_of ^ np.where(status == 2, textkit.mix(owner), U(0))
        order = np.argsort(route, kind="stable")
        values = {"sh": owner[order], "n": size[order].astype(np.int32), "hot": (status[order] == 2).astype(np.uint8), "rank": rank[order].astype(np.int32)} | {c: x[order] for c, x in earlier.items()}
        return pa.Table.from_batches([exchange.pack(route[order], values, ranges, key[0].as_py())])

    def answer_sets(key, table):
        route, row, _ = exchange.grouped(exchange.unpacked(table, "hashes", np.uint64))
        sh = np.concatenate(exchange.unpacked(table, "sh", np.uint64))
        n, hot = (np.concatenate(exchange.unpacked(table, c, t)) for c, t in (("n", np.int32), ("hot", np.uint8)))
        key_of = route ^ np.where(hot > 0, textkit.mix(sh), U(0))
        rank = np.concatenate(exchange.unpacked(table, "rank", np.int32))
        earlier = {c: np.concatenate(exchange.unpacked(table, c, np.int64)) for c in EARLIER}
        home = table.column("chunk").to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((home, sh, key_of))
        order = order[np.concatenate([[True], (key_of[order][1:] != key_of[order][:-1]) | (sh[order][1:] != sh[order][:-1])])]
        _, inverse, count = np.unique(key_of[order], return_inverse=True, return_counts=True)
        sets = np.where(hot[order] > 0, 0, count[inverse])  # the sets of a hot shingle are dealt out: 0 is for not known here
        order, sets = order[sets != 1], sets[sets != 1]
        return pa.table({"key": pa.array(key_of[order].view(np.int64)), "sh": pa.array(sh[order].view(np.int64)), "n": pa.array(n[order]), "home": pa.array(home[order].astype(np.int32)), "rank": pa.array(rank[order]), "sets": pa.array(sets.astype(np.int32))} | {c: pa.array(x[order]) for c, x in earlier.items()})

    def fetch(key, table, wanted):
        sh = wanted.column("sh").to_numpy(zero_copy_only=False)
        c = Chunk(table, k) if len(sh) else None
        return wanted.select(["deal", "tile", "own", "whole", "sh", "docs"]).append_column("shingles", pa.array([c.sets[h].tobytes() for h in sh.view(np.uint64).tolist()], pa.binary()))

    asked = x.groupBy("chunk").applyInArrow(ask_keys, "part int, chunk int, hashes binary, n binary")
    status = asked.groupBy("part").applyInArrow(answer_keys, "chunk int, part int, answer binary")
    more = "".join(f", {c} binary" for c in EARLIER)
    asked = x.groupBy("chunk").cogroup(status.groupBy("chunk")).applyInArrow(ask_sets, f"part int, chunk int, hashes binary, sh binary, n binary, hot binary, rank binary{more}")
    more = "".join(f", {c} long" for c in EARLIER)
    entries = store.written(asked.groupBy("part").applyInArrow(answer_sets, f"key long, sh long, n int, home int, rank int, sets int{more}"), "entries")
    homes = entries.groupBy("sh").agg(F.min("home").alias("home"))
    rows = store.written(x.groupBy("chunk").applyInArrow(members, "doc_id long, n long, sh long, vector binary"), "members")
    vectors = store.written(rows.join(homes.select("sh"), "sh", "left_semi").groupBy("sh").agg(F.first("n").alias("n"), F.first("vector").alias("vector")), "vectors")

    sets = store.written(rows.filter("n > 0").groupBy("sh").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least")), "set-facts")
    store.swept(docs.sparkSession)
    joined = store.written(_joined(entries, vectors, percent), "joined")
    homes = store.written(homes, "homes")
    store.dropped(entries, vectors)
    store.swept(docs.sparkSession)
    clusters = components.components(joined)
    met = store.written(clusters.select(F.col("node").alias("sh"), F.col("root").alias("cluster")).join(sets.select("sh", "n", "docs"), "sh").join(homes, "sh"), "met")
    blocks = met.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    met = met.join(store.written(blocks, "blocks"), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    deals = max(store.partitions(docs.sparkSession), -(-int(met.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0]) // (4 * BLOCK)))
    met = met.withColumn("own", F.pmod(F.xxhash64("sh"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("tile", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")))
    met = met.select(F.col("home").alias("chunk"), F.pmod("tile", F.lit(deals)).cast("int").alias("deal"), "tile", "own", (F.col("own") == F.col("other")).alias("whole"), "sh", "docs")
    dealt = x.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(fetch, "deal int, tile long, own int, whole boolean, sh long, docs long, shingles binary")
    links = store.written(dealt.groupBy("deal").applyInArrow(_linked(percent), "sh long, to long, links long"), "links")
    if x.inputFiles():
        store.unbucketed(x)
    roots = components.components(links.select(F.col("sh").alias("a"), F.col("to").alias("b")))

    linked = store.written(sets.select("sh", "least").join(roots.select(F.col("node").alias("sh"), "root"), "sh"), "rooted")
    least = store.written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = sets.select("sh", "docs", "least").join(linked.join(least, "root").select("sh", "component_id"), "sh", "left").join(links.groupBy("sh").agg(F.sum("links").alias("links")), "sh", "left")
    classes = store.written(classes.select("sh", F.coalesce("component_id", "least").alias("component_id"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    out = rows.join(classes, "sh", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("sh").alias("set_id"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (null last), and of equal ids and texts a single row.

    Rows are told apart by doc_id and text, so a repeated or null doc_id takes no other text with it. Texts without a
    word link with nothing: of those one row of each doc_id and text stays, and all of a null doc_id.
    """
    text = F.xxhash64("text")
    classes = similarity_classes(docs.select(text.alias("doc_id"), "text"), k, percent)
    classes = classes.select(F.col("doc_id").alias("key"), F.col("component_id").alias("class"), (F.col("n_shingles") > 0).alias("worded")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text.alias("key"))
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id")).alias("first")).join(classes.filter("worded"), "key")
    keep = least.groupBy("class").agg(F.min(F.struct("first", "key")).alias("least")).select(F.col("least.first.id").alias("kept"), F.col("least.key").alias("kept_key"))
    worded = rows.join(keep, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept"))).select(*rows.columns).dropDuplicates(["id", "key"])
    bare = rows.join(classes.filter("NOT worded"), "key", "left_semi").select(*rows.columns)
    named = bare.filter(F.col("id").isNotNull()).dropDuplicates(["id", "key"])
    return worded.unionByName(named).unionByName(bare.filter(F.col("id").isNull())).select("row.*")
