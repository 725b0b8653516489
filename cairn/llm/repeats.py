"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Strings can only repeat where their anchors do. The anchor of a string is the least-hashed k-byte gram in it (the
leftmost of equals), so equal strings have equal anchors at equal places, and the strings of one text fall into runs
that share an anchor. Runs with an anchor seen once are done with. The others, as segments of at most 176 bytes that
stand aligned on their anchor, go through a column-wise construction: each round inserts one symbol of each segment,
from the last column to the first, and updates the order of the collection's suffixes (its Burrows-Wheeler order) and
their common prefixes. Strings with a common prefix of full length are equal, and all but the earliest are covered.
Of equal whole segments only the earliest goes through it.

The sequential external files of that construction are the tables and shuffles between its passes over bucketed
chunks of text; a task holds one chunk or one range of anchors.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from cairn.llm import exchange, store, textkit

U = np.uint64
LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM  # the most bytes of a string before its anchor
WIDTH = REACH + LENGTH
PACKED = -(-(REACH + 1) // 8)
#: An anchor with more occurrences (each chunk says 255 at most) is dealt out by its single strings, not as one group.
HOT = 2000
NO_ID = np.iinfo(np.int64).max
#: Kinds of questions: about anchors, whole segments, single strings of hot anchors, and segments' bytes.
STATUS, WHOLE, STRING, SEGMENT = 0, 1, 2, 3
#: Answers about a whole segment: nothing repeats, an equal one comes earlier, or others of its anchor have to be compared.
ALONE, LATER, COMPARE = 0, 1, 2


class Runs:
    """The anchor runs of a slice of texts: anchor position, first and last string start, text, and their hashes."""

    def __init__(self, data, offs):
        n = len(data)
        self.data, self.offs = data, offs
        self.c = textkit.prefix_hash(data)
        self.inverse = textkit.powers(n + 1)[1]
        if n < LENGTH:
            self.at = self.low = self.high = self.doc = np.empty(0, np.int64)
            self.anchor = self.segment = np.empty(0, np.uint64)
            return
        grams = textkit.mix((self.c[GRAM:] - self.c[:-GRAM]) * self.inverse[: n - GRAM + 1])
        mask = U((1 << int(n).bit_length()) - 1)
        least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        wide, width = REACH + 1, 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        owner = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
        start = np.flatnonzero(owner[: n - LENGTH + 1] == owner[LENGTH - 1 :])
        at = (least[start] & mask).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else np.empty(0, np.int64)
        last = np.concatenate([new[1:], [len(start)]]) - 1 if len(new) else new
        self.at, self.low, self.high = at[new], start[new], start[last]
        self.doc = owner[self.low].astype(np.int64)
        self.anchor = grams[self.at]
        shape = (self.at - self.low).astype(np.uint64) * U(256) + (self.at - self.high).astype(np.uint64)
        self.segment = textkit.mix(self.hashed(self.low, self.high + LENGTH) + textkit.mix(shape))

    def hashed(self, low, high):
        return textkit.mix((self.c[high] - self.c[low]) * self.inverse[low])

    def columns(self, which):
        """The segments' bytes, aligned on the anchor, zero outside."""
        at, low, high = self.at[which], self.low[which], self.high[which] + LENGTH
        x = at[:, None] - REACH + np.arange(WIDTH)
        return np.where((x >= low[:, None]) & (x < high[:, None]), self.data[np.clip(x, 0, len(self.data) - 1)], 0).astype(np.uint8)


class Chunk:
    """All runs of a chunk of documents, and what is asked about them."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.slices = [(i, Runs(data, offs)) for i, data, offs in textkit.slices(table.column("text"))]
        join = lambda f, t: np.concatenate([f(i, r) for i, r in self.slices]).astype(t) if self.slices else np.empty(0, t)
        self.anchor = join(lambda i, r: r.anchor, np.uint64)
        self.segment = join(lambda i, r: r.segment, np.uint64)
        self.doc = self.ids[join(lambda i, r: r.doc + i, np.int64)]
        self.at = join(lambda i, r: r.at - r.offs[r.doc], np.int64)
        self.ends = np.cumsum([len(r.at) for _, r in self.slices])

    def anchors(self):
        found, inverse, n = np.unique(self.anchor, return_inverse=True, return_counts=True)
        return found, inverse, np.minimum(n, 255).astype(np.uint8)

    def segments(self, once):
        """For runs `once` (indices): (indices of the earliest run of each distinct (anchor, segment), by anchor; group of each)."""
        order = once[np.lexsort((self.at[once], self.doc[once], self.segment[once], self.anchor[once]))]
        new = np.concatenate([[True], (self.anchor[order][1:] != self.anchor[order][:-1]) | (self.segment[order][1:] != self.segment[order][:-1])]) if len(order) else np.empty(0, bool)
        return order[new], order, np.cumsum(new) - 1

    def parts(self, which):
        """(run set, own indices, places in `which`) for each slice."""
        base = 0
        for (_, r), end in zip(self.slices, self.ends):
            mine = np.flatnonzero((which >= base) & (which < end))
            yield r, which[mine] - base, mine
            base = end

    def strings(self, hot):
        """All strings of the hot runs: hash, document, start in it; and (run set, start in the slice) to find them again."""
        h, doc, at, where = [], [], [], []
        for r, own, mine in self.parts(hot):
            size = r.high[own] - r.low[own] + 1
            start = np.repeat(r.low[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(own) else np.empty(0, np.int64)
            run = np.repeat(np.arange(len(own)), size)
            h.append(r.hashed(start, start + LENGTH))
            doc.append(self.doc[hot[mine]][run])
            at.append(start - r.offs[r.doc[own]][run])
            where.append((r, start))
        return np.concatenate(h), np.concatenate(doc), np.concatenate(at), where


def _first_of(hashes, doc, at):
    """Order by (hash, doc, at), and which of it opens a group."""
    order = np.lexsort((at, doc, hashes))
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.empty(0, bool)
    return order, new


def _ask_anchors(ranges):
    def ask(key, table):
        found, _, n = Chunk(table).anchors()
        return pa.Table.from_batches([exchange.pack(found, {"n": n}, ranges, key[0].as_py())])

    return ask


def _answer_anchors(key, table):
    h, _, at = exchange.grouped(exchange.unpacked(table, "hashes", np.uint64))
    n = np.concatenate(exchange.unpacked(table, "n", np.uint8)).astype(np.int64)
    _, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, n)[inverse]
    status = ((total > 1).astype(np.uint8) + (total > HOT)).astype(np.uint8)
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([STATUS] * len(table), pa.int32()), "part": table.column("part"), "answer": pa.array([status[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())})


def _told(answers, kind, dtype):
    """One kind of answers, in the order asked."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("part")
    got = exchange.unpacked(mine, "answer", dtype)
    return np.concatenate(got) if got else np.empty(0, dtype)


def _packed(hashes, values, ranges, chunk, kind, names):
    out = pa.Table.from_batches([exchange.pack(hashes, values, ranges, chunk)])
    for name in names:
        if name not in out.column_names:
            out = out.append_column(name, pa.nulls(len(out), pa.binary()))
    return out.append_column("kind", pa.array([kind] * len(out), pa.int32())).select(["kind", "part", "chunk", "hashes", *names])


def _ask_runs(ranges):
    def ask(key, table, answers):
        c = Chunk(table)
        chunk = key[0].as_py()
        _, inverse, _ = c.anchors()
        status = _told(answers, STATUS, np.uint8)[inverse] if len(c.anchor) else np.empty(0, np.uint8)
        first, _, _ = c.segments(np.flatnonzero(status == 1))
        names = ["doc", "at", "segment"]
        out = [_packed(c.anchor[first], {"doc": c.doc[first], "at": c.at[first], "segment": c.segment[first]}, ranges, chunk, WHOLE, names)]
        hot = np.flatnonzero(status == 2)
        if len(hot):
            h, doc, at, _ = c.strings(hot)
            order, new = _first_of(h, doc, at)
            order = order[new]
            out.append(_packed(h[order], {"doc": doc[order], "at": at[order]}, ranges, chunk, STRING, names))
        return pa.concat_tables(out)

    return ask


def _ask_bytes(ranges):
    def ask(key, table, answers):
        c = Chunk(table)
        _, inverse, _ = c.anchors()
        status = _told(answers, STATUS, np.uint8)[inverse] if len(c.anchor) else np.empty(0, np.uint8)
        first, _, _ = c.segments(np.flatnonzero(status == 1))
        first = first[_told(answers, WHOLE, np.uint8) == COMPARE]
        columns = np.empty((len(first), WIDTH), np.uint8)
        left, right = np.empty(len(first), np.uint8), np.empty(len(first), np.uint8)
        for r, own, mine in c.parts(first):
            columns[mine] = r.columns(own)
            left[mine], right[mine] = r.at[own] - r.low[own], r.at[own] - r.high[own]
        values = {"doc": c.doc[first], "at": c.at[first], "left": left, "right": right, "columns": columns}
        return _packed(c.anchor[first], values, ranges, key[0].as_py(), SEGMENT, list(values))

    return ask


def equal_strings(columns, left, right, group, rank):
    """covered[i, o]: the string of segment i that starts o bytes before its anchor also stands in a segment of its group of lower rank.

    Segments are sorted by group. Round by round, from the last column to the first, one symbol of each is inserted:
    a stable sort by (group, symbol) turns the order of the suffixes behind it into that of the longer ones, and the
    common prefix of two neighbours with one symbol is one more than the least of those between their old places.
    """
    n = len(group)
    covered = np.zeros((n, REACH + 1), bool)
    if n < 2:
        return covered
    order, common = np.arange(n), np.zeros(n, np.int16)
    levels = int(np.bincount(np.unique(group, return_inverse=True)[1]).max() - 1).bit_length()
    first, last = REACH - left.astype(np.int64), REACH - right.astype(np.int64) + LENGTH
    key0 = np.unique(group, return_inverse=True)[1].astype(np.int64) << 9
    for x in range(WIDTH - 1, -1, -1):
        inside = (x >= first) & (x < last)
        key = (key0 | np.where(inside, columns[:, x].astype(np.int64), 256))[order]
        move = np.argsort(key, kind="stable")
        key, order = key[move], order[move]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] & 511 < 256)) + 1
        fresh = np.zeros(n, np.int16)
        if len(same):
            # the least of common[a + 1 .. b], by tables of the least of 1, 2, 4, ... values
            a, b = move[same - 1] + 1, move[same]
            level = np.frexp(b - a + 1)[1] - 1
            least = np.empty(len(same), np.int16)
            table, size = common, 1
            for v in range(levels + 1):
                mine = np.flatnonzero(level == v)
                if len(mine):
                    least[mine] = np.minimum(table[a[mine]], table[b[mine] - size + 1])
                if 2 * size > n:
                    break
                table = np.minimum(table[:-size], table[size:])
                size *= 2
            fresh[same] = np.minimum(least + 1, LENGTH)
        common = fresh
        if x <= REACH:
            opens = np.flatnonzero(common < LENGTH)
            if len(opens) < n:
                r = rank[order]
                low = np.repeat(np.minimum.reduceat(r, opens), np.diff(np.concatenate([opens, [n]])))
                covered[order[r > low], REACH - x] = True
    return covered


def _replies(table, kind, back, at):
    return pa.table({"chunk": table.column("chunk"), "kind": pa.array([kind] * len(table), pa.int32()), "part": table.column("part"), "answer": pa.array([back[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())})


def _places(table):
    h, _, at = exchange.grouped(exchange.unpacked(table, "hashes", np.uint64))
    return h, np.concatenate(exchange.unpacked(table, "doc", np.int64)), np.concatenate(exchange.unpacked(table, "at", np.int64)), at


def _answer_runs(key, table):
    """Of whole segments, one of ALONE, LATER and COMPARE; of strings, whether an equal one comes earlier."""
    kind = key[0].as_py()
    h, doc, place, at = _places(table)
    back = np.zeros(len(h), np.uint8)
    if kind == STRING:
        order, new = _first_of(h, doc, place)
        head = order[new][np.cumsum(new) - 1]
        back[order] = (doc[order] != doc[head]) | (place[order] != place[head])
    else:
        segment = np.concatenate(exchange.unpacked(table, "segment", np.uint64))
        order = np.lexsort((place, doc, segment, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (segment[order][1:] != segment[order][:-1])])
        head = order[new]
        _, group, size = np.unique(h[head], return_inverse=True, return_counts=True)
        of = np.cumsum(new) - 1
        tied = (doc[order] == doc[head[of]]) & (place[order] == place[head[of]])
        back[order] = np.where(tied, np.where(size[group] > 1, COMPARE, ALONE)[of], LATER)
    return _replies(table, kind, back, at)


def _answer_bytes(key, table):
    """The covered strings of each segment, a bit each."""
    h, doc, place, at = _places(table)
    rank = np.unique(np.stack([doc, place]), axis=1, return_inverse=True)[1].reshape(-1)
    left, right = (np.concatenate(exchange.unpacked(table, x, np.uint8)) for x in ("left", "right"))
    columns = np.concatenate(exchange.unpacked(table, "columns", np.uint8, WIDTH))
    order = np.argsort(h, kind="stable")
    cover = np.empty((len(h), REACH + 1), bool)
    cover[order] = equal_strings(columns[order], left[order], right[order], h[order], rank[order])
    return _replies(table, SEGMENT, np.packbits(cover, axis=1), at)


def _mark(c: Chunk, answers):
    """For each slice, which of its bytes start a covered string."""
    marks = {id(r): np.zeros(len(r.data) + 1, np.int32) for _, r in c.slices}
    if not len(c.anchor):
        return marks

    def put(r, starts):
        d = marks[id(r)]
        np.add.at(d, starts, 1)
        np.add.at(d, starts + LENGTH, -1)

    _, inverse, _ = c.anchors()
    status = _told(answers, STATUS, np.uint8)[inverse]
    first, order, group = c.segments(np.flatnonzero(status == 1))
    code = _told(answers, WHOLE, np.uint8)
    cover = np.unpackbits(_told(answers, SEGMENT, np.uint8).reshape(-1, PACKED), axis=1, count=REACH + 1).astype(bool)
    if len(first):
        head = first[group]
        tie = (c.doc[order] == c.doc[head]) & (c.at[order] == c.at[head])
        later = order[~tie | (code[group] == LATER)]
        for r, own, _ in c.parts(later):
            size = r.high[own] - r.low[own] + 1
            if len(own):
                put(r, np.repeat(r.low[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
        # Runs that tie with the first (rows of one doc_id) share its answer.
        compared = np.cumsum(code == COMPARE) - 1
        tie &= code[group] == COMPARE
        tied, answer = order[tie], compared[group[tie]]
        for r, own, mine in c.parts(tied):
            i, o = np.nonzero(cover[answer[mine]])
            put(r, r.at[own][i] - o)
    hot = np.flatnonzero(status == 2)
    if len(hot):
        h, doc, at, where = c.strings(hot)
        order, new = _first_of(h, doc, at)
        group = np.cumsum(new) - 1
        head = order[new][group]
        covered = np.zeros(len(h), bool)
        covered[order] = (doc[order] != doc[head]) | (at[order] != at[head]) | (_told(answers, STRING, np.uint8)[group] > 0)
        base = 0
        for r, start in where:
            put(r, start[covered[base : base + len(start)]])
            base += len(start)
    return marks


def _covered(key, table, answers):
    """(row, data, offs, covered) summed up: n_bytes, n_removed, n_spans and the kept bytes' digest of each document."""
    c = Chunk(table)
    marks = _mark(c, answers)
    n, removed, spans, digest, kept = [], [], [], [], []
    for _, r in c.slices:
        gone = np.cumsum(marks[id(r)][:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = r.offs[:-1][r.offs[:-1] < len(gone)]
        opens[edge] = gone[edge]
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[r.offs])
        n += np.diff(r.offs).tolist()
        removed += sums(gone).tolist()
        spans += sums(opens).tolist()
        for a, z, k in zip(r.offs[:-1], r.offs[1:], removed[-(len(r.offs) - 1) :]):
            left = r.data[a:z].tobytes() if not k else r.data[a:z][~gone[a:z]].tobytes()
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
    return n, removed, spans, digest, kept


def _digest(key, table, answers):
    n, removed, spans, digest, _ = _covered(key, table, answers)
    return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def _texts(key, table, answers):
    """The kept bytes as text; a character of which a part was removed goes as a whole."""
    kept = _covered(key, table, answers)[4]
    return pa.table({"doc_id": table.column("doc_id"), "text": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())})


def _passes(docs: DataFrame, last, schema):
    x = docs.select("doc_id", "text")
    chunks = exchange.chunk_count(x)
    ranges = max(16, chunks // 2)
    x = store.bucketed(exchange.in_chunks(x, chunks), "chunks", "chunk", min(chunks, 10_000))
    asked, reply = "kind int, part int, chunk int, hashes binary", "chunk int, kind int, part int, answer binary"
    anchors = x.groupBy("chunk").applyInArrow(_ask_anchors(ranges), "part int, chunk int, hashes binary, n binary")
    told = store.written(anchors.groupBy("part").applyInArrow(_answer_anchors, reply), "anchors")
    runs = x.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask_runs(ranges), asked + ", doc binary, at binary, segment binary")
    told = told.unionByName(store.written(runs.groupBy("kind", "part").applyInArrow(_answer_runs, reply), "runs"))
    whole = x.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_ask_bytes(ranges), asked + ", doc binary, at binary, left binary, right binary, columns binary")
    told = told.unionByName(whole.groupBy("part").applyInArrow(_answer_bytes, reply))
    return x.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(last, schema(x))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Texts are UTF-8 bytes, null as empty; strings don't cross documents. A byte is removed if a LENGTH-byte string
    that covers it also starts earlier: in a smaller doc_id, or earlier in the same document. A null doc_id comes
    last. Rows of one doc_id count as one place: at equal starts neither is earlier. Texts shorter than LENGTH lose
    nothing. An empty table gives an empty table; other columns are ignored.
    """
    return _passes(docs, _digest, lambda x: x.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit("").alias("kept_sha256")).schema)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left of every document."""
    return _passes(docs, _texts, lambda x: x.select("doc_id", "text").schema)
