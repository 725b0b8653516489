"""Language-model scoring by a hidden Markov model over words.

The hidden states emit word classes, by a word's first and last letters; inside its class a word has its smoothed
count. Baum-Welch counts are gathered from all training texts in every round; scores are the exact likelihoods of
whole texts by the scaled forward recursion.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import exchange, store, textkit

U = np.uint64
#: Word classes at least; the end of a text is one more. Their number is a power of two and grows as the root of the training words' spellings.
CLASSES, SPREAD = 4096, 16
STATES = 8
#: Tokens of a block: the states on both sides of a cut come from the product of the blocks' matrices.
BLOCK = 1024
#: Steps between scalings of the states: emissions are smoothed, so that a few of their products are far from the least double.
SCALE = 8
#: Bytes of packed hashes of spellings (4 a token) that are worked on side by side.
SLICE = 6 << 20
#: Expected counts are summed as whole multiples of this, so that the order of summing changes nothing.
UNIT = 1 << 20
#: Rows of counts that travel as one value.
PACK = 256


def keys(data, offs):
    """(word hashes, hashes of spellings, first) with one end token after each text's words; the end's hashes are 0.

    A spelling is a word's first byte and its last three; 32 bits of its hash are kept, so that no round hashes again.
    """
    starts, ends, h, first = textkit.words(data, offs)
    n, docs = len(h), len(offs) - 1
    if n:
        low = textkit.LOWER[data].astype(np.uint64)
        size = ends - starts
        c = low[starts] * U(1 << 24)
        for i in range(1, 4):
            c = c + np.where(size >= i, low[np.maximum(ends - i, 0)], U(0)) * U(1 << 8 * (3 - i))
    else:
        c = np.empty(0, np.uint64)
    first = first + np.arange(docs + 1)
    out_h, out_c = np.zeros(n + docs, np.uint64), np.zeros(n + docs, np.uint32)
    word = np.ones(n + docs, bool)
    word[first[1:] - 1] = False
    out_h[word], out_c[word] = np.where(h == 0, U(1), h), textkit.mix(c) & U(0xFFFFFFFF)
    return out_h, out_c, first


def classes_of(spellings, first, size):
    """The class of each word of texts, by the low bits of its spelling's hash; that of a text's end is `size`, a power of two."""
    out = (spellings & np.uint32(size - 1)).astype(np.int32)
    out[first[1:] - 1] = size
    return out


def tokens(data, offs, size=CLASSES):
    """(word hashes, classes, first) with one end token after each text's words; the end's hash is 0."""
    h, spellings, first = keys(data, offs)
    return h, classes_of(spellings, first, size), first


def blocks(classes, first):
    """(starts, lengths, text, place in the text, those that open a text, of these and of the others those that don't end it) of the blocks.

    Blocks that open a text come first; in both parts those that don't end their text do, all of them whole, and lengths fall.
    """
    count = np.diff(first)
    each = -(-count // BLOCK)
    doc = np.repeat(np.arange(len(count)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    start = first[:-1][doc] + nth * BLOCK
    size = np.minimum(BLOCK, first[1:][doc] - start)
    ends = nth == each[doc] - 1
    order = np.lexsort((-size, ends, nth > 0))
    opening, whole = nth == 0, ~ends
    return start[order], size[order], doc[order], nth[order], int(opening.sum()), int((opening & whole).sum()), int((~opening & whole).sum())


class Model:
    def __init__(self, start, trans, emit):
        self.start, self.trans, self.emit = start, trans, emit

    @classmethod
    def initial(cls, base, seed=11):
        """Sticky states, each with the classes' counts over all training texts disturbed at random."""
        r = np.random.default_rng(seed)
        emit = (base + 0.1) * r.gamma(1.0, 1.0, (STATES, len(base)))
        trans = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(trans, 0.9)
        return cls(np.full(STATES, 1 / STATES), trans, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start, trans, emit):
        """Maximum-likelihood steps with light smoothing; emissions lean on the classes' overall counts."""
        base = emit.sum(0) + 0.5
        base = base / base.sum()
        emit = emit + 20.0 * base
        return cls((start + 0.1) / (start + 0.1).sum(), (trans + 0.1) / (trans + 0.1).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def products(self, emit, classes, at):
        """The matrix of each whole block, from the state before it to that of its last token, up to a factor."""
        s, n = STATES, len(at)
        x, y = np.empty((s, n, s)), np.empty((s, n, s))  # by the state before, the block, the state after: a step's emissions lie alike for all states before
        np.multiply(self.trans[:, None, :], emit[classes[at]], out=x)
        for t in range(1, BLOCK):
            np.matmul(x.reshape(-1, s), self.trans, out=y.reshape(-1, s))
            np.multiply(y, emit[classes[at + t]], out=x)
            if t % 8 == 0:
                x /= x.max((0, 2))[:, None]
        return np.ascontiguousarray((x / x.max((0, 2))[:, None]).transpose(1, 0, 2))

    def step_through(self, emit, by_step, live, edge, entry, a, z):
        """The scaled forward recursion over the blocks of one part, in step; entry is what each block's first token has from before."""
        one, room = np.ones(STATES), np.empty((live[0], STATES))
        for t in range(len(live) - 1):
            x, e = a[edge[t] : edge[t + 1]], room[: live[t]]
            if t:
                np.matmul(a[edge[t - 1] : edge[t - 1] + live[t]], self.trans, out=x)
            else:
                x[:] = entry
            np.take(emit, by_step[edge[t] : edge[t + 1]], axis=0, out=e, mode="clip")
            x *= e
            ending = 0 if t % SCALE == 0 else live[t + 1]
            if ending < live[t]:
                w = np.dot(x[ending:], one)
                z[edge[t] + ending : edge[t + 1]] = w
                x[ending:] /= w[:, None]

    def step_back(self, emit, by_step, live, edge, lo, hi, after, before, a, z, pairs):
        """The backward recursion over the blocks lo to hi of one part, given the likelihood after each and the states before each, if any.

        a becomes the states' probabilities, pairs gains the transitions' shares. The likelihood of each block by the state before it, up to a factor.
        """
        back, have = np.ascontiguousarray(self.trans.T), 0
        beta, room = np.empty((hi - lo, STATES)), np.empty((hi - lo, STATES))
        for t in range(len(live) - 2, -1, -1):
            m, p = min(live[t], hi) - lo, edge[t] + lo
            if m <= 0:
                continue
            x, w = a[p : p + m], room[:m]
            np.take(emit, by_step[p : p + m], axis=0, out=w, mode="clip")
            ending = 0 if t % SCALE == 0 else have
            if have < m:
                beta[have:m] = after[have:m] / (x[have:] * after[have:m]).sum(1, keepdims=True)
                have = m
            w *= beta[:m]
            if ending < m:
                w[ending:] /= z[p + ending : p + m, None]
            x *= beta[:m]
            if t:
                pairs += a[edge[t - 1] + lo : edge[t - 1] + lo + m].T @ w
            elif before is not None:
                pairs += before.T @ w
            np.matmul(w, back, out=beta[:m])
        return beta / beta.sum(1, keepdims=True)

    def forward(self, classes, first):
        """The scaled forward recursion of one slice of whole texts, token by token in step for all blocks of a part.

        The blocks that open a text go first; matrices of those inside it carry their states to where the others start, so
        the states before a block are exact. (blocks, parts, classes by step, emissions, scaled states, scales, spans and
        matrices of the inner blocks, states before the blocks); a part's tokens of step t are those from its edge to
        the next, in the order of its blocks. States are scaled at the steps that SCALE divides and at the last of each
        block; the other scales are 1.
        """
        found = at, size, doc, nth, opening, whole, inside = blocks(classes, first)
        emit = np.ascontiguousarray(self.emit.T)
        parts, done = [], 0
        by_step = np.empty(first[-1], np.intp)
        for lo, hi in ((0, opening), (opening, len(at))):
            live = np.searchsorted(-size[lo:hi], -np.arange(size[lo] + 1 if lo < hi else 1), "left")  # blocks longer than t
            edge = done + np.concatenate([[0], np.cumsum(live[:-1])])
            for t in range(len(live) - 1):
                by_step[edge[t] : edge[t + 1]] = classes[at[lo : lo + live[t]] + t]
            parts.append((live.tolist(), edge.tolist()))
            done = edge[-1]
        a, z = _room("a", done, STATES), _room("z", done, 1)[:, 0]
        z[:] = 1.0
        before, spans, x = np.zeros((len(at), STATES)), [], None
        (live, edge), others = parts
        self.step_through(emit, by_step, live, edge, self.start, a, z)
        if whole:
            v = np.empty((len(first) - 1, STATES))
            v[doc[:whole]] = a[edge[BLOCK - 1] : edge[BLOCK - 1] + whole]
            if inside:
                inner = opening + np.argsort(nth[opening : opening + inside], kind="stable")
                edges = np.flatnonzero(np.diff(nth[inner], prepend=0, append=-1))
                x = self.products(emit, classes, at[inner])
                spans = [(inner[i:k], x[i:k]) for i, k in zip(edges[:-1], edges[1:])]
            for i, x in spans:
                before[i] = v[doc[i]]
                w = np.einsum("nk,nkl->nl", v[doc[i]], x)
                v[doc[i]] = w / w.sum(1, keepdims=True)
            last = slice(opening + inside, len(at))
            before[last] = v[doc[last]]
            self.step_through(emit, by_step, *others, before[opening:] @ self.trans, a, z)
        return found, parts, by_step, emit, a, z, spans, before

    def counts(self, classes, first):
        """Expected counts (start, transitions, emissions) of one slice of whole texts; cuts into blocks change nothing.

        Backward, the blocks that end a longer text go first, and the matrices carry their likelihoods to the others.
        """
        s, width = STATES, self.emit.shape[1]
        out, pairs = np.zeros((s, width)), np.zeros((s, s))
        if len(first) < 2:
            return np.zeros(s), pairs, out
        (at, size, doc, nth, opening, whole, inside), parts, by_step, emit, a, z, spans, before = self.forward(classes, first)
        n = len(at)
        after = np.ones((n, s))
        if whole:
            last = slice(opening + inside, n)
            v = np.empty((len(first) - 1, s))
            v[doc[last]] = self.step_back(emit, by_step, *parts[1], inside, n - opening, after[last], before[last], a, z, pairs)
            for i, x in spans[::-1]:
                after[i] = v[doc[i]]
                w = np.einsum("nkl,nl->nk", x, v[doc[i]])
                v[doc[i]] = w / w.sum(1, keepdims=True)
            after[:whole] = v[doc[:whole]]
            if inside:
                inner = slice(opening, opening + inside)
                self.step_back(emit, by_step, *parts[1], 0, inside, after[inner], before[inner], a, z, pairs)
        self.step_back(emit, by_step, *parts[0], 0, opening, after[:opening], None, a, z, pairs)
        starts = a[:opening].sum(0)
        step = max(1 << 14, width)
        for i in range(0, len(by_step), step):
            for k, x in enumerate(np.ascontiguousarray(a[i : i + step].T)):
                out[k] += np.bincount(by_step[i : i + step], x, width)
        return starts, self.trans * pairs, out

    def log10(self, classes, first):
        """log10 likelihood of each whole text's classes: the scales of the forward recursion. A text's first token takes the start probabilities."""
        if len(first) < 2:
            return np.zeros(0)
        (at, _, doc, _, opening, _, _), parts, _, _, _, z, _, _ = self.forward(classes, first)
        logs, of_block = np.log10(z), np.zeros(len(at))
        for lo, (live, edge) in zip((0, opening), parts):
            for t in range(len(live) - 1):
                of_block[lo : lo + live[t]] += logs[edge[t] : edge[t + 1]]
        return np.bincount(doc, of_block, len(first) - 1)


_rooms = {}


def _room(name, n, width):
    """An uninitialised n x width array whose memory is used again; one larger than a slice asks for isn't kept."""
    if len(_rooms.get(name, ())) < n or _rooms[name].shape[1] != width:
        x = np.empty((max(n, SLICE // 4), width))
        if n > SLICE:
            return x[:n]
        _rooms[name] = x
    return _rooms[name][:n]


def held_out(doc_id, folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _packed(batches):
    for b in batches:
        for _, data, offs in textkit.slices(b.column(0)):
            _, spellings, first = keys(data, offs)
            values = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int32).tobytes()), pa.py_buffer(spellings.tobytes())])
            yield pa.RecordBatch.from_arrays([values], ["spellings"])


def _unpacked(batches):
    """(spellings, first) of slices of whole texts, as _packed wrote them."""
    for b in batches:
        for _, data, offs in textkit.slices(b.column(0), SLICE):
            yield np.frombuffer(data.tobytes(), np.uint32), offs // 4


def _spelt(batches):
    """(spelling, n) of a task's words; texts by -1."""
    found, n, texts = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for spellings, first in _unpacked(batches):
        word = np.ones(len(spellings), bool)
        word[first[1:] - 1] = False
        new, m = np.unique(spellings[word].astype(np.int64), return_counts=True)
        found, at = np.unique(np.concatenate([found, new]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, m]), len(found)).astype(np.int64)
        texts += len(first) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n, texts))], ["spelling", "n"])


def _summed(key, table):
    """The sum of a pack's counts over all tasks."""
    total = np.zeros(PACK * STATES, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"pack": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, rounds: int = 16) -> Model:
    """Baum-Welch, every round over all texts of docs; the counts of a round are summed inside tasks and then by Spark.

    There are as many classes as the power of two over SPREAD times the root of the number of distinct spellings,
    CLASSES at least. The first model is the classes' counts over all texts, disturbed by a fixed seed. A task's counts
    are rounded to 1 / UNIT, so texts dealt into other tasks may change the last digits of a model.
    """
    texts = store.written(docs.select("text").mapInArrow(_packed, "spellings binary"), "spellings")
    spelt = texts.mapInArrow(_spelt, "spelling long, n long").groupBy("spelling").agg(F.sum("n").alias("n")).toArrow()  # distinct spellings
    spelling, n = (spelt.column(c).to_numpy() for c in ("spelling", "n"))
    word = spelling >= 0
    size = max(CLASSES, 1 << int(SPREAD * word.sum() ** 0.5 - 1).bit_length() if word.any() else 0)
    base = np.zeros(size + 1)
    np.add.at(base, spelling[word] & (size - 1), n[word])
    base[size] = n[~word].sum()
    model = Model.initial(base)
    packs = -(-(size + 2 + STATES) // PACK)
    for _ in range(rounds):

        def expect(batches, model=model):
            total = None
            for spellings, first in _unpacked(batches):
                got = model.counts(classes_of(spellings, first, size), first)
                total = got if total is None else [x + y for x, y in zip(total, got)]
            if total is not None:
                start, trans, out = total
                # rows 0..size are emissions, then one for the starts and STATES for the transitions
                rows = np.zeros((packs * PACK, STATES), np.int64)
                rows[: size + 2 + STATES] = np.rint(np.concatenate([out.T, start[None], trans]) * UNIT)
                rows = rows.reshape(packs, -1)
                keep = np.flatnonzero(rows.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array([rows[i].tobytes() for i in keep], pa.binary())], ["pack", "counts"])

        got = texts.mapInArrow(expect, "pack long, counts binary").groupBy("pack").applyInArrow(_summed, "pack long, counts binary").toArrow()  # a row for each pack
        total = np.zeros((packs, PACK * STATES))
        for pack, counts in zip(got.column("pack").to_pylist(), got.column("counts")):
            total[pack] = np.frombuffer(counts.as_buffer(), np.int64) / UNIT
        total = total.reshape(-1, STATES)[: size + 2 + STATES]
        model = Model.of_counts(total[size + 1], total[size + 2 :], total[: size + 1].T)
    store.dropped(texts)
    return model


def _ask(ranges, size):
    def ask(key, table):
        hashes, classes, learn = [], [], []
        flags = table.column("held_out").to_numpy(zero_copy_only=False)
        for i, data, offs in textkit.slices(table.column("text")):
            h, c, first = tokens(data, offs, size)
            hashes.append(h)
            classes.append(c)
            learn.append(np.repeat(~flags[i : i + len(offs) - 1], np.diff(first)))
        h, c, t = np.concatenate(hashes), np.concatenate(classes), np.concatenate(learn)
        found, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, t, len(found)).astype(np.uint32)
        return pa.Table.from_batches([exchange.pack(found, {"classes": c[at].astype(np.uint32), "n": n}, ranges, key[0].as_py())])

    return ask


def _answer(key, table):
    """Counts for each chunk that asks, and this range's share of the vocabulary: for each class its words' counts plus one each."""
    asked = exchange.unpacked(table, "hashes", np.uint64)
    h, _, at = exchange.grouped(asked)
    n = np.concatenate(exchange.unpacked(table, "n", np.uint32)).astype(np.int64)
    classes = np.concatenate(exchange.unpacked(table, "classes", np.uint32))
    found, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, inverse, n)
    known = total > 0
    held, place = np.unique(classes[where][known], return_inverse=True)
    mass = np.bincount(place, total[known] + 1, len(held)).astype(np.int64)
    back = total[inverse]
    answers = [back[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]
    size = len(answers)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()),
            "part": pa.array([key[0].as_py()] * (size + 1), pa.int32()),
            "counts": pa.array([*answers, None], pa.binary()),
            "classes": pa.array([None] * size + [held.tolist()], pa.list_(pa.int64())),
            "mass": pa.array([None] * size + [mass.tolist()], pa.list_(pa.int64())),
            "types": pa.array([None] * size + [int(known.sum())], pa.int64()),
            "tokens": pa.array([None] * size + [int(total.sum())], pa.int64()),
        }
    )


def score(docs: DataFrame, rounds: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Null and wordless texts are the end token alone. Under a training set without texts nothing is known, and every
    text still gets a finite score. Repeated rows each get their row; a null doc_id is hashed as an empty text; other
    columns are ignored. score gives each word P(class | state) * (c + 1) / (the class's counts, one more for each of
    its words and one for unseen words), so all words of a class and one unseen word have a probability of 1.
    """
    x = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = train(x.filter(~F.col("held_out")).select("text"), rounds)
    size = model.emit.shape[1] - 1
    chunks = exchange.chunk_count(x)
    ranges = max(16, chunks // 4)
    x = exchange.in_chunks(x, chunks)
    asked = x.groupBy("chunk").applyInArrow(_ask(ranges, size), "part int, chunk int, hashes binary, classes binary, n binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "chunk int, part int, counts binary, classes array<long>, mass array<long>, types long, tokens long")
    answers = store.written(answers, "word-counts")
    vocabulary = answers.filter("chunk = -1")
    types, total = vocabulary.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    mass = np.ones(size + 1)  # the unseen word of each class
    for r in vocabulary.select(F.explode(F.arrays_zip("classes", "mass")).alias("x")).groupBy("x.classes").agg(F.sum("x.mass").alias("m")).collect():  # size rows at most
        mass[r.classes] += r.m

    def judge(key, table, counts):
        counts = counts.sort_by("part")
        c_of = np.concatenate(exchange.unpacked(counts, "counts", np.int64)) if len(counts) else np.empty(0, np.int64)
        parts = []
        all_h = []
        for i, data, offs in textkit.slices(table.column("text")):
            h, c, first = tokens(data, offs, size)
            parts.append((c, first))
            all_h.append(h)
        h = np.concatenate(all_h) if all_h else np.empty(0, np.uint64)
        _, inverse = np.unique(h, return_inverse=True)
        c_all = c_of[inverse]
        known, tokens_of, base, full, at = [], [], [], [], 0
        for c, first in parts:
            n = c_all[at : at + len(c)]
            at += len(c)
            sums = lambda v: np.add.reduceat(v, first[:-1])  # noqa: E731  every text has its end token
            known.append(sums((n > 0).astype(np.int64)))
            tokens_of.append(np.diff(first))
            base.append(sums(np.log10((n + 1) / (total + types + 1))))
            full.append(model.log10(c, first) + sums(np.log10((n + 1) / mass[c])))
        join = lambda v, t: pa.array(np.concatenate(v) if v else np.empty(0), t)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held_out"),
                "n_tokens": join(tokens_of, pa.int64()),
                "n_known": join(known, pa.int64()),
                "train_tokens": pa.array([total] * len(table), pa.int64()),
                "base_score": join(base, pa.float64()),
                "score": join(full, pa.float64()),
            }
        )

    schema = x.select("doc_id", "held_out", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    return x.groupBy("chunk").cogroup(answers.filter("chunk >= 0").select("chunk", "part", "counts").groupBy("chunk")).applyInArrow(judge, schema)
