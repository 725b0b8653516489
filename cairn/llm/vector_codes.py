"""Product quantisation of vectors in integers: codebooks by distributed Lloyd rounds, nearest entries by kd-trees.

A vector is cut into equal consecutive parts, and each part is coded by the nearest entry of its position's codebook.
All arithmetic is on integers, so codes, errors and codebooks don't depend on how rows are dealt to tasks.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import store

LONG = np.iinfo(np.int64).max
#: Rows that are looked up together.
SLICE = 1 << 14


class Tree:
    """A kd-tree over one codebook: nodes hold the box around their entries, leaves a few entries each."""

    def __init__(self, entries: np.ndarray, leaf: int = 2):
        self.entries, self.leaf, self.nodes = entries, leaf, []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, ids) -> int:
        own, points = len(self.nodes), self.entries[ids]
        low, high = points.min(axis=0), points.max(axis=0)
        self.nodes.append(None)
        spread = high - low
        if len(ids) <= self.leaf or not spread.any():
            self.nodes[own] = (low, high, None, None, np.sort(ids))
            return own
        axis = int(np.argmax(spread))
        order = ids[np.argsort(points[:, axis], kind="stable")]
        self.nodes[own] = (low, high, self._grow(order[: len(order) // 2]), self._grow(order[len(order) // 2 :]), None)
        return own

    def nearest(self, points: np.ndarray):
        """(index, squared distance) of the nearest entry of each point; equal distances go to the lower index."""
        best = np.full(len(points), len(self.entries), np.int64)
        far = np.full(len(points), -1, dtype=points.dtype)  # -1: nothing found yet
        self._visit(0, np.arange(len(points)), self._bound(0, points), points, best, far)
        return best, far

    def _bound(self, node: int, points):
        """The squared distance from each point to the node's box."""
        low, high = self.nodes[node][:2]
        gap = np.maximum(np.maximum(low - points, points - high), 0)
        return (gap * gap).sum(axis=1)

    def _visit(self, node: int, rows, bound, points, best, far):
        # A node as near as the best so far is visited too: it may hold an equal entry of a lower index.
        open_ = (far[rows] < 0) | (bound <= far[rows])
        rows = rows[open_]
        if not len(rows):
            return
        _, _, left, right, ids = self.nodes[node]
        if ids is not None:
            for i in ids:
                gap = points[rows] - self.entries[i]
                d = (gap * gap).sum(axis=1)
                better = (far[rows] < 0) | (d < far[rows]) | ((d == far[rows]) & (i < best[rows]))
                best[rows[better]], far[rows[better]] = i, d[better]
            return
        at_left, at_right = self._bound(left, points[rows]), self._bound(right, points[rows])
        nearer = np.asarray(at_left <= at_right, bool)
        for first, second, mine, bound_1, bound_2 in ((left, right, nearer, at_left, at_right), (right, left, ~nearer, at_right, at_left)):
            self._visit(first, rows[mine], bound_1[mine], points, best, far)
            self._visit(second, rows[mine], bound_2[mine], points, best, far)


def usable(vectors: pa.Array):
    """(rows, their components as a flat float64 array, their lengths): rows that are null, or hold null or non-finite components, are left out."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    bad = np.asarray(flat.is_null(), bool)
    values = np.asarray(flat.fill_null(0), np.float64)
    bad |= ~np.isfinite(values)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(vectors.is_valid(), bool)
    good[owner[bad]] = False
    return np.flatnonzero(good), values[good[owner]], lengths[good]


def integers(values: np.ndarray, lengths: np.ndarray, width: int, scale: int):
    """floor(scale * value) as rows of `width`, zeros behind shorter vectors; int64, or Python's integers where those are too narrow."""
    scaled = values * float(scale)
    if len(scaled) and not np.all(np.abs(scaled) < 2.0**30):
        from fractions import Fraction

        whole = np.array([math.floor(Fraction(float(v)) * scale) for v in values], dtype=object)
    else:
        whole = np.floor(scaled).astype(np.int64)
    out = np.zeros((len(lengths), width), whole.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def _narrow(points, codebooks, width: int):
    """Points and codebooks in int64 where no distance can leave it, else in Python's integers."""
    top = max((int(np.abs(x).max()) for x in (points, *codebooks) if x.size), default=0)
    kind = np.int64 if 4 * top * top * max(width, 1) <= LONG else object
    return points.astype(kind), [c.astype(kind) for c in codebooks]


class Model:
    """The codebooks of all part positions: integer arrays of (entries, part width)."""

    def __init__(self, codebooks: list, width: int, scale: int):
        self.codebooks, self.width, self.scale = codebooks, width, scale

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for c in self.codebooks for x in c.ravel()).encode()).hexdigest()

    def decoded(self, code: str) -> list:
        """The vector that a code stands for."""
        at = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
        return [int(x) / self.scale for c, i in zip(self.codebooks, at) for x in c[i]]


def _assigned(vectors: pa.Array, model: Model, trees: list):
    """(rows, points, index and squared distance for each part) of an Arrow array of vectors, in slices."""
    rows, values, lengths = usable(vectors)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    cached = {}
    for s in range(0, len(rows), SLICE):
        e = min(s + SLICE, len(rows))
        points = integers(values[starts[s] : starts[e]], lengths[s:e], model.width, model.scale)
        points, books = _narrow(points, model.codebooks, model.width)
        if points.dtype not in cached:
            cached[points.dtype] = trees if points.dtype == trees[0].entries.dtype else [Tree(c) for c in books]
        step = model.width // len(books)
        found = [t.nearest(points[:, p * step : (p + 1) * step]) for p, t in enumerate(cached[points.dtype])]
        yield rows[s:e], points, found


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding", key: str = "vec_id") -> Model | None:
    """Codebooks after `rounds` rounds over all usable vectors; None if there are none.

    They start as the parts of the first `entries` vectors by key, null keys last, equal keys by their vectors; fewer
    rows give fewer entries. Vectors of different lengths, and lengths that `parts` does not divide, count as filled
    with zeros at their end. In a round each task adds up its parts by entry, Spark adds the tasks' sums, and the
    driver gets one row for each component of the codebooks. Sums are decimals of 38 digits.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits a part")
    x = vectors.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    first = [r.v for r in x.filter(good).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return None
    longest = x.filter(good).agg(F.max(F.size("v"))).first()[0]
    width = -(-longest // parts) * parts
    start = integers(np.array([c for v in first for c in v], np.float64), np.array([len(v) for v in first]), width, scale)
    step = width // parts
    model = Model([start[:, p * step : (p + 1) * step] for p in range(parts)], width, scale)
    for _ in range(rounds):
        model = _round(x.select("v"), model)
    return model


def _round(vectors: DataFrame, model: Model) -> Model:
    """Every part assigned by the trees of the round, which are broadcast, and every entry moved to the floor of its parts' mean."""
    spark = vectors.sparkSession
    trees = spark.sparkContext.broadcast([Tree(c) for c in model.codebooks])
    entries, step = len(model.codebooks[0]), model.width // len(model.codebooks)

    def sums(batches):
        count = np.zeros((len(model.codebooks), entries), np.int64)
        total = np.zeros((len(model.codebooks), entries, step), object)
        for b in batches:
            for _, points, found in _assigned(b.column(0), model, trees.value):
                for p, (best, _) in enumerate(found):
                    part = points[:, p * step : (p + 1) * step]
                    # A slice's sums fit int64: its components are below 2 ** 30 there, or Python's integers.
                    own = np.zeros((entries, step), part.dtype)
                    np.add.at(own, best, part)
                    total[p] += own.astype(object)
                    count[p] += np.bincount(best, minlength=entries)
        p, i = np.nonzero(count)
        at = np.repeat(np.arange(len(p)), step)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[at], pa.int32()), pa.array(i[at], pa.int32()), pa.array(np.tile(np.arange(step), len(p)), pa.int32()), pa.array(count[p, i][at], pa.int64()), pa.array([str(v) for v in total[p, i].ravel()], pa.string())],
            ["part", "entry", "place", "n", "total"],
        )

    found = vectors.mapInArrow(sums, "part int, entry int, place int, n long, total string").groupBy("part", "entry", "place")
    books = [c.astype(object) for c in model.codebooks]
    for r in found.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        books[r.part][r.entry, r.place] = int(r.total) // r.n
    trees.unpersist()
    small = all(abs(int(v)) < 2**30 for c in books for v in c.ravel())
    return Model([c.astype(np.int64) if small else c for c in books], model.width, model.scale)


def encoded(vectors: DataFrame, model: Model | None, vector: str = "embedding") -> DataFrame:
    """vectors, all columns but the vector, with `code` and `error` in the struct `coded`; unusable vectors are left out.

    error is the squared distance in integers; one beyond a long is given as the largest long.
    """
    others = [c for c in vectors.columns if c != vector]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    x = vectors.select(row.alias("row"), F.col(f"`{vector}`").alias("v"))
    if model is None:
        return x.filter("false").select("row", F.struct(F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).alias("coded"))
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(c) for c in model.codebooks])

    def run(batches):
        names = np.array([f"{i:02x}" for i in range(256)])
        for b in batches:
            for rows, _, found in _assigned(b.column(1), model, trees.value):
                codes = ["".join(r) for r in names[np.stack([best for best, _ in found], axis=1)].tolist()]
                errors = [min(int(v), int(LONG)) for v in sum(far for _, far in found)]
                coded = pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), coded], ["row", "coded"])

    schema = x.select("row", F.struct(F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).alias("coded")).schema
    return x.mapInArrow(run, schema)


def code_digest(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, salts: int = 64) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row of vectors(vec_id, embedding, label).

    label_error adds the errors of equal labels, null labels together. Rows of one label are spread over `salts` keys
    when they get its sum, as one label may hold a third of all rows. Repeated rows count as often as they stand there,
    null keys stay, other columns are ignored, an empty table gives an empty table.
    """
    model = train(vectors, parts, entries, rounds, scale)
    x = encoded(vectors.select("vec_id", "embedding", "label"), model)
    x = store.written(x.select("row.vec_id", "row.label", "coded.code", "coded.error"), "vector-codes")
    sums = x.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(int(LONG))).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    x = x.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    both = x.join(sums, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_own") == F.col("_salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(model.digest() if model else None).cast("string").alias("codebooks_sha256"))
