"""Ranges around ranges, by a sweep over rows sorted by (key, start, longest first).

The sorted rows are cut into partitions anywhere, also inside a key. What is open where a partition ends (the ranges that
later rows may still lie in) is handed to the partitions that begin before it closes, so a key of any size is swept by
many tasks. Work follows the rows, the ranges open at the cuts, and what is given out; no two ranges are paired to be
compared. Rows ride through the sweep whole, so nothing that it gives out is shuffled or joined again, and it is given out in
batches of bounded size. Where every pair is asked for, pieces of the rows are swept at once, and pairs leave as lists of rows and of
ranges that all meet, parted in the same task in an order that Parquet's runs and pages hold in little room. Whether a range lies in any other, or holds any, takes no sweep: a least end so far, by windows.
Ranges may cross. Both ends belong to a range, as in containment of (start, end) pairs.
"""

from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.recovery import kept

#: Outer ranges in a batch and in a row that a sweep gives out, and rows from which a key is cut for windows.
BATCH, LISTED, LARGE = 1 << 16, 1 << 12, 250_000
#: Rows that are swept at once for pairs, and what the lengths of repeated lists are multiples of.
PIECE, EVEN = 1 << 10, 8
#: Into how many buckets keys are hashed to see whether any can be large.
BUCKETS = 1 << 16


class Nearest:
    """Open ranges of which one may still be the shortest around a later range: (length, start, id) rises with the end."""

    def __init__(self, ids):
        self.ranks, self.ends = [], []

    def add(self, start, end, i):
        rank = (end - start, start, i)
        at = bisect_left(self.ranks, rank)
        if at and self.ends[at - 1] >= end or at < len(self.ranks) and self.ranks[at] == rank:
            return
        upto = at
        while upto < len(self.ends) and self.ends[upto] <= end:
            upto += 1
        self.ranks[at:upto], self.ends[at:upto] = [rank], [end]

    def around(self, start, end, asking=None):
        """The id of the shortest open range that reaches to `end`; of equals the first by start, then id."""
        at = bisect_left(self.ends, end)
        return [self.ranks[at][2]] if at < len(self.ends) else []

    def open(self, start):
        return [(r[1], e, r[2]) for r, e in zip(self.ranks, self.ends) if e >= start]


class Every:
    """All open ranges, by end; ids is what holds them, an array where they are numbers."""

    def __init__(self, ids):
        self.ends, self.starts, self.ids = [], array("q"), ids()

    def add(self, start, end, i):
        at = bisect_right(self.ends, end)
        self.ends.insert(at, end)
        self.starts.insert(at, start)
        if i is None and isinstance(self.ids, array):
            self.ids = list(self.ids)
        self.ids.insert(at, i)

    def around(self, start, end, asking=None):
        """The ids of all open ranges that reach to `end`."""
        gone = bisect_left(self.ends, start)
        if gone:
            del self.ends[:gone], self.starts[:gone], self.ids[:gone]
        return self.ids[bisect_left(self.ends, end) :]

    def open(self, start):
        return [(s, e, i) for s, e, i in zip(self.starts, self.ends, self.ids) if e >= start]


class Listed(Every):
    """All open ranges with their kind, a number, as id; what is around a range is (start, -end, kind) of each in that order, one behind another."""

    def __init__(self, ids):
        super().__init__(ids)
        self.last = {}

    def add(self, start, end, i):
        super().add(start, end, i)
        self.last.clear()

    def around(self, start, end, asking=None):
        if self.ends and self.ends[0] < start:
            self.last.clear()
            super().around(start, end)
        at = bisect_left(self.ends, end)
        # Neighbours mostly lie in the same ranges; the lists are kept until the open ranges change.
        if at not in self.last:
            self.last[at] = array("q", [v for r in sorted(zip(self.starts[at:], [-e for e in self.ends[at:]], self.ids[at:])) for v in r])
        return self.last[at]


class Unmet:
    """Open ranges that no asking range has met yet, by their names; an id is (id, names), and each is given out once."""

    def __init__(self, ids):
        self.groups = {}

    def add(self, start, end, i):
        ends, held = self.groups.setdefault(frozenset(n for n in i["names"] if n is not None), ([], []))
        at = bisect_right(ends, end)
        ends.insert(at, end)
        held.insert(at, (start, i))

    def around(self, start, end, asking=None):
        """The ids of the open ranges that reach to `end` and share no name with the asking one."""
        out, names = [], (asking or {}).get("names") or ()
        for own in [*self.groups]:
            if not own.isdisjoint(names):
                continue
            ends, held = self.groups[own]
            at = bisect_left(ends, end)
            out.extend(i for _, i in held[at:])
            gone = bisect_left(ends, start, 0, at)
            ends[:], held[:] = ends[gone:at], held[gone:at]
            if not ends:
                del self.groups[own]
        return out

    def open(self, start):
        return [(s, e, i) for ends, held in self.groups.values() for e, (s, i) in zip(ends, held) if e >= start]


def _values(column):
    """What a column holds, as Python's values; numbers without nulls by way of one array, which takes a tenth of the time."""
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _holder(kind):
    return (lambda: array("q")) if pa.types.is_integer(kind) else list


def _left_open(state, batches):
    """The ranges that are open behind the last row of a partition."""
    key = pid = last = now = schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field(c) for c in ("key", "start", "end", "id", "pid")])
        for k, s, e, i, p in zip(*[_values(batch.column(c)) for c in ("key", "start", "end", "id", "pid")]):
            if now is None or k != key:
                now = state(_holder(schema.field("id").type))
            now.add(s, e, i)
            key, pid, last = k, p, s
    found = now.open(last) if now else []
    n = len(found)
    if n:
        s, e, i = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([key] * n, s, e, i, [pid] * n), schema)], schema=schema)


def _swept(state, batches, strict, whole, schema):
    """A row of (row, outers) for each row that asks; unless they are to be whole, lists of over LISTED outers are given out in several, and empty ones not at all."""
    key = pid = now = None
    later, place = [], None
    ids = _holder(schema.field("outers").type.value_type)
    for batch in batches:
        rows, at, ends, outers = batch.column("row"), [], [0], ids()

        def given():
            values = np.frombuffer(outers, np.int64) if isinstance(outers, array) else outers
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, schema.field("outers").type.value_type))
            return pa.RecordBatch.from_arrays([rows.take(pa.array(at, pa.int64())), listed.cast(schema.field("outers").type)], schema=schema)

        for n, (p, k, s, e, i, asks, holds) in enumerate(zip(*[_values(batch.column(c)) for c in ("pid", "key", "start", "end", "id", "asks", "holds")])):
            if now is None or k != key or p != pid:
                now, key, pid, later, place = state(ids), k, p, [], None
            if (s, e) != place:
                # Of strict containment, ranges of one place are no part: they are added once the place is left.
                for x in later:
                    now.add(*x)
                later, place = [], (s, e)
            if holds and strict and asks is not None:
                later.append((s, e, i))
            elif holds:
                now.add(s, e, i)
            if asks:
                found = now.around(s, e, i)
                if not found and not whole:
                    continue
                for some in (found,) if whole or len(found) <= LISTED else (found[first : first + LISTED] for first in range(0, len(found), LISTED)):
                    if isinstance(outers, array) and isinstance(some, list) and None in some:
                        outers = list(outers)
                    outers.extend(some)
                    at.append(n)
                    ends.append(len(outers))
                    if len(outers) >= BATCH:
                        yield given()
                        at, ends, outers = [], [0], ids()
        if at:
            yield given()


def _spread(counts):
    """For each count its place among counts and 0, 1, ... as often as it says, one behind another."""
    before = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(before, counts)


def _parted(low, high, rows, first):
    """(first open range, their number, first row, their number) of low to high with `rows` rows from `first` on, in parts of LISTED pairs at most."""
    step = np.maximum(1, LISTED // np.maximum(1, rows))
    of, part = _spread(np.where(rows > 0, -((low - high) // step), 0))
    at = low[of] + part * step[of]
    return at, np.minimum(step[of], high[of] - at), first[of], rows[of]


def _meetings(ends, asked):
    """Open ranges and rows every two of which meet, as _parted gives them, of places in ends and asked, both rising; each pair in which the first is no less than the second is in one.

    The rows within a range are the first ones of asked. Up to a multiple of EVEN they are given out range by range, so a range
    stays while the same list of rows comes again and again, at the same bits of Parquet's packed groups of eight; the few
    others row by row.
    """
    within = np.searchsorted(asked, ends, side="right")
    evens = within // EVEN
    low = np.append(0, np.flatnonzero(np.diff(evens)) + 1)
    yield _parted(low, np.append(low[1:], len(ends)), evens[low] * EVEN, np.zeros_like(low))
    row = np.arange(len(asked))
    low, high = np.searchsorted(within, row, side="right"), np.searchsorted(evens, row // EVEN, side="right")
    some = np.flatnonzero(low < high)
    yield _parted(low[some], high[some], np.ones_like(some), some)


def _paired(batches, strict, schema):
    """(rows, outers): lists of rows that ask and of ids of ranges, each of which lies around each of the rows; every pair is in one row, which holds LISTED or PIECE pairs at most."""
    none = np.empty(0, np.int64)
    starts, ends, ids = none, none, None
    last = place = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, pid, own = (batch.column(c) for c in ("key", "pid", "id"))
        s, e = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        asks, holds = (pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False) for c in ("asks", "holds"))
        ids = own.slice(0, 0) if ids is None else ids

        def given(parts, i, o, of):
            o_at, o_n, i_at, i_n = parts
            cuts = np.flatnonzero(np.diff(np.cumsum(i_n + o_n) // BATCH)) + 1
            for part in np.split(np.arange(len(i_n)), cuts):
                lists = []
                for at, n, x, values in ((i_at[part], i_n[part], i, batch.column("row")), (o_at[part], o_n[part], o, of)):
                    by, place = _spread(n)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values.take(pa.array(x[at[by] + place]))))
                if len(part):
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(lists, schema)], schema=schema)

        # Whether a row begins a key, and a place.
        turns = pc.or_(*[pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (key, pid)]).to_numpy(zero_copy_only=False)
        turns = np.append((pid[0].as_py(), key[0].as_py()) != last, turns).astype(bool)
        fresh = turns | np.append((s[0], e[0]) != place, (s[1:] != s[:-1]) | (e[1:] != e[:-1]))
        bounds = np.append(np.flatnonzero(fresh), n)
        low = 0
        while low < n:
            # Pieces end where places do, but within places of over PIECE rows; what is left of a place is a piece of its own.
            next_, upto = np.searchsorted(bounds, [low, low + PIECE], side="right")
            high = min(low + PIECE, int(bounds[next_ if not fresh[low] else max(next_, upto - 1)]))
            group = np.cumsum(turns[low:high]) - turns[low]
            a, h = np.flatnonzero(asks[low:high]), np.flatnonzero(holds[low:high])
            if turns[low]:
                starts, ends, ids = none, none, own.slice(0, 0)
            first = a[group[a] == 0] + low
            if len(first) and len(ends):
                first = first[np.argsort(e[first], kind="stable")]
                # Of strict containment, ranges of one place are no part.
                some = np.flatnonzero((starts != s[low]) | (ends != e[low])) if strict and not fresh[low] else np.arange(len(ends))
                for parts in _meetings(ends[some], e[first]) if len(some) else ():
                    yield from given(parts, first, some, ids)
            a, h, of = a + low, h + low, group[h]
            if len(a) and len(h):
                around = (of[:, None] == group[a - low]) & (s[h][:, None] <= s[a]) & (e[h][:, None] >= e[a])
                if strict:
                    around &= (s[h][:, None] != s[a]) | (e[h][:, None] != e[a])
                o, i = np.nonzero(around)
                held, at, rows = np.unique(o, return_index=True, return_counts=True)
                yield from given((held, np.ones_like(held), at, rows), a[i], h, own)
            h = h[of == group[-1]]
            if group[-1]:
                starts, ends, ids = none, none, own.slice(0, 0)
            starts, ends, ids = np.append(starts, s[h]), np.append(ends, e[h]), pa.concat_arrays([ids, own.take(pa.array(h))])
            still = np.argsort(ends, kind="stable")
            still = still[np.searchsorted(ends, s[high - 1], sorter=still) :]
            starts, ends, ids = starts[still], ends[still], ids.take(pa.array(still))
            low = high
        last, place = (pid[n - 1].as_py(), key[n - 1].as_py()), (s[n - 1], e[n - 1])


def _proper(x: DataFrame, key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").isNotNull() & (F.col("start") <= F.col("end")), F.lit(False))


def _dealt(inner: DataFrame, outer: DataFrame, key: str, state, columns: list[str], by: Column | None = None) -> DataFrame:
    """The proper rows of inner and outer, sorted and cut into partitions, with what is open where each begins; the columns of inner ride in `row`."""
    place = [F.col(f"`{key}`").alias("key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    kind = outer.schema["id"].dataType
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    asking = inner.filter(_proper(inner, key)).select(*place, (F.lit(None).cast(kind) if by is None else by).alias("id"), row.alias("row"), F.lit(True).alias("asks"), F.lit(False).alias("holds"))
    holding = outer.filter(_proper(outer, key)).select(*place, "id")
    # Of equal ranges the nearest is that of the least id; rows of one place then are few, and can stay together.
    holding = holding.groupBy("key", "start", "end").agg(F.min("id").alias("id")) if state is Nearest else holding if state is Listed else holding.distinct()
    holding = holding.select("key", "start", "end", "id", F.lit(None).cast(asking.schema["row"].dataType).alias("row"), F.lit(False).alias("asks"), F.lit(True).alias("holds"))
    order = ["pid", "key", "start", F.desc("end"), F.desc("holds"), "id"]
    parts = int(outer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asking.unionByName(holding).repartitionByRange(parts, "key", "start", F.desc("end"))
    rows = kept(rows.withColumn("pid", F.spark_partition_id()))
    firsts = rows.groupBy("pid").agg(F.min(F.struct("key", "start")).alias("first")).select(F.col("pid").alias("next"), F.col("first.key").alias("_key"), F.col("first.start").alias("_start"))  # a row for each partition
    opened = rows.filter("holds").select("key", "start", "end", "id", "pid", "holds")
    if state is Every:
        # What is open at the end of a partition needs no order: the ranges of its last key that reach to its last start.
        lasts = rows.groupBy("pid").agg(F.max(F.struct("key", "start")).alias("last")).select(F.col("pid").alias("_pid"), F.col("last.key").alias("_last"), F.col("last.start").alias("_from"))  # a row for each partition
        opened = opened.join(F.broadcast(lasts), (F.col("pid") == F.col("_pid")) & (F.col("key") == F.col("_last")) & (F.col("end") >= F.col("_from"))).select("key", "start", "end", "id", "pid")
    else:
        opened = opened.sortWithinPartitions(*order).drop("holds")
        opened = opened.mapInArrow(lambda b: _left_open(state, b), opened.schema)
    carried = opened.join(F.broadcast(firsts), (F.col("key") == F.col("_key")) & (F.col("next") > F.col("pid")) & (F.col("end") >= F.col("_start")))
    carried = carried.select(F.col("next").alias("pid"), "key", "start", "end", "id", F.lit(None).cast("boolean").alias("asks"), F.lit(True).alias("holds"))
    return rows.unionByName(carried, allowMissingColumns=True).repartitionById(parts, F.col("pid")).sortWithinPartitions(*order)


def _around(inner: DataFrame, outer: DataFrame, key: str, state, strict: bool, whole: bool, by: Column | None = None) -> DataFrame:
    """(row, outers): the proper rows of inner(key, start, end, ...) as structs, with what the state gives of outer(key, start, end, id); `by` is what the state is asked with, of the type of ids."""
    every = _dealt(inner, outer, key, state, inner.columns, by)
    out = every.select("row", F.array("id").alias("outers"))
    arrow = out.limit(0).toArrow().schema
    return every.mapInArrow(lambda b: _swept(state, b, strict, whole, arrow), out.schema)


def smallest_around(inner: DataFrame, outer: DataFrame, key: str, name: str, strict: bool = False) -> DataFrame:
    """inner(key, start, end, ...) with `name`: the id of the shortest range of outer(key, start, end, id) around each, null if there is none.

    Ties go to the first by start, then id. strict leaves out ranges equal to the inner one. Rows with a null key or place,
    or that end before they start, lie in nothing and hold nothing.
    """
    found = _around(inner, outer, key, Nearest, strict, True).select("row.*", F.try_element_at("outers", F.lit(1)).alias(name))
    rest = inner.filter(~_proper(inner, key))
    return found.unionByName(rest.withColumn(name, F.lit(None).cast(outer.schema["id"].dataType)))


def all_around(inner: DataFrame, outer: DataFrame, key: str, name: str, strict: bool = False, columns: list[str] | None = None) -> DataFrame:
    """inner(key, start, end, ...), or its columns alone, with `name`, a row for the id of each range of outer(key, start, end, id) around each; strict leaves out equal ranges.

    The rows are as many as the pairs. They leave the sweep as pairs of lists of bounded length and are parted in the same task, in no order that is promised.
    """
    every = _dealt(inner, outer, key, Every, columns or inner.columns)
    out = every.select(F.array("row").alias("rows"), F.array("id").alias("outers"))
    arrow = out.limit(0).toArrow().schema
    lists = every.mapInArrow(lambda b: _paired(b, strict, arrow), out.schema)
    return lists.select("rows", F.explode("outers").alias("_outer")).select(F.explode("rows").alias("row"), "_outer").select("row.*", F.col("_outer").alias(name))


def met_without(outer: DataFrame, inner: DataFrame, key: str, names: str, asked: str) -> DataFrame:
    """(key, id) of the ranges of outer(key, id, start, end, names) around any of inner(key, start, end, asked) that shares no name with them; null arrays share none.

    A range is held until it is met and given out once for each partition that it reaches into, so no pairs are listed.
    """
    o = outer.select(key, "start", "end", F.struct(F.col("id").alias("id"), F.coalesce(names, F.array().cast(outer.schema[names].dataType)).alias("names")).alias("id"))
    kind = o.schema["id"].dataType
    by = F.struct(F.lit(None).cast(kind["id"].dataType).alias("id"), F.col(asked).alias("names"))
    i = inner.select(key, "start", "end", asked)
    # The asking rows need not ride: of each, the key is all that is read again.
    met = _around(i, o, key, Unmet, False, False, by).select(F.col("row")[key].alias(key), F.explode("outers").alias("o"))
    return met.select(key, F.col("o.id").alias("id")).distinct()


def listed_around(inner: DataFrame, outer: DataFrame, key: str, name: str) -> DataFrame:
    """inner(key, start, end, ...) with `name`: an array of the ids of all ranges of outer(key, start, end, id) around each, in no order."""
    found = _around(inner, outer, key, Every, False, True).select("row.*", F.col("outers").alias(name))
    none = F.array().cast(found.schema[name].dataType)
    return found.unionByName(inner.filter(~_proper(inner, key)).withColumn(name, none))


def _least_so_far(asking: DataFrame, holding: DataFrame, keys: list[str], name: str) -> DataFrame:
    """asking(keys, _at, _most, ...) with `name`: the id of holding(keys, _at, _value, id) of the least value at or before _at, null where it is above _most; true for an id where holding has none.

    One union and one window. Keys of over LARGE rows are cut at quantiles of their places first; the least values of
    the pieces before, a row each, are handed on.
    """
    told = "id" in holding.columns
    least = F.struct(F.col("_value").alias("value"), F.col("id").alias("id")) if told else F.col("_value")
    held = holding.select(*keys, "_at", least.alias("_least"), F.lit(False).alias("_asks"))
    rows = asking.withColumn("_asks", F.lit(True)).unionByName(held, allowMissingColumns=True)
    places = rows.select(*keys, "_at")
    # Buckets of keys are counted first, as there are few; single keys only where a bucket has over LARGE rows.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    full = [r[0] for r in rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LARGE).select("_bucket").collect()]  # BUCKETS at most
    of_full = places.filter(F.array_contains(F.lit(full), bucket) if full else F.lit(False))
    hot = of_full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LARGE)
    hot = kept(hot) if full else hot
    piece = [*keys]
    if full and not hot.isEmpty():
        most = int(hot.agg(F.max("_n")).first()[0])
        pieces = min(256, most * 4 // LARGE)
        shares = [i / pieces for i in range(1, pieces)]
        cuts = kept(places.join(F.broadcast(hot), keys).groupBy(*keys).agg(F.percentile_approx("_at", F.lit(shares), F.lit(2000)).alias("_cuts")))
        rows = rows.join(F.broadcast(cuts), keys, "left").withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))).drop("_cuts")
        piece = [*keys, "_piece"]
        totals = rows.filter("NOT _asks").join(F.broadcast(hot.select(*keys)), keys, "left_semi").groupBy(*piece).agg(F.min("_least").alias("_total"))
        # A row for each piece of a key, also of those that hold nothing.
        every = hot.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("_piece"))
        before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        carried = kept(every.join(totals, piece, "left").select(*piece, F.min("_total").over(before).alias("_carried")).filter("_carried IS NOT NULL"))
    least = F.min("_least").over(W.partitionBy(*piece).orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_found", least).filter("_asks")
    if len(piece) > len(keys):
        rows = rows.join(F.broadcast(carried), piece, "left").withColumn("_found", F.least("_found", "_carried"))
    found = F.when(F.col("_found.value") <= F.col("_most"), F.col("_found.id")) if told else F.when(F.col("_found") <= F.col("_most"), F.lit(True))
    return rows.select(*[c for c in asking.columns if c not in ("_at", "_most")], found.alias(name))


def _any(asking: DataFrame, holding: DataFrame, key: str | list[str], name: str, at: Column, end: Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    good = F.coalesce(F.col("start") <= F.col("end"), F.lit(False))
    for k in keys:
        good = good & F.col(k).isNotNull()
    asked = asking.filter(good).withColumns({"_at": at, "_most": end})
    told = "id" in holding.columns
    held = holding.filter(good).select(*keys, at.alias("_at"), end.alias("_value"), *["id"] * told)
    rest = asking.filter(~good).withColumn(name, F.lit(None).cast(holding.schema["id"].dataType if told else "boolean"))
    return _least_so_far(asked, held, keys, name).unionByName(rest)


def holds_any(outer: DataFrame, inner: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """outer(key, start, end, ...) with `name`: the id of a range of inner(key, start, end, id) that lies in it, null if none does; without ids true."""
    return _any(outer, inner, key, name, -F.col("start").cast("long"), F.col("end").cast("long"))


def in_any(inner: DataFrame, outer: DataFrame, key: str | list[str], name: str) -> DataFrame:
    """inner(key, start, end, ...) with `name`: the id of a range of outer(key, start, end, id) around it, null if there is none; without ids true."""
    return _any(inner, outer, key, name, F.col("start").cast("long"), -F.col("end").cast("long"))


#: The node types that make regions, and the kinds of these in order.
LOOPS = ("DoWhileStatement", "ForInStatement", "ForOfStatement", "ForStatement", "WhileStatement")
CONDITIONS = ("ConditionalExpression", "IfStatement", "SwitchCase", "SwitchStatement")
KINDS = ("callback", "catch", "conditional", "finally", "loop")
FUNCTIONS = ("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "TSDeclareFunction")


def regions(nodes: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, end) of the control regions that nodes(key, type, start, end, parent_type, is_argument, final_start, final_end) make, each once.

    A loop, a condition, a catch, the last part of a try (final_start to final_end, where it has one), and a function that
    is an argument of a call.
    """
    kind = F.when(F.col("type").isin(*LOOPS), "loop").when(F.col("type").isin(*CONDITIONS), "conditional").when(F.col("type") == "CatchClause", "catch")
    kind = kind.when((F.col("type") == "TryStatement") & F.col("final_start").isNotNull() & F.col("final_end").isNotNull(), "finally")
    kind = kind.when(F.col("type").isin(*FUNCTIONS) & (F.col("parent_type") == "CallExpression") & F.col("is_argument"), "callback")
    last = F.col("type") == "TryStatement"
    x = nodes.select(key, kind.alias("kind"), F.when(last, F.col("final_start")).otherwise(F.col("start")).alias("start"), F.when(last, F.col("final_end")).otherwise(F.col("end")).alias("end"))
    return x.filter("kind IS NOT NULL").distinct()


def control_regions(calls: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """calls(key, start, end, ...) with control: an array of (kind, start, end) of the regions around each, outermost first, empty if there are none.

    Regions outside the function that holds the call count too. A region of one kind and range counts once; regions of
    equal range stand by kind.
    """
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    x = _around(calls, regions(nodes, key).select(key, "start", "end", code.alias("id")), key, Listed, False, True).select("row.*", F.col("outers").alias("control"))
    # Three numbers a region: its kind's place among KINDS, which are in order, is the last.
    read = lambda i: F.struct(F.get(F.array(*[F.lit(k) for k in KINDS]), F.get("control", i + 2).cast("int")).alias("kind"), F.get("control", i).alias("start"), (-F.get("control", i + 1)).alias("end"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    found = x.withColumn("control", F.when(F.size("control") > 0, F.transform(F.sequence(F.lit(0), F.size("control") - 1, F.lit(3)), read)).otherwise(none))
    return found.unionByName(calls.filter(~_proper(calls, key)).withColumn("control", none))


def owned(facts: DataFrame, barriers: DataFrame, handlers: DataFrame, key: str) -> DataFrame:
    """facts(key, start, end, ...) with handler: the id of the handler of handlers(key, id) that owns each; facts that none owns go.

    A fact belongs to the shortest barrier around it: a function or catch of barriers(key, id, start, end), the handlers
    themselves included. What a nested barrier owns is no fact of the handlers around it.
    """
    x = smallest_around(facts, barriers, key, "handler")
    h = handlers.select(F.col(key).alias("_key"), F.col("id").alias("_id"))
    return x.join(h, (F.col(key) == F.col("_key")) & (F.col("handler") == F.col("_id"))).drop("_key", "_id")


def handler_flow(handlers: DataFrame, facts: DataFrame, barriers: DataFrame, key: str) -> DataFrame:
    """handlers(key, id, request, response, parameters) with what each owns of facts(key, start, end, kind, object, name), by place.

    calls: facts of kind call; exits: throws and returns, and calls of the response parameter; sources: reads of the
    request parameter; each an array of (start, name). requests_complete and responses_complete are false where there is
    such a parameter without a plain name, whose reads or exits then can't be told.
    """
    h = handlers.select(F.col(key).alias("_key"), F.col("id").alias("_id"), "request", "response")
    own = owned(facts, barriers, handlers, key)
    both = own.join(h, (F.col(key) == F.col("_key")) & (F.col("handler") == F.col("_id")))
    entry = F.struct("start", "name")
    some = lambda when: F.array_sort(F.collect_list(F.when(when, entry)))
    flow = both.groupBy("_key", "_id").agg(
        some(F.col("kind") == "call").alias("calls"),
        some(F.col("kind").isin("throw", "return") | ((F.col("kind") == "call") & (F.col("object") == F.col("response")))).alias("exits"),
        some((F.col("kind") == "read") & (F.col("object") == F.col("request"))).alias("sources"),
    )
    out = handlers.join(flow, (handlers[key] == F.col("_key")) & (handlers["id"] == F.col("_id")), "left")
    none = F.array().cast("array<struct<start:bigint,name:string>>")
    lists = [F.coalesce(F.col(c).cast("array<struct<start:bigint,name:string>>"), none).alias(c) for c in ("calls", "exits", "sources")]
    complete = [((F.coalesce("parameters", F.lit(0)) < i) | F.col(c).isNotNull()).alias(f"{c}s_complete") for i, c in ((1, "request"), (2, "response"))]
    return out.select(*[handlers[c] for c in handlers.columns], *lists, *complete)
