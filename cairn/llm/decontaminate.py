"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm import textkit

#: Shingle hashes of items held by a task at once; more items are searched in blocks of this size.
BLOCK = 1 << 20
#: A size partition holds the items of up to this many times its smallest size.
GROWTH = 1.5


def _share(threshold: float, n: int) -> int:
    """The least number of shared shingles that makes a containment of threshold."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


class Index:
    """Items partitioned by size, each partition with its own sketch length.

    An item of n shingles that is contained to threshold t lacks at most n - ceil(t * n) of them in the document. So
    of its n - ceil(t * n) + 1 least hashes (a bottom-k MinHash sketch) one at least is in the document. A partition
    of items of up to u shingles takes the sketch length of size u, so its search loses nothing.
    """

    def __init__(self, items: list, threshold: float):
        """items: (item_id, sorted distinct hashes)."""
        self.items = sorted(items, key=lambda x: len(x[1]))
        keys, owners, low = [], [], 0
        while low < len(self.items):
            n = len(self.items[low][1])
            high = low
            while high < len(self.items) and len(self.items[high][1]) <= max(n * GROWTH, n + 1):
                high += 1
            u = len(self.items[high - 1][1])
            k = u - _share(threshold, u) + 1
            for i in range(low, high):
                sketch = self.items[i][1][:k]
                keys.append(sketch)
                owners.append(np.full(len(sketch), i))
            low = high
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.threshold = keys[order], owners[order], threshold
        self.bits = np.zeros(1 << 20, bool)  # most shingles of a document fail here
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, g):
        """(item_id, item size, shared) of the items contained in a document of shingles g (any order, repeats allowed)."""
        hit = g[self.bits[(g >> np.uint64(44)).astype(np.int64)]]
        if not len(hit):
            return
        hit = np.unique(hit)
        a, z = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
        found = {int(i) for x, y in zip(a, z) for i in self.owners[x:y]}
        if found:
            g = np.unique(g)
            for i in sorted(found):
                item, s = self.items[i]
                at = np.minimum(np.searchsorted(g, s), len(g) - 1)
                shared = int((g[at] == s).sum())
                if shared >= _share(self.threshold, len(s)):
                    yield item, len(s), shared


class Passages:
    """Items of fewer than k words: each is one hash, looked for among a document's windows of so many words."""

    def __init__(self, items: list):
        """items: (item_id, hash, words)."""
        self.by_size = {}
        for item, x, n in items:
            self.by_size.setdefault(n, {}).setdefault(int(x), []).append(item)
        self.hashes = {n: np.array(sorted(found), np.uint64) for n, found in self.by_size.items()}

    def search(self, h, first):
        """(text, item_id) of the items that stand in each text of words h, once for each."""
        for n, hashes in self.hashes.items():
            g, text = textkit.windows(h, first, n)
            hit = np.isin(g, hashes)
            for d, x in sorted(set(zip(text[hit].tolist(), g[hit].tolist()))):
                for item in self.by_size[n][x]:
                    yield d, item


def _blocks(items: DataFrame, k: int):
    """Lists of (item_id, hashes, words) of at most about BLOCK hashes, read through an iterator: the driver holds one at a time."""
    out, size = [], 0
    for row in items.toLocalIterator():
        for _, data, offs in textkit.slices(pa.array([row[1]], pa.string())):
            _, _, h, first = textkit.words(data, offs, textkit.ALNUM)
            x = np.unique(textkit.shingles(h, first, k)[0])
            if len(x):
                out.append((row[0], x, len(h)))
                size += len(x)
        if size >= BLOCK:
            yield out
            out, size = [], 0
    yield out


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of the items of which `threshold` of the k-word shingles are in a document.

    Words are runs of letters and digits, A-Z lower-cased, of whole texts; an item of fewer than k words is one
    shingle of its whole sequence, found wherever a document holds that sequence. Null or wordless texts and
    items match nothing. Repeated documents and items each get their rows. The items travel to every task in blocks
    of about BLOCK shingles, and the documents are read once for each block, so memory doesn't grow with the items.
    """
    out = None
    # Each block is shipped on its own inside its function, 8 MB at most.
    for block in _blocks(items.select("item_id", "text"), k):

        def run(batches, block=block):
            index = Index([x[:2] for x in block if x[2] >= k], threshold)
            passages = Passages([(item, x[0], n) for item, x, n in block if n < k])
            for b in batches:
                ids, rows = b.column(0), []
                for i, data, offs in textkit.slices(b.column(1)):
                    _, _, h, first = textkit.words(data, offs, textkit.ALNUM)
                    rows += [(i + d, item, 1, 1) for d, item in passages.search(h, first)]
                    g, at = textkit.shingles(h, first, k)
                    maybe = index.bits[(g >> np.uint64(44)).astype(np.int64)]
                    hits = np.concatenate([[0], np.cumsum(maybe)])
                    for d in np.flatnonzero(hits[at[1:]] > hits[at[:-1]]):
                        rows += [(i + int(d), *x) for x in index.search(g[at[d] : at[d + 1]])]
                if rows:
                    at, item, n, shared = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (item, n, shared)]], ["doc_id", "item_id", "n_shingles", "n_shared"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that contain an item; only the text decides, so repeated or null ids take no other rows with them."""
    text = F.xxhash64("text")
    bad = contained_items(docs.select(text.alias("doc_id"), "text"), items, **options).select(F.col("doc_id").alias("bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("key"))
    return rows.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")
