"""Words and shingles of whole Arrow text columns, hashed with numpy.

Texts are taken in slices of a few megabytes, so memory is bounded by the slice (or by the longest
single text) and not by the Arrow batch.
"""

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
FOLD = U(0xD6E8FEB86659FD93)

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True

_powers = {}


def mix(x):
    """Finishes a 64-bit hash (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    x &= MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def powers(n: int):
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    have = _powers.get("n", 0)
    if have < n:
        m = max(n, 2 * SLICE)
        for name, base in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            x = np.full(m, U(base), np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
        _powers["n"] = m
        if m > 64 * SLICE:  # one huge text must not keep its tables
            p, i = _powers["p"][:n], _powers["i"][:n]
            _powers.clear()
            return p, i
    return _powers["p"][:n], _powers["i"][:n]


def prefix_hash(data):
    """c with c[j] - c[i] the sum of (byte + 1) * BASE**position over data[i:j]."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(len(data) + 1)[0][: len(data)], out=c[1:])
    return c


def slices(column, limit: int = SLICE):
    """(first row, bytes, offsets) for runs of whole texts of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        base = 0
        for part in column.chunks:
            for i, data, offs in slices(part, limit):
                yield base + i, data, offs
            base += len(part)
        return
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data, offs, table=WORD):
    """Starts, ends and hashes of the words, A-Z lower-cased; first[d] is the first word of text d."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    c = prefix_hash(LOWER[data])
    h = (c[ends] - c[starts]) * powers(n + 1)[1][starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * U(BASE)), np.searchsorted(starts, offs)


def shingles(h, first, k: int):
    """Hashes of all k-word windows inside each text, and first[d] of them; a text of 1 to k-1 words has its whole sequence as one."""
    m, count = len(h), np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if m >= k:
        g = h[: m - k + 1].copy()
        for i in range(1, k):
            g = g * FOLD + h[i : m - k + 1 + i]
        valid = np.ones(m, bool)
        for t in range(1, k):
            at = first[1:] - t
            valid[at[at >= first[:-1]]] = False
        pos = np.flatnonzero(valid[: m - k + 1])
        g = mix(g[pos])
    else:
        g, pos = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(short):
        more = []
        for d in short:
            x = 0
            for v in h[first[d] : first[d + 1]].tolist():
                x = (x * int(FOLD) + v) & MASK
            more.append(mix_int(x + int(count[d]) * BASE))
        g, pos = np.concatenate([g, np.array(more, np.uint64)]), np.concatenate([pos, first[short]])
        order = np.argsort(pos, kind="stable")
        g, pos = g[order], pos[order]
    return g, np.searchsorted(pos, first)


def windows(h, first, n: int):
    """(hash, text) of all n-word windows inside each text, hashed as shingles() does a whole text of n < k words."""
    m = max(0, len(h) - n + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = h[:m].copy()
    for i in range(1, n):
        g = g * FOLD + h[i : m + i]
    inside = np.flatnonzero(text[:m] == text[n - 1 : m + n - 1])
    return mix(g[inside] + U(n * BASE & MASK)), text[inside]


def shingle_sets(column, k: int, table=WORD):
    """(row, sorted distinct shingle hashes) of every text."""
    for i, data, offs in slices(column):
        _, _, h, first = words(data, offs, table)
        g, at = shingles(h, first, k)
        for d in range(len(offs) - 1):
            x = np.sort(g[at[d] : at[d + 1]])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            yield i + d, x
