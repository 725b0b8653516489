"""Language ID by rank-order n-gram profiles (out-of-place distance)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.llm import textkit

U = np.uint64
SPACE = 0x20
#: A prediction for a text without letters.
UNDETERMINED = "und"
_letters = {}


def _letter_table():
    """is-a-letter of each code point, by str.isalpha."""
    if "t" not in _letters:
        t = np.zeros(0x110000, bool)
        t[[i for i in range(0x30000) if chr(i).isalpha()]] = True
        _letters["t"] = t
    return _letters["t"]


def grams(texts: list, sizes=(1, 2, 3)):
    """(owner, 40-bit gram code) of all n-grams of the letters of `texts`, lower-cased; other characters part words.

    Grams of two and more may hold the space at either end of a word. Codes are hashes of code points, so any
    alphabet fits; two grams of one text share a code about once in 2**40 / (grams squared) texts.
    """
    joined = "\n".join(t.replace("\n", " ") if t else "" for t in texts).lower()
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(x) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.cumsum(x == 10)
    x = np.where(_letter_table()[x], x, SPACE)
    white = x == SPACE
    keep = ~white | np.concatenate([[True], ~white[:-1]]) | np.concatenate([[True], owner[1:] != owner[:-1]])
    x, owner, white = x[keep].astype(np.uint64), owner[keep], white[keep]
    owners, codes = [], []
    for n in sizes:
        m = len(x) - n + 1
        if m <= 0:
            break
        g = np.zeros(m, np.uint64)
        for i in range(n):
            g = g * U(0x100000001B3) + x[i : m + i] + U(n)
        good = owner[:m] == owner[n - 1 :]
        if n == 1:
            good &= ~white
        elif n == 2:
            good &= ~(white[:m] & white[1:])
        else:
            good &= ~white[1 : m + 1] if n == 3 else True
        owners.append(owner[:m][good])
        codes.append(textkit.mix(g[good]) >> U(24))
    return np.concatenate(owners), np.concatenate(codes)


def _runs(key):
    """Distinct sorted values and their counts."""
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at], np.diff(np.concatenate([at, [len(key)]]))


def profiles_of(texts: list, top: int, sizes=(1, 2, 3)):
    """(owner, code, rank) of each text's `top` most frequent n-grams; ties by code."""
    owner, code = grams(texts, sizes)
    key, count = _runs((owner.astype(np.uint64) << U(40)) | code)
    owner, code = (key >> U(40)).astype(np.int64), key & U((1 << 40) - 1)
    order = np.lexsort((code, -count, owner))
    owner, code = owner[order], code[order]
    first = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - first[owner] if len(owner) else np.empty(0, np.int64)
    good = rank < top
    return owner[good], code[good], rank[good]


def _batches(texts, limit=1 << 18):
    """Runs of texts of about `limit` characters."""
    out, size = [], 0
    for i, t in enumerate(texts):
        out.append(i)
        size += len(t or "")
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 400) -> dict:
    """{language: {code: rank}} from all rows whose lang and text aren't null.

    N-grams are counted inside each task and summed by Spark; only each language's `top` rows come to the driver,
    which is bounded by the number of languages.
    """

    def count(batches):
        sums = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for rows in _batches(texts):
                by = {}
                owner, code = grams([texts[i] for i in rows])
                ids = np.array([by.setdefault(langs[i], len(by)) for i in rows], np.uint64)
                key, n = _runs((ids[owner] << U(40)) | code)
                for name, i in by.items():
                    a, z = np.searchsorted(key, [np.uint64(i) << U(40), np.uint64(i + 1) << U(40)])
                    have = sums.setdefault(name, [np.empty(0, np.uint64), np.empty(0, np.int64)])
                    codes, at = np.unique(np.concatenate([have[0], key[a:z] & U((1 << 40) - 1)]), return_inverse=True)
                    total = np.zeros(len(codes), np.int64)
                    np.add.at(total, at, np.concatenate([have[1], n[a:z]]))
                    sums[name] = [codes, total]
        for name, (codes, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(total)], ["lang", "code", "n"])

    rows = docs.select(text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).mapInArrow(count, "lang string, code long, n long")
    sums = rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Each slice of a language hands on its own best, so that no task ranks all grams of a language.
    part = W.partitionBy("lang", F.pmod("code", F.lit(64))).orderBy(F.desc("n"), "code")
    best = sums.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= top).drop("r")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= top)
    out = {}
    for x in best.collect():
        out.setdefault(x.lang, {})[x.code] = x.r - 1
    return out


def classifier(model: dict, top: int):
    """texts -> (language or und, score). The languages' ranks stand in one table, the highest distance for a missing gram."""
    names = sorted(model)
    codes = np.array(sorted({c for p in model.values() for c in p}), np.uint64)
    ranks = np.full((len(codes) + 1, len(names)), -1, np.int64)
    for j, name in enumerate(names):
        at = np.searchsorted(codes, np.array(list(model[name]), np.uint64))
        ranks[at, j] = list(model[name].values())

    def predict(texts):
        owner, code, rank = profiles_of(texts, top)
        n = len(texts)
        have = np.bincount(owner, minlength=n)
        if not names or not len(codes):
            return [UNDETERMINED] * n, [0.0] * n
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        r = ranks[np.where(codes[at] == code, at, len(codes))]
        d = np.where(r < 0, top, np.minimum(np.abs(r - rank[:, None]), top))
        first = np.searchsorted(owner, np.arange(n + 1))
        c = np.zeros((len(d) + 1, len(names)), np.int64)
        np.cumsum(d, axis=0, out=c[1:])
        total = c[first[1:]] - c[first[:-1]]
        best = np.argmin(total, axis=1)
        low = total[np.arange(n), best]
        rest = total.copy()
        rest[np.arange(n), best] = np.iinfo(np.int64).max
        second = rest.min(axis=1) if len(names) > 1 else have * top
        score = np.where(second > 0, (second - low) / np.maximum(second, 1), 0.0)
        return [names[b] if h else UNDETERMINED for b, h in zip(best, have)], [float(s) if h else 0.0 for s, h in zip(score, have)]

    return predict


def identify(docs: DataFrame, model: dict, top: int = 400, text: str = "text", keep: tuple | None = None) -> DataFrame:
    """docs (all columns, or those in `keep`) with lang_pred and score (0 to 1: how much nearer the best profile is than the next).

    Whole texts are read. A null text, one without letters, and any text under an empty model is `und`, score 0.
    Equal distances go to the language first in code-point order. Columns of docs named like the results are replaced.
    """
    columns = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        predict = classifier(model, top)
        for b in batches:
            texts = b.column(len(columns)).to_pylist()
            names, scores = [], []
            for rows in _batches(texts):
                x, y = predict([texts[i] for i in rows])
                names += x
                scores += y
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(columns))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    x = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("_text_read"))
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return x.mapInArrow(run, schema)


def held_out(doc_id, folds: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
