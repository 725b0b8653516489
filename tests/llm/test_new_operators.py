"""Token alignment and vector codes against brute force, with odd rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import token_align, url_filter, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    return [token_align.tokenizer(open(p, "rb").read(), p.rsplit(".", 1)[1]) for p in (token_align.BYTE_BPE, token_align.PIECE_BPE)]


def odd_texts():
    r = random.Random(4)
    common = "The quick brown fox, aligned twice: naïve café 日本語 😀!"
    return [
        None, "", " ", "   ", "a ", "  two  spaces  ", "a\n\n  b\t c ", "é日本 語", "<s> </s> <|endoftext|> <0x41> <unk>", "a \xa0b c　 d", "don't 's 'll x 's",
        "a\x1c b \x1c c", "the sign ▁ itself", "\0 a", " " * 100_001 + "x", "ab" * 5000, "x" * 3000 + " y", common, common, common + " again",
        " ".join("".join(r.choice("abcdeéñ1,.") for _ in range(r.randint(1, 12))) for _ in range(20_000)),
    ]


def brute(texts, a, b):
    """Links and groups from byte offsets alone, ids from the plain encoders over whole texts."""
    rows = []
    for t in texts:
        ids_a = a.plain.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.model.encode(t or "")
        bytes_a, bytes_b = [a.bytes[i] for i in ids_a], [b.bytes[i] for i in ids_b]
        if not t or b"".join(bytes_a) != b"".join(bytes_b) or b"".join(bytes_a) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        links, j = [], 0
        for i, e in enumerate(end_a):
            s = e - len(bytes_a[i])
            while end_b[j] <= s:
                j += 1
            k = j
            while k < len(end_b) and end_b[k] - len(bytes_b[k]) < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for e in sorted(set(end_a.tolist()) & set(end_b.tolist())):
            x2, y2 = int(np.searchsorted(end_a, e)) + 1, int(np.searchsorted(end_b, e)) + 1
            groups.append(",".join(map(str, ids_a[x:x2])) + "|" + ",".join(map(str, ids_b[y:y2])))
            x, y = x2, y2
        rows.append((ids_a, ids_b, groups, links))
    count = Counter(p for *_, links in rows for p in set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    return [
        (len(x), len(y), len(g), len(l), sum(count[p] == top[p[0]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for x, y, g, l in rows
    ]


def test_alignment_is_that_of_byte_offsets(spark, tokenizers):
    texts = odd_texts()
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "pairs", "row", "n_a", "documents", "best")})
    want = sorted(((i, *r) for (i, _), r in zip(rows, brute(texts, *tokenizers))), key=repr)
    for most in (token_align.PAIRS, 200):
        got = token_align.alignment_digest(docs, most_pairs=most)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_align.alignment_digest(docs.limit(0)).count() == 0


def test_alignment_of_the_table(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in token_align.alignment_digest(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], *tokenizers)))


def test_forgotten_transitions_and_pieces_change_nothing(tokenizers, monkeypatch):
    texts = [t for t in odd_texts() if t and len(t) < 20_000] + [odd_texts()[-1]]
    want = list(token_align.Aligner(*tokenizers).rows(texts))
    monkeypatch.setattr(token_align, "MEMO", 3)
    monkeypatch.setattr(token_align, "PIECES", 40)
    small = token_align.Aligner(*tokenizers)
    assert [x for t in texts for x in small.rows([t])] == want
    small.by_piece = False
    small.pieces.clear()
    assert list(small.rows(texts)) == want


def test_the_byte_alphabet_covers_every_byte():
    assert sorted(token_align.byte_alphabet().values()) == list(range(256))


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    from fractions import Fraction

    kept = [(k, v, l) for k, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    whole = [[math.floor(Fraction(c) * scale) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    step = width // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[whole[i][p * step : (p + 1) * step] for i in order] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(w[p * step : (p + 1) * step], e)), i) for i, e in enumerate(books[p])) for p in range(parts)] for w in whole]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [w[p * step : (p + 1) * step] for w, f in zip(whole, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, l), e in zip(kept, errors):
        labels[l] += e
    top = 2**63 - 1
    return [(k, "".join(f"{i:02x}" for _, i in f), min(e, top), min(labels[l], top), digest) for (k, _, l), f, e in zip(kept, found, errors)]


CASES = {
    "ties": [(i, [float((i * j) % 3 - 1) / 64 for j in range(16)], i % 3 or None) for i in range(150)],
    "copies": [(i, [0.5] * 8, 1) for i in range(40)] + [(7, [0.5] * 8, 1), (None, [0.25] * 8, None)],
    "few": [(3, [0.1, -0.2] * 8, 0), (1, [-0.1, 0.2] * 8, None)],
    "odd": [(1, None, 1), (2, [1.0, None] + [0.0] * 6, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 1), (5, [], 2), (6, [1.0, 2.0, 3.0], 2), (7, [-1.5] * 11, None), (None, [0.25] * 8, 2)],
    "huge": [(i, [3.0e9 * (i + j) if i % 2 else 1e-9 * i for j in range(8)], i % 2) for i in range(40)],
    "none": [(1, None, 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_are_those_of_brute_force(spark, name):
    kind = "double" if name == "huge" else "float"
    rows = spark.createDataFrame(CASES[name], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    table = rows.withColumns({c: F.lit("clash") for c in ("row", "v", "k", "code", "error", "coded", "_l", "_own")})
    got = vector_codes.code_digest(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_codes([tuple(r) for r in rows.collect()]), key=repr)


def test_the_tree_finds_the_first_nearest_of_equals():
    r = np.random.default_rng(1)
    for _ in range(200):
        entries, points = r.integers(-2, 3, (r.integers(1, 40), 4)), r.integers(-3, 4, (60, 4))
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        best, far = vector_codes.Tree(entries).nearest(points)
        assert (best == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    model = vector_codes.train(vectors)
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    for r in vector_codes.encoded(vectors, model).limit(20).collect():
        got = model.decoded(r.coded.code)
        assert abs(sum((4096 * (x - y)) ** 2 for x, y in zip(got, rows[r.row.vec_id])) - r.coded.error) < 0.1 * r.coded.error + 64 * 4096


@pytest.mark.parametrize("urls", [[None], [None, "x", ""], ["http://h.org/a/b", "http://h.org/a/c", "http://h.org/d"], []])
def test_urls_without_a_label_are_allowed(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in url_filter.url_verdicts(pages).collect()] == ["allow"] * len(urls)
