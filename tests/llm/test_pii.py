"""Personal data: base spans against plain regular expressions, the learning against plain Python, and planted cases."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import pii

SF = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


STRICT = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
}


def base(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(STRICT) for m in re.finditer(STRICT[kind][0], text or "") if STRICT[kind][1](m[0]))


def row(text):
    found = base(text)
    written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)
    return (*[sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(written.encode()).hexdigest())


def odd_texts():
    r = random.Random(8)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "00000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1111", "+1 (017) 555-7713", "+49.", " ", "x", "é", "😀", "-", "_", "%", "5", "\n", "b.c_d@e.f", "a@b..x@d.e", "+", "(", ")", "a@b"]
    texts = [None, "", " ", "1.2.3.4.5.6.7.8", "a@b.c@d.e.f", "4929348385146306", "+1+1234567890123456", "+123456789", "1" * 14 + " " + "2" * 5]
    return texts + ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(600)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    table = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("email", "wide", "base", "found", "_text", "_model", "spans", "kind")})
    got = pii.pii_digest(table)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    out = got.collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted(((i, *row(t)) for i, t in rows + rows[:3]), key=repr)
    spans = {r.doc_id: r.spans for r in out if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            mine = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t)}
            listed = spans[i].split(",") if spans[i] else []
            assert mine <= set(listed) and len(listed) == len(set(listed))
            order = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in listed]
            assert order == sorted(order)
    assert pii.pii_digest(table.limit(0)).count() == 0
    assert pii.pii_digest(table.filter("text is null")).select("spans").distinct().collect()[0].spans == ""


def plain_em(patterns, rounds=30, strength=20.0):
    yes = [list(g) for g in pii.GUESS]
    no = [list(reversed(g)) for g in pii.GUESS]
    share = 0.5

    def likely(v):
        if v[pii.TEST] == -1:
            return 0.0
        a = share * math.prod(y[x + 1] for y, x in zip(yes, v))
        b = (1 - share) * math.prod(y[x + 1] for y, x in zip(no, v))
        return a / (a + b)

    for _ in range(rounds):
        q = {v: likely(v) for v in patterns}
        all_n, all_q = sum(patterns.values()), sum(n * q[v] for v, n in patterns.items())
        yes = [[(sum(n * q[v] for v, n in patterns.items() if v[l] == x - 1) + strength * g[x]) / (all_q + strength) for x in range(3)] for l, g in enumerate(pii.GUESS)]
        no = [[(sum(n * (1 - q[v]) for v, n in patterns.items() if v[l] == x - 1) + strength * g[2 - x]) / (all_n - all_q + strength) for x in range(3)] for l, g in enumerate(pii.GUESS)]
        share = (all_q + strength / 2) / (all_n + strength)
    return {v: likely(v) for v in patterns}


def test_reliabilities_are_those_of_plain_expectation_maximisation(spark):
    r = random.Random(2)
    counts = defaultdict(int)
    for _ in range(3000):
        true = r.random() < 0.4
        v = tuple((r.choices((-1, 0, 1), g if true else g[::-1]))[0] for g in [(0.1, 0.2, 0.7)] * 6)
        counts[r.randrange(2), v] += 1
    x = spark.createDataFrame([(k, list(v), n) for (k, v), n in counts.items()], "kind int, votes array<int>, n long")
    got = {(p.kind, tuple(p.votes)): p.likely for p in pii.reliabilities(x).collect()}
    for k in (0, 1):
        for v, q in plain_em({v: n for (kind, v), n in counts.items() if kind == k}).items():
            assert got[k, v] == pytest.approx(q, abs=1e-9)


def test_every_candidate_is_decided_as_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x = pii.candidates(pii.base_spans(docs, ("doc_id",))).select("doc_id", "wide").collect()
    counts = defaultdict(int)
    for r in x:
        for c in r.wide:
            counts[c.kind, tuple(c.votes), tuple(c.features)] += 1
    likely = {}
    for k in {k for k, _, _ in counts}:
        patterns = defaultdict(int)
        for (kind, v, _), n in counts.items():
            if kind == k:
                patterns[v] += n
        likely |= {(k, v): q for v, q in plain_em(patterns).items()}
    yes, no = defaultdict(float), defaultdict(float)
    for (k, v, f), n in counts.items():
        for i, value in [*enumerate(f), (None, None)]:
            yes[k, i, value] += n * likely[k, v]
            no[k, i, value] += n * (1 - likely[k, v])

    def score(c):
        a, b = yes[c.kind, None, None], no[c.kind, None, None]
        out = math.log((a + 1) / (b + 1))
        for i, v in enumerate(c.features):
            y, n = yes[c.kind, i, v], no[c.kind, i, v]
            out += math.log((y + (y + n) / (a + b)) / (a + 1)) - math.log((n + (y + n) / (a + b)) / (b + 1))
        return out

    want = {r.doc_id: sorted((c.kind, c.start, c.end) for c in r.wide if score(c) > 0) for r in x}
    got = {r.doc_id: sorted((c.kind, c.start, c.end) for c in r.found) for r in pii.personal_data(docs).collect()}
    assert got == want and any(want.values())


def test_planted_spans_are_found_and_clean_texts_left_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text")
    planted = {
        1: ("two cards 4111111111111111 5500005555555559 side by side", ["4111111111111111", "5500005555555559"]),
        2: ("write to jörg@straße.example.de now", ["jörg@straße.example.de"]),
        3: ("write to ann [at] example [dot] com now", ["ann [at] example [dot] com"]),
        4: ("card 4111 1111 1111 1111 5 items", ["4111 1111 1111 1111"]),
        5: ("call (017) 555-7713 or +1 (017) 555-7713 today", ["(017) 555-7713", "+1 (017) 555-7713"]),
    }
    clean = {
        10: "number 4111111111111112 fails its checksum", 11: "version 1.2.3 of 2024-01-05, 12:30:45", 12: "a price of 1,234.56 and 99.99 in 2023 and 2024",
        13: "[at] the [dot] nothing", 14: "sum 256.300.1.2 is no address", 15: "isbn 978-3-16-148410-0", 16: "1 2 3 4 5 6 7 8 9 10 11 12 13",
    }
    rows = [(i, t) for i, (t, _) in planted.items()] + list(clean.items())
    out = {r.doc_id: r.spans for r in pii.pii_digest(docs.toDF("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id < 1000").collect()}
    for i, (text, values) in planted.items():
        spans = [x.split(":") for x in out[i].split(",") if x]
        found = [text[int(s) : int(e)] for _, s, e in spans]
        assert set(values) <= set(found), (text, found)
    for i, text in clean.items():
        assert out[i] == "", (text, out[i])


def test_long_texts_take_linear_time(spark):
    n = 1_000_000
    texts = ["a" * n, "1" * n, "a." * (n // 2), "a@" + "b." * (n // 2), "+1" + " " * n, "1 " * (n // 2), "a@b.c " * (n // 20), "1.2.3.4, " * (n // 20), "(" * n]
    began = time.time()
    out = pii.pii_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.time() - began < 90
    # The plain patterns take quadratic time on most of these.
    assert {r.doc_id: tuple(r)[1:6] for r in out if r.doc_id in (6, 7)} == {i: row(texts[i]) for i in (6, 7)}
