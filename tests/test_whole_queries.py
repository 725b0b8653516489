"""Queries over all rows: no id is left out of either side, and pairs are those of brute force."""

from collections import defaultdict

import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name, column, table, key", [("j08_regions", "event_id", "events", "event_id"), ("j15_reachable", "start", "customer", "c_custkey"), ("s11_findings", "o_orderkey", "orders", "o_orderkey")])
def test_every_id_is_judged(spark, name, column, table, key):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[column] for r in rows(spark, name)} == ids


def ranges(spark):
    groups = defaultdict(list)
    for r in spark.sql(f"SELECT o_custkey % 50 AS k, o_orderkey AS id, unix_seconds(CAST(o_orderdate AS timestamp)) AS s, floor(o_totalprice) AS n FROM parquet.`{SF}/orders.parquet`").collect():
        groups[r.k].append((r.s, r.s + 60 * r.n, r.id))
    return groups


def test_every_pair_is_compared(spark):
    want = {(k, i[2], o[2]) for k, x in ranges(spark).items() for i in x for o in x if o[0] <= i[0] and o[1] >= i[1] and o[:2] != i[:2]}
    got = [tuple(r) for r in rows(spark, "j05_contained")]
    assert len(got) == len(want) and set(got) == want and any(i % 2 and o % 5 for _, i, o in want)


def test_parents_are_sought_in_large_groups(spark):
    want, own = {}, defaultdict(list)
    for k, x in ranges(spark).items():
        for i in x:
            around = [(o[1] - o[0], o[0], o[2]) for o in x if o[0] <= i[0] and o[1] >= i[1] and o[:2] != i[:2]]
            want[k, i[2]] = min(around)[2] if around else None
            if around:
                own[k, min(around)[2]].append(i[2])
    assert {(r.k, r.id): r.parent_id for r in rows(spark, "j02_parent")} == want
    assert {(r.k, r.id): (r.own, r.first_id) for r in rows(spark, "j03_facts_owned")} == {x: (len(v), min(v)) for x, v in own.items()}
