"""The cache's data source: commits whole or not at all, prunes files, and tells bad entries from good ones."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from cairn.sources import decision_cache as cache

GOOD = json.dumps({"model": "m", "answers": {"q": {"type": "noul", "noul": 0.5}}})


@pytest.fixture
def entries(spark):
    return spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(GOOD).alias("response"), "id")


def test_what_was_added_is_read_once_each(spark, tmp_path, entries):
    path = f"file://{tmp_path}/c"
    assert cache.cache(spark, path).count() == 0
    cache.add(entries.unionByName(entries), path)
    cache.add(entries.select("key", "response").unionByName(spark.createDataFrame([(None, GOOD), ("zz", None), ("zz", GOOD)], "key string, response string")), path)
    rows = cache.cache(spark, path).collect()
    assert len(rows) == 301 == len({r.key for r in rows}) and {(r.response, r.problem) for r in rows} == {(GOOD, None)}
    assert len({r.written for r in rows}) == 2


def test_a_write_that_fails_leaves_no_entry(spark, tmp_path, entries):
    path = str(tmp_path / "c")
    cache.add(entries.filter("id < 10"), path)
    failing = entries.repartition(6).withColumn("response", F.when(F.col("id") == 299, F.raise_error(F.lit("lost"))).otherwise(F.col("response")))
    with pytest.raises(Exception, match="lost|abort|Abort"):
        failing.select("key", "response").write.format("decision_cache").mode("append").option("path", path).save()
    assert cache.cache(spark, path).count() == 10
    # What a killed task or driver leaves behind: files without a commit, a commit that is not whole.
    (tmp_path / "c/entries/00-killed.jsonl").write_text(json.dumps({"schemaVersion": 1, "key": "00", "response": GOOD, "written": 1}) + "\n")
    (tmp_path / "c/commits/9.tmp").write_text('["00-killed')
    assert cache.cache(spark, path).count() == 10


def test_key_filters_prune_files(spark, tmp_path, entries):
    path = str(tmp_path / "c")
    cache.add(entries, path)
    key = entries.filter("id = 7").first().key
    every = [n for p in cache._Reader(path).partitions() for n in p.value]
    reader = cache._Reader(path)
    assert list(reader.pushFilters([EqualTo(("key",), key), EqualTo(("response",), "x")])) == [EqualTo(("response",), "x")]
    assert [n[:2] for p in reader.partitions() for n in p.value] == [key[:2]] and len(every) > 50
    none = cache._Reader(path)
    assert list(none.pushFilters([In(("key",), ("aa", "bb")), EqualTo(("key",), "cc")])) == [] and [p.value for p in none.partitions()] == [[]]
    x = cache.cache(spark, path).filter(F.col("key") == key)
    assert x.rdd.getNumPartitions() == 1 and [r.key for r in x.collect()] == [key]


def test_partitions_take_files_up_to_their_bytes(tmp_path):
    (tmp_path / "commits").mkdir()
    files = [["00-a", 1], ["01-b", 20 << 20], ["02-c", 9 << 20], ["03-d", 7 << 20], ["04-e", 1]]
    (tmp_path / "commits/1.json").write_text(json.dumps(files))
    assert [p.value for p in cache._Reader(str(tmp_path)).partitions()] == [["00-a"], ["01-b"], ["02-c", "03-d"], ["04-e"]]


def test_bad_entries_have_a_problem(tmp_path, spark):
    response = lambda **x: json.dumps({"model": "m", "answers": {}} | x)
    answer = lambda **x: response(answers={"q": x})
    rated = {"confidence": 1, "probabilities": {"a": 0}}
    good = [GOOD, response(), response(usage={"inputTokens": 0, "outputTokens": 5}), answer(type="choice", choice="a", **rated), answer(type="score", score=7.5, legend={}, **rated)]
    bad = [response(model=""), response(answers=[]), response(usage=None), response(usage={"inputTokens": 1.5, "outputTokens": 1}), answer(type="noul", noul=True), answer(type="noul", noul=1.1), answer(type="choice", choice="", **rated), answer(type="score", score=1, **rated), answer(type="choice", choice="a", confidence=1, probabilities={"a": None}), answer(type="else"), answer(type=["noul"]), "[", "3", "NaN"]
    line = lambda r, **x: json.dumps({"schemaVersion": 1, "key": "ab", "response": r, "written": 1} | x)
    assert [cache.entry(line(r))[3] for r in good] == [None] * len(good)
    assert [cache.entry(line(r))[3] for r in bad] == ["invalid response"] * len(bad)
    assert cache.entry(line(GOOD, schemaVersion=2)) == ("ab", None, 1.0, "other version")
    assert [cache.entry(x) for x in ("{", "[]", line(GOOD, key=None))] == [(None, None, None, p) for p in ("not JSON", "no key", "no key")]
    (tmp_path / "commits").mkdir()
    (tmp_path / "entries").mkdir()
    (tmp_path / "commits/1.json").write_text('[["ab-1.jsonl", 99], ["cd-gone.jsonl", 99]]')
    (tmp_path / "entries/ab-1.jsonl").write_text(line(GOOD) + "\n{\n" + line(GOOD, written="x"))
    got = sorted((r.key or "", r.problem or "") for r in cache.cache(spark, str(tmp_path)).collect())
    assert got == [("", "not JSON"), ("", "not readable: FileNotFoundError"), ("ab", ""), ("ab", "")]
