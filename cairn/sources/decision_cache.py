"""The decision cache as a Spark data source: spark.read / df.write.format("decision_cache") with a path and rows (key, response).

A folder holds entries, one JSON line each, in files named by the first two digits of their keys, and commits: lists of the
files that one write made, with their bytes; a reader's partition takes files up to 16 MB together, one at least. Files that no commit lists are not read, so a write that fails or is killed leaves no entry.
A filter on the key prunes files by name and lines in the reader. An entry that is broken, of
another version or no response has a problem and a null response, so it counts as a miss. An entry's last write counts
(`written`; see decisions.cache_hits). Paths are those of pyarrow's file systems: a local path or file:, hdfs:, s3: or gs:
uri that all executors share.
"""

import json
import math
import re
import time
import uuid
from collections import defaultdict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

VERSION = 1
SCHEMA = "key string, response string, written double, problem string"
_ARROW = pa.schema([("key", pa.string()), ("response", pa.string()), ("written", pa.float64()), ("problem", pa.string())])
_ROWS = 10_000
_BYTES = 16 << 20


def _share(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and 0 <= x <= 1


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 2**53


def _answers(x) -> bool:
    shares = lambda m: isinstance(m, dict) and all(map(_share, m.values()))
    rated = lambda a: _share(a.get("confidence")) and shares(a.get("probabilities"))
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    fits = {
        "noul": lambda a: _share(a.get("noul")),
        "choice": lambda a: isinstance(a.get("choice"), str) and a["choice"] != "" and rated(a),
        "score": lambda a: number(a.get("score")) and rated(a) and isinstance(a.get("legend"), dict),
    }
    return isinstance(x, dict) and all(isinstance(a, dict) and isinstance(a.get("type"), str) and fits.get(a["type"], lambda a: False)(a) for a in x.values())


def is_response(x) -> bool:
    """Whether x is a provider's response: a model's name, answers of known types in their ranges, token counts or none."""
    if not (isinstance(x, dict) and isinstance(x.get("model"), str) and x["model"] and _answers(x.get("answers"))):
        return False
    usage = x.get("usage", {})
    return isinstance(usage, dict) and ("usage" not in x or all(_count(usage.get(k)) for k in ("inputTokens", "outputTokens")))


def entry(line: str) -> tuple:
    """(key, response, written, problem) of a line; a line without a key has a null one."""
    try:
        x = json.loads(line)
    except ValueError:
        return None, None, None, "not JSON"
    if not isinstance(x, dict) or not isinstance(x.get("key"), str):
        return None, None, None, "no key"
    written = x.get("written")
    written = float(written) if isinstance(written, (int, float)) and not isinstance(written, bool) else None
    try:
        good = is_response(json.loads(x["response"]))
    except (KeyError, TypeError, ValueError):
        good = False
    problem = "other version" if x.get("schemaVersion") != VERSION else None if good else "invalid response"
    return x["key"], x["response"] if problem is None else None, written, problem


def _opened(path: str):
    path = re.sub(r"^file:/+", "/", path.rstrip("/"))
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (fs.LocalFileSystem(), path)


def _prefix(key: str) -> str:
    return key[:2].lower() if re.match(r"[0-9a-fA-F]{2}", key) else "__"


class _Part(InputPartition):
    def __init__(self, names: list[str]):
        self.value = names


class _Files(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.keys = path, None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("key",):
                self.keys = set(values) if self.keys is None else self.keys & set(values)
            else:
                yield f

    def partitions(self):
        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        files = []
        for commit in sorted(f.path for f in found if f.path.endswith(".json")):
            with system.open_input_stream(commit) as f:
                files += json.loads(f.read())
        if self.keys is not None:
            wanted = {_prefix(k) for k in self.keys if k is not None}
            files = [f for f in files if f[0][:2] in wanted]
        parts, room = [_Part([])], _BYTES
        for name, size in files:
            if size > room and parts[-1].value:
                parts.append(_Part([]))
                room = _BYTES
            parts[-1].value.append(name)
            room -= size
        return parts

    def read(self, partition):
        system, root = _opened(self.path)
        rows = []
        for name in partition.value:
            try:
                with system.open_input_stream(f"{root}/entries/{name}") as f:
                    for line in _lines(f):
                        row = entry(line)
                        if self.keys is None or row[0] in self.keys:
                            rows.append(row)
                        if len(rows) == _ROWS:
                            yield _batch(rows)
                            rows = []
            except OSError as e:  # an unreadable file is a file of misses, told by its row
                rows.append((None, None, None, f"not readable: {type(e).__name__}"))
        yield _batch(rows)


def _lines(stream, size: int = 1 << 20):
    """The lines of a stream, read by blocks, so that a file need not fit in memory."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole if x)
    if rest:
        yield rest.decode("utf-8", "replace")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, f"{time.time():017.6f}-{uuid.uuid4().hex}"

    def write(self, batches):
        """One task's entries, a file for each prefix; a task that runs twice writes files of other names."""
        system, root = _opened(self.path)
        system.create_dir(f"{root}/entries", recursive=True)
        made, written = {}, float(self.run[:17])
        task = uuid.uuid4().hex
        try:
            for batch in batches:
                lines = defaultdict(list)
                for key, response in zip(batch.column("key").to_pylist(), batch.column("response").to_pylist()):
                    if key is not None and response is not None:
                        lines[_prefix(key)].append(json.dumps({"schemaVersion": VERSION, "key": key, "response": response, "written": written}) + "\n")
                for prefix, out in lines.items():
                    name = f"{prefix}-{self.run}-{task}.jsonl"
                    if name not in made:
                        made[name] = system.open_output_stream(f"{root}/entries/{name}")
                    made[name].write("".join(out).encode())
            sizes = {name: f.tell() for name, f in made.items()}
        finally:
            for f in made.values():
                f.close()
        return _Files(list(sizes.items()))

    def commit(self, messages):
        """Lists all tasks' files in one file that appears under its name when it is whole."""
        system, root = _opened(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{root}/commits/{self.run}.tmp") as f:
            f.write(json.dumps(files).encode())
        system.move(f"{root}/commits/{self.run}.tmp", f"{root}/commits/{self.run}.json")

    def abort(self, messages):
        """Removes the files of tasks that ended; those of tasks that were lost stay unread."""
        system, root = _opened(self.path)
        for name, _ in [f for m in messages if m is not None for f in m.files]:
            system.delete_file(f"{root}/entries/{name}")


class DecisionCache(DataSource):
    @classmethod
    def name(cls):
        return "decision_cache"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a decision cache is appended to")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DecisionCache)


def cache(spark: SparkSession, path: str) -> DataFrame:
    """All committed entries (key, response, written, problem); no rows where there is no folder."""
    register(spark)
    return spark.read.format("decision_cache").option("path", path).load()


def add(entries: DataFrame, path: str) -> None:
    """Commits the entries (key, response) whose keys the cache has no good entry for, each key once, all or none of them.

    They are sorted by key first, so a task writes few files however many tasks there are.
    """
    held = cache(entries.sparkSession, path).filter("problem IS NULL").select("key")
    new = entries.select("key", "response").filter("key IS NOT NULL AND response IS NOT NULL").join(held, "key", "left_anti")
    new = new.groupBy("key").agg(F.min("response").alias("response")).repartitionByRange("key")
    new.write.format("decision_cache").mode("append").option("path", path).save()
