"""Questions about hashes, asked by chunks of documents and answered by ranges of hashes.

Documents are dealt into chunks of a few megabytes by a hash. Each chunk sends its distinct hashes, sorted and packed
into one binary value for each range, with packed values beside them; whoever owns a range sees every chunk's share of
it and answers each chunk in the order asked. A hash that a third of all documents hold is asked for once by each
chunk, so no range is hot, and neither chunks nor ranges grow with the input: their numbers do.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_CHUNKS = 64


def chunk_count(docs: DataFrame, chunk_bytes: int = 3 << 20, text: str = "text") -> int:
    """Chunks of about chunk_bytes of text, LEAST_CHUNKS at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(LEAST_CHUNKS, -(-int(total) // chunk_bytes))


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """docs(doc_id, text, ...) with the column chunk."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(chunks)).cast("int"))


def range_edges(ranges: int):
    """Lower bounds of equal ranges of 64-bit hashes, as uint64."""
    return np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)


def pack(hashes, values: dict, ranges: int, chunk: int) -> pa.RecordBatch:
    """Rows (part, chunk, hashes, *values) for sorted hashes; each value is an array whose first axis goes with them."""
    at = np.concatenate([np.searchsorted(hashes, range_edges(ranges)), [len(hashes)]])
    full = np.flatnonzero(at[1:] > at[:-1])
    blob = lambda x: pa.array([np.ascontiguousarray(x[at[i] : at[i + 1]]).tobytes() for i in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int32)), blob(hashes), *map(blob, values.values())], ["part", "chunk", "hashes", *values])


def unpacked(table: pa.Table, name: str, dtype, width: int = 0) -> list:
    """The packed arrays of one column, a row each."""
    out = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]
    return [x.reshape(-1, width) for x in out] if width else out


def grouped(arrays: list, dtype=np.uint64):
    """(concatenated, row of each, offsets)."""
    if not arrays:
        return np.empty(0, dtype), np.empty(0, np.int64), np.zeros(1, np.int64)
    sizes = np.array([len(x) for x in arrays])
    return np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes), np.concatenate([[0], np.cumsum(sizes)])
