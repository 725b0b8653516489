"""Two tokenizers' tokens of the same texts, aligned by a transducer over dangling suffixes.

The transducer reads both token streams. Its state is the side that leads and the bytes by which it leads, a suffix of
its last token. The next token always comes from the side that is behind, and it overlaps that last token. A group
closes where nothing is left over. States are numbered and their transitions kept by state and next token.
"""

import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from cairn.llm import store

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how byte-level BPE parts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the sign for a space in pieces.
SPACE = "▁"
#: Characters of text that are aligned together, transitions and pieces that are kept, and pairs of a slice of counts (17 bytes each on the driver and in a worker).
SLICE_CHARS, MEMO, PIECES, PAIRS = 1 << 20, 1 << 20, 1 << 19, 1 << 22
_loaded = {}


def byte_alphabet() -> dict:
    """The byte of each character that byte-level BPE writes: visible Latin-1 stands for itself, the other bytes, in order, from U+0100."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE from its JSON file; special tokens' strings are plain text."""

    def __init__(self, data: bytes):
        model, alphabet = json.loads(data), byte_alphabet()
        vocabulary = model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", [])}
        self.size = max([*vocabulary.values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        self.plain = Tokenizer.from_str(data.decode())
        self.plain.encode_special_tokens = True
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        first = self.size - len(special) - len(merged)
        # Where ids follow the merges, ranks say all that merges do, and the faster encoder gives the same ids.
        self.fast = None
        if first == 256 and all(vocabulary[m] == first + i for i, m in enumerate(merged)):
            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list:
        if self.fast:
            try:
                return self.fast.encode_ordinary(" " + text)
            except BaseException as e:  # the fast encoder's panic on white space of 100,000 characters is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return self.plain.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A piece model; it adds the space before the text by itself."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(SPACE, " ").encode())
        # If no piece reaches over the space before a word and white space is kept, words can be encoded alone.
        inner = any(SPACE in self.model.id_to_piece(i).lstrip(SPACE) for i in range(self.size) if not self.model.is_control(i))
        probe = "a  b c  "
        self.by_word = not inner and b"".join(self.bytes[i] for i in self.model.encode(probe)) == b" " + probe.encode()

    def encode(self, text: str) -> list:
        return self.model.encode(text)


def tokenizer(data: bytes, kind: str):
    """The tokenizer of a file's bytes, kept in the process: `json` is byte-level BPE, `model` a piece model."""
    key = (kind, hash(data))
    if key not in _loaded:
        _loaded[key] = {"json": ByteBpe, "model": Pieces}[kind](data)
    return _loaded[key]


class Transducer:
    """Aligns the ids of tokenizer A with those of tokenizer B. A positive state: A leads by some bytes; negative: B does; 0: neither."""

    def __init__(self, a: list, b: list):
        self.bytes = {1: a, -1: b}
        self.forget()

    def forget(self):
        self.states, self.rests, self.moves, self.open, self.kept = {}, [b""], [{}], {}, 0

    def state(self, side: int, rest: bytes) -> int:
        """The number of a state, with the side's sign."""
        if not rest:
            return 0
        known = self.states.get((side, rest))
        if known is None:
            known = self.states[side, rest] = side * len(self.rests)
            self.rests.append(rest)
            self.moves.append({})
        return known

    def move(self, state: int, token: int) -> int:
        """The state after the side that is behind gives `token`."""
        side, rest = (1, self.rests[state]) if state > 0 else (-1, self.rests[-state])
        self.kept += 1
        new = self.bytes[-side][token]
        if len(new) <= len(rest):
            if not rest.startswith(new):
                raise ValueError("the streams spell different bytes")
            return self.state(side, rest[len(new) :])
        if not new.startswith(rest):
            raise ValueError("the streams spell different bytes")
        return self.state(-side, new[len(rest) :])

    def align(self, a: list, b: list):
        """(ends of groups in a, ends in b, links as A id * B's size + B id); both streams must spell the same bytes."""
        ends_a, ends_b, links = [], [], []
        i, j, n, size = 0, 0, len(a), len(self.bytes[-1])
        add, end_a, end_b = links.append, ends_a.append, ends_b.append
        while i < n:
            if self.kept > MEMO:
                self.forget()
            moves, opened = self.moves, self.open
            lead = a[i]
            i += 1
            state = opened.get(lead)
            if state is None:
                state = opened[lead] = self.state(1, self.bytes[1][lead])
            while state:
                while state > 0:
                    token = b[j]
                    j += 1
                    add(lead * size + token)
                    after = moves[state].get(token)
                    if after is None:
                        after = moves[state][token] = self.move(state, token)
                    state = after
                if not state:
                    break
                lead = token
                while state < 0:
                    token = a[i]
                    i += 1
                    add(token * size + lead)
                    after = moves[-state].get(token)
                    if after is None:
                        after = moves[-state][token] = self.move(state, token)
                    state = after
                lead = token
            end_a(i)
            end_b(j)
        return ends_a, ends_b, links


def packed_kind(a, b):
    """The integers that hold A id * B's size + B id."""
    return np.uint64 if a.size * b.size > 1 << 32 else np.uint32


class Aligner:
    """Texts to rows, over alignments of pieces that are kept: (A tokens, B tokens, groups, the groups written out, link codes packed).

    Texts are parted before each single space between characters that are no white space. There every token of both
    tokenizers ends, so that the transducer's state is empty, and a piece has the same alignment wherever it stands.
    """

    parted = re.compile(r"(?<=\S) (?=\S)").split

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.walk = Transducer(a.bytes, b.bytes)
        self.lengths = np.array([len(x) for x in a.bytes])
        self.size = max(a.size, b.size)
        self.signed = [f"{i}{sign}" for sign in ",|;" for i in range(self.size)]
        self.widths = np.array([len(x) for x in self.signed])
        self.kind = packed_kind(a, b)
        self.by_piece = a.fast is not None and b.by_word
        self.pieces = {}

    def rows(self, texts: list):
        """n_a, n_b, n_groups, n_links, groups, pairs (packed, sorted; A id * B's size + B id) and times (packed) of each text."""
        # The sign for a space comes back as a space: the bytes differ.
        parts = [[] if not t or SPACE in t else self.parted(t) if self.by_piece else [t] for t in texts]
        new = {p for x in parts for p in x if p not in self.pieces}
        if len(self.pieces) + len(new) > PIECES:
            self.pieces.clear()
            new = {p for x in parts for p in x}
        self._learn(sorted(new))
        for x in parts:
            found = [self.pieces[p] for p in x]
            if not found or None in found:
                yield 0, 0, 0, 0, "", b"", b""
                continue
            n_a, n_b, n_groups, groups, links = zip(*found)
            links = np.frombuffer(b"".join(links), self.kind)
            pairs, times = np.unique(links, return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), len(links), ";".join(groups), pairs.tobytes(), times.astype(np.uint32).tobytes()

    def _learn(self, pieces: list):
        """Aligns pieces that neither begin nor end with white space as one text, the others alone."""
        alone = [p for p in pieces if not self.by_piece or p[:1].isspace() or p[-1:].isspace()]
        if self.by_piece:
            lone = set(alone)
            joined = [p for p in pieces if p not in lone]
            if joined and not self._aligned(joined):
                alone = pieces
        for p in alone:
            if not self._aligned([p]):
                self.pieces[p] = None

    def _aligned(self, pieces: list) -> bool:
        """Keeps the alignments of pieces that are joined by spaces; False if a tokenizer's bytes are not the text's."""
        text = " ".join(pieces)
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        want = b" " + text.encode()
        if b"".join([self.a.bytes[i] for i in ids_a]) != want or b"".join([self.b.bytes[i] for i in ids_b]) != want:
            return False
        ends_a, ends_b, links = map(np.array, self.walk.align(ids_a, ids_b))
        links = links.astype(self.kind).tobytes()
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        written, offsets = self._written(ids_a, ids_b, ends_a, ends_b)
        place = np.cumsum(self.lengths[ids_a])[ends_a - 1]
        at = np.concatenate([[0], np.searchsorted(place, np.cumsum([len(p.encode()) + 1 for p in pieces])) + 1])
        till_a, till_b = np.concatenate([[0], ends_a])[at], np.concatenate([[0], ends_b])[at]
        # Every token but the first of each group gives one link.
        cut, sign = ((till_a + till_b - at) * self.kind().itemsize).tolist(), offsets[till_a + till_b].tolist()
        for i, (p, n_a, n_b, n_groups) in enumerate(zip(pieces, np.diff(till_a).tolist(), np.diff(till_b).tolist(), np.diff(at).tolist())):
            self.pieces[p] = n_a, n_b, n_groups, written[sign[i] : sign[i + 1] - 1], links[cut[i] : cut[i + 1]]
        return True

    def _written(self, ids_a, ids_b, ends_a, ends_b):
        """All groups in writing, each token with the sign behind it, and where the writing of each token begins."""
        n, m = len(ids_a), len(ids_b)
        group_a = np.repeat(np.arange(len(ends_a)), np.diff(ends_a, prepend=0))
        group_b = np.repeat(np.arange(len(ends_b)), np.diff(ends_b, prepend=0))
        codes = np.empty(n + m, np.int64)
        codes[np.arange(n) + np.concatenate([[0], ends_b])[group_a]] = ids_a
        codes[np.arange(m) + ends_a[group_b]] = ids_b
        codes[ends_a + np.concatenate([[0], ends_b[:-1]]) - 1] += self.size
        codes[ends_a + ends_b - 1] += 2 * self.size
        return "".join(map(self.signed.__getitem__, codes.tolist())), np.concatenate([[0], np.cumsum(self.widths[codes])])


def _sliced(texts: list):
    """Ranges of rows of about SLICE_CHARS characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _files(spark, *paths):
    """Broadcast bytes and kinds of tokenizer files, which the driver reads: megabytes, whatever the input."""
    out = []
    for p in paths:
        with open(p, "rb") as f:
            out.append((f.read(), p.rsplit(".", 1)[-1]))
    return spark.sparkContext.broadcast(out)


SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def aligned(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row of docs.

    groups reads `a1,a2|b1;a3|b2,b3`. pairs are the distinct linked (A id, B id) as A id * B's size + B id, sorted and
    packed in 32 bits (64 where the vocabularies need them), times how often each is linked. Null and empty texts, and
    texts that either tokenizer does not spell byte by byte, have no tokens. Equal rows get equal rows; null keys stay.
    """
    files = _files(docs.sparkSession, a, b)
    x = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        aligner = Aligner(*[tokenizer(*f) for f in files.value])
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in _sliced(texts):
                columns = list(zip(*aligner.rows(texts[s:e])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["key", *names])

    return x.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)


def pair_counts(alignments: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """(a, b, documents): how many rows hold each id pair linked. Tasks count before the shuffle; rows are bounded by the product of the vocabularies."""
    files = _files(alignments.sparkSession, a, b)

    def run(batches):
        ours, theirs = [tokenizer(*f) for f in files.value]
        kind = packed_kind(ours, theirs)
        held, keys, counts = [], np.empty(0, np.uint64), np.empty(0, np.int64)

        def merged():
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, kind), np.empty(0, np.int64))
            every, place = np.unique(np.concatenate([keys, new.astype(np.uint64)]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            held.clear()
            return every, total

        def given(keys, counts):
            for s in range(0, len(keys), 1 << 16):
                k = keys[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k // theirs.size).astype(np.int32)), pa.array((k % theirs.size).astype(np.int32)), pa.array(counts[s : s + (1 << 16)])], ["a", "b", "n"])

        size = 0
        for batch in batches:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), kind))
                size += len(held[-1])
                if size >= PAIRS:
                    (keys, counts), size = merged(), 0
                    if len(keys) >= PAIRS:
                        yield from given(keys, counts)
                        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield from given(*merged())

    return alignments.filter("n_links > 0").select("pairs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("documents"))


def with_best(counts: DataFrame) -> DataFrame:
    """counts(a, b, documents) with best: whether the pair has its A id's highest count, ties included. One A id has as many rows as B has ids at most."""
    top = counts.groupBy(F.col("a").alias("_a")).agg(F.max("documents").alias("_top"))
    return counts.join(top, F.col("a") == F.col("_a")).select("a", "b", "documents", (F.col("documents") == F.col("_top")).alias("best"))


def link_scores(alignments: DataFrame, counts: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, most_pairs: int = PAIRS) -> DataFrame:
    """alignments, without pairs and times, with n_best (links whose pair is its A id's best) and count_sum (the links' counts, added).

    counts(a, b, documents, best) goes to the tasks in slices of about most_pairs pairs, each broadcast for one pass over
    the alignments, so neither driver nor worker holds more whatever the corpus; with more pairs there are more passes.
    `alignments` is read once for each slice and should be a written table; its rows are told apart by `row`.
    """
    spark = alignments.sparkSession
    files = _files(spark, a, b)
    n = counts.count()
    slices = max(1, -(-n // most_pairs))
    sums, others = None, [c for c in alignments.columns if c not in ("pairs", "times")]
    for s in range(slices):
        part = counts.filter(F.pmod(F.xxhash64("a"), F.lit(slices)) == s).toArrow()
        width = tokenizer(*files.value[1]).size
        keys = part.column("a").to_numpy().astype(np.uint64) * np.uint64(width) + part.column("b").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], part.column("documents").to_numpy()[order], part.column("best").to_numpy(zero_copy_only=False)[order]))
        zero = F.lit(0).cast("long")
        found = alignments.select(*others, "pairs", "times").mapInArrow(_scorer(table, files, others), alignments.select(*others, zero.alias("n_best"), zero.alias("count_sum")).schema)
        sums = found if sums is None else sums.unionByName(found)
    if slices == 1:
        return sums
    return sums.groupBy("row").agg(*[F.first(c).alias(c) for c in others if c != "row"], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _scorer(table, files, columns):
    def run(batches):
        keys, counts, best = table.value
        ours, theirs = [tokenizer(*f) for f in files.value]
        kind = packed_kind(ours, theirs)
        keys = keys.astype(kind)
        for batch in batches:
            pairs = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(len(columns))]
            times = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in batch.column(len(columns) + 1)]
            n_best, count_sum = [], []
            for p, t in zip(pairs, times):
                if not len(p) or not len(keys):
                    n_best.append(0)
                    count_sum.append(0)
                    continue
                at = np.minimum(np.searchsorted(keys, p), len(keys) - 1)
                here = keys[at] == p
                n_best.append(int((t * (best[at] & here)).sum()))
                count_sum.append(int((t * np.where(here, counts[at], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*columns, "n_best", "count_sum"])

    return run


def alignment_digest(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs(doc_id, text).

    Texts are tokenised once; what later steps need is written, without the groups. Rows without tokens have zeros and
    an empty groups_sha256. Other columns are ignored, repeated rows count as often as they stand there.
    """
    x = aligned(docs, a, b).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    x = store.written(x.withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = store.written(with_best(pair_counts(x, a, b)), "pair-counts")
    return link_scores(x, counts, a, b, most_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
