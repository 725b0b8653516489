"""JavaScript and TypeScript text to relations: comments and imports, by a lexer of its own that runs on the executors."""

import re

import pandas as pd
from pyspark.sql import DataFrame

SPACE = re.compile(r"\s+")
WORD = re.compile(r"[\w$]+")
STRING = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*{q}?") for q in "'\""}
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[\w$]*")
#: After these words a slash begins a pattern and does not divide.
BEFORE_REGEX = set("return typeof case do else in of instanceof new void delete throw yield await".split())

COMMENTS = "start int, end int, line int, column int, end_line int, style string, value string"


def tokens(source: str):
    """(kind, start, end) of every token, white space left out; kinds: line, block, string, template, regex, word, mark.

    A template is one token with all that its ${} hold, comments in there included. Unclosed tokens end with the text.
    """
    at, n, last = 0, len(source), ""
    while at < n:
        c = source[at]
        if m := SPACE.match(source, at):
            at = m.end()
            continue
        if source.startswith("//", at) or (at == 0 and source.startswith("#!")):
            end = source.find("\n", at)
            kind, end = "line", n if end < 0 else end - (source[end - 1] == "\r")
        elif source.startswith("/*", at):
            end = source.find("*/", at + 2)
            kind, end = "block", n if end < 0 else end + 2
        elif c in STRING:
            kind, end = "string", STRING[c].match(source, at).end()
        elif c == "`":
            kind, end = "template", template_end(source, at)
        elif m := WORD.match(source, at):
            kind, end = "word", m.end()
        elif c == "/" and (last == "" or last in BEFORE_REGEX or last in "(,=:[!&|?{};+-*%<>~^") and (m := REGEX.match(source, at)):
            kind, end = "regex", m.end()
        else:
            kind, end = "mark", at + 1
        if kind not in ("line", "block"):
            last = source[at:end] if kind in ("word", "mark") else "x"
        yield kind, at, end
        at = end


def template_end(source: str, at: int) -> int:
    """Where the template that begins at `at` ends; braces inside ${} are counted over tokens."""
    at, n = at + 1, len(source)
    while at < n:
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, inner = 1, at + 2
            for kind, a, z in tokens(source[inner:]):
                depth += kind == "mark" and {"{": 1, "}": -1}.get(source[inner + a], 0)
                if not depth:
                    break
            else:
                return n
            at = inner + z
        else:
            at += 1
    return n


def utf16(source: str):
    """A function from places in source to UTF-16 offsets."""
    wide = [i for i, c in enumerate(source) if ord(c) > 0xFFFF] if not source.isascii() else []
    if not wide:
        return lambda i: i
    from bisect import bisect_left

    return lambda i: i + bisect_left(wide, i)


def comments_of(source: str) -> list[tuple]:
    """(start, end, line, column, end_line, style, value) of the comments of a text; offsets and columns in UTF-16 units, lines and columns from 1."""
    off, out = utf16(source), []
    line, done = 1, 0
    for kind, a, z in tokens(source):
        if kind not in ("line", "block") or source.startswith("#!", a):
            continue
        line, done = line + source.count("\n", done, a), a
        closed = kind == "block" and z - a >= 4 and source.endswith("*/", a, z)
        value = source[a + 2 : z - 2 * closed]
        begin = source.rfind("\n", 0, a) + 1
        out.append((off(a), off(z), line, off(a) - off(begin) + 1, line + source.count("\n", a, z), kind, value))
    return out


def imports_of(source: str) -> list[str]:
    """The text of each import declaration at the top level; import() and import.meta are none."""
    toks = [t for t in tokens(source) if t[0] not in ("line", "block")]
    depth, out, skip = 0, [], -1
    for i, (kind, a, z) in enumerate(toks):
        mark = source[a:z]
        if i > skip and depth == 0 and kind == "word" and mark == "import" and (i == 0 or source[toks[i - 1][1]] != "."):
            if i + 1 < len(toks) and source[toks[i + 1][1]] in "(.":
                continue
            for j in range(i + 1, len(toks)):
                if toks[j][0] == "string":
                    end = j + 1 if j + 1 < len(toks) and source[toks[j + 1][1]] == ";" else j
                    out.append(source[a : toks[end][2]])
                    skip = end
                    break
        if kind == "mark" and i > skip:
            depth += (mark in "{([") - (mark in "})]")
    return out


def comments(files: DataFrame) -> DataFrame:
    """(filename, start, end, line, column, end_line, style, value): one row per comment of files(filename, source); a null source has none."""

    def run(batches):
        for b in batches:
            rows = [(f, *c) for f, s in zip(b["filename"], b["source"]) if isinstance(s, str) for c in comments_of(s)]
            yield pd.DataFrame(rows, columns=["filename", *[c.split()[0] for c in COMMENTS.split(", ")]])

    return files.select("filename", "source").mapInPandas(run, f"filename string, {COMMENTS}")


def imports(files: DataFrame) -> DataFrame:
    """(filename, ord, source): one row per top-level import of files(filename, source)."""

    def run(batches):
        for b in batches:
            rows = [(f, i, x) for f, s in zip(b["filename"], b["source"]) if isinstance(s, str) for i, x in enumerate(imports_of(s))]
            yield pd.DataFrame(rows, columns=["filename", "ord", "source"])

    return files.select("filename", "source").mapInPandas(run, "filename string, ord int, source string")
