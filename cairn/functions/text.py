"""Scalar functions over evidence text."""

from pyspark.sql import Column, functions as F


def bounded_evidence(text: Column, most: int, marker: str = " ... ") -> Column:
    """text, or its head and tail around a marker, most characters in all. The head takes the odd one."""
    room = most - len(marker)
    head, tail = (room + 1) // 2, room // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail))))


def sanitize_id(text: Column) -> Column:
    """Everything but ASCII letters, digits, _ and - becomes _."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def call_root(callee: Column) -> Column:
    """The first dotted segment."""
    return F.split_part(callee, F.lit("."), F.lit(1))


def root_of(callee: str) -> str:
    """call_root of a fixed callee."""
    return callee.split(".", 1)[0]


def extension(filename: Column) -> Column:
    """The last .xxx, lower-cased; empty if there is none."""
    return F.regexp_extract(F.lower(filename), r"\.[^./]*$", 0)


#: The characters that trimming takes: white space and the byte order mark, as fixed values.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def without_comments(source: Column) -> Column:
    """source without block and line comments, whichever starts first, and trimmed."""
    return trimmed(F.regexp_replace(source, r"(?s)/\*.*?\*/|//[^\n\r]*", ""))


def is_probability(value: Column) -> Column:
    """Finite and between 0 and 1; Spark orders NaN above all numbers, so it is tested for."""
    return value.isNotNull() & ~F.isnan(value) & value.between(0.0, 1.0)


def matches_any(value: Column, patterns: list) -> Column:
    """True if any pattern is found; false without patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def bounded_halves(text: Column, most: int, marker: str) -> Column:
    """text, or half of `most` characters from each end around a marker, which comes on top."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def nearby(text: Column, start: Column, end: Column, radius: int) -> Column:
    """What lies within `radius` characters of the range [start, end), offsets from 0, clamped to the text."""
    a = F.greatest(start - radius, F.lit(0))
    z = F.least(end + radius, F.length(text))
    return F.substring(text, a.cast("int") + 1, F.greatest(z - a, F.lit(0)).cast("int"))


def line_and_column(text: Column, offset: Column) -> Column:
    """The struct (line, column) of an offset from 0, both from 1; only newlines break lines."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    rows = F.split(before, "\n")
    return F.struct(F.size(rows).alias("line"), (F.length(F.element_at(rows, -1)) + 1).alias("column"))


def language(filename: Column) -> Column:
    """The language of a source file by its extension; JavaScript for all others."""
    x = extension(filename)
    return F.when(x.isin(".ts", ".mts", ".cts"), "typescript").when(x == ".tsx", "tsx").when(x == ".jsx", "jsx").otherwise("javascript")


def sql_structure(query: Column) -> Column:
    """SQL without comments and quoted strings, each a space."""
    return F.regexp_replace(query, r"(?s)--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'", " ")


def paginated(query: Column) -> Column:
    """Whether the structure of SQL has a LIMIT or OFFSET."""
    return sql_structure(query).rlike(r"(?i)\b(limit|offset)\b")


def ordered(query: Column) -> Column:
    """Whether the structure of SQL has an ORDER BY."""
    return sql_structure(query).rlike(r"(?i)\border\s+by\b")


def directive(comment: Column, tool: str) -> Column:
    """The struct (command, rules) of a suppression comment `<tool>-<command> rules -- reason`; null for other comments.

    rules is null where none is named: the directive is for all of them. Only the rest of the line counts.
    """
    pattern = rf"\A\s*\*?\s*{tool}-(disable-next-line|disable-line|disable|enable)(?=\s|\z)([^\r\n]*)"
    command = F.regexp_extract(comment, pattern, 1)
    selector = F.regexp_replace(F.regexp_extract(comment, pattern, 2), r"(?:^|\s)--(?:\s.*|\z)", "")
    rules = F.filter(F.split(selector, r"[\s,]+"), lambda r: r != "")
    return F.when(command != "", F.struct(command.alias("command"), F.when(F.size(rules) > 0, rules).alias("rules")))


def escaped(text: Column) -> Column:
    """text with the metacharacters of patterns quoted."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def answer_summary(choice: Column, probability: Column) -> Column:
    """choice and its probability to two places."""
    return F.format_string("%s %.2f", choice, probability)


def same_keys(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct keys hold the same ones."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def canonical(json: Column) -> Column:
    """JSON with the keys of every object sorted; null where it is none. Numbers are written anew."""
    return F.to_json(F.try_parse_json(json))


def decoded_path(uri: Column) -> Column:
    """A percent-decoded URI with slashes for backslashes; a plus sign stays one."""
    return F.translate(F.try_url_decode(F.regexp_replace(uri, r"\+", "%2B")), "\\", "/")
