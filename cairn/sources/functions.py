"""Functions of scripts and the calls they own, from tokens: no grammar, so some forms are told by their neighbours.

Told: declarations, expressions, arrows, methods of classes and objects, constructors, test callbacks. Not told: calls with
type arguments (`f<T>()`), calls inside templates, arrows in a branch of `? :` whose parameters carry a return type.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairn.sources.scripts import tokens, utf16

#: Callees of tests, words that stand before a parenthesis without calling, and words before a method's name.
TESTS = {"test", "it", "specify"}
NO_CALL = set("if for while switch catch with function return typeof await yield void delete in of instanceof new throw else do case import super async".split())
MODIFIERS = set("async static get set public private protected readonly override abstract".split())
CLOSES = {"(": ")", "[": "]", "{": "}"}

FUNCTIONS = "start int, end int, line int, column int, kind string, name string, role string, async boolean, test_name string, source string, calls array<struct<callee: string, start: int, end: int>>"


class Script:
    """The tokens of a text without comments, with the partner of every bracket."""

    def __init__(self, source: str):
        self.source, self.toks = source, [t for t in tokens(source) if t[0] not in ("line", "block")]
        self.text = [source[a:z] for _, a, z in self.toks]
        self.partner, self.around, open_ = {}, [], []
        for i, x in enumerate(self.text):
            if self.toks[i][0] == "mark" and x in ")]}" and open_:
                self.partner[i], self.partner[open_[-1]] = open_[-1], i
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            if self.toks[i][0] == "mark" and x in CLOSES:
                open_.append(i)

    def at(self, i):
        return self.text[i] if 0 <= i < len(self.text) else ""

    def word(self, i):
        return 0 <= i < len(self.text) and self.toks[i][0] == "word" and not self.text[i][0].isdigit()

    def arrow(self, i):
        return self.at(i) == "=" and self.at(i + 1) == ">" and self.toks[i][2] == self.toks[i + 1][1]

    def after_type(self, i, arrow):
        """Where `{` (or, for arrows, `=>`) stands that ends the return type which may begin at i; -1 if there is none."""
        while i < len(self.text):
            x = self.text[i]
            if self.arrow(i) and arrow:
                return i
            if x == "{" and not arrow and self.at(i - 1) not in (":", "|", "&", "<", ","):
                return i
            if x in ("(", "[", "{"):
                i = self.partner.get(i, len(self.text))
            elif x in (";", ")", "]", "}") or (x in ("=", "?") and not self.arrow(i)) or (arrow and x == ","):
                return -1
            i += 1
        return -1

    def expression_end(self, i):
        """The last token of the expression that begins at i; a line break ends it where no operator joins the lines."""
        first = i
        while i < len(self.text):
            if self.toks[i][0] == "mark" and self.text[i] in ",;)]}":
                return i - 1
            if i > first and "\n" in self.source[self.toks[i - 1][2] : self.toks[i][1]]:
                joined = (self.toks[i][0] == "mark" and self.text[i] not in "{!") or self.text[i] in ("in", "instanceof", "as", "satisfies")
                if not joined and (self.toks[i - 1][0] != "mark" or self.text[i - 1] in ")]}"):
                    return i - 1
            i = self.partner.get(i, len(self.text) - 1) + 1 if self.toks[i][0] == "mark" and self.text[i] in CLOSES else i + 1
        return len(self.text) - 1

    def callee(self, i):
        """(name, first token) of what is called by the parenthesis i; name is null where nothing static is."""
        parts, j = [], i - 1
        if self.at(j) == "." and self.at(j - 1) == "?":
            j -= 2
        while True:
            if self.word(j):
                if self.text[j] != "this" and self.text[j] != "super":
                    parts.append(self.text[j])
            elif self.at(j) == "]" and j in self.partner and not (self.toks[self.partner[j] - 1][0] == "mark" and self.at(self.partner[j] - 1) not in (")", "]", ".")):
                k = self.partner[j]
                if j == k + 2 and self.word(k + 1):
                    parts.append(self.text[k + 1])
                j = k - 2 if self.at(k - 1) == "." and self.at(k - 2) == "?" else k
                j -= 1 if self.at(j) in ("[", "?") else 0
                continue
            elif self.at(j) == ")" and j in self.partner:
                k = self.partner[j]
                inner = self.callee(k)[1] if self.word(k - 1) and self.text[k - 1] not in NO_CALL or self.at(k - 1) in (")", "]") else k
                return ".".join(reversed(parts)) or None, inner
            elif not (0 <= j < len(self.text) and self.toks[j][0] in ("string", "template", "regex")):
                return ".".join(reversed(parts)) or None, j + 1
            if self.at(j - 1) == ".":
                j -= 3 if self.at(j - 2) == "?" else 2
            else:
                return ".".join(reversed(parts)) or None, j

    def functions(self):
        """[first token, last token, name, role, async, parameters] of every function, in the order they begin."""
        found, params = [], set()
        for i, x in enumerate(self.text):
            if self.toks[i][0] == "word" and x == "function" and self.at(i - 1) != ".":
                j = i + 1 + (self.at(i + 1) == "*")
                name = self.text[j] if self.word(j) else None
                while j < len(self.text) and self.text[j] != "(":
                    j += 1
                body = self.after_type(self.partner.get(j, len(self.text)) + 1, False)
                if body >= 0 and body in self.partner:
                    params.add(j)
                    found.append([i - (self.at(i - 1) == "async"), self.partner[body], name, None, self.at(i - 1) == "async"])
            elif self.toks[i][0] == "mark" and x == "(" and i in self.partner and i not in params:
                z = self.partner[i]
                body = z + 1 if self.arrow(z + 1) else self.after_type(z + 2, True) if self.at(z + 1) == ":" and self.at(i - 1) != "?" else -1
                named = self.word(i - 1) and (self.text[i - 1] not in NO_CALL or self.at(i - 1) == "async")
                if body >= 0 and (not named or self.at(i - 1) == "async"):
                    params.add(i)
                    quick = self.at(i - 1) == "async"
                    found.append([i - quick, self.body_end(body + 2), None, None, quick])
                elif self.word(i - 1) and self.text[i - 1] not in NO_CALL and self.at(i - 2) not in (".", "new"):
                    body = z + 1 if self.at(z + 1) == "{" else self.after_type(z + 2, False) if self.at(z + 1) == ":" else -1
                    if body >= 0 and body in self.partner and self.around[i] >= 0 and self.at(self.around[i]) == "{":
                        params.add(i)
                        j, quick = i - 2, False
                        while self.at(j) in MODIFIERS or self.at(j) == "*":
                            quick |= self.at(j) == "async"
                            j -= 1
                        made = self.text[i - 1] == "constructor"
                        found.append([j + 1 if made else i, self.partner[body], self.text[i - 1], "constructor" if made else "method", quick])
            elif self.word(i) and self.arrow(i + 1) and self.at(i - 1) != ".":
                quick = self.at(i - 1) == "async"
                found.append([i - quick, self.body_end(i + 3), None, None, quick])
        for f in found:
            s = f[0]
            if f[3] is None:
                f[3] = "method" if self.at(s - 1) == ":" and self.word(s - 2) and self.at(s - 3) in ("{", ",") else "function"
                if f[2] is None and (f[3] == "method" or (self.at(s - 1) == "=" and self.at(s - 3) in ("const", "let", "var"))):
                    f[2] = self.text[s - 2]
        return sorted(found), params

    def body_end(self, i):
        return self.partner.get(i, len(self.text) - 1) if self.at(i) == "{" else self.expression_end(i)


def functions_of(source: str, tests=frozenset(TESTS)) -> list[tuple]:
    """The columns of FUNCTIONS for a text; offsets and columns in UTF-16 units. A call belongs to the innermost function around it."""
    s, off = Script(source), utf16(source)
    found, params = s.functions()
    calls = [[] for _ in found]
    for i, x in enumerate(s.text):
        if s.toks[i][0] != "mark" or x != "(" or i in params or i not in s.partner:
            continue
        before = s.at(i - 1)
        if not (s.word(i - 1) and before not in NO_CALL or before in (")", "]", ".") or (s.word(i - 1) and s.at(i - 2) == ".")):
            continue
        name, first = s.callee(i)
        if name is None or s.at(first - 1) == "new":
            continue
        own = [k for k, f in enumerate(found) if f[0] <= i <= f[1]]
        if own:
            k = min(own, key=lambda k: found[k][1] - found[k][0])
            calls[k].append((name, off(s.toks[first][1]), off(s.toks[s.partner[i]][2])))
    out = []
    for (first, last, name, role, quick), own in zip(found, calls):
        a, z = s.toks[first][1], s.toks[last][2]
        test, title = False, None
        around = s.around[first]
        if around >= 0 and s.at(around) == "(" and around not in params and s.at(first - 1) in ("(", ","):
            called, head = s.callee(around)
            while called is None and s.at(around - 1) == ")":
                around = s.partner[around - 1]
                called, head = s.callee(around)
            test = called is not None and called.split(".")[0] in tests
            one = s.around[first] + 1
            title = source[s.toks[one][1] + 1 : s.toks[one][2] - 1] if test and s.toks[one][0] == "string" else None
        begin = source.rfind("\n", 0, a) + 1
        out.append((off(a), off(z), source.count("\n", 0, a) + 1, off(a) - off(begin) + 1, "test" if test else "function", name, role, quick, title, source[a:z], own))
    return out


def functions(files: DataFrame, tests=frozenset(TESTS)) -> DataFrame:
    """(filename, *FUNCTIONS): one row per function of files(filename, source); a null source has none."""

    def run(batches):
        for b in batches:
            rows = [(f, *c) for f, s in zip(b["filename"], b["source"]) if isinstance(s, str) for c in functions_of(s, tests)]
            x = pd.DataFrame(rows, columns=["filename", "start", "end", "line", "column", "kind", "name", "role", "async", "test_name", "source", "calls"])
            x["calls"] = pd.Series([[dict(zip(("callee", "start", "end"), c)) for c in cs] for cs in x["calls"]], dtype=object)
            yield x

    return files.select("filename", "source").mapInPandas(run, f"filename string, {FUNCTIONS}")


def bounded(functions: DataFrame, most: int | None = 12000, kind: str = "function") -> DataFrame:
    """The functions of a kind whose text is not empty and not longer than the budget (None: of any length), with the callees they call."""
    x = functions.filter((F.col("kind") == kind) & (F.length("source") >= 1))
    x = x if most is None else x.filter(F.length("source") <= most)
    return x.withColumn("callees", F.transform("calls", lambda c: c["callee"]))
