"""Source files and in-memory sources."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions import text

#: Folders never read, and the patterns read where none are given.
IGNORED = ["node_modules", "dist", "build", "coverage", ".git"]
INCLUDED = ["**/*.{js,jsx,mjs,cjs,ts,tsx,mts,cts}"]


def glob_pattern(glob: str) -> str:
    """The Java pattern of a glob with **, *, ? and {a,b}, for whole relative paths."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = glob[i]
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_-" else c)
        i += 1
    return rf"\A{out}\z"


def selected(filename, patterns=None, include=None, ignore=()):
    """Whether a relative path is to be read: given patterns override include, which overrides the default; ignores always hold."""
    wanted = text.matches_any(filename, [glob_pattern(g) for g in patterns or include or INCLUDED])
    folders = text.matches_any(filename, [rf"(?:\A|/){f.replace('.', chr(92) + '.')}/" for f in IGNORED])
    return wanted & ~folders & ~text.matches_any(filename, [glob_pattern(g) for g in ignore])


def read(spark: SparkSession, root: str, patterns=None, include=None, ignore=()) -> DataFrame:
    """(filename, source) of the selected files below root, one row a file, read whole by the executors."""
    x = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("source"), F.col("_metadata.file_path").alias("path"))
    rest = F.expr("substring(path, instr(path, _root) + length(_root))")
    x = x.withColumn("_root", F.lit(root.split("://")[-1].rstrip("/") + "/")).withColumn("filename", text.decoded_path(rest))
    return x.filter(selected(F.col("filename"), patterns, include, ignore)).select("filename", "source")


def supported(files: DataFrame) -> DataFrame:
    """files of JavaScript or TypeScript by their extension, in any case."""
    return files.filter(text.extension(F.col("filename")).rlike(r"\A\.(?:[mc]?[jt]s|[jt]sx)\z"))
