"""Structure of source texts by their lines and indentation: definitions and their extents, calls, statements.

Everything is column expressions on one text, computed where the text is read; only the small arrays that
result are moved. Definitions and statements are compared within one text, never between rows. Each step is a
column of its own, so that no array is computed again for every element of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that open a definition, and names that a bracket follows without a call.
FUNCTION = r"^[ \t]*(?:export |default |pub |async |static )*(?:def|function|fn) (\w+)(?:<[^>\n]*>)?\(([^)\n]*)"
CLASS = r"^[ \t]*(?:export |default |pub |abstract )*(class|struct|interface|trait|impl) (\w+)"
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "match", "and", "or", "not", "in", "def", "fn", "function", "elif", "assert", "print"]
JUMP, BRANCH = r"^[ \t]*(?:return|raise|throw|break|continue)\b", r"^[ \t]*(?:if|elif|for|while)\b"
SOURCES = ("py", "js", "ts", "rs")


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))


def with_definitions(df: DataFrame, text: str, name: str = "definitions") -> DataFrame:
    """The rows with a column of ``kind, name, line_no, end_line, n_params, is_public, parent, calls, fields`` of each function, class and interface of a text.

    A definition ends before the next one that is indented no further, or with the text. Its parent is the last class
    or interface around it. Calls are different names that a bracket follows below the first line; fields are names
    set on the instance or declared public in it. A null text has none.
    """
    lines, opens, ended = (F.col(c) for c in ("_lines", "_opens", "_ended"))

    def opened(x: Column, i: Column) -> Column:
        head = F.regexp_extract(x, CLASS, 1)
        name = F.when(x.rlike(FUNCTION), F.regexp_extract(x, FUNCTION, 1)).otherwise(F.regexp_extract(x, CLASS, 2))
        kind = F.when(x.rlike(FUNCTION), "function").when(head.isin("interface", "trait"), "interface").otherwise("class")
        params = F.size(F.filter(F.split(F.regexp_extract(x, FUNCTION, 2), ","), lambda p: ~F.trim(p).isin("", "self", "&self", "&mut self")))
        public = x.rlike(r"^[ \t]*(?:export|pub) ") | x.rlike(r"^[ \t]*(?:async )?(?:def|class) [^_]")
        return F.when(name != "", F.struct(kind.alias("kind"), name.alias("name"), (i + 1).cast("long").alias("line_no"), _indent(x).alias("indent"), params.cast("long").alias("n_params"), public.alias("is_public")))

    extent = F.transform(opens, lambda d: d.withField("end_line", F.coalesce(F.array_min(F.transform(F.filter(opens, lambda e: (e["line_no"] > d["line_no"]) & (e["indent"] <= d["indent"])), lambda e: e["line_no"])) - 1, F.size(lines).cast("long"))))

    def whole(d: Column) -> Column:
        around = F.filter(ended, lambda e: (e["kind"] != "function") & (e["line_no"] < d["line_no"]) & (e["end_line"] >= d["line_no"]))
        body = F.array_join(F.slice(lines, (d["line_no"] + 1).cast("int"), F.greatest(F.lit(0), d["end_line"] - d["line_no"]).cast("int")), "\n")
        calls = F.filter(F.array_distinct(F.regexp_extract_all(body, F.lit(r"(\w+)\("), 1)), lambda c: ~c.isin(*NO_CALLS))
        fields = F.array_distinct(F.concat(F.regexp_extract_all(body, F.lit(r"(?:self|this)\.(\w+) = "), 1), F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]+pub (\w+): "), 1)))
        return F.struct(d["kind"].alias("kind"), d["name"].alias("name"), d["line_no"].alias("line_no"), d["end_line"].alias("end_line"), d["n_params"].alias("n_params"), d["is_public"].alias("is_public"), F.try_element_at(around, F.lit(-1))["name"].alias("parent"), calls.alias("calls"), fields.alias("fields"))

    steps = df.withColumn("_lines", F.split(text, "\n")).withColumn("_opens", F.filter(F.transform(lines, opened), lambda d: d.isNotNull())).withColumn("_ended", extent)
    return steps.withColumn(name, F.transform(ended, whole)).drop("_lines", "_opens", "_ended")


def statements(text: Column) -> Column:
    """``line_no, indent, jumps, branches, target, reads`` of each line that is neither blank nor a comment.

    ``target`` is the variable that the line sets, empty if none; ``reads`` are the different names on it that
    no bracket or dot follows, without its target.
    """

    def one(x: Column, i: Column) -> Column:
        target = F.regexp_extract(x, r"^[ \t]*(\w+) = ", 1)
        rest = F.when(target != "", F.regexp_replace(x, r"^[ \t]*\w+ = ", "")).otherwise(x)
        plain = F.regexp_replace(F.regexp_replace(rest, r"\"[^\"\n]*\"|'[^'\n]*'", ""), r"#.*$", "")
        reads = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([a-z_]\w*_\w*)(?:[^\w.(]|$)"), 1))
        return F.when(x.rlike(r"^[ \t]*[^ \t\r#/]"), F.struct((i + 1).cast("long").alias("line_no"), _indent(x).cast("long").alias("indent"), x.rlike(JUMP).alias("jumps"), x.rlike(BRANCH).alias("branches"), target.alias("target"), reads.alias("reads")))

    return F.filter(F.transform(F.split(text, "\n"), one), lambda s: s.isNotNull())


def with_flow(df: DataFrame, text: str, name: str = "flow") -> DataFrame:
    """The rows with a column of ``src, dst, kind`` between statements' lines: the next one unless the line jumps, and from a branch the next that is indented no further."""
    found = F.col("_statements")
    after = lambda s: F.filter(found, lambda t: t["line_no"] > s["line_no"])
    least = lambda a: F.array_min(F.transform(a, lambda t: t["line_no"]))
    edge = lambda s, dst, kind: F.when(dst.isNotNull(), F.struct(s["line_no"].alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")))

    def out(s: Column) -> Column:
        step = F.when(~s["jumps"], edge(s, least(after(s)), "next"))
        over = F.when(s["branches"], edge(s, least(F.filter(after(s), lambda t: t["indent"] <= s["indent"])), "skip"))
        return F.array_compact(F.array(step, over))

    return df.withColumn("_statements", statements(F.col(text))).withColumn(name, F.flatten(F.transform(found, out))).drop("_statements")
