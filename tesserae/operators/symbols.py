"""Symbols, imports and their graphs, taken from source texts by patterns per language.

All extraction is column expressions; a text is read once for all kinds of symbols of its language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (kind, pattern with the name as its only group) per extension.
PATTERNS = {
    "py": [("function", r"(?m)^[ \t]*(?:async )?def (\w+)"), ("class", r"(?m)^[ \t]*class (\w+)"), ("import", r"(?m)^(?:import|from) ([\w.]+)")],
    "js": [("function", r"(?m)^(?:export )?(?:async )?function (\w+)"), ("class", r"(?m)^(?:export )?class (\w+)"), ("constant", r"(?m)^(?:export )?const (\w+)"), ("import", r"(?m)^import [^\n]*? from '([^'\n]+)'")],
    "ts": [("function", r"(?m)^(?:export )?(?:async )?function (\w+)"), ("class", r"(?m)^(?:export )?class (\w+)"), ("interface", r"(?m)^(?:export )?interface (\w+)"), ("constant", r"(?m)^(?:export )?const (\w+)"), ("import", r"(?m)^import [^\n]*? from '([^'\n]+)'")],
    "rs": [("function", r"(?m)^[ \t]*(?:pub )?(?:async )?fn (\w+)"), ("struct", r"(?m)^(?:pub )?struct (\w+)"), ("constant", r"(?m)^(?:pub )?const (\w+)"), ("import", r"(?m)^use ([\w:]+)")],
}


def _found(ext: Column, text: Column) -> Column:
    """All symbols of a text as an array of (kind, name)."""
    out = F.array().cast("array<struct<kind:string,name:string>>")
    for e, patterns in PATTERNS.items():
        mine = [_named(k, F.regexp_extract_all(text, F.lit(p), 1)) for k, p in patterns]
        out = F.when(ext == e, F.concat(*mine)).otherwise(out)
    return out


def _named(kind: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def found(path: str, text: str) -> Column:
    """All symbols of a text as an array of (kind, name); null for files of other languages and null texts."""
    return F.when(F.col(text).isNotNull() & extension(path).isin(*PATTERNS), _found(extension(path), F.col(text)))


def difference(path: str, before: str, after: str) -> Column:
    """Symbols added or removed between two texts, as an array of (kind, name, change)."""
    b, a = found(path, before), found(path, after)
    mark = lambda x, change: F.transform(x, lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), F.lit(change).alias("change")))
    return F.concat(mark(F.array_except(a, b), "added"), mark(F.array_except(b, a), "removed"))


def table_statistics(found: DataFrame, key: str) -> DataFrame:
    """``kind, n, n_files, n_names, n_ambiguous``: a name is ambiguous if more than one file defines it."""
    per = found.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("f"))
    files = found.groupBy("kind").agg(F.countDistinct(key).alias("n_files"))
    return per.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_names"), F.sum(F.when(F.col("f") > 1, 1).otherwise(0)).alias("n_ambiguous")).join(files, "kind")


def parameters(text: Column) -> Column:
    """Parameter lists of all functions, without nested brackets."""
    return F.regexp_extract_all(text, F.lit(r"(?:def|function|fn) \w+\(([^()\n]*)\)"), 1)
