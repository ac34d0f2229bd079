"""Scalar functions on texts, paths and sizes, as column expressions that stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_by_bytes(c) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(_c(c)) * 0.25)


def tokens_by_chars(c) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(_c(c)) / 4)


def tokens_by_chars_floor(c) -> Column:
    return F.floor(F.length(_c(c)) / 4)


def unix_lines(c) -> Column:
    return F.regexp_replace(_c(c), r"\r\n?", "\n")


def lines(c) -> Column:
    """Lines without their ends; a final line end makes no further line."""
    return F.split(F.regexp_replace(unix_lines(c), r"\n\z", ""), "\n")


def words(c) -> Column:
    """Maximal runs of anything but white space; none for a blank text."""
    return F.filter(F.split(_c(c), r"\s+"), lambda w: w != "")


def normalised_code(c) -> Column:
    """Trimmed lines without blank and ``//`` lines."""
    kept = F.filter(F.transform(F.split(unix_lines(c), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("//"))
    return F.array_join(kept, "\n")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def depth(path) -> Column:
    return F.size(F.filter(F.split(_c(path), "/"), lambda x: x != ""))


def name_similarity(a, b) -> Column:
    """1 - edit distance / longer length; 1 for two empty names."""
    longer = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(_c(a), _c(b)) / longer)


def jaccard(a, b) -> Column:
    """Shared over all different items of two arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))), F.lit(0.0))


def line_match_ratio(a, b) -> Column:
    """Lines of a that stand in b, over the longer of both; not symmetric."""
    x, y = _c(a), _c(b)
    return F.size(F.filter(x, lambda v: F.array_contains(y, v))) / F.greatest(F.size(x), F.size(y))


def human_size(c) -> Column:
    n = _c(c).cast("double")
    out = F.concat(F.format_string("%.0f", n), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024.0**power, F.concat(F.format_string("%.1f", F.floor(n / 1024.0**power * 10 + 0.5) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncated(c, n: int) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, max(0, n - 3)), F.lit("..."))).otherwise(_c(c))


def safe_file_name(c) -> Column:
    """Characters that file systems forbid become ``_``; a name of nothing else is ``unnamed``."""
    s = F.trim(F.regexp_replace(_c(c), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    return F.when(s == "", "unnamed").otherwise(s)


def safe_path(c) -> Column:
    """No absolute system folder and no step upwards."""
    return ~_c(c).rlike(r"^/(?:etc|usr|bin|sbin|boot|dev|proc|sys|root|var|lib)(?:/|$)") & ~_c(c).rlike(r"(?:^|/)\.\.(?:/|$)")


def glob(pattern: str) -> str:
    """A glob with ``*``, ``?`` and ``**`` as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def tracked(path, extensions: list[str], ignored: list[str]) -> Column:
    """Whether a path's extension is listed and no ignored glob matches it."""
    p = _c(path)
    hit = extension(p).isin(*[e.lower() for e in extensions])
    return hit & ~p.rlike("|".join(glob(g) for g in ignored)) if ignored else hit


# What adds a branch to a program.
BRANCHES = [r"\bif\b", r"\belse\s+if\b", r"\bwhile\b", r"\bfor\b", r"\bcase\b", r"\bcatch\b", r"\?", r"&&", r"\|\|", r"\bmatch\b"]


def cyclomatic_complexity(c) -> Column:
    """1 + the branches of the text; ``else if`` counts twice."""
    total = F.lit(1)
    for pattern in BRANCHES:
        total = total + F.regexp_count(_c(c), F.lit(pattern))
    return total


def calls(c) -> Column:
    """Different names that an opening bracket follows."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"(\w+)\s*\("), 1)))


def issue_references(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"#(\d+)"), 1)


def commit_keywords(c, stop: list[str]) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"\b([a-z]{3,})\b"), 1))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop]))


def squeezed(c) -> Column:
    """Without block and line comments and with single spaces."""
    s = F.regexp_replace(F.regexp_replace(_c(c), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def sentence_ends(c) -> Column:
    """First and last sentence."""
    s = F.filter(F.transform(F.split(_c(c), r"[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(s) == 0, F.lit("")).when(F.size(s) == 1, F.try_element_at(s, F.lit(1))).otherwise(F.concat(F.try_element_at(s, F.lit(1)), F.lit(" ... "), F.try_element_at(s, F.lit(-1))))


def template_names(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(r"\$\{\{\s*([\w.]+)\s*\}\}"), 1)


def fill_template(c, values: dict[str, str]) -> Column:
    out = _c(c)
    for name, value in values.items():
        out = F.regexp_replace(out, r"\$\{\{\s*" + re.escape(name) + r"\s*\}\}", value.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def decay(age_hours: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_hours / half_life)


def canonical_identifiers(keywords: list[str]):
    """A vectorised function: code with each word that is no keyword replaced by the number of its first appearance.

    Comment lines and blank lines are left out. Numbering needs a dictionary per text, which column expressions
    could only search in quadratic time.
    """
    kept = frozenset(keywords)
    token = re.compile(r"\w+|[^\w\s]")

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        seen: dict[str, str] = {}
        out = []
        for line in t.splitlines():
            line = line.strip()
            if line and not line.startswith(("//", "#")):
                for w in token.findall(line):
                    named = (w[0].isalpha() or w[0] == "_") and w not in kept
                    out.append(seen.setdefault(w, f"_V{len(seen) + 1}_") if named else w)
        return " ".join(out)

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(one)

    return canonical


def common_prefix(paths: Column) -> Column:
    """Longest run of leading folders that all paths of an array share."""
    first = F.split(F.array_min(paths), "/")
    last = F.split(F.array_max(paths), "/")
    # Of sorted paths the first and the last share what all share.
    n = F.aggregate(F.sequence(F.lit(1), F.least(F.size(first), F.size(last))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, i: F.struct(F.when(s["on"] & (F.element_at(first, i) == F.element_at(last, i)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (F.element_at(first, i) == F.element_at(last, i))).alias("on")))["n"]
    return F.array_join(F.slice(first, F.lit(1), n), "/")


def keep_trailing_lines(c, budget: int) -> Column:
    """As many last lines as their estimated tokens allow, at least one."""
    ls = F.reverse(lines(c))
    kept = F.aggregate(ls, F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["used"] + tokens_by_chars(x)).alias("used"), F.when(s["on"] & ((s["used"] + tokens_by_chars(x) <= budget) | (s["n"] == 0)), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & (s["used"] + tokens_by_chars(x) <= budget)).alias("on")))["n"]
    return F.array_join(F.reverse(F.slice(ls, F.lit(1), kept)), "\n")
