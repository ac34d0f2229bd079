"""Generated, minified, vendored and data files among source files.

A repository may declare such paths in attribute files; their globs are resolved as git resolves them
(later lines and deeper folders win) and decide whatever they mention. Rules meet paths by an equality join:
each glob has a key, the file name, ending or folder that any path it matches must have, and each path has
all of its own. Rules that several repositories declare alike are mined and applied to repositories that
declare nothing. For paths that no rule of their own repository mentions there are further sources, in this
order: what the content itself shows, a short list of patterns that public attribute files agree on, mined
rules, and folder names mined from the corpus, which are those whose files nearly all show the same kind of
content, wherever the folder lies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import slices
from tesserae.runtime import materialize

# Patterns that public attribute files commonly mark.
DECLARED_WIDELY = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/site-packages/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/vendor/** linguist-vendored
**/external/** linguist-vendored
**/externals/** linguist-vendored
**/deps/** linguist-vendored
**/Pods/** linguist-vendored
**/Carthage/** linguist-vendored
*.min.js linguist-generated
*.min.css linguist-generated
*.bundle.js linguist-generated
*.map linguist-generated
*.lock linguist-generated
package-lock.json linguist-generated
npm-shrinkwrap.json linguist-generated
pnpm-lock.yaml linguist-generated
go.sum linguist-generated
*.pb.go linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*.g.dart linguist-generated
*.designer.cs linguist-generated
"""
ATTRIBUTES = ("linguist-generated", "linguist-vendored")
PROSE = {"md", "markdown", "txt", "rst", "adoc", "tex"}
CODE = {"py", "js", "ts", "rs", "jsx", "tsx", "mjs", "cjs", "go", "java", "c", "h", "cpp", "cc", "rb", "php", "cs", "kt", "swift", "scala", "css"}
IMAGES = {"png", "jpg", "jpeg", "gif", "ico", "bmp", "webp", "svg", "tif", "tiff"}
#: A folder name is mined if its true share of files of the same kind, over different paths, is at least this
#: with 97.5 percent confidence (Wilson's bound): 22 of 22 files do, or 58 of 60.
MINED_SHARE, MINED_Z = 0.85, 1.96
#: A rule is mined if so many repositories declare it, and this share of those that mention it agree.
MINED_REPOSITORIES, MINED_AGREE = 2, 0.9

# --- attribute files ----------------------------------------------------------------------------


@lru_cache(4096)
def glob_regex(pattern: str) -> re.Pattern:
    """The paths, relative to the attribute file's folder, that one of its patterns matches."""
    anchored = "/" in pattern.rstrip("/")
    p, out, i = pattern.removeprefix("/"), [], 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and (i == 0 or p[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            inner = p[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out.append(re.escape(p[i + 1]))
            i += 2
        else:
            out.append(re.escape(p[i]))
            i += 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z", re.DOTALL)
    except re.error:
        return re.compile(r"(?!)")


def parse_attributes(text: str) -> list[tuple[str, dict[str, bool | None]]]:
    """``(pattern, {attribute: True, False or None})`` in order; None means unspecified again. Other attributes are left out."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == "#" or line.startswith("[attr]"):
            continue
        if line[0] == '"':
            end = line.find('"', 1)
            pattern, rest = line[1:end], line[end + 1 :].split()
        else:
            pattern, *rest = line.split()
        said: dict[str, bool | None] = {}
        for word in rest:
            name, _, value = word.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                said[name] = None if word[0] == "!" else not (word[0] == "-" or value.lower() == "false")
        if said and not pattern.startswith("!"):
            rules.append((pattern, said))
    return rules


def declared(path: str, files: Iterable[tuple[str, str]]) -> bool | None:
    """Whether attribute files ``(folder, text)`` mark the path as generated or vendored; None if they say nothing."""
    said: dict[str, bool | None] = {}
    for folder, text in sorted(files, key=lambda f: (len(f[0]), f[0])):
        inside = path.removeprefix(folder + "/") if folder and path.startswith(folder + "/") else None if folder else path
        if inside is None:
            continue
        for pattern, values in _parsed(text):
            if glob_regex(pattern).match(inside):
                said |= values
    known = [v for v in said.values() if v is not None]
    return any(known) if known else None


@lru_cache(1024)
def _parsed(text: str) -> tuple:
    return tuple(parse_attributes(text))


def rule_key(pattern: str) -> str:
    """What every path that the glob matches has: ``n:`` its name, ``s:`` an ending of it, ``d:`` a folder on the way; ``*`` if the glob promises nothing."""
    *folders, name = pattern.strip("/").split("/")
    if not re.search(r"[*?\[\\]", name):
        return f"n:{name}"
    if name[:2] == "*." and not re.search(r"[*?\[\\]", name[1:]):
        return f"s:{name[1:]}"
    plain = [f for f in folders if not re.search(r"[*?\[\\]", f)]
    return f"d:{max(plain, key=len)}" if plain else "*"


def path_keys(path: Column) -> Column:
    """All keys of a path that a rule may have, as an array."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    ends = F.split(name, r"\.")
    endings = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(ends))), lambda i: F.concat(F.lit("s:."), F.array_join(F.slice(ends, i, F.size(ends)), ".")))
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda f: F.concat(F.lit("d:"), f))
    return F.array_distinct(F.concat(F.array(F.lit("*"), F.concat(F.lit("n:"), name)), endings, folders))


def rules_of(attributes: DataFrame) -> DataFrame:
    """``workspace, folder, line_no, pattern, attribute, mark, key`` of attribute files ``workspace, folder, text``; mark is 1, 0 or -1 for unspecified again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (w, folder, n, pattern, name, -1 if value is None else int(value), rule_key(pattern))
                for w, folder, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for n, (pattern, said) in enumerate(parse_attributes(text or ""))
                for name, value in said.items()
            ]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["workspace", "folder", "line_no", "pattern", "attribute", "mark", "key"])

    return attributes.select("workspace", F.coalesce("folder", F.lit("")).alias("folder"), "text").where("workspace is not null").mapInArrow(run, "workspace string, folder string, line_no long, pattern string, attribute string, mark long, key string")


def _matching(candidates: DataFrame) -> DataFrame:
    """The candidates ``..., _path, folder, pattern`` whose glob matches the path inside the folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, folder, pattern = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_path", "folder", "pattern"))
            hit = [bool((not f or p.startswith(f + "/")) and glob_regex(g).match(p[len(f) + 1 :] if f else p)) for p, f, g in zip(path, folder, pattern)]
            yield batch.filter(pa.array(hit, pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)


def declared_marks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``workspace, _path, mark`` of different ``workspace, _path`` that a rule of their own repository mentions."""
    keyed = files.select("workspace", "_path", F.explode(path_keys(F.col("_path"))).alias("key"))
    hits = _matching(keyed.join(rules, ["workspace", "key"]).select("workspace", "_path", "folder", "pattern", "line_no", "attribute", "mark"))
    last = hits.groupBy("workspace", "_path", "attribute").agg(F.max_by("mark", F.struct(F.length("folder"), "folder", "line_no")).alias("mark")).where("mark >= 0")
    return last.groupBy("workspace", "_path").agg((F.max("mark") == 1).alias("mark"))


def mined_rules(rules: DataFrame) -> DataFrame:
    """``pattern, folder, key`` of rules that repositories agree on; globs without a key and bare endings of program text are too general."""
    last = rules.groupBy("workspace", "folder", "pattern", "attribute", "key").agg(F.max_by("mark", "line_no").alias("mark")).where("mark >= 0")
    each = last.groupBy("folder", "pattern", "key", "workspace").agg(F.max("mark").alias("mark"))
    per = each.groupBy("folder", "pattern", "key").agg(F.sum("mark").alias("yes"), F.count(F.lit(1)).alias("n"))
    bare = [f"s:.{e}" for e in sorted(CODE)]
    return per.where((F.col("yes") >= MINED_REPOSITORIES) & (F.col("yes") >= MINED_AGREE * F.col("n")) & (F.col("key") != "*") & ~F.col("key").isin(*bare)).select("pattern", "folder", "key")


# --- content ------------------------------------------------------------------------------------

_COMMENT = r"(?m)^[ \t]*(?://+|#+|/\*+!?|\*+|<!--|--|;+|\"\"\"|''')[ \t]*"
_GENERATED = re.compile(
    _COMMENT
    + r"[^\n]*?(?:<auto-?generated|@generated\b|\bauto-?generated (?:file|code|by|from)|\b(?:code|file|source|automatically) generated (?:by|from|with)|DO NOT EDIT\b"
    r"|\bdo not (?:edit|modify|change) (?:this file|by hand|manually|directly)|\b(?:automatically|machine)[ -](?:produced|made|written|created|generated)\b"
    r"|\bemitted from \S+|\bgenerated (?:from|by) \S+[^\n]*(?:do not|don't|overwritten|will be lost)|\bedit the (?:template|source|schema)[^\n]*not this|changes (?:will|would) be (?:lost|overwritten))",
    re.IGNORECASE,
)
# Every mark above has one of these in lower case.
_MARK_WORDS = ("generated", "do not ", "machine", "automatically", "emitted from", "edit the ", "changes w")
_HTML_MARK = re.compile(r"(?s)<!--.*?-->")
_HEAD_LINE = re.compile(r"[ \t]*(?:(?://|#|--|;|\*)[^\n]*|/\*(?:[^*]|\*(?!/))*\*/[ \t]*|<!--(?:[^-]|-(?!->))*-->[ \t]*|(?:\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|\'\'\'(?:[^\']|\'(?!\'\'))*\'\'\')[ \t]*)?(?:\n|\Z)")
_ONCE = re.compile(r"(?i)\bwas (?:auto-?)?generated\b|\bonce\b|\bnow (?:maintained|edited|written)\b|\bno longer\b|\bused to be\b")
_BANNER = re.compile(r"\s*(?:/\*!?|\"\"\"|#|//|<!--)[\s*!]*@?[\w./-]+(?: -)? v?\d+\.\d+(?:\.\d+)?[\w.-]*\b[^\n]*(?:\n[^\n]*){0,3}?\b(?:licen[cs]e|copyright|\(c\))", re.IGNORECASE)
_MAP = re.compile(r'\s*\{\s*"version"\s*:\s*3\s*,[^\n]{0,400}?"(?:file|sources|mappings|names|sections)"')
_NUMBERS = re.compile(r"(?:\s*-?(?:0x[0-9a-fA-F]+|\d[\d.]*(?:e-?\d+)?)\s*,){12,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{60,}")
_RUN = re.compile(rb"[aA_]*[a9A_]+")
_SHAPE = bytes(97 if chr(c).isalpha() and c < 128 or c == 95 else 57 if 48 <= c < 58 else c if c < 128 else 97 for c in range(256))
_MACHINE_SHARE, _MACHINE_LINES = 0.9, 12
_DATA_SHARE, _DATA_LETTERS = 0.8, 700
_LINE_LETTERS, _SPACE_SHARE = 200, 0.06


def _is_minified(text: str) -> bool:
    """Long lines of program text with hardly any white space."""
    lines = [line for line in text.split("\n") if line.strip()]
    body = [line for line in lines if not line.lstrip().startswith(("//", "/*", "*"))]
    letters = sum(map(len, body))
    if letters < 200 or letters / len(body) < _LINE_LETTERS and not (max(map(len, body)) > 500 and max(map(len, body)) > 0.8 * letters):
        return False
    joined = "".join(body)
    blanks = joined.count(" ") + joined.count("\t")
    return blanks < _SPACE_SHARE * letters and sum(map(joined.count, "{}();=,")) > 0.08 * letters


def _is_machine_made(text: str) -> bool:
    """Line after line of the same few shapes, as templates write them and people do not."""
    if text.count("\n") + 1 < _MACHINE_LINES:
        return False
    shape = _RUN.sub(b"w", text.encode("utf-8", "replace").translate(_SHAPE))
    lines = [s for s in (line.strip() for line in shape.split(b"\n")) if len(s) > 2]
    if len(lines) < _MACHINE_LINES:
        return False
    common = Counter(lines).most_common(4)
    calls = sum(n for s, n in common if b"[" in s and b"." in s)
    return sum(n for _, n in common) >= _MACHINE_SHARE * len(lines) and calls >= 0.3 * len(lines)


def _is_data(text: str) -> bool:
    """Almost nothing but one literal of numbers or encoded bytes."""
    if len(text) < _DATA_LETTERS:
        return False
    held = sum(len(m[0]) for m in _BASE64.finditer(text))
    if held < _DATA_SHARE * len(text):
        held += sum(len(m[0]) for m in _NUMBERS.finditer(text))
    return held >= _DATA_SHARE * len(text)


def _has_banner(text: str) -> bool:
    """Whether a comment block before the first statement opens with the name, version and licence of a library."""
    at, fresh = 0, True
    while at < len(text) and (line := _HEAD_LINE.match(text, at)) and line.end() > at:
        body = line[0].strip()
        if fresh and body and _BANNER.match(text, at):
            return True
        fresh = not body or body.endswith(("*/", "-->", '"""', "'''"))
        at = line.end()
    # A comment that is never closed, or is opened by other marks, is judged by itself.
    return fresh and at < len(text) and bool(_BANNER.match(text, at))


def _is_marked(ext: str, text: str) -> bool:
    """Whether a comment says that a generator wrote the file; in prose only a hidden comment can."""
    lower = text.lower()
    if not any(w in lower for w in _MARK_WORDS):
        return False
    for part in [m[0] for m in _HTML_MARK.finditer(text)] if ext in PROSE else [text]:
        for m in _GENERATED.finditer(part):
            end = part.find("\n", m.start())
            if not _ONCE.search(part[m.start() : end if end >= 0 else len(part)]):
                return True
    return False


def content_kind(path: str, text: str) -> str | None:
    """``generated``, ``minified``, ``vendored``, ``data`` or None, from the whole content and the name's ending."""
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if ext in IMAGES or not text.strip():
        return None
    if _MAP.match(text):
        return "generated"
    if ext in CODE and _has_banner(text):
        return "vendored"
    if _is_marked(ext, text):
        return "generated"
    if ext not in CODE:
        return None
    if _is_data(text):
        return "data"
    if ext in ("js", "ts", "jsx", "tsx", "mjs", "cjs", "css") and _is_minified(text):
        return "minified"
    return "generated" if _is_machine_made(text) else None


@lru_cache(200_000)
def _widely(path: str) -> bool:
    return bool(declared(path, (("", DECLARED_WIDELY),)))


def _evidence(files: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                paths, shown, wide = part.column(1).to_pylist(), [], []
                for path, text in zip(paths, part.column(2).to_pylist()):
                    image = path.rsplit(".", 1)[-1].lower() in IMAGES
                    shown.append(None if image else content_kind(path, text))
                    wide.append(not image and bool(text) and _widely(path))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shown, pa.string()), pa.array(wide, pa.bool_()), pa.array([p.rsplit(".", 1)[-1].lower() in IMAGES or not t for p, t in zip(paths, part.column(2).to_pylist())], pa.bool_())], names=["_id", "_path", "shown", "wide", "exempt"])

    return files.mapInArrow(run, f"_id {kind}, _path string, shown string, wide boolean, exempt boolean")


def not_handwritten(records: DataFrame, id_column: str, path_column: str, text_column: str, workspaces: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """``<id>, reason`` of the files that nobody wrote by hand.

    ``workspaces`` has ``<id>, workspace``, the repository of each record that has a known one, and
    ``attributes`` ``workspace, folder, text``, their attribute files. reason is ``declared``, what the content
    shows, ``pattern``, ``mined`` or ``folder``. Null texts, empty texts and images are never listed; a null
    path is read as a path without a name; a repeated id counts once and is listed if any delivery of it is; no
    rows give no rows. Recorded sizes are not needed: texts are there whole, and some sizes are wrong.
    """
    kind = records.schema[id_column].dataType.simpleString()
    files = records.select(F.col(id_column).alias("_id"), F.coalesce(F.col(path_column), F.lit("")).alias("_path"), F.col(text_column).alias("_text")).where("_text is not null and _id is not null")
    seen = materialize(_evidence(files, kind))
    segments = F.array_distinct(F.slice(F.split("_path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("_path", "/")) - 1)))
    n, yes = F.col("n"), F.greatest("generated", "vendored")
    share, z2 = yes / n, MINED_Z**2
    bound = (share + z2 / (2 * n) - MINED_Z * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    mined = (
        seen.where("not exempt")
        .groupBy("_path")
        .agg(*[F.max((F.coalesce("shown", F.lit("")) == k).cast("int")).alias(k) for k in ("generated", "vendored")])
        .select(F.explode(segments).alias("segment"), "generated", "vendored")
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("generated").alias("generated"), F.sum("vendored").alias("vendored"))
        .where(bound >= MINED_SHARE)
        .select("segment")
    )
    in_folder = seen.where("not exempt and shown is null and not wide").select("_id", F.explode(segments).alias("segment")).join(mined, "segment").select("_id", F.lit("folder").alias("reason"), F.lit(3).alias("rank"))
    reason = F.when(F.col("exempt"), F.lit(None)).when(F.col("shown").isNotNull(), F.col("shown")).when(F.col("wide"), F.lit("pattern"))
    own = seen.select("_id", reason.alias("reason"), F.lit(1).alias("rank")).where("reason is not null").unionByName(in_folder)
    best = lambda df: df.groupBy("_id").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))
    listed = lambda df: df.select(F.col("_id").alias(id_column), "reason")
    if attributes is None or workspaces is None:
        return listed(best(own))
    rules = materialize(rules_of(attributes))
    if rules.isEmpty():
        return listed(best(own))

    home = workspaces.select(F.col(id_column).alias("_id"), "workspace").where("workspace is not null").distinct()
    placed = materialize(seen.where("not exempt").select("_id", "_path").distinct().join(home, "_id", "left"))
    declaring = rules.select("workspace").distinct()
    marks = declared_marks(placed.join(declaring, "workspace", "left_semi").select("workspace", "_path").distinct(), rules)
    told = placed.join(marks, ["workspace", "_path"]).groupBy("_id").agg(F.max("mark").alias("mark"))
    other = placed.join(declaring, "workspace", "left_anti").select("_id", "_path")
    keyed = other.select("_path").distinct().select("_path", F.explode(path_keys(F.col("_path"))).alias("key"))
    alike = _matching(keyed.join(mined_rules(rules), "key").select("_path", "folder", "pattern")).select("_path").distinct()
    by_rule = other.join(alike, "_path", "left_semi").select("_id", F.lit("mined").alias("reason"), F.lit(2).alias("rank"))
    both = best(own.unionByName(by_rule)).join(told, "_id", "full_outer").where("coalesce(mark, true)")
    return listed(both.select("_id", F.when(F.col("mark"), F.lit("declared")).otherwise(F.col("reason")).alias("reason")))
