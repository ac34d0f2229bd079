"""Queries on the symbols and imports of source files, and on the tone and shape of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import symbols
from tesserae.plans.metrics import _FC, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _list(column: str) -> str:
    parts = [f"when ext = '{e}' then list_concat(" + ", ".join(f"list_transform(regexp_extract_all({column}, '{p.replace(chr(39), chr(39) * 2)}', 1), lambda n: {{'kind': '{k}', 'name': n}})" for k, p in ps) + ")" for e, ps in symbols.PATTERNS.items()]
    return "case " + " ".join(parts) + " end"


_X = f"{_FC}, x as (select *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) ext from fc where path is not null), sy as (select id, path, s.kind kind, s.name name from (select id, path, unnest({_list('new_content')}) s from x where new_content is not null and ext in ('py', 'js', 'ts', 'rs')))"


def _symbols(spark, root):
    found = contents_once(spark, root, path=F.col("path"), found=symbols.found("path", "new_content"))
    return found.select("id", "path", F.explode("found").alias("s")).select("id", "path", "s.kind", "s.name")


@query(f"with {_X} select kind, count(*) n, count(distinct id) n_files, (select count(*) from (select name from sy s2 where s2.kind = sy.kind group by name)) n_names, (select count(*) from (select name from sy s2 where s2.kind = sy.kind group by name having count(distinct id) > 1)) n_ambiguous from sy group by kind")
def symbol_statistics(spark, root):
    return symbols.table_statistics(_symbols(spark, root), "id")


@query(f"with {_X} select kind, name, count(*) n from sy where kind <> 'import' group by 1, 2 order by n desc, kind, name limit 40")
def top_symbols(spark, root):
    return _symbols(spark, root).where("kind <> 'import'").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind", "name").limit(40)


@query(f"with {_X}, o as (select id, unnest({_list('original_content')}) s from x where original_content is not null and new_content is not null and ext in ('py', 'js', 'ts', 'rs')), n as (select id, unnest({_list('new_content')}) s from x where original_content is not null and new_content is not null and ext in ('py', 'js', 'ts', 'rs')) select id, s.kind as kind, s.name as name, 'added' as change from (select distinct id, s from n except select distinct id, s from o) union all select id, s.kind, s.name, 'removed' from (select distinct id, s from o except select distinct id, s from n)")
def symbol_changes(spark, root):
    changed = contents_once(spark, root, changed=symbols.difference("path", "original_content", "new_content"))
    return changed.select("id", F.explode("changed").alias("s")).select("id", "s.kind", "s.name", "s.change")


@query(f"with {_X} select path, count(distinct name) n_imports, sum(case when starts_with(name, '.') or starts_with(name, 'crate::') then 0 else 1 end)::bigint n_external from (select distinct path, name from sy where kind = 'import') group by 1")
def import_graph(spark, root):
    i = _symbols(spark, root).where("kind = 'import'").select("path", "name").distinct()
    inner = F.col("name").startswith(".") | F.col("name").startswith("crate::")
    return i.groupBy("path").agg(F.count(F.lit(1)).alias("n_imports"), F.sum(F.when(inner, 0).otherwise(1)).alias("n_external"))


@query(f"with {_X} select name as module, count(distinct path) n_dependents from sy where kind = 'import' group by 1 order by n_dependents desc, module limit 30")
def most_imported(spark, root):
    return _symbols(spark, root).where("kind = 'import'").groupBy(F.col("name").alias("module")).agg(F.countDistinct("path").alias("n_dependents")).orderBy(F.desc("n_dependents"), "module").limit(30)


@query(f"with {_X} select round((select count(*) from (select distinct path, name from sy where kind = 'import')) / (select count(distinct path) from sy), 6) density")
def dependency_density(spark, root):
    s = _symbols(spark, root)
    edges = s.where("kind = 'import'").select("path", "name").distinct().agg(F.count(F.lit(1)).alias("e"))
    return edges.join(F.broadcast(s.agg(F.countDistinct("path").alias("m")))).select(F.round(F.coalesce(F.try_divide("e", "m"), F.lit(0.0)), 6).alias("density"))


@query(f"with {_X}, p as (select id, unnest(regexp_extract_all(new_content, '(?:def|function|fn) \\w+\\(([^()\\n]*)\\)', 1)) a from x where new_content is not null and ext in ('py', 'js', 'ts', 'rs')) select id, count(*) n_functions, max(case when trim(a) = '' then 0 else len(string_split(a, ',')) end) most_parameters from p group by 1")
def parameter_lists(spark, root):
    lists = F.when(symbols.extension().isin(*symbols.PATTERNS), symbols.parameters(F.col("new_content")))
    p = contents_once(spark, root, lists=lists).select("id", F.explode("lists").alias("a"))
    return p.groupBy("id").agg(F.count(F.lit(1)).alias("n_functions"), F.max(F.when(F.trim("a") == "", 0).otherwise(F.size(F.split("a", ",")))).alias("most_parameters"))


@query(f"with {_X} select ext, count(*) n, sum(case when regexp_matches(new_content, '(?m)^[ \\t]*(///|/\\*\\*|\"\"\")') then 1 else 0 end)::bigint n_documented, sum(case when len(string_split(new_content, chr(10))) > 80 then 1 else 0 end)::bigint n_long from x where new_content is not null and ext in ('py', 'js', 'ts', 'rs') group by 1")
def documentation_coverage(spark, root):
    text = F.col("new_content")
    ext = F.when(text.isNotNull() & symbols.extension().isin(*symbols.PATTERNS), symbols.extension())
    c = contents_once(spark, root, ext=ext, documented=text.rlike(r'(?m)^[ \t]*(///|/\*\*|""")'), long=F.size(F.split(text, "\n")) > 80).where("ext is not null")
    return c.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("documented"), 1).otherwise(0)).alias("n_documented"), F.sum(F.when(F.col("long"), 1).otherwise(0)).alias("n_long"))


_POS, _NEG = "fixed|safe|clean|fine|ready", "failed|lost|missing|slower|error"


@query(f"select doc_id, least(1.0, greatest(-1.0, round((len(regexp_extract_all(lower(text), '\\b({_POS})\\b')) - len(regexp_extract_all(lower(text), '\\b({_NEG})\\b'))) / greatest(1, len(regexp_extract_all(text, '\\S+'))), 6))) tone from documents where text is not null")
def document_tone(spark, root):
    pos, neg = (F.regexp_count(F.lower("text"), F.lit(rf"\b({p})\b")) for p in (_POS, _NEG))
    n = F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"[^\t\n\f\r ]+")))
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.round((pos - neg) / n, 6))).alias("tone"))


@query(r"select doc_id, length(text) n_chars, len(regexp_extract_all(text, '\?')) n_questions, len(regexp_extract_all(text, '`[^`\n]+`')) n_quoted, len(regexp_extract_all(text, '\d+')) n_numbers, len(regexp_extract_all(text, '[A-Za-z]+[A-Z][a-z]+')) n_names, round(least(1.0, length(text) / 2000.0), 6) size_class from documents where text is not null")
def text_features(spark, root):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.length("text").alias("n_chars"), n(r"\?").alias("n_questions"), n(r"`[^`\n]+`").alias("n_quoted"), n(r"\d+").alias("n_numbers"), n(r"[A-Za-z]+[A-Z][a-z]+").alias("n_names"), F.round(F.least(F.lit(1.0), F.length("text") / 2000), 6).alias("size_class"))


@query("select workspace_path, count(distinct s.id) n_sessions, count(distinct c.id) n_checkpoints, count(distinct f.id) n_changes from sessions s left join checkpoints c on lower(trim(c.session_id)) = lower(trim(s.id)) left join file_changes f on lower(trim(f.checkpoint_id)) = lower(trim(c.id)) group by 1")
def workspace_rollup(spark, root):
    key = lambda c: F.lower(F.trim(c))
    s = table(spark, root, "sessions").select("workspace_path", F.col("id").alias("sid"), key("id").alias("k")).distinct()
    c = table(spark, root, "checkpoints").select(F.col("id").alias("cid"), key("session_id").alias("k"), key("id").alias("ck")).distinct()
    # Changes are counted per checkpoint before they are joined, each change belonging to one.
    f = table(spark, root, "file_changes").select(key("checkpoint_id").alias("ck"), "id").distinct().groupBy("ck").agg(F.count(F.lit(1)).alias("n"))
    per = s.join(c, "k", "left").join(f, "ck", "left").select("workspace_path", "sid", "cid", "n").distinct()
    return per.groupBy("workspace_path").agg(F.countDistinct("sid").alias("n_sessions"), F.countDistinct("cid").alias("n_checkpoints"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_changes"))
