"""Queries on texts, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import classify, text
from tesserae.operators import spelling
from tesserae.plans.metrics import _CP, _FC, changes_once, checkpoints_once, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _docs(spark, root):
    return table(spark, root, "documents")


@query("select doc_id, strlen(text) // 4 by_bytes, cast(ceil(length(text) / 4) as bigint) by_chars, length(text) // 4 by_chars_floor from documents where text is not null")
def token_estimates(spark, root):
    return _docs(spark, root).where("text is not null").select("doc_id", text.tokens_by_bytes("text").alias("by_bytes"), text.tokens_by_chars("text").alias("by_chars"), text.tokens_by_chars_floor("text").alias("by_chars_floor"))


@query(r"select doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) digest from documents where text is not null")
def unix_line_digest(spark, root):
    return _docs(spark, root).where("text is not null").select("doc_id", F.sha2(text.unix_lines("text"), 256).alias("digest"))


_NORMAL = r"array_to_string(list_filter(list_transform(string_split(regexp_replace({c}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' and not starts_with(x, '//')), chr(10))"


@query(f"with {_FC} select id, sha256({_NORMAL.format(c='new_content')}) normal from fc where new_content is not null")
def normalised_code(spark, root):
    return contents_once(spark, root, normal=F.sha2(text.normalised_code("new_content"), 256)).where("normal is not null")


@query(rf"""with {_FC} select distinct path, lower(regexp_extract(path, '\.([^./]+)$', 1)) ext, len(list_filter(string_split(path, '/'), lambda p: p <> '')) as depth,
case when regexp_matches(lower(path), 'ui|view|component|page') then 'Presentation' when regexp_matches(lower(path), 'service|manager|logic|core') then 'Business Logic' when regexp_matches(lower(path), 'db|storage|repository|model') then 'Data Access' when regexp_matches(lower(path), 'api|protocol|route') then 'API/Protocol' when regexp_matches(lower(path), 'config|infra') then 'Infrastructure' end as layer,
case when regexp_matches(lower(path), 'test|spec') then 'Testing' when regexp_matches(lower(path), 'gui|ui|component') then 'UI/Frontend' when regexp_matches(lower(path), 'api|route|controller') then 'API' when regexp_matches(lower(path), 'auth|security') then 'Authentication' when regexp_matches(lower(path), 'db|model|migration') then 'Database' when regexp_matches(lower(path), 'config|setting') then 'Configuration' when regexp_matches(lower(path), 'util|helper|lib') then 'Utilities' when regexp_matches(lower(path), 'doc|readme') then 'Documentation' when regexp_matches(lower(path), 'build|script|ci') then 'Build/CI' else split_part(path, '/', 1) end as feature
from fc where path is not null""")
def path_classes(spark, root):
    p = F.col("path")
    c = changes_once(spark, root).where("path is not null").select("path").distinct()
    return c.select("path", text.extension("path").alias("ext"), text.depth("path").alias("depth"), classify.layer(p).alias("layer"), classify.feature(p).alias("feature"))


@query(f"with {_FC}, m(e, l) as (values {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in classify.LANGUAGE_OF.items())}) select coalesce(l, 'text') as language, count(*) n from fc left join m on e = lower(regexp_extract(path, '\\.([^./]+)$', 1)) group by 1")
def language_histogram(spark, root):
    return changes_once(spark, root).groupBy(classify.language(text.extension(F.coalesce("path", F.lit("")))).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_CP}, m as (select id, coalesce(description, '') d, lower(coalesce(description, '')) l from cp) select id,
case when starts_with(l, 'feat') or contains(l, 'add') or contains(l, 'implement') or contains(l, 'create') then 'feature' when starts_with(l, 'fix') or contains(l, 'bug') or contains(l, 'resolve') or contains(l, 'patch') then 'bugfix'
when starts_with(l, 'refactor') or contains(l, 'restructure') or contains(l, 'reorganize') then 'refactor' when starts_with(l, 'docs') or contains(l, 'documentation') then 'documentation' when starts_with(l, 'test') or contains(l, 'spec') then 'test'
when starts_with(l, 'style') or contains(l, 'format') then 'style' when starts_with(l, 'chore') or contains(l, 'maintenance') then 'maintenance' when starts_with(l, 'perf') or contains(l, 'performance') or contains(l, 'optimize') then 'performance'
when starts_with(l, 'security') or contains(l, 'secure') then 'security' else 'other' end as commit_type,
nullif(regexp_extract(d, '\\(([^)]+)\\)', 1), '') as message_scope, contains(d, 'BREAKING CHANGE') or contains(d, '!:') as is_breaking, contains(l, 'architecture') or contains(l, 'design') as is_decision from m""")
def commit_types(spark, root):
    """Type, scope and marks of each message."""
    d = F.coalesce("description", F.lit(""))
    scope = F.nullif(F.regexp_extract(d, r"\(([^)]+)\)", 1), F.lit(""))
    return checkpoints_once(spark, root).select("id", classify.first_match(F.lower(d), classify.COMMITS, "other").alias("commit_type"), scope.alias("message_scope"), (d.contains("BREAKING CHANGE") | d.contains("!:")).alias("is_breaking"), F.lower(d).rlike("architecture|design").alias("is_decision"))


@query("""select doc_id, case when regexp_matches(l, 'how to|implement|create|build|add|write|make|develop|code|generate') then 'implementation' when regexp_matches(l, 'error|bug|fix|issue|problem|not working|debug|broken|fails?|crash') then 'debugging'
when regexp_matches(l, 'refactor|improve|optimize|restructure|clean up|reorganize|simplify') then 'refactoring' when regexp_matches(l, 'what is|explain|how does|understand|clarify|describe|tell me about') then 'explanation'
when regexp_matches(l, 'architecture|design|pattern|structure|organize|system|framework') then 'architecture' when regexp_matches(l, 'test|testing|unit test|integration test|mock|spec|coverage') then 'testing' when regexp_matches(l, 'document|docs|comment|readme|guide|tutorial') then 'documentation' end as question_type,
case when regexp_matches(l, 'how to|implement|create|build') then 'implementation' when regexp_matches(l, 'error|bug|fix|issue|problem') then 'debugging' when regexp_matches(l, 'refactor|improve|optimize') then 'refactoring' when regexp_matches(l, 'what is|explain|how does') then 'explanation' else 'general' end as learned_type,
case when regexp_matches(l, 'function|method|procedure|routine') then 'function' when regexp_matches(l, 'class|object|constructor|instance') then 'class' when regexp_matches(l, 'module|file|component|service') then 'module' when regexp_matches(l, 'package|library|framework|dependency') then 'package' when regexp_matches(l, 'system|application|architecture|entire|whole|all') then 'system' else 'function' end as scope_type,
case when regexp_matches(l, 'system|application|entire|whole|all|global') then 'system' when regexp_matches(l, 'module|package|namespace|library') then 'module' when regexp_matches(l, 'class|interface|type|object') then 'class' when regexp_matches(l, 'function|method|procedure') then 'function' when regexp_matches(l, 'variable|property|field|attribute') then 'variable' else 'module' end as wide_scope
from (select doc_id, lower(text) l from documents where text is not null)""")
def question_types(spark, root):
    """Type and scope of each text by the ordered rules; a text that no type rule matches has none."""
    t = F.lower("text")
    return _docs(spark, root).where("text is not null").select("doc_id", classify.first_match(t, classify.QUESTIONS, None).alias("question_type"), classify.first_match(t, classify.LEARNED_QUESTIONS, "general").alias("learned_type"), classify.first_match(t, classify.SCOPES, "function").alias("scope_type"), classify.first_match(t, classify.WIDE_SCOPES, "module").alias("wide_scope"))


@query("""with q as (select lower(text) l from documents where text is not null) select * from (select 'implementation' as l, count(*) n from q where regexp_matches(l, 'how to|implement|create|build|add|write|make|develop|code|generate')
union all select 'debugging', count(*) from q where regexp_matches(l, 'error|bug|fix|issue|problem|not working|debug|broken|fails?|crash') union all select 'refactoring', count(*) from q where regexp_matches(l, 'refactor|improve|optimize|restructure|clean up|reorganize|simplify')
union all select 'explanation', count(*) from q where regexp_matches(l, 'what is|explain|how does|understand|clarify|describe|tell me about') union all select 'architecture', count(*) from q where regexp_matches(l, 'architecture|design|pattern|structure|organize|system|framework')
union all select 'testing', count(*) from q where regexp_matches(l, 'test|testing|unit test|integration test|mock|spec|coverage') union all select 'documentation', count(*) from q where regexp_matches(l, 'document|docs|comment|readme|guide|tutorial')) where n > 0""")
def question_labels(spark, root):
    return _docs(spark, root).where("text is not null").select(F.explode(classify.all_matches(F.lower("text"), classify.QUESTIONS)).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_FC} select id, 1 + " + " + ".join(f"len(regexp_extract_all(new_content, '{p}'))" for p in text.BRANCHES) + " as complexity from fc where new_content is not null")
def complexity(spark, root):
    return contents_once(spark, root, complexity=text.cyclomatic_complexity("new_content")).where("complexity is not null")


@query(f"with {_FC} select id, len(list_distinct(regexp_extract_all(new_content, '(\\w+)\\s*\\(', 1))) n_calls from fc where new_content is not null and path like '%.rs'")
def call_names(spark, root):
    n = F.when(F.col("new_content").isNotNull() & F.col("path").like("%.rs"), F.size(text.calls("new_content")))
    return contents_once(spark, root, n_calls=n).where("n_calls is not null")


@query(f"with {_FC}, x as (select id, unnest(regexp_extract_all(new_content, '(?m)^(?:import|from) ([\\w.]+)', 1)) m from fc where new_content is not null and path like '%.py') select m as module, count(distinct id) n_files from x group by 1")
def python_imports(spark, root):
    modules = F.when(F.col("path").like("%.py"), F.regexp_extract_all("new_content", F.lit(r"(?m)^(?:import|from) ([\w.]+)"), 1))
    x = contents_once(spark, root, modules=modules).select("id", F.explode("modules").alias("module"))
    return x.groupBy("module").agg(F.countDistinct("id").alias("n_files"))


@query(f"with {_FC}, l as (select id, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1) line_no from fc where new_content is not null) select id, line_no::bigint line_no, regexp_extract(line, 'TODO|FIXME|HACK') mark from l where regexp_matches(line, 'TODO|FIXME|HACK')")
def todo_lines(spark, root):
    pattern = "TODO|FIXME|HACK"
    marked = F.filter(F.transform(F.split("new_content", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), F.nullif(F.regexp_extract(x, f"({pattern})", 1), F.lit("")).alias("mark"))), lambda m: m["mark"].isNotNull())
    x = contents_once(spark, root, marks=F.when(F.col("new_content").rlike(pattern), marked))
    return x.select("id", F.explode("marks").alias("m")).select("id", "m.line_no", "m.mark")


@query("select doc_id, array_to_string(regexp_extract_all(text, '#(\\d+)', 1), ',') refs from documents where regexp_matches(text, '#\\d')")
def issue_references(spark, root):
    return _docs(spark, root).where(F.col("text").rlike(r"#\d")).select("doc_id", F.array_join(text.issue_references("text"), ",").alias("refs"))


@query(f"with {_CP}, n as (select distinct description d from cp where description <> '') select a.d as a, b.d as b, round(1 - levenshtein(a.d, b.d) / greatest(length(a.d), length(b.d)), 6) similarity from n a join n b on split_part(a.d, ' ', 1) = split_part(b.d, ' ', 1) and a.d < b.d where 1 - levenshtein(a.d, b.d) / greatest(length(a.d), length(b.d)) >= 0.8")
def similar_descriptions(spark, root):
    """Pairs of descriptions with the same first word and close spelling."""
    n = checkpoints_once(spark, root).select(F.col("description").alias("d")).where("d <> ''").withColumn("w", F.split("d", " ")[0])
    return spelling.close_names(n, "w", "d", 0.8)


@query("select doc_id, round(len(list_intersect(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')), ['the', 'and', 'is'])) / len(list_distinct(list_concat(list_filter(string_split(text, ' '), lambda x: x <> ''), ['the', 'and', 'is']))), 6) jaccard from documents where text is not null")
def jaccard_to_words(spark, root):
    mine = F.filter(F.split("text", " "), lambda x: x != "")
    return _docs(spark, root).where("text is not null").select("doc_id", F.round(text.jaccard(mine, F.array(F.lit("the"), F.lit("and"), F.lit("is"))), 6).alias("jaccard"))


@query(f"with {_FC}, x as (select id, string_split(original_content, chr(10)) a, string_split(new_content, chr(10)) b from fc where original_content is not null and new_content is not null) select id, round(len(list_filter(a, lambda v: list_contains(b, v))) / greatest(len(a), len(b)), 6) ratio from x")
def line_match_ratios(spark, root):
    both = F.col("original_content").isNotNull() & F.col("new_content").isNotNull()
    ratio = F.when(both, F.round(text.line_match_ratio(F.split("original_content", "\n"), F.split("new_content", "\n")), 6))
    return contents_once(spark, root, ratio=ratio).where("ratio is not null")


@query("select id, case when s >= 1099511627776 then printf('%.1f TB', floor(s / 1099511627776.0 * 10 + 0.5) / 10) when s >= 1073741824 then printf('%.1f GB', floor(s / 1073741824.0 * 10 + 0.5) / 10) when s >= 1048576 then printf('%.1f MB', floor(s / 1048576.0 * 10 + 0.5) / 10) when s >= 1024 then printf('%.1f KB', floor(s / 1024.0 * 10 + 0.5) / 10) else s || ' B' end as human from (select id, max(size_bytes) s from file_changes group by id) where s is not null")
def human_sizes(spark, root):
    return table(spark, root, "file_changes").groupBy("id").agg(F.max("size_bytes").alias("s")).where("s is not null").select("id", text.human_size("s").alias("human"))


@query(r"""select doc_id, case when length(text) > 40 then substr(text, 1, 37) || '...' else text end as short, case when trim(regexp_replace(source, '[<>:"/\\|?*]', '_', 'g'), ' ') = '' then 'unnamed' else trim(regexp_replace(source, '[<>:"/\\|?*]', '_', 'g'), ' ') end as file_name from documents where text is not null""")
def short_texts(spark, root):
    return _docs(spark, root).where("text is not null").select("doc_id", text.truncated("text", 40).alias("short"), text.safe_file_name("source").alias("file_name"))


@query(f"with {_FC} select distinct path, not regexp_matches(path, '(^|/)\\.\\.(/|$)') and not regexp_matches(path, '^/(etc|usr|bin|sbin|boot|dev|proc|sys|root|var|lib)(/|$)') as safe, regexp_matches(path, '^(?:.*/)?tests/.*$') as ignored, lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('rs', 'py', 'ts') and not regexp_matches(path, '^(?:.*/)?tests/.*$') as tracked from fc where path is not null")
def tracked_paths(spark, root):
    p = changes_once(spark, root).where("path is not null").select("path").distinct()
    return p.select("path", text.safe_path("path").alias("safe"), F.col("path").rlike(text.glob("**/tests/**")).alias("ignored"), text.tracked("path", ["rs", "py", "ts"], ["**/tests/**"]).alias("tracked"))


@query(f"with {_CP} select id, round(power(0.5, (epoch_us(timestamp '2025-12-31') - epoch_us(created_at)) / 3600000000.0 / 720.0), 9) freshness from cp where created_at is not null")
def recency_decay(spark, root):
    hours = (F.unix_micros(F.lit("2025-12-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    return checkpoints_once(spark, root).where("created_at is not null").select("id", F.round(text.decay(hours, 720.0), 9).alias("freshness"))


@query()
def canonical_code_groups(spark, root):
    """Groups of contents that agree once their own names are numbered by appearance."""
    words = ["if", "else", "for", "in", "return", "def", "class", "import", "from", "fn", "let", "const", "export", "function", "pub", "use", "async"]
    c = contents_once(spark, root, form=F.sha2(text.canonical_identifiers(words)("new_content"), 256), h=F.sha2("new_content", 256)).where("form is not null")
    return c.groupBy("form").agg(F.countDistinct("h").alias("n_contents"), F.count(F.lit(1)).alias("n_files")).where("n_contents > 1")


@query(f"""with {_FC}, p as (select checkpoint_id, string_split(min(path), '/') a, string_split(max(path), '/') b from fc where path is not null group by 1)
select checkpoint_id, array_to_string(a[1 : coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)))], '/') as prefix from p""")
def folder_prefixes(spark, root):
    return changes_once(spark, root).where("path is not null").groupBy("checkpoint_id").agg(F.min("path").alias("a"), F.max("path").alias("b")).select("checkpoint_id", text.common_prefix(F.array("a", "b")).alias("prefix"))


@query()
def pruned_documents(spark, root):
    return _docs(spark, root).where("text is not null").select("doc_id", F.sha2(text.keep_trailing_lines("text", 100), 256).alias("tail"), text.sentence_ends("text").alias("ends"), F.sha2(text.squeezed("text"), 256).alias("squeezed"))
