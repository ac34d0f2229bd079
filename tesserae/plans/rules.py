"""Queries by published rules: kinds of paths, messages and questions, scores of texts, marks in comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import classify, rules, text
from tesserae.operators import rollups, symbols
from tesserae.plans.code import _X, _symbols
from tesserae.plans.metrics import _CP, _FC, changes_once, checkpoints_once, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _texts(spark, root):
    return table(spark, root, "documents").where("text is not null").select("doc_id", "text")


def _paths(spark, root):
    return changes_once(spark, root).where("path is not null").select("path").distinct()


@query(f"""with {_FC}, p as (select distinct path, lower(path) l, regexp_extract(lower(path), '([^/]*)$', 1) n from fc where path is not null) select path,
regexp_matches(n, 'config|settings') or regexp_matches(n, '\\.(env|toml|ini|cfg)$') or n in ('package.json', 'tsconfig.json', 'cargo.toml', '.eslintrc', '.prettierrc') is_config,
regexp_matches(l, 'auth|crypto|security|password|secret|token|cert|key') or ends_with(l, '.pem') is_security,
n in ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml', 'jenkinsfile', 'makefile', 'build.js', 'build.rs', 'webpack.config.js', 'vite.config.ts', 'rollup.config.js') or ends_with(n, '.dockerfile') or contains(l, '.github/workflows') or contains(l, '.gitlab-ci') or contains(l, 'ci/') or contains(l, 'deploy/') is_infrastructure,
regexp_matches(l, 'api|routes|endpoints|controller|handler|protocol|schema|graphql') or regexp_matches(l, '\\.(proto|swagger|openapi)$') is_api,
contains(l, 'migration') or contains(l, 'schema') or contains(l, 'db/') or contains(l, 'database') or ends_with(n, '.sql') or contains(n, 'prisma') or contains(n, 'knex') is_database,
contains(path, 'test') or contains(path, 'spec') is_test from p""")
def path_kinds(spark, root):
    p = F.col("path")
    return _paths(spark, root).select("path", *[c.alias(n) for n, c in classify.path_kinds(p).items()], (p.contains("test") | p.contains("spec")).alias("is_test"))


@query(f"""with {_FC}, p as (select distinct path from fc where path is not null) select 'source' as file_group, count(*) n from p where regexp_matches(path, '\\.(ts|tsx|js|jsx|py|rs|go|java|cpp|c|h)$') union all
select 'test', count(*) from p where regexp_matches(path, '\\.(test|spec)\\.(ts|tsx|js|jsx)$') or contains(path, '/test/') union all
select 'config', count(*) from p where regexp_matches(path, '\\.(json|yaml|yml|toml|ini|conf|config)$') or regexp_matches(path, '(^|/)webpack\\.config\\.js$') union all
select 'documentation', count(*) from p where regexp_matches(path, '\\.(md|rst|txt)$') or contains(path, '/docs/') union all select 'assets', count(*) from p where regexp_matches(path, '\\.(png|jpg|jpeg|gif|svg|css|scss|sass|less)$')""")
def file_groups(spark, root):
    """Paths in each of five groups that may overlap, also empty ones."""
    n = _paths(spark, root).agg(*[F.coalesce(F.sum(F.col("path").rlike(p).cast("long")), F.lit(0)).alias(g) for g, p in classify.FILE_GROUPS.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(g).alias("file_group"), F.col(g).alias("n")) for g in classify.FILE_GROUPS])).alias("x")).select("x.*")


@query(f"""with {_FC}, l(layer, pattern) as (values ('Presentation', 'component|view|page|gui|\\.(css|scss|html|tsx|jsx)$'), ('Application', 'service|controller|handler|route|api'), ('Domain', 'model|entity|domain|type'), ('Database', 'db|database|migration|schema|sql'), ('Infrastructure', 'infra|storage|cache|queue'),
('Configuration', 'config|env|setting'), ('Security', 'auth|security|crypto'), ('Logging', 'log|monitor|metric'), ('Testing', 'test|spec|mock')), m as (select distinct checkpoint_id, layer from fc join l on regexp_matches(lower(path), pattern)), c as (select distinct checkpoint_id from fc where path is not null)
select c.checkpoint_id, coalesce(array_to_string(list_sort(list(m.layer) filter (m.layer is not null)), ','), 'Application') layers from c left join m on m.checkpoint_id is not distinct from c.checkpoint_id group by 1""")
def affected_layers(spark, root):
    """Layers that a checkpoint's paths touch, by rules that do not exclude each other."""
    each = changes_once(spark, root).where("path is not null").select("checkpoint_id", classify.all_matches(F.lower("path"), classify.AFFECTED_LAYERS).alias("l"))
    return each.groupBy("checkpoint_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("l")).select("checkpoint_id", F.when(F.size("l") == 0, "Application").otherwise(F.array_join("l", ",")).alias("layers"))


@query(f"""with {_FC}, f(feature, part) as (values ('authentication', 'auth'), ('authentication', 'login'), ('authentication', 'oauth'), ('authentication', 'session'), ('api', 'api'), ('api', 'routes'), ('api', 'endpoints'), ('api', 'handlers'), ('database', 'db'), ('database', 'database'), ('database', 'migrations'), ('database', 'models'), ('database', 'schema'),
('ui', 'ui'), ('ui', 'components'), ('ui', 'views'), ('ui', 'pages'), ('ui', 'gui'), ('testing', 'test'), ('testing', 'tests'), ('testing', 'spec'), ('testing', 'testing'), ('configuration', 'config'), ('configuration', 'settings'), ('configuration', 'env'), ('utilities', 'util'), ('utilities', 'utils'), ('utilities', 'helpers'), ('utilities', 'lib')),
p as (select checkpoint_id, unnest(string_split(lower(path), '/')) part from fc) select distinct checkpoint_id, feature from p join f using (part)""")
def affected_features(spark, root):
    """Features named by the parts of a checkpoint's paths."""
    named = F.create_map(*[F.lit(x) for f, parts in rules.FEATURE_OF_FOLDER.items() for p in parts for x in (p, f)])
    parts = changes_once(spark, root).select("checkpoint_id", F.explode(F.split(F.lower("path"), "/")).alias("part"))
    return parts.select("checkpoint_id", F.element_at(named, F.col("part")).alias("feature")).where("feature is not null").distinct()


@query(f"""with {_FC}, k as (select checkpoint_id, lower(change_type.kind) k, lower(path) p from fc), n as (select checkpoint_id, count(*) n, sum(case when k = 'created' then 1 else 0 end) c, sum(case when k = 'modified' then 1 else 0 end) m, sum(case when k = 'deleted' then 1 else 0 end) d, max(case when k = 'renamed' then 1 else 0 end) r, max(case when k = 'moved' then 1 else 0 end) v,
max(case when regexp_matches(p, '(^|/)(auth|login|oauth|session|api|routes|endpoints|handlers|db|database|migrations|models|schema|ui|components|views|pages|gui|test|tests|spec|testing|config|settings|env|util|utils|helpers|lib)(/|$)') then 1 else 0 end) f from k group by 1),
i as (select *, case when c > m and c > d then 'feature_addition' when d > 0 and m > d then 'refactoring' else 'maintenance' end intent, case when r = 1 then 'rename' when v = 1 then 'move' end refactoring_type from n)
select checkpoint_id, intent, refactoring_type, round(least(1.0, 0.5 + 0.1 * f + case when intent = 'maintenance' then 0 else 0.1 end + case when n <= 3 then 0.1 else 0 end + case when refactoring_type is not null then 0.05 else 0 end), 6)::double confidence, case when n > 10 then 3 when n > 5 then 2 when n > 1 then 1 else 0 end::integer size_points from i""")
def change_intents(spark, root):
    """Intent of a checkpoint by its counts, kind of refactoring, confidence, and points for the number of files."""
    named = "|".join(p for parts in rules.FEATURE_OF_FOLDER.values() for p in parts)
    k = rollups.kind()
    of = lambda x: F.sum(F.when(k == x, 1).otherwise(0))
    n = changes_once(spark, root).groupBy("checkpoint_id").agg(F.count(F.lit(1)).alias("n"), of("created").alias("c"), of("modified").alias("m"), of("deleted").alias("d"), of("renamed").alias("r"), of("moved").alias("v"), F.max(F.coalesce(F.lower("path").rlike(f"(^|/)({named})(/|$)").cast("int"), F.lit(0))).alias("f"))
    intent = F.when((F.col("c") > F.col("m")) & (F.col("c") > F.col("d")), "feature_addition").when((F.col("d") > 0) & (F.col("m") > F.col("d")), "refactoring").otherwise("maintenance")
    kind = F.when(F.col("r") > 0, "rename").when(F.col("v") > 0, "move")
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    confidence = F.least(F.lit(1.0), 0.5 + 0.1 * F.col("f") + plus(intent != "maintenance", 0.1) + plus(F.col("n") <= 3, 0.1) + plus(kind.isNotNull(), 0.05))
    points = F.when(F.col("n") > 10, 3).when(F.col("n") > 5, 2).when(F.col("n") > 1, 1).otherwise(0)
    return n.select("checkpoint_id", intent.alias("intent"), kind.alias("refactoring_type"), F.round(confidence, 6).alias("confidence"), points.alias("size_points"))


@query(f"""with {_X}, c as (select f.checkpoint_id, count(distinct f.path) n, count(distinct case when s.kind = 'interface' then s.name end) i, count(distinct case when s.kind in ('function', 'class', 'interface', 'constant') then s.name end) e from fc f left join sy s on s.id = f.id group by 1),
p as (select checkpoint_id, case when n > 10 then 3 when n > 5 then 2 when n > 1 then 1 else 0 end + case when i > 0 then 2 else 0 end + case when e > 5 then 1 else 0 end points from c) select checkpoint_id, points::integer points, case when points <= 1 then 'low' when points <= 3 then 'medium' when points <= 5 then 'high' else 'critical' end as significance from p""")
def change_significance(spark, root):
    """Points of a checkpoint for files, interfaces and names defined, and the level they make; cycles are not among them."""
    c = contents_once(spark, root, checkpoint_id=F.col("checkpoint_id"), path=F.col("path"), found=symbols.found("path", "new_content"))
    s = c.select("checkpoint_id", "path", F.explode_outer("found").alias("s"))
    n = s.groupBy("checkpoint_id").agg(F.countDistinct("path").alias("n"), F.countDistinct(F.when(F.col("s.kind") == "interface", F.col("s.name"))).alias("i"), F.countDistinct(F.when(F.col("s.kind").isin("function", "class", "interface", "constant"), F.col("s.name"))).alias("e"))
    points = F.when(F.col("n") > 10, 3).when(F.col("n") > 5, 2).when(F.col("n") > 1, 1).otherwise(0) + F.when(F.col("i") > 0, 2).otherwise(0) + F.when(F.col("e") > 5, 1).otherwise(0)
    return n.select("checkpoint_id", points.alias("points"), F.when(points <= 1, "low").when(points <= 3, "medium").when(points <= 5, "high").otherwise("critical").alias("significance"))


@query(f"""with {_X} select name as module, case when starts_with(name, '@') or regexp_matches(name, 'react|vue|angular|lodash|express|axios|typescript') then 'npm' when contains(name, 'java') or contains(name, 'org.') then 'maven' when contains(name, 'System.') or contains(name, 'Microsoft.') then 'nuget' else 'unknown' end as dependency_source, count(distinct path) n_files from sy where kind = 'import' group by 1, 2""")
def dependency_sources(spark, root):
    return _symbols(spark, root).where("kind = 'import'").groupBy(F.col("name").alias("module")).agg(F.countDistinct("path").alias("n_files")).select("module", rules.dependency_source(F.col("module")).alias("dependency_source"), "n_files")


@query("""with c(concept, relevance, pattern) as (values ('authentication', 0.95, 'auth|login|user|password|token|session'), ('authorization', 0.85, 'auth|login|user|password|token|session'), ('session_management', 0.80, 'auth|login|user|password|token|session'), ('data_persistence', 0.90, 'database|db|save|store|persist|repository'),
('api_communication', 0.90, 'api|endpoint|request|response|http|rest'), ('react', 0.90, 'react|component|hook|usestate|useeffect|jsx'), ('express', 0.90, 'express|middleware|router|app\\.get|app\\.post')) select doc_id, concept, relevance::double relevance from documents join c on regexp_matches(lower(text), pattern) where text is not null""")
def text_concepts(spark, root):
    """Concepts of a domain or a technology that a text's words name."""
    each = F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.struct(F.lit(c).alias("concept"), F.lit(r).alias("relevance"))) for c, r, p in rules.CONCEPTS]))
    return _texts(spark, root).select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.concept", "c.relevance")


@query(f"""with {_X}, w as (select distinct name as word from sy where kind in ('function', 'class')), v as (select word, case when ends_with(word, 's') then word[:-2] else word || 's' end as variant, 0.85 relevance from w
union all select word, word || e, 0.7 from w, (values ('er'), ('ed'), ('ing'), ('tion'), ('tor'), ('able')) x(e) where strlen(word) >= 4 union all select word, p || upper(word[1]) || word[2:], 0.75 from w, (values ('get'), ('set'), ('is'), ('has'), ('can'), ('should')) x(p)
union all select word, upper(word[1]) || word[2:] || r, 0.7 from w, (values ('Service'), ('Manager'), ('Handler'), ('Controller'), ('Repository')) x(r)) select word, variant, relevance::double relevance from v""")
def name_variants(spark, root):
    """Variants of every function's and class's name under which a search should find it."""
    w = _symbols(spark, root).where("kind in ('function', 'class')").select(F.col("name").alias("word")).distinct()
    return w.select("word", F.explode(rules.name_variants(F.col("word"))).alias("v")).select("word", F.col("v.name").alias("variant"), "v.relevance")


@query(f"""with {_FC}, p as (select distinct path from fc where path is not null) select path, (50 + case when ends_with(path, '.ts') or ends_with(path, '.js') then 20 else 0 end + case when ends_with(path, '.py') then 15 else 0 end + case when ends_with(path, '.rs') then 10 else 0 end + case when contains(path, '/src/') then 15 else 0 end
+ case when contains(path, '/lib/') then 10 else 0 end + case when contains(path, '/core/') then 10 else 0 end - case when contains(path, '/test/') or contains(path, 'spec.') then 10 else 0 end)::integer priority from p""")
def warming_priorities(spark, root):
    return _paths(spark, root).select("path", rules.warming_priority(F.col("path")).alias("priority"))


@query(r"""with d as (select doc_id, text, string_split_regex(lower(text), '[\t\n\f\r ]+') w from documents where text is not null), s as (select *, len(list_filter(w, lambda x: x in ('good', 'great', 'excellent', 'perfect', 'awesome'))) p, len(list_filter(w, lambda x: x in ('bad', 'terrible', 'awful', 'broken', 'error', 'problem'))) n,
len(list_filter(w, lambda x: x = 'help')) - len(list_filter(w, lambda x: x in ('issue', 'fail'))) extra from d) select doc_id, case when p > n then 'positive' when n > p then 'negative' else 'neutral' end as mood, round(greatest(-1.0, least(1.0, (p - n + extra) / len(w))), 6) score,
array_to_string(list_filter(w, lambda x: length(x) > 2 and x not in ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'))[1:10], ' ') keywords from s""")
def text_moods(spark, root):
    """Mood of a text by two word lists, its score, and the first ten words that mean something."""
    t = F.col("text")
    return _texts(spark, root).select("doc_id", rules.mood(t).alias("mood"), F.round(rules.mood_score(t), 6).alias("score"), F.array_join(rules.keywords(t), " ").alias("keywords"))


@query(r"""select doc_id, round((least(1.0, length(text) / 100) + least(1.0, len(regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*\(|\.|->')) / 10) + least(1.0, len(regexp_extract_all(text, '\([^)]*\)|\{[^}]*\}|\[[^\]]*\]')) / 5)) / 3, 6) complexity,
round((least(1.0, len(regexp_extract_all(text, '\b[a-z][A-Z][a-zA-Z0-9]*|[a-zA-Z_][a-zA-Z0-9_]*\(')) / 5) + least(1.0, len(regexp_extract_all(text, '/[a-zA-Z0-9_\-/]*|[a-zA-Z0-9_\-]*\.[a-zA-Z0-9]+')) / 3) + least(1.0, len(regexp_extract_all(text, '\b\d+(?:\.\d+)*\b')) / 3)) / 3, 6) specificity,
len(regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+|\w+\(\)'))::integer n_terms from documents where text is not null""")
def text_scores(spark, root):
    """Complexity and specificity of a text as means of three shares, and its technical terms."""
    t = F.col("text")
    return _texts(spark, root).select("doc_id", F.round(rules.complexity(t), 6).alias("complexity"), F.round(rules.specificity(t), 6).alias("specificity"), F.regexp_count(rules.ascii(t), F.lit(r"\b[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)+|\w+\(\)")).alias("n_terms"))


def _count_sql(words: str) -> str:
    return " + ".join(f"contains(l, '{w}')::int" for w in words.split())


@query(rf"""with d as (select doc_id, text, lower(text) l, case when regexp_matches(text, '[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*\(|\.[a-zA-Z]') then 0.2 else 0.0 end named from documents where text is not null),
s as (select doc_id, round(least(1.0, 0.1 + ({_count_sql('implement create build make write add')}) * 0.3 + ({_count_sql('create build make implement fix solve refactor optimize')}) * 0.2 + named), 6) a, round(least(1.0, 0.1 + ({_count_sql('error bug fix issue problem debug')}) * 0.4 + named), 6) b,
round(least(1.0, 0.1 + ({_count_sql('what how explain understand describe')}) * 0.3 + ({_count_sql('what how why where when which who')}) * 0.2 + case when contains(text, '?') then 0.3 else 0 end), 6) c, round(least(1.0, 0.1 + ({_count_sql('refactor improve optimize clean')}) * 0.4 + named), 6) d, round(least(1.0, 0.1 + ({_count_sql('architecture design pattern structure')}) * 0.5), 6) e from d)
select doc_id, case when a = greatest(a, b, c, d, e) then 'implementation' when b = greatest(a, b, c, d, e) then 'debugging' when c = greatest(a, b, c, d, e) then 'explanation' when d = greatest(a, b, c, d, e) then 'refactoring' else 'architecture' end as question_type, greatest(a, b, c, d, e)::double score from s""")
def modelled_questions(spark, root):
    """Kind of question by counts of words, the greatest score first."""
    s = _texts(spark, root).select("doc_id", *[c.alias(n) for n, c in rules.model_scores(F.col("text")).items()])
    names = ["implementation", "debugging", "explanation", "refactoring", "architecture"]
    return s.select("doc_id", rules.first_greatest({n: F.col(n) for n in names}).alias("question_type"), F.greatest(*names).alias("score"))


@query("""with d as (select doc_id, lower(text) l from documents where text is not null), s as (select doc_id,
regexp_matches(l, 'how to|implement|create|build|add|write|make|develop')::int + regexp_matches(l, 'function|method|class|component')::int + regexp_matches(l, 'code|solution|example')::int a, regexp_matches(l, 'error|bug|fix|issue|problem|not working|debug|broken')::int + regexp_matches(l, 'why.*not|what.*wrong|doesn''t work')::int + regexp_matches(l, 'exception|crash|fail')::int b,
regexp_matches(l, 'refactor|improve|optimize|clean up|restructure|reorganize')::int + regexp_matches(l, 'better way|best practice|code smell')::int + regexp_matches(l, 'performance|efficiency')::int c, regexp_matches(l, 'what is|explain|how does|understand|clarify|describe')::int + regexp_matches(l, 'what.*do|how.*work|why.*use')::int + regexp_matches(l, 'meaning|purpose|concept')::int d,
regexp_matches(l, 'architecture|design|pattern|structure|organize|system')::int + regexp_matches(l, 'module|component|service|layer')::int + regexp_matches(l, 'dependency|relationship|interaction')::int e, regexp_matches(l, 'test|testing|unit test|integration test|e2e')::int + regexp_matches(l, 'mock|stub|assertion|coverage')::int + regexp_matches(l, 'spec|specification')::int f,
regexp_matches(l, 'document|documentation|comment|jsdoc|readme')::int + regexp_matches(l, 'api.*doc|guide|tutorial')::int + regexp_matches(l, 'example.*usage')::int g, regexp_matches(l, 'performance|speed|slow|fast|optimize|efficiency')::int + regexp_matches(l, 'memory|cpu|benchmark|profile')::int + regexp_matches(l, 'bottleneck|latency')::int h,
regexp_matches(l, 'security|secure|vulnerability|auth|permission')::int + regexp_matches(l, 'encrypt|hash|sanitize|validate')::int + regexp_matches(l, 'xss|csrf|injection')::int i from d), m as (select *, greatest(a, b, c, d, e, f, g, h, i) z from s)
select doc_id, case z when a then 'implementation' when b then 'debugging' when c then 'refactoring' when d then 'explanation' when e then 'architecture' when f then 'testing' when g then 'documentation' when h then 'performance' else 'security' end as question_type, z score from m""")
def weighted_questions(spark, root):
    """Kind of question with the most of its three families of words; of equal ones the first."""
    t = F.lower("text")
    scores = {n: sum((t.rlike(p).cast("int") for p in ps), F.lit(0)) for n, ps in rules.WEIGHTED_QUESTIONS.items()}
    s = _texts(spark, root).select("doc_id", *[c.alias(n) for n, c in scores.items()])
    return s.select("doc_id", rules.first_greatest({n: F.col(n) for n in scores}).alias("question_type"), F.greatest(*scores).alias("score"))


_ENTITIES = [("function", 0.8, r"\b([a-z][a-zA-Z0-9_]*)[\t\n\f\r ]*\("), ("class", 0.7, r"\b([A-Z][a-zA-Z0-9]*)\b"), ("interface", 0.6, r"\b(I[A-Z][a-zA-Z0-9]*|[A-Z][a-zA-Z0-9]*Interface)\b"), ("variable", 0.9, r"(?:variable|var|let|const)[\t\n\f\r ]+([a-zA-Z_][a-zA-Z0-9_]*)"), ("module", 0.8, r"\b([a-zA-Z][a-zA-Z0-9]*\.(?:[jt]sx?|py|rs))\b")]


@query(r"""with d as (select doc_id, text from documents where text is not null), e as (select doc_id, 'function' kind, 0.8 confidence, unnest(regexp_extract_all(text, '\b([a-z][a-zA-Z0-9_]*)[\t\n\f\r ]*\(', 1)) "name" from d union all select doc_id, 'class', 0.7, unnest(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9]*)\b', 1)) from d
union all select doc_id, 'interface', 0.6, unnest(regexp_extract_all(text, '\b(I[A-Z][a-zA-Z0-9]*|[A-Z][a-zA-Z0-9]*Interface)\b', 1)) from d union all select doc_id, 'variable', 0.9, unnest(regexp_extract_all(text, '(?:variable|var|let|const)[\t\n\f\r ]+([a-zA-Z_][a-zA-Z0-9_]*)', 1)) from d
union all select doc_id, 'module', 0.8, unnest(regexp_extract_all(text, '\b([a-zA-Z][a-zA-Z0-9]*\.(?:[jt]sx?|py|rs))\b', 1)) from d) select doc_id, kind, "name", confidence::double confidence, count(*) n from e group by all""")
def text_entities(spark, root):
    """Functions, classes, interfaces, variables and modules that a text names, how often, and how sure each pattern is."""
    plain = rules.ascii(F.col("text"))
    named = lambda k, c: lambda x: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), x.alias("name"))
    each = F.concat(*[F.transform(F.regexp_extract_all(plain, F.lit(p), 1), named(k, c)) for k, c, p in _ENTITIES])
    return _texts(spark, root).select("doc_id", F.explode(each).alias("e")).groupBy("doc_id", "e.kind", "e.name", "e.confidence").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_FC}, l as (select id, path, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1) line_no from fc where new_content is not null and (contains(path, 'test') or contains(path, 'spec')))
select id, line_no::bigint line_no, sha256(line) h from l where contains(line, 'test(') or contains(line, 'it(') or contains(line, 'def test_')""")
def test_cases(spark, root):
    """Lines of test files that open a test case."""
    is_test = F.col("path").contains("test") | F.col("path").contains("spec")
    hit = lambda x: x.contains("test(") | x.contains("it(") | x.contains("def test_")
    lines = F.filter(F.transform(F.split("new_content", "\n"), lambda x, i: F.when(hit(x), F.struct((i + 1).cast("long").alias("line_no"), F.sha2(x, 256).alias("h")))), lambda m: m.isNotNull())
    return contents_once(spark, root, found=F.when(is_test, lines)).select("id", F.explode("found").alias("m")).select("id", "m.line_no", "m.h")


test_cases.__test__ = False
_MARKS = [("todo", r"(?i)(?://|/\*)[\t ]*TODO:?[\t ]*(.+)"), ("fixme", r"(?i)(?://|/\*)[\t ]*FIXME:?[\t ]*(.+)"), ("rationale", r"(?i)//[\t ]*(?:Using|Chose|Preferred|Pattern:|Design:)[\t ]*(.+)"), ("issue", r"(?i)//[\t ]*(?:Known issue|Issue|Bug):[\t ]*(.+)"), ("deprecated", r"(?i)(?:@deprecated|//[\t ]*DEPRECATED:?)[\t ]*(.+)"), ("hint", r"(?i)//[\t ]*(?:Note|Hint|Important|Warning):[\t ]*(.+)")]


@query(f"""with {_FC}, l as (select id, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1) line_no from fc where new_content is not null), p(mark, pattern) as (values ('todo', '(?i)(?://|/\\*)[\\t ]*TODO:?[\\t ]*(.+)'), ('fixme', '(?i)(?://|/\\*)[\\t ]*FIXME:?[\\t ]*(.+)'), ('rationale', '(?i)//[\\t ]*(?:Using|Chose|Preferred|Pattern:|Design:)[\\t ]*(.+)'),
('issue', '(?i)//[\\t ]*(?:Known issue|Issue|Bug):[\\t ]*(.+)'), ('deprecated', '(?i)(?:@deprecated|//[\\t ]*DEPRECATED:?)[\\t ]*(.+)'), ('hint', '(?i)//[\\t ]*(?:Note|Hint|Important|Warning):[\\t ]*(.+)')), h as (select id, line_no::bigint line_no, mark, case mark
when 'todo' then regexp_extract(line, '(?i)(?://|/\\*)[\\t ]*TODO:?[\\t ]*(.+)', 1) when 'fixme' then regexp_extract(line, '(?i)(?://|/\\*)[\\t ]*FIXME:?[\\t ]*(.+)', 1) end t from l join p on regexp_matches(line, pattern))
select id, line_no, mark, case when mark = 'todo' then case when regexp_matches(t, '(?i)urgent|asap|critical|important') then 'high' when regexp_matches(t, '(?i)soon|needed|required') then 'medium' else 'low' end when mark = 'fixme' then case when regexp_matches(t, '(?i)critical|severe|urgent|security|vulnerability') then 'critical' when regexp_matches(t, '(?i)major|important|bug|error') then 'major' else 'minor' end end as weight from h""")
def comment_marks(spark, root):
    """Marks in comment lines: things to do and to fix with their weight, reasons, known issues, deprecations and hints."""

    def marks(x, i):
        t = F.regexp_extract(x, _MARKS[0][1], 1)
        f = F.regexp_extract(x, _MARKS[1][1], 1)
        weight = {"todo": F.when(t.rlike("(?i)urgent|asap|critical|important"), "high").when(t.rlike("(?i)soon|needed|required"), "medium").otherwise("low"), "fixme": F.when(f.rlike("(?i)critical|severe|urgent|security|vulnerability"), "critical").when(f.rlike("(?i)major|important|bug|error"), "major").otherwise("minor")}
        return F.array_compact(F.array(*[F.when(x.rlike(p), F.struct((i + 1).cast("long").alias("line_no"), F.lit(n).alias("mark"), weight.get(n, F.lit(None).cast("string")).alias("weight"))) for n, p in _MARKS]))

    found = F.when(F.col("new_content").rlike(r"(?i)TODO|FIXME|//|@deprecated"), F.flatten(F.transform(F.split("new_content", "\n"), marks)))
    return contents_once(spark, root, found=found).select("id", F.explode("found").alias("m")).select("id", "m.line_no", "m.mark", "m.weight")


@query(f"""with {_FC}, d as (select id, case when regexp_matches(path, '\\.(ts|tsx|js|jsx)$') then regexp_extract_all(new_content, '(?s)/\\*\\*(.*?)\\*/', 1) when ends_with(path, '.py') then regexp_extract_all(new_content, '(?s)\"\"\"(.*?)\"\"\"', 1) when ends_with(path, '.rs') then regexp_extract_all(new_content, '///([^\\n]*)', 1) end x from fc where new_content is not null)
select id, len(x)::integer n_comments, coalesce(list_sum(list_transform(x, lambda v: length(trim(v, chr(32) || chr(9) || chr(10) || chr(13))))), 0)::bigint n_chars from d where len(x) > 0""")
def doc_comments(spark, root):
    """Documentation comments of each file by its language's form: how many, and their letters."""
    t, p = F.col("new_content"), F.col("path")
    found = F.when(p.rlike(r"\.(ts|tsx|js|jsx)$"), F.regexp_extract_all(t, F.lit(r"(?s)/\*\*(.*?)\*/"), 1)).when(p.endswith(".py"), F.regexp_extract_all(t, F.lit(r'(?s)"""(.*?)"""'), 1)).when(p.endswith(".rs"), F.regexp_extract_all(t, F.lit(r"///([^\n]*)"), 1))
    chars = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")))
    return contents_once(spark, root, n_comments=F.size(found), n_chars=chars).where("n_comments > 0")


@query(f"""with {_FC} select arg_max(path, (modified_at, id)) path, count(distinct path) n_paths from fc where regexp_matches(lower(path), '(^|/)readme') and new_content is not null""")
def readme_files(spark, root):
    """The last changed file that introduces a project, and how many there are."""
    c = contents_once(spark, root, path=F.col("path"), at=F.col("modified_at"), has=F.col("new_content").isNotNull()).where(F.col("has") & F.lower("path").rlike("(^|/)readme"))
    return c.agg(F.max_by("path", F.struct("at", "id")).alias("path"), F.countDistinct("path").alias("n_paths"))


@query(f"""with {_CP}, a as (select id, epoch_us(timestamp '2025-12-31') - epoch_us(created_at) u from cp where created_at is not null) select id, case when u // 86400000000 > 0 then (u // 86400000000) || ' days ago' when u // 3600000000 > 0 then (u // 3600000000) || ' hours ago' when u // 60000000 > 0 then (u // 60000000) || ' minutes ago' else 'Just now' end as age from a""")
def age_strings(spark, root):
    u = F.unix_micros(F.lit("2025-12-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    whole = lambda n: F.expr(f"u div {n}")
    c = checkpoints_once(spark, root).where("created_at is not null").select("id", u.alias("u"))
    age = F.lit("Just now")
    for n, unit in ((60_000_000, "minutes"), (3_600_000_000, "hours"), (86_400_000_000, "days")):
        age = F.when(whole(n) > 0, F.concat(whole(n).cast("string"), F.lit(f" {unit} ago"))).otherwise(age)
    return c.select("id", age.alias("age"))


@query(f"""with {_CP}, {_FC}, f as (select checkpoint_id, sum(case lower(change_type.kind) when 'created' then 0.5 when 'modified' then 1.0 when 'deleted' then 0.8 when 'moved' then 1.2 else 0 end) w, count(distinct nullif(lower(regexp_extract(path, '\\.([^./]+)$', 1)), '')) e from fc group by 1)
select cp.id, round(coalesce(files_affected, 0) * 0.1 + coalesce(w, 0) + least(coalesce(size_bytes, 0) / 1000.0, 10.0) + coalesce(e, 0) * 0.2, 6)::double complexity from cp left join f on f.checkpoint_id = cp.id""")
def change_complexities(spark, root):
    """Weight of a checkpoint: files, kinds of changes, size and different extensions."""
    k = rollups.kind()
    w = F.when(k == "created", 0.5).when(k == "modified", 1.0).when(k == "deleted", 0.8).when(k == "moved", 1.2).otherwise(0.0)
    f = changes_once(spark, root).groupBy("checkpoint_id").agg(F.sum(w).alias("w"), F.countDistinct(F.nullif(text.extension("path"), F.lit(""))).alias("e"))
    c = checkpoints_once(spark, root).join(f, F.col("id") == F.col("checkpoint_id"), "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    return c.select("id", F.round(zero("files_affected") * 0.1 + zero("w") + F.least(zero("size_bytes") / 1000, F.lit(10.0)) + zero("e") * 0.2, 6).alias("complexity"))


@query(f"""with {_FC}, x as (select id, path, string_split(regexp_replace(new_content, '\\r\\n?', chr(10), 'g'), chr(10)) l, len(regexp_extract_all(new_content, '\\w+')) t from fc where new_content is not null)
select id, case when starts_with(path, 'src/') then path[5:] end as inside_src, len(l) >= 6 and t >= 50 as is_fragment, regexp_replace(trim(coalesce(path, '')), '[ ]+', '_', 'g') as symbol_name, floor(0.6 * greatest(0, 100 - 10 * greatest(0, t / 100.0 - 5)) + 0.4 * least(100, len(l)) + 0.5)::bigint quality from x""")
def fragment_checks(spark, root):
    """Path inside a folder, whether a text is long enough to compare, its path as a symbol, and a score of size and length rounded half up."""
    t = F.col("new_content")
    n, w = F.size(F.split(text.unix_lines("new_content"), "\n")), F.regexp_count(t, F.lit(r"\w+"))
    quality = F.floor(0.6 * F.greatest(F.lit(0), 100 - 10 * F.greatest(F.lit(0), w / 100 - 5)) + 0.4 * F.least(F.lit(100), n) + 0.5)
    inside = F.when(F.col("path").startswith("src/"), F.substring(F.col("path"), F.lit(5), F.length("path")))
    return contents_once(spark, root, has=t.isNotNull(), inside_src=inside, is_fragment=(n >= 6) & (w >= 50), symbol_name=F.regexp_replace(F.trim(F.coalesce("path", F.lit(""))), "[ ]+", "_"), quality=quality).where("has").drop("has")


@query(r"""select doc_id, case when length(text) < 1000 then 'low' when length(text) < 5000 then 'medium' else 'high' end as detail, case when length(text) < 1000 then 0.2 when length(text) < 5000 then 0.5 else 0.8 end::double detail_code, sha256(regexp_replace(lower(trim(text)), '[\t\n\f\r ]+', ' ', 'g')) cache_key from documents where text is not null""")
def detail_levels(spark, root):
    """Level of detail by length, its code, and the key under which a normalised text is kept."""
    n = F.length("text")
    key = F.sha2(F.regexp_replace(F.lower(F.trim("text")), r"[\t\n\f\r ]+", " "), 256)
    return _texts(spark, root).select("doc_id", F.when(n < 1000, "low").when(n < 5000, "medium").otherwise("high").alias("detail"), F.when(n < 1000, 0.2).when(n < 5000, 0.5).otherwise(0.8).alias("detail_code"), key.alias("cache_key"))


_ASSIGN = r"(?m)^[ \t]*(?:export )?(?:const |let |var )?(\w+(?:: \w+)?) = ([^\n]*?);?[ \t\r]*$"


@query(f"""with {_FC}, a as (select id, unnest(regexp_extract_all(new_content, '(?m)^[ \\t]*(?:export )?(?:const |let |var )?(\\w+(?:: \\w+)?) = ([^\\n]*?);?[ \\t\\r]*$', 1)) v, unnest(regexp_extract_all(new_content, '(?m)^[ \\t]*(?:export )?(?:const |let |var )?(\\w+(?:: \\w+)?) = ([^\\n]*?);?[ \\t\\r]*$', 2)) e from fc where new_content is not null and regexp_matches(path, '\\.(py|js|ts)$')),
k as (select distinct id, v, case when starts_with(e, '"') or starts_with(e, '''') then 'string' when regexp_matches(e, '^[+-]?[0-9]{{1,18}}$') then 'number' when e in ('true', 'false') then 'boolean' when e = 'null' then 'null' when e = 'undefined' then 'undefined' when starts_with(e, '[') and ends_with(e, ']') then 'array' when starts_with(e, '{{') and ends_with(e, '}}') then 'object' when contains(e, '=>') or starts_with(e, 'function') then 'function' else 'unknown' end t from a),
u as (select id, v, coalesce(array_to_string(list_sort(list(t) filter (t <> 'unknown')), ' | '), 'unknown') x from k group by 1, 2) select id, v as variable, case when x = '' then 'unknown' else x end as unified_type, x = 'string' or x in ('', 'unknown') or contains(x, ' | ') fits_string from u""")
def variable_types(spark, root):
    """Type of each variable from the literals assigned to it, unified, and whether it may stand for a string."""
    pair = lambda i: F.regexp_extract_all("new_content", F.lit(_ASSIGN), i)
    each = F.transform(F.arrays_zip(pair(1).alias("v"), pair(2).alias("e")), lambda p: F.struct(p["v"].alias("v"), rules.literal_type(p["e"]).alias("t")))
    a = contents_once(spark, root, a=F.when(F.col("path").rlike(r"\.(py|js|ts)$"), F.array_distinct(each))).select("id", F.explode("a").alias("a"))
    u = a.groupBy("id", F.col("a.v").alias("variable")).agg(rules.unified(F.collect_set("a.t")).alias("unified_type"))
    return u.select("id", "variable", "unified_type", rules.compatible(F.col("unified_type"), F.lit("string")).alias("fits_string"))
