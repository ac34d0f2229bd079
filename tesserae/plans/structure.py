"""Queries on the structure of source texts: definitions, smells, calls, imports, statements and their flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import graph, structure
from tesserae.plans.code import _X, _symbols
from tesserae.plans.metrics import _CP, _FC, checkpoints_once, contents_once
from tesserae.plans.registry import Registry
from tesserae.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _definitions(spark, root):
    is_source = F.col("path").rlike(r"\.(py|js|ts|rs)$")
    found = contents_once(spark, root, lambda df: structure.with_definitions(df, "new_content"), path=F.when(is_source, F.col("path")), definitions=F.when(is_source, F.col("definitions")))
    return found.select("id", "path", F.explode("definitions").alias("d")).select("id", "path", "d.*")


_FN = r"^[ \t]*(?:export |default |pub |async |static )*(?:def|function|fn) (\w+)(?:<[^>\n]*>)?\(([^)\n]*)"
_CL = r"^[ \t]*(?:export |default |pub |abstract )*(class|struct|interface|trait|impl) (\w+)"
_D = rf"""{_FC}, l as (select id, path, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1)::bigint line_no, len(string_split(new_content, chr(10))) total from fc where new_content is not null and regexp_matches(path, '\.(py|js|ts|rs)$')),
o as (select id, path, line_no, total, length(regexp_extract(line, '^([ \t]*)', 1)) indent, case when regexp_matches(line, '{_FN}') then regexp_extract(line, '{_FN}', 1) else regexp_extract(line, '{_CL}', 2) end "name", case when regexp_matches(line, '{_FN}') then 'function' when regexp_extract(line, '{_CL}', 1) in ('interface', 'trait') then 'interface' else 'class' end kind,
len(list_filter(string_split(regexp_extract(line, '{_FN}', 2), ','), lambda p: trim(p) not in ('', 'self', '&self', '&mut self')))::bigint n_params, regexp_matches(line, '^[ \t]*(?:export|pub) ') or regexp_matches(line, '^[ \t]*(?:async )?(?:def|class) [^_]') is_public from l where regexp_matches(line, '{_FN}') or regexp_matches(line, '{_CL}')),
e as (select o.*, coalesce((select min(n.line_no) - 1 from o n where n.id = o.id and n.line_no > o.line_no and n.indent <= o.indent), total)::bigint end_line from o),
d as (select e.*, (select arg_max(c."name", c.line_no) from e c where c.id = e.id and c.kind <> 'function' and c.line_no < e.line_no and c.end_line >= e.line_no) parent from e)"""
_K = rf"""{_D}, k as (select distinct d.id, d.path, d.kind, d."name", d.line_no, c.callee from d join l on l.id = d.id and l.line_no > d.line_no and l.line_no <= d.end_line, unnest(regexp_extract_all(l.line, '(\w+)\(', 1)) c(callee) where c.callee not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'match', 'and', 'or', 'not', 'in', 'def', 'fn', 'function', 'elif', 'assert', 'print')),
g as (select distinct d.id, d.line_no, f.field from d join l on l.id = d.id and l.line_no > d.line_no and l.line_no <= d.end_line, unnest(list_concat(regexp_extract_all(l.line, '(?:self|this)\.(\w+) = ', 1), regexp_extract_all(l.line, '^[ \t]+pub (\w+): ', 1))) f(field))"""


@query(f"""with {_D} select id, kind, "name", line_no, end_line, n_params, is_public, parent from d""")
def code_definitions(spark, root):
    return _definitions(spark, root).select("id", "kind", "name", "line_no", "end_line", "n_params", "is_public", "parent")


def _classes(d):
    """``id, name, line_no, n_lines, kind, methods, n_fields, n_calls`` of each class and interface."""
    methods = d.where("kind = 'function' and parent is not null").groupBy("id", F.col("parent").alias("name")).agg(F.collect_set("name").alias("methods"))
    c = d.where("kind <> 'function'").select("id", "name", "kind", "line_no", (F.col("end_line") - F.col("line_no") + 1).alias("n_lines"), F.size("fields").alias("n_fields"), F.size("calls").alias("n_calls"))
    return c.join(methods, ["id", "name"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


_C = f"""{_K}, m as (select id, parent "name", list(distinct "name") methods from d where kind = 'function' and parent is not null group by 1, 2),
c as (select d.id, d."name", d.kind, d.line_no, d.end_line - d.line_no + 1 n_lines, coalesce(m.methods, []) methods, (select count(*) from g where g.id = d.id and g.line_no = d.line_no) n_fields, (select count(*) from k where k.id = d.id and k.line_no = d.line_no) n_calls from d left join m on m.id = d.id and m."name" = d."name" where d.kind <> 'function')"""


@query(f"""with {_C} select id, "name", line_no, n_lines, len(methods)::integer n_methods, n_fields::integer n_fields, n_calls::integer n_calls from c""")
def class_profiles(spark, root):
    return _classes(_definitions(spark, root)).select("id", "name", "line_no", "n_lines", F.size("methods").alias("n_methods"), "n_fields", "n_calls")


@query(f"""with {_C}, n as (select *, len(methods) nm, lower("name") low, len(list_filter(methods, lambda x: starts_with(x, 'create'))) creates, len(list_filter(methods, lambda x: regexp_matches(x, '^(get|set|is|has)'))) accessors, len(list_filter(methods, lambda x: regexp_matches(x, 'subscribe|addEventListener|on|addListener'))) listens, len(list_filter(methods, lambda x: regexp_matches(x, 'emit|notify|publish|dispatch'))) emits,
len(list_filter(methods, lambda x: x in ('getInstance', 'get_instance', 'instance'))) gets from c), h as (
select 'long_method' as smell, id, "name", line_no, least(1.0, (end_line - line_no + 1) / 100) confidence from d where kind = 'function' and end_line - line_no + 1 > 50 union all select 'long_parameter_list', id, "name", line_no, 0.9 from d where kind = 'function' and n_params > 5
union all select 'large_class', id, "name", line_no, least(1.0, n_lines / 500) from n where n_lines > 300 union all select 'god_object', id, "name", line_no, (least(1.0, nm / 20) + least(1.0, n_fields / 15) + least(1.0, n_calls / 10)) / 3 from n where nm > 20 or n_fields > 15 or n_calls > 10
union all select 'data_class', id, "name", line_no, 0.8 from n where n_fields >= 3 and nm <= n_fields and accessors >= greatest(0, nm - 1) union all select 'factory', id, "name", line_no, 0.8 from n where regexp_matches(low, 'factory|creator') or creates >= 2
union all select 'observer', id, "name", line_no, case when regexp_matches(low, 'emitter|publisher|eventbus|dispatcher') then 0.4 else 0 end + case when listens > 0 then 0.3 else 0 end + case when emits > 0 then 0.3 else 0 end from n union all select 'singleton', id, "name", line_no, case when gets > 0 then 0.3 else 0 end + case when (select count(*) from g where g.id = n.id and g.line_no = n.line_no and regexp_matches(g.field, 'instance')) > 0 then 0.4 else 0 end from n)
select smell, id, "name", line_no, round(confidence, 6)::double confidence from h where confidence >= 0.7""")
def code_smells(spark, root):
    """Long methods and parameter lists, large and data classes, god objects, factories, observers and singletons, as sure as their rules are, from 0.7 on."""
    d = _definitions(spark, root).withColumn("n_lines", F.col("end_line") - F.col("line_no") + 1)
    low, nm = F.lower("name"), F.size("methods")
    count = lambda pattern: F.size(F.filter("methods", lambda m: m.rlike(pattern)))
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    share = lambda x, most: F.least(F.lit(1.0), x / most)
    of_function = [("long_method", F.when(F.col("n_lines") > 50, share(F.col("n_lines"), 100))), ("long_parameter_list", F.when(F.col("n_params") > 5, F.lit(0.9)))]
    of_class = [
        ("large_class", F.when(F.col("n_lines") > 300, share(F.col("n_lines"), 500))),
        ("god_object", F.when((nm > 20) | (F.col("n_fields") > 15) | (F.col("n_calls") > 10), (share(nm, 20) + share(F.col("n_fields"), 15) + share(F.col("n_calls"), 10)) / 3)),
        ("data_class", F.when((F.col("n_fields") >= 3) & (nm <= F.col("n_fields")) & (count("^(get|set|is|has)") >= F.greatest(F.lit(0), nm - 1)), F.lit(0.8))),
        ("factory", F.when(low.rlike("factory|creator") | (count("^create") >= 2), F.lit(0.8))),
        ("observer", plus(low.rlike("emitter|publisher|eventbus|dispatcher"), 0.4) + plus(count("subscribe|addEventListener|on|addListener") > 0, 0.3) + plus(count("emit|notify|publish|dispatch") > 0, 0.3)),
        ("singleton", plus(count("^(getInstance|get_instance|instance)$") > 0, 0.3) + plus(F.exists("field_names", lambda f: f.contains("instance")), 0.4)),
    ]
    hits = lambda rules: F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("smell"), F.round(c, 6).alias("confidence")) for n, c in rules]), lambda h: h["confidence"] >= 0.7)).alias("h")
    names = d.where("kind <> 'function'").select("id", "name", "line_no", F.col("fields").alias("field_names"))
    classes = _classes(d).join(names, ["id", "name", "line_no"])
    both = d.where("kind = 'function'").select("id", "name", "line_no", hits(of_function)).unionByName(classes.select("id", "name", "line_no", hits(of_class)))
    return both.select("h.smell", "id", "name", "line_no", "h.confidence")


@query(f"""with {_K} select id, "name" as caller, line_no, callee, callee in (select "name" from d where kind = 'function') is_known from k where kind = 'function'""")
def call_edges(spark, root):
    """Each function and the different names it calls, and whether any file defines the name."""
    d = _definitions(spark, root).where("kind = 'function'")
    known = d.select(F.col("name").alias("callee"), F.lit(True).alias("is_known")).distinct()
    return d.select("id", F.col("name").alias("caller"), "line_no", F.explode("calls").alias("callee")).join(known, "callee", "left").select("id", "caller", "line_no", "callee", F.coalesce("is_known", F.lit(False)).alias("is_known"))


@query(f"""with {_K}, f as (select distinct path, "name" from d where kind = 'function'), x as (select k.path, k."name", k.callee, f.path target from k join f on f."name" = k.callee where k.kind = 'function'), t as (select path, "name", target, count(distinct callee) n from x where target <> path group by 1, 2, 3),
own as (select path, "name", count(distinct callee) n from x where target = path group by 1, 2) select t.path, t."name", t.target, t.n::bigint n_foreign, coalesce(own.n, 0)::bigint n_own from t left join own using (path, "name") where t.n >= 3 and t.n > coalesce(own.n, 0)""")
def feature_envy(spark, root):
    """Functions that call at least three names of one other file, and more of them than of their own."""
    d = _definitions(spark, root).where("kind = 'function'")
    defined = d.select(F.col("path").alias("target"), F.col("name").alias("callee")).distinct()
    x = d.select("path", "name", F.explode("calls").alias("callee")).distinct().join(defined, "callee")
    n = x.groupBy("path", "name", "target").agg(F.countDistinct("callee").alias("n"))
    own = n.where("path = target").select("path", "name", F.col("n").alias("o"))
    t = n.where("path <> target").join(own, ["path", "name"], "left").select("path", "name", "target", F.col("n").alias("n_foreign"), F.coalesce("o", F.lit(0)).alias("n_own"))
    return t.where("n_foreign >= 3 and n_foreign > n_own")


@query(f"""with {_K}, t as (select distinct callee from k where contains(path, 'test') or contains(path, 'spec')), f as (select distinct path, "name" from d where kind = 'function' and not contains(path, 'test') and not contains(path, 'spec')) select path, count(*) n_functions, sum(case when "name" in (select callee from t) then 1 else 0 end)::bigint n_tested from f group by 1""")
def tested_functions(spark, root):
    """Functions of each file that is no test, and how many of them a test file calls by name."""
    d = _definitions(spark, root)
    is_test = F.col("path").contains("test") | F.col("path").contains("spec")
    called = d.where(is_test).select(F.explode("calls").alias("name")).distinct().withColumn("tested", F.lit(1))
    f = d.where(~is_test & (F.col("kind") == "function")).select("path", "name").distinct()
    return f.join(called, "name", "left").groupBy("path").agg(F.count(F.lit(1)).alias("n_functions"), F.count("tested").alias("n_tested"))


_BASE = r"(?m)^[ \t]*(?:export |default |abstract )*class (\w+)(?:\(| extends | implements )(\w+)"


@query(f"""with {_FC}, b as (select unnest(regexp_extract_all(new_content, '{_BASE}', 1)) child, unnest(regexp_extract_all(new_content, '{_BASE}', 2)) parent from fc where new_content is not null and regexp_matches(path, '\\.(py|js|ts)$')) select parent, count(distinct child) n_children, count(distinct child) >= 2 and regexp_matches(lower(parent), 'strategy|policy|algorithm|handler') is_strategy from b group by 1""")
def class_parents(spark, root):
    """Classes and interfaces that others are built on, and whether their name and children make a strategy."""
    pair = lambda i: F.regexp_extract_all("new_content", F.lit(_BASE), i)
    b = contents_once(spark, root, pairs=F.when(F.col("path").rlike(r"\.(py|js|ts)$"), F.arrays_zip(pair(1).alias("child"), pair(2).alias("parent")))).select(F.explode("pairs").alias("p")).select("p.child", "p.parent").distinct()
    n = b.groupBy("parent").agg(F.countDistinct("child").alias("n_children"))
    return n.select("parent", "n_children", ((F.col("n_children") >= 2) & F.lower("parent").rlike("strategy|policy|algorithm|handler")).alias("is_strategy"))


_STEM = "regexp_extract({c}, '([^/.:]+)(?:\\.[^/.:]*)*$', 1)"
_M = f"""{_X}, fs as (select distinct path, {_STEM.format(c='path')} stem from fc where path is not null and regexp_matches(path, '\\.(py|js|ts|rs)$')),
im as (select distinct path, {_STEM.format(c='name')} stem from (select path, case when regexp_matches(path, '\\.py$') then regexp_replace(name, '^.*\\.', '') when regexp_matches(path, '\\.rs$') then regexp_extract(name, '::(\\w+)', 1) else regexp_replace(name, '\\.(js|ts)$', '') end name from sy where kind = 'import')),
me as (select distinct im.path src, fs.path dst, im.stem from im join fs using (stem) where im.path <> fs.path and im.stem <> '')"""


def _file_edges(spark, root):
    """``src, dst, stem``: files and the files whose name, without endings, they import."""
    stem = lambda c: F.regexp_extract(c, r"([^/.:]+)(?:\.[^/.:]*)*$", 1)
    s = _symbols(spark, root)
    files = contents_once(spark, root, path=F.col("path")).where(F.col("path").rlike(r"\.(py|js|ts|rs)$")).select(F.col("path").alias("dst"), stem("path").alias("stem")).distinct()
    name = F.when(F.col("path").rlike(r"\.py$"), F.regexp_replace("name", r"^.*\.", "")).when(F.col("path").rlike(r"\.rs$"), F.regexp_extract("name", r"::(\w+)", 1)).otherwise(F.regexp_replace("name", r"\.(js|ts)$", ""))
    imports = s.where("kind = 'import'").select(F.col("path").alias("src"), name.alias("name")).select("src", stem("name").alias("stem")).distinct()
    return imports.join(files, "stem").where("src <> dst and stem <> ''").select("src", "dst", "stem").distinct()


@query(f"with {_M} select src, dst, stem from me")
def resolved_imports(spark, root):
    return _file_edges(spark, root)


@query(f"with {_M} select dst as path, count(distinct src) n_dependents, count(distinct case when contains(src, 'test') then src end) n_test_dependents from me group by 1")
def file_dependents(spark, root):
    e = _file_edges(spark, root)
    return e.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n_dependents"), F.countDistinct(F.when(F.col("src").contains("test"), F.col("src"))).alias("n_test_dependents"))


@query(f"""with recursive {_M}, ch as (select distinct path from fc where path is not null and modified_at >= timestamp '2025-06-01'), r(start, node, depth) as (select distinct path, path, 0 from ch where path in (select dst from me) union select r.start, me.src, r.depth + 1 from r join me on me.dst = r.node where r.depth < 5)
select start as changed, node as path, min(depth)::integer depth from r where node <> start group by 1, 2""")
def impact_cascade(spark, root):
    """Files that depend on a recently changed one, directly or over at most five imports."""
    e = _file_edges(spark, root)
    changed = contents_once(spark, root, path=F.col("path"), recent=F.col("modified_at") >= F.lit("2025-06-01").cast("timestamp_ntz")).where("recent and path is not null").select("path").distinct()
    starts = changed.join(e.select(F.col("dst").alias("path")).distinct(), "path", "left_semi")
    return graph.reachable(e.select("src", "dst"), starts, "dst", "src", 5).where("node <> start").select(F.col("start").alias("changed"), F.col("node").alias("path"), "depth")


@query(f"""with recursive {_M}, r(a, b) as (select src, dst from me union select r.a, me.dst from r join me on me.src = r.b), c as (select x.a as path, least(x.a, min(x.b)) as component from r x join r y on y.a = x.b and y.b = x.a group by 1 having max(case when x.b <> x.a then 1 else 0 end) = 1) select path, component from c""")
def import_cycles(spark, root):
    """Files that import each other in a circle, by the least file of each circle."""
    return graph.strong_components(_file_edges(spark, root), "src", "dst").withColumnRenamed("node", "path")


@query(f"""with recursive {_CP}, e as (select id s, parent_checkpoint_id d from cp where id is not null and parent_checkpoint_id is not null), p as (select distinct head_checkpoint_id a, base_checkpoint_id b from branches where head_checkpoint_id is not null and base_checkpoint_id is not null), r(a, b, node, n, way) as (select a, b, a, 0, a from p union all select r.a, r.b, e.d, r.n + 1, r.way || '>' || e.d from r join e on e.s = r.node where r.node <> r.b)
select a, b, n::integer n_steps, way from r where node = b""")
def shortest_paths(spark, root):
    """The shortest way up from each branch's head to its base."""
    p = table(spark, root, "branches").select(F.col("head_checkpoint_id").alias("a"), F.col("base_checkpoint_id").alias("b")).where("a is not null and b is not null").distinct()
    e = checkpoints_once(spark, root).select(F.col("id").alias("s"), F.col("parent_checkpoint_id").alias("d")).where("s is not null and d is not null")
    found = graph.shortest_paths(e, "s", "d", p, "a", "b")
    return found.select("a", "b", (F.size("path") - 1).alias("n_steps"), F.array_join("path", ">").alias("way"))


_S = r"""l as (select id, unnest(string_split(new_content, chr(10))) line, generate_subscripts(string_split(new_content, chr(10)), 1)::bigint line_no from fc where new_content is not null and ends_with(path, '.py')),
s as (select id, line_no, length(regexp_extract(line, '^([ \t]*)', 1)) indent, regexp_matches(line, '^[ \t]*(?:return|raise|throw|break|continue)\b') jumps, regexp_matches(line, '^[ \t]*(?:if|elif|for|while)\b') branches, regexp_extract(line, '^[ \t]*(\w+) = ', 1) target,
regexp_replace(regexp_replace(case when regexp_matches(line, '^[ \t]*\w+ = ') then regexp_replace(line, '^[ \t]*\w+ = ', '') else line end, '"[^"\n]*"|''[^''\n]*''', '', 'g'), '#.*$', '') plain from l where regexp_matches(line, '^[ \t]*[^ \t\r#/]'))"""
_PY = "path like '%.py'"


@query(rf"""with {_FC}, {_S}, n as (select *, lead(line_no) over (partition by id order by line_no) nx from s) select id, line_no src, nx dst, 'next' as kind from n where not jumps and nx is not null
union all select * from (select n.id, n.line_no, (select min(m.line_no) from s m where m.id = n.id and m.line_no > n.line_no and m.indent <= n.indent) dst, 'skip' from n where branches) where dst is not null""")
def flow_edges(spark, root):
    """Edges of control between the statements of each Python text."""
    e = contents_once(spark, root, lambda df: structure.with_flow(df.where(_PY), "new_content"), flow=F.col("flow"))
    return e.select("id", F.explode("flow").alias("e")).select("id", "e.*")


@query(rf"""with {_FC}, {_S}, n as (select id, line_no, indent, lag(jumps) over w pj, lag(indent) over w pi from s window w as (partition by id order by line_no)) select id, line_no from n where pj and indent = pi""")
def unreachable_statements(spark, root):
    """Statements that follow a jump of the same block, so that control never gets there."""
    e = contents_once(spark, root, lambda df: df.where(_PY).withColumn("_s", structure.statements(F.col("new_content"))), dead=F.expr("filter(transform(_s, (s, i) -> case when i > 0 and try_element_at(_s, i).jumps and try_element_at(_s, i).indent = s.indent then s.line_no end), x -> x is not null)"))
    return e.select("id", F.explode("dead").alias("line_no"))


@query(rf"""with {_FC}, {_S}, w as (select distinct id, target as variable, line_no from s where target <> ''), u as (select distinct id, r.v as variable, line_no from s, unnest(regexp_extract_all(plain, '\b([a-z_]\w*_\w*)(?:[^\w.(]|$)', 1)) r(v)) select u.id, u.variable, u.line_no used_at, (select max(w.line_no) from w where w.id = u.id and w.variable = u.variable and w.line_no <= u.line_no) defined_at from u where exists (select 1 from w where w.id = u.id and w.variable = u.variable)""")
def variable_uses(spark, root):
    """Each use of a variable that its text sets somewhere, with the last line at or before it that does."""
    s = contents_once(spark, root, lambda df: df.where(_PY), s=structure.statements(F.col("new_content"))).select("id", F.explode("s").alias("s")).select("id", "s.*")
    writes = s.where("target <> ''").select("id", F.col("target").alias("variable"), "line_no", F.lit(True).alias("w"))
    reads = s.select("id", F.explode("reads").alias("variable"), "line_no", F.lit(False).alias("w")).join(writes.select("id", "variable").distinct(), ["id", "variable"], "left_semi")
    return graph.def_use(writes.unionByName(reads), "id", "line_no", "variable", "w")


@query(rf"""with {_FC}, {_S}, u as (select distinct id, r.v as variable from s, unnest(regexp_extract_all(plain, '\b([a-z_]\w*_\w*)(?:[^\w.(]|$)', 1)) r(v)) select id, count(*) n_unset from u where not exists (select 1 from s w where w.id = u.id and w.target = u.variable) group by 1""")
def unset_variables(spark, root):
    """How many names each text reads that no statement of it sets."""
    s = F.col("_s")
    reads, targets = F.array_distinct(F.flatten(F.transform(s, lambda x: x["reads"]))), F.transform(s, lambda x: x["target"])
    e = contents_once(spark, root, lambda df: df.where(_PY).withColumn("_s", structure.statements(F.col("new_content"))), n_unset=F.size(F.array_except(reads, targets)).cast("long"))
    return e.where("n_unset > 0")


@query(rf"""with {_FC}, {_S}, b as (select id, line_no, coalesce(lag(jumps or branches) over w, true) or coalesce(lag(indent) over w > indent, false) lead from s window w as (partition by id order by line_no)), n as (select id, line_no, sum(lead::int) over (partition by id order by line_no) block from b) select id, block::bigint block, min(line_no) as first_line, max(line_no) as last_line, count(*) n from n group by 1, 2""")
def statement_blocks(spark, root):
    """Runs of statements that control passes from the first to the last: begun by the text, after a branch or a jump, and where a block ends."""
    lead = F.expr("transform(_s, (s, i) -> struct(s.line_no as line_no, i = 0 or coalesce(try_element_at(_s, i).jumps or try_element_at(_s, i).branches or try_element_at(_s, i).indent > s.indent, true) as lead))")
    e = contents_once(spark, root, lambda df: df.where(_PY).withColumn("_s", structure.statements(F.col("new_content"))), leads=lead).select("id", F.explode("leads").alias("x")).select("id", "x.line_no", "x.lead")
    return graph.basic_blocks(e, "id", "line_no", "lead").select("id", "block", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "n")
