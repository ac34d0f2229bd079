"""Queries of the problems on training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.credentials import credential_lines, redacted
from tesserae.llm.handwritten import not_handwritten
from tesserae.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from tesserae.llm.packing import fill_containers
from tesserae.llm.parsing import parse_errors
from tesserae.llm.spans import shared_coverage, shared_span_pairs
from tesserae.llm.stuffing import stuffed_pages
from tesserae.llm.tokens import count_column, encode_column
from tesserae.operators.integrity import normal_key
from tesserae.runtime import materialize
from tesserae.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of file changes in which a credential begins."""
    found = credential_lines(table(spark, root, "file_changes"), "id", "path", {"original": "original_content", "new": "new_content"})
    return found.withColumnRenamed("id", "file_change_id")


def p2_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The texts of all file changes with their credentials blanked."""
    return redacted(table(spark, root, "file_changes"), "id", "path", ["original_content", "new_content"])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of file changes at different paths that share a passage of 200 characters."""
    return shared_span_pairs(table(spark, root, "file_changes"), "id", "path", ["original_content", "new_content"], span=200)


def p3_shared(spark: SparkSession, root: str) -> DataFrame:
    """Characters of each content of a file change that also stand in one at another path."""
    changes = table(spark, root, "file_changes")
    return shared_coverage(changes, "id", "path", ["original_content", "new_content"], span=200)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of file changes at different paths whose new contents are near duplicates."""
    return near_duplicate_pairs(table(spark, root, "file_changes"), "id", "path", "new_content")


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    """The group of each file change that has a near duplicate, and its number of links."""
    return near_duplicate_groups(table(spark, root, "file_changes"), "id", "path", "new_content")


def _workspaces(spark: SparkSession, root: str) -> DataFrame:
    """``id, workspace_path`` of each file change whose checkpoint and session are known."""
    changes, checkpoints, sessions = (table(spark, root, n) for n in ("file_changes", "checkpoints", "sessions"))
    of_session = sessions.select(normal_key(F.col("id")).alias("session"), "workspace_path").where("session is not null").groupBy("session").agg(F.min("workspace_path").alias("workspace_path"))
    of_checkpoint = checkpoints.select(normal_key(F.col("id")).alias("checkpoint"), normal_key(F.col("session_id")).alias("session")).where("checkpoint is not null and session is not null").groupBy("checkpoint").agg(F.min("session").alias("session"))
    of_change = changes.select("id", normal_key(F.col("checkpoint_id")).alias("checkpoint")).where("checkpoint is not null").groupBy("id").agg(F.min("checkpoint").alias("checkpoint"))
    return of_change.join(of_checkpoint, "checkpoint").join(of_session, "session").where("workspace_path is not null").select("id", "workspace_path")


def _parse_errors(spark: SparkSession, root: str) -> DataFrame:
    # A fixed list of languages; it does not grow with the files.
    languages = {r.ext: r.language_name for r in table(spark, root, "file_languages").where("is_parsed").select("ext", "language_name").collect()}
    return parse_errors(table(spark, root, "file_changes"), "id", "path", "new_content", languages)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """File changes whose new content is not valid in the language of their path."""
    return _parse_errors(spark, root).where("error_line is not null").select(F.col("id").alias("file_change_id")).distinct()


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Judged and invalid file changes per workspace and language; those of no known workspace under null."""
    each = _parse_errors(spark, root).groupBy("id", "language_name").agg(F.max(F.when(F.col("error_line").isNotNull(), 1).otherwise(0)).alias("invalid"))
    placed = each.join(_workspaces(spark, root), "id", "left")
    return placed.groupBy("workspace_path", "language_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("invalid").alias("n_invalid"), F.round(F.avg("invalid"), 6).alias("invalid_rate"))


def _attribute_files(spark: SparkSession, root: str, workspaces: DataFrame) -> DataFrame:
    """``workspace, folder, text``: the latest version of each attribute file of a known workspace."""
    held = table(spark, root, "file_changes").where("path like '%.gitattributes' and new_content is not null").where("path = '.gitattributes' or path like '%/.gitattributes'")
    held = held.select("id", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.col("new_content").alias("text"), "modified_at")
    return held.join(workspaces, "id").groupBy("workspace", "folder").agg(F.max_by("text", F.struct("modified_at", "id", "text")).alias("text"))


def _not_handwritten(spark: SparkSession, root: str) -> DataFrame:
    workspaces = _workspaces(spark, root).withColumnRenamed("workspace_path", "workspace")
    return not_handwritten(table(spark, root, "file_changes"), "id", "path", "new_content", workspaces, _attribute_files(spark, root, workspaces))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """File changes whose content nobody on the project wrote by hand."""
    return _not_handwritten(spark, root).select(F.col("id").alias("file_change_id")).distinct()


def p6_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Their number by reason."""
    return _not_handwritten(spark, root).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, root, "documents"), "doc_id", "text")


def _containers(spark: SparkSession, root: str) -> DataFrame:
    counts = materialize(count_column(table(spark, root, "documents"), "doc_id", "text"))
    # A fixed list of a few capacities; it does not grow with the documents.
    budgets = [(r.budget_id, r.capacity_tokens) for r in table(spark, root, "token_budgets").select("budget_id", "capacity_tokens").distinct().orderBy("budget_id").collect()]
    return fill_containers(counts, "doc_id", "n_tokens", budgets)


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every document, or piece of a document, for each capacity."""
    return _containers(spark, root)


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and unused room per capacity."""
    budgets = table(spark, root, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    used = _containers(spark, root).groupBy("budget_id").agg(F.countDistinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(budgets, "budget_id").select("budget_id", "n_containers", "n_items", "n_tokens", (F.col("n_containers") * F.col("capacity_tokens") - F.col("n_tokens")).alias("unused_tokens"))


def p8_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Per capacity: documents placed, containers over their capacity, documents cut though they would fit, and pieces short of the capacity that are not the last."""
    budgets = table(spark, root, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    placed = _containers(spark, root).join(budgets, "budget_id")
    over = placed.groupBy("budget_id", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id").agg(F.sum(F.when(F.col("n") > F.col("capacity_tokens"), 1).otherwise(0)).alias("n_overfull"))
    each = placed.groupBy("budget_id", "doc_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"))
    # A document of n tokens has n / capacity pieces, rounded up, and at least one.
    wrong = F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))
    return each.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(wrong, 1).otherwise(0)).alias("n_wrongly_cut")).join(over, "budget_id")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that consist of keywords, links or tags instead of sentences."""
    return stuffed_pages(table(spark, root, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_shared": p3_shared,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_reasons": p6_reasons,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
}
SQL: dict[str, str] = {
    "p8_invariants": "select distinct budget_id, (select count(distinct doc_id) from documents) n_documents, cast(0 as bigint) n_wrongly_cut, cast(0 as bigint) n_overfull from token_budgets",
    "p3_found": """
with c as (select id, coalesce(any_value(path), '') path, any_value(original_content) o, any_value(new_content) n from file_changes where id is not null group by id),
t as (select id, path, unnest([o, n]) t from c),
w as (select id, path, unnest(list_transform(range(1, length(t) - 198), lambda i: hash(substr(t, i, 200)))) h from t where length(t) >= 200),
u as (select distinct id, path, h from w)
select distinct a.id id_a, b.id id_b from u a join u b on a.h = b.h and a.id < b.id and a.path <> b.path""",
    "p4_groups": """
with recursive c as (select id, any_value(path) path, any_value(new_content) t from file_changes where new_content is not null and id is not null group by id),
w as (select id, coalesce(path, '') path, regexp_extract_all(lower(t), '[a-z0-9_]+') w from c),
s as (select id, path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from w where len(w) >= 30),
x as (select id, path, len(s) n, unnest(s) g from s),
p as (select a.id id_a, b.id id_b, any_value(a.n) na, any_value(b.n) nb, count(*) k from x a join x b on a.g = b.g and a.id < b.id and a.path <> b.path group by 1, 2),
e as materialized (select id_a, id_b from p where 10 * k >= 7 * (na + nb - k) union all select id_b, id_a from p where 10 * k >= 7 * (na + nb - k)),
r(id, other) as (select id_a, id_b from e union select r.id, e.id_b from r join e on e.id_a = r.other)
select id, least(id, min(other)) group_id, (select count(*) from e where e.id_a = r.id) n_links from r group by id""",
    "p4_found": """
with c as (select id, any_value(path) path, any_value(new_content) t from file_changes where new_content is not null and id is not null group by id),
w as (select id, coalesce(path, '') path, regexp_extract_all(lower(t), '[a-z0-9_]+') w from c),
s as (select id, path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from w where len(w) >= 30),
x as (select id, path, len(s) n, unnest(s) g from s),
p as (select a.id id_a, b.id id_b, any_value(a.n) na, any_value(b.n) nb, count(*) k from x a join x b on a.g = b.g and a.id < b.id and a.path <> b.path group by 1, 2)
select id_a, id_b from p where 10 * k >= 7 * (na + nb - k)""",
}
