"""Rule classifiers on paths, messages and questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules (label, pattern on the lower-case text); the first that matches names the class.
LANGUAGE_OF = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "md": "markdown", "json": "json", "toml": "toml", "yml": "yaml", "yaml": "yaml", "css": "css"}
FEATURES = [("Testing", "test|spec"), ("UI/Frontend", "ui|component"), ("API", "api|route|controller"), ("Authentication", "auth|security"), ("Database", "db|model|migration"), ("Configuration", "config|setting"), ("Utilities", "util|helper|lib"), ("Documentation", "doc|readme"), ("Build/CI", "build|script|ci")]
LAYERS = [("Presentation", "ui|view|component|page"), ("Business Logic", "service|manager|logic|core"), ("Data Access", "db|storage|repository|model"), ("API/Protocol", "api|protocol|route"), ("Infrastructure", "config|infra")]
AFFECTED_LAYERS = [("Presentation", r"component|view|page|gui|\.(css|scss|html|tsx|jsx)$"), ("Application", "service|controller|handler|route|api"), ("Domain", "model|entity|domain|type"), ("Database", "db|database|migration|schema|sql"), ("Infrastructure", "infra|storage|cache|queue"), ("Configuration", "config|env|setting"), ("Security", "auth|security|crypto"), ("Logging", "log|monitor|metric"), ("Testing", "test|spec|mock")]
# Only the first alternative of a commit rule is bound to the beginning.
COMMITS = [("feature", "^feat|add|implement|create"), ("bugfix", "^fix|bug|resolve|patch"), ("refactor", "^refactor|restructure|reorganize"), ("documentation", "^docs|documentation"), ("test", "^test|spec"), ("style", "^style|format"), ("maintenance", "^chore|maintenance"), ("performance", "^perf|performance|optimize"), ("security", "^security|secure")]
QUESTIONS = [
    ("implementation", "how to|implement|create|build|add|write|make|develop|code|generate"),
    ("debugging", "error|bug|fix|issue|problem|not working|debug|broken|fails?|crash"),
    ("refactoring", "refactor|improve|optimize|restructure|clean up|reorganize|simplify"),
    ("explanation", "what is|explain|how does|understand|clarify|describe|tell me about"),
    ("architecture", "architecture|design|pattern|structure|organize|system|framework"),
    ("testing", "test|testing|unit test|integration test|mock|spec|coverage"),
    ("documentation", "document|docs|comment|readme|guide|tutorial"),
]
LEARNED_QUESTIONS = [("implementation", "how to|implement|create|build"), ("debugging", "error|bug|fix|issue|problem"), ("refactoring", "refactor|improve|optimize"), ("explanation", "what is|explain|how does")]
SCOPES = [("function", "function|method|procedure|routine"), ("class", "class|object|constructor|instance"), ("module", "module|file|component|service"), ("package", "package|library|framework|dependency"), ("system", "system|application|architecture|entire|whole|all")]
WIDE_SCOPES = [("system", "system|application|entire|whole|all|global"), ("module", "module|package|namespace|library"), ("class", "class|interface|type|object"), ("function", "function|method|procedure"), ("variable", "variable|property|field|attribute")]
FILE_GROUPS = {
    "source": r"\.(ts|tsx|js|jsx|py|rs|go|java|cpp|c|h)$",
    "test": r"\.(test|spec)\.(ts|tsx|js|jsx)$|/test/",
    "config": r"\.(json|yaml|yml|toml|ini|conf|config)$|(^|/)webpack\.config\.js$",
    "documentation": r"\.(md|rst|txt)$|/docs/",
    "assets": r"\.(png|jpg|jpeg|gif|svg|css|scss|sass|less)$",
}


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column | str | None) -> Column:
    out = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def all_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))


def language(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("text"))


def layer(path: Column) -> Column:
    return first_match(F.lower(path), LAYERS, None)


def feature(path: Column) -> Column:
    """Named area of a path, else its top folder."""
    return first_match(F.lower(path), FEATURES, F.split(path, "/")[0])


def path_kinds(path: Column) -> dict[str, Column]:
    """Whether a path is one of configuration, security, infrastructure, interface and database; each by its own rules."""
    p = F.lower(path)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return {
        "is_config": name.rlike(r"config|settings|\.(env|toml|ini|cfg)$") | name.isin("package.json", "tsconfig.json", "cargo.toml", ".eslintrc", ".prettierrc"),
        "is_security": p.rlike(r"auth|crypto|security|password|secret|token|cert|key|\.pem$"),
        "is_infrastructure": name.isin("dockerfile", "docker-compose.yml", "docker-compose.yaml", "jenkinsfile", "makefile", "build.js", "build.rs", "webpack.config.js", "vite.config.ts", "rollup.config.js") | p.rlike(r"\.dockerfile$|\.github/workflows|\.gitlab-ci|ci/|deploy/"),
        "is_api": p.rlike(r"api|routes|endpoints|controller|handler|protocol|schema|graphql|\.(proto|swagger|openapi)$"),
        "is_database": p.rlike(r"migration|schema|db/|database") | name.rlike(r"\.sql$|prisma|knex"),
    }
