"""Published scoring and labelling rules for texts, names and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the rules.
POSITIVE, NEGATIVE = ["good", "great", "excellent", "perfect", "awesome"], ["bad", "terrible", "awful", "broken", "error", "problem"]
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]
FEATURE_OF_FOLDER = {
    "authentication": ["auth", "login", "oauth", "session"],
    "api": ["api", "routes", "endpoints", "handlers"],
    "database": ["db", "database", "migrations", "models", "schema"],
    "ui": ["ui", "components", "views", "pages", "gui"],
    "testing": ["test", "tests", "spec", "testing"],
    "configuration": ["config", "settings", "env"],
    "utilities": ["util", "utils", "helpers", "lib"],
}
CONCEPTS = [
    ("authentication", 0.95, "auth|login|user|password|token|session"),
    ("authorization", 0.85, "auth|login|user|password|token|session"),
    ("session_management", 0.80, "auth|login|user|password|token|session"),
    ("data_persistence", 0.90, "database|db|save|store|persist|repository"),
    ("api_communication", 0.90, "api|endpoint|request|response|http|rest"),
    ("react", 0.90, "react|component|hook|usestate|useeffect|jsx"),
    ("express", 0.90, r"express|middleware|router|app\.get|app\.post"),
]
WEIGHTED_QUESTIONS = {
    "implementation": ["how to|implement|create|build|add|write|make|develop", "function|method|class|component", "code|solution|example"],
    "debugging": ["error|bug|fix|issue|problem|not working|debug|broken", "why.*not|what.*wrong|doesn't work", "exception|crash|fail"],
    "refactoring": ["refactor|improve|optimize|clean up|restructure|reorganize", "better way|best practice|code smell", "performance|efficiency"],
    "explanation": ["what is|explain|how does|understand|clarify|describe", "what.*do|how.*work|why.*use", "meaning|purpose|concept"],
    "architecture": ["architecture|design|pattern|structure|organize|system", "module|component|service|layer", "dependency|relationship|interaction"],
    "testing": ["test|testing|unit test|integration test|e2e", "mock|stub|assertion|coverage", "spec|specification"],
    "documentation": ["document|documentation|comment|jsdoc|readme", "api.*doc|guide|tutorial", "example.*usage"],
    "performance": ["performance|speed|slow|fast|optimize|efficiency", "memory|cpu|benchmark|profile", "bottleneck|latency"],
    "security": ["security|secure|vulnerability|auth|permission", "encrypt|hash|sanitize|validate", "xss|csrf|injection"],
}
IMPLEMENTING, DEBUGGING, EXPLAINING = ["implement", "create", "build", "make", "write", "add"], ["error", "bug", "fix", "issue", "problem", "debug"], ["what", "how", "explain", "understand", "describe"]
REFACTORING, DESIGNING = ["refactor", "improve", "optimize", "clean"], ["architecture", "design", "pattern", "structure"]
IMPERATIVE, ASKING = ["create", "build", "make", "implement", "fix", "solve", "refactor", "optimize"], ["what", "how", "why", "where", "when", "which", "who"]
VERB_ENDINGS, PREFIXES, ROLES = ["er", "ed", "ing", "tion", "tor", "able"], ["get", "set", "is", "has", "can", "should"], ["Service", "Manager", "Handler", "Controller", "Repository"]


def tokens(text: Column) -> Column:
    """Lower-case words between white space; an end of white space leaves an empty word."""
    return F.split(F.lower(text), r"[\t\n\f\r ]+")


def hits(words: Column, wanted: list[str]) -> Column:
    """How many words, repeats included, are among the wanted ones."""
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def contained(text: Column, wanted: list[str]) -> Column:
    """How many of the wanted texts a lower-case text contains."""
    total = F.lit(0)
    for w in wanted:
        total = total + text.contains(w).cast("int")
    return total


def mood(text: Column) -> Column:
    p, n = hits(tokens(text), POSITIVE), hits(tokens(text), NEGATIVE)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def mood_score(text: Column) -> Column:
    t = tokens(text)
    s = (hits(t, [*POSITIVE, "help"]) - hits(t, [*NEGATIVE, "issue", "fail"])) / F.size(t)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))


def keywords(text: Column, most: int = 10) -> Column:
    return F.slice(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)), 1, most)


def ascii(text: Column) -> Column:
    """Letters beyond ASCII as blanks, so that a word's edge is one of ASCII words."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def _share(text: Column, pattern: str, most: float) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(ascii(text), F.lit(pattern)) / most)


def complexity(text: Column) -> Column:
    """Mean of length, technical terms and brackets, each as a share of what counts as much."""
    return (F.least(F.lit(1.0), F.length(text) / 100) + _share(text, r"\b[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*\(|\.|->", 10) + _share(text, r"\([^)]*\)|\{[^}]*\}|\[[^\]]*\]", 5)) / 3


def specificity(text: Column) -> Column:
    """Mean of named entities, paths and numbers, each as a share of what counts as many."""
    return (_share(text, r"\b[a-z][A-Z][a-zA-Z0-9]*|[a-zA-Z_][a-zA-Z0-9_]*\(", 5) + _share(text, r"/[a-zA-Z0-9_\-/]*|[a-zA-Z0-9_\-]*\.[a-zA-Z0-9]+", 3) + _share(text, r"\b\d+(?:\.\d+)*\b", 3)) / 3


def model_scores(text: Column) -> dict[str, Column]:
    """Score of each kind of question from counts of its words, at most 1."""
    t = F.lower(text)
    named = F.when(text.rlike(r"[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*\(|\.[a-zA-Z]"), 0.2).otherwise(0.0)
    asked = F.when(text.contains("?"), 0.3).otherwise(0.0)
    raw = {
        "implementation": 0.1 + contained(t, IMPLEMENTING) * 0.3 + contained(t, IMPERATIVE) * 0.2 + named,
        "debugging": 0.1 + contained(t, DEBUGGING) * 0.4 + named,
        "explanation": 0.1 + contained(t, EXPLAINING) * 0.3 + contained(t, ASKING) * 0.2 + asked,
        "refactoring": 0.1 + contained(t, REFACTORING) * 0.4 + named,
        "architecture": 0.1 + contained(t, DESIGNING) * 0.5,
    }
    return {k: F.round(F.least(v, F.lit(1.0)), 6) for k, v in raw.items()}


def first_greatest(scores: dict[str, Column]) -> Column:
    """Name of the greatest score; of equal ones the first."""
    out = F.lit(None).cast("string")
    best = F.greatest(*scores.values())
    for name in reversed(scores):
        out = F.when(scores[name] == best, name).otherwise(out)
    return out


def name_variants(word: Column) -> Column:
    """``name, relevance`` of a word's plural or singular, verb forms, prefixed and role names."""
    of = lambda c, r: F.struct(c.alias("name"), F.lit(r).alias("relevance"))
    first = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))
    number = of(F.when(word.endswith("s"), F.left(word, F.length(word) - 1)).otherwise(F.concat(word, F.lit("s"))), 0.85)
    verbs = F.when(F.octet_length(word) < 4, F.array().cast("array<struct<name:string,relevance:double>>")).otherwise(F.array(*[of(F.concat(word, F.lit(e)), 0.7) for e in VERB_ENDINGS]))
    return F.concat(F.array(number), verbs, F.array(*[of(F.concat(F.lit(p), first), 0.75) for p in PREFIXES]), F.array(*[of(F.concat(first, F.lit(r)), 0.7) for r in ROLES]))


def dependency_source(module: Column) -> Column:
    return F.when(module.startswith("@") | module.rlike("react|vue|angular|lodash|express|axios|typescript"), "npm").when(module.rlike(r"java|org\."), "maven").when(module.rlike(r"System\.|Microsoft\."), "nuget").otherwise("unknown")


def warming_priority(path: Column) -> Column:
    plus = lambda pattern, n: F.when(path.rlike(pattern), n).otherwise(0)
    return F.lit(50) + plus(r"\.(ts|js)$", 20) + plus(r"\.py$", 15) + plus(r"\.rs$", 10) + plus("/src/", 15) + plus("/lib/", 10) + plus("/core/", 10) - plus(r"/test/|spec\.", 10)


def literal_type(expression: Column) -> Column:
    """Kind of type that an expression's own text shows."""
    e = expression
    return (
        F.when(e.rlike("^[\"']"), "string").when(e.rlike(r"^[+-]?[0-9]{1,18}$"), "number").when(e.isin("true", "false"), "boolean").when(e == "null", "null").when(e == "undefined", "undefined")
        .when(e.startswith("[") & e.endswith("]"), "array").when(e.startswith("{") & e.endswith("}"), "object").when(e.contains("=>") | e.startswith("function"), "function").otherwise("unknown")
    )


def unified(kinds: Column) -> Column:
    """One type for a set of kinds: unknown ones give way, different ones make a union."""
    known = F.array_sort(F.filter(F.array_distinct(kinds), lambda k: k != "unknown"))
    return F.when(F.size(known) == 0, "unknown").when(F.size(known) == 1, F.try_element_at(known, F.lit(1))).otherwise(F.array_join(known, " | "))


def compatible(a: Column, b: Column) -> Column:
    """Whether one kind may stand for the other: unknown ones and unions fit everything."""
    return (a == "unknown") | (b == "unknown") | a.contains(" | ") | b.contains(" | ") | (a == b)


def impact_rank(kind: Column) -> Column:
    """Order of impacts; the greater one wins when two are merged."""
    return F.when(kind == "signature_change", 3).when(kind == "module_change", 2).when(kind == "implementation_change", 1).otherwise(0)
