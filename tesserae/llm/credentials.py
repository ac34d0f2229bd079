"""Credentials embedded in source code and configuration, found and blanked in place.

A text is turned into entries of (key path, value, offsets): configuration formats by their own rules
(sections, nested mappings, block scalars, quoting), program text by its string literals with the name
or call they belong to, comments and prose by their last words before a value. A value counts by its
own shape if that is unmistakable (issued prefixes, signed tokens, passwords inside URLs and connection
strings, private keys), else by shape and name together. Spans are spliced in the original text, each
by letters of the same length, so that quoting, line structure and every other byte stay as they were.
Offsets count code points. Nothing is cut by length: values, names and texts are read to their ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tokens import slices


@dataclass(frozen=True)
class Entry:
    """A value at ``[start, end)`` under a key path; ``pieces`` are the spans it is written in."""

    path: tuple[str, ...]
    value: str
    pieces: tuple[tuple[int, int], ...]
    context: str  # config, code, call or prose


# --- names ------------------------------------------------------------------------------------

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Words that make a name sensitive, and last words that say a value is none.
SENSITIVE = {"password", "passwd", "pwd", "passphrase", "pass", "passcode", "pw", "secret", "secrets", "token", "tokens", "apikey", "credential", "credentials", "creds", "cred", "auth", "authorization", "authtoken", "dbpass", "psk", "conn", "dsn", "k", "pin", "bearer"}
SENSITIVE_PAIRS = {("api", "key"), ("signing", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("encryption", "key"), ("master", "key"), ("license", "key"), ("account", "key"), ("shared", "key"), ("service", "key"), ("connection", "string"), ("auth", "key"), ("webhook", "key")}
HARMLESS_LAST = {"hint", "id", "ids", "uuid", "guid", "commit", "sha", "sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "integrity", "fingerprint", "revision", "rev", "etag", "public", "pub", "name", "label", "prompt", "placeholder", "help", "message", "text", "title", "url", "uri", "path", "file", "field", "type", "format", "pattern", "regex", "length", "len", "min", "max", "count", "limit", "budget", "ttl", "expiry", "expires", "version", "policy", "rule", "rules", "env", "ref", "header", "column", "table", "param"}
_SENSITIVE_TEXT = re.compile(r"(?i)passw|passphrase|\bpwd\b|secret|token|api[ _-]?key|apikey|credential|signing key|private key|access key|auth|db[ _]?pass|\bpass\b|\bk\b|\bconn\b|\bkey\b")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def _judge(name: str) -> int:
    """1 for a sensitive name, -1 for one that promises something harmless, else 0."""
    w = name_words(name)
    while w and w[-1].isdigit():
        w.pop()
    if not w:
        return 0
    if w[-1] in HARMLESS_LAST or w[-2:] in (["public", "key"], ["key", "id"]):
        return -1
    if any(x in SENSITIVE for x in w) and (w[-1] in SENSITIVE or w[-1] in ("value", "key", "prod", "dev", "test", "staging", "default", "old", "new", "live", "str", "string", "b64", "base64")):
        return 1
    return 1 if tuple(w[-2:]) in SENSITIVE_PAIRS else 0


_judged: dict[str, int] = {}


def judge_name(name: str) -> int:
    if name not in _judged:
        if len(_judged) > 100_000:
            _judged.clear()
        _judged[name] = _judge(name)
    return _judged[name]


# --- value shapes -----------------------------------------------------------------------------

# Published token formats, and the general form of a vendor prefix before random letters.
_ISSUED = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}"
    r"|gh[a-z]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}"
    r"|xox[a-z]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|[a-z]{2,5}_(?:live|test|prod)_[A-Za-z0-9]{12,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|AIza[0-9A-Za-z_-]{30,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}"
)
_PREFIXED = re.compile(r"[A-Za-z]{2,6}[_.\-]([A-Za-z0-9]{16,})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_HASHED = re.compile(r"(?i)(?:sha\d{1,3}|md5|blake\w+)[-:=]")
_PLACEHOLDER = re.compile(r"(?i)^<.*>?$|^\[.*\]$|\$\{|\$\(|^\$[A-Z_]|\{\{|%\(|^%\w+%$|^(?:vault|env|secret|secrets|ssm|op|arn|keyring|sops|aws-sm|gcp-sm|azure-kv|file|doppler)[:=]|process\.env|os\.environ|getenv|^(?:your|my|the|change|replace|insert|enter|example|sample|dummy|fake|test|todo|none|null|true|false|undefined|redacted)\b|change[-_]?me|placeholder|example$|^x{4,}$|^#|your[-_ ]")
_MASKED = re.compile(r"[*•xX.#]{4,}|(.)\1{5,}")
_RANDOM_SET = re.compile(r"[A-Za-z0-9+/_.=\-]{16,}")
_URL_PASSWORD = re.compile(r"://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]{3,})@[^\s\"'`]")
_PAIR_PASSWORD = re.compile(r"(?i)\b(?:pwd|password|accountkey|sharedaccesskey)\s*=\s*([^;\"'`\s]{4,})")
_SCHEME = re.compile(r"(?i)\b(?:bearer|token|basic|apikey)\s+([^\s\"'`<>(){},;\\]{6,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


_KEY_LINE = re.compile(r"(?:\\[nrt]|//|\+(?=\s)|[^A-Za-z0-9+/=])*[A-Za-z0-9+/]{24,}={0,2}")
_KEY_LAST = re.compile(r"(?:\\[nrt]|//|\+(?=\s)|[^A-Za-z0-9+/=])*(?:[A-Za-z0-9+/]+={1,2}|(?=[A-Za-z+/]*\d)[A-Za-z0-9+/]{2,})(?=[\s\"'`,;\\]|$)")
_KEY_HEADS = re.compile(r"(?:\\[nrt]|\W)*(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\n\\]*(?:\s|\\[nrt])*)*")


def _key_body_end(text: str, at: int) -> int:
    """Where the lines of key letters that follow ``at`` end, however many; a short last one belongs to them."""
    if heads := _KEY_HEADS.match(text, at):
        at = heads.end()
    while line := _KEY_LINE.match(text, at):
        at = line.end()
    last = _KEY_LAST.match(text, at)
    return last.end() if last else at


def placeholder(v: str) -> bool:
    return bool(_PLACEHOLDER.search(v) or _MASKED.fullmatch(v) or len(set(v)) < 4)


def _random(v: str) -> bool:
    """Letters drawn at random: both cases and digits mixed without words."""
    if not _RANDOM_SET.fullmatch(v) or _UUID.fullmatch(v):
        return False
    runs = re.findall(r"\d+", v)
    if len(runs) < 2 or not re.search("[a-z]", v) or not re.search("[A-Z]", v):
        return False
    return len(max(re.findall("[a-z]+", v), key=len)) < 6


def _restless(v: str) -> bool:
    """Letters that change between cases and digits as often as drawn ones do."""
    kinds = [2 if c.isdigit() else c.isupper() for c in v]
    return len(v) >= 20 and 2 in kinds and sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.45 * len(v)


def _basic(v: str) -> bool:
    """Base64 of ``user:password``."""
    if len(v) < 12 or len(v) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v):
        return False
    try:
        plain = base64.b64decode(v, validate=True)
    except (ValueError, binascii.Error):
        return False
    return b":" in plain and all(32 <= c < 127 for c in plain)


def unmistakable(v: str) -> bool:
    m = _ISSUED.fullmatch(v)
    if m:
        return not placeholder(v)
    m = _PREFIXED.fullmatch(v)
    return bool(m and (_random(v) and len(re.findall(r"\d+", m[1])) > 1 or _restless(m[1]))) or _basic(v)


def password_like(v: str) -> bool:
    """What may be a password under a name that says so: one word that no language would spell."""
    if len(v) < 6 or re.search(r"\s", v) or placeholder(v) or _UUID.fullmatch(v) or _HASHED.match(v):
        return False
    if v.startswith(("./", "../", "/", "http:", "https:", "data:", "@/")) and not _random(v) and not re.fullmatch(r"/[A-Za-z0-9+/]{20,}=*", v):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?", v) and not _random(v) and not (_PREFIXED.fullmatch(v) and re.search(r"\d", v) and len(re.findall("[A-Z]", v)) > 2):
        return False
    if re.fullmatch(r"[\d.,:\-+/ ]+", v):
        return False
    return bool(re.search(r"\d", v) and re.search("[A-Za-z]", v) or re.search(r"[!@#$%^&*+=?]", v) and re.search("[A-Za-z]", v) or re.search("[a-z][A-Z]{2,}[a-z]", v) or len(v) >= 8 and len(re.findall("[A-Z]", v)) >= 0.28 * len(v) and re.search("[a-z]", v) and not v.isupper() and "_" not in v)


_PHRASE = re.compile(r"[a-z0-9]+(?: [a-z0-9]+){2,}")
# Words of texts about passwords, which no passphrase is.
_TELLING = frozenset("a an and any are as at be by can change choose do enter for from here if in invalid is it many me must my new no not of on or our passphrase password please repeat required reset secret set short the this to token too type use used user was we with wrong you your".split())


def passphrase_like(v: str) -> bool:
    """Several plain words that make no sentence."""
    return bool(_PHRASE.fullmatch(v)) and not _TELLING.intersection(v.split())


#: Names of things that hold nothing but credentials, whatever their keys.
HOLDERS = {"credentials", "creds", "secrets", "passwords", "tokens", "passwd", "apikeys"}


def is_credential(entry: Entry) -> bool:
    v = entry.value
    name = entry.path[-1] if entry.path else ""
    said = judge_name(name)
    if said == 0 and len(entry.path) > 1 and (name.isdigit() or name.lower() in ("value", "default", "data", "current", "main", "primary", "v")):
        said = judge_name(entry.path[-2])
    if said == 0 and entry.context == "config" and HOLDERS.intersection(w for p in entry.path[:-1] for w in ("".join(name_words(p)), *name_words(p)[-1:])):
        # Under a holder of credentials any key may hold one, if the value looks it.
        said = 1 if len(v) >= 8 and re.search(r"\d", v) and re.search("[A-Za-z]", v) else 0
    if said > 0 and " " in v:
        return "passphrase" in name.lower() and passphrase_like(v)
    if said > 0 and _UUID.fullmatch(v):
        return name_words(name)[-2:] == ["api", "key"] or name_words(name)[-1:] in (["apikey"], ["secret"], ["password"])
    if said == 0 and entry.context != "call" and len(v) < 12 or _UUID.fullmatch(v) or placeholder(v) or _HASHED.match(v):
        return False
    if unmistakable(v):
        return not (said < 0 and not _ISSUED.fullmatch(v))
    if said < 0:
        return False
    if said > 0 or entry.context == "call":
        return password_like(v)
    return len(v) >= 20 and _random(v) and not _HEX.fullmatch(v)


# --- from texts to entries ----------------------------------------------------------------------

_STRING = re.compile(r"""(?P<q>["'`])(?P<v>(?=[^"'`\s]*[0-9+/=!@#$%^&*A-Z])[^"'`\s\\]{3,})(?P=q)""")
_ESCAPED = re.compile(r"""(?P<q>["'])(?P<v>(?:[^"'`\s\\]|\\[^\s\\nrt])*\\["'\\](?:[^"'`\s\\]|\\[^\s\\nrt])*)(?P=q)""")
_QUOTED_PHRASE = re.compile(r"""(?P<k>[\w.\-]*(?:pass_?phrase|PASS_?PHRASE|[Pp]ass[Pp]hrase))["']?(?:\s*:\s*(?:&?(?:'static )?str|[sS]tring))?\s*(?::=|=>|=|:)\s*(?P<q>["'`])(?P<v>[a-z0-9]+(?: [a-z0-9]+){2,})(?P=q)""")
_ELEMENT = re.compile(r"<(?P<k>[A-Za-z_][\w.\-:]*)(?:\s[^<>]*)?>\s*(?P<v>[^<>\s]+)\s*</(?P=k)\s*>")
_NAMED_VALUE = re.compile(r"""\b(?:key|name)\s*=\s*(?P<q>["'])(?P<k>[\w.\-:]+)(?P=q)\s+value\s*=\s*(?P<r>["'])(?P<v>[^"'\s]+)(?P=r)""")
_PROPERTY = re.compile(r"<key>\s*(?P<k>[\w.\-]+)\s*</key>\s*<string>\s*(?P<v>[^<>\s]+)\s*</string>")
_JOIN = re.compile(r"""\s*(?:\+|\\\n|,|\.\.|)\s*(?P<q>["'`])(?P<v>[^"'`\s\\]+)(?P=q)""")
_NAME_BEFORE = re.compile(r"""(?:(?P<q>["'`])(?P<quoted>[\w.\-/ ]+)(?P=q)|(?P<bare>[A-Za-z_$][\w$.\-]*))\s*(?:\]\s*)?\??(?::\s*[&'\w<>\[\]| .]+?)?\s*(?::=|=>|=|:)\s*(?:[rbfu]{0,2})(?:String::from|concat!|str|bytes|b|new\s+\w+|\w+\.from)?\s*\(?\s*$""")
_NAMING = frozenset("=:>(rbfumst")
_CALL_BEFORE = re.compile(r"""\b(?P<call>[A-Za-z_]\w*)\(\s*(?:(?P<q>["'`])(?P<arg>[^"'`]*)(?P=q)\s*,\s*)?$""")
_AUTH_CALL = re.compile(r"(?i)auth|login|connect|header|credential|password|passwd|secret|token|api_?key|sign_?in|set_?pass|with_?key")
_CONFIG_LINE = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:-[ \t]+)?(?:export[ \t]+)?(?P<k>[\"']?[\w.\-/]+[\"']?)[ \t]*(?P<sep>[:=])[ \t]*(?P<v>[^\n\r]*)")
_YAML_LINE = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:(?:-[ \t]+)*(?P<k>[\"']?[\w.\-/]+[\"']?)[ \t]*(?P<sep>:(?=[ \t\r\n]|$)|=|:)[ \t]*|(?:-[ \t]+)+)(?P<v>[^\n\r]*)")
_YAML_MARK = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+")
_BLOCK_HEAD = re.compile(r"[|>][+\-\d]*(?:[ \t]+#.*)?")
_FLOW_PARTS = r"""(?P<open>[{\[])|(?P<mark>[}\],])|(?P<sep>%s)|(?P<q>["'])(?P<s>(?:\\[\s\S]|(?!(?P=q))[^\\])*)(?P=q)|(?:\#|//)[^\n]*|(?P<plain>%s)"""
_FLOW = re.compile(_FLOW_PARTS % (":", r"""(?:[^\s{}\[\],:"'#]|:(?=[^\s,}\]]))(?:[^\s{}\[\],:]|:(?=[^\s,}\]])|[ \t]+(?=[^\s{}\[\],:#]))*"""))
_FLOW_TABLE = re.compile(_FLOW_PARTS % ("=", r"""[^\s{}\[\],="'#]+"""))
_BARE_ISSUED = re.compile(rf"(?<![\w\-])(?:{_ISSUED.pattern})(?![\w\-])")
_OPENED = re.compile(r"[{\[]")
_TYPED = re.compile(r"[&'\w<>\[\]| .:=()?!\t]*")
_SECTION = re.compile(r"(?m)^[ \t]*\[+([^\]\n]+)\]+")
_PROSE = re.compile(r"(?m)^[ \t]*(?://+|#+|--|;+|\*+|<!--|/\*+|\"\"\"|''')[^\n]*")
_COMMENT_PAIR = re.compile(r"(?::|=|\bis\b)\s*(\S{6,})")
_TOKEN = re.compile(r"[^\s\"'`<>()\[\]{},;|]{6,}")
_BARE_PAIR = re.compile(r"(?im)^[ \t]*(?:export[ \t]+)?(?P<k>[\w.\-]*(?:pass|pwd|secret|token|key|cred|auth)[\w.\-]*)[ \t]*[:=][ \t]*(?P<v>[^\s\"'`(){}<>;,]{8,})[ \t\r]*$")
_USE_AS = re.compile(r"(?i)\b(?:use|set|enter|with|is|log ?in with)\s+`?(?P<v>[^\s`]{6,})`?\s+(?:as|for)\s+(?:the\s+|a\s+|an\s+)?(?P<n>[\w \-]{2,})")

CONFIG = {"env", "ini", "yml", "yaml", "toml", "cfg", "conf", "properties", "json"}
PROSE = {"md", "txt", "rst"}


def extension(path: str | None) -> str:
    base = (path or "").rsplit("/", 1)[-1].lower()
    if base == ".env" or base.startswith(".env."):
        return "env"
    return base.rsplit(".", 1)[-1] if "." in base else ""


def _flow_entries(text: str, at: int, path: tuple[str, ...], equals: bool = False) -> Generator[Entry, None, int]:
    """Scalars of the JSON value, flow mapping or inline table that opens at ``at``, with keys and places in lists as path; returns its end."""
    stack: list[list] = []  # of [is mapping, key or None, items so far]
    last: tuple[str, int, int] | None = None

    def inner() -> tuple[str, ...]:
        return (*path, *[("" if f[1] is None else f[1]) if f[0] else str(f[2]) for f in stack])

    for m in (_FLOW_TABLE if equals else _FLOW).finditer(text, at):
        if m["open"]:
            stack.append([m["open"] == "{", None, 0])
            last = None
        elif m["sep"]:
            if stack and stack[-1][0] and last and stack[-1][1] is None:
                stack[-1][1], last = last[0], None
        elif m["mark"]:
            if last:
                yield Entry(inner(), last[0], ((last[1], last[2]),), "config")
                last = None
            if m["mark"] == ",":
                stack[-1][1], stack[-1][2] = None, stack[-1][2] + 1
            else:
                stack.pop()
            if not stack:
                return m.end()
        elif m["q"]:
            v = m["s"]
            if "\\" in v and m["q"] == '"':
                try:
                    v = json.loads(f'"{v}"')
                except ValueError:
                    pass
            last = (v, *m.span("s"))
        elif m["plain"]:
            last = (m["plain"].rstrip(), m.start("plain"), m.start("plain") + len(m["plain"].rstrip()))
    return len(text)


def _lines_entries(lines: list[tuple[int, str]], path: tuple[str, ...], joined: bool = False) -> Iterator[Entry]:
    """A value over several lines: joined or wrapped letters as one, else each line that is one word."""
    words = [(at + len(x) - len(x.lstrip()), x.strip()) for at, x in lines if x.strip()]
    if len(words) > 1 and joined and all(" " not in w for _, w in words) or len(words) > 1 and len(words[0][1]) >= 16 and all(" " not in w and len(w) == len(words[0][1]) for _, w in words[:-1]) and " " not in words[-1][1] and len(words[-1][1]) <= len(words[0][1]):
        yield Entry(path, "".join(w for _, w in words), tuple((at, at + len(w)) for at, w in words), "config")
    else:
        for at, w in words:
            if " " not in w:
                yield Entry(path, w, ((at, at + len(w)),), "config")


def _block(text: str, at: int, depth: int) -> Iterator[tuple[int, str]]:
    """Offset and text of the lines from ``at`` on that are blank or further in than ``depth``."""
    while 0 < at < len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        if line.strip() and len(line) - len(line.lstrip()) <= depth:
            return
        yield at, line
        at = end + 1


def _continued(text: str, at: int) -> list[tuple[int, str]]:
    """Offset and text of the lines from ``at`` on that a backslash at each one's end joins."""
    lines = []
    while at < len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)].rstrip()
        lines.append((at, line.removesuffix("\\")))
        if not line.endswith("\\") or end < 0:
            break
        at = end + 1
    return lines


def _config_entries(text: str, kind: str) -> Iterator[Entry]:
    """Scalars of line-oriented formats, with their sections or parents as key path."""
    yaml = kind in ("yml", "yaml")
    sections = [(m.start(), tuple(m[1].replace('"', "").split("."))) for m in _SECTION.finditer(text)] if kind in ("ini", "toml", "cfg", "conf", "properties") else []
    starts = [s for s, _ in sections]
    parents: list[tuple[int, str]] = []
    flow = 0
    for m in (_YAML_LINE if yaml else _CONFIG_LINE).finditer(text):
        key = (m["k"] or "").strip("\"'")
        depth = len(m["indent"])
        if yaml:
            while parents and parents[-1][0] >= depth + (not m["k"]):
                parents.pop()
            path = (*[p for _, p in parents], key or "0")
            if m["k"]:
                parents.append((depth, key))
        else:
            at = bisect_right(starts, m.start()) - 1
            path = (*(sections[at][1] if at >= 0 else ()), key)
        value, start = m["v"].rstrip(), m.start("v")
        if yaml and (mark := _YAML_MARK.match(value)):
            value, start = value[mark.end() :], start + mark.end()
        if yaml and _BLOCK_HEAD.fullmatch(value):
            yield from _lines_entries(list(_block(text, text.find("\n", start) + 1, depth)), path)
            continue
        if kind == "toml" and value[:3] in ('"""', "'''"):
            end = text.find(value[:3], start + 3)
            lines, at = [], start + 3
            for line in text[at : end if end >= 0 else at].split("\n"):
                lines.append((at, line[:-1] if line.endswith("\\") else line))
                at += len(line) + 1
            yield from _lines_entries(lines, path)
            continue
        if (yaml or kind == "toml") and value[:1] in ("{", "["):
            if start >= flow:
                flow = yield from _flow_entries(text, start, path, kind == "toml")
            continue
        if value[:1] in ("'", '"'):
            end = value.find(value[0], 1)
            if end < 0:
                stop, lines, at = text.find(value[0], start + 1), [], start + 1
                for line in text[at : stop if yaml and stop >= 0 else at].split("\n"):
                    lines.append((at, line.removesuffix("\\")))
                    at += len(line) + 1
                yield from _lines_entries(lines, path, joined=value.endswith("\\"))
                continue
            value, start = value[1:end], start + 1
        else:
            if value.endswith("\\") and not yaml and kind != "toml":
                yield from _lines_entries(_continued(text, start), path, joined=True)
                continue
            value = re.split(r"\s+[#;]", value, maxsplit=1)[0].rstrip().rstrip(",")
            if value[:1] in ("|", ">", "&", "[", "{"):
                continue
        if value and (" " not in value or "phrase" in key.lower()):
            yield Entry(path, value, ((start, start + len(value)),), "config")


def _string_entries(text: str) -> Iterator[Entry]:
    """String literals, adjoining ones as one value, with the name or call they belong to."""
    done = -1
    for m in _STRING.finditer(text):
        if m.start() < done:
            continue
        after = m.end()
        value, pieces = m["v"], [m.span("v")]
        line = text.rfind("\n", 0, m.start()) + 1
        before = text[max(line, m.start() - 160) : m.start()]
        # a name or opening bracket may stand on the line before
        if not before.strip():
            up = text.rfind("\n", 0, max(0, line - 1)) + 1
            before = text[max(up, line - 160) : m.start()]
        last = before.rstrip()[-1:]
        if last in ("=", ":", ">") and m.start() - 160 > line and _TYPED.fullmatch(before):
            before = text[line : m.start()]  # a type or blanks longer than the window
        name = _NAME_BEFORE.search(before) if last in _NAMING else None
        call = None if name or last not in ("(", ",") else _CALL_BEFORE.search(before)
        if name:
            opened = before.rstrip().endswith("(")
            while True:
                more = _JOIN.match(text, after)
                glue = text[after : more.start("q")] if more else ""
                if not more or ("+" not in glue and "\\" not in glue and not (opened and ("," in glue and "concat!" in before or "," not in glue))):
                    break
                value += more["v"]
                pieces.append(more.span("v"))
                after = more.end()
            done = after
            yield Entry((name["quoted"] or name["bare"].rsplit(".", 1)[-1],), value, tuple(pieces), "code")
        elif call and _AUTH_CALL.search(call["call"]):
            yield Entry((call["arg"] or call["call"],), value, tuple(pieces), "call")
        elif len(value) >= 12:
            yield Entry((), value, tuple(pieces), "code")


def _prose_entries(text: str, start: int) -> Iterator[Entry]:
    """``words: value`` and ``use value as words`` in one line of prose, and bare tokens by their shape."""
    done = 0
    for m in _COMMENT_PAIR.finditer(text):
        at = m.start()
        while at > done and (text[at - 1].isalnum() or text[at - 1] in "_ .-\t"):
            at -= 1
        words = text[at : m.start()].lstrip("0123456789_ .-\t").split()
        value = m[1].rstrip(".,;`\"')")
        if words:
            done = m.end()
            if value:
                s = start + m.start(1)
                yield Entry((" ".join(words[-3:]),), value, ((s, s + len(value)),), "prose")
    for m in _USE_AS.finditer(text):
        s = start + m.start("v")
        if _SENSITIVE_TEXT.search(m["n"]):
            yield Entry(("password",), m["v"], ((s, s + len(m["v"])),), "prose")
    for m in _TOKEN.finditer(text):
        value = m[0].rstrip(".:")
        cut = value.find("=")
        if 0 < cut < len(value) - 6 and value[:cut].replace("_", "").replace("-", "").isalnum():
            s = start + m.start() + cut + 1
            yield Entry((value[:cut],), value[cut + 1 :], ((s, s + len(value) - cut - 1),), "prose")
        elif _ISSUED.fullmatch(value):
            yield Entry((), value, ((start + m.start(), start + m.start() + len(value)),), "prose")


_HEADER = re.compile(r"(?i)[\"'`](?:x-[\w-]*(?:auth|key|token|secret)[\w-]*|authorization|api-?key)\s*:\s*(?:(?:bearer|token|basic)\s+)?([^\s\"'`]{6,})[\"'`]")


def find(text: str, kind: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """Credentials of a text as ``(offset at which it begins, spans to blank)``, by offset."""
    found: dict[int, list[tuple[int, int]]] = {}
    keys: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            end = _PEM_END.search(text, m.end())
            stop = end.start() if end else _key_body_end(text, m.end())
            body = text[m.end() : stop]
            if len(re.findall(r"[A-Za-z0-9+/]", body)) >= 40 and not placeholder(body.strip()[:12] or "xxxx"):
                # everything but line structure, indentation and what encloses each line
                found[m.start()] = [(m.end() + x.start(), m.end() + x.end()) for x in re.finditer(r"(?<!\\)[A-Za-z0-9+/=]{3,}", body)]
                keys.append((m.start(), stop))
    lower = text.lower()
    if "://" in text:
        for m in _URL_PASSWORD.finditer(text):
            if text[m.start() - 1 : m.start()].isalnum() and not placeholder(m[1]) and not re.fullmatch(r"(?i)pass(?:word|wd)?|pwd|secret|token|user|\d{1,5}", m[1]) and not re.search(r"\$\{|\{|<|%s", m[1]):
                found[m.start(1)] = [m.span(1)]
    if ";" in text and any(w in lower for w in ("pwd", "password", "accountkey", "sharedaccesskey")):
        for m in _PAIR_PASSWORD.finditer(text):
            if (unmistakable(m[1]) or password_like(m[1])) and text.rfind(";", text.rfind("\n", 0, m.start()) + 1, m.start()) >= 0:
                found[m.start(1)] = [m.span(1)]
    for pattern, words in ((_SCHEME, ("bearer", "token", "basic", "apikey")), (_HEADER, ("x-", "authorization", "apikey", "api-key"))):
        for m in pattern.finditer(text) if any(w in lower for w in words) else ():
            v = m[1].rstrip(".")
            if text[m.start() - 1 : m.start()] in ('"', "'", "`", " ", ":", "") and not placeholder(v) and (unmistakable(v) or _random(v) or _HEX.fullmatch(v) or pattern is _HEADER and password_like(v) or text[m.start() - 1 : m.start()] in ('"', "'", "`") and text[m.end() : m.end() + 1] in ('"', "'", "`") and password_like(v)):
                found[m.start(1)] = [(m.start(1), m.start(1) + len(v))]

    def entries() -> Iterator[Entry]:
        if kind in PROSE:
            at = 0
            for line in text.split("\n"):
                yield from _prose_entries(line, at)
                at += len(line) + 1
            yield from _string_entries(text)
        else:
            if kind in CONFIG and kind != "json":
                yield from _config_entries(text, kind)
            else:
                for m in _BARE_PAIR.finditer(text) if any(w in lower for w in ("pass", "pwd", "secret", "token", "key", "cred", "auth")) else ():
                    yield Entry((m["k"],), m["v"], (m.span("v"),), "config")
                at = 0
                while kind == "json" and (opened := _OPENED.search(text, at)):
                    at = max(opened.end(), (yield from _flow_entries(text, opened.start(), ())))
            if kind in CONFIG:
                for m in _BARE_ISSUED.finditer(text):
                    yield Entry((), m[0], (m.span(),), "config")
            yield from _string_entries(text)
            if "\\" in text:
                for m in _ESCAPED.finditer(text):
                    before = text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 160) : m.start()]
                    if before.rstrip()[-1:] in _NAMING and (name := _NAME_BEFORE.search(before)):
                        yield Entry((name["quoted"] or name["bare"].rsplit(".", 1)[-1],), m["v"], (m.span("v"),), "code")
            if "phrase" in lower:
                for m in _QUOTED_PHRASE.finditer(text):
                    yield Entry((m["k"],), m["v"], (m.span("v"),), "code")
            if "</" in text or "/>" in text:
                for pattern in (_ELEMENT, _NAMED_VALUE, _PROPERTY):
                    for m in pattern.finditer(text):
                        yield Entry((m["k"],), m["v"], (m.span("v"),), "config")
            for m in _PROSE.finditer(text):
                yield from _prose_entries(m[0], m.start())

    for e in entries():
        start = e.pieces[0][0]
        if start in found or "-----BEGIN" in e.value or any(a <= start < b for a, b in keys):
            continue
        if "://" in e.value and _URL_PASSWORD.search(e.value):
            continue
        if e.context == "prose" and e.path:
            name = e.path[-1]
            said = 1 if _SENSITIVE_TEXT.search(name) and judge_name(name) >= 0 else judge_name(name)
            if not (unmistakable(e.value) and said >= 0 or said > 0 and password_like(e.value) and re.search(r"\d|[!@#$%^&*+=]", e.value) and "://" not in e.value):
                continue
            if not unmistakable(e.value) and "/" in e.value and not _random(e.value) and not _basic(e.value):
                continue
        elif not is_credential(e):
            continue
        found[start] = list(e.pieces)
    return sorted(found.items())


def redact(text: str, kind: str, mask: str = "X") -> str:
    """The text with each credential's letters replaced by as many masks; nothing else changes."""
    spans = sorted(s for _, spans in find(text, kind) for s in spans)
    out, at = [], 0
    for start, end in spans:
        if end <= at:
            continue
        start = max(start, at)
        out += [text[at:start], mask * (end - start)]
        at = end
    return "".join([*out, text[at:]])


def _lines(text: str, found: list) -> set[int]:
    return {text.count("\n", 0, start) + 1 for start, _ in found}


def credential_lines(records: DataFrame, id_column: str, path_column: str, sides: dict[str, str]) -> DataFrame:
    """``<id>, side, line_no``: distinct lines, from 1, in which a credential begins; ``sides`` maps names to text columns.

    Null and empty texts have none, a null path is read as program text, a null id is kept as it is,
    repeated deliveries of an id count once, texts are searched whole however long.
    """
    names = list(sides)
    df = records.select(F.col(id_column).alias("_id"), F.col(path_column).alias("_path"), *[F.col(sides[n]).alias(f"_t{i}") for i, n in enumerate(names)])
    id_type = records.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, where, lines = [], [], []
            for side in range(len(names)):
                for part in slices(batch, 2 + side):
                    for i, path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2 + side).to_pylist()):
                        if text:
                            for n in _lines(text, find(text, extension(path))):
                                ids.append(i)
                                where.append(names[side])
                                lines.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(where, pa.string()), pa.array(lines, pa.int64())], names=["_id", "side", "line_no"])

    found = df.mapInArrow(run, f"_id {id_type}, side string, line_no long")
    return found.select(F.col("_id").alias(id_column), "side", "line_no").distinct()


def redacted(records: DataFrame, id_column: str, path_column: str, text_columns: list[str]) -> DataFrame:
    """``<id>, <texts>``: each row with its credentials blanked; null texts stay null, rows stay as many as they were."""
    df = records.select(F.col(id_column), F.col(path_column).alias("_path"), *text_columns)
    types = [f"`{id_column}` {records.schema[id_column].dataType.simpleString()}", *[f"`{c}` string" for c in text_columns]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                kinds = [extension(p) for p in part.column(1).to_pylist()]
                done = [pa.array([redact(t, k) if t else t for t, k in zip(part.column(2 + i).to_pylist(), kinds)], pa.string()) for i in range(len(text_columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), *done], names=[id_column, *text_columns])

    return df.mapInArrow(run, ", ".join(types))
