"""JSON (RFC 8259) and TOML 1.0."""

from __future__ import annotations

import re

JSON_GRAMMAR = r"""
value : 'true' | 'false' | 'null' | NUM | STR | object | array ;
object : '{' '}' | '{' members '}' ;
members : STR ':' value | members ',' STR ':' value ;
array : '[' ']' | '[' values ']' ;
values : value | values ',' value ;
"""
_JSON = re.compile(r'[ \t\n\r]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[{}\[\]:,]|(?:true|false|null)(?!\w)', re.ASCII)

TOML_GRAMMAR = r"""
doc : line | doc NL line ;
line : | key '=' value | '[' key ']' | '[[' key ']]' ;
key : KEY | key '.' KEY ;
value : VALUE | '{' '}' | '{' pairs '}' | '[' nls ']' | '[' nls values nls ']' | '[' nls values nls ',' nls ']' ;
pairs : key '=' value | pairs ',' key '=' value ;
values : value | values nls ',' nls value ;
nls : | nls NL ;
"""
_ESC = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_BAD = r"\x00-\x08\x0a-\x1f\x7f"
_BAD_ML = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
_T_STRING = rf'"""(?:(?!""")(?:[^\\{_BAD_ML}]|{_ESC}|\\[ \t]*\r?\n))*"{{3,5}}|\'\'\'(?:(?!\'\'\')[^{_BAD_ML}])*\'{{3,5}}|"(?:[^"\\{_BAD}]|{_ESC})*"|\'[^\'{_BAD}]*\''
_T_COMMON = rf"[ \t]+|#[^\n{_BAD}]*(?:\r(?=\n))?"
_T_KEY = re.compile(rf"(?P<skip>{_T_COMMON})|(?P<nl>\r?\n)|(?P<p>\[\[|\]\]|[\[\]{{}}=.,])|(?P<key>[A-Za-z0-9_-]+|\"(?:[^\"\\{_BAD}]|{_ESC})*\"|'[^'{_BAD}]*')")
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_INT = r"(?:0|[1-9](?:_?\d)*)"
_T_VALUE = re.compile(
    rf"(?P<skip>{_T_COMMON})|(?P<nl>\r?\n)|(?P<value>{_T_STRING}|(?:true|false)(?![\w-])|{_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-]\d\d:\d\d)?)?(?![\w:.-])|{_TIME}(?![\w:.-])"
    rf"|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*(?!\w)|0o[0-7](?:_?[0-7])*(?!\w)|0b[01](?:_?[01])*(?!\w)|[+-]?(?:inf|nan)(?!\w)"
    rf"|[+-]?{_INT}(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?(?![\w.:-]))|(?P<p>[\[\]{{}},=])"
)


def json_tokens(text: str, number: dict[str, int]) -> tuple[list[int], list[int], None] | int:
    """Terminals with their offsets, or the offset of a character that begins no token."""
    out, at, pos = [], [], 0
    fixed = {k: number[f"'{k}'"] for k in ("{", "}", "[", "]", ":", ",", "true", "false", "null")}
    s, n, blank = number["STR"], number["NUM"], " \t\n\r"
    for token in _JSON.findall(text):
        if not text.startswith(token, pos):
            return pos
        c = token[0]
        if c not in blank:
            out.append(s if c == '"' else fixed.get(token, n))
            at.append(pos)
        pos += len(token)
    if pos < len(text):
        return pos
    return [*out, 0], [*at, pos], None


def toml_tokens(text: str, number: dict[str, int]) -> tuple[list[int], list[int], None] | int:
    out, at, pos, nest, value = [], [], 0, [], False
    while pos < len(text):
        m = (_T_VALUE if value else _T_KEY).match(text, pos)
        if not m:
            return pos
        kind = m.lastgroup
        if kind == "key":
            out.append(number["KEY"])
        elif kind == "value":
            out.append(number["VALUE"])
        elif kind == "nl":
            if nest and nest[-1] == "{":
                return pos
            out.append(number["NL"])
            if not nest:
                value = False
        elif kind == "p":
            p = m[0]
            if value:
                if p in "[{":
                    nest.append(p)
                    value = p == "["
                elif p in "]}":
                    if not nest:
                        return pos
                    nest.pop()
                elif p == "," and nest and nest[-1] == "{":
                    value = False
            elif p == "=":
                value = True
            elif p == "}" and nest:
                nest.pop()
                value = True
            if f"'{p}'" not in number:
                return pos
            out.append(number[f"'{p}'"])
        if kind != "skip":
            at.append(pos)
        pos = m.end()
    return [*out, 0], [*at, pos], None
