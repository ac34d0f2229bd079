"""Python 3.13.

The grammar accepts a little more than the language (any expression as target of an assignment, arguments in
any order). Replacement fields of formatted strings are skipped over, not parsed.
"""

from __future__ import annotations

import re

# Reserved words and words that are reserved only in some places.
RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "match case type _".split()
PUNCTUATION = "( ) [ ] { } , : ; . ... = -> := + - * / // % @ ** << >> & | ^ ~ < > <= >= == !=".split()
ASSIGNING = "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()

GRAMMAR = r"""
%left LOW
%left 'or'
%left 'and'
%right 'not'
%left 'in' 'is' NOTIN '<' '>' '<=' '>=' '==' '!='
%left '|'
%left '^'
%left '&'
%left '<<' '>>'
%left '+' '-'
%left '*' '/' '//' '%' '@'
%right UNARY
%right '**'
%right 'await'
%left '.' '(' '['

file : NL* stmt* ;
stmt : simple | compound ;
simple : smalls ';'? NL ;
smalls : small | smalls ';' small ;
small : chain | chainset | sl AUG chain | e ':' e | e ':' e '=' chain | 'return' sl? | 'raise' | 'raise' e | 'raise' e 'from' e | 'global' ids | 'nonlocal' ids | 'del' sl
 | 'pass' | 'break' | 'continue' | 'assert' e | 'assert' e ',' e | 'import' dottedas | 'from' source 'import' names | 'type' id tparams? '=' e ;
chain : sl | yieldx ;
chainset : sl '=' chain | chainset '=' chain ;
yieldx : 'yield' sl? | 'yield' 'from' e ;
sl : slist ','? ;
slist : sitem | slist ',' sitem ;
sitem : e | '*' d %prec LOW ;
ids : id | ids ',' id ;
dotted : id | dotted '.' id ;
dottedas : das | dottedas ',' das ;
das : dotted | dotted 'as' id ;
source : dotted | dots | dots dotted ;
dots : '.' | '...' | dots '.' | dots '...' ;
names : '*' | nas | '(' nas ','? ')' ;
nas : na | nas ',' na ;
na : id | id 'as' id ;
suite : simple | NL INDENT stmt+ DEDENT ;
compound : 'if' ne ':' suite elifs else? | 'while' ne ':' suite else? | 'async'? 'for' tgs 'in' sl ':' suite else? | 'async'? 'with' withs ':' suite
 | 'try' ':' suite excepts else? finally? | 'try' ':' suite finally | decorator* 'async'? 'def' id tparams? '(' params ')' returns? ':' suite | decorator* 'class' id tparams? ':' suite | decorator* 'class' id tparams? '(' args ')' ':' suite
 | 'match' sl ':' NL INDENT cases DEDENT ;
elifs : | elifs 'elif' ne ':' suite ;
else : 'else' ':' suite ;
finally : 'finally' ':' suite ;
excepts : except+ ;
except : 'except' ':' suite | 'except' '*'? e ':' suite | 'except' '*'? e 'as' id ':' suite ;
withs : witem | withs ',' witem | '(' pwiths ','? ')' ;
pwiths : pwith | pwiths ',' pwith ;
pwith : e | e 'as' tg ;
witem : e | e 'as' tg ;
decorator : '@' ne NL ;
returns : '->' e ;
tparams : '[' tplist ','? ']' ;
tplist : tp | tplist ',' tp ;
tp : '*' id tdefault? | '**' id tdefault? | id tdefault? | id ':' e tdefault? ;
tdefault : '=' e ;
params : ( plist ','? )? ;
plist : param | plist ',' param ;
param : id | id ':' e | id '=' e | id ':' e '=' e | '/' | '*' | '*' id | '*' id ':' e | '*' id ':' '*' e | '**' id | '**' id ':' e ;
lparams : ( lplist ','? )? ;
lplist : lparam | lplist ',' lparam ;
lparam : id | id '=' e | '/' | '*' | '*' id | '**' id ;
tgs : tgl ','? ;
tgl : tg | tgl ',' tg ;
tg : id | tg '.' id | tg '[' slices ']' | tg '(' args ')' | '(' ')' | '[' ']' | '(' tgs ')' | '[' tgs ']' | '*' tg ;
ne : e | id ':=' e ;
e : d %prec LOW | d 'if' d 'else' e | 'lambda' lparams ':' e ;
d : d 'or' d | d 'and' d | 'not' d | d 'in' d | d NOTIN d | d 'is' d | d '<' d | d '>' d | d '<=' d | d '>=' d | d '==' d | d '!=' d
 | d '|' d | d '^' d | d '&' d | d '<<' d | d '>>' d | d '+' d | d '-' d | d '*' d | d '/' d | d '//' d | d '%' d | d '@' d
 | '+' d %prec UNARY | '-' d %prec UNARY | '~' d %prec UNARY | d '**' d | 'await' d
 | id | NUM | str | '...' | 'None' | 'True' | 'False' | d '.' id | d '(' args ')' | d '[' slices ']'
 | '(' ')' | '(' yieldx ')' | '(' nel ')' | '(' nel ',' ')' | '(' ne comp ')' | '[' ']' | '[' nel ','? ']' | '[' ne comp ']' | '{' '}' | '{' nel ','? '}' | '{' ne comp '}' | '{' ditems ','? '}' | '{' e ':' e comp '}' ;
str : STR | str STR ;
nel : neitem | nel ',' neitem ;
neitem : ne | '*' d %prec LOW ;
ditems : ditem | ditems ',' ditem ;
ditem : e ':' e | '**' d %prec LOW ;
comp : compfor | comp compfor | comp 'if' cond ;
compfor : 'async'? 'for' tgs 'in' d %prec LOW ;
cond : d %prec LOW | id ':=' d | 'lambda' lparams ':' cond ;
args : ( arglist ','? )? ;
arglist : arg | arglist ',' arg ;
arg : ne | ne comp | id '=' e | '*' e | '**' e ;
slices : slice | slicel ',' | slicel ',' slice ;
slicel : slice | slicel ',' slice ;
slice : ne | e? ':' e? | e? ':' e? ':' e? | '*' d %prec LOW ;
cases : case+ ;
case : 'case' pats guard? ':' suite ;
guard : 'if' ne ;
pats : pat | patl ',' | patl ',' pat ;
patl : pat | patl ',' pat ;
pat : orpat | orpat 'as' id | '*' id ;
orpat : cpat | orpat '|' cpat ;
cpat : NUM | '-' NUM | NUM '+' NUM | NUM '-' NUM | '-' NUM '+' NUM | '-' NUM '-' NUM | str | 'None' | 'True' | 'False' | dotted | '(' ')' | '(' pats ')' | '[' ']' | '[' pats ']' | '{' '}' | '{' mpats ','? '}' | dotted '(' ')' | dotted '(' kpats ','? ')' ;
mpats : mpat | mpats ',' mpat ;
mpat : cpat ':' pat | '**' id ;
kpats : kpat | kpats ',' kpat ;
kpat : pat | id '=' pat ;
id : ID | 'match' | 'case' | 'type' | '_' ;
"""

_PUNCT = "|".join(re.escape(p) for p in sorted(PUNCTUATION + ASSIGNING, key=len, reverse=True))
_STRING = r"(?:[rRuUbBfF]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"
_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d_.eEjJ])|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?!\w)"
_TOKEN = re.compile(rf"(?:[ \t\f]+|\\\r?\n|#[^\r\n]*)+|\r?\n|\r|{_STRING}|not[ \t]+in\b|[^\W\d]\w*|{_NUMBER}|{_PUNCT}")
_INDENT = re.compile(r"[ \t\f]*")

_FORMATTED = re.compile(r"(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|\"|')")
_ANY_STRING = re.compile(_STRING)


def formatted_end(text: str, pos: int, quote: str) -> int:
    """Where the formatted string with its letters from ``pos`` on ends; -1 if it does not."""
    fields: list[list] = []  # of each open replacement field: bracket depth, whether its format has begun
    size = len(text)
    while pos < size:
        c = text[pos]
        literal = not fields or fields[-1][1]
        if literal:
            if text.startswith(quote, pos):
                return -1 if fields else pos + len(quote)
            if c == "\\":
                pos += 2
            elif c == "{":
                if not fields and text.startswith("{{", pos):
                    pos += 2
                else:
                    fields.append([0, False])
                    pos += 1
            elif c == "}" and fields:
                fields.pop()
                pos += 1
            elif c == "\n" and len(quote) == 1:
                return -1
            else:
                pos += 1
            continue
        nested = _FORMATTED.match(text, pos) if c in "fFrR" and not (text[pos - 1].isalnum() or text[pos - 1] == "_") else None
        plain = _ANY_STRING.match(text, pos) if not nested and c in "\"'rRbBuU" else None
        if nested:
            pos = formatted_end(text, nested.end(), nested[1])
            if pos < 0:
                return -1
        elif plain:
            pos = plain.end()
        elif c in "([{":
            fields[-1][0] += 1
            pos += 1
        elif c in ")]}":
            if fields[-1][0] == 0:
                if c != "}":
                    return -1
                fields.pop()
            else:
                fields[-1][0] -= 1
            pos += 1
        elif c == ":" and fields[-1][0] == 0:
            fields[-1][1] = True
            pos += 1
        elif c in "\"'":
            return -1
        else:
            pos += 1
    return -1


class Lexer:
    def __init__(self, number: dict[str, int]):
        self.number = number
        self.fixed = {w: number[f"'{w}'"] for w in RESERVED + SOFT + PUNCTUATION if f"'{w}'" in number}
        self.fixed |= {a: number["AUG"] for a in ASSIGNING}

    def tokens(self, text: str) -> tuple[list[int], list[int], None] | int:
        fixed, number = self.fixed, self.number
        ident, num, string, nl = number["ID"], number["NUM"], number["STR"], number["NL"]
        indent, dedent = number["INDENT"], number["DEDENT"]
        out: list[int] = []
        at: list[int] = []
        levels, depth, pos, size, fresh, match = [0], 0, 0, len(text), True, _TOKEN.match
        if text.startswith("\ufeff"):
            pos = 1
        while pos < size:
            if fresh:
                m = _INDENT.match(text, pos)
                end = m.end()
                nxt = text[end : end + 1]
                if nxt not in ("", "#", "\n", "\r", "\\"):
                    width = len(m[0].rpartition("\f")[2].expandtabs(8))
                    if width > levels[-1]:
                        levels.append(width)
                        out.append(indent)
                        at.append(end)
                    while width < levels[-1]:
                        levels.pop()
                        out.append(dedent)
                        at.append(end)
                    if width != levels[-1]:
                        return end
                fresh = False
                pos = end
                continue
            m = match(text, pos)
            begun = _FORMATTED.match(text, pos) if text[pos] in "fFrR" else None
            if begun:
                end = formatted_end(text, begun.end(), begun[1])
                if end < 0:
                    return pos
                out.append(string)
                at.append(pos)
                pos = end
                continue
            if m is None:
                return pos
            token, end = m[0], m.end()
            kind = fixed.get(token)
            if kind is None:
                c = token[0]
                if c in " \t\f#\\":
                    pos = end
                    continue
                if c in "\r\n":
                    if not depth:
                        fresh = True
                        if out and out[-1] != nl and out[-1] != dedent and out[-1] != indent:
                            out.append(nl)
                            at.append(pos)
                    pos = end
                    continue
                if token[-1] in "\"'":
                    kind = string
                elif c.isdigit() or c == ".":
                    kind = num
                elif c == "n" and token[:4] in ("not ", "not\t"):
                    kind = number["NOTIN"]
                else:
                    kind = ident
            elif token in "([{":
                depth += 1
            elif token in ")]}":
                depth = max(0, depth - 1)
            out.append(kind)
            at.append(pos)
            pos = end
        if out and out[-1] != nl and out[-1] != dedent:
            out.append(nl)
            at.append(pos)
        for _ in levels[1:]:
            out.append(dedent)
            at.append(pos)
        return [*out, 0], [*at, pos], None
