"""JavaScript and TypeScript as ES modules.

The grammar accepts a little more than the standards where later rules would narrow it (targets of
assignments, places of ``await``); what it rejects is not a module. Statement ends are inserted by the
parser where a line ends and nothing else fits.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Reserved words, and words that are reserved only in some places.
RESERVED = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum yield await".split()
CONTEXTUAL = "async of get set static from as let accessor target meta".split()
TYPED = "type interface namespace module declare abstract public private protected readonly override keyof infer is asserts satisfies unique implements out never".split()
PUNCTUATION = "{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- & | ^ ! ~ && || ?? ? : = . ... => ?. @ #".split()
ASSIGNING = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()

_BASE = r"""
%nonassoc LOWEST
%left ARROW
%right '=' OPASSIGN '=>' 'yield'
%right '?' ':'
%left '??'
%left '||'
%left '&&'
%left '|'
%left '^'
%left '&'
%left '==' '!=' '===' '!=='
%left '<' '>' '<=' '>=' 'in' 'instanceof' 'as' 'satisfies'
%left '<<' SHIFT
%left '+' '-'
%left '*' '/' '%'
%right '**'
%right UNARY 'new'
%left '++' '--'
%left '(' '[' '.' '?.' TFULL THEAD '!'
%nonassoc IF
%nonassoc 'else'
%bar obj fnexpr classexpr when stmt fnbody

program : items ;
items : item* ;
item : stmt | import | export ;
stmts : stmt* ;
stmt : block | vardecl ';' | ';' | exprs ';' | 'debugger' ';'
 | 'if' '(' exprs ')' stmt %prec IF | 'if' '(' exprs ')' stmt 'else' stmt
 | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'do' stmt 'while' '(' exprs ')'
 | 'for' 'await'? '(' forhead ')' stmt
 | 'continue' ';' | 'continue' ident ';' | 'break' ';' | 'break' ident ';' | 'return' ';' | 'return' exprs ';' | 'throw' exprs ';'
 | 'switch' '(' exprs ')' '{' case* '}'
 | ident ':' stmt
 | 'try' block 'catch' catcharg? block | 'try' block 'finally' block | 'try' block 'catch' catcharg? block 'finally' block
 | fndecl | classdecl ;
block : '{' stmts '}' ;
catcharg : '(' bindtyped ')' ;
case : 'case' exprs ':' stmts | 'default' ':' stmts ;
forhead : forinit? ';' exprs? ';' exprs? | declword bindtyped 'of' e | declword bindtyped 'in' exprs | e 'of' e | exprs ;
forinit : vardecl | exprs ;
declword : 'var' | 'let' | 'const' ;
vardecl : declword declarator | vardecl ',' declarator ;
declarator : bindtyped | bindtyped '=' e ;
ident : ID | ctx ;
binding : ident | '{' '}' | '{' bindprops ','? '}' | '[' bindelems ']' ;
bindprops : bindprop | bindprops ',' bindprop ;
bindprop : ident | ident '=' e | pname ':' binding | pname ':' binding '=' e | '...' ident ;
bindelems : bindelem? | bindelems ',' bindelem? ;
bindelem : binding | binding '=' e | '...' binding ;
params : '(' ')' | '(' paramlist ','? ')' ;
paramlist : param | paramlist ',' param ;
fndecl : 'async'? 'function' '*'? ident signature fnbody ;
fnexpr : 'async'? 'function' '*'? ident? signature fnbody ;
fnbody : '{' stmts '}' ;
exprs : e | exprs ',' e ;
e : ident | NUM | STR | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | obj | fnexpr | classexpr | template
 | '(' exprs ')' | '[' elements ']'
 | e '.' name | e '.' PRIVATE | e '?.' name | e '?.' PRIVATE | e '?.' '[' exprs ']' | e '?.' args | e '[' exprs ']' | e args | e template
 | 'new' e | 'new' '.' 'target' | 'import' args | 'import' '.' 'meta'
 | e '++' | e '--' | '++' e %prec UNARY | '--' e %prec UNARY
 | '+' e %prec UNARY | '-' e %prec UNARY | '!' e %prec UNARY | '~' e %prec UNARY | 'typeof' e %prec UNARY | 'void' e %prec UNARY | 'delete' e %prec UNARY | 'await' e %prec UNARY
 | e '+' e | e '-' e | e '*' e | e '/' e | e '%' e | e '**' e | e '&' e | e '|' e | e '^' e | e '&&' e | e '||' e | e '??' e
 | e '==' e | e '!=' e | e '===' e | e '!==' e | e '<' e | e '>' e | e '<=' e | e '>=' e | e 'in' e | e 'instanceof' e
 | e '<<' e | e '>' '>' e %prec SHIFT | e '>' '>' '>' e %prec SHIFT
 | e '?' e ':' e | e '=' e | e OPASSIGN e | e '>' '>=' e %prec OPASSIGN | e '>' '>' '>=' e %prec OPASSIGN
 | 'yield' | 'yield' e | 'yield' '*' e
 | ident '=>' abody | arrowhead '=>' abody | 'async' ident '=>' abody | 'async' arrowhead '=>' abody ;
abody : fnbody %prec ARROW | e %prec ARROW ;
args : '(' ')' | '(' arglist ','? ')' ;
arglist : arg | arglist ',' arg ;
arg : e | '...' e ;
elements : element? | elements ',' element? ;
element : e | '...' e ;
template : TFULL | THEAD exprs tmids TTAIL ;
tmids : | tmids TMID exprs ;
obj : '{' '}' | '{' props ','? '}' ;
props : prop | props ',' prop ;
prop : ident | ident '=' e | pname ':' e | '...' e | pname signature fnbody | 'get' pname signature fnbody | 'set' pname signature fnbody | '*' pname signature fnbody | 'async' '*'? pname signature fnbody ;
pname : name | STR | NUM | '[' e ']' ;
members : member* ;
mname : pname | PRIVATE ;
spec : name | STR | name 'as' name | name 'as' STR | STR 'as' name | STR 'as' STR ;
specs : spec | specs ',' spec ;
braced : '{' '}' | '{' specs ','? '}' ;
from : 'from' STR ;
import : 'import' STR with? ';' | 'import' clause from with? ';' ;
with : 'with' obj ;
clause : ident | '*' 'as' ident | braced | ident ',' braced | ident ',' '*' 'as' ident ;
export : 'export' braced from? ';' | 'export' '*' from ';' | 'export' '*' 'as' name from ';' | 'export' vardecl ';' | 'export' fndecl | 'export' classdecl
 | 'export' 'default' fnanon | 'export' 'default' classanon | 'export' 'default' exprs ';' ;
fnanon : 'async'? 'function' '*'? ident? signature fnbody ;
%bar fnexpr classexpr when fnanon
"""
_SCRIPT = r"""
bindtyped : binding ;
param : binding | binding '=' e | '...' binding ;
signature : params ;
arrowhead : '(' ')' | '(' exprs ',' ')' | '(' exprs ')' | '(' '...' binding ')' | '(' exprs ',' '...' binding ')' ;
classdecl : 'class' ident heritage? '{' members '}' ;
classexpr : 'class' ident? heritage? '{' members '}' ;
classanon : 'class' ident? heritage? '{' members '}' ;
heritage : 'extends' e ;
member : ';' | 'static'? method | 'static'? field ';' | 'static' block ;
method : mname signature fnbody | 'get' mname signature fnbody | 'set' mname signature fnbody | '*' mname signature fnbody | 'async' '*'? mname signature fnbody ;
field : mname | mname '=' e ;
"""
_TYPESCRIPT = r"""
bindtyped : binding | binding ':' t | ident '!' ':' t ;
param : deco* access* binding '?'? typed? | deco* access* binding '?'? typed? '=' e | deco* '...' binding typed? | 'this' typed? ;
access : 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
typed : ':' t ;
returns : ':' t | ':' ident 'is' t | ':' 'this' 'is' t | ':' 'asserts' ident | ':' 'asserts' ident 'is' t ;
signature : tparams? params returns? ;
arrowhead : params returns? | tparams params returns? ;
deco : '@' decoe ;
decoe : ident | decoe '.' name | decoe args | '(' e ')' ;
classdecl : deco* 'abstract'? 'class' ident tparams? heritage? implements? '{' members '}' ;
classexpr : deco* 'class' ident? tparams? heritage? implements? '{' members '}' ;
classanon : deco* 'abstract'? 'class' ident? tparams? heritage? implements? '{' members '}' ;
heritage : 'extends' e | 'extends' e targs ;
implements : 'implements' typelist ;
typelist : t | typelist ',' t ;
member : ';' | deco* modifier* method | deco* modifier* field ';' | deco* modifier* overload ';' | 'static' block | modifier* index ';' ;
modifier : 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' ;
method : mname '?'? signature fnbody | 'get' mname signature fnbody | 'set' mname signature fnbody | '*' mname signature fnbody | 'async' '*'? mname signature fnbody ;
overload : mname '?'? signature | 'get' mname signature | 'set' mname signature | 'async' mname signature ;
field : mname '?'? typed? | mname '!' typed | mname '!' typed '=' e | mname '?'? typed? '=' e ;
index : '[' ident ':' t ']' ':' t ;
stmt : tdecl ;
tdecl : 'interface' ident tparams? extendsl? tobj | 'type' ident tparams? '=' t ';' | 'const'? 'enum' ident '{' '}' | 'const'? 'enum' ident '{' enums ','? '}'
 | 'namespace' dotted '{' items '}' | 'module' STR '{' items '}' | 'module' dotted '{' items '}' | 'declare' 'global' '{' items '}' | 'declare' item | 'async'? 'function' '*'? ident signature ';' ;
extendsl : 'extends' typelist ;
dotted : ident | dotted '.' name ;
enums : enum | enums ',' enum ;
enum : pname | pname '=' e ;
export : 'export' tdecl | 'export' 'type' braced from? ';' | 'export' 'type' '*' from ';' | 'export' '=' exprs ';' | 'export' 'as' 'namespace' ident ';' | 'export' 'default' 'interface' ident tparams? extendsl? tobj | 'export' 'default' 'function' ident? signature ';' | 'export' 'import' ident '=' dotted ';' ;
import : 'import' 'type' clause from with? ';' | 'import' ident '=' 'require' args ';' | 'import' ident '=' dotted ';' ;
spec : 'type' name | 'type' name 'as' name ;
e : e 'as' t | e 'as' 'const' | e 'satisfies' t | e '!' | e targs args | e '?.' targs args | e targs template | '<' t '>' e %prec UNARY ;
tparams : '<' tparamlist ','? '>' ;
tparamlist : tparam | tparamlist ',' tparam ;
tparam : tmod* ident tbound? tdefault? ;
tmod : 'const' | 'in' | 'out' ;
tbound : 'extends' t ;
tdefault : '=' t ;
targs : '<' typelist '>' ;
t : tcond | fntype ;
tcond : tunion | tunion 'extends' tunion '?' t ':' t ;
fntype : tparams? params '=>' fnret | 'abstract'? 'new' tparams? params '=>' t ;
fnret : t | ident 'is' t | 'this' 'is' t | 'asserts' ident | 'asserts' ident 'is' t ;
tunion : tinter | '|' tinter | tunion '|' tinter ;
tinter : tunary | '&' tunary | tinter '&' tunary ;
tunary : tpost %prec LOWEST | 'keyof' tunary | 'unique' tunary | 'readonly' tunary | 'infer' ident | 'infer' ident 'extends' tunion ;
tpost : tprim | tpost '[' ']' | tpost '[' t ']' ;
tprim : tname | tname targs | 'this' | 'void' | 'null' | 'true' | 'false' | STR | NUM | '-' NUM | ttemplate | '(' t ')' | tobj | '[' ']' | '[' telems ','? ']'
 | 'typeof' tname targs? | 'typeof' 'import' '(' STR ')' | 'import' '(' t ')' targs? | 'import' '(' t ')' '.' tname targs? ;
tname : ident | tname '.' name ;
ttemplate : TFULL | THEAD t ttmids TTAIL ;
ttmids : | ttmids TMID t ;
telems : telem | telems ',' telem ;
telem : t | t '?' | '...' t | name '?'? ':' t | '...' ident ':' t ;
tobj : '{' tmembers '}' ;
tmembers : | tmlist | tmlist tsep ;
tmlist : tmember | tmlist tsep tmember ;
tsep : ';' | ',' ;
tmember : tmods* mname '?'? typed? | tmods* mname '?'? signature | signature | 'new' signature | tmods* index | 'get' mname signature | 'set' mname signature
 | tro? '[' ident 'in' t ']' tq? typed? | tro? '[' ident 'in' t 'as' t ']' tq? typed? ;
tmods : 'readonly' ;
tro : 'readonly' | '+' 'readonly' | '-' 'readonly' ;
tq : '?' | '+' '?' | '-' '?' ;
"""


def _words(typed: bool) -> tuple[list[str], list[str]]:
    return (CONTEXTUAL + TYPED + ["global", "require"] if typed else CONTEXTUAL), RESERVED


def grammar(typed: bool) -> str:
    contextual, reserved = _words(typed)
    strict = ("let", "static")  # words that modules reserve except as names of properties
    ctx = " | ".join(f"'{w}'" for w in contextual if w not in strict)
    keywords = " | ".join(f"'{w}'" for w in (*reserved, *strict))
    return _BASE + (_TYPESCRIPT if typed else _SCRIPT) + f"\nctx : {ctx} ;\nname : ID | ctx | {keywords} ;\n"


_ID = r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_STRING = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\""
_NUMBER = r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?(?![\w$])|(?:(?:0|[1-9](?:_?\d)*)(?:n|(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d(?:_?\d)*)?)|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?)(?![\w$])"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`"
_PUNCT = "|".join(re.escape(p) for p in sorted([p for p in PUNCTUATION if p not in ("/", "#", "?.")] + [a for a in ASSIGNING if a != "/="] + ["<<"], key=len, reverse=True))
_TOKEN = re.compile(
    rf"[ \t\n\r\v\f\xa0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/|{_ID}|{_STRING}|{_NUMBER}|{_TEMPLATE}|`|\?\.(?!\d)|{_PUNCT}|#{_ID}|/=?"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")
#: After these a slash divides; after anything else it begins a regular expression.
_ENDS = {"ID", "NUM", "STR", "TFULL", "TTAIL", "PRIVATE", "REGEX", "')'", "']'", "'}'", "'this'", "'super'", "'null'", "'true'", "'false'", "'++'", "'--'"}


class Lexer:
    def __init__(self, number: dict[str, int], typed: bool):
        contextual, reserved = _words(typed)
        self.number = number
        self.fixed = {w: number[f"'{w}'"] for w in [*contextual, *reserved] if f"'{w}'" in number}
        self.fixed |= {p: number[f"'{p}'"] for p in [*PUNCTUATION, "<<"] if f"'{p}'" in number}
        self.fixed |= {a: number["OPASSIGN"] for a in ASSIGNING}
        self.semicolon = number["';'"]
        self.ends = {number[x] for x in _ENDS if x in number} | {number[f"'{w}'"] for w in contextual}
        self.restricted = {number[f"'{w}'"] for w in ("return", "break", "continue", "throw")}
        self.steps = {number["'++'"], number["'--'"]}
        self.heads = {number[f"'{w}'"] for w in ("if", "while", "for", "with")}

    def tokens(self, text: str) -> tuple[list[int], list[int], set[int]] | int:
        """(terminals, offsets, indices where a statement end may be inserted), or the offset of a bad character."""
        fixed, number, ends = self.fixed, self.number, self.ends
        ident, num, string = number["ID"], number["NUM"], number["STR"]
        out: list[int] = []
        at: list[int] = []
        breaks: set[int] = set()
        closing = fixed["}"]
        pos, newline, braces, parens, headed = 0, False, [], [], False
        opening, closed = fixed["("], fixed[")"]
        size = len(text)
        if text.startswith("#!"):
            pos = text.find("\n")
            pos = size if pos < 0 else pos
        match = _TOKEN.match
        while pos < size:
            m = match(text, pos)
            if m is None:
                return pos
            token = m[0]
            c = token[0]
            end = m.end()
            kind = fixed.get(token)
            if kind is None:
                if c in " \t\r\n\v\f\xa0\ufeff" or c.isspace():
                    if "\n" in token or "\r" in token or "\u2028" in token:
                        newline = True
                    pos = end
                    continue
                if c == "/":
                    if token[:2] == "//":
                        pos = end
                        continue
                    if token[:2] == "/*":
                        newline = newline or "\n" in token
                        pos = end
                        continue
                    kind = number["OPASSIGN"]
                if c in "'\"":
                    kind = string
                elif c == "`":
                    if len(token) > 1:
                        kind = number["TFULL"]
                    else:
                        part = _PART.match(text, end)
                        if not part:
                            return pos
                        end = part.end()
                        kind = number["THEAD"]
                        braces.append(-1)
                elif c == "#":
                    kind = number["PRIVATE"]
                elif c.isdigit() or c == "." and len(token) > 1:
                    kind = num
                elif c != "/":
                    kind = ident
            if c == "/" and (not out or out[-1] not in ends or headed and out[-1] == closed):
                r = _REGEX.match(text, pos)
                if not r:
                    return pos
                kind, end = number["REGEX"], r.end()
            elif kind == opening:
                parens.append(bool(out) and out[-1] in self.heads)
            elif kind == closed:
                headed = bool(parens) and parens.pop()
            elif token == "{":
                braces.append(1)
            elif token == "}":
                if braces and braces.pop() < 0:
                    part = _PART.match(text, end)
                    if not part:
                        return pos
                    end = part.end()
                    if text[end - 1] == "`":
                        kind = number["TTAIL"]
                    else:
                        kind = number["TMID"]
                        braces.append(-1)
            if newline and out and (out[-1] in self.restricted or kind in self.steps and out[-1] in ends):
                out.append(self.semicolon)
                at.append(pos)
            if newline or kind == closing:
                breaks.add(len(out))
            newline = False
            out.append(kind)
            at.append(pos)
            pos = end
        breaks.add(len(out))
        return [*out, 0], [*at, pos], breaks
