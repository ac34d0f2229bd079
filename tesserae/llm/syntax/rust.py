"""Rust, edition 2021.

Statements of block form end without a semicolon; a struct literal may stand in the head of ``if``, ``while``,
``for`` and ``match`` as far as the rest of the text allows it, since the parser follows both readings.
"""

from __future__ import annotations

import re

# Reserved words, and words that are reserved only in some places.
RESERVED = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while abstract become box do final macro override priv typeof unsized virtual yield try".split()
WEAK = "union auto default macro_rules raw".split()
PUNCTUATION = "{ } ( ) [ ] ; , < > <= >= == != + - * / % & | ^ ! && || = : :: . .. ..= ... -> => ? @ # $ << _ ~ \\".split()
ASSIGNING = "+= -= *= /= %= <<= &= |= ^=".split()

GRAMMAR = r"""
%nonassoc LOWEST
%right '=' OPASSIGN 'return' 'break' CLOSURE
%nonassoc '..' '..='
%left '||'
%left '&&'
%nonassoc '==' '!=' '<' '>' '<=' '>='
%left '|'
%left '^'
%left '&'
%left '<<' SHIFT
%left '+' '-'
%left '*' '/' '%'
%left 'as'
%right UNARY
%left '?' '.' '(' '['

file : inner* item* ;
inner : '#' '!' '[' tts ']' ;
outer : '#' '[' tts ']' ;
vis : 'pub' | 'pub' '(' 'crate' ')' | 'pub' '(' 'self' ')' | 'pub' '(' 'super' ')' | 'pub' '(' 'in' spath ')' ;
item : outer* vis? bareitem ;
bareitem : 'mod' id ';' | 'unsafe'? 'mod' id '{' inner* item* '}' | 'extern' 'crate' id ';' | 'extern' 'crate' id 'as' idu ';' | 'extern' 'crate' 'self' 'as' idu ';'
 | 'use' usetree ';' | fn fnbody | 'type' id generics? bounds? where? '=' ty where? ';' | 'type' id generics? bounds? where? ';'
 | 'struct' id generics? where? '{' fields '}' | 'struct' id generics? '(' tfields ')' where? ';' | 'struct' id generics? where? ';' | 'union' id generics? where? '{' fields '}'
 | 'enum' id generics? where? '{' variants '}'
 | 'const' idu ':' ty '=' e ';' | 'const' idu ':' ty ';' | 'static' 'mut'? idu ':' ty '=' e ';' | 'static' 'mut'? idu ':' ty ';'
 | 'unsafe'? 'auto'? 'trait' id generics? bounds? where? '{' inner* item* '}'
 | 'unsafe'? 'impl' generics? 'const'? '!'? ty 'for' ty where? '{' inner* item* '}' | 'unsafe'? 'impl' generics? ty where? '{' inner* item* '}'
 | 'unsafe'? 'extern' STR? '{' inner* item* '}'
 | macrostmt | 'macro_rules' '!' id delim | 'macro_rules' '!' id pdelim ';' ;
macrostmt : spath '!' '{' tts '}' | spath '!' '(' tts ')' ';' | spath '!' '[' tts ']' ';' ;
fnbody : block | ';' ;
fn : 'default'? 'const'? 'async'? 'unsafe'? 'fn' id generics? '(' params ')' ret? where? | 'const'? 'async'? 'unsafe'? 'extern' STR? 'fn' id generics? '(' params ')' ret? where? ;
params : ( plist ','? )? ;
plist : param | plist ',' param ;
param : outer* pat ':' ty | outer* ty | outer* '...' | outer* self | outer* pat ':' '...' ;
self : 'mut'? 'self' | 'mut'? 'self' ':' ty | '&' 'mut'? 'self' | '&' LIFE 'mut'? 'self' ;
ret : '->' ty ;
generics : '<' '>' | '<' glist ','? '>' ;
glist : gparam | glist ',' gparam ;
gparam : outer* LIFE lbounds? | outer* id bounds? | outer* id bounds? '=' ty | outer* 'const' id ':' ty | outer* 'const' id ':' ty '=' garg ;
lbounds : ':' | ':' lifes ;
lifes : LIFE | lifes '+' LIFE ;
bounds : ':' | ':' blist '+'? ;
blist : bound | blist '+' bound ;
bound : LIFE | '?'? forlife? tpath | '(' '?'? forlife? tpath ')' | '~'? 'const' tpath ;
forlife : 'for' generics ;
where : 'where' | 'where' wlist ','? ;
wlist : wpred | wlist ',' wpred ;
wpred : LIFE lbounds | forlife? ty bounds ;
fields : | flist ','? ;
flist : field | flist ',' field ;
field : outer* vis? id ':' ty ;
tfields : | tflist ','? ;
tflist : tfield | tflist ',' tfield ;
tfield : outer* vis? ty ;
variants : | vlist ','? ;
vlist : variant | vlist ',' variant ;
variant : outer* vis? id disc? | outer* vis? id '{' fields '}' disc? | outer* vis? id '(' tfields ')' disc? ;
disc : '=' e ;
usetree : upath | upath 'as' idu | '*' | upath '::' '*' | '{' ulist '}' | upath '::' '{' ulist '}' | '::' '*' | '::' '{' ulist '}' ;
upath : '::'? seg | upath '::' seg ;
ulist : | utrees ','? ;
utrees : usetree | utrees ',' usetree ;
seg : id | 'self' | 'super' | 'crate' | 'Self' ;
idu : id | '_' ;
id : ID | 'union' | 'auto' | 'default' | 'macro_rules' | 'raw' ;
spath : '::'? seg | spath '::' seg ;

ty : tynb | tybounds ;
tynb : tpath | '(' ')' | '(' ty ')' | '(' ty ',' ')' | '(' ty ',' tys ','? ')' | '!' | '_' | '*' 'const' tynb | '*' 'mut' tynb
 | '&' LIFE? 'mut'? tynb | '&&' LIFE? 'mut'? tynb | '[' ty ']' | '[' ty ';' e ']' | forlife? fnptr | qpath | spath '!' delim | 'dyn' bound | 'impl' bound | forlife tpath ;
tybounds : 'dyn' blist '+' bound | 'impl' blist '+' bound | 'dyn' blist '+' | 'impl' blist '+' ;
tys : ty | tys ',' ty ;
fnptr : 'unsafe'? 'fn' '(' fnptrargs ')' ret1? | 'unsafe'? 'extern' STR? 'fn' '(' fnptrargs ')' ret1? ;
ret1 : '->' tynb ;
fnptrargs : | fnptrlist ','? ;
fnptrlist : fnptrarg | fnptrlist ',' fnptrarg ;
fnptrarg : outer* ty | outer* idu ':' ty | '...' ;
tpath : '::'? tseg | tpath '::' tseg ;
tseg : seg %prec LOWEST | seg targs | seg '::' targs | seg '(' ')' ret1? | seg '(' tys ','? ')' ret1? ;
targs : '<' '>' | '<' gargs ','? '>' ;
gargs : garg | gargs ',' garg ;
garg : LIFE | ty | lit | '-' lit | block | id targs? '=' ty | id targs? bounds ;
qpath : '<' ty '>' '::' qrest | '<' ty 'as' tpath '>' '::' qrest ;
qrest : tseg | qrest '::' tseg ;

pat : patnt | '|' patnt | pat '|' patnt ;
patnt : '_' | '..' | lit | '-' lit | rangeend '..' rangeend | rangeend '..=' rangeend | rangeend '...' rangeend | rangeend '..' | '..=' rangeend | '..' rangeend
 | 'ref'? 'mut'? id | 'ref'? 'mut'? id '@' patnt | epath2 | epath '{' fpats '}' | epath '(' pats ')' | '(' pats ')' | '[' pats ']' | '&' 'mut'? patnt | '&&' 'mut'? patnt | 'const' block | spath '!' delim | 'box' patnt ;
epath2 : '::'? 'self' | 'Self' | 'crate' '::' eseg | epath '::' eseg | qpath ;
rangeend : lit | '-' lit | epath ;
pats : | patl ','? ;
patl : pat | patl ',' pat ;
fpats : | fpatl ','? | fpatl ',' outer* '..' | outer* '..' ;
fpatl : fpat | fpatl ',' fpat ;
fpat : outer* id ':' pat | outer* NUM ':' pat | outer* 'ref'? 'mut'? id ;

block : '{' inner* stmt* tail? '}' ;
stmt : ';' | outer* vis? stmtitem | outer* 'let' pat lettype? ';' | outer* 'let' pat lettype? '=' e ';' | outer* 'let' pat lettype? '=' e 'else' block ';' | outer* e ';' | outer* blocky ;
tail : outer* e ;
lettype : ':' ty ;
stmtitem : bareitem ;
lit : NUM | STR | CHAR | 'true' | 'false' ;
epath : '::'? eseg | epath '::' eseg ;
eseg : seg | seg '::' targs ;
blocky : block | 'unsafe' block | 'const' block | 'async' 'move'? block | label? 'loop' block | label? 'while' e block | label? 'for' pat 'in' e block | label block | if | match ;
if : 'if' e block | 'if' e block 'else' block | 'if' e block 'else' if ;
match : 'match' e '{' inner* arms '}' ;
label : LIFE ':' ;
arms : arm* lastarm? ;
arm : outer* pat guard? '=>' e ',' | outer* pat guard? '=>' blocky ;
lastarm : outer* pat guard? '=>' e ;
guard : 'if' e ;
e : lit | epath | qpath | blocky | epath '!' delim | '(' ')' | '(' inner* e ')' | '(' e ',' ')' | '(' e ',' es ','? ')' | '[' ']' | '[' es ','? ']' | '[' e ';' e ']'
 | epath '{' finits '}' | qpath '{' finits '}'
 | e '.' id | e '.' NUM | e '.' 'await' | e '.' id '::' targs '(' args ')' | e '(' args ')' | e '[' e ']' | e '?'
 | '-' e %prec UNARY | '!' e %prec UNARY | '*' e %prec UNARY | '&' 'mut'? e %prec UNARY | '&&' 'mut'? e %prec UNARY | '&' 'raw' 'const' e %prec UNARY | '&' 'raw' 'mut' e %prec UNARY
 | e '+' e | e '-' e | e '*' e | e '/' e | e '%' e | e '&' e | e '|' e | e '^' e | e '&&' e | e '||' e | e '==' e | e '!=' e | e '<' e | e '>' e | e '<=' e | e '>=' e
 | e '<<' e | e '>' '>' e %prec SHIFT | e 'as' tynb | e '=' e | e OPASSIGN e | e '>' '>=' e %prec OPASSIGN
 | e '..' e | e '..=' e | e '..' %prec LOWEST | '..' e | '..=' e | '..' %prec LOWEST
 | 'return' %prec LOWEST | 'return' e | 'break' LIFE? %prec LOWEST | 'break' LIFE? e %prec 'break' | 'continue' LIFE?
 | 'let' pat '=' e %prec '&&' | 'static'? 'async'? 'move'? '|' cparams '|' cbody %prec CLOSURE | 'static'? 'async'? 'move'? '||' cbody %prec CLOSURE | '_' ;
cbody : e %prec CLOSURE | '->' tynb block %prec CLOSURE ;
cparams : | cplist ','? ;
cplist : cparam | cplist ',' cparam ;
cparam : outer* patnt | outer* patnt ':' ty ;
es : outer* e | es ',' outer* e ;
args : | es ','? ;
finits : | finitl ','? | finitl ',' '..' e | '..' e | finitl ',' '..' | '..' ;
finitl : finit | finitl ',' finit ;
finit : outer* id | outer* id ':' e | outer* NUM ':' e ;
delim : '(' tts ')' | '[' tts ']' | '{' tts '}' ;
pdelim : '(' tts ')' | '[' tts ']' ;
tts : | tts tt ;
tt : delim | TOKENS ;
"""


def grammar() -> str:
    tokens = [f"'{w}'" for w in RESERVED + WEAK + [p for p in PUNCTUATION if p not in "{}()[]"]] + ["ID", "NUM", "STR", "CHAR", "LIFE", "OPASSIGN"]
    return GRAMMAR.replace("TOKENS", " | ".join(t.replace("\\", "\\\\") for t in tokens))


_PUNCT = "|".join(re.escape(p) for p in sorted([p for p in PUNCTUATION if p not in ("/", "_", "#")] + ASSIGNING, key=len, reverse=True))
_TOKEN = re.compile(
    rf"[ \t\n\r\v\f\x85\u200e\u200f  ]+|//[^\n]*|/\*|b?\"(?:[^\"\\]|\\[\s\S])*\"|c\"(?:[^\"\\]|\\[\s\S])*\"|[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)"
    rf"|b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]{{1,8}}\}}))'|'[^\W\d]\w*(?!')|r#[^\W\d]\w*|[^\W\d]\w*"
    rf"|0x_*[0-9a-fA-F][0-9a-fA-F_]*(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0o_*[0-7][0-7_]*(?:[iu](?:8|16|32|64|128|size))?(?!\w)|0b_*[01][01_]*(?:[iu](?:8|16|32|64|128|size))?(?!\w)"
    rf"|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w._]))?(?:[eE][+-]?_*\d[\d_]*)?(?:_*(?:[iu](?:8|16|32|64|128|size)|f32|f64))?(?!\w)|{_PUNCT}|#|/"
)
_COMMENT = re.compile(r"/\*|\*/")
_FIELD = re.compile(r"\d+(?!\w)")


class Lexer:
    def __init__(self, number: dict[str, int]):
        self.number = number
        self.fixed = {w: number[f"'{w}'"] for w in RESERVED + WEAK + PUNCTUATION if f"'{w}'" in number}
        self.fixed |= {a: number["OPASSIGN"] for a in ASSIGNING}

    def tokens(self, text: str) -> tuple[list[int], list[int], None] | int:
        fixed, number = self.fixed, self.number
        out: list[int] = []
        at: list[int] = []
        pos, size, match = 0, len(text), _TOKEN.match
        ident, num, string, dot = number["ID"], number["NUM"], number["STR"], number["'.'"]
        if text.startswith("\ufeff"):
            pos = 1
        if text.startswith("#!", pos) and not re.match(r"#!\s*\[", text[pos:]):
            pos = text.find("\n") if "\n" in text else size
        while pos < size:
            m = match(text, pos)
            if m is None:
                return pos
            token = m[0]
            end = m.end()
            kind = fixed.get(token)
            if kind is None:
                c = token[0]
                if c.isspace() or c in "\x85\u200e\u200f":
                    pos = end
                    continue
                if c == "/":
                    if token[:2] == "//":
                        pos = end
                        continue
                    if token == "/*":
                        depth, where = 1, end
                        while depth:
                            n = _COMMENT.search(text, where)
                            if not n:
                                return pos
                            depth += 1 if n[0] == "/*" else -1
                            where = n.end()
                        pos = where
                        continue
                    return pos
                if c.isdigit():
                    kind = num
                    if out and out[-1] == dot:  # a tuple field: t.0.1 is no number
                        n = _FIELD.match(text, pos)
                        end = n.end() if n else end
                elif c == "'":
                    kind = number["CHAR"] if token[-1] == "'" and len(token) > 2 else number["LIFE"]
                elif token[-1] == '"' or token[-1] == "#" and c in "rbc":
                    kind = string
                elif token[-1] == "'":
                    kind = number["CHAR"]
                elif token == "_":
                    kind = fixed["_"]
                else:
                    kind = ident
            out.append(kind)
            at.append(pos)
            pos = end
        return [*out, 0], [*at, pos], None
