"""From a grammar in text form to LALR(1) tables, and the parser that runs on them.

A grammar has lines ``name : symbols | symbols ;`` with ``'literal'`` and upper-case terminals, groups in
brackets and the marks ``?``, ``*`` and ``+``. ``%left``, ``%right`` and ``%nonassoc`` give precedences from low to
high, ``%prec`` after an alternative sets its own. ``%bar a b when c d`` forbids a and b to begin where c or d
may begin (an object literal where a block may stand). Conflicts that precedences leave open stay in
the tables as sets of actions: the parser then follows all of them side by side until one is left.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import product

_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'|[A-Za-z_][\w]*|%prec|[:|;()?*+]")
END = "$end"


class Grammar:
    def __init__(self, text: str, start: str):
        self.prods: list[tuple[str, tuple[str, ...], str | None]] = [("$start", (start,), None)]
        self.prec: dict[str, tuple[int, str]] = {}
        self.bars: list[tuple[set[str], set[str]]] = []
        level = 0
        body = []
        for line in text.split("\n"):
            line = line.strip()
            if line.startswith(("%left", "%right", "%nonassoc")):
                level += 1
                kind, *words = line.split()
                for w in words:
                    self.prec[w] = (level, kind[1:])
            elif line.startswith("%bar"):
                what, when = line[4:].split(" when ")
                self.bars.append((set(what.split()), set(when.split())))
            elif line and not line.startswith("#"):
                body.append(line)
        self._pieces, self._at, self._fresh = _PIECE.findall("\n".join(body)), 0, {}
        while self._at < len(self._pieces):
            name = self._pieces[self._at]
            assert self._pieces[self._at + 1] == ":", (name, self._pieces[self._at : self._at + 5])
            self._at += 2
            self._alternatives(name, ";")
        self.nonterminals = {p[0] for p in self.prods}
        self.prods = list(dict.fromkeys(self.prods))
        self.terminals = {s for _, rhs, _ in self.prods for s in rhs} - self.nonterminals
        unknown = {t for t in self.terminals if t[0] != "'" and not t.isupper()}
        assert not unknown, unknown

    def _alternatives(self, name: str, stop: str) -> None:
        rhs: list[tuple[str, bool]] = []  # (symbol, whether it may be missing)
        prec = None
        while True:
            piece = self._pieces[self._at]
            self._at += 1
            if piece in ("|", stop):
                # What may be missing is spelled out, as an empty rule would force choices too early.
                for keep in product(*[(True, False) if may else (True,) for _, may in rhs]):
                    self.prods.append((name, tuple(x for (x, _), k in zip(rhs, keep) if k), prec))
                rhs, prec = [], None
                if piece == stop:
                    return
            elif piece == "%prec":
                prec = self._pieces[self._at]
                self._at += 1
            elif piece == "(":
                inner = f"$group{len(self.prods)}_{self._at}"
                self._alternatives(inner, ")")
                rhs.append((inner, False))
            elif piece in "?*+":
                x, _ = rhs.pop()
                if piece != "?":
                    made = f"{x}+"
                    if made not in self._fresh:
                        self._fresh[made] = True
                        self.prods += [(made, (made, x), None), (made, (x,), None)]
                    x = made
                rhs.append((x, piece != "+"))
            else:
                rhs.append((piece, False))


class Tables:
    """``action[state]`` maps a terminal's number to a shift (>= 0), a reduction (< 0) or a tuple of them."""

    def __init__(self, grammar: Grammar):
        prods = grammar.prods
        by_lhs: dict[str, list[int]] = defaultdict(list)
        for n, (lhs, _, _) in enumerate(prods):
            by_lhs[lhs].append(n)
        nonterminals = grammar.nonterminals

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            items, seen, added = list(kernel), set(kernel), set()
            for n, dot in items:
                rhs = prods[n][1]
                if dot < len(rhs) and (x := rhs[dot]) in nonterminals and x not in added:
                    added.add(x)
                    for m in by_lhs[x]:
                        if (m, 0) not in seen:
                            seen.add((m, 0))
                            items.append((m, 0))
            for what, when in grammar.bars:
                if added & when:
                    items = [i for i in items if i[1] or prods[i[0]][0] not in what]
            return items

        start = frozenset([(0, 0)])
        number, kernels, gotos, closures = {start: 0}, [start], [], []
        for kernel in kernels:
            items = closure(kernel)
            closures.append(items)
            moves: dict[str, set] = defaultdict(set)
            for n, dot in items:
                if dot < len(prods[n][1]):
                    moves[prods[n][1][dot]].add((n, dot + 1))
            out = {}
            for x, target in moves.items():
                key = frozenset(target)
                if key not in number:
                    number[key] = len(kernels)
                    kernels.append(key)
                out[x] = number[key]
            gotos.append(out)

        nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for lhs, rhs, _ in prods:
                if lhs not in nullable and all(x in nullable for x in rhs):
                    nullable.add(lhs)
                    changed = True

        # Lookaheads by the relations reads, includes and lookback over nonterminal transitions.
        trans = [(s, x) for s, out in enumerate(gotos) for x in out if x in nonterminals]
        index = {t: i for i, t in enumerate(trans)}
        direct = [{x for x in gotos[gotos[s][a]] if x not in nonterminals} for s, a in trans]
        if (0, prods[0][1][0]) in index:
            direct[index[(0, prods[0][1][0])]].add(END)
        reads = [[index[(r, x)] for x in gotos[r] if x in nullable and (r, x) in index] for r in (gotos[s][a] for s, a in trans)]
        includes: list[list[int]] = [[] for _ in trans]
        lookback: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, (s, a) in enumerate(trans):
            for n in by_lhs[a]:
                rhs, q, alive = prods[n][1], s, True
                for d, x in enumerate(rhs):
                    if x not in gotos[q]:
                        alive = False
                        break
                    if x in nonterminals and all(y in nullable for y in rhs[d + 1 :]):
                        includes[index[(q, x)]].append(i)
                    q = gotos[q][x]
                if alive:
                    lookback[(q, n)].append(i)
        follow = _digraph(includes, _digraph(reads, direct))

        self.terminal = {t: i for i, t in enumerate([END, *sorted(grammar.terminals)])}
        self.action: list[dict[int, object]] = []
        self.goto = [{x: t for x, t in out.items() if x in nonterminals} for out in gotos]
        self.length = [len(rhs) for _, rhs, _ in prods]
        self.lhs = [lhs for lhs, _, _ in prods]
        self.conflicts = 0
        rule_prec = []
        for _, rhs, named in prods:
            last = next((x for x in reversed(rhs) if x not in nonterminals), None)
            rule_prec.append(grammar.prec.get(named or last or ""))
        for s, items in enumerate(closures):
            row: dict[int, list[int]] = defaultdict(list)
            shifts = {x: t for x, t in gotos[s].items() if x not in nonterminals}
            for x, t in shifts.items():
                row[self.terminal[x]].append(t)
            for n, dot in items:
                if dot < len(prods[n][1]):
                    continue
                if n == 0:
                    row[0].append(-1)
                    continue
                look = set().union(*(follow[i] for i in lookback[(s, n)]))
                for x in look:
                    cell, mine, theirs = row[self.terminal[x]], rule_prec[n], grammar.prec.get(x)
                    if x in shifts and mine and theirs and any(a >= 0 for a in cell):
                        if mine[0] > theirs[0] or mine[0] == theirs[0] and mine[1] == "left":
                            cell[:] = [a for a in cell if a < 0]
                        elif mine[0] < theirs[0] or mine[1] == "right":
                            continue
                        else:
                            cell[:] = [a for a in cell if a < 0]
                            continue
                    if -n - 1 not in cell:
                        cell.append(-n - 1)
            done: dict[int, object] = {}
            for t, cell in row.items():
                if len(cell) == 1:
                    done[t] = cell[0]
                elif cell:
                    self.conflicts += 1
                    done[t] = tuple(cell)
            self.action.append(done)
        # Reductions as (length, goto by state) for the inner loop; unit rules between two states become one look-up.
        states = range(len(self.action))
        self.goto_by_prod = [{s: self.goto[s][lhs] for s in states if lhs in self.goto[s]} for lhs in self.lhs]
        del self.goto


def _digraph(relation: list[list[int]], base: list[set]) -> list[set]:
    """Least sets with base[x] in out[x] and out[y] in out[x] for x related to y."""
    n = len(relation)
    out, depth, stack = [set(b) for b in base], [0] * n, []
    for root in range(n):
        if depth[root]:
            continue
        work = [(root, iter(relation[root]))]
        stack.append(root)
        depth[root] = len(stack)
        entered = {root: len(stack)}
        while work:
            x, it = work[-1]
            for y in it:
                if not depth[y]:
                    stack.append(y)
                    depth[y] = entered[y] = len(stack)
                    work.append((y, iter(relation[y])))
                    break
                depth[x] = min(depth[x], depth[y])
                out[x] |= out[y]
            else:
                work.pop()
                if depth[x] == entered[x]:
                    while True:
                        y = stack.pop()
                        depth[y] = 1 << 60
                        if y == x:
                            break
                        out[y] = out[x]
                if work:
                    up = work[-1][0]
                    depth[up] = min(depth[up], depth[x])
                    out[up] |= out[x]
    return out


def _same(a: tuple, b: tuple) -> bool:
    while a is not b:
        if a is None or b is None or a[0] != b[0]:
            return False
        a, b = a[1], b[1]
    return True


class Parser:
    """Runs tables over a whole token stream; stacks are linked lists, so following two actions costs no copy."""

    def __init__(self, tables: Tables, insert: int | None = None):
        self.t, self.insert = tables, insert

    def _step(self, stacks: list[tuple], token: int) -> list[tuple]:
        """All stacks after shifting a token from any of these, without copies of one stack."""
        action, length, goto = self.t.action, self.t.length, self.t.goto_by_prod
        work, out = list(stacks), []
        seen = list(stacks)
        while work:
            node = work.pop()
            acts = action[node[0]].get(token)
            if acts is None:
                continue
            for a in acts if type(acts) is tuple else (acts,):
                if a >= 0:
                    new = (a, node)
                    if not any(_same(new, o) for o in out):
                        out.append(new)
                    continue
                n = -a - 1
                if n == 0:
                    out.append((-1, node))
                    continue
                below = node
                for _ in range(length[n]):
                    below = below[1]
                new = (goto[n][below[0]], below)
                if not any(_same(new, s) for s in seen):
                    seen.append(new)
                    work.append(new)
        return out

    def error(self, tokens: list[int], breaks: set[int] | None = None) -> int | None:
        """Index of the first token that no continuation of the text before it allows, None if there is none.

        ``tokens`` ends with the end mark. Where ``breaks`` is given, a token at one of its indices may be
        preceded by an inserted ``insert`` if it is not allowed otherwise.
        """
        action, length, goto, insert = self.t.action, self.t.length, self.t.goto_by_prod, self.insert
        stack: tuple = (0, None)
        many: list[tuple] | None = None
        i, n = 0, len(tokens)
        while i < n:
            token = tokens[i]
            if many is None:
                node = stack
                while True:
                    a = action[node[0]].get(token)
                    if a.__class__ is int:
                        if a >= 0:
                            stack = (a, node)
                            i += 1
                            break
                        p = -a - 1
                        if p == 0:
                            return None
                        k = length[p]
                        if k == 1:
                            node = node[1]
                        elif k == 3:
                            node = node[1][1][1]
                        else:
                            for _ in range(k):
                                node = node[1]
                        node = (goto[p][node[0]], node)
                        continue
                    many = [stack]
                    break
                if many is None:
                    continue
            after = self._step(many, token)
            if not after:
                if insert is None or breaks is None or i not in breaks:
                    return i
                many = self._step(many, insert)
                if many:
                    many = self._step(many, token)
                if not many:
                    return i
                after = many
            if any(s[0] == -1 for s in after):
                return None
            i += 1
            if len(after) == 1:
                stack, many = after[0], None
            else:
                many = after
        return n
