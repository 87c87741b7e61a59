"""Memoised parsing with derivatives over token streams.

A grammar is a set of interned expressions. The derivative of an expression by a token is the expression of what
may still follow; it is computed once per (expression, token) and kept, so common states behave like those of a
finite automaton. An empty derivative marks the failing token; an end that is not nullable means truncation.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s*(?:('[^']*')|([A-Za-z_][A-Za-z_0-9]*)|([|()\[\]*+]))")


class Grammar:
    """Rules in EBNF: name = a 'literal' [optional] (group) x* x+ | alternative. Capitals are token kinds.

    No rule may be left-recursive. Ambiguity is fine: alternatives are derived together.
    """

    EMPTY, EPSILON = 0, 1

    def __init__(self, rules: dict[str, str], start: str, limit: int = 1_500_000):
        self.rules, self.start_rule, self.limit = rules, start, limit
        words = [m for body in rules.values() for m in _META.finditer(body)]
        self.kinds: dict[str, int] = {}
        for m in words:
            if m[1] or m[2] and m[2].isupper():
                self.kind(m[0].strip().strip("'"))
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {("empty",): 0, ("epsilon",): 1}
        self.nodes: list[tuple] = [("empty",), ("epsilon",)]
        self.null: dict[int, bool] = {0: False, 1: True}
        self.memo: dict[tuple[int, int], int] = {}
        self.bodies: dict[str, int] = {}
        self.start = self._ref(self.start_rule)

    # -- expressions, interned
    def _intern(self, node: tuple) -> int:
        i = self.ids.get(node)
        if i is None:
            i = self.ids[node] = len(self.nodes)
            self.nodes.append(node)
        return i

    def kind(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds))

    def _ref(self, name: str) -> int:
        return self._intern(("ref", name))

    def _cat(self, a: int, b: int) -> int:
        if a == 0 or b == 0:
            return 0
        if a == 1:
            return b
        if b == 1:
            return a
        node = self.nodes[a]
        if node[0] == "cat":  # kept leaning to the right, so equal rests are one expression
            return self._intern(("cat", node[1], self._cat(node[2], b)))
        return self._intern(("cat", a, b))

    def _alt(self, *parts: int) -> int:
        flat: set[int] = set()
        for p in parts:
            if self.nodes[p][0] == "alt":
                flat |= self.nodes[p][1]
            elif p:
                flat.add(p)
        if len(flat) < 2:
            return next(iter(flat), 0)
        return self._intern(("alt", frozenset(flat)))

    # -- rules
    def _body(self, name: str) -> int:
        if name not in self.bodies:
            words = [m.group(m.lastindex) for m in _META.finditer(self.rules[name])]
            words.append("")
            out, at = self._choice(words, 0)
            if words[at]:
                raise ValueError(f"rule {name}: {words[at:]}")
            self.bodies[name] = out
        return self.bodies[name]

    def _choice(self, words: list[str], at: int) -> tuple[int, int]:
        parts = []
        while True:
            one, at = self._sequence(words, at)
            parts.append(one)
            if words[at] != "|":
                return self._alt(*parts), at
            at += 1

    def _sequence(self, words: list[str], at: int) -> tuple[int, int]:
        items = []
        while words[at] not in ("", "|", ")", "]"):
            w = words[at]
            if w in ("(", "["):
                item, at = self._choice(words, at + 1)
                item = item if w == "(" else self._alt(item, 1)
            elif w[0] == "'" or w.isupper():
                item = self._intern(("token", self.kind(w.strip("'"))))
            else:
                item = self._ref(w)
            at += 1
            while words[at] in ("*", "+"):
                star = self._intern(("star", item))
                item = star if words[at] == "*" else self._cat(item, star)
                at += 1
            items.append(item)
        out = 1
        for item in reversed(items):
            out = self._cat(item, out)
        return out, at

    # -- derivatives
    def nullable(self, i: int) -> bool:
        known = self.null.get(i)
        if known is None:
            node = self.nodes[i]
            what = node[0]
            if what == "token":
                known = False
            elif what == "star":
                known = True
            elif what == "ref":
                known = self.nullable(self._body(node[1]))
            elif what == "cat":
                known = self.nullable(node[1]) and self.nullable(node[2])
            else:
                known = any(self.nullable(p) for p in node[1])
            self.null[i] = known
        return known

    def derive(self, i: int, t: int) -> int:
        known = self.memo.get((i, t))
        if known is None:
            node = self.nodes[i]
            what = node[0]
            if what == "token":
                known = int(node[1] == t)
            elif what == "cat":
                known = self._cat(self.derive(node[1], t), node[2])
                if self.nullable(node[1]):
                    known = self._alt(known, self.derive(node[2], t))
            elif what == "alt":
                known = self._alt(*[self.derive(p, t) for p in node[1]])
            elif what == "star":
                known = self._cat(self.derive(node[1], t), i)
            elif what == "ref":
                known = self.derive(self._body(node[1]), t)
            else:
                known = 0
            self.memo[i, t] = known
        return known

    def run(self, tokens) -> int:
        """-1 if the tokens are a text of the grammar, the position of the failing token, or their number if they end too early."""
        if len(self.memo) > self.limit or len(self.nodes) > self.limit:
            self.reset()
        state, memo, kinds, n = self.start, self.memo, self.kinds, 0
        for name in tokens:
            t = kinds.get(name, -1)
            nxt = memo.get((state, t))
            if nxt is None:
                try:
                    nxt = self.derive(state, t)
                except RecursionError:
                    return self._deep(tokens)
            if not nxt:
                return n
            state = nxt
            n += 1
        return -1 if self.nullable(state) else n

    def _deep(self, tokens) -> int:
        """The same for texts nested beyond the interpreter's stack, on a thread with a larger one."""
        import sys
        import threading

        result: list[int] = []

        def work() -> None:
            state, n = self.start, 0
            for name in tokens:
                state = self.derive(state, self.kinds.get(name, -1))
                if not state:
                    result.append(n)
                    return
                n += 1
            result.append(-1 if self.nullable(state) else n)

        old, stack = sys.getrecursionlimit(), threading.stack_size()
        try:
            threading.stack_size(512 << 20)
            sys.setrecursionlimit(1_000_000)
            worker = threading.Thread(target=work)
            worker.start()
            worker.join()
        finally:
            sys.setrecursionlimit(old)
            threading.stack_size(stack)
        return result[0]
