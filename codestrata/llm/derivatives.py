"""Parsing with derivatives, memoised.

A language is a set of forms, each a sequence of symbols still to come, as a linked list whose
cells are shared (equal rests are the same cell). Its derivative by a token is the set of rests
after that token; the derivatives of a rule by a token are computed once, those of a cell and of a
whole set too. An empty derivative marks the token that can't stand there; a derivative at the end
that holds no empty form means that the text breaks off.

Rules must not be left-recursive. ``EOS`` is the end of a statement: a semicolon, or nothing before
a line break, a closing brace or the end.
"""

from __future__ import annotations

import re

END = "<end>"
_PART = re.compile(r"\s*('[^']+'|[A-Za-z_][\w-]*|[()|?*+])")
STATES = 200_000  # memoised sets of forms, beyond which the memo starts anew


class Grammar:
    """rules: lines ``name = parts``, with 'token', NAME of a token class, rule, ( ) | ? * +."""

    def __init__(self, text: str, start: str):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self.names = {line.split("=", 1)[0].strip() for line in text.splitlines() if "=" in line and not line.startswith(" ")}
        body, name = "", None
        for line in [*text.splitlines(), "end ="]:
            if line.startswith(" ") or not line.strip():
                body += line
                continue
            if name:
                parts = _PART.findall(body)
                tree, rest = self._choice(parts, 0)
                if rest != len(parts):
                    raise ValueError(f"rule {name}: {parts[rest:]}")
                self.rules[name] = tree
            name, body = (x.strip() if i == 0 else x for i, x in enumerate(line.split("=", 1)))
        unknown = {s for alts in self.rules.values() for alt in alts for s in alt if s[0].islower() and s not in self.rules and not s.startswith("'")}
        if unknown:
            raise ValueError(f"no rules for {unknown}")
        self.rules = {n: [tuple(s[1:-1] if s[0] == "'" else s for s in alt) for alt in alts] for n, alts in self._keyed().items()}
        self.nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for n, alts in self.rules.items():
                if n not in self.nullable and any(all(s in self.nullable for s in alt) for alt in alts):
                    self.nullable.add(n)
                    grown = True
        self.soft = set(self.nullable) | {"EOS"}  # nullable where a statement may end
        grown = True
        while grown:
            grown = False
            for n, alts in self.rules.items():
                if n not in self.soft and any(all(s in self.soft for s in alt) for alt in alts):
                    self.soft.add(n)
                    grown = True
        self.start = self.key(start)
        self.lead: dict[tuple[str, str, bool], frozenset[tuple[str, ...]]] = {}
        self.reset()

    def key(self, rule: str) -> str:
        return "\0" + rule

    def _keyed(self) -> dict[str, list[tuple[str, ...]]]:
        """Rules get names that no token has."""
        return {self.key(n): [tuple(self.key(s) if s in self.rules else s for s in alt) for alt in alts] for n, alts in self.rules.items()}

    def _choice(self, parts: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        alts: list[tuple[str, ...]] = []
        seq: list[str] = []
        while at < len(parts) and parts[at] != ")":
            part = parts[at]
            at += 1
            if part == "|":
                alts.append(tuple(seq))
                seq = []
                continue
            if part == "(":
                inner, at = self._choice(parts, at)
                part = self._fresh(inner) if len(inner) > 1 or len(inner[0]) != 1 else inner[0][0]
                at += 1
            while at < len(parts) and parts[at] in ("?", "*", "+"):
                mark, at = parts[at], at + 1
                again = self._fresh([])
                if mark == "?":
                    self.rules[again] = [(part,), ()]
                elif mark == "*":
                    self.rules[again] = [(part, again), ()]
                else:
                    more = self._fresh([])
                    self.rules[more] = [(part, more), ()]
                    self.rules[again] = [(part, more)]
                part = again
            seq.append(part)
        alts.append(tuple(seq))
        return alts, at

    def _fresh(self, alts: list[tuple[str, ...]]) -> str:
        name = f"g{len(self.rules)}"
        self.rules[name] = alts
        return name

    def reset(self) -> None:
        self.cells: dict[tuple[str, int], int] = {}
        self.symbol: list[str] = [""]
        self.rest: list[int] = [0]
        self.by_cell: dict[tuple[int, str, bool], frozenset[int]] = {}
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.moves: list[dict[tuple[str, bool], int]] = []
        self.first = self.state(frozenset([self.cell(self.start, 0)]))

    def cell(self, symbol: str, rest: int) -> int:
        found = self.cells.get((symbol, rest))
        if found is None:
            found = self.cells[symbol, rest] = len(self.symbol)
            self.symbol.append(symbol)
            self.rest.append(rest)
        return found

    def state(self, forms: frozenset[int]) -> int:
        found = self.sets.get(forms)
        if found is None:
            found = self.sets[forms] = len(self.members)
            self.members.append(forms)
            self.moves.append({})
        return found

    def leading(self, rule: str, token: str, loose: bool) -> frozenset[tuple[str, ...]]:
        """The rests of a rule after a token. loose: a statement may end before this token."""
        known = self.lead.get((rule, token, loose))
        if known is None:
            out: set[tuple[str, ...]] = set()
            empty = self.soft if loose else self.nullable
            for alt in self.rules[rule]:
                for k, symbol in enumerate(alt):
                    if symbol in self.rules:
                        out.update(rest + alt[k + 1:] for rest in self.leading(symbol, token, loose))
                    elif symbol == token or symbol == "EOS" and token == ";":
                        out.add(alt[k + 1:])
                    if symbol not in empty:
                        break
            known = self.lead[rule, token, loose] = frozenset(out)
        return known

    def cell_derivative(self, cell: int, token: str, loose: bool) -> frozenset[int]:
        known = self.by_cell.get((cell, token, loose))
        if known is not None:
            return known
        out: set[int] = set()
        empty = self.soft if loose else self.nullable
        at = cell
        while at:
            symbol, rest = self.symbol[at], self.rest[at]
            if symbol in self.rules:
                for form in self.leading(symbol, token, loose):
                    made = rest
                    for s in reversed(form):
                        made = self.cell(s, made)
                    out.add(made)
            elif symbol == token or symbol == "EOS" and token == ";":
                out.add(rest)
            if symbol not in empty:
                break
            at = rest
        known = self.by_cell[cell, token, loose] = frozenset(out)
        return known

    def derivative(self, state: int, move: tuple[str, bool]) -> int:
        """The state after a token, or -1."""
        forms: set[int] = set()
        for cell in self.members[state]:
            forms |= self.cell_derivative(cell, *move)
        found = self.moves[state][move] = self.state(frozenset(forms)) if forms else -1
        return found

    def accepts_end(self, state: int) -> bool:
        for cell in self.members[state]:
            while cell and self.symbol[cell] in self.soft:
                cell = self.rest[cell]
            if not cell:
                return True
        return False

    def failure(self, moves) -> int | None:
        """None if the tokens are a text of the language, else the failing token's number; the
        number of tokens stands for a text that breaks off. moves: (token class, loose) each."""
        if len(self.members) > STATES:
            self.reset()
        state, table, n = self.first, self.moves, -1
        for n, move in enumerate(moves):
            step = table[state].get(move)
            if step is None:
                step = self.derivative(state, move)
            if step < 0:
                return n
            state = step
        return None if self.accepts_end(state) else n + 1
