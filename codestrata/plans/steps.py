"""Steps with declared inputs and outputs: closure, order, staleness and a run in threads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object] = field(compare=False, default=lambda: None)
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


class Plan:
    """A graph of steps: a step follows those it names and those that write what it reads."""

    def __init__(self, steps: Iterable[Step]):
        self.steps = {s.name: s for s in steps}
        writers = {w: s.name for s in self.steps.values() for w in s.writes}
        self.needs: dict[str, set[str]] = {}
        for s in self.steps.values():
            self.needs[s.name] = {n for n in (*s.after, *(writers.get(r) for r in s.reads)) if n and n != s.name}
            unknown = self.needs[s.name] - set(self.steps)
            if unknown:
                raise ValueError(f"{s.name} follows unknown steps: {sorted(unknown)}")
        self.order()

    def order(self) -> list[str]:
        """Steps after those they need, by name where either may come first."""
        left, out = {n: set(d) for n, d in self.needs.items()}, []
        while left:
            free = sorted(n for n, d in left.items() if not d)
            if not free:
                raise ValueError(f"steps wait for each other: {sorted(left)}")
            out += free
            left = {n: d - set(free) for n, d in left.items() if n not in free}
        return out

    def closure(self, names: Iterable[str]) -> list[str]:
        """The named steps and all they need, in order."""
        wanted, todo = set(), list(names)
        while todo:
            n = todo.pop()
            if n not in wanted:
                wanted.add(n)
                todo += self.needs[n]
        return [n for n in self.order() if n in wanted]

    def stale(self, changed: Iterable[str]) -> list[str]:
        """The steps that must run again when these artifacts have changed."""
        dirty, out = set(changed), []
        for n in self.order():
            s = self.steps[n]
            if dirty & set(s.reads) or self.needs[n] & set(out):
                out.append(n)
                dirty |= set(s.writes)
        return out

    def execute(self, names: Iterable[str] | None = None, threads: int = 4) -> Mapping[str, str]:
        """Runs steps as soon as all they need is done: done, failed, or skipped behind a failure."""
        wanted = self.closure(self.steps if names is None else names)
        state: dict[str, str] = {}
        running = {}
        with ThreadPoolExecutor(threads) as pool:
            while len(state) < len(wanted):
                for n in wanted:
                    if n in state or n in running.values():
                        continue
                    needs = self.needs[n]
                    if any(state.get(d) in ("failed", "skipped") for d in needs):
                        state[n] = "skipped"
                    elif all(state.get(d) == "done" for d in needs):
                        running[pool.submit(self.steps[n].run)] = n
                if running:
                    for f in wait(running, return_when=FIRST_COMPLETED).done:
                        state[running.pop(f)] = "failed" if f.exception() else "done"
        return state
