"""Weighted transducers over the tropical semiring: weights add along a path, and of paths the least counts."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

INF = float("inf")


@dataclass
class Machine:
    """A transducer whose arcs are found as they are asked for.

    ``step(state, symbol)`` gives ``(output, weight, next)`` for each arc that reads the symbol; the symbol ``None`` asks for
    arcs that read nothing, the output ``None`` writes nothing. ``final`` is the weight of ending in a state, ``INF`` if
    none may end there.
    """

    start: Hashable
    step: Callable[[Hashable, object], Iterable[tuple[object, float, Hashable]]]
    final: Callable[[Hashable], float]


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that gives ``b`` what ``a`` writes; its states are pairs, of which only those that are met exist."""

    def step(state, symbol):
        p, q = state
        for out, w, to in a.step(p, symbol):
            if out is None:
                yield None, w, (to, q)
            else:
                for second, v, then in b.step(q, out):
                    yield second, w + v, (to, then)
        if symbol is None:
            for second, v, then in b.step(q, None):
                yield second, v, (p, then)

    return Machine((a.start, b.start), step, lambda s: a.final(s[0]) + b.final(s[1]))


def shortest_path(machine: Machine, symbols: Iterable) -> tuple[float, list] | None:
    """The least weight of a path that reads all the symbols, and what it writes; of equal paths the first found. None if
    no path does. Symbols are read in order, so states are relaxed position by position; arcs that read nothing are
    relaxed until nothing falls any more, which needs them to form no cycle of negative weight."""

    def settle(reached: dict) -> dict:
        todo = list(reached)
        while todo:
            state = todo.pop()
            far, path = reached[state]
            for out, w, to in machine.step(state, None):
                if far + w < reached.get(to, (INF,))[0]:
                    reached[to] = (far + w, path if out is None else (path, out))
                    todo.append(to)
        return reached

    reached = settle({machine.start: (0.0, None)})
    for symbol in symbols:
        ahead: dict = {}
        for state, (far, path) in reached.items():
            for out, w, to in machine.step(state, symbol):
                if far + w < ahead.get(to, (INF,))[0]:
                    ahead[to] = (far + w, path if out is None else (path, out))
        reached = settle(ahead)
    best = min(((far + machine.final(s), i) for i, (s, (far, _)) in enumerate(reached.items())), default=(INF, 0))
    if best[0] == INF:
        return None
    path, out = list(reached.values())[best[1]][1], []
    while path is not None:
        path, x = path
        out.append(x)
    return best[0], out[::-1]
