"""Exact ordinal cover: the best short sequence of evidence, by dynamic programming over coverage states.

A candidate raises each atom to a level 0, 1 or 2; a set's state is the greatest level of each atom, its utility the weighted
sum of levels. The best answer has the greatest utility, then the least acquisition time (each gain times its position),
then the fewest items, the least cost and the least keys.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple


class Item(NamedTuple):
    key: str
    levels: tuple[int, ...]
    cost: int


class Answer(NamedTuple):
    utility: int
    time: int
    cost: int
    keys: tuple[str, ...]


def evaluate(order: tuple[Item, ...], weights: tuple[int, ...]) -> Answer:
    state, time = (0,) * len(weights), 0
    value = lambda s: sum(w * x for w, x in zip(weights, s))
    for pos, item in enumerate(order, 1):
        after = tuple(map(max, state, item.levels))
        time += pos * (value(after) - value(state))
        state = after
    return Answer(value(state), time, sum(i.cost for i in order), tuple(i.key for i in order))


def objective(a: Answer) -> tuple:
    return -a.utility, a.time, len(a.keys), a.cost, a.keys


def brute_force(items: list[Item], weights: tuple[int, ...], k: int, budget: int | None = None) -> Answer:
    best = evaluate((), weights)
    for n in range(1, min(k, len(items)) + 1):
        for order in itertools.permutations(items, n):
            a = evaluate(order, weights)
            if (budget is None or a.cost <= budget) and objective(a) < objective(best):
                best = a
    return best


def solve(items: list[Item], weights: tuple[int, ...], k: int, budget: int | None = None) -> Answer:
    """Shortest way through (length, state) layers. In a best sequence every item raises the state, so none is used twice.

    Without a budget one best partial answer per state is enough; with one, those that no other beats in both time and cost.
    """
    zero = (0,) * len(weights)
    value = lambda s: sum(w * x for w, x in zip(weights, s))
    layer: dict[tuple[int, ...], list[tuple[int, int, tuple[str, ...]]]] = {zero: [(0, 0, ())]}
    best = evaluate((), weights)
    for pos in range(1, k + 1):
        nxt: dict[tuple[int, ...], list[tuple[int, int, tuple[str, ...]]]] = {}
        for state, partial in layer.items():
            base = value(state)
            for item in items:
                after = tuple(map(max, state, item.levels))
                gain = value(after) - base
                if after == state:
                    continue
                for time, cost, keys in partial:
                    if budget is None or cost + item.cost <= budget:
                        nxt.setdefault(after, []).append((time + pos * gain, cost + item.cost, (*keys, item.key)))
        for state, found in nxt.items():
            kept: list[tuple[int, int, tuple[str, ...]]] = []
            for f in sorted(found):
                if not kept or (budget is not None and f[1] < min(x[1] for x in kept)):
                    kept.append(f)
            nxt[state] = kept
            a = Answer(value(state), *kept[0])
            if objective(a) < objective(best):
                best = a
        layer = nxt
        if not layer:
            break
    return best


def soft_fill(items: list[Item], chosen: tuple[str, ...], k_min: int, budget: int | None = None) -> tuple[str, ...]:
    """Up to ``k_min`` items: the cheapest of the rest first, then by direct and partial levels, then key."""
    by_key = {i.key: i for i in items}
    out, spent = list(chosen), sum(by_key[k].cost for k in chosen)
    rest = sorted((i for i in items if i.key not in chosen), key=lambda i: (i.cost, -i.levels.count(2), -i.levels.count(1), i.key))
    for i in rest:
        if len(out) >= k_min:
            break
        if budget is None or spent + i.cost <= budget:
            out.append(i.key)
            spent += i.cost
    return tuple(out)


def replay(items: list[Item], weights: tuple[int, ...], answer: Answer, k: int, budget: int | None = None) -> bool:
    """Whether an answer holds by its own steps: known keys, each once, within k and the budget, and its numbers right."""
    by_key = {i.key: i for i in items}
    if len(set(answer.keys)) != len(answer.keys) or len(answer.keys) > k or any(x not in by_key for x in answer.keys):
        return False
    again = evaluate(tuple(by_key[x] for x in answer.keys), weights)
    return again == answer and (budget is None or again.cost <= budget)
