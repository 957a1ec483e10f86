"""Chains of evidence: ties between the candidates of an event, the score of a chain, beam search and reading order."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Sequence

import numpy as np

from attestra.operators.selection import STATE_OF, Pool

# What the score of a chain weighs; the last three are taken off.
SCORE = {"base": 0.45, "coverage": 0.35, "direct": 0.15, "complements": 0.12, "corroborates": 0.08, "tension": 0.08, "bridge": 0.05, "duplicate": 0.25, "background": 0.15, "source": 0.10}
# What a tie between neighbours adds to a reading order.
NEXT_TO = {"complements": 0.35, "corroborates": 0.25, "tension": 0.20, "bridge": 0.12}
POSITIVE = tuple(NEXT_TO)
DIRECT, BACKGROUND = {"direct", "partial"}, {"background", "irrelevant"}
EARLY_DIRECTNESS = {"direct": 1.0, "partial": 0.65, "context": 0.25}


class Graph:
    """The candidates of a pool, best first, and the ties between them as matrices by kind. Atoms weigh 1.

    Two candidates are duplicates by group or text. They complement each other if both cover atoms, not the same ones, and
    one is direct or partial; corroborate with one relation on a shared atom from different sources; are in tension with
    opposed relations on a shared atom; and bridge if one is background and the other direct or partial, with a shared atom
    or of one source.
    """

    def __init__(self, c: Pool, atoms: int | None = None):
        n = len(c)
        self.n = n
        names = {a: k for k, a in enumerate(sorted({a for x in c["atoms"] for a in x}))}
        self.covers = np.zeros((n, len(names)), bool)
        for i, x in enumerate(c["atoms"]):
            self.covers[i, [names[a] for a in x]] = True
        self.total = max(1, len(names) if atoms is None else atoms)
        self.base = np.asarray(c["base"], float)
        self.dup, self.source = list(c["dup"]), list(c["source"])
        relation, directness = list(c["relation"]), list(c["directness_name"])
        self.direct = np.array([d in DIRECT for d in directness], bool)
        self.background = np.array([r in BACKGROUND or d in ("context", "none") for r, d in zip(relation, directness)], bool)
        self.back = self.background.tolist()
        self.early = [EARLY_DIRECTNESS.get(d, 0.0) for d in directness]
        alike = lambda x: np.array([[a == b and bool(a) for b in x] for a in x], bool).reshape(n, n)
        side = [STATE_OF.get(r, "U") for r in relation]
        polar = np.array([s != "U" for s in side], bool)
        shared = (self.covers.astype(int) @ self.covers.T.astype(int)) > 0
        other = (self.covers.astype(int) @ ~self.covers.T) > 0  # covers something that the other doesn't
        any_atom, source = self.covers.any(1), alike(self.source)
        both_polar = polar[:, None] & polar[None]
        duplicate = alike(self.dup) | alike(list(c["key"]))
        bridges = self.background[:, None] & self.direct[None]
        self.ties = {
            "duplicate": duplicate,
            "complements": ~duplicate & any_atom[:, None] & any_atom[None] & (other | other.T) & (self.direct[:, None] | self.direct[None]),
            "corroborates": shared & both_polar & alike(relation) & ~source,
            "tension": shared & both_polar & ~alike(side),
            "bridge": (bridges | bridges.T) & (shared | source),
        }
        for m in self.ties.values():
            np.fill_diagonal(m, False)
        # What is looked up over and over, as lists and numbers: chains are short.
        self.positive = sum(self.ties[k].astype(int) for k in POSITIVE).tolist()
        self.tie = sum(SCORE[k] * self.ties[k] for k in POSITIVE).tolist()
        self.twin = self.ties["duplicate"].tolist()
        self.atoms = [np.flatnonzero(row).tolist() for row in self.covers]
        self.mask = [sum(1 << a for a in x) for x in self.atoms]
        self.core = (self.direct & ~self.background).tolist()
        self.next_to = (sum(w * self.ties[k] for k, w in NEXT_TO.items()) - 0.20 * self.ties["duplicate"]).tolist()
        self.worth = (SCORE["base"] * self.base + SCORE["direct"] * self.direct - SCORE["background"] * self.background).tolist()

    def score(self, chain: Sequence[int]) -> float:
        """Worth of a chain, whatever its order."""
        n, mask, worth, tie = len(chain), 0, 0.0, 0.0
        for p, i in enumerate(chain):
            mask |= self.mask[i]
            worth += self.worth[i]
            row = self.tie[i]
            for j in chain[:p]:
                tie += row[j]
        dups = [self.dup[i] for i in chain if self.dup[i]]
        repeats = len(dups) - len(set(dups))
        excess = sum(max(x - 2, 0) for x in Counter(self.source[i] for i in chain if self.source[i]).values()) if n > 2 else 0
        value = worth / n + SCORE["coverage"] * mask.bit_count() / self.total + tie / max(n * (n - 1) / 2, 1)
        return round(value - (SCORE["duplicate"] * repeats + SCORE["source"] * excess) / n, 9)

    def extensions(self, chain: Sequence[int], limit: int) -> list[int]:
        """What may come next: those with a positive tie to the chain, and those that cover a missing atom; all if none has a tie.

        Best first by ties, base score, atoms covered and fewest duplicates; ties to the better ranked.
        """
        ties = {i: sum(self.positive[i][j] for j in chain) for i in range(self.n) if i not in chain}
        left = list(ties)
        if any(ties.values()):
            covered = 0
            for i in chain:
                covered |= self.mask[i]
            left = [i for i in left if ties[i] or self.mask[i] & ~covered]
        return sorted(left, key=lambda i: (-ties[i], -self.base[i], -self.mask[i].bit_count(), sum(self.twin[i][j] for j in chain), i))[:limit]

    def beam(self, width: int = 12, depth: int = 5) -> list[tuple[float, list[int]]]:
        """Best chains by beam search over sequences, each set of evidence once, best first: score and order of search."""
        starts = sorted(range(self.n), key=lambda i: (-self.base[i], not self.direct[i], -self.mask[i].bit_count(), bool(self.background[i]), i))[:width]
        level = [(i,) for i in starts]
        for _ in range(min(depth, self.n) - 1):
            wider = {(*chain, i) for chain in level for i in self.extensions(chain, max(width, 4))}
            level = [x for _, x in sorted((-self.score(x), x) for x in wider)[:width]]
        sets = {frozenset(x): x for x in reversed(level)}
        return sorted(((self.score(x), list(x)) for x in sets.values()), key=lambda s: (-s[0], -int(self.covers[s[1]].any(0).sum()), s[1]))

    def order_score(self, order: Sequence[int]) -> float:
        """Worth of a reading order: new atoms and direct evidence early, atoms in the claim's order, ties between neighbours."""
        n = len(order)
        seen: dict[int, int] = {}
        value = 0.0
        for pos, i in enumerate(order):
            early = (n - pos) / n
            for a in self.atoms[i]:
                if a not in seen:
                    seen[a] = pos
                    value += early
            value += 0.35 * early * self.early[i]
            if self.back[i] and any(self.core[j] for j in order[pos + 1 :]):
                value -= 0.25
        places = [seen[a] for a in sorted(seen)]
        for x, y in itertools.combinations(places, 2):
            value += 0.15 if x < y else -0.35 if x > y else 0.0
        for i, j in zip(order, order[1:]):
            value += self.next_to[i][j]
        return round(float(value), 9)

    def best_order(self, chain: Sequence[int]) -> list[int]:
        """The best of all orders of a chain; of equals the one of better scores first, then nearest to the order of search."""
        n = len(chain)

        def key(order: tuple[int, ...]) -> tuple:
            early = round(float(sum((n - p) / n * self.base[i] for p, i in enumerate(order))), 9)
            turned = sum(chain.index(x) > chain.index(y) for x, y in itertools.combinations(order, 2))
            return -self.order_score(order), -early, turned, order

        return list(min(itertools.permutations(chain), key=key))
