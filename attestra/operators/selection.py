"""Selectors that choose step by step within one event.

Each takes the event's candidates as plain lists and returns chosen positions; ``grouped`` runs one per event on a pool that
has been cut to its best candidates beforehand, so no group handed to Python is larger than the pool.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attestra.functions.vectors import dot
from attestra.operators.ranking import top_k


class Pool:
    """The columns of one group's candidates, best first: arrays of numbers, lists of anything else."""

    def __init__(self, columns: dict[str, Sequence]):
        self.columns = columns

    def __getitem__(self, name: str) -> Sequence:
        return self.columns[name]

    def __setitem__(self, name: str, values: Sequence) -> None:
        self.columns[name] = values

    def __len__(self) -> int:
        return len(next(iter(self.columns.values())))

    def head(self, n: int) -> Pool:
        return Pool({k: v[:n] for k, v in self.columns.items()})


def per_row(df: DataFrame, keys: list[str], packed: str, fn: Callable[[Pool], Iterable[tuple]], schema: str) -> DataFrame:
    """``keys`` and the rows that ``fn`` makes of each row's array of structs, whole Arrow batches at a time.

    The structs' fields are sliced from the batch's columns, so a group costs no frame of its own.
    """
    out = StructType([f for k in keys for f in df.schema if f.name == k] + list(StructType.fromDDL(schema)))
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            offsets, values = lists.offsets.to_numpy(), lists.values
            columns = {}
            for i, f in enumerate(values.type):
                child = values.field(i)
                number = pa.types.is_integer(f.type) or pa.types.is_floating(f.type)
                columns[f.name] = child.to_numpy(zero_copy_only=False) if number else child.to_pylist()
            at, rows = [], []
            for g, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for r in fn(Pool({k: v[lo:hi] for k, v in columns.items()})) if hi > lo else ():
                    at.append(g)
                    rows.append(r)
            made = list(zip(*rows)) or [()] * (len(arrow) - len(keys))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take).cast(arrow.field(i).type) for i in range(len(keys))), *(pa.array(list(c), arrow.field(len(keys) + i).type) for i, c in enumerate(made))], schema=arrow)

    return df.select(*keys, packed).mapInArrow(run, out)


def grouped(df: DataFrame, by: list[str], order: list[Column], pool: int | None, fn: Callable[[Pool], Iterable[tuple]], schema: str) -> DataFrame:
    """``by`` and what ``fn`` makes of each group's best ``pool`` rows, or all, which it gets in that order."""
    best = top_k(df, by, order, pool)
    fields = ["rank", *(c for c in best.columns if c not in by and c != "rank")]
    packed = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["rank"] - b["rank"]).alias("pool"))
    return per_row(packed, by, "pool", fn, schema)


def mmr(score: np.ndarray, sim: np.ndarray, k: int, lam: float | Sequence[float] = 0.7) -> list[int]:
    """Maximal marginal relevance: first the best score, then ``lam * score - (1 - lam) * closeness to the chosen``.

    Closeness is never below 0, so unlikeness is not rewarded. With k or fewer candidates the order is plain by score. A list
    of lambdas holds one for each step. Ties go to the earlier candidate.
    """
    n = len(score)
    if n == 0 or k <= 0:
        return []
    by_score = np.argsort(-score, kind="stable")
    if k >= n:
        return by_score.tolist()
    lams = [lam] * k if np.isscalar(lam) else list(lam)
    chosen, close = [int(by_score[0])], np.zeros(n)
    while len(chosen) < k:
        close = np.maximum(close, sim[:, chosen[-1]])
        gain = np.round(lams[len(chosen)] * score - (1 - lams[len(chosen)]) * close, 9)
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
    return chosen


def mmr_rounds(df: DataFrame, by: list[str], item: str, vector: str, query: DataFrame, runs: dict[str, Sequence[float]]) -> DataFrame:
    """``mmr`` over groups of any size: ``by, run, q, lams, n, chosen``, the chosen with ``item``, ``vector`` and score ``s``, in order.

    ``query`` has one vector ``q`` for each group; ``runs`` has each run's lambda for each step. A step is one aggregate over
    all rows, which meet the chosen so far in a broadcast: each task keeps one row for each group and run.
    """
    steps = {len(x) for x in runs.values()}
    assert len(steps) == 1
    kind = f"array<struct<{item}:{df.schema[item].dataType.simpleString()},{vector}:{df.schema[vector].dataType.simpleString()},s:double>>"
    each = F.array(*(F.struct(F.lit(r).alias("run"), F.array(*(F.lit(float(x)) for x in lams)).alias("lams")) for r, lams in runs.items()))
    state = query.select(*by, "q", F.inline(each)).withColumns({"n": F.lit(0).cast("long"), "chosen": F.array().cast(kind)})
    for step in range(steps.pop()):
        rows = df.join(F.broadcast(state), by).withColumn("s", F.round(dot(F.col(vector), F.col("q")), 9))
        lam = F.get("lams", F.lit(step))
        close = F.array_max(F.transform("chosen", lambda x: F.greatest(F.lit(0.0), F.round(dot(F.col(vector), x[vector]), 9))))
        # The first step, and groups with no more rows than steps, go by score alone.
        gain = F.col("s") if step == 0 else F.when(F.col("n") <= len(next(iter(runs.values()))), F.col("s")).otherwise(F.round(lam * F.col("s") - (1 - lam) * close, 9))
        free = ~F.exists("chosen", lambda x: x[item] == F.col(item))
        best = F.max_by(F.struct(item, vector, "s"), F.when(free, F.struct(gain.alias("gain"), F.col("s"), (-F.col(item)).alias("tie"))))
        held = [F.first(c).alias(c) for c in ("q", "lams", "chosen")]
        state = rows.groupBy(*by, "run").agg(*held, F.count("*").alias("n"), best.alias("best"))
        state = state.withColumn("chosen", F.when(F.col("best").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("best")))).drop("best")
    return state


def token_mmr(score: np.ndarray, tokens: list[set], k: int, lam: float = 0.7) -> list[int]:
    chosen: list[int] = []
    close = [0.0] * len(score)
    while len(chosen) < min(k, len(score)):
        gain = np.array([-np.inf if i in chosen else round(lam * score[i] - (1 - lam) * close[i], 9) for i in range(len(score))])
        chosen.append(int(np.argmax(gain)))
        last = tokens[chosen[-1]]
        close = [max(c, len(t & last) / len(t | last) if t | last else 1.0) for c, t in zip(close, tokens)]
    return chosen


def may_win(df: DataFrame, by: list[str], order: list[Column], score: str, k: int, lam: float = 0.7) -> DataFrame:
    """Rows that ``token_mmr`` can choose at all, ``order`` being by score first.

    While fewer than k are chosen, one of the k best is free, and its gain is at least ``lam * score - (1 - lam)``; a row whose
    gain stays below that even at closeness 0 never wins.
    """
    ranked = top_k(df, by, order, name="__n")
    kth = F.max(F.when(F.col("__n") == k, F.col(score))).over(Window.partitionBy(*by))
    least = F.coalesce(lam * kth - (1 - lam) - 1e-8, F.lit(-np.inf))
    return ranked.withColumn("__least", least).where((F.col("__n") <= k) | (lam * F.col(score) >= F.col("__least"))).drop("__n", "__least")


class SlotWeights(NamedTuple):
    """What a slot's score weighs: base, newly covered atoms, directness, polarity, and penalties."""

    base: float = 1.0
    coverage: float = 0.35
    directness: float = 0.20
    polarity: float = 0.10
    duplicate: float = 0.15
    source: float = 0.08
    background: float = 0.20


def slot_greedy(c: Pool, k: int, w: SlotWeights = SlotWeights()) -> list[tuple[int, float]]:
    """Slots filled one after another by the best score given what is chosen; ``(position, score)``. An atom weighs 1."""
    fixed = w.base * c["base"] + w.directness * c["directness"] + w.polarity * c["polarity"] - w.background * c["background"]
    covered: set = set()
    sources, duplicates, out, left = Counter(), Counter(), [], list(range(len(c)))
    while left and len(out) < k:
        def value(i: int) -> float:
            new = len(set(c["atoms"][i]) - covered)
            dup = duplicates[c["dup"][i]] if c["dup"][i] else 0
            return round(float(fixed[i]) + w.coverage * new - w.duplicate * dup - w.source * sources[c["source"][i]], 9)

        best = max(left, key=lambda i: (value(i), -i))
        out.append((best, value(best)))
        left.remove(best)
        covered |= set(c["atoms"][best])
        sources[c["source"][best]] += 1
        if c["dup"][best]:
            duplicates[c["dup"][best]] += 1
    return out


def set_cover(atoms: list[list[str]], weights: dict[str, float], k: int) -> list[tuple[int, float]]:
    """Greedy weighted cover: ``(position, gain)`` while something new is covered; ties to the earlier candidate."""
    covered: set = set()
    out: list[tuple[int, float]] = []
    while len(out) < k:
        gains = [(round(sum(weights.get(a, 1.0) for a in set(atoms[i]) - covered), 9), -i) for i in range(len(atoms)) if i not in [x for x, _ in out]]
        if not gains or max(gains)[0] <= 0:
            break
        gain, i = max(gains)
        out.append((-i, gain))
        covered |= set(atoms[-i])
    return out


def minimal_group(atoms: list[list[str]], chosen: list[int]) -> list[int]:
    """The chosen without those whose atoms the others cover, dropped from the last."""
    keep = list(chosen)
    for i in reversed(chosen):
        if set(atoms[i]) <= {a for j in keep if j != i for a in atoms[j]}:
            keep.remove(i)
    return keep


def factions(sim: np.ndarray, threshold: float, least: int, most: int) -> list[list[int]]:
    """Single-link clusters met in order of rank, joined down to ``most`` and split up to ``least``."""
    clusters: list[list[int]] = []
    link = lambda a, b: float(sim[np.ix_(a, b)].max())
    for i in range(len(sim)):
        near = max(range(len(clusters)), key=lambda c: (link([i], clusters[c]), -c), default=None)
        if near is not None and link([i], clusters[near]) >= threshold:
            clusters[near].append(i)
        else:
            clusters.append([i])
    while len(clusters) > max(1, most):
        a, b = max(itertools.combinations(range(len(clusters)), 2), key=lambda p: (link(clusters[p[0]], clusters[p[1]]), -p[0], -p[1]))
        clusters[a] += clusters.pop(b)
    while len(clusters) < min(least, len(sim)):
        big = max(clusters, key=len)
        if len(big) == 1:
            break
        out = min(big, key=lambda i: (sim[i, [j for j in big if j != i]].mean(), -i))
        big.remove(out)
        clusters.append([out])
    return sorted(sorted(c) for c in clusters)


def one_per_faction(clusters: list[list[int]], k: int) -> list[int]:
    """The first of each cluster, then the others by rank."""
    heads = [c[0] for c in clusters][:k]
    return heads + [i for i in sorted(i for c in clusters for i in c) if i not in heads][: k - len(heads)]


# The state a relation speaks for, and what each kind of step counts.
STATE_OF = {"support": "S", "refute": "R", "qualify": "Q", "mixed": "Q"}
STEP_VALUE = {"OPEN": 100.0, "CONTRAST": 80.0, "CORROBORATE": 35.0, "BRIDGE": 10.0, "FALLBACK": 0.0}
WEAK = {"none", "context", ""}


def transition(state: str, relation: str, directness: str) -> tuple[str, str]:
    """``(step, new state)`` of an atom in state U, S, R, Q or C when it meets an evidence of a relation.

    An open atom takes the evidence's side; the other side, or a qualification, is a contrast; the same side corroborates;
    weak evidence that takes no side bridges.
    """
    side = STATE_OF.get(relation, "U")
    if side == "U":
        return ("BRIDGE", state) if directness in WEAK else ("FALLBACK", state)
    if state == "U":
        return "OPEN", side
    if side == "Q":
        return "CONTRAST", "Q"
    if side == state:
        return "CORROBORATE", state
    return ("CONTRAST", "C") if state in "SR" else ("FALLBACK", state)


def resolved(states: dict[str, str]) -> float:
    return sum(s != "U" for s in states.values()) / len(states) if states else 0.0


class ChainStep(NamedTuple):
    at: int
    atom: str
    step: str
    before: str
    after: str
    utility: float


def resolving_chain(c: Pool, atoms: dict[str, float], target: float = 0.8, least: int = 0, most: int = 10, budget: int | None = None, contrast_after: bool = False) -> tuple[list[ChainStep], dict[str, str], str]:
    """Chain of evidence that resolves the claim's atoms: at each step the transition of greatest utility.

    Utility: value of the step, 10 x the atom's weight, the evidence's quality and 0.1 x its base score. Evidence of a
    duplicate group or a text already used is left out. Stops when ``target`` of the atoms is resolved (then only missing
    steps up to ``least``, or contrasts if asked for, are added), at ``most`` steps, or when nothing fits.
    """
    states = dict.fromkeys(atoms, "U")
    steps: list[ChainStep] = []
    used, dups, texts, spent = set(), set(), set(), 0
    reason = "max_steps"
    while len(steps) < most:
        met = resolved(states) >= target
        if met and len(steps) >= least and not contrast_after:
            reason = "target_resolved"
            break
        options, too_dear = [], False
        for i in range(len(c)):
            if i in used or (c["dup"][i] and c["dup"][i] in dups) or c["key"][i] in texts:
                continue
            found = []
            for a in c["atoms"][i]:
                if a in states:
                    step, after = transition(states[a], c["relation"][i], c["directness_name"][i])
                    if step != "FALLBACK":
                        found.append((STEP_VALUE[step] + 10 * atoms[a] + c["quality"][i] + 0.1 * c["base"][i], a, step, after))
            if met and len(steps) >= least:
                found = [f for f in found if f[2] == "CONTRAST"]
            if not found:
                continue
            if budget is not None and spent + c["cost"][i] > budget:
                too_dear = True
                continue
            u, a, step, after = min(found, key=lambda f: (-round(f[0], 9), f[1]))
            options.append((-round(u, 9), i, a, step, after))
        if not options:
            reason = "token_budget" if too_dear else "target_resolved" if met else "no_transition"
            break
        u, i, a, step, after = min(options)
        steps.append(ChainStep(i, a, step, states[a], after, -u))
        states[a] = after
        used.add(i)
        texts.add(c["key"][i])
        spent += int(c["cost"][i])
        if c["dup"][i]:
            dups.add(c["dup"][i])
    return steps, states, reason


#: Weights of the marginal features; costs are taken off. All are non-negative.
MARGINAL = {"new_atoms": 1.0, "resolves": 1.0, "contrast": 0.6, "corroborates": 0.3, "directness": 0.5, "polarity": 0.4, "quality": 0.4, "confidence": 0.2, "base": 0.3, "new_source": 0.2, "duplicate": 0.8, "background": 0.5}
COSTS = ("duplicate", "background")


def marginal_features(c: Pool, i: int, covered: set, states: dict[str, str], sources: set, dups: set) -> dict[str, float]:
    atoms = [a for a in c["atoms"][i] if a in states]
    moves = [transition(states[a], c["relation"][i], c["directness_name"][i])[0] for a in atoms]
    n = max(1, len(states))
    return {
        "new_atoms": len(set(atoms) - covered) / n,
        "resolves": moves.count("OPEN") / n,
        "contrast": moves.count("CONTRAST") / n,
        "corroborates": moves.count("CORROBORATE") / n,
        "directness": c["directness"][i],
        "polarity": c["polarity"][i],
        "quality": c["quality"][i],
        "confidence": c["confidence"][i],
        "base": c["base"][i],
        "new_source": float(c["source"][i] not in sources),
        "duplicate": float(bool(c["dup"][i]) and c["dup"][i] in dups),
        "background": c["background"][i],
    }


def marginal_greedy(c: Pool, atoms: dict[str, float], weights: dict[str, float] | None = None, least: int = 1, most: int = 8, stop: float = 0.6) -> list[tuple[int, float]]:
    """Greedy on weighted marginal features; after ``least`` steps it stops when the best utility is at most ``stop``."""
    weights = MARGINAL if weights is None else weights
    states, covered, sources, dups, out = dict.fromkeys(atoms, "U"), set(), set(), set(), []
    while len(out) < min(most, len(c)):
        taken = {i for i, _ in out}
        value = {}
        for i in range(len(c)):
            if i not in taken:
                f = marginal_features(c, i, covered, states, sources, dups)
                value[i] = round(sum((-1 if k in COSTS else 1) * weights.get(k, 0.0) * v for k, v in f.items()), 9)
        best = max(value, key=lambda i: (value[i], -i))
        if len(out) >= least and value[best] <= stop:
            break
        out.append((best, value[best]))
        for a in c["atoms"][best]:
            if a in states:
                states[a] = transition(states[a], c["relation"][best], c["directness_name"][best])[1]
                covered.add(a)
        sources.add(c["source"][best])
        if c["dup"][best]:
            dups.add(c["dup"][best])
    return out


def budget_value(c: Pool, chain: Sequence[int], total: int) -> float:
    """Coverage of ``total`` atoms, mean quality, and newly covered atoms between pairs that are no duplicates."""
    atoms = [set(c["atoms"][i]) for i in chain]
    ties = []
    for (i, a), (j, b) in itertools.combinations(zip(chain, atoms), 2):
        same = c["key"][i] == c["key"][j] or (c["dup"][i] and c["dup"][i] == c["dup"][j])
        ties.append(-1.0 if same else 0.45 + 0.55 * len(a ^ b) / len(a | b) if a and b and a != b else 0.0)
    return round(len(set().union(*atoms)) / total + 0.5 * float(np.mean([c["quality"][i] for i in chain])) + 0.25 * (sum(ties) / len(ties) if ties else 0.0), 9)


def rule_steps(c: Pool, least: int = 5, most: int = 10) -> list[tuple[int, str]]:
    """Rule by rule: evidence for an atom not covered yet (P1), then the other side of a covered one (P2), then by quality (P3) up to ``least``."""
    covered, sides, out = set(), {}, []
    while len(out) < min(most, len(c)):
        left = [i for i in range(len(c)) if i not in [x for x, _ in out]]
        side = lambda i: STATE_OF.get(c["relation"][i], "U")
        new = [i for i in left if set(c["atoms"][i]) - covered and side(i) != "U"]
        other = [i for i in left if side(i) != "U" and any(a in sides and side(i) not in sides[a] for a in c["atoms"][i])]
        rule, options = ("P1", new) if new else ("P2", other) if other else ("P3", left if len(out) < least else [])
        if not options:
            break
        best = max(options, key=lambda i: (len(set(c["atoms"][i]) - covered) if rule == "P1" else 0, round(c["quality"][i], 9), -i))
        out.append((best, rule))
        covered |= set(c["atoms"][best])
        for a in c["atoms"][best]:
            sides.setdefault(a, set()).add(side(best))
    return out


def sufficiency_chain(c: Pool, atoms: dict[str, float], important: float = 0.5, target: float = 0.8, most: int = 10) -> tuple[list[int], float, bool]:
    """Cover the important atoms to ``target`` of their weight, then add one evidence that contradicts; ``(chosen, covered share, contradicted)``."""
    weight = {a: w for a, w in atoms.items() if w >= important}
    total = sum(weight.values()) or 1.0
    chosen = [i for i, _ in set_cover([[a for a in x if a in weight] for x in c["atoms"]], weight, most)]
    done: list[int] = []
    share = 0.0
    for i in chosen:
        done.append(i)
        share = sum(weight[a] for a in {a for j in done for a in c["atoms"][j] if a in weight}) / total
        if share >= target:
            break
    sides = {STATE_OF.get(c["relation"][i], "U") for i in done} & {"S", "R"}
    against = [i for i in range(len(c)) if i not in done and sides and STATE_OF.get(c["relation"][i], "U") in {"S", "R"} - sides]
    if against and len(done) < most:
        done.append(max(against, key=lambda i: (round(c["quality"][i], 9), -i)))
    return done, round(share, 9), bool(against) or sides == {"S", "R"}


def budgeted_chain(c: Pool, most: int = 8, enough: float = 0.8, stop: float = 0.1, stop_early: float = 0.05) -> list[tuple[int, float]]:
    """Greedy on the gain of ``budget_value``; stops at a gain below ``stop`` once ``enough`` is covered, else below ``stop_early``."""
    total = max(1, len({a for x in c["atoms"] for a in x}))
    out: list[tuple[int, float]] = []
    value = 0.0
    while len(out) < min(most, len(c)):
        chain = [i for i, _ in out]
        gains = {i: round(budget_value(c, [*chain, i], total) - value, 9) for i in range(len(c)) if i not in chain}
        best = max(gains, key=lambda i: (gains[i], -i))
        covered = len({a for i in chain for a in c["atoms"][i]}) / total
        if out and gains[best] < (stop if covered >= enough else stop_early):
            break
        out.append((best, gains[best]))
        value += gains[best]
    return out


def atom_order(c: Pool, atoms: list[str], least: int = 5) -> list[tuple[int, str, str]]:
    """For each atom in order its best evidence not used yet, then the best of the other side; filled up to ``least`` by rank: ``(position, atom, role)``."""
    used: list[int] = []
    out: list[tuple[int, str, str]] = []
    for a in atoms:
        options = [i for i in range(len(c)) if i not in used and a in c["atoms"][i]]
        if not options:
            continue
        first = max(options, key=lambda i: (round(c["quality"][i], 9), -i))
        side = STATE_OF.get(c["relation"][first], "U")
        out.append((first, a, "primary"))
        used.append(first)
        other = [i for i in options if i != first and side in ("S", "R") and STATE_OF.get(c["relation"][i], "U") in {"S", "R"} - {side}]
        if other:
            second = max(other, key=lambda i: (round(c["quality"][i], 9), -i))
            out.append((second, a, "opposing"))
            used.append(second)
    for i in range(len(c)):
        if len(out) >= least:
            break
        if i not in used:
            out.append((i, "", "fallback"))
            used.append(i)
    return out


def constrained_likelihood(score: Sequence[float], source: Sequence[str], stance: Sequence[str], anchors: int, k: int, source_penalty: float = 0.1, stance_penalty: float = 0.05) -> list[int]:
    """The first ``anchors`` by rank are kept; the rest is filled greedily by score less penalties for sources and stances already held."""
    chosen = list(range(min(anchors, k, len(score))))
    while len(chosen) < min(k, len(score)):
        sources, stances = Counter(source[i] for i in chosen), Counter(stance[i] for i in chosen)
        left = [i for i in range(len(score)) if i not in chosen]
        chosen.append(max(left, key=lambda i: (round(score[i] - source_penalty * sources[source[i]] - stance_penalty * stances[stance[i]], 9), -i)))
    return chosen


def state_budget(costs: Sequence[int], states: Sequence[float], budget: int, patience: int = 2) -> int:
    """Length of the prefix to keep: within the budget, and no further than ``patience`` items after the state last improved."""
    spent, best, keep = 0, 0.0, 0
    for i, (cost, state) in enumerate(zip(costs, states)):
        spent += cost
        if spent > budget:
            break
        if state > best or i == 0:
            best, keep = max(best, state), i + 1
        elif i + 1 - keep > patience:
            break
    return keep


def sensitivity_gate(score: np.ndarray, sim: np.ndarray, k: int, low: float = 0.3, base: float = 0.7, high: float = 1.0, change: float = 0.3, redundant: float = 0.2, floor: float = 0.5) -> tuple[float, float, float]:
    """``(lambda, sensitivity, redundancy)``: the low lambda where the choice depends on it, the top is redundant and relevance holds."""
    if len(score) <= k:
        return base, 0.0, 0.0
    return gate(score, sim, *(mmr(score, sim, k, x) for x in (low, base, high)), low, base, change, redundant, floor)


def gate(score: np.ndarray, sim: np.ndarray, at_low: list[int], at_base: list[int], at_high: list[int], low: float = 0.3, base: float = 0.7, change: float = 0.3, redundant: float = 0.2, floor: float = 0.5) -> tuple[float, float, float]:
    """``sensitivity_gate`` from what each lambda chose."""
    apart = lambda a, b: 1 - len(set(a) & set(b)) / len(set(a) | set(b))
    sensitivity = max(apart(at_low, at_base), apart(at_low, at_high))
    redundancy = float(np.mean([sim[i, j] for i, j in itertools.combinations(at_high, 2)])) if len(at_high) > 1 else 0.0
    holds = score[at_low].mean() >= floor * max(score[at_high].mean(), 1e-12)
    return (low if sensitivity >= change and redundancy >= redundant and holds else base), round(sensitivity, 9), round(redundancy, 9)


def greedy_set(n: int, k: int, value: Callable[[tuple[int, ...]], float]) -> tuple[int, ...]:
    """Grown one item at a time by the value of the whole set; ties to the earlier item."""
    chosen: tuple[int, ...] = ()
    while len(chosen) < min(k, n):
        chosen = max((tuple(sorted((*chosen, i))) for i in range(n) if i not in chosen), key=lambda s: (value(s), [-i for i in s]))
    return chosen


def exhaustive_set(n: int, k: int, value: Callable[[tuple[int, ...]], float]) -> tuple[int, ...]:
    return max(itertools.combinations(range(n), min(k, n)), key=lambda s: (value(s), [-i for i in s]))


def beam_set(n: int, k: int, value: Callable[[tuple[int, ...]], float], width: int) -> tuple[int, ...]:
    level: list[tuple[int, ...]] = [()]
    for _ in range(min(k, n)):
        wider = {tuple(sorted((*s, i))) for s in level for i in range(n) if i not in s}
        level = sorted(wider, key=lambda s: (-value(s), s))[:width]
    return level[0]


def hashed_schedule(seed: int, steps: int, choices: Sequence[float]) -> list[float]:
    """Lambdas of each step picked by a hash of seed and step."""
    return [choices[zlib.crc32(f"{seed}|{i}".encode()) % len(choices)] for i in range(steps)]
