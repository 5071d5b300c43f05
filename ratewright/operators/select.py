"""Choice of tables to keep: floors of variance share, prefixes of a ranked path, supports and their supersets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

Support = frozenset[str]


def kept_by_share(variances: dict[Support, float], least: float, keep_mains: bool = True) -> set[Support]:
    """Supports with at least ``least`` of the summed variance (and main effects), and all their subsets."""
    total = sum(max(v, 0.0) for v in variances.values())
    if not least > 0 or not total > 0:
        return set(variances)
    strong = [u for u, v in variances.items() if max(v, 0.0) / total >= least or (keep_mains and len(u) == 1)]
    return {u for u in variances if any(u <= s for s in strong)}


def maximal(supports: Iterable[Support]) -> set[Support]:
    """Supports that are no proper subset of another."""
    every = set(supports)
    return {u for u in every if not any(u < other for other in every)}


def chosen_prefix(deviances: Sequence[float], fraction: float = 1.0, tolerance: float = 0.0) -> int:
    """The first place on a path with ``fraction`` of the best fall of the deviance and within ``tolerance`` of the best."""
    best = min(range(len(deviances)), key=deviances.__getitem__)
    fall = deviances[0] - deviances[best]
    if not fall > 0 or fraction >= 1:
        return best
    near = (1 + tolerance) * deviances[best]
    return next(i for i in range(len(deviances)) if any(deviances[0] - d >= fraction * fall for d in deviances[: i + 1]) and any(d <= near for d in deviances[: i + 1]))


def _below(u: Support) -> list[Support]:
    return [u - {f} for f in u]


def _in_order(u: Support) -> list[str]:
    return sorted(u)


def ranked_sequence(variances: dict[Support, float], steps: int, prune_mains: bool = False) -> tuple[list[Support], list[Support], list[int]]:
    """Main effects that always stay, the order in which the other tables enter, and the prefixes of it to try.

    The greatest variance enters first, names break ties.  A table of three or more features waits until all tables
    with one feature less are in, and never enters without them.  With ``prune_mains``, main effects have ranks too,
    and enter before the first table that needs them.  The sizes are a geometric grid of about ``steps`` from 0 to all.
    """
    mains = sorted((u for u in variances if len(u) == 1), key=_in_order)
    stay = [] if prune_mains else mains
    ranked = sorted((u for u in variances if u not in stay), key=lambda u: (-variances[u], _in_order(u)))
    inside, path, waiting = set(stay), [], []
    for u in ranked:
        waiting.append(u)
        while ready := next((v for v in waiting if len(v) < 3 or all(b in inside for b in _below(v))), None):
            waiting.remove(ready)
            needed = [frozenset([f]) for f in _in_order(ready)] if len(ready) > 1 else []
            new = [v for v in [*needed, ready] if v in variances and v not in inside]
            inside.update(new)
            path += new
    grid = {round(len(path) ** (k / (max(steps, 2) - 1))) for k in range(max(steps, 2))} if path else set()
    return stay, path, sorted({0, len(path)} | grid)


def voted(votes: dict[Support, tuple[float, bool, bool]], supports: Iterable[Support], budget: int, prune_mains: bool = False) -> set[Support]:
    """The tables to keep: mean gain, first and second verdict of each (``ensemble.fold_votes``).

    Tables kept by the second verdict alone come in by falling mean gain while there are fewer than ``budget``.  A table
    then goes if one of its parts of two or more features is gone; main effects of the others come back.
    """
    every = set(supports)
    kept = {u for u in every if len(u) == 1 and not prune_mains} | {u for u, (_, first, _) in votes.items() if first}
    extra = sorted((u for u, (_, first, second) in votes.items() if second and not first and u not in kept), key=lambda u: (-votes[u][0], _in_order(u)))
    kept |= set(extra[: max(0, budget - len(kept))])
    while lost := {u for u in kept if any(len(b) > 1 and b not in kept for b in _below(u))}:
        kept -= lost
    return {u for u in every if any(u <= k for k in kept)}
