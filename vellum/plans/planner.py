"""Planning over a few summary rows, on the driver: slots, projects, bridges, wave modes and quotas."""

from __future__ import annotations

import math

# fixed values: shares of the slots beside projects, and of a creation wave
SHARES = {"bridges": 0.15, "unclassified": 0.10, "ambient": 0.05}
QUOTAS = {"evidence": 0.30, "concepts": 0.10, "entities": 0.20, "facts": 0.10}
CREATE_THRESHOLD, LEAST, MOST = 0.5, 1, 4


def split_slots(total: int) -> dict[str, int]:
    """project, bridges, unclassified and ambient slots; they sum to the total."""
    if total <= 1:
        return {"project": total, "bridges": 0, "unclassified": 0, "ambient": 0}
    if total <= 3:
        return {"project": total - 1, "bridges": 0, "unclassified": 0, "ambient": 1}
    out = {k: max(1, math.floor(v * total)) for k, v in SHARES.items()}
    return {"project": total - sum(out.values()), **out}


def distribute(scores: dict[str, float], slots: int) -> dict[str, int]:
    """Slots of the projects that get any, in proportion to scores above 0, one to four each.

    What rounding leaves over goes to the highest score with room, what it takes too many comes off the lowest one that has
    more than one; where no project has room the sum differs.  A single project gets all; without scores all share alike.
    """
    if not scores or slots <= 0:
        return {}
    active = {p: s for p, s in scores.items() if s > 0}
    if not active:
        each, rest = divmod(slots, len(scores))
        even = {p: each + (i < rest) for i, p in enumerate(sorted(scores))}
        return {p: n for p, n in even.items() if n}
    if len(active) == 1:
        return dict.fromkeys(active, slots)
    total = sum(active.values())
    out = {p: min(MOST, max(LEAST, round(slots * s / total))) for p, s in active.items()}
    left = slots - sum(out.values())
    # one project after the other takes all that it has room for
    for p in sorted(active, key=active.get, reverse=left > 0):
        change = min(left, MOST - out[p]) if left > 0 else max(left, LEAST - out[p])
        out[p], left = out[p] + change, left - change
    return out


def pick_bridges(pairs: list[dict], activity: dict[str, float], slots: int, archival: bool = False) -> list[dict]:
    """Pairs by the lesser activity of their projects; in archival mode strata of 40, 40 and 20 %, filled up from the rest."""
    def least(p: dict) -> float:
        return min((activity.get(x, 0.0) for x in [*p["projects_a"], *p["projects_b"]]), default=0.0)

    ordered = sorted(pairs, key=lambda p: (-least(p), p["page_a"], p["page_b"]))
    if not archival:
        return ordered[:slots]
    third = max(1, len(ordered) // 3)
    strata = [ordered[:third], ordered[third : 2 * third], ordered[2 * third :]]
    want = [round(slots * s) for s in (0.4, 0.4)]
    picked = [p for s, n in zip(strata, [*want, slots - sum(want)], strict=True) for p in s[: max(0, n)]][:slots]
    return picked + [p for p in ordered if p not in picked][: slots - len(picked)]


def allocate(scores: dict[str, float], worst: dict[str, list[str]], pairs: list[dict], unclassified: list[str], ambient: list[str], total: int, mode: str = "project") -> dict:
    """What a wave works on.  Slots that a part can't use go to the projects; no page is taken twice."""
    if mode == "global":
        return {"project": {}, "bridges": [], "unclassified": [], "ambient": ambient[:total]}
    slots = split_slots(total)
    bridges = pick_bridges(pairs, scores, slots["bridges"])
    loose = unclassified[: slots["unclassified"]]
    spare = slots["bridges"] - len(bridges) + slots["unclassified"] - len(loose)
    share = distribute(scores, slots["project"] + spare)
    taken = {p: worst.get(p, [])[:n] for p, n in share.items()}
    used = {x for v in taken.values() for x in v} | set(loose)
    return {"project": taken, "bridges": bridges, "unclassified": loose, "ambient": [x for x in ambient if x not in used][: slots["ambient"]]}


def wave_mode(summary: dict) -> str:
    """The first mode whose queue is open."""
    order = ["create", "table-audit", "figure-extract", "multimodal", "numeric-review", "wire"]
    return next((m for m in order if summary.get(m)), "repair")


def create_quotas(slots: int) -> dict[str, int]:
    out = {k: math.floor(v * slots) for k, v in QUOTAS.items()}
    return {**out, "analyses": slots - sum(out.values())}
