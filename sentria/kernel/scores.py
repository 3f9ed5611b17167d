"""Boundary scores of two sentence lists, for single rows; ``operators.scoring`` has them for tables."""

from __future__ import annotations

from itertools import accumulate


def boundary_f1(pred: list[str] | None, gold: list[str] | None) -> float | None:
    """F1 of the inner boundaries, white space aside; null where the characters differ."""
    if pred is None or gold is None:
        return None
    p, g = ([len("".join((s or "").split())) for s in x] for x in (pred, gold))
    if "".join("".join(s.split()) for s in pred if s) != "".join("".join(s.split()) for s in gold if s):
        return None
    a, b = set(accumulate(p[:-1])), set(accumulate(g[:-1]))
    precision = len(a & b) / len(a) if a else 1.0
    recall = len(a & b) / len(b) if b else 1.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 1.0
