"""Comparisons and evaluations as text or JSON. Rows come from `compare.compare` and `evaluate.evaluate`."""

from __future__ import annotations

from .functions.canonical import canonical_json
from .operators.calibration import ENGINES
from .schemas import ContractError

#: What every report says.
BANNER = "Decision support only. Requires human review."
HEURISTIC = "Combined score is a review-prioritization heuristic, not a probability."
EVALUATION_HEURISTIC = "Combined metrics describe a review-prioritization heuristic, not a probability."


def _number(x, digits: int = 6) -> str:
    return "—" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def _grid(rows: list[tuple]) -> list[str]:
    cells = [[_number(x) for x in r] for r in rows]
    wide = [max(map(len, c)) for c in zip(*cells)]
    line = "+".join(["", *("-" * (w + 2) for w in wide), ""])
    return [line, *("| " + " | ".join(x.ljust(w) for x, w in zip(r, wide)) + " |" for r in cells), line]


def comparison(row: dict, form: str = "table") -> str:
    """One compared pair, the banner first."""
    if form == "json":
        return f"{BANNER}\n{canonical_json({**row, 'banner': BANNER}).decode()}"
    if form != "table":
        raise ContractError("output_format")
    of = lambda c: tuple(row.get(f"{e}_{c}") for e in ENGINES)
    alone = lambda name, c: (name, None, None, None, row.get(c))
    rows = [
        ("Field", *(e.capitalize() for e in ENGINES), "Combined"), ("Status", *of("status"), row.get("status")), ("Raw cosine", *of("cosine"), None), ("Known-different baseline percentile", *of("percentile"), None),
        ("Sanitized error", *of("error"), row.get("error")), alone("Combined score (heuristic)", "combined_score"), alone("Weighted percentile", "weighted_percentile"),
        alone("Fisher tail score (heuristic)", "fisher_tail_score"), alone("Active engines", "active_engines"),
    ]
    who = f"Flagged account: {canonical_json(row['a']).decode()} | Suspect account: {canonical_json(row['b']).decode()}"
    return "\n".join([BANNER, who, *_grid(rows), HEURISTIC])


def evaluation(rows: list[dict], form: str = "table") -> str:
    """The rows of one evaluation, an engine each."""
    if form == "json":
        return canonical_json(rows).decode()
    if form != "table":
        raise ContractError("output_format")
    names = ("engine", "roc_auc", "pr_auc", "precision", "recall", "support_same", "support_different", "n_excluded", "threshold", "met")
    return "\n".join([*_grid([names, *(tuple(r[c] for c in names) for r in rows)]), EVALUATION_HEURISTIC])
