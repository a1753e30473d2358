"""Prediction scores as SQL expressions.

All scores come from sums, so they combine across any grouping without another
look at the rows. Nothing is rounded here; callers round what they show.
"""

from __future__ import annotations

SUMS = ("n", "scored", "sse", "sum_y", "sq_mean", "m2")


def moment_sums(label: str = "demand", prediction: str = "prediction") -> list[str]:
    """The mergeable aggregates ``SUMS`` of predicted rows.

    ``n`` counts the rows with a label. Rows without a prediction (their group
    had no training rows) are left out of the other sums. ``m2`` is the sum of
    squares around the group's mean and ``sq_mean`` is ``sum_y ^ 2 / scored``.
    """
    error = f"({prediction} - {label})"
    y = f"IF({prediction} IS NULL, NULL, CAST({label} AS DOUBLE))"
    return [
        f"count({label}) AS n",
        f"count({y}) AS scored",
        f"sum({error} * {error}) AS sse",
        f"sum({y}) AS sum_y",
        f"sum({y}) * sum({y}) / nullif(count({y}), 0) AS sq_mean",
        f"var_pop({y}) * count({y}) AS m2",
    ]


def sums_from_powers(n: str, sse: str, sum_y: str, sum_y2: str) -> list[str]:
    """``SUMS`` from power sums of integer labels, all rows predicted."""
    squared = f"CAST({sum_y} AS DOUBLE) * {sum_y} / nullif({n}, 0)"
    return [
        f"{n} AS n", f"{n} AS scored", f"{sse} AS sse", f"CAST({sum_y} AS DOUBLE) AS sum_y",
        f"{squared} AS sq_mean", f"greatest({sum_y2} - {squared}, 0D) AS m2",
    ]


def score_columns() -> list[str]:
    """``rmse`` and ``r2`` from columns named as in ``SUMS``.

    R2 is NULL where the label is constant. Variance within the summed groups
    counts however small it is; the variance between them is a difference of
    large sums, so what is no more than its rounding noise counts as none.
    """
    between = "(sq_mean - sum_y * sum_y / nullif(scored, 0))"
    sst = f"(m2 + IF({between} > sq_mean * 1e-12D, {between}, 0D))"
    return [
        "sqrt(greatest(sse, 0D) / nullif(scored, 0)) AS rmse",
        f"CASE WHEN {sst} > 0 THEN 1D - sse / {sst} END AS r2",
    ]
