"""Closed-form least squares from moment sums, rendered as SQL expressions.

A regression with k regressors needs only the sums m_ij = Σ x_i·x_j, v_i = Σ x_i·y, Σ y² and n,
which Spark computes in one partial/final hash aggregate per key.  Coefficients follow from
Cramer's rule and standard errors from the cofactors; both are plain expressions over those
sums, so the same text runs in Spark (``F.expr``) and in the DuckDB oracle.
"""

from __future__ import annotations

from itertools import permutations


def _det(m: list[list[str]]) -> str:
    """Determinant of a small symbolic matrix (Leibniz expansion; k <= 4)."""
    k = len(m)
    if k == 1:
        return f"({m[0][0]})"
    terms = []
    for p in permutations(range(k)):
        inv = sum(1 for i in range(k) for j in range(i + 1, k) if p[i] > p[j])
        prod = " * ".join(f"({m[i][p[i]]})" for i in range(k))
        terms.append(("- " if inv % 2 else "+ ") + prod)
    return "(" + " ".join(terms) + ")"


def moment_names(k: int, prefix: str = "m") -> tuple[list[list[str]], list[str], str, str]:
    xx = [[f"{prefix}_xx_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]
    xy = [f"{prefix}_xy_{i}" for i in range(k)]
    return xx, xy, f"{prefix}_yy", f"{prefix}_n"


def moment_aggs(xs: list[str], y: str, prefix: str = "m") -> list[tuple[str, str]]:
    """(name, SQL of a row's term) pairs for the raw moment sums of regressors ``xs`` and target ``y``."""
    k = len(xs)
    out = []
    for i in range(k):
        for j in range(i, k):
            out.append((f"{prefix}_xx_{i}_{j}", f"({xs[i]}) * ({xs[j]})"))
    for i in range(k):
        out.append((f"{prefix}_xy_{i}", f"({xs[i]}) * ({y})"))
    out.append((f"{prefix}_yy", f"({y}) * ({y})"))
    out.append((f"{prefix}_n", "1"))
    return out


def centred_aggs(xs: list[str], y: str, prefix: str = "m") -> list[tuple[str, str]]:
    """(name, SQL aggregate) pairs for moment sums about the means, i.e. of a regression with a constant,
    which is left out of ``xs``.  ``covar_pop`` merges centred sums, so a high level costs no digits."""
    about = lambda a, b: f"covar_pop({a}, {b}) * count({a})"
    k = len(xs)
    out = [(f"{prefix}_xx_{i}_{j}", about(xs[i], xs[j])) for i in range(k) for j in range(i, k)]
    out += [(f"{prefix}_xy_{i}", about(xs[i], y)) for i in range(k)]
    return out + [(f"{prefix}_yy", about(y, y)), (f"{prefix}_n", f"count({y})")]


def ols_exprs(k: int, prefix: str = "m", used: int | None = None) -> dict[str, str]:
    """SQL expressions over the moment sums: ``beta_i``, ``var_i`` (σ²·(XᵀX)⁻¹_ii), ``t_i``, ``rss``,
    ``s2`` and ``inv_i_j``.  ``used`` is the number of coefficients estimated (k, or more with centred sums);
    a variance that rounding leaves at 0 or below has no t."""
    xx, xy, yy, n = moment_names(k, prefix)
    det = f"nullif({_det(xx)}, 0)"
    out = {}
    for i in range(k):
        mi = [[xy[r] if c == i else xx[r][c] for c in range(k)] for r in range(k)]
        out[f"beta_{i}"] = f"({_det(mi)} / {det})"
        for j in range(k):
            minor = [[xx[r][c] for c in range(k) if c != i] for r in range(k) if r != j]
            out[f"inv_{i}_{j}"] = f"({'-' if (i + j) % 2 else ''}{_det(minor) if minor else '1'} / {det})"
    out["rss"] = f"({yy} - (" + " + ".join(f"{out[f'beta_{i}']} * {xy[i]}" for i in range(k)) + "))"
    out["s2"] = f"({out['rss']} / nullif({n} - {used or k}, 0))"
    for i in range(k):
        var = out[f"var_{i}"] = f"({out['s2']} * {out[f'inv_{i}_{i}']})"
        out[f"t_{i}"] = f"({out[f'beta_{i}']} / sqrt(CASE WHEN {var} > 0 THEN {var} END))"
    return out


# MacKinnon (2010) response-surface coefficients for the 5% critical value of the
# Dickey-Fuller tau statistic with one variable; crit = b0 + b1/T + b2/T^2 + b3/T^3.
ADF_CRIT_5PCT = {
    "n": (-1.94100, -0.2686, -3.365, 31.223),
    "c": (-2.86154, -2.8903, -4.234, -40.040),
    "ct": (-3.41049, -4.3904, -9.036, -45.374),
}


def adf_crit_5pct_sql(regression: str, nobs: str) -> str:
    b0, b1, b2, b3 = ADF_CRIT_5PCT[regression]
    return f"({b0} + ({b1}) / {nobs} + ({b2}) / pow({nobs}, 2) + ({b3}) / pow({nobs}, 3))"
