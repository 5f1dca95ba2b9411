"""SQL text fragments for the DuckDB oracle strings (same formulas as
``functions.expr``, written as plain SQL)."""

from __future__ import annotations

from ..functions.expr import AS_A, AS_P
from .panel import FIRM_PANEL_SQL, ORDER_PANEL_SQL


def p_value(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + {AS_P} * {x}))"
    poly = f"{AS_A[-1]}"
    for a in reversed(AS_A[:-1]):
        poly = f"({poly} * {t} + {a})"
    return f"({poly} * {t} * exp(-({x} * {x})))"


def finish(ate: str = "ate", se: str = "se") -> str:
    """Columns ci_lower, ci_upper, z, p_value, effect_pct as a select list."""
    z = f"({ate} / nullif({se}, 0))"
    return (f"{ate} - 1.96 * {se} as ci_lower, {ate} + 1.96 * {se} as ci_upper, {z} as z, "
            f"{p_value(z)} as p_value, 100.0 * (exp({ate}) - 1.0) as effect_pct")


def r(expr: str, d: int = 6) -> str:
    return f"round({expr}, {d})"


def with_panel(body_ctes: str = "", final: str = "") -> str:
    """``with panel as (<fixture>) [, more ctes] <final select>``."""
    panel = FIRM_PANEL_SQL.strip()
    head = f"with panel as (\n{panel}\n)"
    if body_ctes:
        head += ",\n" + body_ctes
    return head + "\n" + final


def with_orders(body_ctes: str = "", final: str = "") -> str:
    head = f"with base as (\n{ORDER_PANEL_SQL.strip()}\n)"
    if body_ctes:
        head += ",\n" + body_ctes
    return head + "\n" + final
