"""Column expressions shared by the plans.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; none of them needs Python at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- predicates
def legal_ball(extras_type: str | Column = "extras_type") -> Column:
    """A delivery that counts as a ball faced (no wide, no no-ball).

    A missing ``extras_type`` is an ordinary ball.
    """
    e = _c(extras_type)
    return e.isin(*C.LEGAL_EXTRAS) | e.isNull()


def bowler_wicket(is_wicket: str | Column = "is_wicket",
                  kind: str | Column = "dismissal_kind") -> Column:
    """Wicket credited to the bowler: any dismissal but a run out.

    Three-valued: a wicket with a missing kind is not counted.
    """
    return (_c(is_wicket) == 1) & (_c(kind) != C.NOT_BOWLER_WICKET)


def dismissal_of(kind_value: str, is_wicket: str | Column = "is_wicket",
                 kind: str | Column = "dismissal_kind") -> Column:
    return (_c(is_wicket) == 1) & (_c(kind) == kind_value)


def faceoff_ball(keep_non_dismissals: bool,
                 kind: str | Column = "dismissal_kind") -> Column:
    """Balls that count in a batter-versus-bowler face-off.

    The five excluded kinds are never counted.  A ball with no dismissal has
    a missing kind: ``keep_non_dismissals=False`` drops it (three-valued
    ``!=``), ``True`` keeps it.
    """
    k = _c(kind)
    keep = ~k.isin(*C.FACEOFF_EXCLUDED_KINDS)
    return (keep | k.isNull()) if keep_non_dismissals else keep


def high_impact(total_runs: str | Column = "total_runs",
                is_wicket: str | Column = "is_wicket") -> Column:
    """True for a ball worth six or more runs or taking a wicket; never NULL."""
    return F.when((_c(total_runs) >= 6) | (_c(is_wicket) == 1), F.lit(True)).otherwise(F.lit(False))


# --------------------------------------------------------------- arithmetic
def phase(over: str | Column = "over") -> Column:
    """Four-over phase of a zero-based over: 0-3 -> 1, ..., 16-19 -> 5 (bigint)."""
    return F.ceil((_c(over) + 1) / C.OVERS_PER_PHASE)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL when ``den`` is 0 or NULL (never raises)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def per_over(mean: Column, digits: int = 2) -> Column:
    """Mean per ball scaled to a six-ball over, rounded."""
    return F.round(mean * C.BALLS_PER_OVER, digits)


# ---------------------------------------------------------------- mappings
def canonical(col: str | Column, aliases: Mapping[str, str]) -> Column:
    """Replace a known alias by its canonical name; other values pass through.

    The alias table is a literal map, so the lookup is a codegen'd expression:
    no join, no broadcast, no shuffle.  It is searched entry by entry for every
    row, which is right for the few dozen entries here; a table that grows
    belongs in a join.
    """
    c = _c(col)
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, c), c)


def raw_names(canonical_names: Iterable[str], aliases: Mapping[str, str]) -> list[str]:
    """Every raw value that canonicalises into ``canonical_names``.

    Lets a filter on canonical names run *before* canonicalisation, as a plain
    ``IN`` list that the parquet reader can push down.
    """
    wanted = set(canonical_names)
    out = [n for n in canonical_names if n not in aliases]
    out += [a for a, c in aliases.items() if c in wanted]
    return sorted(set(out))


# ------------------------------------------------------------ match labels
def win_margin_category(result: str | Column = "result",
                        margin: str | Column = "result_margin") -> Column:
    """The label of the highest step of ``constants.MARGINS`` that the margin
    reaches, by kind of result (case and space insensitive); else No Result."""
    kind, out = F.trim(F.lower(_c(result))), F.lit(C.NO_RESULT)
    for name, steps in C.MARGINS.items():
        label = F.lit(C.NO_RESULT)
        for step, least in sorted(steps.items(), key=lambda s: s[1]):      # the highest step reached wins
            label = F.when(_c(margin) >= least, F.lit(step)).otherwise(label)
        out = F.when(kind == name, label).otherwise(out)
    return out


def toss_match_winner(toss_winner: str | Column = "toss_winner",
                      winner: str | Column = "winner") -> Column:
    """"Yes" when the toss winner won the match (case/space-insensitive), else "No"."""
    same = F.trim(F.lower(_c(toss_winner))) == F.trim(F.lower(_c(winner)))
    return F.when(same, "Yes").otherwise("No")
