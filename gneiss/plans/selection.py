"""Which rules are in the plan: check modes and options, for all variables or some.

An option is a row (option, var, value), var null for all. ``mode`` names the parts that are checked (``meta``, ``time``, ``data``), ``without`` a rule
that is switched off, ``only`` the rules that are left, ``clear_bits`` how many low bits of a variable's values count as noise. A rule that is switched off
for all variables is no part of the plan at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import bits

#: Most options that become part of the plan.
MOST_OPTIONS = 10_000
MODES = ("meta", "time", "data")


@dataclass
class Selection:
    """Options as they were read: modes, rules without, rules only, and cleared bits, by variable (None: all)."""

    modes: set[str] = field(default_factory=lambda: set(MODES))
    without: dict[str | None, set[str]] = field(default_factory=dict)
    only: dict[str | None, set[str]] = field(default_factory=dict)
    clear: dict[str | None, int] = field(default_factory=dict)

    @classmethod
    def of(cls, options: DataFrame) -> Selection:
        """``options`` (option, var, value); null options say nothing, an unknown one is an error."""
        rows = options.where("option is not null and value is not null").limit(MOST_OPTIONS + 1).collect()
        if len(rows) > MOST_OPTIONS:
            raise ValueError(f"more than {MOST_OPTIONS} options")
        out, modes = cls(), set()
        for option, var, value in sorted(((r["option"], r["var"], str(r["value"])) for r in rows), key=str):
            if option == "mode":
                modes |= {m for m in value.split(",") if m}
            elif option in ("without", "only"):
                getattr(out, option).setdefault(var, set()).update(x for x in value.split(",") if x)
            elif option == "clear_bits":
                out.clear[var] = int(value)
            else:
                raise ValueError(f"no option {option!r}")
        if modes - set(MODES):
            raise ValueError(f"no mode {sorted(modes - set(MODES))}")
        out.modes = modes or out.modes
        return out

    def rules(self, rules: dict[str, tuple[str, Column]]) -> dict[str, Column]:
        """Of ``rules`` (code: (mode, condition on a row that has ``var``)) those that are checked, each with the variables it isn't checked of.

        A variable's own list of rules takes the place of the list for all.
        """
        out = {}
        for code, (mode, condition) in rules.items():
            if mode not in self.modes or code in self.without.get(None, ()):
                continue
            off = [v for v, codes in self.without.items() if v is not None and code in codes]
            own = {v: code in codes for v, codes in self.only.items() if v is not None}
            general = None not in self.only or code in self.only[None]
            if not general and not any(own.values()):
                continue
            on = F.lit(general)
            for v, yes in sorted(own.items()):
                on = F.when(F.col("var") == v, F.lit(yes)).otherwise(on)
            out[code] = condition & on & (~F.coalesce(F.col("var").isin(*off), F.lit(False)) if off else F.lit(True))
        return out

    def cleared(self, value: Column) -> Column:
        """A double without the low bits that its variable's options call noise."""
        out = bits.clear_low_double_bits(value, self.clear[None]) if self.clear.get(None) else value
        for v, n in sorted((v, n) for v, n in self.clear.items() if v is not None):
            out = F.when(F.col("var") == v, bits.clear_low_double_bits(value, n) if n else value).otherwise(out)
        return out


def checked(rows: DataFrame, rules: dict[str, tuple[str, Column]], options: DataFrame) -> DataFrame:
    """``rows`` (var, ...) with ``code``, a row for each rule of the selection that fires."""
    chosen = Selection.of(options).rules(rules)
    found = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(c, F.lit(k)) for k, c in chosen.items()]))
    return rows.select("*", F.explode(found).alias("code"))
