"""Check lists: lines of the user's directive language as rows.

A line is ``text & code,level,{flags,V=value,F=frequency,R=record,R=first-last,var,...}``; the flags are D (discard) and
EM (e-mail). Braces inherit: what stands beside them belongs to each
group inside. Lists are a few hundred lines in a driver file; their rows are joined as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "code string, var string, level int, discard boolean, values array<string>, text string, freqs array<string>, records array<struct<lo:bigint,hi:bigint>>, email boolean"


def expand(line: str, outer: tuple[str, ...] | None = None) -> list[tuple[str, ...]]:
    """The item sets of a brace line: the line's own items, and those of each group with all that surrounds it.

    An item ``name=value`` of a group takes the place of an outer one of the same name; ``D(x)`` in a group drops the
    item ``x``, or the one named ``x``, that it would inherit. A group without items of its own gives no set.
    """
    own, groups, depth, word, inner = [], [], 0, "", ""
    for c in line + ",":
        if depth:
            depth += (c == "{") - (c == "}")
            if depth:
                inner += c
            else:
                groups.append(inner)
                inner = ""
        elif c in "{,":
            if word:
                own.append(word)
            word, depth = "", int(c == "{")
        else:
            word += c
    mine = _settled(outer or (), own)
    return ([mine] if own or outer is None else []) + [x for g in groups for x in expand(g, mine)]


def _settled(outer, items) -> tuple[str, ...]:
    """``items`` and what they inherit of ``outer``: neither what they drop nor what they give another value."""
    gone = {x[2:-1] for x in items if x.startswith("D(") and x.endswith(")")}
    mine = [x for x in items if not (x.startswith("D(") and x.endswith(")"))]
    named = {x.split("=", 1)[0] for x in mine if "=" in x}
    kept = [x for x in outer if x not in gone and x.split("=", 1)[0] not in gone | (named if "=" in x else set()) and x not in mine]
    return (*kept, *mine)


def _records(item: str, line: str) -> tuple[int, int]:
    """The first and last record of ``5`` or ``5-10``."""
    lo, dash, hi = item.partition("-")
    try:
        return int(lo), int(hi if dash else lo)
    except ValueError:
        raise ValueError(f"no records: R={item} in {line!r}") from None


def directives(lines: list[str]) -> list[tuple]:
    """Rows of SCHEMA; lines without ``&`` and comments are skipped; the level is 1 unless L1 to L4 is among the items."""
    rows = []
    for line in lines:
        line = line.split("#", 1)[0].strip()
        if "&" not in line:
            continue
        text, _, rest = (x.strip() for x in line.partition("&"))
        code, _, items = rest.partition(",")
        for group in expand(items):
            level, discard, email, values, freqs, records, names = 1, False, False, [], [], [], []
            for x in (i.strip() for i in group):
                if len(x) == 2 and x[0] == "L" and x[1] in "1234":
                    level = int(x[1])
                elif x == "D":
                    discard = True
                elif x == "EM":
                    email = True
                elif x.startswith("V="):
                    values.append(x[2:])
                elif x.startswith("F="):
                    freqs.append(x[2:])
                elif x.startswith("R="):
                    records.append(_records(x[2:], line))
                elif x:
                    names.append(x)
            rows += [(code.strip(), v, level, discard, values or None, text, freqs or None, records or None, email) for v in names or ["*"]]
    return rows


def parse(lines: list[str]) -> list[tuple]:
    """The rows without their last three columns; lines that need one of these are refused."""
    rows = directives(lines)
    if any(r[6] or r[7] or r[8] for r in rows):
        raise ValueError("frequencies, records and e-mail need directives()")
    return [r[:6] for r in rows]


def check_list(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(directives(lines), SCHEMA)
