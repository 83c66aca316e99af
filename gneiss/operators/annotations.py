"""Findings and what becomes of them: directives, levels, locks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Most rows of a rule table that becomes part of the plan or goes to every task.
MOST_RULES = 10_000


def _few(rules: DataFrame) -> list:
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def resolved(findings: DataFrame, directives: DataFrame, limit: int = 4, record: str = "rec", freq: str = "freq") -> DataFrame:
    """Findings (code, var, level, ...) with the directive that governs each: the exact (code, var) before
    (code, *) before (*, var). Discarded findings go; the others get the directive's level, ``limit`` at most.

    Directives: (code, var, level, discard, values, freqs, records): '*' stands for any; a discard with ``values`` or ``freqs``
    holds only for findings whose ``value`` or ``freq`` is among them; one with ``records`` only for findings whose ``record`` is in
    one of these ranges, ends included; with both, for findings that meet both. A discard by frequencies or records
    that governs a finding raises where ``findings`` has no such column. Directives are few: those of a code and those of a
    variable are gathered, so that each finding has one partner at most and is chosen for in its own row.
    """
    rank = F.when(F.col("code") == "*", 3).when(F.col("var") == "*", 2).otherwise(1)
    d = directives.select("code", "var", F.struct(rank.alias("rank"), "level", F.col("var").alias("of"), "discard", "values", "freqs", "records").alias("d"))
    # codes and variables are hot keys of the findings: a check list of few rows goes to them
    near = F.broadcast if directives.limit(MOST_RULES + 1).count() <= MOST_RULES else lambda x: x
    by_code = near(d.where("code <> '*'").groupBy("code").agg(F.collect_list("d").alias("_by_code")))
    by_var = near(d.where("code = '*'").groupBy("var").agg(F.collect_list("d").alias("_by_var")))
    f = findings.join(by_code, "code", "left").join(by_var, "var", "left")
    none = F.array().cast(dict(by_var.dtypes)["_by_var"])
    mine = F.filter(F.coalesce("_by_code", none), lambda x: (x["of"] == F.col("var")) | (x["of"] == "*"))
    best = f.withColumn("_d", F.array_min(F.concat(mine, F.coalesce("_by_var", none))))
    known = lambda c: F.col(c) if c in findings.columns else F.raise_error(F.lit(f"a directive needs the column {c} of findings"))
    by_value = F.when(F.col("_d.values").isNotNull(), F.array_contains("_d.values", F.col("value")))
    by_freq = F.when(F.col("_d.freqs").isNotNull(), F.array_contains("_d.freqs", known(freq).cast("string")))
    no, yes = F.lit(False), F.lit(True)
    listed = F.when(F.col("_d.values").isNull() & F.col("_d.freqs").isNull(), yes).otherwise(F.coalesce(by_value, no) | F.coalesce(by_freq, no))
    at = known(record).cast("long")
    in_range = F.when(F.col("_d.records").isNull(), yes).otherwise(F.coalesce(F.exists("_d.records", lambda r: at.between(r["lo"], r["hi"])), no))
    gone = F.when(F.col("_d.discard"), listed & in_range)
    kept = best.where(~F.coalesce(gone, F.lit(False)))
    return kept.withColumn("level", F.least(F.coalesce("_d.level", "level"), F.lit(limit))).select(*findings.columns)


def exit_level(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level): the highest level of each key's findings."""
    return findings.groupBy(*keys).agg(F.max("level").alias("level"))


def notes(findings: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, note): the findings of each key as one YAML text by level and code, ``most`` texts a code and how many more there are."""
    each = findings.groupBy(*keys, "level", "code").agg(F.sort_array(F.collect_set("text")).alias("texts"), F.count("*").alias("n"))
    lines = F.transform(F.slice("texts", 1, most), lambda t: F.concat(F.lit("    - "), t))
    more = F.when(F.size("texts") > most, F.array(F.lit("    - more ..."))).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lit("- code: "), F.col("code"), F.lit("\n  level: L"), F.col("level").cast("string"), F.lit("\n  count: "), F.col("n").cast("string"), F.lit("\n  texts:"))
    told = each.withColumn("_n", F.concat_ws("\n", F.array(head), lines, more))
    return told.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "code", "_n")), asc=False), lambda x: x["_n"]), "\n").alias("note"))


def write_notes(findings: DataFrame, path: str, keys: list[str], most: int = 5) -> None:
    """Write ``notes`` as text files below ``path``, a folder for each key."""
    notes(findings, keys, most).withColumnRenamed("note", "value").write.mode("overwrite").partitionBy(*keys).text(path)


def tag_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, code, n, captions) of each code."""
    return findings.groupBy(*keys, "level", "code").agg(F.count("*").alias("n"), F.min("text").alias("caption"))


def flood_limited(findings: DataFrame, keys: list[str], order: list[str], most: int = 5) -> DataFrame:
    """The first ``most`` findings of each key, and one row ``more ...`` for the rest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = findings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most + 1)
    return r.withColumn("text", F.when(F.col("place") > most, "more ...").otherwise(F.col("text")))


def check_results(findings: DataFrame, keys: list[str], areas: list[str]) -> DataFrame:
    """One column for each area: FAIL, FIXED, OMIT or PASS, whichever weighs most; N/A where nothing was said."""
    rank = F.when(F.col("result") == "FAIL", 4).when(F.col("result") == "PASS", 3).when(F.col("result") == "FIXED", 2).when(F.col("result") == "OMIT", 1).otherwise(0)
    p = findings.withColumn("_r", rank).groupBy(*keys).pivot("area", areas).agg(F.max("_r"))
    names = F.array(F.lit("N/A"), F.lit("OMIT"), F.lit("FIXED"), F.lit("PASS"), F.lit("FAIL"))
    return p.select(*keys, *[F.coalesce(F.get(names, F.col(a)), F.lit("N/A")).alias(a) for a in areas])


def unlocked(records: DataFrame, series: list[str], order: list[str], level: str, lock_at: int = 2) -> DataFrame:
    """Members of a series before which none reached ``lock_at``; the ones after it are skipped."""
    before = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.where("true").withColumn("_m", F.max(level).over(before)).where(F.col("_m").isNull() | (F.col("_m") < lock_at)).drop("_m")


def erased(findings: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Findings without those that a summarising code of the same key erases; ``rules``: (code, erases)."""
    pairs: dict[str, set[str]] = {}
    for r in _few(rules.select("code", "erases").where("code is not null and erases is not null").distinct()):
        pairs.setdefault(r["code"], set()).add(r["erases"])
    if not pairs:
        return findings
    table = F.create_map(*[x for c, e in sorted(pairs.items()) for x in (F.lit(c), F.array(*[F.lit(v) for v in sorted(e)]))])
    # codes of a key that erase any are few, whatever it has of others
    gone = findings.where(F.col("code").isin(*pairs)).groupBy(*keys).agg(F.collect_set("code").alias("gone_"))
    gone = gone.withColumn("gone_", F.array_distinct(F.flatten(F.transform("gone_", lambda c: F.element_at(table, c)))))
    return findings.join(gone, keys, "left").where(~F.coalesce(F.array_contains("gone_", F.col("code")), F.lit(False))).select(*findings.columns)


def union_by_precedence(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Check lists in order of precedence: of equal keys the first list's row stays."""
    every = None
    for prio, x in enumerate(lists):
        x = x.withColumn("prio", F.lit(prio))
        every = x if every is None else every.unionByName(x)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("prio"))).where("_r = 1").drop("_r")
