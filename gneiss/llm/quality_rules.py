"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores what it measured and one bit a rule that failed.
Policies are versions of a set of rules that count; applying one, or asking what another would
do, is bitwise work on the ledger and reads no text again. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import WORD

SPACE, SYMBOL, HAS_WORD = "[\\x20\\x09-\\x0D]", "[#*$%&|<>]", "[^\\x20\\x09-\\x0D]"
#: Length of the word windows of the repetition rule.
WINDOW = 5

#: Every rule by name, as an SQL condition under which a document fails it; its place is its bit.
RULES = {
    "too_short": "n_words < 10",
    "repetition": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "line_copies": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "2 * n_capitals > word_chars",
    "exclamations": "4 * n_exclamations > n_words",
}
BASE = ("too_short", "repetition")


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE_POLICY = Policy("base-1", BASE)
POLICY = Policy("full-1", tuple(RULES))


def _count(pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(pattern)), F.lit(0)).cast("long")


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclamations).

    A repeated word stands in a window of ``WINDOW`` words found twice or more in the text. Windows are
    compared as 64-bit hashes. They are sorted, with their places, only in texts where some window repeats.
    """
    d = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    d = d.select(
        "id",
        (F.coalesce(F.length("text"), F.lit(0)) - _count(SPACE)).cast("long").alias("word_chars"),
        _count(SYMBOL).alias("n_symbols"),
        _count("[A-Z]").alias("n_capitals"),
        _count("!").alias("n_exclamations"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(HAS_WORD)).alias("lines"),
        F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"),
    )
    d = d.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    at = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    d = d.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("windows", F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), at)).otherwise(none)).drop("words")
    place = lambda x, i: F.struct(x.alias("x"), i.alias("i"))
    d = d.withColumn("windows", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", place))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    w = F.col("windows")
    beside = lambda e, j: F.when((F.get(w, j - 1)["x"] == e["x"]) | (F.get(w, j + 1)["x"] == e["x"]), e["i"])
    d = d.withColumn("places", F.sort_array(F.array_compact(F.transform(w, beside)))).drop("windows")
    p = F.col("places")
    covered = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    return d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("places")


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed``, a bit for each rule of ``RULES`` that failed.

    Null or empty texts measure 0 everywhere and fail ``too_short``; null ids and repeated rows keep
    their rows; other columns are ignored; an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, id, text).withColumn("failed", failed.cast("long"))


def verdict(policy: Policy) -> Column:
    """Whether a row of the ledger passes ``policy``."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """(version, rule, bit, n_failed, n_only): documents that fail a rule of the policy, and those that
    would pass without it. The ledger is first counted by its bits, so at most 2^rules rows go on."""
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules])
    masks = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = masks.withColumn("r", F.explode(names)).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy(F.lit(policy.version).alias("version"), "rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def with_ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``freed_by``, the rule without which alone the document would pass ``policy``, and ``n_freed``, how many
    documents that rule keeps out alone; null where the document passes or fails several. The rules' counts are few rows."""
    by = F.broadcast(ablations(ledger, policy).select("bit", F.col("rule").alias("freed_by"), F.col("n_only").alias("n_freed")))
    return ledger.join(by, F.col("failed").bitwiseAND(F.lit(policy.mask)) == F.col("bit"), "left").drop("bit")
