"""URL filters: rules for hosts and paths, and a weighted vocabulary for what no rule decides.

A rule is ``host/path``: it fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
that fits wins (of two as long, the one with the longer host) and its verdict stands. Else the vocabulary decides: an Aho-Corasick automaton goes over
the folded URL once, a hit counts where it begins and ends at a border of words, and a URL is blocked on one strict
term or on ``SEVERAL`` distinct soft ones (a strict term weighs ``SEVERAL``, a soft one 1, each term counts once).

Rules and vocabulary are parameters, at most ``MOST_ENTRIES`` entries of ``MOST_CHARS`` characters each (an error
beyond); they go to the workers with the function. No row moves: the judgement is a map over the URLs alone, the
other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct soft terms that block a URL; the weight of a strict one.
SEVERAL = 2
#: Bound of what goes to every worker: about 256 MB of automaton at most.
MOST_ENTRIES, MOST_CHARS = 1_000_000, 256

# Terms of URLs of adult sites, betting, pills, link farms and trackers.
STRICT = ["casino", "porn", "xxx", "viagra", "cialis", "escort", "warez", "adult x", "cheap pills", "free bets", "spam farm", "ads track"]
SOFT = ["adult", "ads", "bets", "betting", "bonus", "cheap", "crack", "dating", "farm", "free", "keygen", "loan", "payday", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "track", "win"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def folded(url: Column) -> Column:
    """A-Z in lower case, runs of ASCII characters that are neither letters nor digits as one blank, a blank at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), _BREAK, " "), F.lit(" "))


def _bounded(entries: list, longest: int, what: str) -> None:
    if len(entries) > MOST_ENTRIES or longest > MOST_CHARS:
        raise ValueError(f"{what}: {len(entries)} entries of up to {longest} characters; {MOST_ENTRIES} of {MOST_CHARS} go to the workers at most")


def weights(strict: list[str], soft: list[str]) -> dict[str, int]:
    """Term to weight, terms folded as URLs are; a term in both lists is strict, empty ones are left out."""
    out = {}
    for terms, weight in ((soft, 1), (strict, SEVERAL)):
        for t in terms:
            words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)).split(" ")
            if term := " ".join(w for w in words if w):
                out[term] = weight
    _bounded(list(out), max(map(len, out), default=0), "vocabulary")
    return out


def hits(text: str, automaton) -> Iterator[tuple[str, int]]:
    """(term, weight) of every hit in a folded URL that has a blank on both sides."""
    for end, (term, weight) in automaton.iter(text):
        if text[end + 1] == " " and text[end - len(term)] == " ":
            yield term, weight


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], strict: list[str] = STRICT, soft: list[str] = SOFT, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, strict_hits, soft_hits, soft_terms; columns of these names are replaced.

    ``rules`` holds (verdict, host, path), verdict ``allow`` or ``block``; of rules with the same host and path the first counts. strict_hits and
    soft_hits count all hits, soft_terms the distinct soft terms. A null or empty URL, or one without ``://``,
    has an empty host and path, so no rule fits it; the vocabulary judges what text there is, and without any it is
    allowed. URLs of any length are read whole, repeated rows are judged alike, an empty table gives an empty one.
    Percent escapes are not decoded. An empty vocabulary blocks nothing.
    """
    by_host: dict[str, dict[str, str]] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
        by_host.setdefault(host, {}).setdefault(path, verdict)
    _bounded(rules, max((len(h + p) for _, h, p in rules), default=0), "rules")
    terms = weights(strict, soft)

    def ruled(host: str, path: str) -> tuple[str, str] | None:
        best, at = None, host
        while True:
            for start, verdict in by_host.get(at, {}).items():
                if path.startswith(start) and (best is None or len(at) + len(start) > best[0]):
                    best = (len(at) + len(start), at + start, verdict)
            _, dot, at = at.partition(".")
            if not dot:
                return best and best[1:]

    @F.pandas_udf("rule string, verdict string, strict_hits long, soft_hits long, soft_terms long")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            automaton.add_word(t, (t, w))
        if terms:
            automaton.make_automaton()
        for hosts, paths, texts in parts:
            out = []
            for host, path, text in zip(hosts, paths, texts, strict=True):
                found = list(hits(text, automaton)) if terms else []
                strong = sum(w == SEVERAL for _, w in found)
                distinct = len({t for t, w in found if w == 1})
                rule, verdict = ruled(host, path) or (None, "block" if strong or distinct >= SEVERAL else "allow")
                out.append((rule, verdict, strong, len(found) - strong, distinct))
            yield pd.DataFrame(out, columns=["rule", "verdict", "strict_hits", "soft_hits", "soft_terms"])

    told = judge(host_of(F.col(url)), path_of(F.col(url)), folded(F.col(url)))
    made = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms"]
    others = [F.col(f"`{c}`") for c in pages.columns if c == url or c not in made]
    out = pages.select(*others, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), told.alias("verdict"))
    return out.select(*others, "host", "path", *[F.col(f"verdict.{c}").alias(c) for c in made[2:]])
