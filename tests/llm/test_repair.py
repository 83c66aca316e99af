import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from gneiss.llm import repair
from gneiss.llm.q_repair import op13_conversation_repair
from gneiss.llm.repair import Costs, damaged, digests, repaired

SHAPE = re.compile(r"(s?(ua)+)?")
WS = "\x20\t\n\x0b\x0c\r"


def broken(rows):
    """Rows (conv, turn, role, text) after the damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        at = out.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        at += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(WS)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by memo over (row, initials so far as a state told by the shape alone)."""

    def ahead(state):
        """States as shortest prefixes of the shape."""
        return {"": ["s", "u"], "s": ["u"], "u": ["a"], "ua": ["u"]}[state]

    def after(state, c):
        return {"s": "s", "u": "u", "a": "ua"}[c] if c in ahead(state) else None

    @functools.cache
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "ua"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (s := after(state, role[0])) is not None:
                    c, a, r = best(i, s, inserts + 1)
                    options.append((c + 3, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 4, "D" + a, r))
            if found[i] not in ("blank", "duplicate"):
                late = 3 if found[i] == "truncated" else 0
                for letter, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if new and (s := after(state, new[0])) is not None:
                        c, a, r = best(i + 1, s, 0)
                        options.append((c + price + late, letter + a, ((new, text), *r)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def every(rows, found):
    """(cost, audit) over all edits of a few rows, with up to two inserts in each place."""
    gaps = ["", *"ua", "ua", "au", "uu", "aa"]
    choices = [[("D", "", 4)] + ([] if f in ("blank", "duplicate") else [("K", r[1][:1] or "?", 3 * (f == "truncated")), *[("R", c, 3 + 3 * (f == "truncated")) for c in "ua"]]) for r, f in zip(rows, found, strict=True)]
    best = None
    for picks in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles = ins[0] + "".join(p[1] + g for p, g in zip(picks, ins[1:], strict=True))
            if SHAPE.fullmatch(roles):
                audit = "I" * len(ins[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, ins[1:], strict=True))
                got = (sum(p[2] for p in picks) + 3 * sum(map(len, ins)), audit)
                best = min(best or got, got)
    return best


def plainly(rows):
    out = {}
    for conv, lines in broken(rows).items():
        found = faults(lines)
        cost, audit, kept = cheapest(lines, found)
        turns = [t for t, _, _ in lines if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        told = "\n".join(f"{r}:{t}" for r, t in kept)
        assert SHAPE.fullmatch("".join(r[0] for r, _ in kept))
        out[conv] = (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


def judged(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, convs, longest, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None, "Sam", "uncle")):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "no", " ", "", None, "What? ", f"t{rng.randint(0, 9)}!", f"u{rng.randint(0, 9)}", "Ends\n.\n\n", "längs…"])
            rows.append((None if conv == 0 else conv, rng.choice([turn, turn, turn, None, turn // 2, turn * 3]), rng.choice(roles), text))
    return rows


def test_brute_force_is_right():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(i, rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["a.", "b", " ", "c!"])) for i in range(rng.randint(0, 3))]
        found = faults(rows)
        assert cheapest(rows, found)[:2] == every(rows, found)


def test_all_rows(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert judged(op13_conversation_repair(spark, sf)) == plainly(rows)


@pytest.mark.parametrize(("piece", "parts"), [(1024, 1), (3, 4), (1, 9)])
def test_odd_rows(spark, monkeypatch, piece, parts):
    """Long conversations in pieces of any size, over any number of partitions; null ids, turns, roles and texts, ties and repeated rows."""
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rows = made(7, 40, 12) + [(99, t, "user" if t % 2 else "assistant", f"n{t}.") for t in range(130)] + [(98, 1, "user", "same.")] * 50 + [(97, 5, "user", "x" * 300_000 + ".")]
    rows += [(-1, None, "assistant", "Same text."), (-1, None, "assistant", "Same text.")] + [(50, t, "user", " ") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as n", "'x' as index", "1 as whole", "2 as first")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert judged(digests(repaired(damaged(df), "copies"))) == plainly(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_outputs_are_the_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again."), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in repaired(df).collect()}
    assert (got[1].edits, got[1].roles, got[1].texts, got[1].cost) == ("KRK", ["system", "user", "assistant"], ["Be brief.", "Hello.", "Again."], 3)
    assert (got[2].edits, got[2].roles, got[2].cost) == ("D", [], 4)


def test_empty_table_and_dropped_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(repaired(damaged(df), "copies")).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema)
    assert judged(digests(repaired(damaged(df), "copies"))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_vectors_converge_whatever_lies_behind():
    """A few ordinary rows lead all vectors that inserts allow to the same one up to a constant."""
    costs, codes = Costs(), bytes([1, 2] * 4)
    ends = [v for v in itertools.product(range(0, 7, 3), repeat=4)]
    closed = {(min(a, 3 + c, 6 + d), min(b, 3 + c, 6 + d), min(c, 3 + d), min(d, 3 + c)) for a, b, c, d in ends}
    assert len({costs.first(codes, repair.levelled(v)) for v in closed}) < len(closed)
