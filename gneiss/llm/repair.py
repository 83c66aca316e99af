"""Repair of conversations by cheapest edits, Viterbi in parallel pieces.

A repaired conversation's role initials read ``(s?(ua)+)?``, an automaton of four states. The edits are Keep (0), Rerole to
user or assistant (3), Delete (4; blank and duplicate rows have to go) and Insert of an empty user or assistant (3); a truncated row that stays
costs 3 more. The cost of what is still to come is a vector over the states, and each row maps the vector behind it to the one before it.

Rows are sorted by range over all partitions, so one long conversation lies in many; each partition cuts its rows into pieces. A
conversation inside one piece is solved there. Of the others every piece starts from a speculative vector (that of a conversation's
end). Fix-up passes follow: a piece whose successor's first vector differs from the one it has used by more than a constant runs again
with it; when none differs, all vectors are right up to constants, which change no choice. Few passes are needed: an insert or two leads from any
state to any other that matters, so differences are small and mostly the same whatever lies behind. Each piece then maps the
state it is entered in to the one it is left in, the maps are chained, and every piece is traced with its own state: at each row the
least letter (D, I, K, R) that keeps to the cheapest cost, which gives the least audit.

Identical rows are counted before they are moved, so neither a hot conversation nor a hot row meets in one task. Only two passes go over one
conversation's pieces in order: that of the maps, four numbers a piece, and that of the digest, which is sequential by its definition;
both stream with the memory of one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import SPACES, indexed, materialise, release

#: Bounds of a piece (one row at least): rows, and characters of roles and texts.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 16

# States: nothing yet, after a system row, after a user row, after an assistant row.
#: Where Insert and Rerole lead from each state (2 writes a user row, 3 an assistant row), and Keep of each initial.
WRITE = (2, 2, 3, 2)
KEEP = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: Inserts that close a conversation: its cost to come when no row is left.
CLOSING = (0, 6, 3, 0)
ROLE = {2: "user", 3: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Bits of a row's code beside its initial (0 s, 1 u, 2 a, 3 other).
TRUNCATED, DELETED = 4, 8


def before(code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """The cost to come in each state before a row, from those behind it."""
    late = 3 if code & TRUNCATED else 0
    keep = KEEP[code & 3]
    best = []
    for q in range(4):
        c = 4 + behind[q]
        if not code & DELETED:
            c = min(c, 3 + late + behind[WRITE[q]], late + behind[keep[q]] if q in keep else c)
        best.append(c)
    user, assistant = min(best[2], 3 + best[3]), min(best[3], 3 + best[2])
    return min(best[0], 3 + user), min(best[1], 3 + user), user, assistant


def levelled(v: tuple[int, ...]) -> tuple[int, ...]:
    low = min(v)
    return tuple(c - low for c in v)


class Costs:
    """``before`` up to constants; there are few vectors, so each is worked out once."""

    def __init__(self) -> None:
        self.known: dict = {}

    def step(self, code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
        v = self.known.get((code, behind))
        if v is None:
            v = self.known[code, behind] = levelled(before(code, behind))
        return v

    def first(self, codes: bytes, end: tuple[int, ...]) -> tuple[int, ...]:
        for code in reversed(codes):
            end = self.step(code, end)
        return end

    def all(self, codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        out = [end]
        for code in reversed(codes):
            out.append(self.step(code, out[-1]))
        return out[::-1]


def edits(codes: bytes, vectors: list[tuple[int, ...]], state: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
    """(letter, row, state after, cost) of the least cheapest edits from ``state`` on; ``last`` closes the conversation."""
    for i, code in enumerate(codes):
        late = 3 if code & TRUNCATED else 0
        # costs behind the row, at the level of those before it
        level = min(before(code, vectors[i + 1])) - min(vectors[i])
        here, behind = vectors[i], [c - level for c in vectors[i + 1]]
        while True:
            if here[state] == 4 + behind[state]:
                yield "D", i, state, 4
                break
            if here[state] == 3 + here[WRITE[state]]:
                state = WRITE[state]
                yield "I", i, state, 3
                continue
            kept = KEEP[code & 3].get(state)
            if kept is not None and here[state] == late + behind[kept]:
                state = kept
                yield "K", i, state, late
            else:
                state = WRITE[state]
                yield "R", i, state, 3 + late
            break
    while last and CLOSING[state]:
        state = WRITE[state]
        yield "I", len(codes), state, 3


def left_in(codes: bytes, vectors: list[tuple[int, ...]], state: int) -> int:
    for _, _, state, _ in edits(codes, vectors, state, False):
        pass
    return state


def sorted_rows(rows: DataFrame, copies: str | None) -> DataFrame:
    """(conv_id, n, first, turn, initial, blank, truncated, role, text), sorted by range: each different row once, ``n`` times meant.

    ``first`` is true where the conversation has no earlier row of this role and text. A row of no copies stands for
    its conversation only.
    """
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"))
    there = F.col("n") > 0
    r = r.select("conv_id", there.alias("there"), *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role")], F.when(there, F.md5("text")).alias("digest"), F.when(there, F.col("text")).alias("text"), "n")
    firsts = r.where("there").groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("turn"), F.bool_or(F.col("turn").isNull()).alias("unknown"))
    firsts = firsts.select("conv_id", F.lit(True).alias("there"), F.when(~F.col("unknown"), F.col("turn")).alias("turn"), "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"))
    key = ["conv_id", "there", "turn", "role", "digest"]
    each = r.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(*key).agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.bool_or("first").alias("first"))
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = F.coalesce(said == "", F.lit(False))
    initial = F.coalesce(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0))
    placed = each.select(
        *key, "n", "first", blank.alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3).cast("int").alias("initial"), F.when(F.col("first") & ~blank, F.col("text")).alias("text"),
    )
    ordered = placed.repartitionByRange(*key).sortWithinPartitions(*key)
    return ordered.select("conv_id", "n", "first", "turn", "initial", "blank", "truncated", "role", "text")


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_ENDS = ["first_initial", "last_initial", "low_turn", "high_turn", "turns"]
_FACTS = _COUNTS + _ENDS


class Piece:
    def __init__(self, conv) -> None:
        self.conv, self.codes, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.facts = dict.fromkeys(_FACTS, 0) | dict.fromkeys(_ENDS[:4])

    def add(self, initial: int, turn: int | None, role: str, text: str | None, blank: bool, duplicate: bool, truncated: bool) -> None:
        f = self.facts
        f["blank"] += blank
        f["duplicate"] += duplicate and not blank
        f["truncated"] += truncated and not blank and not duplicate
        if self.codes:
            f["illegal"] += (f["last_initial"], initial) not in LEGAL
        else:
            f["first_initial"] = initial
        f["last_initial"] = initial
        if turn is not None:
            f["turns"] += f["high_turn"] is None or turn != f["high_turn"]
            f["low_turn"], f["high_turn"] = turn if f["low_turn"] is None else f["low_turn"], turn
        gone = blank or duplicate
        self.codes.append(initial | (DELETED if gone else TRUNCATED if truncated else 0))
        self.roles.append(None if gone else role)
        self.texts.append(None if gone else text)
        self.chars += 0 if gone else len(role) + len(text)


def _kind(name: str) -> pa.DataType:
    return pa.int32() if name.endswith("initial") else pa.int64()


def pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows cut into pieces; ``whole`` ones hold all of their conversation, ``used`` and ``begins`` are the first vectors of the others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, kind, done, now, alone = Costs(), None, [], None, False

        def closed(whole: bool) -> None:
            begins = None if whole else list(costs.first(bytes(now.codes), CLOSING))
            done.append((now.conv, whole, bytes(now.codes), now.roles, now.texts, *now.facts.values(), None if whole else list(CLOSING), begins))

        def told() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            vector = pa.list_(pa.int64())
            kinds = [kind, pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *map(_kind, _FACTS), vector, vector]
            names = ["conv_id", "whole", "codes", "roles", "texts", *_FACTS, "used", "begins"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, n, first, turn, initial, blank, truncated, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        closed(alone)
                        size += now.chars
                        alone = True
                    now = Piece(conv)
                for copy in range(n):
                    if len(now.codes) >= PIECE_ROWS or now.chars >= PIECE_CHARS:
                        closed(False)
                        size += now.chars
                        now, alone = Piece(conv), False
                    now.add(initial, turn, role, text, blank, not first or copy > 0, truncated)
                    if size >= 1 << 22 or len(done) >= 1024:
                        yield told()
                        done, size = [], 0
        if now is not None:
            closed(False)
            yield told()

    conv = dict(rows.dtypes)["conv_id"]
    facts = ", ".join(f"{c} {'int' if c.endswith('initial') else 'long'}" for c in _FACTS)
    return rows.mapInArrow(cut, f"conv_id {conv}, whole boolean, codes binary, roles array<string>, texts array<string>, {facts}, used array<bigint>, begins array<bigint>")


def _by_codes(df: DataFrame, run, schema: str) -> DataFrame:
    """``run(index, codes, used)`` for each row of (index, codes, used)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            out = [run(costs, codes, tuple(used)) for codes, used in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["index", "used", "made"])

    return df.select("index", "codes", "used").mapInArrow(each, schema)


def converged(cut: DataFrame) -> DataFrame:
    """(index, conv_id, used, last) of pieces that are not whole, ``used`` the right vector behind each up to a constant.

    Every pass joins neighbours by their numbers and runs the pieces again whose vector was wrong; each pass sets at least the
    last wrong piece of a conversation right for good, so it ends.
    """
    codes = cut.select("index", "codes")
    now = materialise(cut.select("index", "conv_id", "used", "begins"), "vectors")
    while True:
        behind = now.select((F.col("index") - 1).alias("index"), F.col("conv_id").alias("whose"), F.col("begins").alias("need"))
        stale = materialise(now.join(behind, "index").where("conv_id <=> whose and used != need").select("index", F.col("need").alias("used")), "stale")
        if stale.isEmpty():
            release(stale)
            break
        again = _by_codes(stale.join(codes, "index"), lambda costs, c, used: list(costs.first(c, used)), "index long, used array<bigint>, made array<bigint>")
        again = again.select("index", F.col("used").alias("used2"), "made")
        new = materialise(now.join(again, "index", "left").select("index", "conv_id", F.coalesce("used2", "used").alias("used"), F.coalesce("made", "begins").alias("begins")), "vectors")
        release(now, stale)
        now = new
    return now.join(behind, "index", "left").select("index", "conv_id", "used", (~F.coalesce(F.col("conv_id").eqNullSafe(F.col("whose")) & F.col("need").isNotNull(), F.lit(False))).alias("last"))


def entered(vectors: DataFrame, codes: DataFrame) -> DataFrame:
    """(index, state): the state in which each piece is entered, by chaining what each makes of every state."""
    maps = _by_codes(vectors.join(codes, "index"), lambda costs, c, used: [left_in(c, costs.all(c, used), q) for q in range(4)], "index long, used array<bigint>, made array<bigint>")
    chain = vectors.select("index", "conv_id").join(maps.select("index", "made"), "index").repartition("conv_id").sortWithinPartitions("conv_id", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, 0, False
        for batch in batches:
            out = []
            for c, made in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or c != conv:
                    conv, state, begun = c, 0, True
                out.append(state)
                state = made[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], ["index", "state"])

    return chain.mapInArrow(run, "index long, state int")


def _traced(df: DataFrame) -> DataFrame:
    """Pieces with (used, last, state) edited: edits, roles and texts of the repaired rows, cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part, out = batch.slice(start, 64), []
                for codes, roles, texts, used, last, state in zip(*[part.column(c).to_pylist() for c in ("codes", "roles", "texts", "used", "last", "state")], strict=True):
                    letters, new_roles, new_texts, cost = [], [], [], 0
                    for letter, i, at, price in edits(codes, costs.all(codes, tuple(used)), state, last):
                        letters.append(letter)
                        cost += price
                        if letter != "D":
                            new_roles.append(roles[i] if letter == "K" else ROLE[at])
                            new_texts.append("" if letter == "I" else texts[i])
                    out.append(("".join(letters), new_roles, new_texts, cost))
                cols = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
                kept = ["index", "conv_id", "whole", *_FACTS]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*kept, "edits", "roles", "texts", "cost"])

    kinds = dict(df.dtypes)
    kept = ", ".join(f"{c} {kinds[c]}" for c in ["index", "conv_id", "whole", *_FACTS])
    return df.select("index", "conv_id", "whole", *_FACTS, "codes", "roles", "texts", "used", "last", "state").mapInArrow(run, f"{kept}, edits string, roles array<string>, texts array<string>, cost long")


def repaired(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Pieces of repaired conversations: index, conv_id, whole, edits, roles, texts, cost, blank, duplicate, truncated, illegal and ends.

    ``rows`` has conv_id, turn, role, text and, if ``copies`` names one, a count of how often each row stands there; other columns are
    not read. A conversation's rows lie by turn (nulls first), then role, then digest of the text; its pieces by ``index``. Null roles
    and texts are one space, so such rows are blank or of no known role; rows of null conv_id are one conversation. ``roles`` and ``texts`` are
    the rows that stay or come, ``edits`` one letter for each edit. A row's first fault counts: blank, duplicate (role and text
    stood earlier), truncated. A conversation without rows has an empty piece if a row of 0 copies names it; an empty table gives
    an empty one. Long texts make a piece of their own.
    """
    placed = indexed(pieces(sorted_rows(rows, copies)), "pieces")
    cut = placed.where("not whole")
    vectors = converged(cut)
    states = materialise(vectors.join(entered(vectors, cut.select("index", "codes")), "index").select("index", F.col("used").alias("right"), "last", "state"), "states")
    closing = F.array(*[F.lit(c).cast("long") for c in CLOSING])
    inside = placed.where("whole").withColumns({"used": closing, "last": F.lit(True), "state": F.lit(0)})
    across = cut.join(states, "index").withColumn("used", F.col("right")).drop("right")
    return _traced(inside.unionByName(across))


def digests(told: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    Whole pieces are told where they lie; the pieces of the others come together by conversation and stream in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, now = None, [], None

        def closed() -> tuple:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            return (now["conv"], gaps, *[now[c] for c in _COUNTS], now["cost"], "".join(now["edits"]), now["hash"].hexdigest())

        def out() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for start in range(0, batch.num_rows, 64):
                for p in batch.slice(start, 64).to_pylist():
                    if now is None or p["whole"] or p["conv_id"] != now["conv"]:
                        if now is not None:
                            done.append(closed())
                        now = dict.fromkeys([*_COUNTS, "cost", "turns"], 0) | {"conv": p["conv_id"], "low": None, "high": None, "initial": None, "edits": [], "hash": hashlib.sha256(), "begun": False}
                    for c in [*_COUNTS, "cost", "turns"]:
                        now[c] += p[c]
                    if now["initial"] is not None and p["first_initial"] is not None:
                        now["illegal"] += (now["initial"], p["first_initial"]) not in LEGAL
                    now["initial"] = p["last_initial"] if p["last_initial"] is not None else now["initial"]
                    if p["low_turn"] is not None:
                        now["turns"] -= p["low_turn"] == now["high"]
                        now["low"], now["high"] = p["low_turn"] if now["low"] is None else now["low"], p["high_turn"]
                    now["edits"].append(p["edits"])
                    for role, text in zip(p["roles"], p["texts"], strict=True):
                        now["hash"].update(f"{chr(10) if now['begun'] else ''}{role}:{text}".encode())
                        now["begun"] = True
            if done:
                yield out()
                done = []
        if now is not None:
            done.append(closed())
            yield out()

    kind = dict(told.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, repaired_sha256 string"
    cols = ["conv_id", "whole", *_FACTS, "edits", "roles", "texts", "cost"]
    inside = told.where("whole").select(*cols)
    across = told.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "index").select(*cols)
    return inside.mapInArrow(run, schema).union(across.mapInArrow(run, schema))


def damage(conv_id: Column, turn: Column) -> Column:
    """0 to 19, drawn by CRC-32 of ``conv_id:turn``, a null as one space."""
    known = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults drawn by ``damage``: 0 drops a row (no copies), 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 makes it a user's. Null roles and texts are one space."""
    d, role, text = damage(F.col("conv_id"), F.col("turn")), F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
    )
