"""Benchmark decontamination by the q-gram lemma.

A text that holds a benchmark item of m bytes with at most e edits shares with it m - q + 1 - q e of
the item's q-grams at least, and they lie on diagonals (place in the text less place in the item)
that differ by e at most. Diagonals are dealt in overlapping bands, each twice e + 1 wide and begun
every e + 1, so that some band holds them all. Bands with that many shared q-grams are regions; each
is verified by a banded alignment of the item with the text around it.

Texts are compared as UTF-8 bytes of their lower case, each run of white space as one space; an edit is one byte,
and places count in those bytes. One rule holds for items of all sizes: edits up to ``RATE`` of what is aligned, and an item
leaks if a document holds at least the share ``SHARE`` of its bytes. An item of more than ``SEGMENT`` bytes is searched by
overlapping segments, each with its own edits, and the share is that of the bytes that the found ones cover; of a shorter one all is held
or nothing is. An item so short that its edits come to none is searched exactly, as whole words. What is shorter than ``EVIDENCE`` bytes stands in any
text by chance: it is found, but takes no document out.

The items are searched in blocks of at most ``BLOCK_BYTES``, each of which is broadcast and indexed once in a Python worker; every
document is read whole against every block.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import fresh, materialise, sliced
from gneiss.llm.shingles import chunks, text_buffers

Q = 8
#: Edits in a byte of an item, the share of its bytes that a document has to hold, and the bytes below which an item is no evidence.
RATE, SHARE, EVIDENCE = 0.07, 0.9, 20
#: Bytes of a segment of a long item; segments begin every half of it.
SEGMENT = 512
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 4_000_000
#: (place of a q-gram in a text, item that holds it) pairs that are held at once.
MOST_HITS = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SLOTS = 20


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data`` with each run of white space as one space, and the ``offsets`` of its rows; runs end with their row."""
    space = _SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    out = np.where(space, np.uint8(0x20), data)[~again]
    return out, kept[offsets]


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed in an item of ``m`` bytes: its share, as far as the lemma still asks for a q-gram."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def _codes(data: np.ndarray) -> np.ndarray:
    """The q-gram at each byte as one integer, exactly."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _pieces(b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """An item, or its overlapping segments if it is long, with their first bytes; the last one ends with the item."""
    if len(b) <= SEGMENT:
        return [(0, b)]
    starts = [*range(0, len(b) - SEGMENT, SEGMENT // 2), len(b) - SEGMENT]
    return [(i, b[i : i + SEGMENT]) for i in starts]


def _covered(spans: list[tuple[int, int]]) -> int:
    """Bytes that lie in some span [begin, end)."""
    total, upto = 0, 0
    for a, z in sorted(spans):
        total += max(0, z - max(a, upto))
        upto = max(upto, z)
    return total


class Items:
    """A block of benchmark items (id, text), indexed by q-gram."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        known = [(i, _folded(t)) for i, t in items if t]
        self.sizes = [len(b) for _, b in known]
        self.ids = [i for i, _ in known]
        long = [budget(min(len(b), SEGMENT), rate) > 0 for _, b in known]
        #: (item, first byte of the piece in it, piece)
        pieces = [(k, at, p) for k, (_, b) in enumerate(known) if long[k] for at, p in _pieces(b)]
        self.places = [at for _, at, _ in pieces]
        self.items = [(k, p) for k, _, p in pieces]
        self.edits = np.array([budget(len(b), rate) for _, b in self.items], np.int64)
        self.needed = np.array([max(1, len(b) - Q + 1 - Q * e) for (_, b), e in zip(self.items, self.edits, strict=True)], np.int64)
        codes = [_codes(b) for _, b in self.items]
        own = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.own, self.place = own[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat)) if len(flat) else self.first
        self.filter = np.zeros(1 << _SLOTS, bool)
        self.filter[_slot(self.grams)] = True
        # short items by their first bytes, of each length up to Q: sorted codes and the items of each
        short = [(k, b) for k, (_, b) in enumerate(known) if len(b) and not long[k]]
        self.longest = max((len(b) for _, b in short), default=0)
        self.short: dict[int, tuple[np.ndarray, list[list[tuple[int, bytes]]]]] = {}
        for n in {min(Q, len(b)) for _, b in short}:
            by: dict[int, list[tuple[int, bytes]]] = {}
            for k, b in short:
                if min(Q, len(b)) == n:
                    by.setdefault(int.from_bytes(b[:n].tobytes(), "little"), []).append((k, b.tobytes()))
            self.short[n] = np.array(sorted(by), np.uint64), [by[k] for k in sorted(by)]

    def _expanded(self, at, gram, row, offsets):
        """(row, item, diagonal) of all items that hold the q-grams found ``at``."""
        many = self.last[gram] - self.first[gram]
        each = np.repeat(self.first[gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(row, many), self.own[each].astype(np.int64), np.repeat(at, many) - offsets[np.repeat(row, many)] - self.place[each]

    def regions(self, text: np.ndarray, offsets: np.ndarray):
        """(row, item, least diagonal) of the bands that hold q-grams enough; rows are the stretches between ``offsets``."""
        codes = _codes(text)
        if not len(codes) or not len(self.grams):
            return
        at = np.flatnonzero(self.filter[_slot(codes)])
        gram = np.minimum(np.searchsorted(self.grams, codes[at]), len(self.grams) - 1)
        true = self.grams[gram] == codes[at]
        at, gram = at[true], gram[true]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, gram, row = at[inside], gram[inside], row[inside]
        # rows one after the other, so many at once as have ``MOST_HITS`` hits together; one row of more goes in parts
        hits = np.concatenate([[0], np.cumsum(self.last[gram] - self.first[gram])])
        edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(hits[edges], hits[edges[i]] + MOST_HITS, "right")) - 1)
            a, z = edges[i], edges[j]
            parts = [a, z]
            if hits[z] - hits[a] > MOST_HITS:
                parts = [a, *(a + np.flatnonzero(np.diff((hits[a:z] - hits[a]) // MOST_HITS)) + 1), z]
            yield from self._bands([(at[x:y], gram[x:y], row[x:y]) for x, y in zip(parts[:-1], parts[1:], strict=True)], offsets)
            i = j

    def _bands(self, parts, offsets):
        """The bands of some rows. Items with fewer q-grams in a row than needed go before any band is made; several ``parts``
        are of one row, whose hits are first counted by item and then kept for the items that are left."""
        if len(parts) > 1:
            often = sum(np.bincount(self._expanded(*p, offsets)[1], minlength=len(self.items)) for p in parts)
            found = []
            for p in parts:
                row, item, diagonal = self._expanded(*p, offsets)
                keep = often[item] >= self.needed[item]
                found.append((row[keep], item[keep], diagonal[keep]))
            row, item, diagonal = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            row, item, diagonal = self._expanded(*parts[0], offsets)
            _, back, often = np.unique(row * len(self.items) + item, return_inverse=True, return_counts=True)
            keep = often[back] >= self.needed[item]
            row, item, diagonal = row[keep], item[keep], diagonal[keep]
        if not len(item):
            return
        step = self.edits[item] + 1
        band = np.floor_divide(diagonal, step)
        item, row = np.tile(item, 2), np.tile(row, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((band, item, row))
        key = np.stack([row, item, band], 1)[order]
        new = np.flatnonzero(np.any(np.diff(key, axis=0, prepend=key[:1] - 1) != 0, axis=1))
        size = np.diff(np.append(new, len(key)))
        for r, i, b in key[new][size >= self.needed[key[new, 1]]].tolist():
            yield r, i, b * int(self.edits[i] + 1)

    def words(self, text: np.ndarray, offsets: np.ndarray):
        """(row, item, first byte) of each short item that stands in a row as whole words."""
        if not self.short or not len(text):
            return
        padded = np.concatenate([text, np.zeros(max(Q, self.longest) + 1, np.uint8)])
        codes = _codes(padded)[: len(text)]
        before = np.concatenate([[False], _WORD[text[:-1]]])
        before[offsets[:-1][offsets[:-1] < len(text)]] = False
        for n, (known, items) in self.short.items():
            own = codes & np.uint64((1 << (8 * n)) - 1)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for x in np.flatnonzero((known[place] == own) & ~before).tolist():
                row = int(np.searchsorted(offsets, x, "right")) - 1
                for k, b in items[place[x]]:
                    z = x + len(b)
                    if z <= offsets[row + 1] and padded[x:z].tobytes() == b and not (z < offsets[row + 1] and _WORD[padded[z]]):
                        yield row, k, x - int(offsets[row])

    def verify(self, item: int, text: np.ndarray, low: int) -> tuple[int, int] | None:
        """(edits, first byte) of the item in ``text`` on the diagonals of the band from ``low`` and as
        far around it as edits reach, or None beyond its budget."""
        pattern, e = self.items[item][1], int(self.edits[item])
        m = len(pattern)
        lo, hi = low - e, low + 2 * (e + 1) - 1 + e
        begin = max(0, lo)
        at = text[begin : max(0, hi + m + e)].tobytes().find(pattern.tobytes())
        if at >= 0:
            return 0, begin + at
        width = hi - lo + 1
        diagonals = np.arange(lo, hi + 1)
        big = m + len(text) + 1
        cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, big)
        first = diagonals.copy()
        steps = np.arange(width)
        padded = np.full(m + width, 256, np.int16)
        a, z = max(0, -lo), min(len(padded), len(text) - lo)
        if z > a:
            padded[a:z] = text[lo + a : lo + z]
        for i in range(m):
            column = i + 1 + diagonals
            step = cost + (padded[i : i + width] != pattern[i])
            skip = np.append(cost[1:] + 1, big)
            src = np.where(step <= skip, first, np.append(first[1:], 0))
            step = np.where((column >= 0) & (column <= len(text)), np.minimum(step, skip), big)
            # insertions run to the right: least of (cost - place) so far, plus place
            run = np.minimum.accumulate(step - steps)
            where = np.maximum.accumulate(np.where(step - steps == run, steps, 0))
            cost, first = run + steps, src[where]
        best = int(np.argmin(cost))
        return (int(cost[best]), int(first[best])) if cost[best] <= e else None

    def search(self, column):
        """(row, item id, edits, first byte, item bytes, share), the best place of each item in a row: the most of it, then the fewest edits, then the
        first place. Edits and place are those of its best piece; of items that share an id the one of the greatest share is told."""
        data, offsets = text_buffers(column)
        for i, j in chunks(offsets):
            text, bounds = fold(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int]]] = {}
            for row, item, low in self.regions(text, bounds):
                hit = self.verify(item, text[bounds[row] : bounds[row + 1]], low)
                if hit:
                    k, piece = self.items[item]
                    at, held = self.places[item], found.setdefault((row, k), {})
                    held[at, at + len(piece)] = min(hit, held.get((at, at + len(piece)), hit))
            for row, k, first in self.words(text, bounds):
                held = found.setdefault((row, k), {})
                held[0, self.sizes[k]] = min((0, first), held.get((0, self.sizes[k]), (0, first)))
            best = {}
            for (row, k), held in found.items():
                told = (-_covered(list(held)) / self.sizes[k], *min(held.values()), self.sizes[k])
                best[row, self.ids[k]] = min(told, best.get((row, self.ids[k]), told))
            for (row, id), (share, edits, first, n) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
                yield i + row, id, edits, first, n, -share


def _folded(text: str) -> np.ndarray:
    """An item's bytes without white space at either end."""
    b = np.frombuffer(text.encode(), np.uint8)
    b, _ = fold(b, np.array([0, len(b)]))
    inside = np.flatnonzero(b != 0x20)
    return b[inside[0] : inside[-1] + 1] if len(inside) else b[:0]


#: The index of the block that this worker searched last, by the block's name: later tasks of a worker find it here.
_LAST: dict[str, Items] = {}


def _indexed(shared) -> Items:
    name, block, rate = shared.value
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Items(block, rate)
    return _LAST[name]


def _blocks(benchmark: DataFrame, id: str, text: str):
    """Lists of (id, text), each of ``BLOCK_BYTES`` at most (or of one item); the driver holds one at a time."""
    items = benchmark.select(benchmark[id].cast("long").alias("id"), F.lower(benchmark[text].cast("string")).alias("text")).where("text is not null").orderBy("id", "text")
    held, size = [], 0
    for r in items.toLocalIterator():
        n = len(r["text"].encode())
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["id"], r["text"]))
        size += n
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(id, item_id, edits, first_byte, item_bytes, share): each item of which a document holds a share within the edits, at its best place.

    Null or empty texts and items hold and are nothing. Rows of null id are searched as any other, and so are items of null
    id, which count as one; repeated rows give repeated results. With no items the result is empty. Columns besides id and
    text are ignored. A ``share`` of ``SHARE`` or more is a leak; long passages of long items are told with their lesser share.
    """
    schema = "id long, item_id long, edits int, first_byte long, item_bytes int, share double"
    at = docs.select(docs[id].cast("long").alias("id"), F.lower(docs[text].cast("string")).alias("text"))
    sc, found = docs.sparkSession.sparkContext, []
    for block in _blocks(benchmark, "item_id", "text"):
        shared = sc.broadcast((uuid.uuid4().hex, block, rate))

        def run(batches, shared=shared):
            for batch in sliced(batches):
                rows = list(_indexed(shared).search(batch.column(1)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.float64())],
                    ["id", "item_id", "edits", "first_byte", "item_bytes", "share"],
                )

        found.append(at.mapInArrow(run, schema))
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, share: float = SHARE, evidence: int = EVIDENCE) -> DataFrame:
    """``docs`` without the rows that hold the share ``share`` of an item of ``evidence`` bytes or more; columns as they are, whatever their names.

    Rows are judged by their text where they are read, nothing is joined: null and repeated ids are judged as others, copies alike, null and
    empty texts stay. With no items every row stays; an empty table gives an empty one. Each block of the benchmark is one pass over what the
    block before left.
    """
    sc, names, first = docs.sparkSession.sparkContext, docs.columns, True
    low = fresh(names, "lower_")
    for block in _blocks(benchmark, "item_id", "text"):
        shared = sc.broadcast((uuid.uuid4().hex, block, rate))

        def run(batches, shared=shared):
            for batch in sliced(batches):
                keep = np.ones(batch.num_rows, bool)
                for row, _, _, _, size, held in _indexed(shared).search(batch.column(len(names))):
                    keep[row] &= held < share or size < evidence
                yield batch.select(range(len(names))).filter(pa.array(keep))

        docs = docs if first else materialise(docs, "clean")
        first = False
        docs = docs.select("*", F.lower(docs[text].cast("string")).alias(low)).mapInArrow(run, docs.schema)
    return docs
