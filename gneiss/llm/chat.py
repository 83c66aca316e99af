"""Chat formatting of reply trees.

Messages with a parent form trees. Paths from the root to each leaf are found by iterative self-joins:
first pointers that double their reach find each message's depth and leave out cycles; then every leaf starts
with itself, and in round k each path is extended by the ancestors that lie up to 2^k above its oldest
message. A tree of depth d takes log2(d) rounds and no more rows than its paths hold. Branches are ranked by the mean score of their
messages, and the chosen ones are each formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so that no text can make a control string, and reading back undoes it.
The loss mask is a list of [begin, end) code points of the formatted text, one for each assistant text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import materialise, release, sliced

BEGIN, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def escape_role(s: str) -> str:
    """A role stands on one line: its line breaks are escaped too."""
    return escape(s).replace("\n", "\\n")


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def rooted(messages: DataFrame) -> DataFrame:
    """(tree, message, parent, depth): the messages from which a root is reached, ``depth`` steps below it.

    Every message points at its parent; in each round a pointer that has not reached a root takes over the one of the
    message it points at, so that its reach doubles. A round in which no pointer reaches a root is the last: what is
    left lies on a cycle or below one. The table never has more rows than messages.
    """
    m = messages.select("tree", "message", "parent").where("tree is not null and message is not null").dropDuplicates(["tree", "message"])
    known = m.select(F.col("tree").alias("t"), F.col("message").alias("p"))
    m = m.join(known, (m.tree == known.t) & (m.parent == known.p), "left").select("tree", "message", F.col("p").alias("parent"))
    at = m.withColumn("high", F.coalesce("parent", "message")).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long"))
    now, found = materialise(at.withColumn("done", F.col("parent").isNull()), "pointers"), -1
    while True:
        done = now.where("done").count()
        if done == found:
            break
        found = done
        above = now.select("tree", F.col("message").alias("high"), F.col("high").alias("far"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = now.where("not done").join(above, ["tree", "high"]).select("tree", "message", "parent", F.col("far").alias("high"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        new = materialise(now.where("done").select("tree", "message", "parent", "high", "depth", "done").union(step), "pointers")
        release(now)
        now = new
    return now.where("done").select("tree", "message", "parent", "depth")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, up): the messages from each leaf up to its root, ``up`` steps above the leaf.

    ``messages`` has tree, message, parent (null at a root; a parent that is no message of the tree also
    makes a root). Messages on a cycle or below one have no root and no path; they are left out before paths are made.
    """
    m = materialise(rooted(messages), "messages")
    deepest = m.agg(F.max("depth")).first()[0] or 0
    leaves = m.join(m.select("tree", F.col("parent").alias("message")).where("message is not null").distinct(), ["tree", "message"], "left_anti")
    paths = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up"))
    # jump: the ancestor ``reach`` steps above a message
    jump, reach = m.where("parent is not null").select("tree", F.col("message").alias("low"), F.col("parent").alias("high")), 1
    while reach <= deepest:
        longer = paths.join(jump.withColumnRenamed("low", "message"), ["tree", "message"]).select("tree", "leaf", F.col("high").alias("message"), (F.col("up") + reach).alias("up"))
        longer = materialise(paths.union(longer), "paths")
        release(paths)
        paths = longer
        if 2 * reach <= deepest:
            far = jump.select("tree", F.col("low").alias("high"), F.col("high").alias("far"))
            further = materialise(jump.join(far, ["tree", "high"]).select("tree", "low", F.col("far").alias("high")), "jump")
            release(jump)
            jump = further
        reach *= 2
    return paths


def ranked_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, branch, message, up) of the ``keep`` best branches of each tree, ``branch`` from 1.

    A branch's score is the mean of its messages' scores (null scores count as 0), ties go to the
    longer branch and then to the smaller leaf.
    """
    paths = leaf_paths(messages)
    scores = messages.dropDuplicates(["tree", "message"]).select("tree", "message", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scored = paths.join(scores, ["tree", "message"]).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("turns"), "leaf")
    best = scored.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep).select("tree", "leaf", "branch")
    return paths.join(best, ["tree", "leaf"])


def formatted(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, branch, text, mask, n_turns): each chosen path as one conversation with its loss mask.

    ``messages`` has tree, message, parent, role, text, score; null roles and texts count as empty,
    repeated messages as one; a tree of any shape gives ``keep`` rows at most. A conversation is one row and
    has to fit in memory; its turns meet in one task, other conversations anywhere.
    """
    rows = messages.dropDuplicates(["tree", "message"]).select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = ranked_paths(messages, keep).join(rows, ["tree", "message"])
    told = turns.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches):
        for batch in sliced(batches):
            texts, masks, counts = [], [], []
            for turns in batch.column(3).to_pylist():
                parts, mask, at = [], [], 0
                for t in turns:
                    head, body, tail = f"{BEGIN}{escape_role(t['role'])}\n", escape(t["text"]), f"{END}\n"
                    if t["role"] == "assistant":
                        mask.append([at + len(head), at + len(head) + len(body)])
                    parts += [head, body, tail]
                    at += len(head) + len(body) + len(tail)
                texts.append("".join(parts))
                masks.append(mask)
                counts.append(len(turns))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int64()))), pa.array(counts, pa.int64())],
                ["tree", "leaf", "branch", "text", "mask", "n_turns"],
            )

    kinds = dict(told.dtypes)
    return told.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, branch int, text string, mask array<array<bigint>>, n_turns long")


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; raises if it is none."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """(tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted texts and masks."""

    def run(batches):
        for batch in sliced(batches):
            out = []
            for text, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in mask)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(conversations.dtypes)["tree"]
    return conversations.select("tree", "branch", "text", "mask").mapInArrow(
        run, f"tree {kind}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chained(rows: DataFrame) -> DataFrame:
    """Reply trees from plain conversations (conv_id, turn, role, text): each row replies to the one before it.

    Rows lie by turn, null turns first, rows of one turn by role and text; repeated rows are turns of
    their own. A row without conv_id belongs to no other: it is a conversation by itself, in a tree named after
    its place in the table.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    alone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), alone).alias("tree"), "turn", "role", "text")
    at = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return at.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
