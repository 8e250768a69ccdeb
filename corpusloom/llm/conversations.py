"""Repair of the turns of conversations at the least cost, by recursive DuckDB queries.

Roles must read ``(s?(ua)+)?``.  Rows are kept, reroled or deleted and turns inserted, so that
the cost is least; of equally cheap ways the one whose audit, a letter for each edit, comes
first in ASCII order is taken.

Each turn is a small digest row: role, flags, a hash of its text.  Equal rows of one turn
are counted before anything is shuffled, since all but the first are duplicates.  Digests
are sorted by ranges of conversation and turn and numbered, and stretches of 256 numbers are
dealt out by their hash; in a batch of stretches one recursive query advances a turn of all
conversations at a time, and keeps for each state of the grammar the least cost and its
audit.  A conversation that spans stretches is walked from every state it may enter one in,
and the same query then joins its stretches, 256 at a time, so neither a task nor a
recursion grows with the longest conversation.

Only then do texts move, once: the turns of a conversation stream past its audit in order.
That last pass holds one row and the audit, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import ASCII_SPACE, cut_lineage, look_up

STRETCH_BITS = 8
#: Rows that one recursive query takes, about.
BATCH_ROWS = 40_000
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's; and what each may go on with.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def inserts(state: int) -> dict[int, int]:
    """How many inserted turns lead from a state to each other one; more are never of use."""
    out, at = {state: 0}, state
    while True:
        at = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}[at]
        if at in out:
            return out
        out[at] = max(out.values()) + 1


def moves() -> pd.DataFrame:
    """What can be done with one row in each state, inserted turns before it included; ``initial`` is what a kept row's role must begin with."""
    rows = []
    for state in NEXT:
        for at, n in inserts(state).items():
            rows.append((state, at, n * INSERT + DELETE, "I" * n + "D", None, False))
            for initial, then in NEXT[at].items():
                rows.append((state, then, n * INSERT, "I" * n + "K", initial, True))
                if initial in ROLES:
                    rows.append((state, then, n * INSERT + REROLE, "I" * n + "R", None, True))
    return pd.DataFrame(rows, columns=["state", "next", "cost", "edits", "initial", "stays"])


#: The edits of each row, in each state: ``(walk, step, state, next, cost, edits)``.
EDGES_SQL = f"""
SELECT t.walk, t.step, m.state, m.next, m.cost + CASE WHEN m.stays AND t.truncated THEN {TRUNCATED} ELSE 0 END + {DELETE} * (t.n - 1) AS cost, m.edits || repeat('D', t.n - 1) AS edits
FROM turns t JOIN moves m ON (NOT m.stays OR NOT t.dropped) AND (m.initial IS NULL OR m.initial = t.initial)
"""
#: One step of all walks at a time.
WALK_SQL = """
WITH RECURSIVE walked(walk, step, entry, state, best) AS (
  SELECT walk, 0, entry, entry, {'cost': 0::BIGINT, 'audit': ''} FROM entries
  UNION ALL
  SELECT w.walk, w.step + 1, w.entry, e.next, min({'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.edits})
  FROM walked w JOIN edges e ON e.walk = w.walk AND e.step = w.step + 1 AND e.state = w.state GROUP BY ALL)
SELECT w.walk, w.entry, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walked w JOIN ends USING (walk, step)
"""


def _connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '512MB'")
    con.register("moves", moves())
    return con


def _walk(con, edges_sql: str, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """``(walk, entry, state, cost, audit)`` after the last step of each walk of ``rows``, from each of its entries."""
    con.register("turns", rows)
    con.register("entries", entries)
    con.execute(f"CREATE OR REPLACE TEMP TABLE edges AS {edges_sql}")
    con.execute("CREATE OR REPLACE TEMP TABLE ends AS SELECT walk, max(step)::INT AS step FROM turns GROUP BY walk")
    return con.execute(WALK_SQL).fetchdf()


def _entries(firsts: np.ndarray) -> pd.DataFrame:
    """All four states for the walks that may go on from somewhere, the empty one for the others."""
    walk = np.repeat(np.arange(len(firsts)), np.where(firsts, 1, 4))
    return pd.DataFrame({"walk": walk, "entry": np.concatenate([np.arange(1 if f else 4) for f in firsts]) if len(firsts) else walk})


def _whole(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows in frames of some 40,000, none of which ends inside a group of ``key``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BATCH_ROWS:
            own = pd.concat(held, ignore_index=True)
            same = (own[key] == own[key].iloc[-1]).all(axis=1).to_numpy()
            cut = len(own) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield own.iloc[:cut]
            held = [own.iloc[cut:]]
    own = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(own):
        yield own


def _changes(*columns: pd.Series) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        values = c.to_numpy()
        out[1:] |= values[1:] != values[:-1]
    out[:1] = True
    return out


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the contract's damage; dropped rows have 0 copies.

    Null roles and texts are one space, and so are null ids and turns in what is hashed.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    role, text = shown(F.col(role_col)), shown(F.col(text_col))
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def conv_key(conv: Column) -> Column:
    """A key that is never null; all rows without an id are one conversation."""
    return F.coalesce(conv.cast("string"), F.lit(" "))


def digests(rows: DataFrame) -> DataFrame:
    """``(at, key, conv_id, turn, role, body, initial, blank, truncated, n)`` of ``rows(conv_id, turn, role, text, copies)``: one row for equal rows of a turn.

    ``at`` numbers them in order of conversation, turn (nulls first), role, and the hash of the text.
    """
    bare = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    marked = rows.where("copies > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("body"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "copies")
    order = ["conv_id", "turn", "role", "body"]
    counted = marked.groupBy(*order).agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.sum("copies").alias("n"))
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.select(F.monotonically_increasing_id().alias("at"), conv_key(F.col("conv_id")).alias("key"), "*", F.substring("role", 1, 1).alias("initial")))


def faults(turns: DataFrame) -> DataFrame:
    """``digests`` with ``first``: whether no earlier turn of the conversation has the row's role and text."""
    same = ["key", "role", "body"]
    earliest = cut_lineage(turns.groupBy(*same).agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("weight")).where("weight > 1"))
    return look_up(turns, earliest, same, "weight").withColumn("first", F.coalesce(F.col("at") == F.col("earliest"), F.lit(True))).drop("earliest")


def counts(turns: DataFrame) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated)`` from ``faults``; each row's first fault counts."""
    n, first = F.col("n"), F.col("first")
    total = lambda c: F.sum(c).cast("long")
    # By turn first, so that what is told apart never meets in one task.
    per = turns.groupBy("key", "turn").agg(
        total(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), total(F.when(F.col("blank"), 0).otherwise(n - first.cast("long"))).alias("duplicate"),
        total((~F.col("blank") & first & F.col("truncated")).cast("long")).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return per.groupBy("key").agg(gaps.cast("long").alias("gaps"), *(total(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")))


PARTS = "key string, stretch long, entry int, state int, cost long, audit string"


def _stretches(turns: DataFrame) -> DataFrame:
    """``PARTS``: for each conversation in each stretch, the least cost and its audit from each state it may be entered in to each state it may be left in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con = _connect()
        for own in _whole(batches, ["stretch"]):
            new = _changes(own["stretch"], own["key"])
            walk = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            rows = own[["initial", "dropped", "truncated", "n"]].assign(walk=walk, step=np.arange(len(own)) - starts[walk] + 1)
            # Only what stands first in a stretch may have begun before it.
            found = _walk(con, EDGES_SQL, rows, _entries(~_changes(own["stretch"])[starts]))
            at = starts[found["walk"].to_numpy()]
            yield found.assign(key=own["key"].to_numpy()[at], stretch=own["stretch"].to_numpy()[at])[["key", "stretch", "entry", "state", "cost", "audit"]]

    rows = turns.select(F.shiftright("at", STRETCH_BITS).alias("stretch"), "at", "key", "initial", (F.col("blank") | ~F.col("first")).alias("dropped"), "truncated", "n")
    return rows.repartition("stretch").sortWithinPartitions("stretch", "at").mapInPandas(run, PARTS)


def _joined(parts: DataFrame) -> DataFrame:
    """``PARTS`` of conversations that span several stretches, 256 neighbouring ones put into one."""
    from pyspark.sql import Window as W

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con = _connect()
        for own in _whole(batches, ["key", "block"]):
            new = _changes(own["key"], own["block"])
            walk = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            rows = own[["entry", "state", "cost", "audit"]].assign(walk=walk, step=own["step"] + 1)
            found = _walk(con, "SELECT walk, step, entry AS state, state AS next, cost, audit AS edits FROM turns", rows, _entries(own["block"].to_numpy()[starts] == 0))
            at = starts[found["walk"].to_numpy()]
            yield found.assign(key=own["key"].to_numpy()[at], stretch=own["block"].to_numpy()[at])[["key", "stretch", "entry", "state", "cost", "audit"]]

    rank = (F.dense_rank().over(W.partitionBy("key").orderBy("stretch")) - 1).cast("long")
    placed = parts.withColumn("rank", rank).select("key", F.shiftright("rank", STRETCH_BITS).alias("block"), (F.col("rank") % (1 << STRETCH_BITS)).cast("int").alias("step"), "entry", "state", "cost", "audit")
    return placed.repartition("key", "block").sortWithinPartitions("key", "block", "step").mapInPandas(run, PARTS)


def audits(turns: DataFrame) -> DataFrame:
    """``(key, cost, audit)`` of each conversation in ``faults``."""
    parts, done = cut_lineage(_stretches(turns)), None
    while True:
        spans = parts.groupBy("key").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a < b").select("key")
        several = cut_lineage(spans)
        single = parts.join(several, "key", "left_anti")
        done = single if done is None else done.unionByName(single)
        if several.isEmpty():
            break
        parts = cut_lineage(_joined(parts.join(several, "key", "left_semi")))
    end = [(state, min((n, then) for then, n in inserts(state).items() if then in (EMPTY, ASSISTANT))[0]) for state in NEXT]
    more = F.coalesce(*(F.when(F.col("state") == state, F.lit(n)) for state, n in end))
    best = F.min(F.struct((F.col("cost") + more * INSERT).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), more)).alias("audit"))).alias("best")
    return done.where(F.col("entry") == EMPTY).groupBy("key").agg(best).select("key", "best.cost", "best.audit")


class _Conversation:
    """Turns of one conversation in order, against its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.last, self.illegal, self.n = audit, 0, EMPTY, None, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._stays("I", ROLES["a" if self.state == USER else "u"], "")

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of what stays of a turn, after what is inserted before it."""
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._stays(edit, role, text)
        elif edit == "R":
            yield self._stays(edit, ROLES["a" if self.state == USER else "u"], text)

    def _stays(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = NEXT[self.state][role[:1]]
        self.n += 1
        return edit, role, text


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's row of ``found`` and after it its turns in order, whole conversations in one partition."""
    heads = found.select("key", "conv_id", F.struct(*(c for c in found.columns if c not in ("key", "conv_id"))).alias("head"))
    empty = lambda kind: F.lit(None).cast(kind)
    turns = rows.where("copies > 0").select(conv_key(F.col("conv_id")).alias("key"), "conv_id", empty(heads.schema["head"].dataType).alias("head"), "turn", "role", "text", "copies")
    every = heads.select("key", "conv_id", "head", empty("long").alias("turn"), empty("string").alias("role"), empty("string").alias("text"), F.lit(0).cast("long").alias("copies")).unionByName(turns)
    # The hash is null for heads, which come first.
    every = every.withColumn("body", F.sha2("text", 256))
    return every.repartition("key").sortWithinPartitions("key", F.col("head").isNull(), "turn", "role", "body").select("conv_id", F.col("head.audit").alias("audit"), *(F.col(f"head.{c}").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "cost")), "role", "text", "copies")


def _ids(batch: pd.DataFrame) -> list[int | None]:
    return [None if k is pd.NA else k for k in batch["conv_id"].astype("Int64")]


def _framed(rows: list[tuple], schema: str) -> pd.DataFrame:
    """The first column may hold nulls."""
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return made.assign(conv_id=pd.array(made["conv_id"].astype(object).tolist(), "Int64"))


def plan(rows: DataFrame) -> DataFrame:
    """``(key, conv_id, gaps, blank, duplicate, truncated, cost, audit)`` for each conversation of ``rows(conv_id, turn, role, text, copies)``, also where no copy is left."""
    turns = cut_lineage(faults(digests(rows)))
    every = rows.select("conv_id").distinct().withColumn("key", conv_key(F.col("conv_id")))
    found = every.join(counts(turns), "key", "left").join(audits(turns), "key", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "cost")}
    return found.withColumns({**zero, "audit": F.coalesce("audit", F.lit(""))})


def repaired(rows: DataFrame) -> DataFrame:
    """``TURNS``: the turns of the repaired conversations in order (``place`` from 0), with the edit that left or made each: K, R or I."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key = None, None
        for batch in batches:
            out = []
            for conv, audit, role, text, copies in zip(_ids(batch), batch["audit"], batch["role"], batch["text"], batch["copies"], strict=True):
                if copies == 0:
                    out += [] if own is None else [(key, own.n - 1, *t) for t in own.inserted()]
                    own, key = _Conversation(audit), conv
                for _ in range(copies):
                    out += [(key, own.n - 1, *t) for t in own.turn(role, text)]
            yield _framed(out, TURNS)
        if own is not None:
            yield _framed([(key, own.n - 1, *t) for t in own.inserted()], TURNS)

    return _streamed(rows, plan(rows)).mapInPandas(run, TURNS)


def digest(rows: DataFrame) -> DataFrame:
    """The columns of ``DIGEST`` for each conversation of ``rows(conv_id, turn, role, text, copies)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own, seen = None, None, hashlib.sha256()

        def add(turns) -> None:
            for _, role, text in turns:
                seen.update(("\n" * (own.n > 1) + f"{role}:{text}").encode())

        def close() -> list[tuple]:
            if own is None:
                return []
            add(own.inserted())
            return [(*head[:5], own.illegal, head[5], own.audit, seen.hexdigest())]

        for batch in batches:
            out = []
            for key, audit, role, text, copies, *numbers in zip(_ids(batch), *(batch[c] for c in ("audit", "role", "text", "copies", "gaps", "blank", "duplicate", "truncated", "cost")), strict=True):
                if copies == 0:
                    out += close()
                    head, own, seen = (key, *map(int, numbers)), _Conversation(audit), hashlib.sha256()
                for _ in range(copies):
                    add(own.turn(role, text))
            yield _framed(out, DIGEST)
        yield _framed(close(), DIGEST)

    return _streamed(rows, plan(rows)).mapInPandas(run, DIGEST)


def repair_digest(table: DataFrame) -> DataFrame:
    """The contract's columns for each original ``conv_id``, of damaged ``conversations``.

    All rows without an id are one conversation.  Rows of one turn come in order of role,
    then of their text's SHA-256; equal ones are duplicates.  A role without any character
    cannot be kept.  A conversation that loses all rows has zeros, an empty audit and the
    empty text's hash; an empty table gives no rows.  Texts may have any length; other columns are not read.
    The turns of one conversation stream through one task, in order, as its hash asks for.
    """
    return digest(damaged(table))
