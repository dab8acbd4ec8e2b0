"""Repair of conversation structure over a suffix-shared automaton.

A conversation is a word of signatures, one letter a row: the role's initial class
(s, u, a or other) and whether the text is cut short.  Rows that must go (blank, or
said before) cost the same everywhere and change no state, so they are not part of
the word.  Words are cut into chunks of at most ``chunk`` letters, so that a
conversation of any length is many small words.

All distinct words are sorted from their end and read as a stream.  Consecutive words
share their longest common ending, so every ending is one node of an acyclic
automaton (a suffix-shared DAWG), made once.  A node holds, for each state of the
grammar ``(s?(ua)+)?``, the cost to go, the first edit and the best audit of what
follows.  What follows a chunk is a vector of four costs: the end of the conversation,
or for inner chunks the cost to go of the chunk after it, found by composing the
chunks' 4 x 4 cost tables from the end.  Options of a state begin with different
letters, so ties are settled by the first letter alone.

Edits: K keep 0, R rerole to user or assistant 1, D delete 2, I insert an empty text of
user or assistant 5; a row cut short that stays adds 5.  Inserts stand as late as
possible, after rows that go.

Texts are shuffled once, by conversation, for the rows in order and their digest; the
digest is sequential by nature, so a conversation's texts pass through one task, as a
stream that holds one batch.

Defined results: null roles and texts are one space; null conversation ids are one
conversation and null turns come first; rows of one turn go by role, then by the md5
of ``role:text``; equal rows stand together and are blank or said before from the
second on.  A role without a first letter among s, u, a is kept by no grammar, so it
is reroled or goes.  A conversation whose rows are all dropped has zeros, an empty
audit and the digest of the empty string.  An empty table gives no rows; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from folioscan.llm import common

CHUNK = 256
WHITE = " \t\n\x0b\x0c\r"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
CUT_SHORT = 5
FAR = 1 << 60
#: cost to go at the end of a conversation: START and AFTER_A may end, the others insert
END = (0, 10, 5, 0)
#: state after a user or assistant that the grammar asks for, by state
ASKED = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
#: state after a kept row, by (state, initial)
KEPT = {
    (START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U,
}


# -- the automaton -------------------------------------------------------------


def step(letter: str | None, after: list[tuple]) -> list[tuple]:
    """Per state (cost to go, edit, next state, whether the letter is used) before ``letter``.

    ``after`` is the same after it, by cost first.  A capital letter is a row cut
    short; without a letter only inserts are possible, as at the end.
    """
    out: list[tuple] = []
    for state in range(4):
        options = []
        if letter is not None:
            cut = CUT_SHORT if letter.isupper() else 0
            options.append((after[state][0] + COST["D"], "D", state, True))
            if (state, letter.lower()) in KEPT:
                to = KEPT[state, letter.lower()]
                options.append((after[to][0] + cut, "K", to, True))
            to = ASKED[state][1]
            options.append((after[to][0] + COST["R"] + cut, "R", to, True))
        else:
            options.append((after[state][0], "", state, True))
        out.append(min(options))
    for _ in range(3):  # inserts before it: at most three in a row
        out = [min(best, (out[ASKED[s][1]][0] + COST["I"], "I", ASKED[s][1], False)) for s, best in enumerate(out)]
    return out


class Automaton:
    """Nodes of the endings of the words seen last, for one vector of costs after them.

    Words come sorted from their end; ``word`` returns the path of a word's nodes, the
    first being the node of the whole word.  ``made`` counts the nodes.
    """

    def __init__(self, after: tuple):
        self.after = [(c, "", s, True) for s, c in enumerate(after)]
        self.path: list[tuple[str, list[tuple], list[str]]] = []
        self.made = 0

    def word(self, word: str) -> list[tuple]:
        """Per state (cost to go, audit, state at the end) of a word."""
        ending = word[::-1]
        keep = 0
        while keep < min(len(ending), len(self.path)) and self.path[keep][0] == ending[keep]:
            keep += 1
        del self.path[keep:]
        for letter in ending[keep:]:
            before = self.path[-1][1] if self.path else [(c, s, ("", s)) for s, (c, *_) in enumerate(self.after)]
            self.path.append((letter, self._node(letter, before), []))
            self.made += 1
        top = self.path[-1][1] if self.path else [(c, s, ("", s)) for s, (c, *_) in enumerate(self.after)]
        return [(cost, *_audit(best)) for cost, _, best in top]

    def _node(self, letter: str, after: list[tuple]) -> list[tuple]:
        """Per state (cost, state, audit as a chain that shares the following node's)."""
        best = step(letter, [(cost,) for cost, *_ in after])
        chains: list = [None] * 4

        def chain(state: int):
            if chains[state] is None:
                _, edit, to, used = best[state]
                chains[state] = (edit, after[to][2] if used else chain(to))
            return chains[state]

        return [(best[s][0], s, chain(s)) for s in range(4)]


def _audit(chain: tuple) -> tuple[str, int]:
    out = []
    while not isinstance(chain[1], int):
        out.append(chain[0])
        chain = chain[1]
    return "".join(out) + chain[0], chain[1]


def ends(costs: tuple) -> list[tuple]:
    """Per state (cost to go, audit of inserts) at the end of a conversation."""
    return [(c, "I" * (c // COST["I"])) for c in costs]


def table(word: str) -> list[list[int]]:
    """Least cost of a word from each state to each state."""
    rows = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for letter in reversed(word):
        columns = [[c for c, *_ in step(letter, [(rows[p][q],) for p in range(4)])] for q in range(4)]
        rows = [[min(columns[q][p], FAR) for q in range(4)] for p in range(4)]
    return rows


# -- rows ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) after damage by crc32 of ``conv_id:turn``, nulls as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            space("role").alias("role"), space("text").alias("text"), hit.alias("hit"),
        )
        .withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", "turn",
            F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            (F.col("hit") == 0).alias("dropped"),
        )
    )


KEYS = ["conv_id", "has_turn", "turn", "role", "said"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order (``KEYS``) and ``last``, the last character that is no white space."""
    said = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")))
    text = F.coalesce("text", F.lit(" "))
    return rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": text}).select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role", said.alias("said"), "text",
        F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1)).alias("last"),
    )


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, sub, word, turns, roles, saids): the rows that may stay, in order and cut into chunks."""
    first = F.min(F.struct("has_turn", "turn")).alias("at")
    stay = rows.where("last <> ''").groupBy("conv_id", "role", "said").agg(first, F.any_value("last").alias("last"))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("last").isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    stay = stay.select("conv_id", "at.has_turn", "at.turn", "role", "said", letter.alias("letter"))
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("sub", pa.int32()), ("word", pa.string()),
         ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("saids", pa.list_(pa.string()))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sub, at, held = TaskContext.get().partitionId(), 0, None, []

        def done() -> tuple:
            turns, roles, saids, letters = zip(*held)
            return (at[0], part, sub, "".join(letters), turns, roles, saids)

        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for conv, *row in zip(*columns):
                if at != (conv,) or len(held) == chunk:
                    if held:
                        out.append(done())
                        sub, held = sub + 1, []
                    at = (conv,)
                held.append(row)
            yield _batch(out, schema)
        yield _batch([done()] if held else [], schema)

    n = common.parts_of(rows.sparkSession, stay.count(), 200_000)
    return (
        stay.repartitionByRange(n, *KEYS)
        .sortWithinPartitions(*KEYS)
        .select("conv_id", "turn", "role", "said", "letter")
        .mapInArrow(cut, "conv_id long, part int, sub int, word string, turns array<long>, roles array<string>, saids array<string>")
    )


def _stream(df: DataFrame, columns: list[str], fn, schema: str, arrow: pa.Schema, *, order: list) -> DataFrame:
    """``fn`` over the rows of one conversation after the other; it gets (new conversation?, row) and gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, {}
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (row[0],):
                    at = (row[0],)
                    state.clear()
                out.extend(fn(state, *row))
            yield _batch(out, arrow)

    return df.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


# -- costs and audits ----------------------------------------------------------

ENDED = ",".join(map(str, END))


def tables(words: DataFrame) -> DataFrame:
    """(word, costs): the 4 x 4 cost table of every word."""
    schema = pa.schema([("word", pa.string()), ("costs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(w, [c for row in table(w) for c in row]) for w in batch.column(0).to_pylist()], schema)

    return words.mapInArrow(run, "word string, costs array<long>")


def _followed(many: DataFrame) -> DataFrame:
    """(conv_id, part, sub, after): the costs after every chunk of conversations of several chunks, least 0."""

    def link(state: dict, conv: int, part: int, sub: int, costs: list[int]):
        after = state.get("after", END)
        least = min(after)
        yield conv, part, sub, ",".join(str(c - least) for c in after)
        state["after"] = tuple(min(costs[4 * p + q] + after[q] for q in range(4)) for p in range(4))

    arrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("sub", pa.int32()), ("after", pa.string())])
    costs = tables(many.select("word").distinct())
    return _stream(
        many.join(costs, "word"), ["conv_id", "part", "sub", "costs"], link, "conv_id long, part int, sub int, after string",
        arrow, order=[F.desc("part"), F.desc("sub")],
    )


def audits(words: DataFrame) -> DataFrame:
    """(word, after, costs, audits, ends) for ``words(word, after)``: per state, from one automaton a task and vector."""
    schema = pa.schema(
        [("word", pa.string()), ("after", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
         ("ends", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, None
        for batch in batches:
            out = []
            for word, after in zip(*(c.to_pylist() for c in batch.columns)):
                if after != at:
                    at, automaton = after, Automaton(tuple(map(int, after.split(","))))
                out.append((word, after, *zip(*automaton.word(word))))
            yield _batch(out, schema)

    n = common.parts_of(words.sparkSession, words.count(), 20_000)
    ending = F.reverse("word")
    return (
        words.repartitionByRange(n, "after", ending)
        .sortWithinPartitions("after", ending)
        .select("word", "after")
        .mapInArrow(run, "word string, after string, costs array<long>, audits array<string>, ends array<int>")
    )


def audited(rows: DataFrame, chunk: int = CHUNK, hot_share: int = 1000) -> DataFrame:
    """Chunks with ``audit``, the best edits of their rows, and ``tail``, the inserts at the end of the conversation."""
    own = common.stored(chunks(rows, chunk), "dialogue-chunks")
    of = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.struct("part", "sub")).alias("final"))
    several = common.stored(of.where("n > 1").withColumnRenamed("conv_id", "c"), "dialogue-long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    many = own.join(several, same).withColumn("final", F.struct("part", "sub") == F.col("final")).drop("c", "n")
    many = common.stored(many, "dialogue-many")
    after = _followed(many).toDF("c", "p", "s", "after")
    many = many.join(after, same & (F.col("part") == F.col("p")) & (F.col("sub") == F.col("s"))).drop("c", "p", "s")
    single = own.join(several, same, "left_anti").select("*", F.lit(True).alias("final"), F.lit(ENDED).alias("after"))
    whole = common.stored(single.withColumn("alone", F.lit(True)).unionByName(many.withColumn("alone", F.lit(False))), "dialogue-words")
    counts = common.stored(whole.groupBy("word", "after").agg(F.count("*").alias("n")), "dialogue-distinct")
    total = counts.agg(F.sum("n")).first()[0] or 0
    planned = common.stored(audits(counts.select("word", "after")), "dialogue-audits")
    # words of more than a fixed share of all chunks are few: they are broadcast, so no task gets all their chunks
    hot = counts.where(F.col("n") * hot_share > total).select("word", "after")
    often = whole.join(F.broadcast(planned.join(hot, ["word", "after"], "left_semi")), ["word", "after"])
    rare = whole.join(F.broadcast(hot), ["word", "after"], "left_anti").join(planned, ["word", "after"])
    best = common.stored(often.unionByName(rare), "dialogue-best")
    tails = F.array(*[F.lit(a) for _, a in ends(END)])
    audit = lambda state: (F.col("audits")[state], F.when(F.col("final"), tails[F.col("ends")[state]]).otherwise(""))

    def walk(state: dict, conv, part, sub, turns, roles, saids, audits, ends_, final):
        at = state.get("at", START)
        state["at"] = ends_[at]
        yield conv, turns, roles, saids, audits[at], ends(END)[ends_[at]][1] if final else ""

    arrow = pa.schema(
        [("conv_id", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("saids", pa.list_(pa.string())),
         ("audit", pa.string()), ("tail", pa.string())]
    )
    alone = best.where("alone")
    first, tail = audit(START)
    alone = alone.select("conv_id", "turns", "roles", "saids", first.alias("audit"), tail.alias("tail"))
    linked = _stream(
        best.where("NOT alone"), ["conv_id", "part", "sub", "turns", "roles", "saids", "audits", "ends", "final"], walk,
        "conv_id long, turns array<long>, roles array<string>, saids array<string>, audit string, tail string", arrow,
        order=["part", "sub"],
    )
    return alone.unionByName(linked)


# -- repaired rows -------------------------------------------------------------

ROW = "conv_id long, edit string, fault string, turn long, role string, text string, new_role string"


def _edited(rows: DataFrame, dropped: DataFrame, chunk: int) -> DataFrame:
    """Rows in order with their edits, conversation after conversation within a partition."""
    best = common.stored(audited(rows, chunk), "dialogue-edits")
    edits = F.arrays_zip(
        F.col("turns").alias("turn"), F.col("roles").alias("role"), F.col("saids").alias("said"),
        F.regexp_extract_all("audit", F.lit("I*[DKR]"), F.lit(0)).alias("edit"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    marks = best.select("conv_id", F.explode(edits).alias("e")).select(
        "conv_id", F.lit(0).alias("tail"), F.col("e.turn").isNotNull().alias("has_turn"), "e.turn", "e.role", "e.said",
        F.lit(0).alias("kind"), "e.edit", none("string").alias("text"),
    )
    at_end = best.where("tail <> ''").select(
        "conv_id", F.lit(1).alias("tail"), none("boolean").alias("has_turn"), none("long").alias("turn"), none("string").alias("role"),
        none("string").alias("said"), F.lit(2).alias("kind"), F.col("tail").alias("edit"), none("string").alias("text"),
    )
    texts = rows.select("conv_id", F.lit(0).alias("tail"), "has_turn", "turn", "role", "said", F.lit(1).alias("kind"),
                        none("string").alias("edit"), "text")
    gone = dropped.select("conv_id").distinct().select(
        "conv_id", F.lit(2).alias("tail"), none("boolean").alias("has_turn"), none("long").alias("turn"), none("string").alias("role"),
        none("string").alias("said"), F.lit(3).alias("kind"), none("string").alias("edit"), none("string").alias("text"),
    )
    schema = pa.schema(
        [("conv_id", pa.int64()), *[(c, pa.int64() if c == "turn" else pa.string())
                                    for c in ("edit", "fault", "turn", "role", "text", "new_role")]]
    )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, pending = None, START, None
        for batch in batches:
            out = []
            for conv, turn, role, kind, marked, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (conv,):
                    if kind == 3:  # all its rows are dropped
                        out.append((conv, None, None, None, None, None, None))
                    at, state, pending = (conv,), START, None
                if kind == 0:
                    pending = marked
                if kind in (0, 3):
                    continue
                if kind == 1 and pending is None:
                    fault = "duplicate" if text.strip(WHITE) else "blank"
                    out.append((conv, "D", fault, turn, role, text, None))
                    continue
                for e in marked if kind == 2 else pending:
                    if e == "I":
                        new, state = ASKED[state]
                        out.append((conv, "I", None, None, None, "", new))
                        continue
                    fault = None if text.rstrip(WHITE)[-1] in ".!?" else "truncated"
                    new = None
                    if e == "K":
                        new, state = role, KEPT[state, role[:1]]
                    elif e == "R":
                        new, state = ASKED[state]
                    out.append((conv, e, fault, turn, role, text, new))
                pending = None
            yield _batch(out, schema)

    together = marks.unionByName(at_end).unionByName(texts).unionByName(gone)
    order = ["conv_id", "tail", "has_turn", "turn", "role", "said", "kind"]
    return (
        together.repartition("conv_id")
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "kind", "edit", "text")
        .mapInArrow(edit, ROW)
    )


def _split(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    if "dropped" not in conversations.columns:
        conversations = conversations.withColumn("dropped", F.lit(False))
    common.bounded_batches(conversations.sparkSession)
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "dropped"
    )
    return _ordered(own.where("NOT dropped")), own.where("dropped")


def repaired(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows with their edits: conv_id, edit, fault, turn, role, text, new_role (null: the row goes).

    A conversation whose rows are all ``dropped`` is one row without an edit.
    """
    rows, dropped = _split(conversations)
    return _edited(rows, dropped, chunk)


def repair_digest(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a conversation: faults, cost, audit and digest of the repaired text."""
    rows, dropped = _split(conversations)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in names[-2:] else pa.int64()) for c in names])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, {}

        def done() -> tuple:
            n = s["faults"]
            gaps = s["turn"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
            return (at[0], gaps, n["blank"], n["duplicate"], n["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest())

        for batch in batches:
            out = []
            for conv, edit, fault, turn, role, text, new in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (conv,):
                    if at is not None:
                        out.append(done())
                    at = (conv,)
                    s = {"faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "turns": 0, "turn": None, "first": None,
                         "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "role": None, "lines": 0}
                if edit is None:
                    continue
                s["audit"].append(edit)
                s["cost"] += COST[edit] + (CUT_SHORT if fault == "truncated" and edit != "D" else 0)
                if fault:
                    s["faults"][fault] += 1
                if role is not None:
                    if s["role"] is not None and s["role"][:1] + role[:1] not in ("su", "ua", "au"):
                        s["illegal"] += 1
                    s["role"] = role
                if turn is not None and turn != s["turn"]:
                    s["first"] = turn if s["first"] is None else s["first"]
                    s["turn"], s["turns"] = turn, s["turns"] + 1
                if new is not None:
                    s["sha"].update(("\n" if s["lines"] else "").encode() + f"{new}:{text}".encode())
                    s["lines"] += 1
            yield _batch(out, schema)
        yield _batch([done()] if at is not None else [], schema)

    return _edited(rows, dropped, chunk).mapInArrow(
        fold,
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )


# -- SQL -----------------------------------------------------------------------


def _repair_sql() -> str:
    """The same by a recursive query: per state a string of nine digits of cost and the audit after it."""
    add = lambda v, c, e: f"lpad(((({v})[1:9])::INT + {c})::VARCHAR, 9, '0') || '{e}' || ({v})[10:]"
    to = {s: t for s, (_, t) in ASKED.items()}
    states = []
    for p in range(4):
        kept = " ".join(f"WHEN letter = '{x}' THEN {add(f'v{t}', 'cut', 'K')}" for (s, x), t in KEPT.items() if s == p)
        free = f"least({add(f'v{p}', 2, 'D')}, {add(f'v{to[p]}', '(1 + cut)', 'R')}, CASE {kept} ELSE '~' END)"
        states.append(f"CASE WHEN forced THEN {add(f'v{p}', 2, 'D')} ELSE {free} END AS v{p}")
    relaxed = f"SELECT conv_id, pos, {', '.join(states)} FROM (SELECT r.*, v0, v1, v2, v3 FROM dp JOIN sig r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1)"
    for _ in range(3):
        options = ", ".join(f"least(v{p}, {add(f'v{to[p]}', 5, 'I')}) AS v{p}" for p in range(4))
        relaxed = f"SELECT conv_id, pos, {options} FROM ({relaxed})"
    end = ", ".join(f"'{c:09d}{a}' AS v{s}" for s, (c, a) in enumerate(ends(END)))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH RECURSIVE
    crc AS (SELECT list(c ORDER BY i) AS t
            FROM (SELECT i, list_reduce([i::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8],
                         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                  FROM range(256) r(i))),
    hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT,
                           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                          lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
            FROM conversations, crc),
    row AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, range(2) c(i) WHERE hit <> 0 AND (i = 0 OR hit = 3)),
    said AS (SELECT *, md5(length(role) || ':' || role || ':' || text) AS said, right(rtrim(text, {white}), 1) AS last FROM row),
    num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS pos FROM said),
    dup AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, said ORDER BY pos) > 1 AS again,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM num),
    sig AS (SELECT conv_id, pos, role, text, turn, left(role, 1) AS letter, last = '' OR again AS forced,
                   CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                   CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 5 END AS cut,
                   before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
            FROM dup),
    dp AS (SELECT conv_id, max(pos) + 1 AS pos, {end} FROM sig GROUP BY conv_id
           UNION ALL {relaxed}),
    best AS (SELECT conv_id, v0[1:9]::BIGINT AS cost, v0[10:] AS audit FROM dp WHERE pos = 1),
    edit AS (SELECT conv_id, i, audit[i] AS e, i - length(replace(audit[1:i], 'I', '')) AS ins FROM best, range(1, 100000) r(i) WHERE i <= length(audit)),
    line AS (SELECT e.conv_id, i, e, s.role, CASE e WHEN 'I' THEN '' ELSE s.text END AS text,
                    row_number() OVER (PARTITION BY e.conv_id ORDER BY i) AS o
             FROM edit e LEFT JOIN sig s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e <> 'I' AND s.pos = i - ins
             WHERE e <> 'D'),
    sys AS (SELECT *, max(CASE WHEN o = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM line),
    done AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                               || ':' || text, chr(10) ORDER BY i)) AS sha FROM sys GROUP BY conv_id),
    n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM sig GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
           coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
    """


REPAIR_SQL = _repair_sql()
