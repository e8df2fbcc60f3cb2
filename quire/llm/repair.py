"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

A conversation should read ``(s?(ua)+)?`` in role initials: perhaps a system turn, then users and assistants by turns. The
cheapest edits that make it so are a shortest path over rows and the four states of that expression: *keep* a row (free), *re-role*
it to user or assistant (2), *delete* it (3; blank and repeated rows have to go) and *insert* an empty turn (2). A
truncated row that stays costs 1 more.

The cost of the best ending is carried from the last row to the first as a vector with a number for each state. Adding a constant to a
vector changes no decision, and up to a constant only a few vectors exist (``VECTORS``), since states are two or three inserts
apart. Conversations are cut into chunks of rows, in the order of all rows. Without knowing what follows it, a chunk is run
backwards from every vector at once (speculation); vectors that come to differ only by a constant are one from
there on. Where all have become one, the chunk has converged: its first vector is known whatever follows. A chunk that hasn't waits
for the next one in fix-up passes, each of which also joins what neighbours have found, so that n chunks in a row that don't
converge (say, users only) take log2(n) passes, and the usual case takes none.

With the vectors known, the cheapest edits are read off forwards, in every state the alphabetically least of those that reach the
cost (D, I, K, R). A chunk is run from all four states at once, which converge in the same way and are stitched by the
same passes; then each chunk writes its part of the audit and its repaired turns. Only conversations of more than one chunk take
part in any pass.

Rows that repeat an earlier row's role and text are found by the task that cuts the chunks as far as it sees the conversation, and by the
least task per digest among tasks that share one.

Defined results: rows stand by turn, nulls first, rows of one turn by a digest of role and text, so copies are neighbours; a null
role or text is a single space; a null conversation id is one conversation; a conversation without rows has no result
here; an empty table gives none. A task holds a chunk (``ROWS`` rows or ``CHARACTERS`` characters, or one longer row) and a digest
of 16 bytes for each row of the conversation that it is reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.scans import running
from quire.session import settle

ROWS = 4096
CHARACTERS = 1 << 22

# --- fixed values: costs, states, faults ---------------------------------------------------------------------
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what has been read last
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = (USER, USER, ASSISTANT, USER)  # the turn that an insert or a new role makes
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE = 8, 9  # kinds of rows; others are twice the initial's number (3: any other), plus 1 if truncated
ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]


def _with_inserts(v: Sequence[float]) -> Vector:
    """Costs before inserts, from costs behind them."""
    user = min(v[USER], INSERT + v[ASSISTANT])
    assistant = min(v[ASSISTANT], INSERT + v[USER])
    return tuple(int(x) for x in (min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant))


def _choices(kind: int, after: Vector, state: int) -> list[tuple[int, str, int]]:
    """``(cost to the end, letter, next state)`` of a row's edits."""
    out = [(DELETE + after[state], "D", state)]
    if kind < BLANK:
        late = TRUNCATED * (kind % 2)
        to = STEPS.get((state, (INITIALS + "?")[kind // 2]))
        if to is not None:
            out.append((late + after[to], "K", to))
        out.append((REROLE + late + after[WANTED[state]], "R", WANTED[state]))
    return out


def _before(kind: int, after: Vector) -> Vector:
    return _with_inserts([min(_choices(kind, after, state))[0] for state in range(4)])


def _level(v: Vector) -> Vector:
    return tuple(x - v[ASSISTANT] for x in v)


def _tables() -> tuple[list[Vector], list[bytes]]:
    """All vectors up to a constant, that of an ended conversation first, and for each kind of row which one comes before which."""
    far = float("inf")
    vectors = [_level(_with_inserts([0, far, far, 0]))]
    at = {vectors[0]: 0}
    steps: list[list[int]] = [[] for _ in range(DUPLICATE + 1)]
    for v in vectors:  # grows meanwhile
        for kind, row in enumerate(steps):
            before = _level(_before(kind, v))
            if before not in at:
                at[before] = len(vectors)
                vectors.append(before)
            row.append(at[before])
    return vectors, [bytes(row).ljust(256, b"\0") for row in steps]


VECTORS, BEFORE = _tables()
ENDED = 0


def _edits(kind: int, after: Vector, state: int) -> tuple[str, int]:
    """The least letters, inserts and then the row's own, that reach the cost, and the state behind them."""
    before = _before(kind, after)
    letters = ""
    while True:
        choices = [(letter, to) for cost, letter, to in _choices(kind, after, state) if cost == before[state]]
        if INSERT + before[WANTED[state]] == before[state]:
            choices.append(("I", WANTED[state]))
        letter, state = min(choices)
        letters += letter
        if letter != "I":
            return letters, state


#: By kind, vector behind the row and state.
EDITS = [[[_edits(kind, v, state) for state in range(4)] for v in VECTORS] for kind in range(DUPLICATE + 1)]
#: The same, as a table from state to state.
FORWARD = [[bytes(to for _, to in states).ljust(256, b"\0") for states in vectors] for vectors in EDITS]


def speculate(kinds: bytes) -> bytes:
    """For every vector behind the rows, the one before them."""
    vectors = bytes(range(len(VECTORS)))
    for kind in reversed(kinds):
        vectors = vectors.translate(BEFORE[kind])
    return vectors


def behind_rows(kinds: bytes, end: int) -> list[int]:
    """The vector behind each row."""
    out = []
    for kind in reversed(kinds):
        out.append(end)
        end = BEFORE[kind][end]
    return out[::-1]


def states_through(kinds: bytes, end: int) -> bytes:
    """For every state before the rows, the one behind them."""
    states = bytes(range(4))
    for kind, v in zip(kinds, behind_rows(kinds, end)):
        states = states.translate(FORWARD[kind][v])
    return states


def trace(kinds: bytes, turns: Sequence[tuple[str, str]], end: int, state: int, last: bool) -> tuple[str, int, list[tuple[str, str]]]:
    """Letters of the edits, their cost, and the turns that they leave."""
    audit, cost, left = [], 0, []
    for kind, v, (role, text) in zip(kinds, behind_rows(kinds, end), turns):
        letters, to = EDITS[kind][v][state]
        audit.append(letters)
        for letter in letters:
            if letter == "I":
                cost += INSERT
                state = WANTED[state]
                left.append((ROLES[state], ""))
            elif letter == "D":
                cost += DELETE
            else:
                cost += TRUNCATED * (kind % 2) + REROLE * (letter == "R")
                left.append((ROLES[to] if letter == "R" else role, text))
        state = to
    while last and state in (SYSTEM, USER):
        audit.append("I")
        cost += INSERT
        state = WANTED[state]
        left.append((ROLES[state], ""))
    return "".join(audit), cost, left


def _kind(role: str, text: str, seen: set[bytes]) -> int:
    bare = text.rstrip(BLANKS)
    if not bare:
        return BLANK
    digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    if digest in seen:
        return DUPLICATE
    seen.add(digest)
    initial = INITIALS.find(role[0]) if role else -1
    return 2 * (initial if initial >= 0 else len(INITIALS)) + (bare[-1] not in ENDS)


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def chunks(talks: DataFrame) -> DataFrame:
    """``(conv_id, chunk, part, kinds, turns, first_turn, last_turn, n_turns, illegal)`` of rows ``(conv_id, turn, role, text)``, settled.

    Chunks of a conversation stand by ``chunk``; ``part`` is the task that cut it. ``n_turns`` counts different turns, nulls left
    out, ``illegal`` neighbours whose roles don't follow each other, both inside the chunk.
    """
    rows = talks.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumns({"tie": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})
    # copies without end are spread by their row
    order = ["conv_id", "turn", "tie", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    ids = rows.schema["conv_id"]
    fields = [ids, *T.StructType.fromDDL(
        "chunk long, part int, kinds binary, turns array<struct<role:string,text:string>>, first_turn long, last_turn long, n_turns long, illegal long"
    ).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done = size = 0
        here: object = None
        seen: set[bytes] = set()
        kinds = bytearray()
        turns: list[tuple[str, str]] = []
        numbers: list[int | None] = []

        def cut() -> pa.RecordBatch:
            known = [x for x in numbers if x is not None]
            illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(turns, turns[1:]))
            row = [here, (part << 40) + done, part, bytes(kinds), [{"role": r, "text": t} for r, t in turns],
                   known[0] if known else None, known[-1] if known else None, len(set(known)), illegal]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, types)], [f.name for f in fields])

        types: list[pa.DataType] = []
        for batch in batches:
            if not types:
                types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.binary(), _TURNS, *[pa.int64()] * 4]
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if turns and (conv != here or len(turns) >= ROWS or size + len(text) > CHARACTERS):
                    yield cut()
                    done, size = done + 1, 0
                    kinds.clear()
                    turns.clear()
                    numbers.clear()
                if conv != here:
                    here = conv
                    seen.clear()
                kinds.append(_kind(role, text, seen))
                turns.append((role, text))
                numbers.append(turn)
                size += len(text)
        if turns:
            yield cut()

    return settle(rows.mapInArrow(run, T.StructType(fields)))


def _late_copies(parts: DataFrame) -> DataFrame:
    """``(chunk, late)``: places of rows that a task before has seen, for conversations that tasks share."""
    rows = parts.select("conv_id", "part", "chunk", "kinds", F.posexplode("turns").alias("place", "t"))
    # what a task has seen itself is marked already, so a digest has one row per task here
    kind = F.conv(F.hex(F.substring("kinds", F.col("place") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.where(kind < BLANK).withColumn("d", F.md5(F.concat(F.length("t.role").cast("string"), F.lit(":"), "t.role", "t.text").cast("binary")))
    least = rows.groupBy("conv_id", "d").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    least = least.withColumnsRenamed({"conv_id": "_c", "d": "_d"})
    again = rows.join(least, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("d") == F.col("_d"))).where("part > least")
    return again.groupBy("chunk").agg(F.collect_list("place").alias("late"))


def _mapped(rows: DataFrame, fn: Callable[..., bytes], *args: str) -> DataFrame:
    """``rows`` with ``map``, an array of what ``fn`` says of the columns ``args``."""
    fields = [*rows.schema.fields, T.StructField("map", T.ArrayType(T.IntegerType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(fn(*values)) for values in zip(*[batch.column(a).to_pylist() for a in args])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def stitch(maps: DataFrame, first: int, step: int) -> DataFrame:
    """``(chunk, given)``: what each chunk is given by its neighbour.

    ``maps`` has ``(conv_id, chunk, ord, most, map)``; the neighbour's number is higher by ``step``, and the chunk without
    one is given ``first``. A chunk whose map has one value has converged and needs no neighbour; others are joined to what their
    neighbour stands for until all have.
    """
    outer = F.col("ord") == (F.col("most") if step > 0 else 1)
    value = F.when(outer, F.array_repeat(F.get("map", F.lit(first)), F.size("map"))).otherwise(F.col("map"))
    rows = settle(maps.select("conv_id", "chunk", "ord", "most", F.col("ord").alias("at"), value.alias("map")))
    while True:
        open_ = F.array_min("map") < F.array_max("map")
        if not rows.where(open_).take(1):
            break
        # ``at`` is the farthest chunk that the map takes in; the next one's map goes in front of it
        next_ = rows.select(F.col("conv_id").alias("_c"), (F.col("ord") - step).alias("_o"), F.col("at").alias("_at"), F.col("map").alias("_m"))
        both = rows.join(next_, open_ & F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_o")), "left")
        joined = F.when(F.col("_o").isNull(), F.col("map")).otherwise(F.transform("_m", lambda x: F.get("map", x)))
        rows = settle(both.select("conv_id", "chunk", "ord", "most", F.coalesce("_at", "at").alias("at"), joined.alias("map")))
    out = rows.select(F.col("conv_id").alias("_c"), (F.col("ord") - step).alias("_o"), F.get("map", F.lit(0)).alias("given"))
    return rows.select("conv_id", "chunk", "ord").join(out, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ord") == F.col("_o")), "left").select(
        "chunk", F.coalesce("given", F.lit(first)).alias("given")
    )


def repair(talks: DataFrame) -> DataFrame:
    """``(conv_id, chunk, kinds, first_turn, last_turn, n_turns, illegal, first_role, last_role, audit, cost, turns)``, a row per chunk.

    ``kinds`` tells faults, a byte per row; ``turns`` are those that the edits leave.
    """
    cut = chunks(talks)
    shared = cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("most"), F.min("part").alias("_a"), F.max("part").alias("_z"))
    shared = shared.where("most > 1").select(F.col("conv_id").alias("_c"), "most", (F.col("_a") < F.col("_z")).alias("_parts"))
    long = cut.join(shared, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    late = _late_copies(long.where("_parts"))
    marked = long.select("conv_id", "chunk", "most", "kinds").join(late, "chunk", "left")
    mark = lambda kinds, late: bytes(DUPLICATE if i in set_ else k for i, k in enumerate(kinds)) if (set_ := set(late or ())) else bytes(kinds)
    marked = _with_kinds(marked, mark)
    marked = running(marked, ["conv_id"], ["chunk"], {"ord": ("sum", F.lit(1).cast("bigint"))})
    back = settle(_mapped(marked, speculate, "kinds"))
    ends = stitch(back, ENDED, 1).withColumnRenamed("given", "end")
    known = settle(back.drop("map").join(ends, "chunk"))
    ways = _mapped(known, states_through, "kinds", "end")
    states = stitch(ways, START, -1).withColumnRenamed("given", "state")
    solved = known.join(states, "chunk").select("chunk", F.col("kinds").alias("_kinds"), "end", "state", (F.col("ord") == F.col("most")).alias("last"))
    rows = cut.join(solved, "chunk", "left").withColumn("kinds", F.coalesce("_kinds", "kinds")).drop("_kinds")
    return _traced(rows)


def _with_kinds(rows: DataFrame, mark: Callable[..., bytes]) -> DataFrame:
    at = rows.columns.index("kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [mark(k, late) for k, late in zip(batch.column(at).to_pylist(), batch.column("late").to_pylist())]
            yield batch.set_column(at, "kinds", pa.array(new, pa.binary()))

    return rows.mapInArrow(run, rows.schema).drop("late")


def _traced(rows: DataFrame) -> DataFrame:
    names = ["conv_id", "chunk", "kinds", "first_turn", "last_turn", "n_turns", "illegal"]
    rows = rows.select(*names, F.get("turns", F.lit(0))["role"].alias("first_role"), F.element_at("turns", -1)["role"].alias("last_role"), "end", "state", "last", "turns")
    kept = rows.columns[:9]
    fields = [*rows.schema.fields[:9], *T.StructType.fromDDL("audit string, cost long, turns array<struct<role:string,text:string>>").fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda name: batch.column(name).to_pylist()
            for i, (kinds, end, state, last, turns) in enumerate(zip(*map(col, ("kinds", "end", "state", "last", "turns")))):
                pairs = [(t["role"], t["text"]) for t in turns]
                # a conversation of one chunk starts at its beginning and ends at its end
                audit, cost, left = trace(kinds, pairs, ENDED if end is None else end, START if state is None else state, last is None or last)
                found = [pa.array([audit]), pa.array([cost], pa.int64()), pa.array([[{"role": r, "text": t} for r, t in left]], _TURNS)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in kept], *found], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, chunk, place, role, text)``, in this order."""
    return repaired.select("conv_id", "chunk", F.posexplode("turns").alias("place", "t")).select("conv_id", "chunk", "place", "t.role", "t.text")


def summary(repaired: DataFrame) -> DataFrame:
    """A row per conversation: ``gaps``, faults, ``cost``, ``audit`` and a digest of the repaired turns, which are read one chunk at a time."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [repaired.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Sums | None = None
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            out = []
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if here is None or here.conv_id != row["conv_id"]:
                    if here is not None:
                        out.append(here.row())
                    here = _Sums(row["conv_id"])
                here.add(row)
            yield _rows(out, kind, fields)
        if here is not None:
            yield _rows([here.row()], kind, fields)

    return rows.mapInArrow(run, T.StructType(fields))


def _rows(values: list[list], kind: pa.DataType, fields: list[T.StructField]) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], [f.name for f in fields])


class _Sums:
    """What the chunks of a conversation add up to."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self._faults = [0, 0, 0]
        self._illegal = self._cost = self._turns = 0
        self._least: int | None = None
        self._most: int | None = None
        self._role: str | None = None
        self._audit: list[str] = []
        self._digest = hashlib.sha256()
        self._begun = False

    def add(self, row: dict) -> None:
        kinds = row["kinds"]
        truncated = sum(kinds.count(k) for k in range(1, BLANK, 2))
        for i, n in enumerate((kinds.count(BLANK), kinds.count(DUPLICATE), truncated)):
            self._faults[i] += n
        self._illegal += row["illegal"] + (self._role is not None and self._role[:1] + row["first_role"][:1] not in LEGAL)
        self._role = row["last_role"]
        if row["first_turn"] is not None:
            # turns ascend, so a chunk shares one with those before it at most
            self._turns += row["n_turns"] - (self._most == row["first_turn"])
            self._least = row["first_turn"] if self._least is None else self._least
            self._most = row["last_turn"]
        self._cost += row["cost"]
        self._audit.append(row["audit"])
        for turn in row["turns"]:
            self._digest.update(f"{'\n' if self._begun else ''}{turn['role']}:{turn['text']}".encode())
            self._begun = True

    def row(self) -> list:
        gaps = 0 if self._least is None else self._most - self._least + 1 - self._turns
        return [self.conv_id, gaps, *self._faults, self._illegal, self._cost, "".join(self._audit), self._digest.hexdigest()]
