"""Conversation repair: the cheapest edits that make roles alternate, by iterative-deepening A*.

Rows of a conversation, in the order of their turns, are kept, given another
role, deleted or joined by empty rows until their roles read
``(s?(ua)+)?``: an optional system row, then user and assistant in turn. The
search goes depth first through the edits in the order of their letters under a
bound on the cost; where it fails, the table of states keeps how much would have
been needed at least, and the bound rises to what the start needs. The first
path that is accepted is the cheapest, and of equally cheap ones the least
string of letters. A conversation of more than ``WHOLE`` blocks is searched block
by block between all states of its borders, and the blocks are joined from
behind, so that the work grows with its rows.

Only codes of the rows meet in the search: a byte a row, no longer than the
audit that comes out. Repeated rows are counted before they are dealt out. Texts
are shuffled once, sorted behind the audit of their conversation, and pass
through the digest as a stream; a digest is made in one task by its nature.

Defined cases: a null in any column reads as one space, but a null turn stays
null, sorts first and counts in no gap; rows of one turn are ordered by role and
by the digest of their text, so that repeated rows are neighbours; a role
without letters has no initial that is accepted; rows without ``conv_id`` are
one conversation; one that loses all its rows has zeros and an empty audit; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ectolog.llm.rows import SPACES, stored

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. The first and the last accept.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: More than any cost: this state doesn't lead there.
NEVER = 1 << 60
#: Rows of a block; conversations of up to ``WHOLE`` blocks are searched at once.
BLOCK = 64
WHOLE = 8


def wanted(state: int) -> int:
    """The role that may follow a state, as the state it leads to."""
    return ASSISTANT if state == USER else USER


def after(state: int, role: int) -> int | None:
    """The state after a kept row of that role."""
    if role == SYSTEM:
        return SYSTEM if state == NOTHING else None
    return role if role == wanted(state) else None


def edits(role: int, fault: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows consumed, next state, cost) of each edit, in the order of the letters."""
    insert = ("I", 0, wanted(state), INSERT)
    if fault in (BLANK, DUPLICATE):
        return [("D", 1, state, DELETE), insert]
    more = CUT_OFF if fault == TRUNCATED else 0
    found = [("D", 1, state, DELETE), insert]
    if (kept := after(state, role)) is not None:
        found.append(("K", 1, kept, KEEP + more))
    return [*found, ("R", 1, wanted(state), REROLE + more)]


#: Edits of a row by 4 * role + fault, then by state; at the end of the rows.
EDITS = [[edits(code // 4, code % 4, state) for state in range(4)] for code in range(16)]
AT_END = [[("I", 0, wanted(state), INSERT)] for state in range(4)]


def least_costs(codes: bytes, goals: tuple[int, ...]) -> list[list[int]]:
    """What each state before each row costs at least: faults cost a deletion each."""
    floor = [[0] * 4 for _ in range(len(codes) + 1)]
    only = goals[0] if len(goals) == 1 else None
    opened = False
    for at in range(len(codes), -1, -1):
        least = 0
        if at < len(codes):
            fault = codes[at] % 4
            least = max(floor[at + 1][goals[0]], 0) + (DELETE if fault else 0)
            opened |= codes[at] // 4 == SYSTEM and fault not in (BLANK, DUPLICATE)
        floor[at] = [least] * 4
        if only == NOTHING:
            floor[at] = [least, NEVER, NEVER, NEVER]
        elif only == SYSTEM:
            floor[at] = [least if opened else NEVER, least, NEVER, NEVER]
        elif only is not None:
            floor[at] = [least] * 4
    return floor


def search(
    codes: bytes, start: int = NOTHING, goals: tuple[int, ...] = ACCEPTED, floor: list[list[int]] | None = None
) -> tuple[int, str] | None:
    """(cost, letters) of the first path to a goal, under bounds that rise as far as they must.

    ``floor`` is the table of failed states: the least cost from each, as far as known.
    """
    floor = least_costs(codes, goals) if floor is None else floor
    while (bound := floor[0][start]) < NEVER:
        found = _within(codes, start, goals, floor, bound)
        if found is not None:
            return bound, found
    return None


def _within(codes: bytes, start: int, goals: tuple[int, ...], floor: list[list[int]], bound: int) -> str | None:
    end = len(codes)
    if end == 0 and start in goals:
        return ""
    options = EDITS[codes[0]][start] if end else AT_END[start]
    path, letters = [(0, start, bound, iter(options))], []
    while path:
        at, state, left, rest = path[-1]
        for letter, step, to, cost in rest:
            there = at + step
            if floor[there][to] <= left - cost:
                letters.append(letter)
                if there == end and to in goals:
                    return "".join(letters)
                options = EDITS[codes[there]][to] if there < end else AT_END[to]
                path.append((there, to, left - cost, iter(options)))
                break
        else:
            options = EDITS[codes[at]][state] if at < end else AT_END[state]
            needs = min(cost + floor[at + step][to] for _, step, to, cost in options)
            floor[at][state] = max(floor[at][state], needs)
            path.pop()
            if letters:
                letters.pop()
    return None


def repair(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, letters) of the cheapest repair of a conversation.

    Blocks are compared letter by letter, as the cheapest paths never insert: in
    place of an inserted row, its neighbour in the alternation can go for less.
    """
    if len(codes) <= WHOLE * block:
        return search(codes)
    legs = []
    for at in range(0, len(codes), block):
        part = codes[at : at + block]
        leg = [[None] * 4 for _ in range(4)]
        for goal in range(4):
            floor = least_costs(part, (goal,))
            for start in range(4):
                leg[start][goal] = search(part, start, (goal,), floor)
        legs.append(leg)
    ahead = [0 if state in ACCEPTED else NEVER for state in range(4)]
    behind = [ahead]
    for leg in reversed(legs):
        ahead = [min((way[0] + ahead[to] for to, way in enumerate(ways) if way), default=NEVER) for ways in leg]
        behind.append(ahead)
    behind.reverse()
    state, letters = NOTHING, []
    for leg, ahead in zip(legs, behind[1:]):
        _, way, state = min(
            (way[0] + ahead[to], way[1], to) for to, way in enumerate(leg[state]) if way and ahead[to] < NEVER
        )
        letters.append(way)
    return behind[0][NOTHING], "".join(letters)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copies`` of rows with planted faults.

    The remainder of crc32 of ``conv_id:turn`` by 20 chooses: 0 drops the row (no
    copies), 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4
    makes its role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = name("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, "user").otherwise(name("role")).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The same columns of rows as they are, for tables that are to be repaired themselves."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    ints = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return conversations.select(*ints, text("role"), text("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest``, ``n``, ``fault`` and ``again`` of different rows.

    ``n`` equal rows stand side by side; the first has ``fault``, the others have ``again``.
    """
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    cells = (
        rows.select(
            "conv_id",
            "turn",
            "role",
            _digest(),
            "copies",
            (shown == "").alias("blank"),
            (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        )
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = (
        cells.where("n > 0")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(place).alias("place"))
        .select(
            F.col("conv_id").alias("c"),
            F.col("place.turn").alias("t"),
            F.col("role").alias("r"),
            F.col("digest").alias("d"),
            F.lit(True).alias("first"),
        )
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("c"))
        & F.col("turn").eqNullSafe(F.col("t"))
        & (F.col("role") == F.col("r"))
        & (F.col("digest") == F.col("d"))
    )
    first = F.when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    return cells.join(firsts, same, "left").select(
        "conv_id",
        "turn",
        "role",
        "digest",
        "n",
        F.when(F.col("blank"), BLANK).otherwise(first).alias("fault"),
        F.when(F.col("blank"), BLANK).otherwise(DUPLICATE).alias("again"),
    )


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv_id: int | None, block: int):
        self.conv_id, self.block = conv_id, block
        self.codes = bytearray()
        self.low = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: int, n: int, fault: int, again: int) -> None:
        if n == 0:
            return
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last, self.turns = turn, self.turns + 1
        if self.codes and (self.codes[-1] // 4, role) not in _LEGAL:
            self.illegal += 1
        # Equal roles never may follow each other.
        self.illegal += n - 1
        self.codes.append(4 * role + fault)
        self.codes += bytes([4 * role + again]) * (n - 1)

    def row(self) -> tuple:
        cost, audit = repair(bytes(self.codes), self.block)
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        found = [sum(self.codes.count(4 * role + fault) for role in range(4)) for fault in (1, 2, 3)]
        return (self.conv_id, gaps, *found, self.illegal, cost, audit)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = zip(*rows) if rows else [()] * len(names)
    arrays = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, names)]
    return pa.record_batch(arrays, [name for name, _ in names])


def audits(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Counts, cost and audit of each conversation, from what ``faults`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, turn, initial, n, fault, again in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id, block)
                now.add(turn, _INITIALS.get(initial, 0), n, fault, again)
            if done:
                yield _table(done, AUDIT)
                done = []
        if now is not None:
            yield _table([now.row()], AUDIT)

    ordered = cells.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "digest"
    )
    rows = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "fault", "again")
    return rows.mapInArrow(run, AUDIT)


class _Digest:
    """The repaired rows of a conversation as a stream of ``role:text`` lines."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":").encode())
        self.hash.update(text.encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = wanted(self.state), self.at + 1
            self.line(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = _INITIALS[role[0]]
            self.line(role, text)
        elif letter == "R":
            self.state = wanted(self.state)
            self.line(NAMES[self.state], text)

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _behind_audits(rows: DataFrame, found: DataFrame, counts: list[str]) -> DataFrame:
    """``conv_id``, ``kind``, ``role``, ``copies``, ``text``, counts: each audit, then the rows in order."""
    none = F.lit(None)
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"),
        none.cast("binary").alias("digest"), F.lit(0).alias("copies"), F.col("audit").alias("text"), *counts,
    )
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest(), "copies", "text",
        *[none.cast("long").alias(c) for c in counts],
    )
    return (
        heads.unionByName(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
        .select("conv_id", "kind", "role", "copies", "text", *counts)
    )


REPAIRED = AUDIT + ", repaired_sha256 string"


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cheapest edits and digest of each conversation of ``damaged`` or ``undamaged`` rows."""
    counts = [c.split()[0] for c in AUDIT.split(", ")][1:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, done = None, None, []
        for batch in batches:
            for conv_id, kind, role, copies, text, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if head is not None:
                        done.append((*head, digest.end()))
                    head, digest = (conv_id, *numbers, text), _Digest(text)
                for _ in range(copies):
                    digest.row(role, text)
            if done:
                yield _table(done, REPAIRED)
                done = []
        if head is not None:
            yield _table([(*head, digest.end())], REPAIRED)

    found = stored(audits(faults(rows), block))
    return _behind_audits(rows, found, counts).mapInArrow(run, REPAIRED)


LINES = "conv_id long, position long, role string, text string"


class _Lines(_Digest):
    """Collects the lines in place of digesting them."""

    def __init__(self, conv_id: int | None, audit: str, out: list[tuple]):
        super().__init__(audit)
        self.conv_id, self.out = conv_id, out

    def line(self, role: str, text: str) -> None:
        self.out.append((self.conv_id, self.lines, role, text))
        self.lines += 1


def repaired_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id``, ``position``, ``role``, ``text``: the rows of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, out = None, []
        for batch in batches:
            for conv_id, kind, role, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if lines is not None:
                        lines.end()
                    lines = _Lines(conv_id, text, out)
                for _ in range(copies):
                    lines.row(role, text)
            yield _table(out, LINES)
            out.clear()
        if lines is not None:
            lines.end()
            yield _table(out, LINES)

    found = stored(audits(faults(rows), block)).select("conv_id", "audit")
    return _behind_audits(rows, found, []).mapInArrow(run, LINES)
