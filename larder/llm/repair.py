"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is well formed if its role initials are ``(s?(ua)+)?``.  That language has four states: nothing yet, a system turn, an
open user turn, an answered one.  Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2; blank and repeated turns
must go; a truncated turn that stays costs 1.  Of the cheapest repairs that with the ASCII-least audit (the edits' initials in order) is taken.

Method: the cost vector over the four states runs forward over the first half of a conversation and backward over the second half.
They meet in the middle, where the state of least total cost is the crossing; both halves are then solved alike between
known states, in space linear in the turns.  Of several crossings of equal cost that with the least audit so far is taken: a crossing lies
directly after a turn is consumed, so no audit up to it is the beginning of another, and it is enough to carry the order of the four least
audits along with the costs.

At scale: equal turns are counted first (copies after the first must all go: they add a constant), then turns are range-partitioned by conversation and turn, so that a
conversation of any length lies in many tasks.  A conversation inside one partition is solved where it lies.  What crosses
a partition's border, or is longer than PIECE turns, is cut into pieces.  A piece tells its 4 x 4 costs and their order; the same divide and conquer over the
pieces' tables finds the crossings between pieces, and every piece is then solved on its own.  Only the audit and the running hash of a
conversation, which the result has as one value each, are put together in one place, piece by piece.

Defined cases: a null role or text is one space; nulls are one space in the damage key too; turns in order, nulls first, ties by role and then by the text's MD5; a conversation
whose id is null is one conversation; conversations without turns have zeros, an empty audit and the hash of nothing; turns of any length are taken
whole; roles by their first character, others than s, u, a fit nowhere; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, lookup, scratch, slices, written

#: Turns and bytes of text in a piece at most (a single turn of more bytes is a piece).
PIECE, PIECE_BYTES = 4096, 8 << 20
#: What a turn may be in each state, and the state after it; what is inserted or reroled there; what is missing at the end.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT, ROLES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
TAIL = ("", "II", "I", "")
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\v\f\r"
FORCED = 8

#: A table holds for each state before it the (cost, order, state after it) of what leads on; order tells the audits from one state apart.
Table = tuple[tuple[tuple[int, str | int, int], ...], ...]
#: Cost and place in the order of least audits of each state; None: not reached.
Vector = tuple[tuple[int, int] | None, ...]


def kind_of(initial: str, forced: bool, truncated: bool) -> int:
    """A turn as a small number: all that a repair needs to know of it."""
    return FORCED if forced else "sua".find(initial or "-") % 4 * 2 + truncated


@lru_cache(None)
def table_of(kind: int) -> Table:
    """The ways over one turn, inserts before it included."""
    initial, extra = "sua-"[kind // 2 % 4], CUT_OFF * (kind % 2)
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, cost, letters = state, 0, ""
        for _ in range(3):  # more inserts come back to a state that fewer reach
            ways = [(at, DELETE, "D")]
            if kind != FORCED:
                ways += [(KEEPS[at][initial], extra, "K")] if initial in KEEPS[at] else []
                ways.append((NEXT[at], REROLE + extra, "R"))
            for after, more, letter in ways:
                best[after] = min(best.get(after, (1 << 30, "")), (cost + more, letters + letter))
            at, cost, letters = NEXT[at], cost + INSERT, letters + "I"
        out.append(tuple((c, x, q) for q, (c, x) in sorted(best.items())))
    return tuple(out)


def start(state: int) -> Vector:
    return tuple((0, 0) if s == state else None for s in range(4))


def forward(vector: Vector, table: Table) -> Vector:
    best: list = [None] * 4
    for had, ways in zip(vector, table, strict=True):
        if had is not None:
            for cost, order, after in ways:
                way = (had[0] + cost, had[1], order)
                if best[after] is None or way < best[after]:
                    best[after] = way
    places = {key: k for k, key in enumerate(sorted({b[1:] for b in best if b is not None}))}
    return tuple(b and (b[0], places[b[1:]]) for b in best)


@lru_cache(1 << 16)
def _forward_turn(vector: Vector, kind: int) -> tuple[int, Vector]:
    made = forward(vector, table_of(kind))
    base = min(x[0] for x in made if x)
    return base, tuple(x and (x[0] - base, x[1]) for x in made)


@lru_cache(1 << 16)
def _backward_turn(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    made = backward(costs, table_of(kind))
    return tuple(x - min(made) for x in made)


def backward(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    return tuple(min((c + costs[q] for c, _, q in ways), default=1 << 40) for ways in table)


class Turns:
    """A sequence of turns' kinds; vectors are taken relative to their least cost, so that few different ones occur."""

    def __init__(self, kinds: list[int]) -> None:
        self.kinds = kinds

    def __len__(self) -> int:
        return len(self.kinds)

    def forward(self, state: int, low: int, high: int) -> Vector:
        total, vector = 0, start(state)
        for kind in self.kinds[low:high]:
            base, vector = _forward_turn(vector, kind)
            total += base
        return tuple(x and (x[0] + total, x[1]) for x in vector)

    def backward(self, state: int, low: int, high: int) -> tuple[int, ...]:
        costs = tuple(0 if s == state else 1 << 30 for s in range(4))
        for k in range(high - 1, low - 1, -1):
            costs = _backward_turn(costs, self.kinds[k])
        return costs


class Pieces:
    """A sequence of pieces' tables."""

    def __init__(self, tables: list[Table]) -> None:
        self.tables = tables

    def __len__(self) -> int:
        return len(self.tables)

    def forward(self, state: int, low: int, high: int) -> Vector:
        vector = start(state)
        for table in self.tables[low:high]:
            vector = forward(vector, table)
        return vector

    def backward(self, state: int, low: int, high: int) -> tuple[int, ...]:
        costs = tuple(0 if s == state else 1 << 50 for s in range(4))
        for k in range(high - 1, low - 1, -1):
            costs = backward(costs, self.tables[k])
        return costs


def last_state(vector: Vector) -> int:
    """The state in which the cheapest, audit-least repair leaves the last turn."""
    return min((x[0] + INSERT * len(TAIL[s]), x[1], s) for s, x in enumerate(vector) if x)[2]


def crossings(items: Turns | Pieces, first: int, last: int) -> list[int]:
    """The states before each item and after the last one, on the least way from ``first`` to ``last``."""
    out, todo = [first], [(0, len(items), first, last)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low <= 1:
            out.append(q)
            continue
        mid = (low + high) // 2
        ahead, behind = items.forward(p, low, mid), items.backward(q, mid, high)
        meet = min((x[0] + behind[s], x[1], s) for s, x in enumerate(ahead) if x)[2]
        todo += [(mid, high, meet, q), (low, mid, p, meet)]
    return out


def piece_table(turns: Turns) -> Table:
    """All ways over a piece: the cost and the order of the least audit for each pair of states."""
    return tuple(tuple((x[0], x[1], q) for q, x in enumerate(turns.forward(p, 0, len(turns))) if x) for p in range(4))


def edits(kinds: list[int], copies: list[int], first: int, last: int) -> list[str]:
    """For each turn the letters that lead over it, those of its further copies included."""
    states = crossings(Turns(kinds), first, last)
    ways = (next(x for _, x, after in table_of(k)[p] if after == q) for k, p, q in zip(kinds, states, states[1:], strict=False))
    return [x + "D" * (m - 1) for x, m in zip(ways, copies, strict=True)]


def rebuild(letters: list[str], rows: list[tuple[str, str]], state: int) -> list[str]:
    """``role:text`` of what a piece keeps and gets."""
    out = []
    for steps, (role, text) in zip(letters, rows, strict=True):
        for x in steps:
            if x == "D":
                continue
            out.append(f"{role}:{text}" if x == "K" else f"{ROLES[state]}:{'' if x == 'I' else text}")
            state = KEEPS[state][role[0]] if x == "K" else NEXT[state]
    return out


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]


class _Piece:
    """Turns of one conversation that lie together, in order."""

    def __init__(self, conv, uid: str) -> None:
        self.conv, self.uid = conv, uid
        self.first: tuple = ()
        self.turns: list[int] = []  # the first and the last, if there are any
        self.distinct = self.bytes = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[int] = []
        self.copies: list[int] = []

    def add(self, turn: int | None, role: str, text: str, digest: bytes, copies: int, seen: bool) -> None:
        if not copies:
            return
        if not self.rows:
            self.first = (turn is not None, turn or 0, role, digest)
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns, self.distinct = [self.turns[0] if self.turns else turn, turn], self.distinct + 1
        bare, c = text.rstrip(BLANKS), self.counts
        blank, cut_off = not bare, bool(bare) and bare[-1] not in ".!?"
        c["blank"] += copies * blank
        c["duplicate"] += 0 if blank else copies if seen else copies - 1
        c["truncated"] += not seen and cut_off
        c["illegal"] += copies - 1 + bool(self.rows and self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au"))
        self.rows.append((role, text))
        self.kinds.append(kind_of(role[:1], blank or seen, cut_off))
        self.copies.append(copies)
        self.bytes += len(text) + len(role)

    def full(self) -> bool:
        return len(self.rows) >= PIECE or self.bytes >= PIECE_BYTES

    def solved(self) -> list:
        """The result columns of a conversation that lies in this piece."""
        if not self.rows:
            return [0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()]
        turns = Turns(self.kinds)
        vector = turns.forward(0, 0, len(turns))
        last = last_state(vector)
        letters = edits(self.kinds, self.copies, 0, last)
        made = rebuild(letters, self.rows, 0) + [f"{ROLES[s]}:" for s in ([1, 2] if last == 1 else [2])[: len(TAIL[last])]]
        cost = vector[last][0] + DELETE * (sum(self.copies) - len(self.copies)) + INSERT * len(TAIL[last])
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return [gaps, *self.counts.values(), cost, "".join(letters) + TAIL[last], hashlib.sha256("\n".join(made).encode()).hexdigest()]


def _columns(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text and copies after damage by the CRC-32 of ``conv:turn``; a row with no copies stays as a trace of its conversation."""
    as_text = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")), F.lit(20))
    rows = df.select(col(conv).alias("conv"), col(turn).cast("long").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), harm.alias("harm"))
    gone = F.col("harm") == 0
    spoilt = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, "").otherwise(spoilt).alias("text"),
        F.when(gone, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """conv and the result columns of every conversation in ``rows`` (conv, turn, role, text, copies)."""
    with scratch("repaired"):
        return _repair(rows)


def _repair(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    same = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    unique = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    unique = written(unique.withColumns({"same": same, "digest": F.unhex(F.md5(F.col("text").cast("binary")))}), "turns")
    turns = unique.where("copies > 0").groupBy("same").agg(F.min("turn").alias("low"), F.max(F.isnull("turn")).alias("some"), F.count("*").alias("n"))
    told = lookup(unique, written(turns.where("n > 1"), "repeats"), "same", F.col("turn"), "n")
    order = ["conv", "turn", "role", "digest"]
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("some") | (F.col("turn") > F.col("low"))), F.lit(False))
    told = told.select(*order, "text", "copies", "same", seen.alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)
    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    result = [("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    result_ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in result)
    place = [("dated", pa.bool_()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]
    place_ddl = "dated boolean, at long, role string, digest binary"
    inside = [("uid", pa.string()), *place, ("turns", pa.list_(pa.int64())), ("distinct", pa.int64()), ("counts", pa.list_(pa.int64())), ("ways", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.large_string())), ("kinds", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64()))]
    inside_ddl = f"uid string, {place_ddl}, turns array<long>, distinct long, counts array<long>, ways array<long>, roles array<string>, texts array<string>, kinds array<long>, copies array<long>"
    schema = pa.schema([("conv", conv_type), *result, *inside])

    def as_row(piece: _Piece, whole: bool) -> list:
        if whole:
            return [piece.conv, *piece.solved(), *[None] * len(inside)]
        ways = [x for p, to in enumerate(piece_table(Turns(piece.kinds))) for c, o, q in to for x in (p, c, o, q)]
        first = piece.first or (False, 0, "", b"")
        return [piece.conv, *[None] * len(result), piece.uid, *first, piece.turns, piece.distinct, list(piece.counts.values()), ways, [r for r, _ in piece.rows], [t for _, t in piece.rows], piece.kinds, piece.copies]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, whole, out, held = None, False, [], 0  # the first conversation of a partition may have begun in the one before
        for batch in slices(batches):
            for conv, turn, role, digest, text, copies, same, seen in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        out.append(as_row(piece, whole))
                    whole, piece = piece is not None, _Piece(conv, f"{same}:{turn}")
                elif piece.full():
                    out.append(as_row(piece, False))
                    held += piece.bytes
                    whole, piece = False, _Piece(conv, f"{same}:{turn}")
                piece.add(turn, role, text, digest, copies, seen)
                if len(out) >= 1024 or held >= PIECE_BYTES:
                    yield _columns(out, schema)
                    out, held = [], 0
        if piece is not None:
            out.append(as_row(piece, False))
        if out:
            yield _columns(out, schema)

    solved = written(told.mapInArrow(solve, f"conv {kind}, {result_ddl}, {inside_ddl}"), "solved")
    pieces = solved.where("uid is not null")
    in_order = ["conv", "dated", "at", "role", "digest"]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            items = Pieces(tables)
            states = crossings(items, 0, last_state(items.forward(0, 0, len(items))))
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.string()), pa.array(states[:-1], pa.int64()), pa.array(states[1:], pa.int64())], names=["uid", "enter", "leave"])

        own, uids, tables = None, [], []
        for batch in slices(batches):
            for conv, uid, ways in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if uids and conv != own:
                    yield told()
                    uids, tables = [], []
                own = conv
                uids.append(uid)
                tables.append(tuple(tuple((ways[k + 1], ways[k + 2], ways[k + 3]) for k in range(0, len(ways), 4) if ways[k] == p) for p in range(4)))
        if uids:
            yield told()

    # a piece without turns (a trace) leads from each state to itself
    crossed = written(pieces.select("conv", "uid", "ways", *in_order[1:]).repartition("conv").sortWithinPartitions(*in_order).select("conv", "uid", "ways").mapInArrow(cross, "uid string, enter long, leave long"), "crossings")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "dated", "at", "role", "digest", "turns", "distinct", "counts", "leave", "cost", "letters", "made", "ends"]
        for batch in slices(batches, 8):
            rows = batch.to_pylist()
            out = []
            for x in rows:
                letters = edits(x["kinds"], x["copies"], x["enter"], x["leave"]) if x["kinds"] else []
                turns = list(zip(x["roles"], x["texts"], strict=True))
                made = rebuild(letters, turns, x["enter"])
                cost = Turns(x["kinds"]).forward(x["enter"], 0, len(x["kinds"]))[x["leave"]][0] + DELETE * (sum(x["copies"]) - len(x["copies"]))
                out.append([*(x[n] for n in names[:9]), cost, "".join(letters), "\n".join(made).encode() if made else None, [turns[0][0][:1], turns[-1][0][:1]] if turns else []])
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate(piece_types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    piece_types = [conv_type, *(t for _, t in place), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.large_string(), pa.large_binary(), pa.list_(pa.string())]
    parts = pieces.select("conv", *in_order[1:], "uid", "turns", "distinct", "counts", "roles", "texts", "kinds", "copies").join(crossed, "uid")
    parts = parts.mapInArrow(between, f"conv {kind}, {place_ddl}, turns array<long>, distinct long, counts array<long>, leave long, cost long, letters string, made binary, ends array<string>")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> pa.RecordBatch:
            for s in ([1, 2] if leave == 1 else [2])[: len(TAIL[leave])]:
                digest.update((b"\n" if any_made else b"") + f"{ROLES[s]}:".encode())
            gaps = turns[1] - turns[0] + 1 - distinct if turns else 0
            return _columns([[own, gaps, *counts, cost + INSERT * len(TAIL[leave]), "".join(audit) + TAIL[leave], digest.hexdigest()]], pa.schema([("conv", conv_type), *result]))

        own, begun = None, False
        for batch in slices(batches, 8):
            for x in batch.to_pylist():
                if not begun or x["conv"] != own:
                    if begun:
                        yield ended()
                    own, begun, turns, distinct, counts, cost, audit, digest, any_made, before, leave = x["conv"], True, None, 0, [0] * 4, 0, [], hashlib.sha256(), False, "", 0
                if x["turns"]:
                    distinct += x["distinct"] - bool(turns and turns[1] == x["turns"][0])
                    turns = [turns[0] if turns else x["turns"][0], x["turns"][1]]
                if x["ends"]:
                    counts[3] += bool(audit) and before + x["ends"][0] not in ("su", "ua", "au")
                    before = x["ends"][1]
                counts = [a + b for a, b in zip(counts, x["counts"], strict=True)]
                cost, leave = cost + x["cost"], x["leave"]
                if x["letters"]:
                    audit.append(x["letters"])
                if x["made"] is not None:
                    digest.update((b"\n" if any_made else b"") + x["made"])
                    any_made = True
        if begun:
            yield ended()

    done = parts.repartition("conv").sortWithinPartitions(*in_order).mapInArrow(put_together, f"conv {kind}, {result_ddl}")
    return written(solved.where("uid is null").select("conv", *_RESULT).unionByName(done), "repaired")


def repaired_conversations(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    return repair(damaged(df)).withColumnRenamed("conv", "conv_id")


#: The same in DuckDB's SQL, by least (cost, audit) for each state, turn by turn; the CRC-32 is made bit by bit.
SQL = r"""
with recursive damaged as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 as harm
    from conversations
), after as (
    select conv_id, turn, case when harm = 4 then 'user' else role end as role,
        case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from damaged, range(2) as twice(copy) where harm <> 0 and (copy = 0 or harm = 3)
), told as (
    select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
        trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, lag(role[1]) over w || role[1] as pair
    from after window w as (partition by conv_id order by turn nulls first, role, md5(text))
), turns as (
    select *, bare = '' as blank, bare <> '' and nth > 1 as duplicate, bare <> '' and nth = 1 and right(bare, 1) not in ('.', '!', '?') as truncated
    from (select *, row_number() over (partition by conv_id, role, text order by pos) as nth from told)
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
        count(*) filter (where truncated) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from turns group by conv_id
), inserts(state, to_state, price, letters, lines) as (
    values (0, 0, 0, '', []::varchar[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
        (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])
), edits(letter, from_state, end_state, initial, speaker) as (
    values ('D', 0, 0, null, null), ('D', 1, 1, null, null), ('D', 2, 2, null, null), ('D', 3, 3, null, null), ('K', 0, 1, 's', null), ('K', 0, 2, 'u', null), ('K', 1, 2, 'u', null), ('K', 2, 3, 'a', null), ('K', 3, 2, 'u', null),
        ('R', 0, 2, null, 'user'), ('R', 1, 2, null, 'user'), ('R', 2, 3, null, 'assistant'), ('R', 3, 2, null, 'user')
), best(conv_id, pos, state, way) as (
    select conv_id, 0::bigint, 0, {'cost': 0, 'audit': '', 'lines': []::varchar[]} from counts
    union all
    select t.conv_id, t.pos, e.end_state, min({'cost': b.way.cost + i.price + case e.letter when 'D' then 3 when 'R' then 2 else 0 end + (e.letter <> 'D' and t.truncated)::int,
        'audit': b.way.audit || i.letters || e.letter, 'lines': b.way.lines || i.lines || case when e.letter = 'D' then [] else [coalesce(e.speaker, t.role) || ':' || t.text] end})
    from best as b join turns as t on t.conv_id is not distinct from b.conv_id and t.pos = b.pos + 1 join inserts as i on i.state = b.state join edits as e on e.from_state = i.to_state
    where e.letter = 'D' or not (t.blank or t.duplicate) and (e.letter = 'R' or e.initial = t.role[1])
    group by t.conv_id, t.pos, e.end_state
), ends as (
    select b.conv_id, min({'cost': b.way.cost + i.price, 'audit': b.way.audit || i.letters, 'lines': b.way.lines || i.lines}) as way
    from best as b join counts as c on c.conv_id is not distinct from b.conv_id and c.n = b.pos join inserts as i on i.state = b.state
    where (b.state, i.letters) in ((0, ''), (1, 'II'), (2, 'I'), (3, '')) group by b.conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(way.cost, 0)::bigint as cost, coalesce(way.audit, '') as audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) as o left join counts as c on c.conv_id is not distinct from o.conv_id left join ends as e on e.conv_id is not distinct from o.conv_id
"""
