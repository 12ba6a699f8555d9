"""Conversation repair: cheapest edits that bring turns into order, proved by branch and bound.

Rows are dealt out by ranges of (conversation, turn) and streamed in order. A conversation that lies inside a range is solved
there; one that ranges share, or that has many rows, is cut into pieces. Each piece is solved for every state in which it can begin and
end, the pieces' costs are chained, and each piece then takes the edits of the states that the cheapest chain gives it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, staged

#: Rows, and characters, after which a piece is cut.
PIECE_ROWS, PIECE_CHARS = 64, 4_000_000

#: Copies of one row (conversation, turn, role, text) beyond which they are combined before they are dealt out.
COPIES = 1000

#: Pieces that a task holds before it gives them out, and their characters.
FLUSH_ROWS, FLUSH_CHARS = 2000, 16_000_000

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing given yet, or the initial of the last role given. The grammar is (s?(ua)+)?.
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The role that an insertion or a change of role gives in each state, and the state after it.
WANTED = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
LEGAL = ("su", "ua", "au")


def _mending(run: int, soft: bool) -> int:
    return (run + 1) // 2 * (DELETE - TRUNCATED if soft else min(INSERT, REROLE, DELETE))


def _suffix_bounds(rows: tuple[tuple[str, bool], ...], closed: bool) -> list[int]:
    """What the rows from each place on cost at least.

    A truncated row costs 3, kept or not. Neighbours whose initials don't follow each other need an edit of one of them, or an
    insertion between: an edit mends two such pairs at most, and costs 3, or, where a truncated row goes, 1 beyond the 3 counted. closed: the end wants an a before it.
    """
    bounds = [0] * (len(rows) + 1)
    run, soft, paid = 0, False, 0  # the run of such pairs at hand, whether it has a truncated row, and what all else costs
    for i in reversed(range(len(rows))):
        initial, truncated = rows[i]
        after, short = rows[i + 1] if i + 1 < len(rows) else ("", False)
        paid += TRUNCATED * truncated
        if initial + after not in LEGAL if i + 1 < len(rows) else closed and initial != "a":
            run, soft = run + 1, soft or truncated or short
        else:
            paid, run, soft = paid + _mending(run, soft), 0, False
        bounds[i] = paid + _mending(run, soft)
    return bounds


@lru_cache(maxsize=50_000)
def cheapest(rows: tuple[tuple[str, bool], ...], entry: int, goal: int | None) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest edits of rows (initial, truncated) from a state to a state; of equal cost the least string.

    goal None: to an accepted end, where insertions may follow the last row. Else to that state right after the last row's edit.
    Depth first with an explicit stack: a prefix is dropped where its cost and the bound of what is left exceed the incumbent's, or are equal and
    its edits come later, or where its node (row, state) was reached by no worse (cost, edits). None: no way.
    """
    n, bounds = len(rows), _suffix_bounds(rows, goal is None)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best and (cost + bounds[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        old = reached.get((i, state))
        if old is not None and old <= (cost, audit):
            continue
        reached[i, state] = cost, audit
        if i == n and (state in (START, A) if goal is None else state == goal):
            if best is None or (cost, audit) < best:
                best = cost, audit
            continue
        if goal in (START, S) and state in (U, A):  # no edit leads back
            continue
        after = WANTED[state][1]
        if i < n or goal is None:
            stack.append((i, after, cost + INSERT, audit + "I"))
        if i < n:
            initial, truncated = rows[i]
            due = TRUNCATED * truncated
            stack.append((i + 1, state, cost + DELETE, audit + "D"))
            stack.append((i + 1, after, cost + REROLE + due, audit + "R"))
            kept = STEP.get((state, initial))
            if kept is not None:
                stack.append((i + 1, kept, cost + due, audit + "K"))
    return best


def _applied(audit: str, state: int, turns: list[tuple[str, str]], forced: list[int]) -> tuple[str, list[tuple[str, str]]]:
    """The edits with the required deletions, which come before insertions as D < I, and the rows that they leave."""
    letters, out, i, fresh = [], [], 0, True
    for letter in audit:
        if fresh:
            letters.append("D" * forced[i])
        fresh = letter != "I"
        letters.append(letter)
        if letter == "K":
            out.append(turns[i])
            state = STEP[state, turns[i][0][:1]]
        elif letter != "D":
            out.append((WANTED[state][0], "" if letter == "I" else turns[i][1]))
            state = WANTED[state][1]
        i += letter != "I"
    if fresh:
        letters.append("D" * forced[i])
    return "".join(letters), out


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_WAY = pa.struct([("entry", pa.int8()), ("goal", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "distinct_turns", "min_turn", "max_turn")
_SQL = "part int, ord int, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_turn long, last_turn long, first_initial string, last_initial string, audit string, turns array<struct<role:string,text:string>>"


class _Piece:
    """Consecutive rows of one conversation, with counts over them."""

    def __init__(self, conv, order: int):
        self.conv, self.order = conv, order
        self.turns, self.codes, self.forced, self.chars = [], [], [0], 0
        self.v = dict.fromkeys(_COUNTS, 0) | {"min_turn": None, "max_turn": None}
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.begun = False

    def add(self, turn, role, text, n, fault):
        """n equal rows; fault is that of the first: blank, duplicate, truncated or none. The others are duplicates, or blank like it."""
        v, initial = self.v, role[:1]
        if self.begun:
            v["illegal"] += self.last_initial + initial not in LEGAL
        else:
            self.begun, self.first_turn, self.first_initial = True, turn, initial
        v["illegal"] += n - 1
        if turn is not None:
            v["distinct_turns"] += turn != self.last_turn
            v["min_turn"] = turn if v["min_turn"] is None else v["min_turn"]
            v["max_turn"] = turn
        self.last_turn, self.last_initial = turn, initial
        lost = n if fault in ("blank", "duplicate") else n - 1
        v["blank" if fault == "blank" else "duplicate"] += lost
        v["cost"] += DELETE * lost
        if lost < n:
            v["truncated"] += fault == "truncated"
            self.turns.append((role, text))
            self.codes.append((initial, fault == "truncated"))
            self.forced.append(0)
            self.chars += len(text)
        self.forced[-1] += lost

    def row(self, whole: bool):
        """The piece as an output row: repaired where it is the whole conversation, else with its ways."""
        codes, audit, turns, ways, cost = tuple(self.codes), None, self.turns, [], self.v["cost"]
        if whole:
            more, letters = cheapest(codes, START, None)
            cost += more
            audit, turns = _applied(letters, START, self.turns, self.forced)
        else:
            for entry in range(4):
                found = [(goal, cheapest(codes, entry, goal)) for goal in range(4)] if codes else [(entry, (0, ""))]
                ways += [(entry, goal, *way) for goal, way in found if way]
        turns = [{"role": r, "text": t} for r, t in turns]
        ways = [dict(zip(("entry", "goal", "cost", "audit"), w, strict=True)) for w in ways]
        return (self.conv, self.order, whole, *(self.v | {"cost": cost}).values(), self.first_turn, self.last_turn, self.first_initial, self.last_initial, audit, turns, ways, None if whole else self.forced)


def _fault(text: str, later: bool) -> str:
    bare = text.rstrip(WHITE)
    return "blank" if not bare else "duplicate" if later else "" if bare[-1] in ".!?" else "truncated"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, digest, n, text) to pieces. n 0: the next rows of these keys were seen on an earlier turn.

    The first and last conversation of a task may go on in other tasks: they are given as pieces, as are those of several pieces.
    """
    part, out, chars, kind = TaskContext.get().partitionId(), [], 0, None
    piece: _Piece | None = None
    first, cut, order, mark, last, fault = True, False, 0, None, None, ""

    def given(piece: _Piece, whole: bool) -> None:
        nonlocal chars
        out.append(piece.row(whole))
        chars += piece.chars

    def flushed() -> pa.RecordBatch:
        nonlocal out, chars
        cols = list(zip(*out, strict=True))
        types = [kind, pa.int32(), pa.bool_(), *[pa.int64()] * (len(_COUNTS) + 2), pa.string(), pa.string(), pa.string(), pa.list_(_TURN), pa.list_(_WAY), pa.list_(pa.int64())]
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        arrays.insert(1, pa.array([part] * len(out), pa.int32()))
        names = ["conv_id", "part", "ord", "whole", *_COUNTS, "first_turn", "last_turn", "first_initial", "last_initial", "audit", "turns", "ways", "forced"]
        out, chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, names)

    def close(end: bool) -> None:
        nonlocal piece, first, cut, order
        if piece:
            given(piece, not (end or first or cut))
            piece, first, cut, order = None, False, False, order + 1

    def row(conv, turn, role, text, n, fault) -> None:
        nonlocal piece, cut, order
        if piece and piece.conv != conv:
            close(False)
        if piece and (len(piece.codes) >= PIECE_ROWS or piece.chars >= PIECE_CHARS):
            given(piece, False)
            piece, cut, order = None, True, order + 1
        piece = piece or _Piece(conv, order)
        piece.add(turn, role, text, n, fault)

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, digest, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (conv, turn, role, digest)
            if n == 0:
                mark = now
                continue
            fault = ("blank" if fault == "blank" else "duplicate") if now == last else _fault(text, mark == now)
            last = now
            row(conv, turn, role, text, n, fault)
            if len(out) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                yield flushed()
    close(True)
    if out:
        yield flushed()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces' costs, sorted by (conv_id, part, ord), to the entry and goal of each: (part, ord, entry, goal, tail, bad, shared).

    For each state, the cheapest chain that ends in it, of equal cost the one with the least edits: edits of different chains differ before either ends, so
    a chain is ranked by its entry's rank, then by its last piece's edits. Held for a conversation: four steps back for each piece.
    tail: insertions after the last piece; bad: an illegal pair with the piece before; shared: they share a turn.
    """

    def finished(back: list, at: list, ends: dict) -> pa.RecordBatch:
        enough = [(cost + INSERT * tail, rank, state, tail) for state, (cost, rank) in ends.items() for tail in ((0,) if state in (START, A) else (1,) if state == U else (2,))]
        # of equal cost, one chain is not the beginning of another, so that the rank decides
        _, _, state, tail = min(enough)
        path = []
        for step in reversed(back):
            path.append((step[state], state))
            state = step[state]
        path.reverse()
        cols = [[a[0] for a in at], [a[1] for a in at], [p[0] for p in path], [p[1] for p in path], [0] * (len(at) - 1) + [tail], [a[2] for a in at], [a[3] for a in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["part", "ord", "entry", "goal", "tail", "bad", "shared"])

    conv, back, at, ends, before = None, [], [], {START: (0, 0)}, None
    for batch in batches:
        for key, part, order, ways, first_turn, last_turn, first_initial, last_initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at and key != conv:
                yield finished(back, at, ends)
                back, at, ends, before = [], [], {START: (0, 0)}, None
            conv, chains = key, {}
            for w in ways:
                if w["entry"] in ends:
                    cost, rank = ends[w["entry"]]
                    mine = (cost + w["cost"], rank, w["place"], w["entry"])
                    if w["goal"] not in chains or mine < chains[w["goal"]]:
                        chains[w["goal"]] = mine
            back.append({goal: c[3] for goal, c in chains.items()})
            order_of = sorted({(rank, place) for _, rank, place, _ in chains.values()})
            ends = {goal: (cost, order_of.index((rank, place))) for goal, (cost, rank, place, _) in chains.items()}
            bad = before is not None and before[1] + first_initial not in LEGAL
            shared = before is not None and first_turn is not None and before[0] == first_turn
            before = last_turn, last_initial
            at.append((part, order, int(bad), int(shared)))
    if at:
        yield finished(back, at, ends)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the way that they take (turns, forced, entry, audit, tail at the end of the columns) to their edits and repaired rows."""
    for batch in batches:
        audits, rows = [], []
        for turns, forced, entry, letters, tail in zip(*(batch.column(c).to_pylist() for c in ("turns", "forced", "entry", "letters", "tail")), strict=True):
            audit, out = _applied(letters + "I" * tail, entry, [(t["role"], t["text"]) for t in turns], forced)
            audits.append(audit)
            rows.append([{"role": r, "text": t} for r, t in out])
        kept = [n for n in batch.schema.names if n not in ("turns", "forced", "entry", "letters", "tail")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(audits, pa.string()), pa.array(rows, pa.list_(_TURN))], [*kept, "audit", "turns"])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the contract's faults, drawn by crc32(`conv_id:turn`) % 20; nulls of role, text and the drawn key count as one space."""
    blank = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(draw == 4, "user").otherwise(F.coalesce("role", blank))
    return rows.where(draw != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("__copy")).drop("__copy")


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """a joined with b on equal keys, null with null; b's keys are left out."""
    b = b.select(*(F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in b.columns))
    joined = a.join(b, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys], how)
    return joined.drop(*(f"__{k}" for k in keys))


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired pieces of conversations (conv_id, turn, role, text): one row for a conversation, or several, ordered by (part, ord), for a long one.

    Columns: conv_id, part, ord, whole (the row is a whole conversation), blank, duplicate, truncated, illegal, cost, distinct_turns, min_turn, max_turn,
    audit (the edits' initials in order), turns (repaired rows of role and text).

    Rows are taken by turn, null first, then role, then MD5 of the text. Of copies of a row the first is judged and the others are deleted. Whether a text
    was seen on an earlier turn is told by digests, which travel without the texts; a text moves once, to its range. A conversation may hold any share
    of the rows: its ranges are solved apart and only pieces' costs, a few numbers for 64 rows, meet in one task. More than COPIES equal rows are counted
    before they move.

    Null role or text: one space. Empty text: blank. Very long texts: whole; a piece ends after 4 million characters. Null conversation: one of its own.
    Roles are told apart by their first letter; others than s, u, a are changed or deleted. Repeated rows: duplicates. Empty table: no rows. Extra columns, whatever
    their names: left out.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    kind, same = rows.schema["conv_id"].dataType.simpleString(), ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    told = rows.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    told = staged(told.where((F.col("first") < F.col("last")) | (F.col("n") > COPIES)), "turns-seen")
    met = _met(rows.drop("text"), told, same, "inner")
    marks = met.where(place > F.col("first")).select(*_order()).distinct()
    many = staged(met.where(F.col("n") > COPIES).groupBy(*_order()).agg(F.count("*").alias("n")).where(F.col("n") > COPIES), "turns-copies")
    keys = ["conv_id", "turn", "role", "digest"]
    single = _met(rows, many.select(*keys), keys, "left_anti").select(*keys, F.lit(1).cast("long").alias("n"), "text")
    copies = _met(rows, many, keys, "inner").groupBy(*keys).agg(F.first("n").alias("n"), F.first("text").alias("text"))
    dealt = single.unionByName(copies).unionByName(marks.select(*keys, F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text")))
    dealt = dealt.repartitionByRange(*_order()).sortWithinPartitions(*_order(), "n").select(*keys, "n", "text")
    pieces = staged(dealt.mapInArrow(_pieces, f"conv_id {kind}, {_SQL}, ways array<struct<entry:byte,goal:byte,cost:long,audit:string>>, forced array<long>"), "turns-pieces")

    open_ = pieces.where("not whole")
    ranked = F.transform("ways", lambda w: F.struct(w["entry"].alias("entry"), w["goal"].alias("goal"), w["cost"].alias("cost"), F.array_position(F.array_sort(F.array_distinct(F.col("ways.audit"))), w["audit"]).alias("place")))
    costs = open_.select("conv_id", "part", "ord", ranked.alias("ways"), "first_turn", "last_turn", "first_initial", "last_initial")
    chosen = costs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "ord").mapInArrow(_chained, "part int, ord int, entry int, goal int, tail int, bad int, shared int")
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["goal"] == F.col("goal")))[0]
    taken = open_.join(chosen, ["part", "ord"]).withColumn("way", way)
    plain = ["conv_id", "part", "ord", "whole", *_COUNTS]
    fixed = {"illegal": F.col("illegal") + F.col("bad"), "cost": F.col("cost") + F.col("way.cost") + INSERT * F.col("tail"), "distinct_turns": F.col("distinct_turns") - F.col("shared")}
    taken = taken.withColumns(fixed).select(*plain, "turns", "forced", "entry", F.col("way.audit").alias("letters"), "tail")
    schema = f"conv_id {kind}, part int, ord int, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, turns array<struct<role:string,text:string>>"
    return pieces.where("whole").select(*plain, "audit", "turns").unionByName(taken.mapInArrow(_mended, schema))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (conv_id, part, ord), their rows joined as text, to a row for each conversation; texts are hashed as they pass."""

    def record() -> pa.RecordBatch:
        low, high = sums["min_turn"], sums["max_turn"]
        gaps = 0 if low is None else high - low + 1 - sums["distinct_turns"]
        values = [[conv], [gaps], *([sums[c]] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ["".join(audit)], [digest.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v, kind if i == 0 else pa.string() if i > 6 else pa.int64()) for i, v in enumerate(values)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    conv = kind = sums = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            if sums is None or row["conv_id"] != conv:
                if sums is not None:
                    yield record()
                conv, audit, digest, wrote = row["conv_id"], [], hashlib.sha256(), False
                sums = dict.fromkeys(_COUNTS, 0) | {"min_turn": None, "max_turn": None}
            for c in _COUNTS[:6]:
                sums[c] += row[c]
            if row["min_turn"] is not None:
                sums["min_turn"] = row["min_turn"] if sums["min_turn"] is None else min(sums["min_turn"], row["min_turn"])
                sums["max_turn"] = row["max_turn"] if sums["max_turn"] is None else max(sums["max_turn"], row["max_turn"])
            audit.append(row["audit"])
            if row["some"]:
                digest.update(b"\n" if wrote else b"")
                digest.update(row["body"].encode())
                wrote = True
    if sums is not None:
        yield record()


def reports(pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation of `conversations`; pieces are those of `repair`.

    A conversation of one piece is digested where it lies; the pieces of others are sorted and hashed as they pass. A SHA-256 is one sequence, so that one task
    hashes the repaired text of one conversation. A conversation without pieces: zeros, no edits, the digest of no bytes.
    """
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    whole = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    kind = pieces.schema["conv_id"].dataType.simpleString()
    cut = pieces.where("not whole").select("conv_id", "part", "ord", *_COUNTS, "audit", (F.size("turns") > 0).alias("some"), body.alias("body"))
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "ord")
    cut = cut.mapInArrow(_summed, f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")
    found = _met(conversations.select("conv_id").distinct(), whole.unionByName(cut), ["conv_id"], "left")
    zero = F.lit(0).cast("long")
    return found.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", *counts)), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
