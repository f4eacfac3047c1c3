"""Conversation structure repair: faults as short signatures, each distinct one solved once, edits replayed."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import spread, written

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What has been written so far: nothing, a system row, up to a user row, up to an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row that starts with this letter leads from each of these; None: it may not stand there.
LEADS = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None,) * 4}
#: The only row that an edit can write there: user, but behind a user row.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), {USER: "user", ASSISTANT: "assistant"}
#: Rows whose solutions are found before the recursion goes on to earlier ones, so that it stays shallow.
STRETCH = 200
BLANKS = r"\x20\x09-\x0D"


def solve(signature: str) -> tuple[str, int]:
    """Initials of the cheapest edits that leave `(s?(ua)+)?`, of equally cheap ones the least string, and their cost.

    A letter of the signature is a row: its role's initial (o: any other), a capital where the row is truncated,
    x where it has to go. What is left to do depends on the place and on what has been written last alone, so
    `best` is a recursion on these two, and remembers. Options of one place start with different letters, so the
    first letter decides between equally cheap ones. No place takes more than two inserted rows.
    """
    count = len(signature)
    costs, letters = array("q", [-1]) * (4 * count + 4), bytearray(4 * count + 4)

    def consumed(at: int, state: int) -> tuple[int, str]:
        """The best that does not insert here."""
        if at == count:
            return (0, "") if state in (START, ASSISTANT) else (1 << 60, "")
        code = signature[at]
        found = [(DELETE + best(at + 1, state), "D")]
        if code != "x":
            stays = TRUNCATED if code.isupper() else 0
            if (lead := LEADS[code.lower()][state]) is not None:
                found.append((stays + best(at + 1, lead), "K"))
            found.append((REROLE + stays + best(at + 1, NEXT[state]), "R"))
        return min(found)

    def best(at: int, state: int) -> int:
        place = 4 * at + state
        if costs[place] < 0:
            then = NEXT[state]
            inserted = min(consumed(at, then)[0], INSERT + consumed(at, NEXT[then])[0])
            costs[place], letter = min(consumed(at, state), (INSERT + inserted, "I"))
            letters[place] = ord(letter or "\0")
        return costs[place]

    for at in range(count, -1, -STRETCH):
        for state in range(4):
            best(at, state)
    cost, audit, at, state = best(0, START), [], 0, START
    while at < count or letters[4 * at + state]:
        letter = chr(letters[4 * at + state])
        audit.append(letter)
        if letter in "IR":
            state = NEXT[state]
        elif letter == "K":
            state = LEADS[signature[at].lower()][state]
        at += letter != "I"
        best(at, state)
    return "".join(audit), cost


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(x.as_py()) for x in batch["signature"]]
        audits, costs = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch["signature"], batch["n"], pa.array(audits, pa.string()), pa.array(costs, pa.int64())], names=["signature", "n", "audit", "cost"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as damage leaves them, with `copies` (0: dropped, then without turn, role and text; 2: repeated).

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3
    repeats it, 4 makes it the user's. A null is read as one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, nulls as one space, for repair without damage."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order: one row for each conversation of the partition, with its part of the signature and counts."""
    part = TaskContext.get().partitionId()
    names = ["conv_id", "part", "signature", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail"]
    kind, now, begun = None, None, False
    done: list[list] = []
    for batch in batches:
        kind = batch["conv_id"].type
        for conv, turn, initial, fault, first, copies in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "first", "copies")), strict=True):
            if not begun or conv != now[0]:
                now, begun = [conv, part, [], None, None, 0, 0, 0, 0, 0, "", ""], True
                done.append(now)
            if not copies:
                continue
            if turn is not None and turn != now[4]:
                now[3], now[4], now[5] = turn if now[3] is None else now[3], turn, now[5] + 1
            fresh = int(first and fault != "blank")  # the first of equal rows is no duplicate
            repeats = 0 if fault == "blank" else copies - fresh
            now[2].append((initial.upper() if fault == "truncated" else initial) * fresh + "x" * (copies - fresh))
            now[6] += copies * (fault == "blank")
            now[7] += repeats
            now[8] += fresh * (fault == "truncated")
            now[9] += copies - 1 + (bool(now[11]) and now[11] + initial not in ("su", "ua", "au"))
            now[10], now[11] = now[10] or initial, initial
        for row in done[:-1]:
            row[2] = "".join(row[2])
        if len(done) > 1000:
            yield _table(done[:-1], names, kind)
            done = done[-1:]
    if done:
        done[-1][2] = "".join(done[-1][2])
        yield _table(done, names, kind)


def _table(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of each conversation of `rows` (as `damaged` gives them).

    Rows go by turn, nulls first, those of one turn by role and then by their text's sha256. Equal rows are
    counted before anything is shuffled whole, and texts stay behind: their digests travel. The first row of
    each content is found by partial aggregation and looked up with frequent contents on the map side. A
    range of rows is one task's, whichever conversations it holds, so a long conversation is divided, and only one
    letter a row of it comes together.
    """
    text = F.col("text")
    fault = F.when(~text.rlike(f"[^{BLANKS}]"), "blank").when(~text.rlike(rf"[.!?][{BLANKS}]*\z"), "truncated").otherwise("none")
    first_letter = F.substring("role", 1, 1)
    initial = F.when(first_letter.isin("s", "u", "a"), first_letter).otherwise("o")
    short = rows.select("conv_id", "turn", "role", _digest(), fault.alias("fault"), initial.alias("initial"), "copies")
    content = F.sha2(F.to_json(F.struct(F.col("conv_id").cast("string"), "role", F.hex("digest"))).cast("binary"), 256).alias("content")
    equal = written(short.groupBy("conv_id", "turn", "role", "digest", "fault", "initial").agg(F.sum("copies").alias("copies")).withColumn("content", content), "turns-rows")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    leads = written(equal.where("copies > 0").groupBy("content").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")), "turns-leads")
    found = spread(equal.where("copies > 0"), leads, "content", equal.count()).select("conv_id", "turn", "role", "digest", "fault", "initial", "copies", (place == F.col("lead")).alias("first"))
    gone = equal.where("copies = 0").select("conv_id", "turn", "role", "digest", "fault", "initial", "copies", F.lit(False).alias("first"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = found.unionByName(gone).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "first", "copies")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, part int, signature string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    # one row for each range that a conversation touches
    parts = written(ranged.mapInArrow(_chunks, schema), "turns-parts").withColumn("empty", F.col("head") == "")
    inside = Window.partitionBy("conv_id").orderBy("part")
    seam = F.lag(F.when(~F.col("empty"), F.col("tail")), 1).over(inside)
    seams = parts.where("not empty").withColumn("broken", seam.isNotNull() & ~F.concat(seam, "head").isin("su", "ua", "au")).withColumn("same", F.coalesce(F.lag("last_turn").over(inside) == F.col("first_turn"), F.lit(False)))
    whole = seams.unionByName(parts.where("empty").withColumns({"broken": F.lit(False), "same": F.lit(False)}))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce(F.max(wide("last_turn")) - F.min(wide("first_turn")) + 1 - F.sum("turns") + F.count_if("same"), F.lit(0))
    return whole.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "signature"))), lambda x: x["signature"]), "").alias("signature"),
        gaps.alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        (F.sum("illegal") + F.count_if("broken")).alias("illegal"),
    ).withColumn("gaps", F.expr("try_cast(gaps as bigint)"))


def audits(rows: DataFrame) -> DataFrame:
    """`faults` with audit and cost: each distinct signature is solved once; frequent ones are joined on the map side."""
    found = written(faults(rows), "turns-faults")
    distinct = found.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    solved = written(distinct.mapInArrow(_solved, "signature string, n long, audit string, cost long"), "turns-solved")
    return spread(found, solved, "signature", found.count()).drop("signature")


class Replay:
    """Writes a conversation's edits onto its rows, in their order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is inserted before the row, and of the row itself unless it goes."""
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            self.state = NEXT[self.state]
            yield "R", ROLE[self.state], text
        elif letter == "K":
            self.state = LEADS[role[0]][self.state]
            yield "K", role, text


def _replayed(batches: Iterator[pa.RecordBatch], take: Callable, result: Callable) -> Iterator[pa.RecordBatch]:
    """Rows by conversation, its audit first; one row at a time, so a conversation of any length takes the same memory."""
    replay = conv = None
    for batch in batches:
        done: list = []
        for conv_, audit, role, text, copies in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if audit is not None:
                if replay:
                    take(done, conv, replay.inserted(), True)
                replay, conv = Replay(audit), conv_
            for _ in range(copies or 0):
                take(done, conv, replay.row(role, text), False)
        if done:
            yield result(done, batch["conv_id"].type)
    if replay:
        done = []
        take(done, conv, replay.inserted(), True)
        if done:
            yield result(done, batch["conv_id"].type)


def _in_order(rows: DataFrame, solved: DataFrame) -> DataFrame:
    own = rows.where("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", _digest(), "text", "copies")
    lead = solved.select("conv_id", "audit", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))))
    both = own.unionByName(lead)
    order = ["conv_id", F.col("audit").isNull(), "turn", "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text", "copies")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places: dict = {}

    def take(done, conv, lines, last):
        for edit, role, text in lines:
            done.append((conv, places.setdefault("at", 0), edit, role, text))
            places["at"] += 1
        if last:
            places.clear()

    def result(done, kind):
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    return _replayed(batches, take, result)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, place (0, 1 ...), edit (K, R or I), role, text of every repaired row; `solved` as `audits` gives it."""
    kind = dict(rows.dtypes)["conv_id"]
    return _in_order(rows, solved).mapInArrow(_rows_of, f"conv_id {kind}, place long, edit string, role string, text string")


def _hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict = {}

    def take(done, conv, lines, last):
        for _, role, text in lines:
            if "sum" in state:
                state["sum"].update(b"\n")
            state.setdefault("sum", hashlib.sha256()).update(f"{role}:{text}".encode())
        if last:
            done.append((conv, state.pop("sum", hashlib.sha256()).hexdigest()))

    def result(done, kind):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])], names=["conv_id", "repaired_sha256"])

    return _replayed(batches, take, result)


def repaired_hashes(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's repaired rows as `role:text`, a line feed between them.

    The hash of a conversation is one sequence of steps, so its rows pass through one task, one at a time.
    """
    return _in_order(rows, solved).mapInArrow(_hashes_of, f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text; other columns are left out) are damaged first unless `damage` is false, then read by turn, nulls first,
    those of one turn by role and text digest. Each has at most one fault: blank, else duplicate (role and text as
    in an earlier row), else truncated (its last character but blanks is none of `.!?`). `audit` has the initials of the
    cheapest Keep, Rerole, Delete and Insert edits that leave role initials `(s?(ua)+)?`. Nulls are read as one
    space, a null conv_id is a conversation of its own, and a role's first letter alone matters. A conversation that
    loses all its rows has zeros, an empty audit and the hash of nothing. gaps beyond 63 bits are null. An empty
    table gives no rows.
    """
    rows = damaged(conversations) if damage else undamaged(conversations)
    solved = written(audits(rows), "turns-audits")
    hashes = repaired_hashes(rows, solved)
    both = solved.join(hashes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
