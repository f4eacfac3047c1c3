"""List items put into lists: sequences of numbered paragraphs, their levels, continued and empty items.

Classes of blocks: item (a numbered paragraph that can be one), candidate (a list paragraph without a number, which may
continue an item), rejected (one of a custom style), quiet (figures and references: they end a sequence and do not
interrupt its numbers), other. Blocks without a row, such as tables, stand between rows whose `block`s are not neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of lists that do not stop a conversion, and the others.
WARNINGS = ("list_root_level_decrease_split", "list_root_level_normalized", "empty_parent_list_item")
INTERRUPTED, JUMP, AMBIGUOUS = "interrupted_list_continuation_not_serializable", "list_level_jump_not_serializable", "ambiguous_list_continuation_not_serializable"
EMPTY_ITEM, EMPTY_CONTINUATION = "empty_list_item_not_serializable", "empty_list_continuation_not_serializable"


class _Sequence:
    """Open lists by level, from the level of the first item; and what has been closed inside."""

    def __init__(self, root: int):
        self.root, self.last = root, None
        self.open: dict[int, list] = {}  # level: number, signature, list, items so far
        self.numbers: set[int] = set()
        self.closed_levels: set[tuple[int, int]] = set()
        self.closed_numbers: set[int] = set()

    def close(self, level: int) -> None:
        number = self.open.pop(level)[0]
        self.closed_levels.add((number, level))
        self.closed_numbers.add(number)

    def reopens(self, number: int, level: int) -> bool:
        return (number, level) in self.closed_levels or (number in self.closed_numbers and all(x[0] != number for x in self.open.values()))

    def path(self) -> str:
        return ".".join(f"{x[2]}:{x[3]}" for _, x in sorted(self.open.items()))


class _Document:
    def __init__(self):
        self.sequence, self.part, self.lists = None, 0, 0
        self.left: set[int] = set()  # numbers of the sequence before, until another block interrupts them
        self.interrupted: set[int] = set()

    def end(self, interrupt: bool) -> None:
        if self.sequence:
            self.left, self.sequence = self.sequence.numbers, None
        if interrupt:
            self.interrupted |= self.left
            self.left = set()

    def item(self, number: int, level: int, signature: str) -> list[str]:
        codes = []
        while True:
            s = self.sequence = self.sequence or _Sequence(level)
            if number in self.interrupted or s.reopens(number, level):
                codes.append(INTERRUPTED)
            if s.last is not None and level > s.last + 1:
                codes.append(JUMP)
            elif level < s.root:
                codes.append(WARNINGS[0])
            else:
                break
            self.end(False)
        if s.last is None and level:
            codes.append(WARNINGS[1])
        for deeper in [x for x in s.open if x > level]:
            s.close(deeper)
        if level in s.open and s.open[level][1] != signature:
            s.close(level)
        if level not in s.open:
            self.lists += 1
            s.open[level] = [number, signature, self.lists, 0]
        s.open[level][3] += 1
        s.last, self.part = level, 0
        s.numbers.add(number)
        return list(dict.fromkeys(codes))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by document and block; what is carried along is one document's open sequence, its numbers, and an empty item until it is known whether a list of its own follows."""
    document, name, begun, waiting = _Document(), None, False, None
    names = ("pkg_id", "index", "act", "gap", "num_id", "level", "signature", "empty", "reason")
    kinds = None

    def told(path: str | None) -> tuple:
        child = path is not None and path.startswith(waiting[3] + ".")
        return (*waiting[:5], [*waiting[5], WARNINGS[2] if child else EMPTY_ITEM], None)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], names=["pkg_id", "index", "list_id", "path", "part", "codes", "reason"])

    for batch in batches:
        out: list[tuple] = []
        kinds = [batch["pkg_id"].type, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]
        for pkg, index, act, gap, number, level, signature, empty, reason in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if not begun or pkg != name:
                if waiting:
                    out.append(told(None))
                document, name, begun, waiting = _Document(), pkg, True, None
            elif gap:
                document.end(True)
            if act in ("item", "continuation"):
                if act == "item":
                    codes, at = document.item(number, level, signature), level
                else:
                    document.part += 1
                    codes, at = [EMPTY_CONTINUATION] if empty else [], document.sequence.last
                path = document.sequence.path()
                if waiting:
                    out.append(told(path))
                row = (pkg, index, document.sequence.open[at][2], path, document.part, codes, None)
                waiting = row if empty and act == "item" else None
                if not waiting:
                    out.append(row)
            else:
                document.end(act != "quiet")
                if reason is not None:
                    out.append((pkg, index, None, None, None, [AMBIGUOUS], reason))
        yield made(out)
    if waiting:
        yield made([told(None)])


def continued(rows: DataFrame) -> DataFrame:
    """Adds act (what a block does to lists), gap (blocks without a row before it) and reason (why a candidate continues nothing); keeps empty.

    A run of candidates right behind an item continues it if another item of the same number, level and signature comes
    right behind the run. Both neighbours are looked up from every candidate: the last block before it that is none, and
    the first behind it. All windows read one order, so a task sorts its rows once.
    """
    order = Window.partitionBy("pkg_id").orderBy("block")
    rows = rows.withColumn("_region", F.col("block") - F.row_number().over(order))
    rows = rows.withColumn("_mark", F.when(F.col("class") != "candidate", F.struct("_region", "class", "num_id", "level", "signature")))
    around = {k: F.expr(f"{k}(_mark) ignore nulls over (partition by pkg_id order by block)") for k in ("lag", "lead")}
    rows = rows.withColumns({"_a": around["lag"], "_z": around["lead"], "_lag": F.lag("class").over(order), "gap": F.coalesce(F.lag("_region").over(order) != F.col("_region"), F.lit(False))})
    a, z = F.col("_a"), F.col("_z")
    behind = F.coalesce((a["class"] == "item") & (a["_region"] == F.col("_region")), F.lit(False))
    next_item = F.coalesce((z["class"] == "item") & (z["_region"] == F.col("_region")), F.lit(False))
    reason = (
        F.when(~next_item, "end of sequence").when(z["num_id"] != a["num_id"], "other number").when(z["level"] < a["level"], "other level, behind an inner list")
        .when(z["level"] != a["level"], "other level").when(z["signature"] != a["signature"], "other signature")
    )
    first = ~((F.col("_lag") == "candidate") & ~F.col("gap"))
    candidate = F.col("class") == "candidate"
    why = F.when(candidate & behind & first, reason).when((F.col("class") == "rejected") & (F.col("_lag") == "item") & ~F.col("gap"), "custom style")
    act = F.when(candidate & behind & reason.isNull(), "continuation").when(F.col("class").isin("item", "quiet"), F.col("class")).otherwise("other")
    return rows.select("pkg_id", "index", "block", act.alias("act"), "gap", why.alias("reason"), "num_id", "level", "signature", "empty")


def list_items(rows: DataFrame) -> DataFrame:
    """pkg_id, index, list_id, path, part, codes, reason: items (part 0), paragraphs that continue them (1, 2 ...), and blocks with a code alone.

    rows: pkg_id, index, block (place among all blocks), class, and of items num_id, level, kind, number_format,
    start, optionally empty. An item of another signature than the open list's at its level opens a sibling, one level
    deeper opens a child of the last item; deeper still, or above the level a sequence began at, a new sequence
    begins. A number is not to be used again once another block has interrupted it or its list has been closed. `path`
    has list:item for each level. An empty item is an error unless it has a list of its own, which is a warning.

    The stack is a true state machine: rows are read in document order, documents are independent and dealt over the
    tasks, and what a task holds is one document's open lists. A null pkg_id is a document of its own; a document
    without items gives no rows. Of rows of one block the order is not defined.
    """
    signature = F.concat_ws("|", "num_id", "level", "kind", "number_format", "start")
    empty = F.coalesce("empty", F.lit(False)) if "empty" in rows.columns else F.lit(False)
    found = continued(rows.withColumns({"signature": signature, "empty": empty}))
    ordered = found.sortWithinPartitions("pkg_id", "block")  # the windows have dealt the rows by document
    kind = dict(rows.dtypes)["pkg_id"]
    return ordered.select("pkg_id", "index", "act", "gap", "num_id", "level", "signature", "empty", "reason").mapInArrow(_placed, f"pkg_id {kind}, index int, list_id int, path string, part int, codes array<string>, reason string")


def list_problems(items: DataFrame) -> DataFrame:
    """pkg_id, index, code, severity of what `list_items` found."""
    code = F.col("code")
    return items.select("pkg_id", "index", F.explode("codes").alias("code")).select("pkg_id", "index", "code", F.when(code.isin(*WARNINGS), "warning").otherwise("error").alias("severity"))


def block_class(role: Column, numbered: Column, continuation: Column) -> Column:
    """The class of a body block: `role` of `conversion.body_blocks`, whether it is a list item, `roles.continuation`."""
    return F.when(numbered, "item").when(role.isin("figure", "figure_text", "bibl"), "quiet").otherwise(F.coalesce(continuation, F.lit("other")))
