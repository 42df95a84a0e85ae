"""Repair of conversation structure: cheapest edits that make the roles alternate, and what was wrong.

Rows are put in order by ranges of (conversation, turn), so that a long conversation is spread over many tasks. Every task solves the
stretches of its own rows from each state to each (:mod:`.audit`); a small row per stretch goes on, and those of one
conversation are joined in order. Texts are shuffled once, when the edits are applied: the rows of a conversation pass through a
task one after the other and are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit
from .audit import BLANK, DUPLICATE, SOUND, TRUNCATED, Stretch
from .common import stored

STRETCH = 4096      # rows solved together
SPACES = " \t\n\x0b\x0c\r"
ORDER = ["turn", "role0", "text0"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role0, text0, copy, role, text: the rows with the planted faults; null roles and texts are one space.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it
    a user's. role0 and text0 (a hash) are those before, by which rows of one turn are ordered; copies are adjacent.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _key("role").alias("role"), _key("text").alias("text"),
                                (F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20).alias("_f"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("_f <> 0").select(
        "conv_id", "turn", F.col("role").alias("role0"), F.xxhash64("text").alias("text0"), F.explode(copies).alias("copy"),
        F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def turns(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of :func:`damaged`."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _key("role").alias("role0"), F.xxhash64(_key("text")).alias("text0"),
                                F.lit(0).alias("copy"), _key("role").alias("role"), _key("text").alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role0, text0, row, copy, initial, fault: every row's first fault, without the texts."""
    body = F.rtrim("text", F.lit(SPACES))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    thin = rows.select("conv_id", *ORDER, F.monotonically_increasing_id().alias("row"), "copy", F.substring("role", 1, 1).alias("initial"),
                       (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"), F.unhex(said).alias("said"))
    thin = stored(thin, "repair-rows")
    # The first row that says something is found by a partial aggregation and marked by its number: no hot group is gathered.
    first = thin.groupBy("conv_id", "said").agg(F.min(F.struct(*ORDER, "row", "copy")).alias("f")).select("f.row", "f.copy", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    return thin.join(first, ["row", "copy"], "left").select("conv_id", *ORDER, "row", "copy", "initial", fault.alias("fault"))


_STRETCH = ("part long, seq long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
            "first_initial string, last_initial string, ways array<struct<start: int, end: int, cost: long, letters: string>>")
_FIELDS = [f.split()[0] for f in _STRETCH.split(", ")[:12]]
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
_NEVER = object()


def stretches(thin: DataFrame) -> DataFrame:
    """One row per stretch of a conversation, numbered by task and place."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, current, seq, out, first = _NEVER, None, 0, [], True
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, turn, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault")), strict=True):
                if c != conv or current.rows >= STRETCH:
                    # Only a task's first conversation, or one cut here, can have begun before: others begin with nothing.
                    starts = range(audit.STATES) if first or c == conv else [audit.NOTHING]
                    current = Stretch(best={s: audit.begin(s) for s in starts})
                    out.append((c, part, seq, current))
                    conv, seq, first = c, seq + 1, False
                current.add(turn, initial, fault)
            if len(out) > 1000:
                yield _stretch_rows(out[:-1], kind)
                out = out[-1:]
        if out:
            yield _stretch_rows(out, kind)

    order = ["conv_id", *ORDER, "row", "copy"]
    placed = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault")
    return placed.mapInArrow(solve, f"conv_id {_kind(thin)}, {_STRETCH}")


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _stretch_rows(found: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([c for c, *_ in found], kind), pa.array([p for _, p, _, _ in found], pa.int64()), pa.array([s for _, _, s, _ in found], pa.int64())]
    for name in _FIELDS[2:]:
        columns.append(pa.array([getattr(x, name) for *_, x in found], pa.string() if name.endswith("initial") else pa.int64()))
    ways = [[dict(zip(("start", "end", "cost", "letters"), w, strict=True)) for w in x.ways()] for *_, x in found]
    return pa.RecordBatch.from_arrays([*columns, pa.array(ways, _WAYS)], ["conv_id", *_FIELDS, "ways"])


def audits(found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit from the stretches."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, whole, best, out = _NEVER, None, None, []

        def end() -> None:
            cost, letters = audit.finished(best)
            gaps = whole["last_turn"] - whole["first_turn"] + 1 - whole["turns"] if whole["turns"] else 0
            out.append((conv, gaps, whole["blank"], whole["duplicate"], whole["truncated"], whole["illegal"], cost, letters))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    if whole is not None:
                        end()
                    conv, whole, best = row["conv_id"], None, audit.begin(audit.NOTHING)
                best = audit.joined(best, {(w["start"], w["end"]): (w["cost"], w["letters"]) for w in row["ways"]})
                whole = row if whole is None else _together(whole, row)
            if len(out) > 1000:
                yield _audit_rows(out, kind)
                out.clear()
        if whole is not None:
            end()
            yield _audit_rows(out, kind)

    order = ["conv_id", "part", "seq"]
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return found.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(join, f"conv_id {_kind(found)}, {counts}, audit string")


def _together(a: dict, b: dict) -> dict:
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += not audit.legal(a["last_initial"], b["first_initial"])
    out["turns"] -= b["first_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    out["last_initial"] = b["last_initial"]
    return out


def _audit_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", *COUNTS, "audit"])


def conversation_audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every conversation of the table, those without rows left included: counts, cost and the edits' initials."""
    found = audits(stretches(stored(faults(rows), "repair-faults")))
    known = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = known.join(found, known["_conv"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("_conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))


class _Repair:
    """Applies the letters of one conversation to its rows as they come."""

    def __init__(self, row: dict, said: Callable[[dict, str, str, str], None]):
        self.row, self.said, self.at, self.due = row, said, 0, "user"

    def _say(self, edit: str, role: str, text: str) -> None:
        self.said(self.row, edit, role, text)
        self.due = "assistant" if role[:1] == "u" else "user"

    def insertions(self) -> None:
        letters = self.row["audit"]
        while self.at < len(letters) and letters[self.at] == "I":
            self._say("I", self.due, "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.insertions()
        edit = self.row["audit"][self.at]
        self.at += 1
        if edit != "D":
            self._say(edit, role if edit == "K" else self.due, text)


def _walk(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows of each conversation one after the other in one partition, its audit before them."""
    heads = audited.withColumn("kind", F.lit(0))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER, "copy").select("conv_id", "kind", *COUNTS, "audit", "role", "text")


def _applied(batches: Iterator[pa.RecordBatch], begun: Callable[[dict], None], said: Callable, ended: Callable[[dict], None]) -> Iterator[pa.RecordBatch]:
    """Yields every batch after its rows went through; the callbacks see each conversation begin, speak and end."""
    repair = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if repair is not None:
                    repair.insertions()
                    ended(repair.row)
                repair = _Repair(row, said)
                begun(row)
            else:
                repair.take(row["role"], row["text"])
        yield batch
    if repair is not None:
        repair.insertions()
        ended(repair.row)


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the repaired conversations, positions from 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        position = [0]
        kind = None

        def said(row: dict, edit: str, role: str, text: str) -> None:
            out.append((row["conv_id"], position[0], edit, role, text))
            position[0] += 1

        def begun(row: dict) -> None:
            position[0] = 0

        def taken() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "edit", "role", "text"])

        for batch in _applied(batches, begun, said, lambda row: None):
            kind = batch.schema.field("conv_id").type
            yield taken()
        if out:
            yield taken()

    return _walk(rows, audited).mapInArrow(run, f"conv_id {_kind(audited)}, position long, edit string, role string, text string")


def digest(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The audited conversations with repaired_sha256, the digest of the repaired ``role:text`` lines joined by line feeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = {}
        kind = None

        def begun(row: dict) -> None:
            state["sha"], state["sep"] = hashlib.sha256(), ""

        def said(row: dict, edit: str, role: str, text: str) -> None:
            state["sha"].update(f"{state['sep']}{role}:{text}".encode())
            state["sep"] = "\n"

        def ended(row: dict) -> None:
            out.append((row["conv_id"], *(row[c] for c in COUNTS), row["audit"], state["sha"].hexdigest()))

        def taken() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in _applied(batches, begun, said, ended):
            kind = batch.schema.field("conv_id").type
            yield taken()
        if out:
            yield taken()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return _walk(rows, audited).mapInArrow(run, f"conv_id {_kind(audited)}, {counts}, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows are taken by turn, null turns first, rows of one turn by role and hash of the text (so repeated rows have one order, and
    equal ones are interchangeable). Null roles and texts are one space. Rows with a null conv_id are one conversation. A
    conversation whose rows are all gone has zeros, no edits and the digest of the empty string; an empty table gives none.
    Other columns are not read. A conversation's audit is one string and its digest one sequential sum: its rows
    stream through one task in the last step, in bounded memory.
    """
    rows = damaged(conversations) if damage else turns(conversations)
    audited = stored(conversation_audits(rows, conversations), "repair-audits")
    return digest(rows, audited)
