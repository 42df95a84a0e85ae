"""Frames of recorded call stacks: symbols by context, process and the mappings valid at the event's time.

A recorded stack is an array of addresses, leaf first, in which a marker stands before the addresses of each context:

    [KERNEL, addr, addr, ..., USER, addr, addr, ..., SCRIPT, text id, ...]

A kernel address is looked up among the kernel's symbols; a user address first in the mappings of its process, then in the
symbols of the mapped object; a script frame is the id of a text such as ``name (file:line)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import all_of
from ..shared import stored
from .enrich import _distance, asof, floor_lookup

# The markers of the contexts in a recorded stack, and the name of the kernel as an object.
KERNEL = -128
USER = -512
SCRIPT = -130
KERNEL_DSO = "[kernel.kallsyms]"
UNKNOWN = "Unknown"

FRAME = "array<struct<addr:bigint,symbol:string,offset:bigint,kernel:boolean,dso:string>>"
NEVER = -(1 << 63)
TOP = 15                # level of the largest blocks, of 16^15 addresses


def stack_frames(df: DataFrame, symbols: DataFrame, maps: DataFrame, texts: DataFrame | None = None, stack: str = "stack",
                 pid: str = "_pid", at: str = "_time", kernel: bool = True, user: bool = True, max_rows: int | None = None) -> DataFrame:
    """Add ``frames``: array of (addr, symbol, offset, kernel, dso) in stack order, without the markers.

    ``symbols``: dso, start, name[, length]; those of the kernel have the dso KERNEL_DSO and start at their address, those of an
    object start at their place in its file. ``maps``: ``pid``, ``at``, seq, start, end (exclusive), dso, place (of the start in the file):
    of the mappings that hold an address and are not later than the event the latest counts; one without dso unmaps. ``texts``: addr, text.
    ``kernel`` and ``user`` select contexts (script frames count as user); frames before any marker are always kept.

    Unknown kernel symbols have offset 0; without a mapping symbol, offset and dso are Unknown, 0, Unknown, without a symbol in the
    mapped object Unknown, the place in the file, Unknown. Before any marker only ``addr`` is known. Null and empty stacks have no frames.

    Mappings change seldom: an event takes the time of the last change in its process, and work is on distinct
    (process, change, stack) from there on; those get a number, so that frames do not carry their whole stack through the joins.
    """
    changes = maps.select(pid, at, F.col(at).alias("_change")).distinct()
    known = asof(df.where(F.size(stack) > 0), changes, [pid], ["_change"], at, at, max_rows=max_rows)
    known = known.withColumn("_change", F.coalesce("_change", F.lit(NEVER)))
    keys = [pid, "_change", stack]
    placed = F.transform(stack, lambda a, i: F.struct(i.alias("pos"), a.alias("addr")))
    marks = F.filter(placed, lambda p: p["addr"].isin(KERNEL, USER, SCRIPT))
    # The distinct stacks are used several times below; the table spares their scan over all events each time and fixes their numbers.
    kept = stored(known.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()), "stacks")
    single = kept.withColumn("_marks", marks).select("_id", pid, "_change", "_marks", F.posexplode(stack).alias("_pos", "addr"))
    before = F.filter("_marks", lambda m: m["pos"] < F.col("_pos"))
    single = single.where(~F.col("addr").isin(KERNEL, USER, SCRIPT) | F.col("addr").isNull())
    single = single.withColumn("_context", F.try_element_at(before, F.lit(-1))["addr"]).drop("_marks")
    if not kernel:
        single = single.where(~F.col("_context").eqNullSafe(F.lit(KERNEL)))
    if not user:
        single = single.where(F.col("_context").isNull() | (F.col("_context") == KERNEL))

    mapped = stored(_mapped(single.where(F.col("_context") == USER).select(pid, "_change", "addr").distinct(), maps, pid, at, max_rows), "mapped")
    single = single.join(mapped, all_of([F.col("_context") == USER, F.col(pid) == F.col("_mp"), F.col("_change") == F.col("_mc"),
                                         F.col("addr") == F.col("_ma")]), "left").drop("_mp", "_mc", "_ma")
    in_kernel = F.col("_context") == KERNEL
    single = single.withColumns({"dso": F.when(in_kernel, F.lit(KERNEL_DSO)).otherwise(F.col("_object")),
                                 "_place": F.when(in_kernel, F.col("addr")).otherwise(F.col("_place"))})
    length = ["length"] if "length" in symbols.columns else []
    found = floor_lookup(single, "_place", symbols, "start", ["name", *length], ["dso"])
    offset = _distance(F.col("_place"), F.col("_start"))
    hit = F.col("_start").isNotNull()
    if length:
        hit = hit & (offset < F.col("length"))
    found = found.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_offset": offset})
    if texts is not None:
        said = texts.select(F.col("addr").alias("_ta"), F.col("text").alias("_text")).groupBy("_ta").agg(F.max("_text").alias("_text"))
        found = found.join(said, (F.col("_context") == SCRIPT) & (F.col("addr") == F.col("_ta")), "left")
    else:
        found = found.withColumn("_text", F.lit(None).cast("string"))
    rows = found.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_pos", _frame().alias("f")))).alias("_f"))   # bounded by stack depth
    rows = kept.join(rows, "_id").select(F.col(pid).alias("_rp"), F.col("_change").alias("_rc"), F.col(stack).alias("_rs"), F.col("_f.f").alias("frames"))
    none = F.array().cast(FRAME)
    joined = known.join(rows, F.col(pid).eqNullSafe(F.col("_rp")) & (F.col("_change") == F.col("_rc")) & (F.col(stack) == F.col("_rs")), "left")
    empty = df.where(F.coalesce(F.size(stack), F.lit(0)) <= 0).withColumn("frames", none)
    return joined.select(*df.columns, F.coalesce("frames", none).alias("frames")).unionByName(empty)


def _mapped(wanted: DataFrame, maps: DataFrame, pid: str, at: str, max_rows: int | None) -> DataFrame:
    """_mp, _mc, _ma: process, change and address, with _object and _place of the latest mapping that holds the address by then.

    A mapping is filed under the aligned blocks of 16^level addresses that make it up, at most 30 a level; an address lies in one block
    of each level. In a block every mapping holds every address, so the latest one there is an as-of lookup, and the
    latest of the levels counts: rows grow with the mappings and the addresses, not with the versions an address has had.
    """
    spans = maps.where(F.col(pid).isNotNull() & F.col(at).isNotNull() & (F.col("start") < F.col("end")))
    level = F.sequence(F.lit(0), F.lit(TOP))
    pieces = spans.select(F.col(pid).alias("_mp"), F.col(at).alias("_from"), F.col("seq"), F.struct(
        F.col(at).alias("f"), F.col("seq").alias("s"), F.col("dso").alias("object"), F.col("start").alias("lo"), F.col("place").alias("place")).alias("_found"),
        F.explode(F.flatten(F.transform(level, lambda k: _blocks(F.col("start"), F.col("end"), k)))).alias("_b")).select("*", "_b.*").drop("_b")
    levels = sorted(r[0] for r in pieces.select("_level").distinct().collect())   # at most TOP + 1 values
    probes = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_ma", 4 * k).alias("_block")) for k in levels or [0]])
    points = wanted.select(F.col(pid).alias("_mp"), F.col("_change").alias("_mc"), F.col("addr").alias("_ma"))
    points = points.where("_mp IS NOT NULL AND _ma IS NOT NULL").withColumn("_b", F.explode(probes)).select(
        "*", "_b.*", F.lit(0).cast("bigint").alias("seq")).drop("_b")
    seen = asof(points, pieces, ["_mp", "_level", "_block"], ["_found"], "_mc", "_from", max_rows=max_rows).where("_found IS NOT NULL")
    latest = seen.groupBy("_mp", "_mc", "_ma").agg(F.max("_found").alias("_found")).where("_found.object IS NOT NULL")
    return latest.select("_mp", "_mc", "_ma", F.col("_found.object").alias("_object"),
                         (F.col("_found.place") + F.col("_ma") - F.col("_found.lo")).alias("_place"))


def _blocks(start: Column, end: Column, k: Column) -> Column:
    """The blocks of 16^k addresses inside [start, end) that lie in no larger such block: (_level, _block)."""
    def inside(j: Column) -> tuple[Column, Column]:
        low, bits = F.call_function("shiftright", start, j * 4), j * 4
        up = F.when(F.call_function("shiftleft", low, bits) == start, low).otherwise(low + 1)
        return up, F.call_function("shiftright", end, bits) - 1

    (lo, hi), (up_lo, up_hi) = inside(k), inside(F.least(k + 1, F.lit(TOP)))
    parents = (k < TOP) & (up_lo <= up_hi)
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    blocks = F.when(parents, F.concat(span(lo, up_lo * 16 - 1), span((up_hi + 1) * 16, hi))).otherwise(span(lo, hi))
    return F.transform(blocks, lambda b: F.struct(k.alias("_level"), b.alias("_block")))


def _frame() -> Column:
    c, hit = F.col("_context"), F.col("_hit")
    split = F.instr("_text", "(")
    named = F.when(split > 0, F.expr("substring(_text, 1, instr(_text, '(') - 2)")).otherwise(F.col("_text"))
    where = F.when(split > 0, F.expr("substring(_text, instr(_text, '(') + 1, char_length(_text) - instr(_text, '(') - 1)")).otherwise("")
    unknown = F.lit(UNKNOWN)
    return F.struct(
        F.when(c == SCRIPT, F.lit(0).cast("bigint")).otherwise(F.col("addr")).alias("addr"),
        F.when(c == SCRIPT, F.coalesce(named, unknown)).when(hit, F.col("name")).when(c.isNotNull(), unknown).alias("symbol"),
        F.when(c == SCRIPT, 0).when(hit, F.col("_offset")).when(c == KERNEL, 0).when(c == USER, F.coalesce("_place", F.lit(0))).cast("bigint").alias("offset"),
        (c == KERNEL).alias("kernel"),
        F.when(c == SCRIPT, where).when(c == KERNEL, F.lit(KERNEL_DSO)).when(hit, F.col("dso")).when(c.isNotNull(), unknown).alias("dso"))


def frame_labels(frames: str = "frames") -> Column:
    """Frames as ``symbol+0xoffset`` (just the symbol of script frames and of unknown ones), for folding."""
    def label(f: Column) -> Column:
        plain = (f["symbol"] == UNKNOWN) | (f["addr"] == 0)
        return F.when(f["symbol"].isNull(), F.concat(F.lit("0x"), F.lower(F.hex(f["addr"])))).when(plain, f["symbol"]).otherwise(
            F.concat(f["symbol"], F.lit("+0x"), F.lower(F.hex(f["offset"]))))

    return F.transform(frames, label)
