"""Near-duplicate documents by MinHash: universal hash minima, banding, signature and exact verification, components.

Documents with equal shingle sets are one class from the start. Classes that share a band are a bucket. A bucket is not
expanded into pairs: first every class is compared with the smallest class of one of its buckets, then of all its
buckets, skipping what is already in one component. Only classes of a bucket that are still in different components after
that are compared with each other, in blocks of bounded size by their signatures, and only pairs whose signatures agree
enough get an exact check. So a large group of copies costs work in proportion to its size, and no link between different
components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import stored
from .graph import components
from .runs import by_key, runs

BANDS, ROWS = 32, 4     # at a similarity of 0.8 all bands differ in 5 of 10^8 cases
HASHES = BANDS * ROWS
SLICE = 4096            # shingles hashed together
BLOCK = 512             # members of a bucket in one block, in expectation
SLACK = 4.5             # standard deviations below the threshold down to which signatures may agree


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 [sets, HASHES]: the minima of every hash function over each set; empty sets get the largest value."""
    a, b = words.hash_functions(HASHES, 9)
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        for k in range(0, len(s), SLICE):
            minima = np.min(s[k:k + SLICE, None] * a + b, axis=0) >> np.uint64(32)
            out[i] = np.minimum(out[i], minima.astype(np.uint32))
    return out


def node_of(s: np.ndarray) -> int:
    """64-bit hash of a set. Among n different sets two share a hash with probability n^2 / 2^65."""
    total = np.uint64(words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return int(words.mix(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def sign(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), node (hash of the set, null if empty), bands of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(s) for s in words.shingles(batch.column("text"), k)]
            keys = band_keys(signatures(sets)) if sets else np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel()))], ["doc_id", "th", "n", "node", "bands"])

    return documents.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(words.tidy(run), f"doc_id {kind}, th long, n long, node long, bands array<long>")


def shingle_sets(documents: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, signature, shingles) of the wanted (doc_id, node) rows, from the texts."""
    rows = documents.select("doc_id", "text").join(wanted.select(F.col("doc_id").alias("id"), "node"), F.col("doc_id").eqNullSafe(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(s) for s in words.shingles(batch.column("text"), k)]
            own = [i for i, (s, node) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if len(s) and node_of(s) == node]
            signature = signatures([sets[i] for i in own])
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(pa.array(own, pa.int64())), pa.array([len(sets[i]) for i in own], pa.int64()),
                pa.array([s.tobytes() for s in signature], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())],
                ["node", "n", "signature", "shingles"])

    return rows.select("node", "text").mapInArrow(words.tidy(run), "node long, n long, signature binary, shingles binary")


def least_agreement(threshold: float) -> float:
    return threshold - SLACK * np.sqrt(threshold * (1 - threshold) / HASHES)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs that are similar: first by signature, then exactly, 100 * both >= percent * either."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "signature", "shingles")))

    joined = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    joined = joined.where(F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent)
    least = least_agreement(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for us, vs, uset, vset in zip(*(batch.column(c) for c in ("u_signature", "v_signature", "u_shingles", "v_shingles")), strict=True):
                same = (np.frombuffer(us.as_buffer(), np.uint32) == np.frombuffer(vs.as_buffer(), np.uint32)).mean()
                ok = False
                if same >= least:
                    a, b = np.frombuffer(uset.as_buffer(), np.uint64), np.frombuffer(vset.as_buffer(), np.uint64)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok = 100 * both >= percent * (len(a) + len(b) - both)
                keep.append(ok)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    return joined.mapInArrow(words.tidy(run), "u long, v long")


def _placed(members: DataFrame, known: DataFrame) -> DataFrame:
    """(key, band, node, rep, component, rep_component); nodes without a link are their own component."""
    by = known.select(F.col("node").alias("rep"), F.col("component").alias("rc"))
    return (members.join(known, "node", "left").join(by, "rep", "left")
            .select("key", "band", "node", "rep", F.coalesce("component", "node").alias("component"), F.coalesce("rc", "rep").alias("rep_component")))


def open_links(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): similar members of one bucket in different components, neither its smallest; enough to join the components.

    In a bucket, those outside the component of its smallest member are compared with all others; both sides are cut
    into blocks of about BLOCK members, and a pair of blocks is one unit of work. Pairs with the smallest member have been
    compared before, and a pair that shares several buckets is compared in that of the first band.
    """
    placed = _placed(members, known).where("node <> rep")
    outside = F.col("component") != F.col("rep_component")
    size = placed.groupBy("key").agg(F.count(F.when(outside, 1)).alias("out"), F.count(F.when(~outside, 1)).alias("in"))
    size = size.where("out > 1 or (out > 0 and in > 0)").select("key", F.ceil(F.col("out") / BLOCK).cast("int").alias("nout"), F.ceil(F.col("in") / BLOCK).cast("int").alias("nin"))
    open_ = placed.join(size, "key").withColumn("outside", outside)
    block = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("nout")).otherwise(F.greatest("nin", F.lit(1)))).cast("int")
    open_ = open_.withColumn("block", block)
    # Cells: blocks i <= j of those outside, or block i of those outside with block -1 - j of the others.
    with_out = F.transform(F.sequence(F.lit(0), F.col("nout") - 1), lambda o: F.when(
        F.col("outside"), F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))).otherwise(
        F.struct(o.alias("i"), (-1 - F.col("block")).alias("j"))))
    with_in = F.when(F.col("outside") & (F.col("nin") > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.col("nin") - 1, F.lit(0))), lambda o: F.struct(
        F.col("block").alias("i"), (-1 - o).alias("j")))).otherwise(F.expr("cast(array() as array<struct<i:int,j:int>>)"))
    cells = open_.select("key", "band", "node", "component", "outside", F.explode(F.concat(with_out, with_in)).alias("c"))
    cells = cells.select("key", "band", "node", "component", F.col("outside").cast("int").alias("outside"), "c.i", "c.j")
    cells = by_key(cells.join(sets, "node"), ["key", "i", "j"])
    least = least_agreement(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["key", "i", "j"]):
            node, comp, n, out, j, band = (table.column(c).to_numpy() for c in ("node", "component", "n", "outside", "j", "band"))
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            shingles = table.column("shingles")
            us, vs = [], []
            for s, e in bounds:
                comp_now = comp[s:e].copy()
                for x in range(s, e):
                    if j[s] < 0:
                        near = s + np.flatnonzero(out[s:e] == 0) if out[x] else ()
                    else:
                        near = np.arange(x + 1, e)
                    if not len(near):
                        continue
                    near = near[(comp_now[near - s] != comp_now[x - s]) & (np.minimum(n[near], n[x]) * 100 >= np.maximum(n[near], n[x]) * percent)]
                    equal = signature[near] == signature[x]
                    first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1)
                    for y in near[(equal.mean(1) >= least) & (first == band[s])].tolist():
                        if comp_now[x - s] == comp_now[y - s]:
                            continue
                        a, b = (np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in (x, y))
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if 100 * both >= percent * (len(a) + len(b) - both):
                            us.append(int(node[x]))
                            vs.append(int(node[y]))
                            comp_now[comp_now == comp_now[y - s]] = comp_now[x - s]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return cells.mapInArrow(words.tidy(run), "u long, v long")


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    u = known.select(F.col("node").alias("u"), F.col("component").alias("uc"))
    v = known.select(F.col("node").alias("v"), F.col("component").alias("vc"))
    return (pairs.join(u, "u", "left").join(v, "v", "left")
            .where(F.coalesce("uc", "u") != F.coalesce("vc", "v")).select(*pairs.columns))


def link_components(documents: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all classes that are linked with another one."""
    bands = signed.where("n > 0").select("node", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep <> last").select("key", "rep")
    members = stored(bands.join(buckets, "key").select("key", "band", "node", "rep").distinct(), "buckets")
    first = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = stored(shingle_sets(documents, first.join(members.select("node").distinct(), "node"), k), "sets")

    stars = members.where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    nearest = stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = stored(verify(nearest, sets, percent), "links")
    known = components(links)
    rest = stored(_apart(stars.distinct(), known).join(nearest, ["u", "v"], "left_anti"), "pairs")
    links = links.unionByName(stored(verify(rest, sets, percent), "links"))
    known = stored(components(links), "components")

    more = stored(open_links(members, known, sets, percent), "links")
    return known if more.isEmpty() else components(links.unionByName(more))


def decisions(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept for every row; see :func:`near_duplicates`."""
    signed = stored(sign(documents, k), "signed")
    known = link_components(documents, signed, k, percent)
    first = signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = first.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of = placed.join(least, "component").select("node", "component_id")
    rows = signed.select("doc_id", "th", "n", "node").join(of, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows whose shingle sets have a Jaccard similarity of at least ``percent`` / 100 are linked; component_id is the smallest
    doc_id that links lead to, the row's own included, and kept says whether it is the row's own. Null texts and texts
    without words link with nothing. Rows that repeat a doc_id are compared like any others. Ids that are null are no
    component's smallest unless it has no other.
    """
    return decisions(documents, k, percent).drop("th")


def distinct_documents(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, one of each group, with all their columns; of rows repeated in full one stays.

    In a component without any id, only exact copies are told from each other, so all its different texts stay.
    """
    kept = decisions(documents, k, percent).where("kept").select(F.col("doc_id").alias("_llm_id"), F.col("th").alias("_llm_th")).distinct()
    rows = documents.withColumn("_llm_text", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_llm_id"]) & (rows["_llm_text"] == kept["_llm_th"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_llm_text"]).drop("_llm_text")
