"""Near-duplicate embeddings by NN-descent on cosine similarity.

Equal vectors of a label are one node. Neighbour lists start from random hyperplane buckets, cut into blocks of bounded
size, and are refined by joining neighbours of neighbours: all that list a node or are listed by it are compared with each
other. A list that is saturated - its last neighbour is still a link - doubles, up to a bound; what a block finds linked is
also tied to one node of the block, so a full list loses no connection. Where a bucket or the neighbours of a hub fill several
blocks, the blocks are compared with each other too, as far as their nodes are still in different components. Links make
components, and inside a component the links are counted exactly, block against block. An audit compares a bounded sample of
nodes with all nodes, averages over nodes with links, apart for nodes of small and of large components, and starts another
round with new buckets while recall is too low. With too few linked nodes to judge by, rounds go on until a link at the
threshold would have shared a bucket in all but one of fifty cases. If recall stays low, it is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components
from .runs import by_key, runs

LINK = 0.98
LIST = 12           # neighbours a list starts with
LONGEST = 48        # neighbours a saturated list may grow to; the rest is counted inside components
TABLES = 4          # hyperplane tables of one round
BUCKET = 64         # nodes a bucket aims at
BLOCK = 128         # nodes compared with each other at most, in expectation
OPEN_BLOCK = 512    # nodes of different components in one block, where blocks are compared with each other
ROUNDS = 12         # rounds after which too low a recall is an error
AUDIT = 512         # nodes of the audit at first, of small and of large components each
AUDIT_MOST = 8192   # nodes of the audit, while too few of them have links
ENOUGH = 64         # audited nodes with links
SMALL = 32          # nodes of a small component at most
RECALL = 0.98       # mean share of a node's links that is found, below which another round follows


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def nodes(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, dims, v (doubles as bytes) of the rows that can have links."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    label = embeddings.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, raw = [], [], []
            for i, v in enumerate(batch.column("embedding")):
                if not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    top = np.abs(x).max()
                    if top > 0:
                        x = x / top if not 1e-100 < top < 1e100 else x       # squares stay finite
                        at.append(i)
                        dims.append(len(x))
                        raw.append((x + 0.0).tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                             ["vec_id", "label", "dims", "v"])

    rows = embeddings.where(F.col("label").isNotNull()).select("vec_id", "label", "embedding")
    return rows.mapInArrow(run, f"vec_id {kind}, label {label}, dims int, v binary").withColumn("node", F.xxhash64("label", "v"))


def _hyperplanes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([dims, seed]).standard_normal((dims, TABLES * 30))


def bucketed(points: DataFrame, seed: int) -> DataFrame:
    """node, part, key, sub, v: each node once per table; the number of hyperplanes follows the size of the label."""
    sizes = points.groupBy("part").agg(F.count("*").alias("size"))
    bits = F.greatest(F.least(F.ceil(F.log2(F.col("size") / BUCKET)).cast("int"), F.lit(30)), F.lit(0))
    rows = points.join(sizes, "part").select("node", "part", "dims", "v", bits.alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits, raw = batch.column("dims").to_numpy(), batch.column("bits").to_numpy(), batch.column("v").to_pylist()
            keys = np.zeros((len(raw), TABLES), np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                side = (_unit([raw[i] for i in own]) @ _hyperplanes(int(d), seed) > 0).reshape(len(own), TABLES, 30)
                used = np.arange(30) < bits[own][:, None, None]
                keys[own] = ((side & used) * (np.int64(1) << np.arange(30))).sum(2)
            table = np.broadcast_to(np.arange(TABLES, dtype=np.int64) << 32, keys.shape)
            take = pa.array(np.repeat(np.arange(len(raw)), TABLES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("node", "part", "v")), pa.array((keys + table).ravel())], ["node", "part", "v", "key"])

    keyed = rows.mapInArrow(run, "node long, part long, v binary, key long")
    blocks = keyed.groupBy("part", "key").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    sub = F.pmod(F.xxhash64("node", "part", "key", F.lit(seed)), F.col("n"))
    return keyed.join(blocks, ["part", "key"]).select("node", "part", "key", sub.alias("sub"), "n", "v")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(linked)).min(1, initial=len(linked)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _nearest(df: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """(u, v, sim, tie): for every row of a group its nearest others in it, ``keep`` of them and all links up to LONGEST.

    Rows with a tie and no sim lead from each node to one node of what links connect it with inside the group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            ids, raw = table.column("node").to_numpy(), table.column("v").to_pylist()
            us, vs, sims, ties = [], [], [], []
            for s, e in bounds:
                if e - s < 2:
                    continue
                x = _unit(raw[s:e])
                sim = x @ x.T
                same = ids[s:e, None] == ids[None, s:e]
                sim[same] = -2
                n = min(keep, e - s - 1)
                order = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n < e - s - 1 else np.argsort(-sim, axis=1)[:, :n]
                if n == keep and (sim >= LINK).sum(1).max() > keep:
                    order = np.argsort(-sim, axis=1)[:, :LONGEST]
                row = np.repeat(np.arange(e - s), order.shape[1])
                col = order.ravel()
                value = sim[row, col]
                rank = np.tile(np.arange(order.shape[1]), e - s)
                good = (value > -1.5) & ((rank < keep) | (value >= LINK))
                us.append(ids[s:e][row[good]])
                vs.append(ids[s:e][col[good]])
                sims.append(value[good])
                ties.append(np.zeros(good.sum(), bool))
                linked = sim >= LINK
                if linked.any():
                    root = _roots(linked)
                    moved = np.flatnonzero(root != np.arange(e - s))
                    us.append(ids[s:e][moved])
                    vs.append(ids[s:e][root[moved]])
                    sims.append(np.zeros(len(moved)))
                    ties.append(np.ones(len(moved), bool))
            if us:
                tie = np.concatenate(ties)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(sims), mask=tie), pa.array(tie)], ["u", "v", "sim", "tie"])

    return by_key(df, keys).mapInArrow(run, "u long, v long, sim double, tie boolean")


def _lists(edges: DataFrame) -> DataFrame:
    """u, near, tied: the best neighbours, LIST of them, or twice as many as long as the last one is a link; and all ties."""
    pairs = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("tie").alias("tie"))
    near = F.slice(F.sort_array(F.collect_list(F.when(F.col("sim").isNotNull(), F.struct("sim", "v"))), asc=False), 1, LONGEST)
    lists = pairs.groupBy("u").agg(near.alias("near"), F.collect_list(F.when(F.col("tie"), F.col("v"))).alias("tied"))
    length = F.lit(LONGEST)
    size = LONGEST // 2
    while size >= LIST:
        length = F.when(F.coalesce(F.get("near", F.lit(size - 1))["sim"], F.lit(-1.0)) >= LINK, length).otherwise(F.lit(size))
        size //= 2
    return lists.select("u", F.slice("near", 1, length).alias("near"), "tied")


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.sim").alias("sim"), F.lit(False).alias("tie"))


def _hubs(lists: DataFrame) -> DataFrame:
    """hub, node, n: those that list the hub or are listed by it, and the number of blocks they fill."""
    one = _edges(lists)
    both = one.select(F.col("u").alias("hub"), F.col("v").alias("node")).unionByName(one.select(F.col("v").alias("hub"), F.col("u").alias("node"))).distinct()
    return both.join(both.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("n")), "hub")


def refine(lists: DataFrame, points: DataFrame, seed: int = 0) -> DataFrame:
    """Neighbour lists after one join of neighbours of neighbours."""
    sub = F.pmod(F.xxhash64("node", "hub", F.lit(seed)), F.col("n"))
    met = _hubs(lists).select("hub", sub.alias("sub"), "node").join(points.select("node", "v"), "node")
    return _lists(_edges(lists).unionByName(_nearest(met, ["hub", "sub"], LIST // 2)))


def _links(lists: DataFrame) -> DataFrame:
    near = _edges(lists).where(F.col("sim") >= LINK).select("u", "v")
    return near.unionByName(lists.select("u", F.explode("tied").alias("v")))


def open_links(groups: DataFrame, points: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v): pairs that connect members of one group (g, node) which are still in different components.

    The members outside the component that has most of the group are compared with all others. Both sides are cut into
    blocks, and a pair of blocks is one unit of work.
    """
    placed = groups.join(known, "node", "left").select("g", "node", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("g", "component").agg(F.count("*").alias("n"))
    size = counts.groupBy("g").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all")).where(F.col("all") > F.col("m.n"))
    size = size.select("g", F.col("m.component").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / OPEN_BLOCK).cast("int").alias("nout"), F.ceil(F.col("m.n") / OPEN_BLOCK).cast("int").alias("nin"))
    open_ = placed.join(size, "g").withColumn("outside", F.col("component") != F.col("main"))
    open_ = open_.withColumn("b", F.pmod(F.xxhash64("node", "g"), F.when(F.col("outside"), F.col("nout")).otherwise(F.col("nin"))).cast("int"))
    # Cells: blocks i <= j of those outside, or block i of those outside with block -1 - j of the others.
    with_out = F.transform(F.sequence(F.lit(0), F.col("nout") - 1), lambda o: F.when(
        F.col("outside"), F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))).otherwise(F.struct(o.alias("i"), (-1 - F.col("b")).alias("j"))))
    with_in = F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), F.col("nin") - 1), lambda o: F.struct(F.col("b").alias("i"), (-1 - o).alias("j"))))
    with_in = with_in.otherwise(F.expr("cast(array() as array<struct<i:int,j:int>>)"))
    cells = open_.select("g", "node", "component", F.explode(F.concat(with_out, with_in)).alias("c")).select("g", "node", "component", "c.i", "c.j")
    keys = ["g", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
            raw = table.column("v").to_pylist()
            us, vs = [], []
            for s, e in bounds:
                x = _unit(raw[s:e])
                linked = (x @ x.T >= LINK) & (comp[s:e, None] != comp[None, s:e])
                if linked.any():
                    root = _roots(linked)
                    moved = np.flatnonzero(root != np.arange(e - s))
                    us += node[s:e][moved].tolist()
                    vs += node[s:e][root[moved]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return by_key(cells.join(points.select("node", "v"), "node"), keys).mapInArrow(run, "u long, v long")


def _audit(placed: DataFrame, chosen: DataFrame, sample: int) -> tuple[int, int, float]:
    """Of ``sample`` of the chosen nodes: how many there are, how many have links, and the mean share of these links inside one component."""
    queries = chosen.orderBy(F.xxhash64(F.col("node"), F.lit(7)), "node").limit(sample).select("node", "part", "component", "v").collect()
    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    for part in {q["part"] for q in queries}:
        at = [i for i, q in enumerate(queries) if q["part"] == part]
        own = [queries[i] for i in at]
        by[part] = np.array(at), np.array([q["node"] for q in own]), np.array([q["component"] for q in own]), _unit([bytes(q["v"]) for q in own])
    total = len(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            node, part, comp = (batch.column(c).to_numpy() for c in ("node", "part", "component"))
            raw = batch.column("v").to_pylist()
            for p, (at, ids, comps, q) in by.items():
                every = np.flatnonzero(part == p)
                for own in (every[k:k + BLOCK] for k in range(0, len(every), BLOCK)):
                    linked = (_unit([raw[k] for k in own]) @ q.T >= LINK) & (node[own, None] != ids[None, :])
                    n[at] += linked.sum(0)
                    found[at] += (linked & (comp[own, None] == comps[None, :])).sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(found[some])], ["q", "n", "found"])

    counted = placed.mapInArrow(run, "q long, n long, found long").groupBy("q").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))
    row = counted.agg(F.count("*").alias("linked"), F.avg(F.col("found") / F.col("n")).alias("share")).first()
    return total, row["linked"], 1.0 if row["share"] is None else row["share"]


def audit(points: DataFrame, known: DataFrame, sample: int = AUDIT) -> tuple[float, bool]:
    """Recall against brute force over bounded samples of nodes, and whether enough of these have links to judge by.

    Recall is the mean, over sampled nodes with links, of the share of the links whose ends are in one component, for
    nodes of small components (or none) and of large ones apart; the lower one counts. Samples grow while few have links.
    """
    sizes = known.groupBy("component").agg(F.count("*").alias("size"))
    of = known.join(sizes, "component").select("node", "component", "size")
    placed = points.select("node", "part", "v").join(of, "node", "left").select("node", "part", "v", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    shares, enough = [], True
    for chosen in (placed.where(F.col("size") <= SMALL), placed.where(F.col("size") > SMALL)):
        n = sample
        while True:
            total, linked, share = _audit(placed, chosen, n)
            if linked >= ENOUGH or total < n or n >= AUDIT_MOST:
                break
            n = min(4 * n, AUDIT_MOST)
        shares.append(share)
        enough = enough and (linked >= ENOUGH or total < n)
    return min(shares), enough


def recall(points: DataFrame, known: DataFrame, sample: int = AUDIT) -> float:
    return audit(points, known, sample)[0]


def _rounds_needed(points: DataFrame) -> int:
    """Rounds after which a link at the threshold has shared a bucket in all but 1 - RECALL of the cases."""
    size = points.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    bits = min(max(math.ceil(math.log2(size / BUCKET)), 0), 30)
    together = (1 - math.acos(LINK) / math.pi) ** bits
    return 1 if together == 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - together) / TABLES)


def link_counts(points: DataFrame, known: DataFrame) -> DataFrame:
    """(node, links): exact numbers of linked vectors of other nodes, inside components; blocks meet block by block."""
    placed = points.join(known, "node").select("node", "component", "copies", "v")
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = placed.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cells = placed.select("component", "node", "copies", "v", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    cells = cells.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "copies", "v")
    keys = ["component", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            node, copies, b, i, j = (table.column(c).to_numpy() for c in ("node", "copies", "b", "i", "j"))
            raw = table.column("v").to_pylist()
            out = np.zeros(len(node), np.int64)
            for s, e in bounds:
                x = _unit(raw[s:e])
                linked = (x @ x.T >= LINK) & (node[s:e, None] != node[None, s:e])
                if i[s] != j[s]:
                    linked &= b[s:e, None] != b[None, s:e]
                out[s:e] = linked @ copies[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(out)], ["node", "links"])

    return by_key(cells, keys).mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows are linked if their labels are equal and not null and their cosine, in double precision, is at least 0.98. Null,
    empty and zero vectors and those with null or non-finite components link with nothing, and vectors of different
    length neither. n_links counts other rows; equal vectors of a label are linked; rows that repeat a vec_id count
    as rows. component_id is the smallest vec_id links lead to.
    """
    valid = stored(nodes(embeddings), "vectors")
    points = stored(valid.groupBy("node").agg(F.first("v").alias("v"), F.first("dims").alias("dims"), F.xxhash64(F.first("label"), F.first("dims")).alias("part"),
                                              F.count("*").alias("copies"), F.min("vec_id").alias("first")), "nodes")
    needed = _rounds_needed(points)
    lists, known = None, None
    for r in range(ROUNDS):
        buckets = bucketed(points, r)
        new = _nearest(buckets, ["part", "key", "sub"], LIST)
        first = stored(_lists(new if lists is None else _edges(lists).unionByName(new)), "lists")
        lists = stored(refine(first, points, r), "lists")
        links = _links(first).unionByName(_links(lists))
        if known is not None:
            links = links.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
        known = stored(components(links), "components")
        hot = buckets.where("n > 1").select(F.xxhash64("part", "key").alias("g"), "node")
        hot = hot.unionByName(_hubs(first).where("n > 1").select(F.xxhash64("hub", F.lit("hub")).alias("g"), "node"))
        more = stored(open_links(hot, points, known), "links")
        if not more.isEmpty():
            known = stored(components(more.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
        share, enough = audit(points, known)
        if share >= RECALL and (enough or r + 1 >= needed):
            break
    else:
        raise RuntimeError(f"near-duplicate embeddings: after {ROUNDS} rounds the audited recall is {share:.4f}, under {RECALL}")
    counts = link_counts(points, known)
    placed = points.select("node", "copies", "first").join(known, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of = placed.join(least, "component").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    rows = valid.select("vec_id", "node").join(of, "node").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    linkable = valid.select(F.col("vec_id").alias("_id")).groupBy("_id").agg(F.count("*").alias("_n"))
    alone = _rest(embeddings, linkable)
    out = rows.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rest(embeddings: DataFrame, linkable: DataFrame) -> DataFrame:
    """The rows that can't have links, alone in their components."""
    every = embeddings.groupBy("vec_id").agg(F.count("*").alias("n"))
    left = every.join(linkable, every["vec_id"].eqNullSafe(linkable["_id"]), "left").select("vec_id", (F.col("n") - F.coalesce("_n", F.lit(0))).cast("int").alias("n"))
    return left.where("n > 0").select(F.explode(F.array_repeat("vec_id", F.col("n"))).alias("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
