"""Near-duplicate embeddings by NN-descent.

Vectors are compared only with equal label and length. Equal vectors are one node with a multiplicity. Then

1. a forest of random hyperplane codes puts nodes into chunks; the best ``LIST`` neighbours found there are the first lists.
   There are as many trees as two vectors at the threshold need to meet in one, given the depth of the codes. Crowded
   chunks are split by further planes, with more trees again;
2. rounds of NN-descent: around each node its neighbours and those that list it are compared with each other, and whoever
   beats the end of a list enters it; until few lists change (Dong et al., 2011). Lists full of links get longer by the round;
3. every comparison also keeps its threshold edges, as a spanning forest of the nodes at hand, so that lists full of the
   nearest copies of a large group do not cut it off from the rest;
4. links are counted among all that can be linked: the component, compared block by block on full vectors. That gives the exact number of links within each component without writing the pairs;
5. an audit compares a hashed sample of nodes, a fresh one each time, with all nodes. Recall is measured per node, before
   the links that the audit found are kept; while it is below ``RECALL``, new trees and rounds follow. Where the last
   attempt stays below, a warning tells the figure and all nodes of a label are compared block by block, which is exact.

Chunks, neighbourhoods and blocks are salted by their counted size, so that no group of copies meets in one task. Vectors are
carried as they come, as float or double, and compared in double precision, scaled first so that no square overflows.

Defined cases: null, zero and empty vectors, vectors with a null or non-finite component and those without a label link
with nothing and stay; equal rows link with each other; an empty table gives no rows; a null vec_id takes part in links but
is never kept and never names a component that has another id; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import connected_components, discard, materialize, salted_join, sorted_groups

THRESHOLD = 0.93
#: TREES: at least; the depth of the codes calls for more.
TREES, LEAF, CHUNK, LIST, SPLITS = 8, 48, 256, 6, 2
#: CHANGED: a round that brings the lists less than this closer, on average, is the last.
ROUNDS, CHANGED, RECALL, TRIES = 3, 0.002, 0.995, 5
#: Members of a block when all of a group are compared with each other.
MEMBERS = 1024
#: Sizes of groups that are broadcast at most.
SIZES = 200_000
#: Parts in which the pairs of one node are ranked.
PARTS = 16
#: The audit's first sample, its largest, and the nodes with few links that it should have: 600 show a loss of one in 200 with 95 %.
AUDIT, AUDIT_MOST, LINKED = 1024, 16384, 600
FOUND = "src bigint, dst bigint, sim double, link boolean"


#: Ends the bytes of a vector of doubles, whose number is then no multiple of four; one of floats has no end mark.
DOUBLE = b"d"


def _matrix(column) -> np.ndarray:
    """Unit rows in double precision of a column of binary vectors of one length and type."""
    raw = column.to_pylist()
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    double = flat.shape[1] % 4 == 1
    x = np.ascontiguousarray(flat[:, :-1] if double else flat).view(np.float64 if double else np.float32).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _width(vec: bytes) -> int:
    return len(vec) // 8 if len(vec) % 4 == 1 else len(vec) // 4


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest with the components of a boolean matrix, depth first: a path through a group of copies, so that none is a hub."""
    free, out = links.any(axis=1), []
    for start in np.flatnonzero(free).tolist():
        if not free[start]:
            continue
        free[start], todo = False, [start]
        while todo:
            open_ = links[todo[-1]] & free
            other = int(open_.argmax())
            if open_[other]:
                free[other] = False
                out.append((todo[-1], other))
                todo.append(other)
            else:
                todo.pop()
    return out


def _compare(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, keep: int, threshold: float) -> tuple[list, list, list, list]:
    """Rows of FOUND: pairs of a node and one of its ``keep`` best others, if the cosine exceeds its ``floor``, and the threshold's forest."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    src, dst, sim, link = [], [], [], []
    for a, b in _spanning(sims >= threshold):
        src.append(ids[a]), dst.append(ids[b]), sim.append(sims[a, b]), link.append(True)
    k = min(keep, len(ids) - 1)
    if k > 0:
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        values = np.take_along_axis(sims, best, axis=1)
        rows, cols = np.nonzero(values > floor[:, None])
        # a pair counts for both its ends, so one that both chose is given once
        a, b = np.minimum(rows, best[rows, cols]), np.maximum(rows, best[rows, cols])
        a, b = np.divmod(np.unique(a * len(ids) + b), len(ids))
        src += ids[a].tolist()
        dst += ids[b].tolist()
        sim += sims[a, b].tolist()
        link += [False] * len(a)
    return src, dst, sim, link


def _found(rows: list[tuple[list, list, list, list]]) -> pa.RecordBatch:
    src, dst, sim, link = ([x for part in rows for x in part[k]] for k in range(4))
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64()), pa.array(link, pa.bool_())], names=["src", "dst", "sim", "link"])


def _compared(rows: DataFrame, keep: int, threshold: float) -> DataFrame:
    """FOUND of each (k1, k2)-group of ``rows`` (k1, k2, nid, floor, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for group in sorted_groups(batches, 2):
            if group.num_rows < 2:
                continue
            ids, at = np.unique(group.column(2).to_numpy(), return_index=True)
            x = _matrix(group.column(4).take(pa.array(at)))
            out.append(_compare(ids, x, group.column(3).to_numpy()[at], keep, threshold))
            n += len(out[-1][0])
            if n > 20_000:
                yield _found(out)
                out, n = [], 0
        if out:
            yield _found(out)

    return rows.select("k1", "k2", "nid", "floor", "vec").repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, FOUND)


def _trees(depth: np.ndarray, threshold: float) -> np.ndarray:
    """How many codes of ``depth`` signs a pair at the threshold needs to share one with probability ``RECALL``."""
    same = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** np.asarray(depth, float)
    return np.ceil(np.log1p(-RECALL) / np.log(np.maximum(1 - same, 1e-9))).astype(np.int64)


def _split(groups: DataFrame, sizes: DataFrame, trees: int, leaf: int, threshold: float) -> DataFrame:
    """Splits the groups (k1, tree, depth, nid, vec) that are in ``sizes`` (of, n) by further hyperplanes.

    A group of n rows gets log2(n / leaf) more signs, and its rows as many trees more as the greater depth calls for, each
    with planes of its own; ``trees`` at least at the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                tree, depth, n = (part.column(k).to_numpy() for k in (1, 2, 5))
                dims = np.array([_width(v) for v in part.column(4).to_pylist()])
                bits = np.ceil(np.log2(np.maximum(1.0, n / leaf))).astype(int).clip(0, 32)
                more = np.where(depth == 0, np.maximum(trees, _trees(bits, threshold)), -(-_trees(depth + bits, threshold) // np.maximum(trees, _trees(depth, threshold))))
                for d, t in sorted(set(zip(dims.tolist(), tree.tolist(), strict=True))):
                    at = np.flatnonzero((dims == d) & (tree == t))
                    x = _matrix(part.column(4).take(pa.array(at)))
                    for r in range(int(more[at].max())):
                        own = np.flatnonzero(more[at] > r)
                        name = t * 1000 + r + 1
                        planes = np.random.default_rng([d, 7, name]).standard_normal((int(bits[at].max()), d))
                        used = (x[own] @ planes.T > 0) & (np.arange(len(planes)) < bits[at[own], None])
                        codes = (used * (1 << np.arange(len(planes), dtype=np.int64))).sum(axis=1)
                        picked = part.take(pa.array(at[own]))
                        columns = [picked.column(0), pa.array(np.full(len(own), name)), pa.array((depth + bits)[at[own]]), picked.column(3), picked.column(4), pa.array(codes)]
                        yield pa.RecordBatch.from_arrays(columns, names=["k1", "tree", "depth", "nid", "vec", "code"])

    sized = _sized(groups, sizes).where("n is not null").select("k1", "tree", "depth", "nid", "vec", "n")
    out = sized.mapInArrow(run, "k1 bigint, tree bigint, depth bigint, nid bigint, vec binary, code bigint")
    return out.select(F.xxhash64("code", "tree", "k1").alias("k1"), "tree", "depth", "nid", "vec")


def _codes(nodes: DataFrame, attempt: int, trees: int, leaf: int, threshold: float) -> DataFrame:
    """(k1, tree, depth, nid, vec): groups of nodes with equal signs. Groups above ``CHUNK`` are split ``SPLITS`` times more."""
    start = nodes.select(F.col("part").alias("k1"), F.lit(attempt + 1).cast("long").alias("tree"), F.lit(0).cast("long").alias("depth"), "nid", "vec")
    out = materialize(_split(start, _sizes(start), trees, leaf, threshold), f"codes{attempt}")
    for level in range(SPLITS):
        large = materialize(_sizes(out).where(F.col("n") > CHUNK), f"large{attempt}-{level}")
        if not large.take(1):
            break
        rest = _sized(out, large).where("n is null").select(*out.columns)
        split = materialize(rest.unionByName(_split(out, large, trees, leaf, threshold)), f"codes{attempt}-{level}")
        discard(out)
        out = split
    return out


def _sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("k1").alias("of")).agg(F.count("*").alias("n"))


def _sized(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """``groups`` (k1, nid, ..), a written table, with the n of their groups in ``sizes`` (of, n); null where they have none.

    Up to ``SIZES`` sizes (they are counted) are broadcast, so that no vector is shuffled; beyond, large groups are dealt out.
    """
    if len(sizes.select(F.lit(1)).take(SIZES + 1)) <= SIZES:
        return groups.join(F.broadcast(sizes), F.col("k1") == F.col("of"), "left").drop("of")
    return salted_join(groups, sizes.withColumnRenamed("of", "k1"), "k1", "nid", how="left")


def _salted(rows: DataFrame, size: int, tag: str = "crowds") -> DataFrame:
    """Adds k2, which splits each k1-group of ``rows``, a written table, into parts of about ``size``."""
    counts = materialize(_sizes(rows).where(F.col("n") > size), tag)
    return _sized(rows, counts).withColumn("k2", F.coalesce(F.pmod(F.xxhash64("nid", "k1"), F.ceil(F.col("n") / size)), F.lit(0))).drop("n")


def _lists(found: DataFrame, size: int, grown: int, threshold: float) -> DataFrame:
    """(src, list): the ``size`` best of each node, as structs of sim and dst; distances of both ends count.

    A list that is full of links is longer: it has its further links too, up to ``grown`` entries.
    """
    both = found.select("src", "dst", "sim").unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    # the best of each of a node's parts, then of those: a node that many others list meets in no task as a whole
    part = F.pmod(F.xxhash64("dst"), F.lit(PARTS)).alias("part")
    pairs = both.select("src", "dst", "sim", part).repartition("src", "part").groupBy("src", "part", "dst").agg(F.max("sim").alias("sim"))
    top = lambda entries: F.slice(F.sort_array(entries, asc=False), 1, grown)
    best = pairs.groupBy("src", "part").agg(top(F.collect_list(F.struct("sim", "dst"))).alias("list"))
    best = best.groupBy("src").agg(top(F.flatten(F.collect_list("list"))).alias("list"))
    return best.select("src", F.filter("list", lambda e, i: (i < size) | (e["sim"] >= threshold)).alias("list"))


def _round(nodes: DataFrame, lists: DataFrame, size: int, threshold: float, tag: str) -> DataFrame:
    """FOUND of the comparisons around every node."""
    edges = lists.select(F.col("src").alias("k1"), F.explode("list").alias("e")).select("k1", F.col("e.dst").alias("nid"))
    around = edges.unionByName(edges.select(F.col("nid").alias("k1"), F.col("k1").alias("nid")))
    around = materialize(around.unionByName(lists.select(F.col("src").alias("k1"), F.col("src").alias("nid"))).distinct(), f"around{tag}")
    floors = lists.select(F.col("src").alias("of"), F.when(F.size("list") >= size, F.element_at("list", -1)["sim"]).otherwise(-2.0).alias("floor"))
    vectors = nodes.select(F.col("nid").alias("id"), "vec").join(floors, F.col("id") == F.col("of"), "left").select("id", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    # groups are split before vectors join them
    rows = _salted(around, 2 * CHUNK, f"crowds{tag}").join(vectors, F.col("nid") == F.col("id"))
    found = materialize(_compared(rows, size, threshold), f"round{tag}")
    discard(around)
    return found


def _audited(placed: DataFrame, sample: int, salt: int, threshold: float) -> DataFrame:
    """(src, total, hit, dst): the links of a sample of at most ``sample`` nodes, which is broadcast, found by comparing all nodes.

    ``total`` counts a node's links in a batch and ``hit`` those within its component; rows with a dst are links to other
    components, one for each component.
    """
    some = placed.withColumn("x", F.xxhash64("nid", F.lit(salt))).orderBy("x", "nid").limit(sample).collect()
    by: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}
    for r in some:
        by.setdefault((r["part"], len(r["vec"])), []).append((r["nid"], r["component"], bytes(r["vec"])))
    mats = {k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), _matrix(pa.array([r[2] for r in v], pa.binary()))) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, total, hit, dst = [], [], [], []
            ids, parts, components = (batch.column(k).to_numpy() for k in range(3))
            for (part, _), (names, owners, x) in mats.items():
                every, step = np.flatnonzero(parts == part), max(64, 4_000_000 // len(names))
                for i in range(0, len(every), step):
                    at = every[i : i + step]
                    near = (x @ _matrix(batch.column(3).take(pa.array(at))).T >= threshold) & (names[:, None] != ids[at][None, :])
                    same = near & (owners[:, None] == components[at][None, :])
                    some = np.flatnonzero(near.any(axis=1))
                    src += names[some].tolist()
                    total += near[some].sum(axis=1).tolist()
                    hit += same[some].sum(axis=1).tolist()
                    dst += [None] * len(some)
                    rows, cols = np.nonzero(near & ~same)
                    _, first = np.unique(np.stack([rows, components[at[cols]]]), axis=1, return_index=True)
                    src += names[rows[first]].tolist()
                    total += [0] * len(first)
                    hit += [0] * len(first)
                    dst += ids[at[cols[first]]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (src, total, hit, dst)], names=["src", "total", "hit", "dst"])

    return placed.select("nid", "part", "component", "vec").mapInArrow(run, "src bigint, total bigint, hit bigint, dst bigint")


def _audit(nodes: DataFrame, parts: DataFrame, n: int, attempt: int, size: int, threshold: float) -> tuple[float, DataFrame]:
    """Recall of ``parts`` (id, component), and the links (src, dst) to other components that the audit found.

    Each attempt draws other nodes. Recall is the mean over nodes of the share of a node's links that are in its component,
    over all nodes with links or over those with at most ``size`` of them, whichever is less: large groups can't hide what
    pairs lose. The sample grows until it has ``LINKED`` nodes of the second kind, or all nodes, or ``AUDIT_MOST``.
    """
    known = nodes.join(parts, F.col("nid") == F.col("id"), "left")
    placed = materialize(known.select("nid", "part", F.coalesce("component", "nid").alias("component"), "vec"), f"placed{attempt}")
    sample = AUDIT
    while True:
        found = materialize(_audited(placed, sample, attempt + 3, threshold), f"audit{attempt}-{sample}")
        by = found.groupBy("src").agg(F.sum("total").alias("total"), (F.sum("hit") / F.sum("total")).alias("share"))
        few = F.when(F.col("total") <= size, F.col("share"))
        every, small, linked = by.agg(F.coalesce(F.avg("share"), F.lit(1.0)), F.coalesce(F.avg(few), F.lit(1.0)), F.count(few)).first()
        if linked >= LINKED or sample >= min(n, AUDIT_MOST):
            discard(placed)
            return min(every, small), found.where("dst is not null").select("src", "dst")
        discard(found)
        sample *= 4


def _exact(nodes: DataFrame, parts: DataFrame, threshold: float, block: int = MEMBERS) -> DataFrame:
    """(src, dst): a forest of all links across components, each label's nodes compared block by block."""
    placed = nodes.join(parts, F.col("nid") == F.col("id"), "left").select("part", "nid", F.coalesce("component", "nid").alias("component"), "vec")
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = salted_join(placed, sizes, "part", "nid").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "nid", "component", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            ids, component, x = group.column(3).to_numpy(), group.column(4).to_numpy(), _matrix(group.column(5))
            found = _spanning((x @ x.T >= threshold) & (component[:, None] != component[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return rows.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(run, "src bigint, dst bigint")


def _counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(nid, links): for ``members`` (component, nid, vec, copies) the number of vectors linked to each, itself included.

    A component's members are dealt into blocks, and every ordered pair of blocks is one group: rows go to as many groups
    as the component has blocks.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = salted_join(members, sizes, "component", "nid").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    left = dealt.select("component", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.lit(True).alias("asks"), "nid", "vec", "copies")
    right = dealt.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.col("own").alias("b"), F.lit(False).alias("asks"), "nid", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links = [], []
        for group in sorted_groups(batches, 3):
            asks = group.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            x = _matrix(group.column(5))
            copies = group.column(6).to_numpy()[~asks]
            near = x[asks] @ x[~asks].T >= threshold
            same = group.column(4).to_numpy()[asks][:, None] == group.column(4).to_numpy()[~asks][None, :]
            ids += group.column(4).to_numpy()[asks].tolist()
            links += ((near | same) @ copies).tolist()
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["nid", "links"])
                ids, links = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["nid", "links"])

    both = left.unionByName(right).repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    return both.mapInArrow(run, "nid bigint, links bigint").groupBy("nid").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, size: int = LIST, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select("vec_id", F.col("label"), F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda v: v + F.lit(0.0).cast(kind)).alias("e"))
    good = F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    rows = materialize(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    distinct = rows.where("good").groupBy("label", "e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))

    dtype, mark = (np.float32, b"") if kind == "float" else (np.float64, DOUBLE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.asarray(v.values.to_numpy(zero_copy_only=False), dtype).tobytes() + mark for v in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(vec, pa.binary())], names=["nid", "part", "vec_id", "copies", "vec"])

    part = F.xxhash64(F.col("label").cast("string"), F.size("e"))
    packed = materialize(distinct.select(F.monotonically_increasing_id().alias("nid"), part.alias("part"), "vec_id", "copies", "label", "e"), "nodes")
    nodes = materialize(packed.select("nid", "part", "vec_id", "copies", "e").mapInArrow(pack, "nid bigint, part bigint, vec_id bigint, copies bigint, vec binary"), "packed")
    n = nodes.count()
    lists, links = None, None
    for attempt in range(TRIES):
        codes = _codes(nodes, attempt, trees, leaf, threshold)
        coded = codes.withColumn("floor", F.lit(-2.0).cast("double"))
        found = materialize(_compared(_salted(coded, CHUNK, f"crowds{attempt}"), size, threshold), f"forest{attempt}")
        discard(codes)
        links = _joined(links, found, f"links{attempt}")
        lists = _merged(lists, found, size, 2 * size, threshold, f"lists{attempt}")
        for step in range(rounds):
            found = _round(nodes, lists, size, threshold, f"{attempt}-{step}")
            before = _closeness(lists, size)
            links, lists = _joined(links, found, f"links{attempt}-{step}"), _merged(lists, found, size, size << (step + 2), threshold, f"lists{attempt}-{step}")
            if _closeness(lists, size) - before < CHANGED * n * size:
                break
        parts = _parts(links, f"parts{attempt}")
        reached, missed = _audit(nodes, parts, n, attempt, size, threshold)
        if missed.take(1):
            links = materialize(links.unionByName(missed), f"audited{attempt}")
            parts = _parts(links, f"mended{attempt}")
        if reached >= recall:
            break
    else:
        warnings.warn(f"near_duplicates: the last audit's recall is {reached:.4f}, below {recall}: all vectors of a label are compared", stacklevel=2)
        links = materialize(links.unionByName(_exact(nodes, parts, threshold)), "exact")
        parts = _parts(links, "whole")
    members = nodes.join(parts, F.col("nid") == F.col("id")).select("component", "nid", "vec_id", "vec", "copies")
    counted = _counts(members, threshold, MEMBERS)
    names = members.groupBy(F.col("component").alias("of")).agg(F.min("vec_id").alias("name"))
    linked = members.select("nid", "component").join(names, F.col("component") == F.col("of")).select(F.col("nid").alias("m"), "name").join(counted, F.col("m") == F.col("nid")).select("m", "name", "links")
    known = packed.join(linked, F.col("nid") == F.col("m"), "left").select(F.col("label").alias("l"), F.col("e").alias("f"), F.coalesce("name", "vec_id").alias("name"), (F.coalesce("links", "copies") - 1).alias("links"))
    out = rows.join(known, F.col("good") & (F.col("label") == F.col("l")) & (F.col("e") == F.col("f")), "left")
    component = F.coalesce("name", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _parts(links: DataFrame, tag: str) -> DataFrame:
    return materialize(connected_components(links.select(F.col("src").alias("a"), F.col("dst").alias("b"))), tag)


def _closeness(lists: DataFrame, size: int) -> float:
    """Sum of 1 + cosine over the ``size`` best of all lists; it only grows from round to round."""
    return lists.agg(F.coalesce(F.sum(F.aggregate(F.slice("list", 1, size), F.lit(0.0), lambda s, e: s + 1 + e["sim"])), F.lit(0.0))).first()[0]


def _joined(links: DataFrame | None, found: DataFrame, tag: str) -> DataFrame:
    new = found.where("link").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    out = materialize((new if links is None else links.unionByName(new)).distinct(), tag)
    if links is not None:
        discard(links)
    return out


def _merged(lists: DataFrame | None, found: DataFrame, size: int, grown: int, threshold: float, tag: str) -> DataFrame:
    old = None if lists is None else lists.select("src", F.explode("list").alias("e")).select("src", "e.dst", "e.sim")
    out = materialize(_lists(found if old is None else found.select("src", "dst", "sim").unionByName(old), size, grown, threshold), tag)
    discard(found)
    if lists is not None:
        discard(lists)
    return out
