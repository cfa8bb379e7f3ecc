"""MinHash near-duplicates with circulant signatures, banding and exact verification.

Circulant MinHash (Li and Li, 2022) needs two permutations: ``sigma`` scatters the shingles over a universe of
2**20 places, ``pi`` ranks the places, and coordinate k of the signature is the least rank after a circular shift of ``pi``
by k. As row ``x`` of all shifted permutations is the slice of ``pi`` that starts at ``x``, a whole signature is a minimum
over slices.

1. One pass over the texts gives signature, band hashes, set size and a 128-bit digest of the set. Documents with the same
   set form a class; its smallest doc_id stands for it from here on. (Arrow batches, numpy.)
2. Within each band bucket every class is paired with the bucket's smallest one, a star instead of all pairs. Pairs whose
   sizes or signatures rule out the threshold go; the others are verified on their full sets.
3. Components of the links found. In buckets that still hold several components, members outside the largest are paired with
   a drawn member of it, another one in each bucket (``STEPS`` times).
4. All pairs that are still open, those across components of a bucket, are decided without writing them: signatures are
   compared block by block, which leaves groups of documents that may link; within a group full sets are compared block by
   block, as a product of incidence matrices. Either step writes a spanning forest of what it found, fewer rows than members.
   So no candidate pair is left undecided except within a component, where it doesn't matter.
5. Components of all links.

With 32 bands of 4 a pair of Jaccard similarity 0.8 is missed with a probability below 1e-7; the signature bound lies five
standard deviations below the threshold. Sets are compared as 64-bit hashes.

Defined cases: null and empty texts, and those of white space only, have empty sets and link with nothing; a text of fewer
words than a shingle has one shingle; rows of a repeated doc_id count as one document for the links and each keeps its own
row; a null doc_id neither links nor is kept, its component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import connected_components, discard, materialize, salted_join, sorted_groups
from tessella.llm.shingles import mix, shingle_sets

WIDTH, PERCENT = 5, 80
COORDINATES, ROWS = 128, 4
UNIVERSE_BITS = 20
STEPS = 1  # of those that pair open members with drawn ones
BLOCK, BLOCK_SHINGLES = 512, 1 << 18  # members of a block that are compared by signature, shingles of one compared by sets
SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig binary"


class Circulant:
    """Signatures of sets of 64-bit hashes."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 1 << UNIVERSE_BITS
        self.sigma = rng.permutation(n).astype(np.int32)
        pi = rng.permutation(n).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        places = self.sigma[(hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
        out = None
        for i in range(0, len(places), 2048):
            least = self.slices[places[i : i + 2048]].min(axis=0)
            out = least if out is None else np.minimum(out, least)
        return out


def signed(docs: DataFrame, width: int, coordinates: int, rows: int) -> DataFrame:
    """SIGNED for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant, schema = Circulant(coordinates), None
        bands = coordinates // rows
        weights = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            n, d1, d2, keys, sigs = [], [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                if not len(s):
                    d1.append(0)
                    d2.append(0)
                    keys.append(None)
                    sigs.append(None)
                    continue
                sig = circulant(s)
                d1.append(int((mix(s).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)))
                mixed = (sig.astype(np.uint64) + np.uint64(1)) * weights
                keys.append(mix(mixed.reshape(bands, rows).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64))
                sigs.append((mix(sig.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNED)


def _both(pairs: DataFrame, values: DataFrame, of: str, value: str) -> DataFrame:
    """(a, b, x, y): the ``value`` of both ends of written ``pairs`` (a, b). The centre of a large star is a hot key."""
    one = salted_join(pairs, values.select(F.col(of).alias("a"), F.col(value).alias("x")), "a", "b", pairs)
    return salted_join(one, values.select(F.col(of).alias("b"), F.col(value).alias("y")), "b", "a", pairs).select("a", "b", "x", "y")


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures agree in at least ``least`` of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least))

    return _both(pairs, classes.select("rep", "sig"), "rep", "sig").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_limit: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, left = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if left is None or a != last:
                    last, left = a, next(shingle_sets(pa.array([x.as_py()]), width))
                right = next(shingle_sets(pa.array([y.as_py()]), width))
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ids = pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct()
    if ids.limit(id_limit + 1).count() <= id_limit:
        ids = F.broadcast(ids)  # so only texts that are needed get shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, F.col("id") == F.col("of"), "left_semi")
    return _both(pairs, texts, "id", "text").mapInArrow(run, "a bigint, b bigint").distinct()


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the graph between rows and columns of a boolean matrix."""
    out, rows_left, columns_left = [], np.ones(links.shape[0], bool), np.ones(links.shape[1], bool)
    for start in np.flatnonzero(links.any(axis=1)):
        if not rows_left[start]:
            continue
        rows_left[start], todo = False, [(int(start), True)]
        while todo:
            at, is_row = todo.pop()
            found = np.flatnonzero(links[at] & columns_left if is_row else links[:, at] & rows_left)
            (columns_left if is_row else rows_left)[found] = False
            out += [(at, int(f)) if is_row else (int(f), at) for f in found]
            todo += [(int(f), not is_row) for f in found]
    return out


def _dealt(left: DataFrame, right: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of both sides (g, own, ..) for every pair of a left and a right block of their group; ``blocks`` is (g, lefts, rights)."""
    sizes = blocks.withColumnRenamed("g", "of")
    one = left.join(sizes, F.col("g") == F.col("of")).select(*left.columns, F.lit(True).alias("asks"), F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    two = right.join(sizes, F.col("g") == F.col("of")).select(*right.columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), F.col("rights")).cast("int").alias("j"))
    both = one.unionByName(two)
    return both.select("g", "i", "j", *[c for c in both.columns if c not in ("g", "i", "j")]).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def _pairs_of(forest: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    flat = [(min(p), max(p)) for part in forest for p in part]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.int64())], names=["a", "b"])


def _blocked(rows: DataFrame, decide) -> DataFrame:
    """(a, b): forests of what ``decide`` finds between the two sides of each group of dealt ``rows`` (.., rep, part, asks, ..)."""
    at = {c: k for k, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for group in sorted_groups(batches, 3):
            asks = group.column(at["asks"]).to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            part, rep = (group.column(at[c]).to_numpy() for c in ("part", "rep"))
            apart = part[asks][:, None] != part[~asks][None, :]
            if apart.any():
                left, right = rep[asks].tolist(), rep[~asks].tolist()
                out.append([(left[r], right[c]) for r, c in _forest(decide(group, asks, at) & apart)])
                n += len(out[-1])
            if n > 50_000:
                yield _pairs_of(out)
                out, n = [], 0
        yield _pairs_of(out)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _alike_forest(mixed: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b): a forest over the members of open buckets ``mixed`` whose signatures agree across components."""
    sig = classes.select(F.col("rep").alias("of"), "sig")
    rows = mixed.join(sig, F.col("rep") == F.col("of")).select(F.col("key").alias("g"), "rep", "n", "part", "sig", (F.col("part") != F.col("largest")).alias("other"))
    blocks = rows.groupBy("g").agg(F.ceil(F.sum(F.col("other").cast("int")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"))

    def decide(group: pa.Table, asks: np.ndarray, at: dict[str, int]) -> np.ndarray:
        raw = group.column(at["sig"]).to_pylist()
        sigs = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        n = group.column(at["n"]).to_numpy()
        near = np.stack([(sigs[~asks] == s).mean(axis=1) >= least for s in sigs[asks]])
        return near & (100 * np.minimum.outer(n[asks], n[~asks]) >= percent * np.maximum.outer(n[asks], n[~asks]))

    return _blocked(_dealt(rows.where("other").drop("other"), rows.drop("other"), blocks), decide)


def _linked_forest(groups: DataFrame, mixed: DataFrame, docs: DataFrame, width: int, percent: int, id_limit: int) -> DataFrame:
    """(a, b): a forest of the links across components within ``groups`` (id, component), on full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    ids = groups.select(F.col("id").alias("of"))
    if ids.limit(id_limit + 1).count() <= id_limit:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, F.col("id") == F.col("of"), "left_semi")
    full = materialize(texts.mapInArrow(sets, "id bigint, shingles binary"), "sets")
    members = mixed.select("rep", "n", "part").distinct().join(groups, F.col("rep") == F.col("id")).select(F.col("component").alias("g"), "rep", "n", "part")
    largest = members.groupBy("g", "part").agg(F.count("*").alias("m")).groupBy(F.col("g").alias("of")).agg(F.max_by("part", F.struct("m", "part")).alias("largest"))
    members = materialize(members.join(largest, F.col("g") == F.col("of")).select("g", "rep", "n", "part", (F.col("part") != F.col("largest")).alias("other")), "members")
    deal = lambda n: F.greatest(F.ceil(F.sum(n) / BLOCK_SHINGLES), F.ceil(F.sum(F.when(n > 0, 1)) / BLOCK)).cast("int")
    blocks = members.groupBy("g").agg(deal(F.when(F.col("other"), F.col("n")).otherwise(0)).alias("lefts"), deal(F.col("n")).alias("rights"))
    rows = members.join(full, F.col("rep") == F.col("id")).select("g", "rep", "part", "shingles", "other")

    def decide(group: pa.Table, asks: np.ndarray, at: dict[str, int]) -> np.ndarray:
        found = [np.frombuffer(s, np.uint64) for s in group.column(at["shingles"]).to_pylist()]
        n = np.array([len(s) for s in found])
        _, column, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(found)), n), times[column] > 1
        used, place = np.unique(column[shared], return_inverse=True)
        common = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
        rank = np.where(asks, np.cumsum(asks) - 1, np.cumsum(~asks) - 1)
        for start in range(0, len(used), 4096):  # incidence of some shingles at a time
            mine = (place >= start) & (place < start + 4096)
            r, c = row[shared][mine], place[mine] - start
            wide = min(4096, len(used) - start)
            x, y = np.zeros((common.shape[0], wide), np.float32), np.zeros((common.shape[1], wide), np.float32)
            x[rank[r[asks[r]]], c[asks[r]]] = 1
            y[rank[r[~asks[r]]], c[~asks[r]]] = 1
            common += x @ y.T
        return 100 * common >= percent * (n[asks][:, None] + n[~asks][None, :] - common) - 1e-3

    return _blocked(_dealt(rows.where("other").drop("other"), rows.drop("other"), blocks), decide)


def _placed(shared: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Bucket members with ``part``, the component that the links give them so far."""
    parts = connected_components(links)
    return materialize(shared.select("key", "rep", "n").join(parts, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part")), tag)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, rows: int = ROWS, slack: float = 0.175, id_limit: int = 500_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    ``slack``: how far below the threshold a signature's estimate may lie. Up to ``id_limit`` ids (counted) are broadcast
    to pick the texts that verification needs.
    """
    docs = docs.select("doc_id", "text")
    sigs = materialize(signed(docs, width, coordinates, rows), "signed")
    classes = sigs.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", F.col("n_shingles").alias("n"))
    classes = materialize(classes.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    least = percent / 100 - slack
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    members = classes.select(F.explode_outer("bands").alias("key"), "rep", "n")
    centres = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    centres = materialize(centres, "centres")
    hot = centres.select("key", F.col("m").alias("n")), classes.count() * (coordinates // rows)
    # members of buckets that hold more than one class
    shared = materialize(salted_join(members, centres.select("key", "c"), "key", "rep", sizes=hot).select("key", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("cn")), "buckets")
    star = shared.where(F.col("rep") != F.col("centre")).where(fits(F.col("n"), F.col("cn"))).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = materialize(star, "star")
    links = materialize(_verified(materialize(_alike(tested, classes, least), "alike"), docs, width, percent, id_limit), "links")
    for step in range(STEPS + 1):
        placed = _placed(shared, links, f"placed{step}")
        # what is open: pairs across components, each with one side outside the bucket's largest component
        sizes = placed.groupBy("key", "part").agg(F.count("*").alias("m"))
        open_keys = sizes.groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        mixed = materialize(placed.join(open_keys.select("key", "largest"), "key"), f"open{step}")
        discard(placed)
        if step == STEPS:
            break
        # another member of the largest component for each bucket, so that a document meets as many as it has buckets
        drawn = mixed.where("part = largest").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key", F.lit(step)).alias("x"), "rep", "n")).alias("c"))
        others = mixed.where("part <> largest").select("key", F.col("rep").alias("r2"), F.col("n").alias("n2"))
        pairs = others.join(drawn.select("key", F.col("c.rep").alias("rep"), F.col("c.n").alias("n")), "key").where(fits(F.col("n"), F.col("n2")))
        pairs = pairs.select(F.least("rep", "r2").alias("a"), F.greatest("rep", "r2").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs{step}")
        links = materialize(links.unionByName(_verified(materialize(_alike(pairs, classes, least), f"alike{step}"), docs, width, percent, id_limit)), f"links{step}")
        tested = materialize(tested.unionByName(pairs), f"tested{step}")
        for t in (mixed, pairs):
            discard(t)
    groups = materialize(connected_components(_alike_forest(mixed, classes, least, percent), "groups"), "groups")
    links = links.unionByName(_linked_forest(groups, mixed, docs, width, percent, id_limit))
    ends = materialize(connected_components(links), "components")
    for t in (shared, tested, mixed):
        discard(t)
    by_class = classes.select("d1", "d2", "n", "rep").join(ends, F.col("rep") == F.col("id"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "n", F.coalesce("component", "rep").alias("part"))
    same = (F.col("n_shingles") == F.col("n")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    out = sigs.select("doc_id", "n_shingles", "d1", "d2").join(by_class, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
