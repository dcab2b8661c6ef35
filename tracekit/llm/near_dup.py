"""Near-duplicates by a chosen-path set similarity join.

Every text is its set of word shingles, and every distinct set a member of
a random tree: a node picks a few of the set's minwise values (one over the
threshold of them on average) and a set goes on to one child for each picked
value. Two sets at the threshold are expected to share one child of each node
that they share, others fewer, so nodes soon hold few sets, and sets that
are alike meet in some leaf. In a leaf all sets are compared. Several
trees bring the recall of a link at the threshold to the target: a first
round for all sets, and as many more, each with minwise values of its own, as
the depth reached asks for, for the sets in nodes that go deep. Those only
look for links between components that the first round has left apart.

A family of many near copies would stay together in every tree. Where nodes
below the roots are crowded, their sets are first compared with a few
pivots of the node, on full sets; what is linked is one component from then
on. All its sets still look for links to other components, but nodes
within one component end, and a node of one large component and few other sets
is compared others against all, in blocks, without going deeper.

Leaves compare sketches first; sets that may be linked are then compared on
their full shingle sets. Neither step emits pairs: a leaf yields its groups
of maybe linked sets, and a group the links that span its linked parts, so
thousands of copies of one text cost rows in proportion to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import components, local_components, partitions, small_table, union_all, whole_groups, written
from tracekit.llm._text import mixed, shingle_set

SKETCH = 64  # minwise values of a set, a power of two
TREES = 8  # of a round
RECALL = 0.9995  # of a link exactly at the threshold, at any depth
LEAF = 4000  # sets that are compared with one another
CROWD = 256  # sets of a node from which on its pivots are compared first
PIVOTS = 4  # of such a node
NEAR = 3  # of the pivots that a set meets, the most alike, are compared on full sets
SHARE = 256  # sets compared with a pivot at a time
DEPTH = 12
SIGMAS = 4.5  # how far a sketch may fall below the threshold: misses one link at the threshold in 100,000
PART = (1 - RECALL) / 2 - 1e-5  # of links missed: by the levels all sets go through, and by the rounds of deep ones
RANGE_SHINGLES = 2_000_000  # shingles of a group that are counted at a time
SEED = 11


@lru_cache(64)
def _minwise(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of a round's minwise values."""
    rng = np.random.default_rng([SEED, which] if which else SEED)
    factor = rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64)


def sketch(shingles: np.ndarray, which: int = 0) -> np.ndarray:
    """The minwise values, 32 bits each, of a round."""
    factor, shift = _minwise(which)
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[at:at + 4096, None] * factor + shift).min(0), out=low)
    return (mixed(low) >> np.uint64(32)).astype(np.uint32)


def missed(threshold: float, levels: int, trees: int) -> float:
    """How often two sets exactly at the threshold share no node below so
    many levels in any tree of a round. The trees are independent given how
    many of the round's minwise values agree, which is binomial."""
    often, rest = divmod(1 / threshold, 1)
    total = 0.0
    for k in range(SKETCH + 1):
        same, lost = k / SKETCH, 0.0
        for _ in range(levels):
            one = 1 - same + same * lost
            lost = one ** often * (1 - rest + rest * one)
        total += math.comb(SKETCH, k) * threshold ** k * (1 - threshold) ** (SKETCH - k) * lost ** trees
    return total


def _sets(docs: DataFrame, size: int, threshold: float, trees: int) -> DataFrame:
    """A row per document: its set's size, digest, sketch (``path`` and its
    low bits), and the nodes below the roots of all trees."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, path = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, size)
                n.append(len(found))
                sig.append(xxhash.xxh3_128_digest(found.tobytes()))
                path.append(sketch(found).view(np.int32) if len(found) else None)
            bits = [None if p is None else p.astype(np.uint16).tobytes() for p in path]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                 pa.array(path, pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                names=["doc_id", "text_hash", "n", "sig", "path", "bits"])

    sets = (docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
            .mapInArrow(rows, "doc_id long, text_hash long, n long, sig binary, path array<int>, bits binary"))
    return sets.withColumn("below", _below(F.lit(0), threshold, trees)).withColumn("row", F.monotonically_increasing_id())


def _below(which: Column, threshold: float, trees: int) -> Column:
    """The nodes below the roots of a round's trees."""
    roots = F.array(*[F.xxhash64(F.lit(SEED), (which * trees + t).cast("int")) for t in range(trees)])
    return F.filter(F.flatten(F.transform(roots, lambda root: _picked(root, threshold))), lambda node: node.isNotNull())


def _picked(node: Column, threshold: float) -> Column:
    """The children of ``node`` that the row's ``path`` goes on to."""
    at = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(SKETCH))
    step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(SKETCH // 2)) * 2 + 1
    often, rest = divmod(1 / threshold, 1)
    extra = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1 << 20)) < F.lit(int(rest * (1 << 20)))

    def child(k: int) -> Column:
        pick = F.pmod(at + step * k, F.lit(SKETCH)).cast("int")
        return F.xxhash64(node, pick, F.get("path", pick))

    return F.array(*[child(k) for k in range(int(often))], F.when(extra, child(int(often))))


def _leaves(paths_of: DataFrame, classes: DataFrame, threshold: float, leaf: int, depth: int,
            shallow: int) -> tuple[DataFrame, int, DataFrame | None]:
    """(node, cls) of all leaves with two sets or more, the levels gone
    through, and the sets in nodes that go below level ``shallow``.

    ``paths_of`` has the path of each cls; both tables may have several
    rounds ``which``. With a column ``root``, the component so far, nodes
    within one component are left out, and nodes with few sets besides one
    component are leaves whatever their size, in blocks of that component."""
    keys = [c for c in ("cls", "which", "root") if c in classes.columns]
    own = [c for c in keys if c != "root"]
    out = ["node", *[c for c in keys if c != "which"]]
    level = classes.select(*keys, F.explode("below").alias("node"))
    leaves, paths, deep, half = [], None, None, leaf // 2
    for d in range(depth):
        nodes = written(level, "dup-nodes")
        if "root" in keys:
            parts = nodes.groupBy("node", "root").agg(F.count("*").alias("k"))
            sizes = parts.groupBy("node").agg(F.sum("k").alias("m"), F.max_by("root", "k").alias("main"), F.max("k").alias("k"),
                                              F.count("*").alias("parts")).where("parts > 1").drop("parts")
        else:
            sizes = nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        small = F.col("m") <= leaf
        settled = ~small & (F.col("m") - F.col("k") <= half) if "root" in keys else F.lit(False)
        counts = written(sizes.select("*", small.alias("small"), settled.alias("settled")), "dup-counts")
        leaves.append(nodes.join(counts.where("small"), "node").select(*out))
        if "root" in keys:
            # few sets besides one component: they go to every block of it
            met = nodes.join(counts.where("settled"), "node")
            n_blocks = F.ceil(F.col("k") / half).cast("int")
            block = F.when(F.col("root") == F.col("main"), F.array(F.pmod(F.xxhash64("cls"), n_blocks).cast("int"))).otherwise(F.sequence(F.lit(0), n_blocks - 1))
            met = met.select(*out, F.explode(block).alias("block"))
            leaves.append(met.select(F.xxhash64("node", "block").alias("node"), *out[1:]))
        if d == 0 and shallow == 0:
            deep = nodes.select("cls").distinct()
        going = counts.where("not small and not settled").select("node", "m")
        if going.isEmpty():
            return union_all(leaves), d + 1, deep
        inner = nodes.join(going.select("node"), "node").select("node", *keys)
        if d == depth - 1:
            break
        if d + 1 == shallow:
            deep = inner.select("cls").distinct()
        if paths is None:  # only of the sets that go on
            paths = written(paths_of.join(inner.select(*own).distinct(), own, "left_semi").select(*own, "path"), "dup-paths")
        level = inner.join(paths, own).select(*keys, F.explode(_picked(F.col("node"), threshold)).alias("node")).where("node is not null")
    # sets that stay together however deep are compared in blocks: every two blocks of such a node make a leaf
    sized = nodes.join(going, "node")
    n_blocks = F.ceil(F.col("m") / half).cast("int")
    dealt = sized.select(*out, n_blocks.alias("b"), F.pmod(F.xxhash64("cls"), n_blocks).cast("int").alias("i"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
    leaves.append(other.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("node"), *out[1:]))
    return union_all(leaves), depth, deep


def _maybe_linked(n: np.ndarray, bits: np.ndarray, rows: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Which sets may be linked to each of ``rows``, by their sizes and sketches."""
    same = np.empty((len(rows), len(n)), np.int16)
    for at in range(0, len(rows), 64):
        same[at:at + 64] = (bits[rows[at:at + 64], None] == bits[None]).sum(2)
    ratio = 100 * np.minimum(n[rows, None], n[None]) >= percent * np.maximum(n[rows, None], n[None])
    return (same >= least) & ratio


def _least(percent: int) -> int:
    """How many values of two sketches agree at least where sets are linked."""
    return math.floor(SKETCH * percent / 100 - SIGMAS * math.sqrt(SKETCH * percent / 100 * (1 - percent / 100)))


def _besides_largest(kinds: np.ndarray) -> np.ndarray:
    """The places of all but the most frequent kind."""
    _, which, times = np.unique(kinds, return_inverse=True, return_counts=True)
    return np.flatnonzero(which != times.argmax())


def _screen(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(grp, cls, root): the groups of maybe linked sets of every leaf, each
    once; where leaves have the component so far, by links between two of
    them, else every set is its own ``root``."""
    least = _least(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            node, cls, n = (table.column(c).to_numpy() for c in ("node", "cls", "n"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint16).reshape(-1, SKETCH)
            bounds = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            size = np.diff(bounds)
            rooted = "root" in table.column_names
            root = table.column("root").to_numpy() if rooted else np.arange(len(node))
            left, right = [], []
            # small leaves all at once, by the distance of two rows
            few = np.repeat(size <= 16, size)
            for k in range(1, min(16, int(size.max(initial=0)))):
                i = np.flatnonzero((node[k:] == node[:-k]) & few[k:] & (root[k:] != root[:-k]))
                i = i[100 * np.minimum(n[i], n[i + k]) >= percent * np.maximum(n[i], n[i + k])]
                i = i[(bits[i] == bits[i + k]).sum(1) >= least]
                left.append(i)
                right.append(i + k)
            for start, m in zip(bounds[:-1][size > 16], size[size > 16]):
                own = root[start:start + m]
                others = _besides_largest(own)
                if not len(others):
                    continue
                maybe = _maybe_linked(n[start:start + m], bits[start:start + m], others, percent, least)
                a, b = np.nonzero(maybe & (own[others, None] != own[None]))
                left.append(others[a] + start)
                right.append(b + start)
            a, b = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
            label = local_components(len(node), a, b)
            active = np.flatnonzero(np.bincount(np.r_[a, b], minlength=len(node)))
            key = np.zeros(len(node), np.uint64)
            np.add.at(key, label[active], mixed(cls[active].astype(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(mixed(key)[label[active]].view(np.int64)), pa.array(cls[active]), pa.array(root[active] if rooted else cls[active])],
                                             names=["grp", "cls", "root"])

    full = leaves.join(classes.select("cls", "n", "bits"), "cls").select(*leaves.columns, "n", "bits")
    dealt = full.repartition(partitions(leaves.sparkSession), "node").sortWithinPartitions("node")
    return dealt.mapInArrow(rows, "grp long, cls long, root long").distinct()


def _from_texts(docs: DataFrame, wanted: DataFrame, size: int, made: Callable[[np.ndarray], object], kind: str, arrow: pa.DataType) -> DataFrame:
    """(cls, made) of the wanted (cls, sig, doc_id, text_hash; a written table), what is made
    of the full sets, which are computed again from those texts, of which
    equal rows count once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text, size) for text in batch.column(0).to_pylist()]
            sig = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array([made(f) for f in found], arrow)], names=["sig", "made"])

    ids = small_table(wanted.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["id"]) & (texts["__hash"] == ids["hash"]), "left_semi")
    sets = texts.dropDuplicates(["doc_id", "__hash"]).select("text").mapInArrow(rows, f"sig binary, made {kind}")
    return sets.join(small_table(wanted.select("sig", "cls")), "sig").select("cls", "made")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of the wanted."""
    return _from_texts(docs, wanted, size, lambda found: found.tobytes(), "binary", pa.binary()).withColumnRenamed("made", "shingles")


def _more_paths(docs: DataFrame, wanted: DataFrame, size: int, threshold: float, trees: int, start: int, rounds: int) -> DataFrame:
    """(cls, which, path, below) of the wanted for rounds from ``start`` on."""
    def paths(found: np.ndarray) -> list[np.ndarray]:
        return [sketch(found, w).view(np.int32).tolist() for w in range(start, start + rounds)]

    made = _from_texts(docs, wanted, size, paths, "array<array<int>>", pa.list_(pa.list_(pa.int32())))
    each = made.select("cls", F.posexplode("made").alias("at", "path")).select("cls", (F.col("at") + start).alias("which"), "path")
    return each.withColumn("below", _below(F.col("which"), threshold, trees))


def links_of(sets: list[np.ndarray], percent: int, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets whose intersection is at least ``percent`` of their
    union, by counting shared shingles; only such that two sets have count.
    With ``kinds`` only pairs of two kinds; the largest is not compared with itself."""
    n = np.array([len(s) for s in sets], np.int64)
    kinds = np.arange(len(sets)) if kinds is None else kinds
    rows = _besides_largest(kinds) if len(sets) else np.empty(0, np.int64)
    common = np.zeros((len(rows), len(sets)), np.float64)
    # a range of hashes at a time; sets are sorted
    bounds = [int(x) for x in np.linspace(0, float(1 << 64), 2 + int(n.sum()) // RANGE_SHINGLES)[1:-1]]
    cuts = np.array([[0, *np.searchsorted(s, np.array(bounds, np.uint64)), len(s)] for s in sets])
    for r in range(cuts.shape[1] - 1):
        parts = [s[a:b] for s, a, b in zip(sets, cuts[:, r], cuts[:, r + 1])]
        _, which, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = times[which] > 1
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in parts])[shared]
        column = (np.cumsum(times > 1) - 1)[which[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, (start, start + 4096))
            has = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - start)), np.float32)
            has[owner[a:b], column[a:b] - start] = 1
            common += has[rows] @ has.T  # counts up to 4096 are exact in single precision
    linked = (100 * common >= percent * (n[rows, None] + n[None] - common)) & (kinds[rows, None] != kinds[None])
    a, b = np.nonzero(linked)
    pairs = np.unique(np.sort(np.column_stack([rows[a], b]), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _confirm(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that span the linked sets of every group."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            grp, cls, root = (table.column(c).to_numpy() for c in ("grp", "cls", "root"))
            blobs = table.column("shingles")
            bounds = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1], True])
            for start, end in zip(bounds[:-1], bounds[1:]):
                a, b = links_of([np.frombuffer(x.as_buffer(), np.uint64) for x in blobs[start:end]], percent, root[start:end])
                label = local_components(end - start, a, b)
                member = np.flatnonzero(label != np.arange(end - start))
                if len(member):
                    own = cls[start:end]
                    yield pa.RecordBatch.from_arrays([pa.array(own[member]), pa.array(own[label[member]])], names=["a", "b"])

    dealt = sets.join(small_table(groups), "cls").select("grp", "cls", "root", "shingles")
    dealt = dealt.repartition(partitions(groups.sparkSession), "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(rows, "a long, b long")


def _beside_pivots(classes: DataFrame, percent: int, crowd: int) -> DataFrame | None:
    """(cls, pivot): for the sets below the roots in nodes with more than
    ``crowd``, the most alike pivots by sketches; None without such a node."""
    nodes = classes.select("cls", F.explode("below").alias("node"))
    chosen = F.array(*[F.min_by("cls", F.xxhash64("cls", F.lit(p))) for p in range(PIVOTS)])
    large = written(nodes.groupBy("node").agg(F.count("*").alias("m"), chosen.alias("pivots")).where(F.col("m") > crowd)
                    .select("node", F.explode(F.array_distinct("pivots")).alias("pivot")), "dup-pivots")
    if large.isEmpty():
        return None
    least = _least(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pivot_n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "pivot_n"))
            bits, pivot_bits = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, SKETCH)
                                for c in ("bits", "pivot_bits"))
            same = (bits == pivot_bits).sum(1)
            keep = pa.array((same >= least) & (100 * np.minimum(n, pivot_n) >= percent * np.maximum(n, pivot_n)))
            found = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("cls", "pivot")), pa.array(same)],
                                               names=["cls", "pivot", "same"])
            yield found.filter(keep)

    sketches = classes.select(F.col("cls").alias("pivot"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))
    of_pivots = small_table(written(large.join(sketches, "pivot"), "dup-pivots"))
    met = classes.select("cls", "n", "bits", F.explode("below").alias("node")).join(of_pivots, "node").where("cls <> pivot")
    alike = met.mapInArrow(rows, "cls long, pivot long, same long")
    # a set has at most PIVOTS rows for each of its nodes below the roots
    best = alike.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set(F.struct("same", "pivot")), False), 1, NEAR).alias("best"))
    return best.select("cls", F.explode("best.pivot").alias("pivot"))


def _linked_to_pivots(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the (cls, pivot) whose full sets are linked. A task compares
    shares of the sets of a pivot, one at a time."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            found = []
            for pivot, cls, blob in zip(*(batch.column(c) for c in ("pivot", "cls", "shingles"))):
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if not cls.is_valid:
                    of = own
                    continue
                common = len(np.intersect1d(own, of, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(of) - common):
                    found.append((cls.as_py(), pivot.as_py()))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    shares = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    members = (pairs.join(shares, "pivot").join(sets, "cls")
               .select("pivot", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int").alias("share"), "cls", "shingles"))
    own = (sets.withColumnRenamed("cls", "pivot").join(shares, "pivot")
           .select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("cls"), "shingles"))
    dealt = members.unionByName(own).repartition(partitions(pairs.sparkSession), "pivot", "share")
    return dealt.sortWithinPartitions("pivot", "share", F.col("cls").asc_nulls_first()).mapInArrow(rows, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, root) with more links: those join old components,
    so only their roots are searched anew."""
    if links.isEmpty():
        return roots
    old = small_table(written(roots, "dup-roots"))
    a, b = old.toDF("a", "root_a"), old.toDF("b", "root_b")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = small_table(components(between, "dup-components"))
    moved = old.join(new.toDF("root", "new"), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return moved.unionByName(new.join(old, "id", "left_anti"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = TREES, leaf: int = LEAF,
                    depth: int = DEPTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text_hash, n_shingles, grp, component_id, kept), a row per
    document row; grp is the component's own id, null where there is no set.

    The set of a text is its distinct shingles of ``size`` words, or all its
    words as one; two sets are linked if their intersection is at least
    ``percent`` % of their union. component_id is the smallest doc_id in the
    same linked component, kept whether it is the row's own. Rows with equal
    sets are one member of the join, so copies cost no pairs. Null, empty and blank texts have no set and link with nothing:
    component_id is their own doc_id. Null ids are nobody's smallest one; a
    component of nothing else has a null component_id and kept is false.
    Repeated rows, empty tables and other columns do no harm. Texts are read
    whole, twice where they may be linked. Runs jobs.
    """
    first = written(_sets(docs, size, percent / 100, trees), "dup-sets")
    classes = written(first.where("n > 0").groupBy("sig").agg(
        F.min("doc_id").alias("rep"), F.min("row").alias("cls"), F.first("below").alias("below"), F.first("n").alias("n"), F.first("bits").alias("bits"),
        F.min_by(F.struct("doc_id", "text_hash"), "row").alias("at")), "dup-classes")

    def texts_of(members: DataFrame) -> DataFrame:
        return written(classes.join(members, "cls", "left_semi").select("cls", "sig", "at.*"), "dup-active")

    def links(leaves: DataFrame) -> DataFrame:
        groups = written(_screen(leaves, classes, percent), "dup-groups")
        sets = written(_full_sets(docs, texts_of(groups.select("cls").distinct()), size), "dup-full")
        return written(_confirm(groups, sets, percent), "dup-links")

    threshold = percent / 100
    shallow = next(d for d in range(depth + 1) if d == depth or missed(threshold, d + 1, trees) > PART)
    pairs = _beside_pivots(classes, percent, min(crowd, leaf))
    members = classes
    if pairs is not None:
        pairs = written(pairs, "dup-pairs")
        sets = written(_full_sets(docs, texts_of(pairs.select("cls").union(pairs.select("pivot")).distinct()), size), "dup-full")
        family = written(_linked_to_pivots(pairs, sets, percent), "dup-links")
        roots = components(family, "dup-components")
        members = written(classes.select("cls", "below").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
                          .withColumn("root", F.coalesce("root", "cls")), "dup-members")
    leaves, levels, deep = _leaves(first.select(F.col("row").alias("cls"), "path"), members, threshold, leaf, depth, shallow)
    roots = components(links(leaves), "dup-components") if pairs is None else _merged(roots, links(leaves))
    left, done = missed(threshold, levels, trees), 1
    wanted = texts_of(deep) if left > PART else None
    while left > PART:
        rounds = math.ceil(math.log(PART / left) / math.log(missed(threshold, levels, trees)))
        more = written(_more_paths(docs, wanted, size, threshold, trees, done, rounds)
                       .join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "dup-more")
        leaves, levels, _ = _leaves(more.select("cls", "which", "path"), more, threshold, leaf, depth, depth)
        roots = _merged(roots, links(leaves))
        left, done = left * missed(threshold, levels, trees) ** rounds, done + rounds

    linked = roots.join(classes.select(F.col("cls").alias("id"), "sig", "rep"), "id")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("smallest"))
    by_sig = (classes.select("cls", "sig", "rep").join(linked.join(smallest, "root").select("sig", "smallest", "root"), "sig", "left")
              .select("sig", F.coalesce("root", "cls").alias("grp"),
                      F.when(F.col("root").isNotNull(), F.col("smallest")).otherwise(F.col("rep")).alias("found")))
    rows = first.select("doc_id", "text_hash", "n", "sig").join(by_sig, "sig", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("found"))
    return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "grp", component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates:
    of each component the row with the smallest doc_id stays, null last, then
    with the smallest hash of its text; rows without a set all stay."""
    rows = written(near_duplicates(docs, size, percent, **how).select("doc_id", "text_hash", "grp"), "dup-rows")
    members = rows.where("grp is not null").groupBy("grp", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    # of equal rows only one may stay, so such rows are dropped and one is added again
    stays = members.groupBy("grp").agg(F.min_by(F.struct("doc_id", "text_hash", "times"), order).alias("s")).select("grp", "s.*")
    single = stays.where("times = 1").select("doc_id", "text_hash")
    same = members["doc_id"].eqNullSafe(single["doc_id"]) & (members["text_hash"] == single["text_hash"])
    gone = small_table(written(members.join(single, same, "left_anti").select("doc_id", "text_hash"), "dup-gone"))
    again = small_table(written(stays.where("times > 1").select("doc_id", "text_hash"), "dup-again"))

    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    rest = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["doc_id"]) & (hashed["__hash"] == gone["text_hash"]), "left_anti")
    ones = (hashed.join(again, hashed["doc_id"].eqNullSafe(again["doc_id"]) & (hashed["__hash"] == again["text_hash"]), "left_semi")
            .dropDuplicates(["doc_id", "__hash"]))
    return rest.unionByName(ones).drop("__hash")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the contract: three words, 85 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=3, percent=85).drop("text_hash", "grp")
