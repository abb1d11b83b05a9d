"""Near duplicates: a Jaccard join of word shingles over a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, batches_of, give_back
from .components import components
from .shingles import overlap, set_digest, shingle_sets

#: A count vector has a power of two of token groups, at least 2 ** LEAST_BITS and at most PER_GROUP shingles to a group on average.
LEAST_BITS, PER_GROUP = 8, 8
#: Counts are kept in a byte; this one stands for itself or more.
FULL = 255
#: Two sets are linked where NUM * |union| <= DEN * |intersection|.
NUM, DEN = 4, 5
#: Points of a leaf, children of a node, most points of one tree.
LEAF, FANOUT, TREE = 16, 8, 1024
#: A row of a cell names so many cells of its node that come before; a pair that meets in one of them isn't reported again.
EARLIER = 8
#: Rows of an Arrow batch that hold one whole text, or two.
TEXT_BATCH, PAIR_BATCH = 1000, 200
#: Passes in which nodes are compared with drawn members of their cells before the trees are built.
LEADERS = 2
#: Pairs of each node of a cell that the trees give at first; all follow.
PICKED = 4
#: One document in HOT_SAMPLE is looked at for frequent shingles; one met in HOT_LEAST of them is frequent; so many are kept.
HOT_SAMPLE, HOT_LEAST, HOT_KEPT = 64, 4, 100_000


def count_vector(shingles: np.ndarray) -> bytes:
    """Shingles per hashed group, one byte each; counts from FULL on are FULL. Larger sets have more groups. Takes the first row of a set."""
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1, len(shingles)) / PER_GROUP))))
    groups = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(groups, FULL).astype(np.uint8).tobytes()


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Vectors over fewer groups: neighbours add up."""
    if vectors.shape[1] == groups:
        return vectors
    return np.minimum(vectors.reshape(len(vectors), groups, -1).sum(2, dtype=np.int64), FULL).astype(np.uint8)


def stacked(column: list) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Greatest overlap that the coordinate minima allow; unbounded where both counts of a group are FULL."""
    low = np.minimum(a, b)
    return np.where((low == FULL).any(1), UNBOUNDED, low.sum(1, dtype=np.int64))


def pair_bounds(a: list, b: list) -> np.ndarray:
    """overlap_bound of pairs of vectors of any lengths, the longer one folded."""
    la, lb = (np.array([len(v) for v in x]) for x in (a, b))
    out = np.zeros(len(a), np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist(), strict=True)):
        at = np.flatnonzero((la == x) & (lb == y))
        step = max(1, SLAB // max(x, y))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            out[some] = overlap_bound(folded(stacked([a[r] for r in some]), min(x, y)), folded(stacked([b[r] for r in some]), min(x, y)))
    return out


#: Bytes of vectors that are compared at once.
SLAB = 1 << 25
UNBOUNDED = 1 << 40


def prefix(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first |s| - ceil(0.8 |s|) + 1 shingles in an order that puts frequent ones last.

    Linked sets share at least 0.8 of the larger one, so whatever the order is,
    their prefixes share a shingle. The order decides the cost alone.
    """
    n = len(shingles)
    size = n - (NUM * n + DEN - 1) // DEN + 1 if n else 0
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        shingles = shingles[np.argsort(hot[at] == shingles, kind="stable")]
    return shingles[:size]


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Sorted shingles that a sample of the documents finds frequent; at most HOT_KEPT of them."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s[0] for s in shingle_sets(pdf["text"].tolist())]
            values, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pd.DataFrame({"s": values.view(np.int64), "n": n.astype(np.int64)})

    sample = documents.where("text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    counts = sample.select("text").mapInPandas(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "s").limit(HOT_KEPT).collect()
    return np.sort(np.array([r.s for r in top], np.int64).view(np.uint64))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, n, digest, keys, counts of every document; sets of no shingle have n = 0 and no keys. Equal sets, and only they, share their 128-bit digest."""
    hot = documents.sparkSession.sparkContext.broadcast(frequent_shingles(documents))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets([t if isinstance(t, str) else None for t in pdf["text"]])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n": np.array([s.shape[1] for s in sets], np.int64), "digest": [set_digest(s) for s in sets],
                "keys": [prefix(s[0], hot.value).view(np.int64) for s in sets], "counts": [count_vector(s[0]) for s in sets],
            })
        give_back()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(describe, "doc_id long, n long, digest binary, keys array<long>, counts binary")


# ---- the tree


class CountTree:
    """R-tree over count vectors, packed bottom-up; a box keeps its greatest coordinates, sizes and component.

    The overlap of any set in one box with any set in another is at most the
    sum of the coordinate minima of the two boxes' upper corners.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        spread = counts.var(0)
        keys = [counts[:, g] for g in np.argsort(spread)[-3:]]
        self.order = np.lexsort((*keys, sizes))
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order], roots[self.order])]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            upper, low, high, root = self.levels[-1]
            starts = np.arange(0, len(upper), width)
            first, last = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
            self.levels.append((np.maximum.reduceat(upper, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.where(first == last, first, MIXED)))
            width = FANOUT

    def _may(self, level: int, i: np.ndarray, other: CountTree, j: np.ndarray) -> np.ndarray:
        upper, low, high, root = self.levels[level]
        upper2, low2, high2, root2 = other.levels[min(level, len(other.levels) - 1)]
        ok = (DEN * high[i] >= NUM * low2[j]) & (DEN * high2[j] >= NUM * low[i]) & ((root[i] != root2[j]) | (root[i] == MIXED))
        ok = ok.nonzero()[0]
        bound = overlap_bound(upper[i[ok]], upper2[j[ok]])
        return ok[(NUM + DEN) * bound >= NUM * (low[i[ok]] + low2[j[ok]])]

    def join(self, new: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the point pairs that the bound leaves, each pair once, of different components.

        ``new`` tells which pairs to keep at once. Box pairs are taken from a stack in parts of bounded size, deepest first.
        """
        most = max(1, SLAB // self.levels[0][0].shape[1])
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while stack:
            level, i, j = stack.pop()
            keep = self._may(level, i, self, j)
            i, j = i[keep], j[keep]
            if level == 0:
                apart = i != j
                i, j = self.order[i[apart]], self.order[j[apart]]
                if new is not None and len(i):
                    i, j = i[keep := new(i, j)], j[keep]
                found.append((i, j))
                continue
            width = LEAF if level == 1 else FANOUT
            total, child = len(self.levels[level - 1][0]), np.arange(width)
            for k in range(0, len(i), step := max(1, most // width**2)):
                p, q = i[k : k + step], j[k : k + step]
                a = (p[:, None, None] * width + child[None, :, None]).repeat(width, 2).ravel()
                b = (q[:, None, None] * width + child[None, None, :]).repeat(width, 1).ravel()
                ok = (a < total) & (b < total) & (a <= b)
                stack.append((level - 1, a[ok], b[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.order[:0], self.order[:0])


#: Component mark of boxes that hold several.
MIXED = np.iinfo(np.int64).min


def met_before(earlier: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair name a common earlier cell; column 0 counts the cells that a row names."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), step := SLAB >> 8):
        a, b = earlier[i[k : k + step]], earlier[j[k : k + step]]
        for x in range(1, earlier.shape[1]):
            named = (b[:, 1:] == a[:, x, None]) & (np.arange(1, earlier.shape[1]) <= b[:, :1])
            out[k : k + step] |= named.any(1) & (x <= a[:, 0])
    return out


def tree_pairs(
    nodes: np.ndarray, sizes: np.ndarray, roots: np.ndarray, blocks: np.ndarray, counts: list, earlier: np.ndarray, across: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs of one cell that may be linked and meet in no earlier cell. ``across`` keeps pairs of different blocks only.

    Sizes of linked sets differ by a quarter at most, so their vectors are of
    equal or neighbouring lengths: each length has a tree over its own sets and
    the folded ones of the next length.
    """
    lengths = np.array([len(v) for v in counts])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for groups in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths == groups) | (lengths == 2 * groups))
        if len(at) < 2:
            continue
        vectors = np.empty((len(at), groups), np.uint8)
        own = lengths[at] == groups
        vectors[own] = stacked([counts[k] for k in at[own]])
        if not own.all():
            vectors[~own] = folded(stacked([counts[k] for k in at[~own]]), groups)

        def new(i: np.ndarray, j: np.ndarray, at: np.ndarray = at, own: np.ndarray = own) -> np.ndarray:
            keep = own[i] | own[j]
            if across:
                keep &= blocks[at[i]] != blocks[at[j]]
            keep[keep] = ~met_before(earlier, at[i[keep]], at[j[keep]])
            return keep

        i, j = (at[x] for x in CountTree(vectors, sizes[at], roots[at]).join(new))
        found.append((np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (nodes[:0], nodes[:0])


def picked(a: np.ndarray, b: np.ndarray, few: int) -> np.ndarray:
    """Which pairs are among the first ``few`` of either of their nodes, in an order drawn by hash: at most ``few`` times the nodes in all."""
    draw = np.argsort(pd.util.hash_array(a) ^ (pd.util.hash_array(b) * np.uint64(3)), kind="stable")
    keep = np.zeros(len(a), bool)
    for side in (a, b):
        keep[draw] |= pd.Series(side[draw]).groupby(side[draw]).cumcount().to_numpy() < few
    return keep


def _cells(batches: Iterator[pd.DataFrame], few: int | None = None) -> Iterator[pd.DataFrame]:
    """Join every cell of a partition that is sorted by cell; a cell has at most 2 * TREE or so rows. ``few`` asks for so many pairs of each node of a cell only."""
    rest: pd.DataFrame | None = None

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        same = (pdf["key"].to_numpy()[1:] == pdf["key"].to_numpy()[:-1]) & (pdf["i"].to_numpy()[1:] == pdf["i"].to_numpy()[:-1]) & (pdf["j"].to_numpy()[1:] == pdf["j"].to_numpy()[:-1])
        starts = np.flatnonzero(np.r_[True, ~same])
        columns = [pdf[c].to_numpy(np.int64) for c in ("node", "n", "root", "block")]
        counts = pdf["counts"].tolist()
        across = (pdf["i"] != pdf["j"]).to_numpy()
        lengths = pdf["earlier"].map(len).to_numpy(np.int64)
        earlier = np.zeros((len(pdf), EARLIER + 1), np.int64)
        earlier[:, 0] = lengths
        earlier[:, 1:][np.arange(EARLIER) < lengths[:, None]] = np.concatenate([np.asarray(e, np.int64) for e in pdf["earlier"]])
        found = [tree_pairs(*(c[a:b] for c in columns), counts[a:b], earlier[a:b], bool(across[a])) for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True)]
        if few is not None:
            found = [(i[keep], j[keep]) for i, j in found for keep in [picked(i, j, few)]]
        both = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame({"a": both[0], "b": both[1]}).drop_duplicates()

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        end = pdf.iloc[-1]
        last = ((pdf["key"] == end["key"]) & (pdf["i"] == end["i"]) & (pdf["j"] == end["j"])).to_numpy()
        whole, rest = pdf[~last], pdf[last]
        if len(whole):
            yield joined(whole)
    if rest is not None and len(rest):
        yield joined(rest)


# ---- the join


def _small(df: DataFrame, rows: int = BROADCAST_ROWS):
    """Broadcast hint for a written table that holds few enough rows, else nothing: then the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def _verified(pairs: DataFrame, documents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b, doc_a, doc_b, set_a, set_b) whose whole texts are linked, as a, b."""
    pairs = scratch.write(pairs, f"{name}-pairs")
    right = scratch.write(pairs.select("b", "doc_b", "set_b").distinct(), f"{name}-right")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    left = texts.join(_small(pairs.select("a", "b", "doc_a", "set_a")), F.col("doc_id") == F.col("doc_a")).select("a", "b", "set_a", F.col("text").alias("text_a"))
    right = texts.join(_small(right), F.col("doc_id") == F.col("doc_b")).select("b", "set_b", F.col("text").alias("text_b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # the rows of one b follow each other: its text is cut once
            number = {t: k for k, t in enumerate(dict.fromkeys([*pdf["text_a"], *pdf["text_b"]]))}
            sets = shingle_sets(list(number))
            names = [set_digest(s) for s in sets]
            keep = []
            for text_a, text_b, set_a, set_b in zip(pdf["text_a"], pdf["text_b"], pdf["set_a"], pdf["set_b"], strict=True):
                i, j = number[text_a], number[text_b]
                # an id that repeats with another text brings a set that isn't the node's
                both = overlap(sets[i], sets[j]) if names[i] == set_a and names[j] == set_b else 0
                keep.append(both > 0 and DEN * both >= NUM * (sets[i].shape[1] + sets[j].shape[1] - both))
            yield pdf.loc[keep, ["a", "b"]]
        give_back()

    with batches_of(documents.sparkSession, PAIR_BATCH):
        joined = left.join(right, "b").select("a", "b", "set_a", "set_b", "text_a", "text_b")
        return scratch.write(joined.mapInPandas(check, "a long, b long").distinct(), name)


def near_duplicates(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents``.

    1. Each text becomes its set of distinct 5-word shingles, a count vector
       (shingles per hashed group) and prefix keys. Equal sets are one node.
    2. Nodes that share a prefix key form a cell; linked nodes always share
       one. In two passes each cell draws a leader and each node is compared
       with the leaders of four of its cells, as far as they are of another
       component: that joins the bulk of every large group of near copies in a
       number of comparisons that grows with the rows, not the pairs.
    3. In the cells that still hold several components, an R-tree over the
       count vectors is joined with itself; boxes whose coordinate minima
       cannot reach the overlap that a link needs, or that hold one and the
       same component, are left out. Cells beyond TREE nodes are cut in blocks,
       and every pair of blocks has a tree, so nothing is capped. Nodes that
       meet in many cells are reported in the first, since each row names the
       node's cells just before its own.
    4. The trees run twice. At first each node of a cell gives a few of its
       pairs, a number that grows with the rows: their links join what the
       leaders left apart in large groups. Then all pairs are given whose nodes
       are still of different components, with no bound.
    5. The pairs are verified on whole texts; links give components.

    Texts of fewer than five words are one shingle; null texts and those
    without words have none, are linked with nothing and are their own
    component. Rows with a null id have a null component unless an equal or
    linked text has an id. Repeated rows share their result. An empty table
    gives no rows.
    """
    with batches_of(documents.sparkSession, TEXT_BATCH):
        every = scratch.write(features(documents).withColumn("row", F.monotonically_increasing_id()), "features")
    full = every.where("n > 0")
    # a node is known by the number of one of its rows, so no two nodes can share it
    reps = scratch.write(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("node")), "reps")
    # one row of each node stays, also where rows are repeated with their ids
    copies = scratch.write(full.select("row", "digest").join(reps, "digest").where("row <> node").select(F.col("row").alias("__row")), "copies")
    points = full.join(_small(copies), F.col("row") == F.col("__row"), "left_anti").dropna(subset=["doc_id"]).withColumnRenamed("row", "node")
    keys = points.select(F.explode("keys").alias("key"), "node", "n").repartition("key")
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("first <> last").select("key", "size")
    members = scratch.write(keys.join(shared, "key").select("key", "node", "n", "size"), "members")

    # the leaders' passes
    roots = None
    for turn in range(LEADERS):
        placed = _placed(members, roots)
        mine = placed.select("key", F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("draw"), "node", "n", "root").alias("m"), "size")
        lead = mine.groupBy("key").agg(F.min("m").alias("lead"), F.min("m.root").alias("low"), F.max("m.root").alias("high")).where("low <> high").select("key", "lead")
        near = mine.join(lead, "key").where("m.root <> lead.root").where((DEN * F.col("m.n") >= NUM * F.col("lead.n")) & (DEN * F.col("lead.n") >= NUM * F.col("m.n")))
        pick = F.struct(F.xxhash64("key", F.lit(turn)).alias("draw"), F.col("lead.node").alias("b"))
        picks = near.groupBy(F.col("m.node").alias("a")).agg(
            F.max(F.struct("size", F.col("lead.node").alias("b"))).alias("x"), F.min(F.struct("size", F.col("lead.node").alias("b"))).alias("y"), F.min(pick).alias("z"), F.max(pick).alias("w"))
        pairs = scratch.write(picks.select("a", F.explode(F.array_distinct(F.array("x.b", "y.b", "z.b", "w.b"))).alias("b")), f"lead-{turn}")
        links = _verified(_allowed(pairs, points).dropDuplicates(["a", "b"]), documents, scratch, f"lead-links-{turn}")
        if roots is not None:
            links = links.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = scratch.write(components(links, scratch, f"lead-{turn}"), f"lead-roots-{turn}")

    # the trees' passes: a few pairs of each node, then all that are still of different components
    for few in (PICKED, None):
        name = "all" if few is None else "few"
        found = _tree_join(_placed(members, roots), points, scratch, f"tree-pairs-{name}", few)
        more = _verified(_with_docs(found, points), documents, scratch, f"tree-links-{name}")
        known = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = scratch.write(components(known.unionByName(more), scratch, name), f"tree-roots-{name}")

    groups = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = scratch.write(groups.join(first, "root").select("digest", "component_id"), "classes")
    scratch.keep_only("features", "classes")
    bare = every.select("doc_id", "n", "digest")
    linked = bare.where("n > 0").join(classes, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = bare.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _tree_join(placed: DataFrame, points: DataFrame, scratch: Scratch, name: str, few: int | None) -> DataFrame:
    """a, b: node pairs of different components that the trees of the cells leave, all of them or a few of each node."""
    mixed = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(node))").alias("who"), F.min("node").alias("least"),
    ).where("low <> high")
    # cells of the same members are one cell
    mixed = mixed.groupBy("size", "who", "least").agg(F.min("key").alias("key"))
    mixed = mixed.select("key", F.ceil(F.col("size") / TREE).cast("int").alias("parts"))
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
    rows = placed.drop("size").join(mixed, "key").withColumn("earlier", F.collect_list("key").over(before))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", "node", "n", "root", "block", "earlier", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(points.select("node", "counts"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return scratch.write(rows.select("key", "i", "j", "node", "n", "root", "block", "earlier", "counts").mapInPandas(partial(_cells, few=few), "a long, b long").distinct(), name)


def _placed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, n, size and the component that each member has so far."""
    if roots is None:
        return members.select("key", "node", "n", "size", F.col("node").alias("root"))
    now = roots.select(F.col("node").alias("__node"), "root")
    return members.join(_small(now), F.col("node") == F.col("__node"), "left").select("key", "node", "n", "size", F.coalesce("root", "node").alias("root"))


def _with_docs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs with a document of each node and the digests of their sets."""
    for side in ("a", "b"):
        pairs = pairs.join(points.select(F.col("node").alias(side), F.col("doc_id").alias(f"doc_{side}"), F.col("digest").alias(f"set_{side}")), side)
    return pairs.select("a", "b", "doc_a", "doc_b", "set_a", "set_b")


def _allowed(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) that their count vectors allow, with a document and the set digest of each node."""
    facts = points.select("node", "doc_id", "n", "counts", "digest")
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("doc_id", "n", "counts", "digest"))), side)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                limit = pair_bounds(pdf["counts_a"].tolist(), pdf["counts_b"].tolist())
                ok = (NUM + DEN) * limit >= NUM * (pdf["n_a"] + pdf["n_b"]).to_numpy()
                names = {"doc_id_a": "doc_a", "doc_id_b": "doc_b", "digest_a": "set_a", "digest_b": "set_b"}
                yield pdf.loc[ok, ["a", "b", *names]].rename(columns=names)

    schema = "a long, b long, doc_a long, doc_b long, set_a binary, set_b binary"
    return pairs.select("a", "b", "n_a", "n_b", "counts_a", "counts_b", "doc_id_a", "doc_id_b", "digest_a", "digest_b").mapInPandas(keep, schema)


def one_of_each(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``documents``, one row of each component: that with the smallest id.

    Ids of the others are joined away: by broadcast while there are few, else by shuffle.
    """
    found = near_duplicates(documents, scratch)
    gone = scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    scratch.keep_only("gone")
    return documents.join(_small(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
