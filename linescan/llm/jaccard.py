"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts with one set of shingles form a class, so copies are one row from the
start. Every tree of the forest is a trie of paths of MinHash minima. A class
begins at the longest prefix of each of its paths and shortens them, a minimum
at a time and the one that brings the fewest new candidates first, until a pair
at the threshold would meet it in some tree with the target recall; where it
shares no prefix, shortening costs nothing. So crowded nodes are entered only as
far up as recall asks for. A class that stops at a node meets all
that are below it. Nodes are dealt out in blocks, and each pair of blocks is
one small task unit in which every pair of classes is verified on whole shingle
sets. A pair counts in the first tree where it meets, so links are counted once.
What leaves a unit is a row for each class, never a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .batches import by_bytes, runs
from .components import components
from .shingles import MinHash, mix, paths_of, shingle_sets
from .tables import keep, table

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 16
LONGEST_PREFIX = 6
TARGET_RECALL = 0.9995
#: A block holds about so many classes and so many shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 500_000
#: Candidate ids of up to so many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def prefix_length(threshold: float, trees: int, longest: int, target: float) -> int:
    """The longest prefix with which, in all trees alike, a pair at the threshold meets with the target recall.

    No path is ever shortened beyond it.
    """
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    raise ValueError("so few trees cannot reach the target recall")


def _class_id(shingles: np.ndarray) -> bytes:
    """128 bits of a set: equal sets, equal ids."""
    one, two = mix(shingles ^ np.uint64(0xA5A5A5A5)), mix(shingles + np.uint64(0x5BD1E995))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)]).tobytes()


def class_features(docs: DataFrame, words: int, hasher: MinHash) -> DataFrame:
    """doc_id, class id, number of shingles, and label of the forest (null without words)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            labels = [hasher.label(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([_class_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(labels, pa.binary()),
                ],
                ["doc_id", "cid", "n", "label"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(features, "doc_id long, cid binary, n long, label binary")


def class_shingles(docs: DataFrame, words: int) -> DataFrame:
    """Class id and whole shingle set (8 bytes each) of every text."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"]
            )

    return docs.select("text").mapInArrow(sets_of, "cid binary, shingles binary")


def with_class(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` plus cid, the class id of each text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_class_id(s) for s in sets], pa.binary())], [*batch.schema.names, "cid"])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("cid", BinaryType())]))


def intersections(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of left[a] & right[b] for every pair (a, b)."""
    if len(a) <= 8 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    # Many pairs of few sets: a product of 0-1 matrices, some columns at a time.
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sizes[0].sum()
    rows = [np.repeat(np.arange(len(side)), n) for side, n in zip((left, right), sizes)]
    columns = [column[:split], column[split:]]
    shared = np.intersect1d(columns[0], columns[1])
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), 4096):
        dense = []
        for side, r, c in zip((left, right), rows, columns):
            p = place[c] - at
            inside = (p >= 0) & (p < 4096)
            m = np.zeros((len(side), min(4096, len(shared) - at)), np.float32)
            m[r[inside], p[inside]] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return np.rint(total[a, b]).astype(np.int64)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges (a, b)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            return least


def chosen_depths(sizes: list[tuple[int, int, int]], trees: int, least: int, longest: int, threshold: float, target: float) -> list[int]:
    """How long the prefix of each of a class's paths stays.

    ``sizes`` has (tree, depth, classes at that node) for the trees in which the
    class shares its prefix of length ``least``. A prefix of length d in tree after
    tree misses a pair at the threshold with the product of 1 - threshold**d.
    """
    missed = lambda d: math.log1p(-(threshold**d)) if threshold < 1 else -math.inf
    at = {(t, d): n for t, d, n in sizes}
    depths = [longest if (t, least) in at else least for t in range(trees)]
    miss = sum(map(missed, depths))
    while miss > math.log1p(-target):
        open_ = [t for t in range(trees) if depths[t] > least]
        if not open_:
            break
        price = lambda t: (at[t, depths[t] - 1] - at.get((t, depths[t]), 1)) / (missed(depths[t]) - missed(depths[t] - 1))
        t = min(open_, key=lambda t: (price(t), t))
        miss += missed(depths[t] - 1) - missed(depths[t])
        depths[t] -= 1
    return depths


def verified_links(unit: pa.Table, threshold: float, trees: int, least: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Class ids with links in this unit, the number of texts each links to, and the least class that it reaches.

    A unit is one node's block by itself or against another of its blocks.
    """
    tree = unit.column("tree")[0].as_py()
    unit = unit.sort_by("cid")
    block = unit.column("block").to_numpy()
    first, second = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
    x, y = np.flatnonzero(block == first), np.flatnonzero(block == second)
    cids = unit.column("cid").to_pylist()
    n, copies = unit.column("n").to_numpy(), unit.column("copies").to_numpy()
    stops = unit.column("stops").to_numpy(zero_copy_only=False)
    paths = paths_of(unit.column("label").to_pylist(), trees)
    depths = np.frombuffer(b"".join(unit.column("depths").to_pylist()), np.uint8).reshape(-1, trees)
    may = n[x][:, None] >= threshold * n[y][None, :]
    may &= n[y][None, :] >= threshold * n[x][:, None]
    may &= stops[x][:, None] | stops[y][None, :]
    if first == second:
        may &= np.triu(np.ones_like(may), 1)
    a, b = np.nonzero(may)
    i, j = x[a], y[b]
    for t in range(tree):  # did they meet before?
        _, start = np.unique(paths[:, t, :least], axis=0, return_inverse=True)
        start = start.reshape(-1)
        alike = np.flatnonzero(start[i] == start[j])
        shared = np.logical_and.accumulate(paths[i[alike], t] == paths[j[alike], t], axis=1).sum(1)
        before = alike[shared >= np.minimum(depths[i[alike], t], depths[j[alike], t])]
        keep_ = np.ones(len(i), bool)
        keep_[before] = False
        a, b, i, j = a[keep_], b[keep_], i[keep_], j[keep_]
    if not len(a):
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    sets = [np.frombuffer(s.as_py(), np.uint64) for s in unit.column("shingles")]
    both = intersections([sets[k] for k in x], [sets[k] for k in y], a, b)
    good = both >= threshold * (n[i] + n[j] - both) - 1e-9
    i, j = i[good], j[good]
    links = np.bincount(i, copies[j], len(cids)) + np.bincount(j, copies[i], len(cids))
    reached = least_reachable(len(cids), i, j)
    has = np.flatnonzero(links)
    return [cids[k] for k in has], links[has].astype(np.int64), [cids[k] for k in reached[has]]


def jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, trees: int = TREES, longest: int = LONGEST_PREFIX,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """doc_id, class_id, n_links for each document of ``docs`` (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of shingles
    (``words`` lower-case words, split at white space) is ``threshold`` or more.
    class_id is the least doc_id that links lead to; n_links counts the other
    documents that a document is linked to, copies each by itself. Texts that
    are null, empty or only white space have no shingles: no links and a class
    of their own. A shorter text has one shingle. Rows that repeat a doc_id and
    its shingles count once; a doc_id with two texts gives two rows. A null
    doc_id is a document. Other columns are ignored; texts count whole, however
    long; no documents give no rows. Links at the threshold are found with a
    probability of ``target`` at least; none is found wrongly. ``trees`` paths of
    ``longest`` minima are kept for each text.
    """
    return text_classes(docs, threshold, words, trees, longest, target).select("doc_id", "class_id", "n_links")


def text_classes(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, trees: int = TREES, longest: int = LONGEST_PREFIX,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """The rows of ``jaccard_join`` with cid, the text's set of shingles, and root, the cid that stands for its class.

    Where a doc_id has several texts, unlike classes may have one class_id, but not one root.
    """
    least = prefix_length(threshold, trees, longest, target)
    hasher = MinHash(trees, longest)
    once = keep(class_features(docs, words, hasher).dropDuplicates(["doc_id", "cid"]), "labels")
    worded = once.where("n > 0").groupBy("cid")
    classes = keep(worded.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("label").alias("label")), "classes")
    met = _meetings(classes, trees, least, longest)
    depths = keep(_depths(met, trees, least, longest, threshold, target), "depths")
    units = _units(met, depths, least)
    sets = _candidate_sets(docs, classes, depths, units, words)
    found = keep(_verify(units, sets, threshold, trees, least), "links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "cid")
    least = grouped.join(classes.select("cid", "rep"), "cid").groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = links.join(grouped, "cid").join(least, "root").select("cid", "links", "class_id", "root")
    info = classes.select("cid", "copies", "rep").join(linked, "cid", "left")
    info = info.select("cid", F.coalesce("root", "cid").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return once.select("doc_id", "cid").join(info, "cid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "cid", F.coalesce("root", "cid").alias("root"),
    )


def _meetings(classes: DataFrame, trees: int, least: int, longest: int) -> DataFrame:
    """cid, n, tree, path of every class that shares a path's first ``least`` minima with another."""
    width = 2 * longest
    keys = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    keys = keys.select("cid", "n", "tree", F.substring("label", F.col("tree") * width + 1, F.lit(width)).alias("path"))
    keys = keys.withColumn("node", F.substring("path", 1, 2 * least))
    shared = keys.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    return keep(keys.join(shared, ["tree", "node"]).drop("node"), "met")


def _depths(met: DataFrame, trees: int, least: int, longest: int, threshold: float, target: float) -> DataFrame:
    """cid and depths, a byte for each tree: where the class's paths stop."""
    nodes = met.select("cid", "tree", "path", F.explode(F.sequence(F.lit(least), F.lit(longest))).alias("depth"))
    nodes = nodes.select("cid", "tree", "depth", F.substring("path", F.lit(1), 2 * F.col("depth")).alias("node"))
    sizes = nodes.groupBy("tree", "depth", "node").agg(F.count(F.lit(1)).alias("members"))
    # At most trees * (longest - least + 1) numbers for each class.
    own = nodes.join(sizes, ["tree", "depth", "node"]).groupBy("cid").agg(F.collect_list(F.struct("tree", "depth", "members")).alias("sizes"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(s["tree"], s["depth"], s["members"]) for s in sizes] for sizes in batch.column("sizes").to_pylist()]
            chosen = [bytes(chosen_depths(sizes, trees, least, longest, threshold, target)) for sizes in found]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(chosen, pa.binary())], ["cid", "depths"])

    return own.mapInArrow(choose, "cid binary, depths binary")


def _units(met: DataFrame, depths: DataFrame, least: int) -> DataFrame:
    """cid, tree, node, stops, block, lo, hi: which classes meet in which pair of blocks of which node.

    A class is at all nodes of its path down to the one where it stops.
    """
    stop = F.conv(F.hex(F.substring("depths", F.col("tree") + 1, F.lit(1))), 16, 10).cast("int")
    below = met.join(depths, "cid").withColumn("stop", stop).withColumn("depth", F.explode(F.sequence(F.lit(least), F.col("stop"))))
    below = below.select("cid", "n", "tree", F.substring("path", F.lit(1), 2 * F.col("depth")).alias("node"), (F.col("depth") == F.col("stop")).alias("stops"))
    below = keep(below, "nodes")
    nodes = below.groupBy("tree", "node").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("stops").alias("stopped"), F.sum("n").alias("shingles"),
        F.bit_xor(F.xxhash64("cid", "stops")).alias("mark"), F.bit_xor(F.xxhash64("cid", "stops", F.lit(1))).alias("mark2"),
    ).where("members > 1 AND stopped > 0")
    # Nodes of the same classes that stop alike, as of a text and its edit, are worked on in their first tree only.
    nodes = nodes.groupBy("members", "mark", "mark2").agg(F.min(F.struct("tree", "node")).alias("b"), F.first("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    nodes = nodes.select("b.tree", "b.node", blocks.alias("blocks"))
    dealt = below.drop("n").join(nodes, ["tree", "node"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("cid", "tree", "node", "stops", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _candidate_sets(docs: DataFrame, classes: DataFrame, depths: DataFrame, units: DataFrame, words: int) -> DataFrame:
    """copies, n, label, depths and whole shingle sets of the classes that meet others."""
    candidates = keep(classes.join(units.select("cid").distinct(), "cid", "left_semi").join(depths, "cid"), "candidates")
    ids = candidates.select(F.col("rep").alias("id")).distinct()
    ids = F.broadcast(ids) if candidates.count() <= BROADCAST_ROWS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, texts.doc_id.eqNullSafe(ids.id), "left_semi")
    sets = class_shingles(texts, words).dropDuplicates(["cid"])
    return candidates.drop("rep").join(sets, "cid")


def _verify(units: DataFrame, sets: DataFrame, threshold: float, trees: int, least: int) -> DataFrame:
    """cid, links, root of every class with links, a row for each unit."""
    order = ["tree", "node", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, order):
            cids, links, roots = verified_links(unit, threshold, trees, least)
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(links), pa.array(roots, pa.binary())], ["cid", "links", "root"])

    dealt = units.join(sets, "cid").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(verify, "cid binary, links long, root binary")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE c * 5 >= 4 * (nx + ny - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.x = l.x),
c AS (SELECT x, min(root) AS class_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(n.n_links, 0) AS n_links FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.x = d.doc_id
"""
