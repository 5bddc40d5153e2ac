"""Operator 9: n-gram Jaccard self-join by a MinHash LSH forest with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, may_hold, mix, packed, pieces, Rolling, signed, unpacked, words
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
TARGET_RECALL = 0.9999
#: Shingles, and texts, that one side of a verification task holds.
BLOCK_SHINGLES = 600_000
BLOCK_MEMBERS = 4_000
#: Cells of one dense incidence slice.
DENSE_CELLS = 4_000_000
#: Rows of a sorted trie that are walked at once.
WALK_ROWS = 1 << 18
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)


def forest_depth(similarity: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, longest: int = MAX_DEPTH) -> int:
    """Where shortening stops: the longest prefix by which a pair of that similarity is found with the target recall."""
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The least similarity from ``threshold`` on that a set of ``size`` can have with another, different set; 1 if there is none."""
    found = [common / (size + other - common) for other in range(max(1, int(threshold * size)), int(size / threshold) + 2) for common in range(1, min(size, other) + 1)]
    return min((x for x in found if threshold - 1e-9 <= x < 1), default=1.0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``n``-word shingles. Rows of 1 to n-1 words have one shingle, all their words; rows without words none."""
    starts, ends, row = words(data, offsets)
    hashes = Rolling(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(len(offsets)))
    full = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        full = full * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(full)]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = h * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Forest:
    """Signatures by one-permutation hashing, arranged as ``trees`` label strings of ``longest`` values."""

    def __init__(self, trees: int, longest: int = MAX_DEPTH):
        self.trees, self.longest, self.bins = trees, longest, trees * longest
        self.detours = (mix(np.arange(self.bins * 24, dtype=np.uint64) + np.uint64(7)) % np.uint64(self.bins)).astype(np.int64).reshape(24, self.bins)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = ((shingles >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        head = np.concatenate(([True], at[1:] != at[:-1]))
        out = np.full(self.bins, _EMPTY, np.uint64)
        out[at[head]] = shingles[head]
        held = out != _EMPTY
        if not held.all():
            source = np.where(held, np.arange(self.bins), -1)
            for detour in self.detours:
                empty = np.flatnonzero(source < 0)
                if not len(empty):
                    break
                there = detour[empty]
                source[empty] = np.where(held[there], there, -1)
            empty = np.flatnonzero(source < 0)
            full = np.flatnonzero(held)
            source[empty] = full[np.searchsorted(full, empty) % len(full)]
            out = out[source]
        return mix(out)

    def labels(self, signature: np.ndarray) -> np.ndarray:
        """(trees, 2) numbers: a tree's label string, four labels of 16 bits in each number, the first label on top. Their order is the trie's."""
        parts = (signature >> np.uint64(48)).reshape(self.trees, 2, 4) << np.array([48, 32, 16, 0], np.uint64)
        return np.bitwise_or.reduce(parts, 2)


def shared_labels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many labels from the first on are equal, for rows of two numbers each."""
    x = a ^ b
    equal = (x < np.uint64(1 << 48)).astype(np.int8) + (x < np.uint64(1 << 32)) + (x < np.uint64(1 << 16)) + (x == 0)
    return np.where(equal[:, 0] == 4, 4 + equal[:, 1], equal[:, 0])


def climb(tree: np.ndarray, keys: np.ndarray, depth: np.ndarray, longest: int = MAX_DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (position, position of the least of its node) of records in trie order, from the longest prefixes upwards.

    At each length the records that still shorten are those whose ``depth`` is not longer. Those that share a prefix of the length
    are linked to its first one; of a node that was linked under a longer prefix only its first record is linked on.
    """
    heads = np.arange(len(tree))
    for level in range(longest, int(depth.min()) - 1 if len(depth) else longest, -1):
        at = np.flatnonzero(depth <= level)
        if len(at) < 2:
            continue
        same = (tree[at][1:] == tree[at][:-1]) & (shared_labels(keys[at][1:], keys[at][:-1]) >= level)
        first = heads[at[np.maximum.accumulate(np.where(np.concatenate(([False], same)), 0, np.arange(len(at))))]]
        new = np.concatenate(([False], same)) & (heads[at] != first)
        # A record's node is named by its head; nodes that meet keep the first one's.
        lower = np.unique(heads[at[new]])
        yield lower, first[new][np.unique(heads[at[new]], return_index=True)[1]]
        heads[at] = first


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """Sixteen bytes that name a set of shingles."""
    if not len(shingles):
        return None
    return np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD, split: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Exact Jaccard of all pairs of a family, in dense slices: for each position the positions that it links to.

    With ``split``, only pairs between the first ``split`` sets and the others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    width = int(column[-1]) + 1 if len(column) else 0
    left = n if split is None else split
    common = np.zeros((left, n if split is None else n - split), np.float32)
    step = max(1, DENSE_CELLS // max(1, n))
    for k in range(0, width, step):
        a, b = np.searchsorted(column, [k, k + step])
        dense = np.zeros((n, min(step, width - k)), np.float32)
        dense[owner[a:b], column[a:b] - k] = 1
        common += dense[:left] @ (dense if split is None else dense[split:]).T
    others = sizes if split is None else sizes[split:]
    for i in range(left):
        hit = common[i] >= threshold * (sizes[i] + others - common[i]) - 1e-6
        if split is None:
            hit[i] = False
        yield i, np.flatnonzero(hit) + (0 if split is None else split)


def _verify(members: list[dict], split: int | None, threshold: float) -> tuple[list[int], list[int]]:
    """(weight of each member's links, position of the least member of its component)."""
    parent = list(range(len(members)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    weights = np.array([m["weight"] for m in members])
    links = np.zeros(len(members), np.int64)
    for i, partners in linked([m["shingles"] for m in members], threshold, split):
        links[i] += weights[partners].sum()
        if split is not None:
            links[partners] += weights[i]
        for j in partners.tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return links.tolist(), [find(i) for i in range(len(members))]


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """For each row of ``df``: doc_id, class_id, n_links.

    Two texts are linked when the Jaccard similarity of their sets of ``n``-word shingles (words are runs of
    bytes other than ASCII white space) is at least ``threshold``. A class is a connected component of links,
    named by its least key; n_links counts the other rows that a row is linked to, copies included.

    1. Rows with equal shingle sets collapse into one representative with a weight.
    2. A representative's signature gives one label string for each tree. Range-partitioned and sorted, the
       strings of a tree are its prefix trie. A record climbs from its longest matched prefix to shorter ones until
       the expected recall of a partner of the least similarity that its size admits reaches ``recall``; at each
       length it is linked to the first record of its node (a star, never all pairs).
    3. The stars' components are families. All pairs inside a family are compared exactly, in
       blocks of bounded size and without emitting a row for a pair.

    Null or empty texts have no shingles: they are classes of their own with no links. Null keys get the class of
    their text (a class of null keys only has a null class_id). Repeated rows are copies. Extra columns are ignored.
    A text is held whole in one task, with some 60 bytes of work space for each of its bytes.
    """
    longest = MAX_DEPTH
    floor = forest_depth(threshold, trees, recall, longest)
    depths = np.array([longest] + [forest_depth(least_similarity(k, threshold), trees, recall, longest) for k in range(1, 64)] + [floor], np.int8)
    signed_schema = "doc_id long, fp binary, n_shingles long, labels binary"

    def sign(batches):
        forest = Forest(trees, longest)
        for batch, data, offsets in pieces(batches, "text"):
            sets = shingle_sets(data, offsets, n)
            labels = [forest.labels(forest.signature(s)).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(labels, pa.binary())], ["doc_id", "fp", "n_shingles", "labels"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = materialize(rows.mapInArrow(sign, signed_schema), "signatures")
    reps = marks.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("labels").alias("labels"))
    reps = materialize(reps, "representatives")

    def plant(batches):
        """A row for each tree: label strings as signed numbers, whose order is the same."""
        for batch in batches:
            raw = batch.column(1)
            keys = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, 2) ^ _SIGN
            at = pa.array(np.repeat(np.arange(batch.num_rows), trees))
            depth = depths[np.minimum(batch.column(2).to_numpy(), len(depths) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int16), batch.num_rows)), pa.array(signed(np.ascontiguousarray(keys[:, 0]))), pa.array(signed(np.ascontiguousarray(keys[:, 1]))), batch.column(0).take(at), pa.array(np.repeat(depth, trees).astype(np.int16))], ["tree", "high", "low", "fp", "depth"])

    at_once = WALK_ROWS

    def walk(batches):
        """Links inside a sorted part of the tries (v not null), and at its end the first and last record of each depth (v null)."""
        held, size, first, last = [], 0, {}, {}

        def links():
            table = pa.Table.from_batches([*last.values(), *held]).combine_chunks()
            if last:  # what is carried over came before, in this order
                table = table.sort_by([(c, "ascending") for c in ("tree", "high", "low", "fp")])
            tree, depth, fp = table["tree"].to_numpy(), table["depth"].to_numpy(), table["fp"].combine_chunks()
            keys = np.stack((table["high"].to_numpy().view(np.uint64), table["low"].to_numpy().view(np.uint64)), 1) ^ _SIGN
            for k in np.unique(depth).tolist():
                at = np.flatnonzero(depth == k)
                first.setdefault(k, table.slice(at[0], 1).to_batches()[0])
                last[k] = table.slice(at[-1], 1).to_batches()[0]
            for u, v in climb(tree, keys, depth, longest):
                if len(u):
                    yield pa.RecordBatch.from_arrays([fp.take(pa.array(u)), fp.take(pa.array(v)), *[pa.nulls(len(u), t) for t in (pa.int16(), pa.int64(), pa.int64(), pa.int16())]], ["fp", "v", "tree", "high", "low", "depth"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield from links()
                held, size = [], 0
        if held:
            yield from links()
        for b in [*first.values(), *last.values()]:
            yield pa.RecordBatch.from_arrays([b["fp"], pa.nulls(1, pa.binary()), b["tree"], b["high"], b["low"], b["depth"]], ["fp", "v", "tree", "high", "low", "depth"])

    order = ["tree", "high", "low", "fp"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walk_schema = "fp binary, v binary, tree short, high long, low long, depth short"
    tries = reps.select("fp", "labels", "n_shingles").mapInArrow(plant, "tree short, high long, low long, fp binary, depth short")
    walked = materialize(tries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(walk, walk_schema), "walked")
    # Where partitions meet, their outermost records (some of each depth) are walked once more.
    edges = walked.filter("v IS NULL").select("tree", "high", "low", "fp", "depth").distinct().repartition(1).sortWithinPartitions(*order).mapInArrow(walk, walk_schema)
    stars = walked.filter("v IS NOT NULL").select(F.col("fp").alias("u"), "v").union(edges.filter("v IS NOT NULL").select("fp", "v"))
    families = components(stars).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    families = families.join(reps.drop("labels"), "fp")
    spread = families.groupBy("family").agg(F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    families = materialize(families.join(spread, "family").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")), "families")

    member_schema = "fp binary, family binary, weight long, blocks int, block int, shingles array<long>"

    def gather(batches):
        for batch, data, offsets in pieces(batches, "text"):
            sets = shingle_sets(data, offsets, n)
            keep = [i for i, (s, fp) in enumerate(zip(sets, batch.column(batch.schema.get_field_index("fp")).to_pylist())) if fingerprint(s) == fp]
            if keep:
                some, sets = batch.take(pa.array(keep)), [sets[i] for i in keep]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays(
                    [some.column(some.schema.get_field_index(c)) for c in ("fp", "family", "weight", "blocks", "block")] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(sets))))],
                    ["fp", "family", "weight", "blocks", "block", "shingles"],
                )

    # Only texts that may be members are shuffled to meet their families.
    some = may_hold(rows, families.select(F.col("rep").alias("doc_id")), "doc_id").filter("_may").drop("_may")
    held = some.join(families, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "fp", "family", "weight", "blocks", "block").mapInArrow(gather, member_schema)
    # A member meets every block of its family: with b blocks that is b rows for it, each of a bounded task.
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    held = held.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "fp")

    def verify(batches):
        current, members, seen = None, [], None

        def finish():
            split = next((k for k, m in enumerate(members) if m["block"] != members[0]["block"]), len(members)) if current[1] != current[2] else None
            if split is not None and (split == len(members) or members[0]["block"] != current[1]):
                links, roots = [0] * len(members), list(range(len(members)))
            else:
                links, roots = _verify(members, split, threshold)
            fps = [m["fp"] for m in members]
            least = {}
            for fp, r in zip(fps, roots):
                least[r] = min(fp, least.get(r, fp))
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([least[r] for r in roots], pa.binary()), pa.array(links, pa.int64()), pa.array([m["blocks"] for m in members], pa.int32())], ["fp", "root", "links", "blocks"])

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("shingles"))
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            info = batch.select(["fp", "family", "weight", "blocks", "block", "i", "j"]).to_pylist()
            for k, m in enumerate(info):
                at = (m["family"], m["i"], m["j"])
                if at != current:
                    if members:
                        yield finish()
                    current, members, seen = at, [], None
                if m["fp"] != seen:  # repeated rows bring their representative more than once
                    members.append(m | {"shingles": values[offsets[k] : offsets[k + 1]].view(np.uint64).copy()})
                    seen = m["fp"]
        if members:
            yield finish()

    found = materialize(held.mapInArrow(verify, "fp binary, root binary, links long, blocks int"), "verified")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("blocks").alias("blocks"))
    split = found.filter("blocks > 1").select(F.col("fp").alias("u"), F.col("root").alias("v"))
    joined = components(split)
    links = links.join(joined, links.fp == joined.node, "left").select("fp", "links", F.when(F.col("blocks") > 1, F.coalesce(joined.root, "fp")).otherwise(links.root).alias("root"))
    classes = reps.select("fp", "rep", "weight").join(links, "fp", "left").select("fp", "rep", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = classes.join(named, "root").select("fp", "class_id", "n_links")
    return marks.join(classes, "fp", "left").select("doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` without all but the least doc_id of each class; of repeated rows one stays. Null doc_ids without a named class stay."""
    found = near_duplicates(df, **options)
    drop = found.filter(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct()
    # Only ids that several rows carry need a pass that groups rows.
    repeated = df.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = df.select("doc_id", packed(df)).join(drop, "doc_id", "left_anti")
    # Maps have no equality: rows are compared as JSON.
    same = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256).alias("same")
    once = kept.join(repeated, "doc_id").groupBy("doc_id", same).agg(F.first("row").alias("row"))
    return unpacked(kept.join(repeated, "doc_id", "left_anti").select("row").union(once.select("row")), df.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
