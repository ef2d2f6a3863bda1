"""N-gram Jaccard join by signature trees: connected classes of documents with similar shingle sets.

1. Each distinct shingle set becomes one class (copies need no further work).
2. Any two sets of Jaccard similarity at least t share one of their first n - ceil(t n) + 1 shingles
   in a global order, here by rarity and then hash. Classes meet in a block for each such shingle; of blocks
   with the same members one is kept.
3. In a block, a signature tree over the classes' token bitmaps and sizes is walked against itself;
   node pairs that can't reach the overlap are pruned. What is left is a candidate; candidates are
   reduced to a spanning forest at once, and their components are small groups of plausible links.
4. Each group meets again with its whole shingle sets; the same walk verifies pairs exactly, leaving out
   those that are connected already. Components of the verified links are the result.

Blocks and groups of more than SPLIT members are dealt over pairs of sub-blocks, so a task holds at
most two sub-blocks, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, saved, sliced
from framewright.llm.components import components
from framewright.llm.shingles import frequent, shingle_sets

#: Children of a tree node.
FAN = 16
#: Bits of the bitmap of a set of up to as many shingles; larger sets get the next power of two, to MOST_BITS.
LEAST_BITS, MOST_BITS = 1024, 1 << 15
#: Members from which a block is dealt over pairs of sub-blocks.
SPLIT = 4096
#: Most members of plausible groups (rows of three numbers, 48 bytes each) that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18


def bitmap(hashes: np.ndarray) -> bytes:
    width = LEAST_BITS
    while width < min(len(hashes), MOST_BITS):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the least width among them."""
    width = min(map(len, maps)) // 8
    rows = []
    for one in maps:
        words = np.frombuffer(one, np.uint64)
        rows.append(words if len(words) == width else np.bitwise_or.reduce(words.reshape(-1, width)))
    return np.array(rows)


class SignatureTree:
    """Levels of nodes over items in order of size: OR-combined bitmaps, size ranges, and the most shingles that share bits."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def survivors(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes a x b may hold a link, by the sizes and by the largest overlap that the bitmaps allow."""
        maps, low, high, excess = self.levels[level]
        la, ha, lb, hb = low[a][:, None], high[a][:, None], low[b][None, :], high[b][None, :]
        may = (100 * ha >= percent * lb) & (100 * hb >= percent * la)
        i, j = np.nonzero(may)
        if len(i):
            common = np.bitwise_count(maps[a[i]] & maps[b[j]]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a[i]], excess[b[j]])
            most = np.minimum(common, np.minimum(high[a[i]], high[b[j]]))
            may[i, j] = most * (100 + percent) >= percent * (low[a[i]] + low[b[j]])
        return may


def link(sizes: np.ndarray, maps: np.ndarray, percent: int, check: Callable[[int, int], bool] | None, labels: np.ndarray, at: np.ndarray) -> None:
    """Join the labels of linked items among those at places `at`, sorted by size, by dual traversal of their signature tree.

    `check` decides a pair of places that the tree can't prune; None takes it. Pairs and node pairs whose
    items are connected already are left out. labels are changed in place.
    """
    tree = SignatureTree(sizes, maps)
    top = len(tree.levels) - 1
    stack = [(top, 0, 0)] if len(sizes) > 1 else []
    while stack:
        level, a, b = stack.pop()
        span = FAN**level
        la, lb = labels[at[a * span : (a + 1) * span]], labels[at[b * span : (b + 1) * span]]
        if (la == la[0]).all() and (lb == la[0]).all():
            continue
        level -= 1
        count = len(tree.levels[level][1])
        i, j = np.arange(a * FAN, min(count, (a + 1) * FAN)), np.arange(b * FAN, min(count, (b + 1) * FAN))
        may = tree.survivors(level, i, j, percent)
        if a == b:
            may = np.triu(may, 1 if level == 0 else 0)
        for x, y in zip(*np.nonzero(may), strict=True):
            p, q = int(i[x]), int(j[y])
            if level:
                stack.append((level, p, q))
                continue
            p, q = int(at[p]), int(at[q])
            if labels[p] != labels[q] and (check is None or check(p, q)):
                one, other = labels[p], labels[q]
                labels[labels == max(one, other)] = min(one, other)


def linked(sizes: np.ndarray, maps: list[bytes], percent: int, check: Callable[[int, int], bool] | None) -> np.ndarray:
    """Labels of the components of links among items sorted by size.

    Items whose bitmaps have one width share a tree, so large sets aren't folded to a width at which they
    fill it. Items of two widths meet, at the lesser one, if their sizes are near enough for a link.
    """
    labels = np.arange(len(sizes))
    widths = np.array([len(m) for m in maps])
    places = [np.flatnonzero(widths == w) for w in np.unique(widths)]
    for k, own in enumerate(places):
        link(sizes[own], folded([maps[i] for i in own]), percent, check, labels, own)
        for other in places[k + 1 :]:
            near = own[100 * sizes[own] >= percent * sizes[other].min()]
            far = other[percent * sizes[other] <= 100 * sizes[own].max()]
            if len(near) and len(far):
                both = np.concatenate([near, far])
                both = both[np.argsort(sizes[both], kind="stable")]
                link(sizes[both], folded([maps[i] for i in both]), percent, check, labels, both)
    return labels


def _digests(sets: list[np.ndarray]) -> dict:
    """n, s1, s2: size and 128-bit digest of each set."""
    found = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
    return {"n": [len(x) for x in sets]} | {name: [int.from_bytes(x[at : at + 8], "little", signed=True) for x in found] for name, at in (("s1", 0), ("s2", 8))}


def digested(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, s1, s2): size and 128-bit digest of each row's shingle set."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0)} | _digests(shingle_sets(batch.column(1), width))

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n int, s1 long, s2 long")


def shingled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """digested, and the set's first shingles by rarity (keys) and its bitmap (bits)."""
    common = frequent(documents, width)

    def run(batch: pa.RecordBatch) -> dict:
        sets, keys = shingle_sets(batch.column(1), width), []
        for found in sets:
            first = len(found) - -(-percent * len(found) // 100) + 1 if len(found) else 0
            if len(common) and len(found):
                often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
                ordered = np.concatenate([found[~often], found[often]])[:first]
            else:
                ordered = found[:first]
            keys.append(ordered.view(np.int64))
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys), pa.int64()))
        return {"doc_id": batch.column(0), "keys": lists, "bits": [bitmap(x) for x in sets]} | _digests(sets)

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n int, s1 long, s2 long, keys array<long>, bits binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(c[low] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def dealt(members: DataFrame, key: str, node: str, split: int = SPLIT) -> DataFrame:
    """Members with columns a and b: those of a key with at most `split` members are one sub-block (0, 0); of
    a larger one, each goes with its part to every pair of parts that has it. Needs a column m, the key's members."""
    parts = F.ceil(F.col("m") / split).cast("int")
    part = F.pmod(F.xxhash64(node), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    spread = members.withColumn("part", part).withColumn("other", other)
    return spread.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("part", "other", "m")


def _forest(nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each item to the first of its component, where that is another."""
    roots = nodes[labels]
    moved = labels != np.arange(len(labels))
    return nodes[moved], roots[moved]


def plausible(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of a spanning forest of the pairs that the signature trees can't prune, of rows (key, a, b, n, rep, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, size = [], [], 0
        for block in grouped(sliced(batches, 1 << 14), 3):
            if block.num_rows < 2:
                continue
            sizes = block.column("n").to_numpy().astype(np.int64)
            nodes = block.column("rep").to_numpy()
            labels = linked(sizes, block.column("bits").to_pylist(), percent, None)
            one, other = _forest(nodes, labels)
            u.append(one)
            v.append(other)
            size += len(one)
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
                u, v, size = [], [], 0
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return blocks.select("key", "a", "b", "n", "rep", "bits").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "n", "rep").mapInArrow(run, "u long, v long")


def verified(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of a spanning forest of the exact links, of rows (root, a, b, n, rep, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(sliced(batches), 3):
            if block.num_rows < 2:
                continue
            sizes = block.column("n").to_numpy().astype(np.int64)
            nodes = block.column("rep").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("hashes")]

            def check(i: int, j: int, sets: list = sets) -> bool:
                one, other = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                common = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
                return 100 * common >= percent * (len(one) + len(other) - common)

            labels = linked(sizes, [bitmap(x) for x in sets], percent, check)
            one, other = _forest(nodes, labels)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], ["u", "v"])

    return groups.select("root", "a", "b", "n", "rep", "hashes").repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "n", "rep").mapInArrow(run, "u long, v long")


def distinct_blocks(entries: DataFrame) -> DataFrame:
    """(key, rep, m) of the blocks of entries (rep, key) that have m > 1 members; of blocks with the same members, by two hashes over them, one.

    Similar sets share many shingles, so their blocks would bring the same bitmaps together again and again.
    """
    live = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = saved(entries.join(live, "key").select("key", "rep", "m"), "blocks")
    members = blocks.groupBy("key").agg(F.first("m").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("f1"), F.bit_xor(F.xxhash64("rep", F.lit("again"))).alias("f2"))
    kept = members.groupBy("m", "f1", "f2").agg(F.min("key").alias("key")).select("key")
    return blocks.join(kept, "key")


def similar_classes(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text).

    A row's set is its distinct `width`-word shingles (see `shingles`); with fewer words, the whole
    sequence is one; a null, empty or blank text has none and links with nothing. Two rows link when
    100 * |intersection| >= percent * |union|. component_id is the least doc_id that links reach, its own
    included. Rows of one id count as one document. A null id keeps its row with a null component and
    links nothing. Other columns don't matter; an empty table gives no rows.
    """
    rows = saved(digested(documents, width), "digested")
    used = shingled(documents, width, percent).filter("n > 0 AND doc_id IS NOT NULL")
    digest = ["n", "s1", "s2"]
    classes = saved(used.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "classes")
    blocks = distinct_blocks(classes.select("rep", F.explode("keys").alias("key"))).join(classes.select("rep", "n", "bits"), "rep")
    edges = plausible(dealt(blocks, "key", "rep"), percent)
    near = saved(components(edges), "near")

    counted = near.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    wanted = near.join(counted, "root").withColumnRenamed("node", "rep")
    if near.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def sets(batch: pa.RecordBatch) -> dict:
        found = shingle_sets(batch.column(3), width)
        return {"root": batch.column(0), "rep": batch.column(1), "m": batch.column(2), "n": [len(x) for x in found], "hashes": [memoryview(x).cast("B") for x in found]}

    texts = wanted.join(documents.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep IS NOT NULL"), "rep").select("root", "rep", "m", "text")
    groups = arrow_map(texts, sets, "root long, rep long, m long, n int, hashes binary")
    roots = components(verified(dealt(groups, "root", "rep"), percent))

    named = classes.select(*digest, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, F.coalesce("root", "rep").alias("component_id"))
    return rows.select("doc_id", *digest).join(named, digest, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents that stand for their component: those with its least doc_id; of rows of one
    id the one with the least text (null first), of equal texts that with the least other columns, in whatever order rows come. Rows with a null id stay."""
    found = similar_classes(documents, width, percent)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in documents.columns]
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")))
    known = documents.filter("doc_id IS NOT NULL").select("doc_id", F.struct("text", others.alias("others")).alias("order"), F.struct(*columns).alias("row"))
    known = known.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return known.unionByName(documents.filter("doc_id IS NULL")).select(columns)
