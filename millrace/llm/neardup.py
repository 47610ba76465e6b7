"""Near-duplicate records with small edits (problem 7).

Count-vector R-tree. The distinct pairs of adjacent tokens of a text (its
shingles) are hashed into GROUPS groups; a text is the point of its group counts.
The overlap of two texts cannot exceed the sum of the smaller counts, group by
group, and for boxes of points the sum over their upper corners. With 128 groups this
bound leaves hardly any false pair, but boxes of unrelated texts overlap in so many
dimensions that a tree over all points would have to be searched everywhere. So the
upper levels of the tree are cells of equal minima (BANDS signatures of ROWS
minhashes each) instead of boxes; the points of a cell are packed into a tree of
pages and boxes, sort-tile order, which is joined with itself level by level. A pair of
similarity 0.7 misses all cells with probability (1 - 0.7^5)^40 = 0.0006, one of
0.8 with 1e-7.

Exact copies (equal shingle sets) are folded to classes before cells are formed.
Cells are counted by aggregation, and what a cell is known to hold goes back to its
rows by a salted join, so a cell of very many points never meets in one task: it
is split into a triangle of block pairs, and no task meets more than two blocks.
Surviving pairs are verified on the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable

GROUPS, BANDS, ROWS = 128, 40, 5
LEAST_TOKENS = 30
#: Points of a cell that are compared in one task; larger cells are split.
BLOCK = 4096
#: By default a class of exact copies up to this size is expanded into all pairs, a larger one into pairs with its smallest key.
EXPANDED = 32
#: Bits of the filter that spares re-reading texts without candidates: 16 for each text that has one, up to 16 MB. Beyond that the texts are joined.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 27
#: Tasks that share the rows of one key in a join.
SALTS = 8
#: Popular cells that are broadcast to tell their rows apart (a megabyte); if there are more, all cells' rows are dealt out.
MOST_POPULAR = 50_000
WORDS_KEPT = 1_000_000

_TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")
_SEEDS = np.random.default_rng(20).integers(1, 1 << 31, (BANDS * ROWS, 2), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


_hashes = _Hashes()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (uint64, ascending) of the texts one after another, and how many each has (0 if too short)."""
    if len(_hashes) > WORDS_KEPT:
        _hashes.clear()
    found = [_TOKEN.findall(t) if t else [] for t in texts]
    found = [[w.lower() for w in f] if len(f) >= LEAST_TOKENS else [] for f in found]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    if not counts.sum():
        return np.empty(0, np.uint64), counts * 0
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(found)), np.uint64, int(counts.sum()))
    of = np.repeat(np.arange(len(texts)), counts)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pair ^= pair >> np.uint64(29)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(32)
    same = of[1:] == of[:-1]
    pair, of = pair[same], of[1:][same]
    order = np.lexsort((pair, of))
    pair, of = pair[order], of[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
    return pair[new], np.bincount(of[new], minlength=len(texts))


def _signatures(pair: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys of each text."""
    low, high = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pair >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for i, (a, b) in enumerate(_SEEDS):
        x = (low * a) ^ (high * b)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        keys[:, i // ROWS] = keys[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, starts)
    keys += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    return (keys * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _classes(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of each text's shingle set; every text has some."""
    mixed = (pair ^ (pair >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (np.add.reduceat(mixed ^ (mixed >> np.uint64(27)), np.cumsum(n) - n) + n.astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(values.ravel()))


def points(texts: DataFrame) -> DataFrame:
    """id, cls (hash of the shingle set), n, counts (BINARY, GROUPS bytes), bands of each text long enough; from id, text.

    A class met again in the same task has no bands: its cells are known already.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                pair, n = shingles(part.column(1).to_pylist())
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                n = n[rows]
                starts = np.cumsum(n) - n
                cls = _classes(pair, n)
                place = np.repeat(np.arange(len(rows)), n) * GROUPS + (pair >> np.uint64(40)).astype(np.int64) % GROUPS
                counts = np.minimum(np.bincount(place, minlength=len(rows) * GROUPS), 255).astype(np.uint8).reshape(-1, GROUPS)
                fresh = np.zeros(len(rows), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        fresh[i] = True
                        seen.add(c)
                if len(seen) > WORDS_KEPT:
                    seen.clear()
                keys = np.zeros((len(rows), BANDS), np.int64)
                if fresh.any():
                    wanted = np.repeat(fresh, n)
                    keys[fresh] = _signatures(pair[wanted], np.cumsum(n[fresh]) - n[fresh])
                sizes = np.where(fresh, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys[fresh].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(cls), pa.array(n, pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary()), bands], names=["id", "cls", "n", "counts", "bands"]
                )

    return texts.mapInArrow(run, "id string, cls bigint, n int, counts binary, bands array<bigint>")


def _packed(n: np.ndarray, counts: np.ndarray, page: int) -> np.ndarray:
    """Points in sort-tile order: slices of like size, within a slice by a fixed random direction, so that a page's points are alike."""
    order = np.argsort(n, kind="stable")
    width = page * max(1, int(np.ceil(np.sqrt(len(n) / page))))
    along = counts @ np.random.default_rng(4).normal(size=counts.shape[1])
    return np.concatenate([part[np.argsort(along[part], kind="stable")] for part in np.split(order, range(width, len(n), width))])


def page_pairs(n: np.ndarray, counts: np.ndarray, threshold: float, page: int = 32, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points whose summed minima allow `threshold`: the packed tree joined with itself from the root down. Counts of 255 are unbounded."""
    share = threshold / (1 + threshold)
    counts = np.where(counts == 255, 60_000, counts).astype(np.int32)
    order = _packed(n, counts, page) if len(n) > page else np.arange(len(n))
    n, counts = n[order], counts[order]
    levels = [(n, n, counts)]  # least size, most size and upper corner of each node, points first
    while len(levels[-1][0]) > 1:
        least, most, upper = levels[-1]
        begin = np.arange(0, len(least), page if len(levels) == 1 else fan)
        levels.append((np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin), np.maximum.reduceat(upper, begin, axis=0)))
    i = j = np.zeros(1, np.int64)
    for level in range(len(levels) - 2, -1, -1):
        least, most, upper = levels[level]
        width = page if level == 0 else fan
        step = max(1, 200_000 // (width * width))
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, len(i), step):
            x = i[at : at + step, None] * width + np.arange(width)
            y = j[at : at + step, None] * width + np.arange(width)
            x, y = (np.broadcast_to(v, (len(x), width, width)).ravel() for v in (x[:, :, None], y[:, None, :]))
            fits = (x < len(least)) & (y < len(least)) & ((x < y) if level == 0 else (x <= y))
            x, y = x[fits], y[fits]
            fits = (least[y] * threshold <= most[x] + 1e-9) & (least[x] * threshold <= most[y] + 1e-9)
            x, y = x[fits], y[fits]
            fits = np.minimum(upper[x], upper[y]).sum(1) >= share * (least[x] + least[y]) - 1e-9
            kept.append((x[fits], y[fits]))
        i, j = (np.concatenate(v) for v in zip(*kept))
    if len(levels) == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[i], order[j]


def _cell_pairs(cells: DataFrame, threshold: float) -> DataFrame:
    """a, b (classes, a < b) of the candidate pairs of different families in each cell; cells (cell, cls, family, n, counts) come sorted, one after another."""

    def pairs(cls: np.ndarray, family: np.ndarray, n: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]  # most cells: all at once
        if len(two):
            least = np.minimum(np.where(counts[two] == 255, 60_000, counts[two]).astype(np.int32), np.where(counts[two + 1] == 255, 60_000, counts[two + 1])).sum(1)
            two = two[least >= threshold / (1 + threshold) * (n[two] + n[two + 1]) - 1e-9]
            left.append(two), right.append(two + 1)
        for a, b in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist()):
            x, y = page_pairs(n[a:b], counts[a:b], threshold)
            left.append(a + x), right.append(a + y)
        i, j = np.concatenate(left), np.concatenate(right)
        other = family[i] != family[j]
        i, j = cls[i[other]], cls[j[other]]
        pair = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last cell of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(4)] + [np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, GROUPS)]
            if rest:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            edges = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            done = int(edges[-1]) if len(edges) else 0
            if done:
                yield pairs(*(c[:done] for c in columns[1:]), np.concatenate([[0], edges]))
            rest = [c[done:] for c in columns]
        if rest:
            yield pairs(*rest[1:], np.array([0, len(rest[0])]))

    return cells.mapInArrow(run, "a bigint, b bigint")


def _salted(rows: DataFrame, spread: str, known: DataFrame, key: str) -> DataFrame:
    """`rows` joined with `known`, which has one row for each key; the rows of one key are dealt to SALTS tasks by `spread`."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"]).drop("salt")


def _keyed(points: DataFrame) -> DataFrame:
    """cls, family and key of the cells of each class. A class that several tasks met stands more than once."""
    return points.select("cls", "family", F.explode("bands").alias("key"))


def _in_cells(rows: DataFrame, classes: DataFrame) -> DataFrame:
    cells = rows.join(classes.select("cls", "family", "n", "counts"), "cls").select("cell", "cls", "family", "n", "counts")
    return cells.repartition("cell").sortWithinPartitions("cell")


def _cell_candidates(points: DataFrame, classes: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """Candidate pairs of different families within all cells. If not `whole`, cells of one family only are passed over first."""
    keyed = _keyed(points)
    if whole:  # each class its own family: what stands alone is most of the cells
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    else:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("family").alias("least"), F.max("family").alias("most")).where("least <> most").select("key", "size")
    sizes = durable(sizes)
    popular = sizes.where(F.col("size") > BLOCK).select("key")
    if popular.count() <= MOST_POPULAR:  # they alone are dealt to several tasks
        popular = F.broadcast(popular.withColumn("popular", F.lit(True)))
        salt = F.when(F.col("popular"), F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        dealt = keyed.select("key", "cls").join(popular, "key", "left").withColumn("salt", salt).drop("popular")
        copies = F.explode(F.when(F.col("size") > BLOCK, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        routed = dealt.join(sizes.withColumn("salt", copies), ["key", "salt"]).drop("salt")
    else:
        routed = _salted(keyed.select("key", "cls"), "cls", sizes, "key")
    routed = routed.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    routed = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return _cell_pairs(_in_cells(routed.select(cell.alias("cell"), "cls").distinct(), classes), threshold).distinct()


def _hub_candidates(points: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of each class and the smallest one of each of its cells: at most BANDS a class."""
    keyed = _keyed(points).select("key", "cls")
    hubs = keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("most")).where("hub < most").select("key", "hub")
    pairs = _salted(keyed, "cls", hubs, "key").where("cls <> hub").select("hub", "cls").distinct()
    pairs = pairs.select(F.xxhash64("hub", "cls").alias("cell"), F.explode(F.array("hub", "cls")).alias("cls"))
    return _cell_pairs(_in_cells(pairs, classes), threshold).distinct()


def _sieve(ends: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits with those of the ids in `ends`, put together as bitmaps of 32,768 bits."""
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ends.select((bit / 32768).cast("int").alias("place"), (bit % 32768).alias("bit")).groupBy("place").agg(F.bitmap_construct_agg("bit").alias("map")).toArrow()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for place, bitmap in zip(maps["place"].to_pylist(), maps["map"].to_pylist()):
        out[place] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def _verified(texts: DataFrame, found: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the candidates that reach the threshold, by the shingles of the texts that stand for their classes: those of smallest id."""
    candidates = durable(candidates)
    first = found.groupBy("cls").agg(F.min("id").alias("id"))
    ends = durable(candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(first, "cls"))
    wanted = ends.count()
    bits = max(LEAST_BITS, 1 << (16 * wanted).bit_length())
    if bits <= MOST_BITS:
        sieve = texts.sparkSession.sparkContext.broadcast(_sieve(ends, bits))
    else:
        sieve, texts = None, texts.join(ends.select("id").distinct(), "id", "left_semi")

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sieve is not None:
                bit = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((sieve.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                pair, n = shingles(part.column(1).to_pylist())
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                n = n[rows]
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(pair.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_classes(pair, n)), sets], names=["cls", "s"])

    sets = texts.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("bit")).mapInArrow(again, "cls bigint, s array<bigint>")
    # an id may come with several contents: each stands for its own class
    sets = sets.groupBy("cls").agg(F.first("s").alias("s"))
    both = candidates.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared")))
    return both.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def _class_points(found: DataFrame) -> DataFrame:
    """cls, id, n and counts of each class, by the smallest of its ids; each its own family."""
    return found.groupBy("cls").agg(F.min(F.struct("id", "n", "counts")).alias("p")).select("cls", "p.*", F.col("cls").alias("family"))


def class_links(texts: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of all pairs of classes of `found` (points of `texts`: id, text) that reach the threshold."""
    classes = _class_points(found)
    return _verified(texts, found, _cell_candidates(found.withColumn("family", F.col("cls")), classes, threshold, True), threshold)


def components(links: DataFrame) -> DataFrame:
    """cls, label (smallest class of its component) of each class in `links` (a, b).

    Labels go to the smallest neighbour, then to that one's own label, until none changes; each round is a written
    table. Classes that very many others are linked to, and labels that very many have, are joined salted.
    """
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = edges.select(F.col("a").alias("cls")).distinct().withColumn("label", F.col("cls"))
    while True:
        near = _salted(edges.select("a", F.col("b").alias("cls")), "a", labels, "cls").groupBy("a").agg(F.min("label").alias("near"))
        step = durable(labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed")))
        if step.where("changed").isEmpty():
            return step.select("cls", "label")
        used = step.select("label").distinct()
        jump = step.select(F.col("cls").alias("label"), F.col("label").alias("further")).join(used, "label", "left_semi")
        labels = durable(_salted(step.select("cls", "label"), "cls", jump, "label").select("cls", F.least("label", "further").alias("label")))


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))


def near_pairs(df: DataFrame, key: str = "chunk_id", text: str = "content", threshold: float = 0.7, expanded: int | None = EXPANDED) -> DataFrame:
    """a, b (keys as strings, a < b): texts that share at least `threshold` of their distinct shingles.

    Texts below 30 tokens, null and blank ones, and rows with null keys are left out.
    Repeated rows count once. With `expanded` None all pairs come out, whatever the size of a class of equal
    shingle sets. Else classes of more than `expanded` members stand in pairs with other texts by their smallest
    key, and hold that key in a pair with each member. An empty table gives an empty table.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    texts = _prepared(df, key, text)
    found = durable(points(texts))
    links = class_links(texts, found, threshold)
    members = found.select("cls", "id").distinct()
    classes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    whole = F.lit(True) if expanded is None else F.col("copies") <= expanded
    # members of a large class are split into blocks, so no task meets more than two blocks of a class
    classes = classes.withColumn("blocks", F.when(whole, F.ceil(F.col("copies") / BLOCK)).otherwise(1).cast("int"))
    named = members.join(classes, "cls").where(whole | (F.col("id") == F.col("first"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sizes = classes.select("cls", F.sequence(F.lit(0), F.col("blocks") - 1).alias("each"))
    across = links
    for c in "ab":
        across = across.join(sizes.withColumnRenamed("cls", c), c).withColumn(f"block_{c}", F.explode("each")).drop("each")
    for c in "ab":
        across = across.join(named.select(F.col("cls").alias(c), F.col("block").alias(f"block_{c}"), F.col("id").alias(f"id_{c}")), [c, f"block_{c}"])
    across = across.select("id_a", "id_b")
    several = named.where(whole & (F.col("copies") > 1)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = several.select("cls", F.col("block").alias("block_a"), F.col("other").alias("block_b"), F.col("id").alias("id_a"))
    two = several.select("cls", F.col("other").alias("block_a"), F.col("block").alias("block_b"), F.col("id").alias("id_b"))
    within = one.join(two, ["cls", "block_a", "block_b"]).where("id_a < id_b").select("id_a", "id_b")
    star = members.join(classes.where(~whole), "cls").where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    every = across.unionByName(within).unionByName(star).where("id_a <> id_b")
    return every.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_groups(df: DataFrame, key: str = "chunk_id", text: str = "content", threshold: float = 0.7) -> DataFrame:
    """id, group_id (smallest key of its group), copies (texts of its shingle set, itself included) of each text long enough.

    Groups are connected components of classes over the links, found in two steps, so that a family of very many
    near copies is not listed pair by pair: links of each class to the smallest class of each of its cells make
    families first; then only pairs of different families are searched. Texts below 30 tokens, null and blank ones, and rows
    with null keys are left out. A key with several contents has a row for each of their groups.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    texts = _prepared(df, key, text)
    found = durable(points(texts))
    classes = _class_points(found)
    stars = durable(_verified(texts, found, _hub_candidates(found.withColumn("family", F.col("cls")), classes, threshold), threshold).select("a", "b"))
    families = components(stars)
    related = classes.drop("family").join(families.withColumnRenamed("label", "family"), "cls", "left").withColumn("family", F.coalesce("family", "cls"))
    others = durable(_verified(texts, found, _cell_candidates(found.join(related.select("cls", "family"), "cls"), related, threshold, False), threshold).select("a", "b"))
    labels = families if others.isEmpty() else components(stars.unionByName(others))

    members = found.select("cls", "id").distinct()
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    sizes = sizes.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = sizes.groupBy("label").agg(F.min("first").alias("group_id"))
    sizes = _salted(sizes, "cls", names, "label").select("cls", "group_id", "copies")
    return _salted(members, "id", sizes, "cls").select("id", "group_id", "copies").distinct()
