"""N-gram Jaccard self-join by signature trees with dual traversal.

Equal shingle sets are one set. Sets that could be similar are brought together losslessly: a
set is cut by hash into so many parts that two similar sets must agree on a known number of them, and sets that
agree on too few, such as texts that share no more than a passage, do not meet. The connected groups of that relation
are the blocks; each is searched with signature trees, whose nodes hold the OR of their members' shingle bitmaps and their range of sizes. Pairs of nodes are pruned by the
largest overlap they allow; what reaches the leaves is verified on whole sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, join_repeated, read, text_of
from .components import components

#: A pair is similar if 100 * intersection >= PERCENT * union.
PERCENT = 90
WIDTH = 3
FANOUT = 8
#: Parts beyond the fewest that would do: a third of the differences, this many at least; see set_parts and set_blocks.
SPARE = 3
#: Sets up to which the pairs of a part key are listed; with more the key is frequent.
LISTED = 4
#: Shingles and sets of a block that one task holds; larger blocks are cut into pairs of sub-trees.
TASK_SHINGLES = 4_000_000
TASK_SETS = 8192
KNOWN_WORDS = 1_000_000
#: Sets in blocks up to which their rows are named to every task; beyond, all texts are shuffled once.
BROADCAST_SETS = 1_000_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def finished(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sorted 64-bit hashes of their distinct shingles."""

    def __init__(self, width: int):
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                self[word] = value = xxhash.xxh3_64_intdigest(word)
                return value

        self.words, self.width = Words(), width

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII rules on bytes
        if not tokens:
            return np.zeros(0, np.uint64)
        ids = np.fromiter(map(self.words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        width = min(self.width, len(ids))
        out = np.full(len(ids) - width + 1, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                out = finished(out * M1 + ids[i : len(ids) - width + 1 + i])
        return np.unique(out)


def bands(most: int) -> list[int]:
    """First sizes of the size bands, each a third larger than the one before."""
    firsts = [1]
    while firsts[-1] <= most:
        firsts.append(max(firsts[-1] + 1, firsts[-1] * 4 // 3))
    return firsts


FIRSTS = np.array(bands(1 << 40), dtype=np.int64)


def schemes(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, most differences) by which a set of `size` is cut: its own band's, and that of the one
    below if a smaller partner may lie there.

    Similar sets of sizes a <= b differ in at most (a + b)(100 - p) / (100 + p) shingles, and
    b <= 100 a / p makes that a (100 - p) / p, largest for the last size of the band.
    """
    own = int(np.searchsorted(FIRSTS, size, side="right")) - 1
    out = [own]
    if own and -(-percent * size // 100) < FIRSTS[own]:
        out.append(own - 1)
    return [(band, int(FIRSTS[band + 1] - 1) * (100 - percent) // percent) for band in out]


def set_parts(shingles: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, slack, keys) per scheme; a key per part, equal for sets that agree on the part, its lowest bit that of the band.

    With `most` differences and most + 1 + spare parts, similar sets agree on more than spare
    parts. If either has at most spare empty parts, one of those is not empty; so only sets with
    more empty parts give keys for these, which would else bring unlike sets together. The slack is
    spare less the empty parts: similar sets share more keys than the slack of either, and one at least.
    """
    out = []
    with np.errstate(over="ignore"):
        mixed = finished(shingles * M3)
        for band, most in schemes(len(shingles), percent):
            spare = max(SPARE, most // 3) if most else 0
            parts = most + 1 + spare
            sums = np.zeros(parts, dtype=np.uint64)
            place = ((shingles >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            np.add.at(sums, place, mixed)
            named = finished(finished(sums + np.arange(parts, dtype=np.uint64) * M1) + np.uint64(band) * M2)
            named = (named & ~np.uint64(1)) | np.uint64(band & 1)
            filled = np.bincount(place, minlength=parts) > 0
            empty = int((~filled).sum())
            out.append((band, spare - empty, (named if empty > spare else named[filled]).view(np.int64)))
    return out


def part_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The keys of all schemes of a set."""
    return np.concatenate([keys for _, _, keys in set_parts(shingles, percent)])


SETS = pa.schema(
    [("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary())]
    + [("odd", pa.int32()), ("slack", pa.int32()), ("slack_below", pa.int32()), ("keys", pa.list_(pa.int64()))]
)
#: Sets of which a task remembers that it has given their part keys already.
SEEN_SETS = 1 << 17


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingle_sets(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row its number of shingles, the name of its set, and its part keys (none for an empty set or one this task has met before).

    `odd` is the lowest bit of its own band; the slacks are those of its own scheme and of the one below, if it has that.
    """

    def run(batches):
        shingle, seen = Shingler(width), set()
        for batch in batches:
            sizes, names, cuts = [], [], []
            for text in batch.column("text"):
                shingles = shingle(text.as_py())
                name = set_name(shingles) if len(shingles) else None
                sizes.append(len(shingles))
                names.append(name)
                cuts.append([] if name is None or name in seen else set_parts(shingles, percent))
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(name)
            odd = pa.array([c[0][0] & 1 if c else None for c in cuts], pa.int32())
            slacks = [pa.array([c[i][1] if len(c) > i else None for c in cuts], pa.int32()) for i in (0, 1)]
            keys = pa.array([np.concatenate([k for _, _, k in c]) if c else [] for c in cuts], pa.list_(pa.int64()))
            arrays = [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), odd, *slacks, keys]
            yield pa.RecordBatch.from_arrays(arrays, schema=SETS)

    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, set_id binary, odd int, slack int, slack_below int, keys array<long>")


class Tree:
    """Sets in order of size; every node of every level has a bitmap, a size range and the most bits its members share."""

    def __init__(self, sets: list[np.ndarray], at: np.ndarray, bits: int):
        self.at = at  # places of the sets in the task, ordered by size
        rows = np.zeros((len(at), bits // 8), dtype=np.uint8)
        for row, i in enumerate(at):
            flags = np.zeros(bits, dtype=np.uint8)
            flags[sets[i] % np.uint64(bits)] = 1
            rows[row] = np.packbits(flags)
        maps = rows.view(np.uint64)
        sizes = np.array([len(sets[i]) for i in at])
        folded = sizes - np.bitwise_count(maps).sum(1)  # shingles lost to shared bits
        self.levels = [(maps, sizes, sizes, folded)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, folded = self.levels[-1]
            cuts = np.arange(0, len(maps), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(folded, cuts))
            )

    def members(self, level: int, i: int) -> np.ndarray:
        span = FANOUT**level
        return self.at[i * span : (i + 1) * span]

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][0])))


def may_link(a: tuple, i: int, b: tuple, j: int, percent: int) -> bool:
    """Whether the largest overlap of a member of node i with one of node j can be enough."""
    if 100 * a[2][i] < percent * b[1][j] or 100 * b[2][j] < percent * a[1][i]:
        return False
    need = -(-percent * (a[1][i] + b[1][j]) // (100 + percent))
    shared = int(np.bitwise_count(a[0][i] & b[0][j]).sum()) + min(a[3][i], b[3][j])
    return min(shared, a[2][i], b[2][j]) >= need


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what the similar pairs of the sets connect.

    `first` and `second` are the places of two groups of sets; without `second` the pairs lie
    inside `first`. Node pairs whose members are all connected already are not entered.
    """
    bits = 64
    while bits < min(2 * max(len(s) for s in sets), 1 << 16):
        bits *= 2
    by_size = lambda at: at[np.argsort([len(sets[i]) for i in at], kind="stable")]
    one = Tree(sets, by_size(first), bits)
    two = one if second is None else Tree(sets, by_size(second), bits)
    label, found = np.arange(len(sets)), []
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if one is two and la == lb == 0 and i == j:
            continue
        if not (one is two and la == lb and i == j) and not may_link(one.levels[la], i, two.levels[lb], j, percent):
            continue
        mine, theirs = one.members(la, i), two.members(lb, j)
        labels = label[mine[0]]
        if (label[mine] == labels).all() and (label[theirs] == labels).all():
            continue
        if la == 0 and lb == 0:
            a, b = int(mine[0]), int(theirs[0])
            if similar(sets[a], sets[b], percent):
                found.append((a, b))
                label[label == label[b]] = labels
        elif one is two and la == lb and i == j:
            kids = one.children(la, i)
            stack += [(la - 1, x, la - 1, y) for x in reversed(kids) for y in reversed(kids) if x <= y]
        elif la >= lb:
            stack += [(la - 1, x, lb, j) for x in reversed(one.children(la, i))]
        else:
            stack += [(la, i, lb - 1, y) for y in reversed(two.children(lb, j))]
    return found


def with_cuts(members: DataFrame) -> DataFrame:
    """The members with `_k`, into how many chunks their block must be cut; blocks of several are fewer than the sets by TASK_SETS."""
    sums = members.groupBy("block").agg(F.sum("n_shingles").alias("_s"), F.count("*").alias("_n"))
    cut = F.greatest(F.ceil(F.col("_s") / TASK_SHINGLES), F.ceil(F.col("_n") / TASK_SETS)).cast("int")
    large = sums.select("block", cut.alias("_k")).where("_k > 1")
    if large.count() <= BROADCAST_SETS:
        large = F.broadcast(large)
    return members.join(large, "block", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))


def by_size(members: DataFrame, percent: int) -> DataFrame:
    """Blocks beyond one task become a block per size band, which holds the sets of the band and of the next.

    Similar sets are at most 100 / percent apart in size, so they lie in one band or in neighbouring ones; a set goes
    to two blocks instead of to as many tasks as its block has chunks.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100.0001 / percent))
    both = F.explode(F.when(F.col("_k") > 1, F.array(band, band - 1)).otherwise(F.array(F.lit(-2).cast("long"))))
    split = with_cuts(members).withColumn("_g", both)
    return split.select("node", F.when(F.col("_g") == -2, F.col("block")).otherwise(F.xxhash64("block", "_g")).alias("block"), "n_shingles", "set_id", "text")


def tree_links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of the same block.

    `members`: node, block, n_shingles, set_id and text of the sets to search. A block within
    TASK_SHINGLES and TASK_SETS is one tree in one task. A larger one is dealt by hash into k chunks and every
    pair of chunks, a pair of sub-trees, is a task of its own.
    """
    placed = with_cuts(by_size(members, percent))
    mine = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    dealt = placed.withColumn("_c", mine).withColumn("_o", other).select(
        "block", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), F.col("_c").alias("c"), "node", "set_id", "text"
    )
    order = ["block", "i", "j"]
    tasks = dealt.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order, "node")

    def search(key, rows, shingle):
        nodes, chunks, sets = [], [], []
        for node, c, name, text in rows:
            shingles = shingle(text)
            if (not nodes or nodes[-1] != node) and set_name(shingles) == name:  # not a hash twin of the row key
                nodes.append(node)
                chunks.append(c)
                sets.append(shingles)
        chunk, n = np.array(chunks), np.arange(len(nodes))
        first, second = (n, None) if key[1] == key[2] else (n[chunk == key[1]], n[chunk == key[2]])
        if len(first) and (second is None or len(second)):
            return [(nodes[a], nodes[b]) for a, b in links(sets, first, second, percent)]
        return []

    def run(batches):
        shingle, key, rows = Shingler(width), None, []
        empty = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        out = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "i", "j", "node", "c", "set_id", "text")]
            for block, i, j, *rest in zip(*columns):
                if key != (block, i, j):
                    if rows:
                        out += search(key, rows, shingle)
                    key, rows = (block, i, j), []
                rows.append(rest)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=empty)
                out = []
        if rows:
            out += search(key, rows, shingle)
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=empty)

    return tasks.mapInArrow(run, "a long, b long")


def set_number() -> Column:
    """48 bits of a set's name."""
    return F.shiftrightunsigned(F.xxhash64("set_id"), 16)


def shared_parts(keyed: DataFrame) -> DataFrame:
    """(frequent, a, b): pairs of schemes that share a key of at most LISTED, once per key, and (scheme, key) of the keys that more schemes have.

    A scheme is a set in one band: twice the set's number, plus the band's lowest bit. Keys are shuffled straight from the
    rows; each task has given those of a set once.
    """
    exploded = keyed.where("set_id is not null").select(set_number().alias("node"), F.explode("keys").alias("key"))
    schemed = exploded.select("key", (F.col("node") * 2 + F.col("key").bitwiseAND(F.lit(1))).alias("a"))
    inside = Window.partitionBy("key").orderBy("a")
    around = schemed.withColumn("_before", F.lag("a").over(inside)).withColumn("_after", F.lead("a").over(inside))
    met = around.where("(_before is null and _after is not null) or _before <> a").select("key", "a")  # each scheme once, keys of one row gone
    everyone = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = F.array(*[F.lead("a", k).over(inside) for k in range(1, LISTED)])
    counted = met.select("key", "a", (F.count("*").over(everyone) > LISTED).alias("frequent"), later.alias("_later"))
    other = F.when(F.col("frequent"), F.array("key")).otherwise(F.filter("_later", lambda x: x.isNotNull()))
    return counted.select("frequent", "a", F.explode(other).alias("b"))


def set_blocks(keyed: DataFrame) -> DataFrame:
    """(node, root) of the sets that may be similar, directly or through others.

    Frequent keys, such as those of a passage that many texts hold, are taken from the slack of a scheme. While some of it is
    left, similar schemes share more listed keys than that, and pairs with fewer go. Schemes without slack meet in any key they
    share, listed or frequent. So a similar pair always meets: of the parts it agrees on, those that do not count are
    empty or frequent in both, so no more than either set has.
    A set is named by 48 bits of its name here; sets that share those share a block, no more.
    """
    scratch = Scratch(keyed.sparkSession)
    met = scratch.keep(shared_parts(keyed), "jaccard-met")
    node = set_number() * 2
    schemes_of = F.inline(F.array(
        F.struct((node + F.col("odd")).alias("scheme"), "slack"), F.struct((node + 1 - F.col("odd")).alias("scheme"), F.col("slack_below").alias("slack"))
    ))
    known = keyed.where("odd is not null").select(schemes_of).where("slack is not null").groupBy("scheme").agg(F.min("slack").alias("slack"))
    frequent = met.where("frequent").select(F.col("a").alias("scheme"), F.col("b").alias("key"))
    taken = frequent.groupBy("scheme").agg(F.count("*").alias("_n"))
    left = scratch.keep(known.join(taken, "scheme", "left").select("scheme", (F.col("slack") - F.coalesce("_n", F.lit(0))).alias("left")), "jaccard-slack")
    pairs = met.where("not frequent").groupBy("a", "b").agg(F.count("*").alias("_n"))
    for side in ("a", "b"):
        pairs = pairs.join(left.select(F.col("scheme").alias(side), F.col("left").alias(f"_{side}")), side)
    pairs = pairs.where(F.col("_n") > F.greatest("_a", "_b", F.lit(0))).select("a", "b")
    least = F.min("scheme").over(Window.partitionBy("key"))
    spent = frequent.join(left.where("left < 0"), "scheme").withColumn("least", least).where("scheme <> least")
    edges = pairs.unionByName(spent.select(F.col("scheme").alias("a"), F.col("least").alias("b")))
    roots = components(edges.select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b")), "jaccard-blocks")
    scratch.drop(met, left)
    return roots


def row_key() -> Column:
    """What names a row: its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of(F.col("text")))


def jaccard_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The columns of jaccard_components, the row's own key, and `keeper`, the key of the row that stands for its component.

    That is the row with the smallest doc_id of the component, of several the one with the smallest key. Two texts of one
    doc_id are rows of their own; rows that repeat share a key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text_of(F.col("text")).alias("text"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")  # a row without an id comes last
    keyed = scratch.keep(shingle_sets(rows, width, percent), "shingle-sets")
    sets = scratch.keep(keyed.select("doc_id", "row_key", "n_shingles", "set_id"), "shingle-names")
    blocks = scratch.keep(set_blocks(keyed), "jaccard-members")
    scratch.drop(keyed)
    distinct = (
        sets.where("set_id is not null")
        .groupBy("set_id")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"))
        .withColumn("row_key", F.col("first.row_key"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    distinct = scratch.keep(distinct, "shingle-nodes")  # numbers are fixed by being written
    wanted = distinct.withColumn("set", set_number()).join(blocks.withColumnRenamed("node", "set").withColumnRenamed("root", "block"), "set")
    wanted = scratch.keep(wanted.select("node", "block", "row_key", "set_id", "n_shingles"), "jaccard-wanted")
    once = rows.select("row_key", "text")
    if wanted.count() <= BROADCAST_SETS:  # 60 bytes each
        members = once.join(F.broadcast(wanted), "row_key")
    else:
        members = once.join(wanted, "row_key")
    members = members.select("node", "block", "n_shingles", "set_id", "text").dropDuplicates(["node"])  # repeated rows
    texts = scratch.keep(members, "jaccard-texts")
    found = scratch.keep(tree_links(texts, width, percent), "jaccard-links")
    scratch.drop(texts, blocks, wanted)
    roots = components(found, "jaccard-links")
    ids = distinct.select("node", "set_id", "first", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("first").alias("keeper"))
    named = ids.join(least, "root").where("copies > 1 or first <> keeper")
    names = scratch.keep(named.select("set_id", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.row_key").alias("keeper"), "copies"), "jaccard-names")
    scratch.drop(distinct, found)
    result = join_repeated(sets.select("doc_id", "row_key", "n_shingles", "set_id"), names, "set_id", "copies", F.col("row_key"))
    return result.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row_key", F.coalesce("keeper", "row_key").alias("keeper")
    )


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Words are split at ASCII gaps and A-Z lower-cased; a text of fewer than `width` words is
    one shingle. component_id is the smallest doc_id among the documents that links connect.
    Null and empty texts, and those without words, have no shingles, no links and their own id.
    Null ids take part but never name a component that holds another id. Repeated rows are
    copies of each other. An empty table gives no rows. Other columns are not read. Shingles
    are compared by 64-bit hashes.
    """
    return jaccard_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
