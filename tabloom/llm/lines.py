"""Line deduplication with a segment-partition edit join."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import GAP_CHARS, Scratch, join_repeated, read, text_of

#: A pair of lines is near if its edit distance is at most floor(shorter length / CHARS_PER_EDIT), and at most MOST_EDITS.
MOST_EDITS = 2
CHARS_PER_EDIT = 20
GAP_BYTES = GAP_CHARS.encode()
SEEN_LINES = 200_000
BLOCK_CHARS = 1 << 20
BROADCAST_LINES = 100_000
BLOCK = 2048


def edits_for(length: int) -> int:
    return min(MOST_EDITS, length // CHARS_PER_EDIT)


def forms_of(text: str) -> list[bytes]:
    """The lines of a text as compared: ASCII space around them stripped, A-Z lower-cased, in UTF-8."""
    return [line.strip(GAP_BYTES) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of a and b is at most `limit`.

    Equal ends are cut off first. Bits of one word stand for the rows of the band around the
    diagonal, from `limit` above it to `limit` below it; each character of b moves the band down a row.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a:
        return len(b) <= limit
    above = (1 << limit + 1) - 1  # rows at or above row 0 match every character
    rows: dict[str, int] = {}
    for row, c in enumerate(a, 1):
        rows[c] = rows.get(c, above) | 1 << row + limit
    band = (1 << 2 * limit + 1) - 1
    bottom = 1 << 2 * limit
    down, up = band & ~above, above  # where values grow, and fall, from row to row
    distance = len(b) - len(a)
    diagonal = 1 << limit - distance
    for column, c in enumerate(b, 1):
        match = rows.get(c, above) >> column & band
        grow, fall = down >> 1 | bottom, up >> 1
        same = ((match & grow) + grow ^ grow | match | fall) & band
        right_up, right_down = fall | band & ~(same | grow), same & grow
        right_up = right_up << 1 | 1
        down, up = (right_down << 1 | band & ~(same | right_up)) & band, same & right_up & band
        if not same & diagonal:
            distance += 1
            if distance > limit:
                return False
    return True


def segments(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the limit + 1 even segments of a line; the later ones take the rest."""
    parts = limit + 1
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def index_and_probes(length: int) -> list[tuple[bool, int, int, int, int]]:
    """(indexed, partner length, segment, start, size) of the substrings of a line of `length`.

    A line indexes its own segments and probes those of lines up to MOST_EDITS shorter. If two
    lines are within the limit and segment i is the first on which they agree, at most i edits lie
    before it and at most limit - i behind it, which bounds where it can start.
    """
    out = []
    for partner in range(length, max(0, length - MOST_EDITS) - 1, -1):
        limit = edits_for(partner)
        shift = length - partner
        if not limit or shift > limit:
            continue
        for i, (start, size) in enumerate(segments(partner, limit)):
            lo = max(start - i, start + shift - (limit - i), 0)
            hi = min(start + i, start + shift + (limit - i), length - size)
            out += [(not shift and at == start, partner, i, at, size) for at in range(lo, hi + 1)]
    return out


def parities(lines: list[str]) -> np.ndarray:
    """Per line 32 bits: the parities of the counts of 32 classes of neighbouring characters.

    An edit changes at most four of those counts by one, so near lines differ in at most 4 x limit bits.
    """
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)), lengths)
    kind = ((codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(32)
    inside = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][inside] * 32 + kind[inside].astype(np.int64), minlength=32 * len(lines))
    return (counts.reshape(-1, 32) & 1) @ (1 << np.arange(32, dtype=np.int64))


def distinct_lines(texts, seen: set):
    """Blocks (ids, lines) of the lines of a batch that can have near partners and were not met before in the task.

    The upper half of an id is from the line's digest, the lower half its parities.
    """
    heads, lines, size = [], [], 0

    def block():
        ids = np.array(heads, dtype=np.int64) << 32 | parities(lines)
        return ids, lines

    for text in texts:
        for form in forms_of(text.as_py()):
            if len(form) < CHARS_PER_EDIT or form in seen:
                continue
            line = form.decode("utf-8", "surrogatepass")
            if len(line) < CHARS_PER_EDIT:
                continue
            if len(seen) >= SEEN_LINES:
                seen.clear()
            seen.add(form)
            heads.append(int.from_bytes(hashlib.md5(form).digest()[:4], "little", signed=True))
            lines.append(line)
            size += len(line)
            if size >= BLOCK_CHARS:
                yield block()
                heads, lines, size = [], [], 0
    if lines:
        yield block()


def substring_rows(texts: DataFrame) -> DataFrame:
    """key, line, indexed: the index entries and probes of every line, once per task."""

    def run(batches):
        import xxhash

        digest, plans, seen = xxhash.xxh64_intdigest, {}, set()
        for batch in batches:
            keys, lines, kinds = [], [], []
            for ids, found in distinct_lines(batch.column("text"), seen):
                for number, line in zip(ids.tolist(), found):
                    plan = plans.get(len(line))
                    if plan is None:
                        plan = plans[len(line)] = index_and_probes(len(line))
                    ascii_line = line.isascii()
                    data = line.encode("utf-8", "surrogatepass") if ascii_line else line
                    for indexed, partner, i, at, size in plan:
                        part = data[at : at + size]
                        keys.append(digest(part if ascii_line else part.encode("utf-8", "surrogatepass"), partner << 8 | i))
                        kinds.append(indexed)
                    lines += [number] * len(plan)
            key = np.array(keys, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lines, pa.int64()), pa.array(kinds, pa.bool_())], names=["key", "line", "indexed"])

    return texts.mapInArrow(run, "key long, line long, indexed boolean")


def survivors(rows: DataFrame) -> DataFrame:
    """(key, line) of lines that share a key, which one of them indexes, with a line their parities allow.

    Rows come sorted by key, so a task holds one key's distinct lines at a time, 9 bytes each,
    and compares them in blocks. At most one row leaves per line and key.
    """
    ordered = rows.repartition("key").sortWithinPartitions("key", "line")
    schema = pa.schema([("key", pa.int64()), ("line", pa.int64())])

    def partnered(line: np.ndarray, indexed: np.ndarray) -> np.ndarray:
        line, at = np.unique(line, return_inverse=True)
        low = line.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        keep = np.zeros(len(line), bool)
        base = np.unique(at[indexed])
        for i in range(0, len(base), BLOCK):
            mine = base[i : i + BLOCK]
            for j in range(0, len(line), BLOCK):
                near = np.bitwise_count(low[mine][:, None] ^ low[j : j + BLOCK][None, :]) <= 4 * MOST_EDITS
                near &= mine[:, None] != np.arange(j, min(j + BLOCK, len(line)))[None, :]
                keep[mine[near.any(1)]] = True
                keep[j : j + BLOCK] |= near.any(0)
        return line[keep]

    def run(batches):
        def found(key, line, indexed):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for i in np.flatnonzero(np.diff(cuts) > 1):
                part = slice(cuts[i], cuts[i + 1])
                if indexed[part].any() and line[part][0] != line[part][-1]:
                    kept = partnered(line[part], indexed[part])
                    yield np.full(len(kept), key[cuts[i]]), kept

        def out(parts):
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)

        held: list[list[np.ndarray]] = []  # batches of the key that is still open
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line", "indexed")]
            if held and new[0][-1] == held[0][0][-1]:
                held.append(new)  # all of one key so far
                continue
            rest = [np.concatenate([h[i] for h in held] + [new[i]]) for i in range(3)]
            last = np.searchsorted(rest[0], rest[0][-1])
            yield from out(list(found(*(r[:last] for r in rest))))
            held = [[r[last:] for r in rest]]
        if held:
            yield from out(list(found(*(np.concatenate([h[i] for h in held]) for i in range(3)))))

    return ordered.mapInArrow(run, "key long, line long")


def line_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, form) of the wanted lines; broadcast up to BROADCAST_LINES of them, else shuffled."""

    def run(batches):
        seen = set()
        for batch in batches:
            for ids, found in distinct_lines(batch.column("text"), seen):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.string())], names=["line", "form"])

    few = wanted.count() <= BROADCAST_LINES
    lines = texts.mapInArrow(run, "line long, form string")
    return lines.join(F.broadcast(wanted) if few else wanted, "line").distinct()


def near_lines(texts: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """Digests of the lines of which an earlier one is within the limit.

    The lines that share a key come together with their texts, earliest first; each is
    compared with those before it until one is near. A row leaves per line found, not per pair.
    """
    shared = scratch.keep(survivors(substring_rows(texts)), "line-keys")
    forms = scratch.keep(line_texts(texts, shared.select("line").distinct()), "line-forms")
    placed = forms.withColumn("digest", F.unhex(F.md5("form"))).join(firsts.select("digest", "first"), "digest")
    met = shared.join(placed, "line").repartition("key").sortWithinPartitions("key", "first")

    def run(batches):
        key, low, forms, done = None, [], [], set()
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("key", "line", "digest", "form")]
            for mine, line, digest, form in zip(*columns):
                if mine != key:
                    key, low, forms = mine, [], []
                bits = line & 0xFFFFFFFF
                if low and digest not in done:
                    before = np.array(low, dtype=np.uint64)
                    for i in np.flatnonzero(np.bitwise_count(before ^ np.uint64(bits)) <= 4 * MOST_EDITS):
                        other = forms[i]
                        if within(form, other, edits_for(min(len(form), len(other)))):
                            done.add(digest)
                            out.append(digest)
                            break
                low.append(bits)
                forms.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])

    return met.select("key", "line", "digest", "form").mapInArrow(run, "digest binary").distinct()


def numbered_lines(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, line_no and digest of every line with a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("line_no", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            owners, numbers, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                for number, form in enumerate(forms_of(text.as_py())):
                    if form:
                        owners.append(row)
                        numbers.append(number)
                        digests.append(hashlib.md5(form).digest())
            owner = pa.array(owners, pa.int32())
            arrays = [batch.column("doc_id").take(owner), batch.column("row_key").take(owner), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return rows.mapInArrow(run, "doc_id long, row_key long, line_no int, digest binary")


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_decisions(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed_lines (numbers from 0, ascending), and _row_key.

    Lines are compared without ASCII space around them and with A-Z lower-cased. A line goes if
    an earlier one, by (doc_id, line number), equals it or is near it (see CHARS_PER_EDIT): what is
    earlier counts whether it stays or not. Lines without a word stay. n_lines counts lines with a word.
    Null and empty texts have none. Null ids come first; rows of one id come in the order of a
    hash of their texts; rows with equal id and text are one document given twice, with one result
    each. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = text_of(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id"), text).alias("row_key"), text.alias("text"))
    lines = scratch.keep(numbered_lines(rows), "lines")
    place = F.struct("doc_id", "row_key", "line_no")
    firsts = scratch.keep(lines.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-firsts")
    later = near_lines(rows.select("text"), firsts, scratch).withColumn("near", F.lit(True))
    known = scratch.keep(firsts.join(later, "digest", "left").where("n > 1 or near"), "line-known")
    judged = join_repeated(lines, known, "digest", "n", F.concat_ws("~", "row_key", "line_no"))
    gone = F.coalesce("near", F.lit(False)) | F.coalesce(F.col("first") != place, F.lit(False))
    per_row = judged.groupBy("doc_id", "row_key", "line_no").agg(F.max(gone).alias("gone")).groupBy("doc_id", "row_key").agg(
        F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line_no")))).alias("removed_lines")
    )
    found = rows.select("doc_id", "row_key").join(per_row.drop("doc_id"), "row_key", "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return found.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"),
        removed.alias("removed_lines"), F.col("row_key").alias("_row_key"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the lines that line_decisions removes cut from `text`; other columns pass through."""
    decided = line_decisions(docs).select("_row_key", "removed_lines").dropDuplicates(["_row_key"])
    key = F.xxhash64(F.col("doc_id"), text_of(F.col("text")))
    joined = docs.select(F.struct("*").alias("_row"), key.alias("_row_key")).join(decided, "_row_key")
    left = F.filter(split_lines(F.col("_row.text")), lambda line, i: ~F.array_contains("removed_lines", i))
    text = F.when(F.size("removed_lines") > 0, F.array_join(left, "\n")).otherwise(F.col("_row.text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(read(spark, sf_dir, "documents")).drop("_row_key")
