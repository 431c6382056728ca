"""Periodic runs of words, found on scale tiles.

For every octave of periods [2^o, 2^(o+1)) a text is cut into overlapping tiles, one per boundary c, a
multiple of the octave's step B. A tile answers for itself, with two Z-functions at its boundary,
how far words on both sides of c equal those q further on, for each period q of the octave, as
long as the whole block [c, c + B) does. A stretch of equal words long enough for a run holds such a block,
and what its boundaries report overlaps, so runs come back by stitching the fragments of a
document and period.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, read, text_of, words_of

LEAST = 12
#: Texts of more words are dealt to tasks as pieces of so many words, at least, per group of octaves.
PIECE_WORDS = 1 << 16
#: Octaves below this one share a piece; each of the others has pieces of its own, as long as its tiles ask for.
SHARED_OCTAVES = 12
#: Words that are solved at once.
BATCH_WORDS = 1 << 18
#: Pairs (boundary, period) compared at once.
PAIRS = 1 << 22


def least_match(octave: int) -> int:
    """The fewest neighbouring words equal to those a period on, in a run with a period of the octave."""
    return min(max(q, LEAST - q) for q in range(1 << octave, 2 << octave))


def step_of(octave: int) -> int:
    """Boundaries' distance B: every stretch of least_match words holds a block [c, c + B) with c a multiple of B."""
    return (least_match(octave) + 1) // 2


STEPS = [step_of(o) for o in range(5)] + [1 << (o - 1) for o in range(5, 48)]


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def tile(ids: list[int], c: int, octave: int, step: int) -> list[tuple[int, int, int]]:
    """(period, start, end) for the periods whose words at [c, c + step) all equal those a period on.

    [start, end) are the places around c that equal the place a period on, at most `step` to the
    left and 2 * step to the right of c. `ids` are the words of one text, from 0 on.
    """
    first, n = 1 << octave, len(ids)
    ahead = ids[c : c + 2 * step]
    z = z_function(ahead + ids[c + first : min(n, c + 2 * first + 2 * step)])
    back = ids[max(0, c - step) : c][::-1]
    # places c - 1 + q for the octave's periods, the last first
    last = min(n, c + 2 * first - 1)
    y = z_function(back + ids[max(0, c + first - step) : last][::-1])
    out = []
    for q in range(first, min(2 * first, n - c)):
        right = min(z[len(ahead) + q - first], len(ahead), n - c - q)
        if right < step:
            continue
        at = len(back) + last - (c + q)
        left = min(y[at], len(back)) if back and at < len(y) else 0
        out.append((q, c - left, c + right))
    return out


def blocks(ids: np.ndarray, text: np.ndarray, octave: int, step: int, low: int, high: int) -> np.ndarray:
    """Boundaries in [low, high) that some period of the octave makes worth a tile.

    Words of the first places of the block are compared for all periods at once; a boundary
    without a period that passes has none whose whole block passes. `text` numbers the texts.
    """
    first, n = 1 << octave, len(ids)
    places = np.arange(-(-low // step) * step, min(high, n - first - step + 1), step)
    found = []
    per = max(1, PAIRS >> octave)
    for i in range(0, len(places), per):
        c = places[i : i + per]
        width = min(first, n - int(c[0]) - first)
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.full(first, -1, ids.dtype)]) if n < int(c[-1]) + 2 * first else ids, width)
        at, q = np.nonzero(view[c + first] == ids[c][:, None])
        c, q = c[at], q + first
        fits = c + q + step <= n
        c, q = c[fits], q[fits]
        for k in range(1, min(step, 12)):
            same = ids[c + k] == ids[c + q + k]
            c, q = c[same], q[same]
        same = text[c] == text[c + q + step - 1]
        found.append(np.unique(c[same]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def merged(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) that touch, made one."""
    out = []
    for q, a, b in sorted(fragments):
        if out and out[-1][0] == q and a <= out[-1][2]:
            if b > out[-1][2]:
                out[-1] = (q, out[-1][1], b)
        else:
            out.append((q, a, b))
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32)


def solve(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per whole text, as numbers of words, the stretches (period, start, end) that make a run or a multiple of one."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # long texts first: an octave asks only those it fits into
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    ids, text = np.concatenate([np.zeros(0, np.int32), *[texts[i] for i in order]]), np.repeat(np.arange(len(order)), sizes)
    found: list[list] = [[] for _ in texts]
    for octave in range(48):
        fit = int((sizes >= max(LEAST, 2 << octave)).sum())
        if not fit:
            break
        end, step = int(starts[fit]), STEPS[octave]
        hits = blocks(ids[:end], text[:end], octave, step, 0, end)
        for t, places in groupby(hits.tolist(), key=lambda c: int(text[c])):
            base = int(starts[t])
            words, fragments = texts[order[t]].tolist(), []
            for c in places:
                fragments += tile(words, c - base, octave, step)
            found[order[t]] += [(q, a, b) for q, a, b in merged(fragments) if b - a >= max(q, LEAST - q)]
    return found


def solve_piece(ids: np.ndarray, base: int, low: int, high: int, octaves: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Fragments of the boundaries in [low, high) of one text, of which `ids` are the words from place `base` on."""
    words, found, text = ids.tolist(), [], np.zeros(len(ids), dtype=np.int8)
    for octave in range(*octaves):
        step = STEPS[octave]
        shift = base % step  # boundaries are multiples of the step in the whole text
        padded = np.concatenate([np.full(shift, -1, ids.dtype), ids])
        hits = blocks(padded, np.zeros(len(padded), np.int8), octave, step, low - base + shift, high - base + shift)
        for c in (hits - shift).tolist():
            found += tile(words, c, octave, step)
    return [(q, a + base, b + base) for q, a, b in merged(found)]


def pieces_of(n: int):
    """(first octave, octave after the last, low, high, base, end) of the pieces of a text of n words.

    Boundaries in [low, high) need the words [base, end): a step to the left, two steps and the largest period to the right.
    """
    groups, octave = [], 0
    while (2 << octave) <= n:
        after = SHARED_OCTAVES if octave < SHARED_OCTAVES else octave + 1
        groups.append((octave, after))
        octave = after
    for octave, after in groups:
        reach = 2 << after
        size = max(PIECE_WORDS, reach)
        for low in range(0, n, size):
            yield octave, after, low, low + size, max(0, low - (1 << after)), min(n, low + size + reach)


# --- Spark ----------------------------------------------------------------------------------

FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
SCAN = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())]
    + [("text", pa.string()), ("fragments", pa.list_(FRAGMENT)), ("long", pa.bool_())]
)
SCAN_DDL = "row long, doc_id long, n_words long, sha string, text string, fragments array<struct<period:long,start:long,stop:long>>, long boolean"
PIECE_DDL = "row long, octave int, after int, low long, high long, base long, ids binary"


def scanned(rows: DataFrame) -> DataFrame:
    """Per text its words, their digest and its stretches; the text itself only where it has any or is long.

    Texts of more than PIECE_WORDS words are not solved here.
    """

    def run(batches):
        held, words = [], 0

        def flush():
            solved = iter(solve([h[3] for h in held if h[3] is not None]))
            out = []
            for row, doc_id, raw, ids, n, sha in held:
                long = ids is None
                fragments = [] if long else [{"period": q, "start": a, "stop": b} for q, a, b in next(solved)]
                out.append((row, doc_id, n, sha, raw if long or fragments else None, fragments, long))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCAN)], schema=SCAN)

        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                raw = text.as_py()
                split = raw.encode("utf-8", "surrogatepass").split()
                n = len(split)
                ids = numbered(split) if n <= PIECE_WORDS else None
                held.append((row.as_py(), doc_id.as_py(), raw, ids, n, hashlib.sha256(b" ".join(split)).hexdigest()))
                words += n
                if words > BATCH_WORDS or len(held) >= 4096:
                    yield flush()
                    held, words = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, SCAN_DDL)


def exploded(long: DataFrame) -> DataFrame:
    """The pieces of long texts, each with the numbers of the words that its tiles read."""
    schema = pa.schema([("row", pa.int64()), ("octave", pa.int32()), ("after", pa.int32())] + [(c, pa.int64()) for c in ("low", "high", "base")] + [("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for row, text in zip(batch.column("row"), batch.column("text")):
                ids = numbered(text.as_py().encode("utf-8", "surrogatepass").split())
                for octave, after, low, high, base, end in pieces_of(len(ids)):
                    out = [row.as_py(), octave, after, low, high, base, ids[base:end].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema)], schema=schema)

    return long.select("row", "text").mapInArrow(run, PIECE_DDL)


def piece_fragments(pieces: DataFrame) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("row", "period", "start", "stop")])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = solve_piece(np.frombuffer(r["ids"], np.int32), r["base"], r["low"], r["high"], (r["octave"], r["after"]))
                if found:
                    columns = [np.full(len(found), r["row"]), *np.array(found, dtype=np.int64).T]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=schema)

    dealt = pieces.repartition(F.col("row"), F.col("octave"), F.col("low"))
    return dealt.mapInArrow(run, "row long, period long, start long, stop long")


def stitched(fragments: DataFrame) -> DataFrame:
    """Runs (row, start, length, period): fragments of a row and period that touch made one, multiples of a period left out."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reach).cast("long"), F.lit(1))
    stretches = (
        fragments.withColumn("_o", opens)
        .withColumn("_g", F.sum("_o").over(order))
        .groupBy("row", "period", "_g")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    matched = F.col("stop") - F.col("start")
    runs = stretches.where(matched >= F.greatest(F.col("period"), LEAST - F.col("period")))
    runs = runs.select("row", "start", (matched + F.col("period")).alias("length"), "period")
    return runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def collapsed(rows: DataFrame) -> DataFrame:
    """Per (row, text, runs) the digest of the words outside the repeats of its runs, joined by spaces, and that text."""

    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("sha", pa.string()), ("collapsed", pa.string())])
        for batch in batches:
            shas, kept = [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                split = text.as_py().encode("utf-8", "surrogatepass").split()
                change = np.zeros(len(split) + 1, dtype=np.int64)
                for r in runs.as_py():
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                stay = np.cumsum(change[:-1]) == 0
                body = b" ".join([w for w, s in zip(split, stay.tolist()) if s])
                shas.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shas, pa.string()), pa.array(kept, pa.string())], schema=schema)

    return rows.select("row", "text", "runs").mapInArrow(run, "row long, sha string, collapsed string")


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, runs (array of start, length, period in order), collapsed_sha256 and, with
    `texts`, collapsed: the words that no run repeats joined by spaces (null where nothing is dropped).

    Words are split at ASCII gaps and compared exactly; whole texts count, whatever their length. A
    run is a stretch of words with smallest period q and at least max(12, 2q) words that cannot be
    extended; a word goes if a run holds it after its first q words. Null and empty texts and those without words have no runs.
    Repeated rows and ids are judged each. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    scan = scratch.keep(scanned(rows), "run-scan")  # row numbers are fixed by being written
    pieces = exploded(scan.where("long"))
    solved = scan.where("not long").select("row", F.inline("fragments"))
    runs = stitched(solved.unionByName(piece_fragments(pieces)))
    listed = scratch.keep(runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")), "runs")
    changed = listed.join(scan.where("text is not null").select("row", "text"), "row")
    done = collapsed(changed)
    none = F.array().cast(RUNS)
    out = scan.select("row", "doc_id", "n_words", F.col("sha").alias("_whole")).join(listed, "row", "left").join(done if texts else done.drop("collapsed"), "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("sha", "_whole").alias("collapsed_sha256"),
        *(["collapsed"] if texts else []),
    )


def report(found: DataFrame) -> DataFrame:
    """The runs of each document as counts, the longest one and a digest."""
    best = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    in_order = F.sort_array(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    df = found.withColumn("runs", in_order).withColumn("_best", best)
    length, period = -F.col("_best.l"), F.col("_best.p")
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * -_best.l) div _best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: of a tenth of the documents, by crc32 of the id, the words from one place on
    repeat with a period. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = words_of(text_of(F.col("text")))
    chosen = docs.select("doc_id", text_of(F.col("text")).alias("text"), F.when(h % 10 == 0, split).alias("_w"), g.alias("_g"))
    n = F.size("_w")
    a = F.expr("cast(_g % size(_w) as int)")
    df = chosen.withColumn("_a", F.when(F.col("_w").isNotNull() & (n > 0), a))
    df = df.withColumn("_p", F.expr("cast(1 + floor((size(_w) - _a) / (3 + _g % 8)) as int)"))
    repeated = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p") + 1)))
    return df.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_scale_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(periodic_runs(planted(read(spark, sf_dir, "documents")), texts=False))
