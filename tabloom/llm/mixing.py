"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, join_small, read, running_start, text_of, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Words of a block, whatever the size of the corpus.
BLOCK_WORDS = 512
GOLDEN = 0.6180339887498949
BINS = 1024
CHUNK = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets per source from (source, source_size); returns those with source_rank and target.

    Sources in code point order, null last, take the weights in turn and share `share` times
    all words. No target exceeds `most` times its source; the excess goes to the others by weight.
    That fixpoint is target = min(cap, level * weight) for one level, read off the sources
    sorted by cap / weight. One row per source goes through the single-task window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(F.array(*map(F.lit, weights)), F.col("source_rank") % len(weights) + 1)
    )
    ranked = ranked.withColumn("_cap", (most * F.col("source_size")).cast("double"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "source_rank")
    full = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (share * F.sum("source_size").over(full) - F.col("_capped")) / F.col("_left"))
        .withColumn("_level", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(full))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return levels.select("source", "source_size", "source_rank", target.alias("target"))


def slot_schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """As many slots as the sources need blocks, each given to a source: (slot, source_rank, block).

    Slot t gets the golden-ratio point frac((t + 0.5) * 0.618...), looked up in the sources'
    cumulative targets through an equi-join on bins; `block` counts a source's slots. Slots that
    a source gets beyond its blocks go, in order, to the blocks that got none, so every block of every
    source has one slot.
    """
    slots, n_sources = targets.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    bins = max(BINS, n_sources)
    order = Window.partitionBy(F.lit(0)).orderBy("source_rank")
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    spans = (
        targets.withColumn("_hi", F.sum("target").over(order) / total)
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0.0)))
        .where("target > 0")
        .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") * bins), F.floor(F.col("_hi") * bins))))
        .select("source_rank", "_lo", "_hi", F.col("_bin").alias("_span_bin"))
    )
    point = (F.col("id") + 0.5) * GOLDEN
    points = (
        spark.range(slots)
        .withColumn("_point", point - F.floor(point))
        .withColumn("_bin", F.floor(F.col("_point") * bins))
    )
    inside = (F.col("_bin") == F.col("_span_bin")) & (F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi"))
    chunk, one = F.floor(F.col("slot") / CHUNK).alias("_chunk"), F.lit(1).alias("_one")
    dealt = points.join(spans, inside, "left").select(F.col("id").alias("slot"), F.coalesce("source_rank", F.lit(-1)).alias("source_rank"))
    ranked = running_start(dealt.select("*", chunk, one), "source_rank", "_chunk", ["slot"], "_one", "block")
    needs = targets.where("need > 0").select(F.col("source_rank").alias("_rank"), "need")
    small = F.broadcast(needs) if n_sources <= 50_000 else needs
    ranked = ranked.join(small, F.col("source_rank") == F.col("_rank"), "left").select("slot", "source_rank", "block", "need")
    ranked = Scratch(spark).keep(ranked.withColumn("_used", F.coalesce(F.col("block") < F.col("need"), F.lit(False))), "mix-slots")
    used = ranked.where("_used").select("slot", "source_rank", "block")
    got = used.groupBy("source_rank").agg(F.count("*").alias("_got"))
    short = needs.withColumnRenamed("_rank", "source_rank").join(got, "source_rank", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < need")
    blocks = short.select("source_rank", F.explode(F.sequence(F.col("_got"), F.col("need") - 1)).alias("block"))
    every = F.lit(0).alias("_all")
    blocks = blocks.select("*", every, F.floor(F.col("source_rank") / CHUNK).alias("_chunk"), one)
    blocks = running_start(blocks, "_all", "_chunk", ["source_rank", "block"], "_one", "_place").select("_place", "source_rank", "block")
    free = ranked.where("not _used").select("slot", every, chunk, one)
    free = running_start(free, "_all", "_chunk", ["slot"], "_one", "_place").select("_place", "slot")
    return used.unionByName(free.join(blocks, "_place").select("slot", "source_rank", "block"))


def row_key() -> Column:
    """Names a row by what the mix reads of it; equal rows share it."""
    return F.xxhash64("doc_id", "source", text_of(F.col("text")))


def taken_rows(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """The mix as rows of `docs`: one per document and pass, columns unchanged but text and n_chars.

    A whole pass keeps its text. Where a source's last block ends inside a document the row
    holds the words taken, one space between them. Texts are shuffled once.
    """
    passes = F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("_pass")
    rows = documents.where("taken > 0").select("row_key", "size", "taken", passes)
    rows = rows.select("row_key", "size", F.least("size", F.col("taken") - F.col("_pass") * F.col("size")).alias("_n"))
    keyed = docs.select(row_key().alias("row_key"), F.struct("*").alias("_row")).dropDuplicates(["row_key"])
    joined = keyed.join(rows, "row_key")
    part = F.array_join(F.slice(words_of(F.col("_row.text")), F.lit(1), F.col("_n").cast("int")), " ")
    whole = F.col("_n") == F.col("size")
    new = {
        "text": F.when(whole, F.col("_row.text")).otherwise(part),
        "n_chars": F.when(whole, F.col("_row.n_chars")).otherwise(F.length(part).cast("long")) if "n_chars" in docs.columns else None,
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix(docs: DataFrame, seed: int = 7, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix all documents; returns (documents, pieces).

    Each source's documents are put in a seeded hash order and read as one stream of words,
    twice if need be, cut into blocks of BLOCK_WORDS words. The k-th block of a source is its last if
    it reaches the target, rounded to words, and ends there. The number of slots grows with the
    total; with `slots` there are about so many and the words of a block follow from the total.

    documents: doc_id, source, row_key, size, source_size, target, taken (words in scheduled
    blocks; a stream is taken from its front, so they are whole passes and then first words).
    pieces: slot, doc_id, source, epoch (0 or 1), first_word, n_words, in no order; `slot` is
    the place in the mix.
    Null texts and texts without words have size 0 and are taken 0 times; null sources form
    the last source; repeated rows are separate documents; an empty table gives no rows. Other columns of
    `docs` are not read.
    """
    spark = docs.sparkSession
    body = text_of(F.col("text"))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    kept = ["doc_id", "source", "row_key"]
    size = F.size(words_of(body)).cast("long")
    sized = Scratch(spark).keep(
        docs.select("doc_id", "source", row_key().alias("row_key"), size.alias("size"), place.alias("_place")), "mix-sizes"
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = Scratch(spark).keep(source_targets(sums), "mix-targets")
    block_words = BLOCK_WORDS
    if slots is not None:
        block_words = max(1, -(-int(targets.agg(F.sum("target")).first()[0] or 0.0) // slots))
    targets = targets.withColumn("goal", F.round("target").cast("long")).withColumn("need", F.ceil(F.col("goal") / block_words))
    schedule = slot_schedule(spark, targets)
    placed = join_small(sized, targets, "source").withColumn("_bucket", F.substring("_place", 1, 3))
    placed = running_start(placed, "source_rank", "_bucket", ["_place", "doc_id", "size"], "size", "_start")
    placed = placed.drop("_bucket", "_place")
    lo = F.col("_start") + F.col("epoch") * F.col("source_size")
    first = F.greatest(lo, F.col("block") * block_words)
    last = F.least(lo + F.col("size"), (F.col("block") + 1) * block_words, F.col("goal"))
    pieces = (
        placed.where("size > 0")
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
        .withColumn("block", F.explode(F.sequence(F.floor(lo / block_words), F.floor((lo + F.col("size") - 1) / block_words))))
        .join(schedule, ["source_rank", "block"], "left")
        .withColumn("n_words", F.when(F.col("slot").isNotNull(), F.greatest(last - first, F.lit(0))).otherwise(0))
        .withColumn("first_word", first - lo)
    )
    group = [*kept, "size", "source_size", "target"]
    documents = pieces.groupBy(*group, "source_rank", "_start").agg(F.sum("n_words").alias("taken")).select(*group, "taken")
    documents = documents.unionByName(placed.where("size = 0").select(*group, F.lit(0).cast("long").alias("taken")))
    used = pieces.where("n_words > 0").select("slot", "doc_id", "source", "epoch", "first_word", "n_words")
    return documents, used


def op7_golden_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix(read(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")
