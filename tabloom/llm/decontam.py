"""Benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, text_of

WINDOW = 13
#: Words of benchmark items that one broadcast set may hold; a larger benchmark takes several scans.
SET_WORDS = 2_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.int64())]))


def normalised(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WindowSet:
    """The windows of some benchmark items: word numbers, and per window length hash -> windows -> items."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, dict[tuple[int, ...], list[int]]]] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised(text)]
            length = min(width, len(ids))
            for i in range(len(ids) - length + 1 if ids else 0):
                windows.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).add(item)
        for length, found in windows.items():
            rows = np.array(list(found), dtype=np.uint64)
            self.by_length[length] = (
                np.unique(rolled(rows.ravel(), length)[::length] if len(rows) else rows.ravel()),
                {k: sorted(v, key=lambda item: (item is None, item or 0)) for k, v in found.items()},
            )

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, last word, item) of every occurrence of a window."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        out = []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for length, (hashes, found) in self.by_length.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(full):
                continue
            keys = rolled(ids, length)[full]
            at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            for i in full[hashes[at] == keys]:
                items = found.get(tuple(int(x) for x in ids[i : i + length]))  # the hash only preselects
                for item in items or ():
                    out.append((int(i), int(i) + length - 1, item))
        return out


def rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` ids."""
    count = len(ids) - length + 1
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = (out * MIX) ^ (out >> np.uint64(29)) ^ (ids[j : j + count] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def scan(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """Append the spans found to `_spans`; map-only, one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    column = docs.columns.index("_text")
    spans_at = docs.columns.index("_spans")
    schema = docs.schema

    def run(batches):
        found = shared.value
        for batch in batches:
            spans = batch.column(spans_at).to_pylist()
            for row, text in enumerate(batch.column(column)):
                new = found.spans(normalised(text.as_py()))
                if new:
                    spans[row] = (spans[row] or []) + [{"first": a, "last": b, "item": c} for a, b, c in new]
            columns = list(batch.columns)
            columns[spans_at] = pa.array(spans, type=SPANS)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def with_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, set_words: int = SET_WORDS) -> DataFrame:
    """`docs` with `_spans`: every occurrence of a benchmark window in `_text`.

    The size of the benchmark is measured first. Up to `set_words` words it is one broadcast set;
    a larger one is dealt into parts of about that size and the texts are scanned once for each, so
    no set outgrows the bound and no window is left out. A single item is never split.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), text_of(F.col("text")).alias("text"))
    sized = items.withColumn("words", F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long"))
    total = sized.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-total // set_words))
    out = docs.withColumn("_spans", F.lit(None).cast("array<struct<first:int,last:int,item:bigint>>"))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = [(r["item"], r["text"]) for r in mine.collect()]  # about set_words words
        out = scan(out, WindowSet(rows, width))
    return out


REPORT = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
)


def hit_words(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans joined into disjoint runs of words."""
    runs: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


def measure(text: str | None, spans: list[dict] | None) -> tuple:
    n_words = len(normalised(text))
    n_hit = sum(b - a + 1 for a, b in hit_words(spans or []))
    items = sorted({"null" if s["item"] is None else str(s["item"]) for s in spans or []})
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def without_spans(text: str, spans: list[dict]) -> str:
    """The text less the words hit and the characters between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for first, last in hit_words(spans):
        out.append(data[at : places[first][0]])
        at = places[last][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, set_words: int = SET_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words and are never contaminated; items without words have no windows;
    equal items all count; an item without an id counts as the id "null". Repeated rows are
    reported each; empty tables give no rows, or no hits. Other columns are not read.
    """
    scanned = with_spans(docs.select("doc_id", F.col("text").alias("_text")), benchmark, width, set_words)
    schema = pa.schema([("doc_id", pa.int64()), *REPORT])
    fields = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def run(batches):
        for batch in batches:
            cells = [measure(t, s) for t, s in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist())]
            columns = [batch.column("doc_id"), *(list(c) for c in zip(*cells))] if cells else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return scanned.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, fields)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, spans: bool = False, width: int = WINDOW, set_words: int = SET_WORDS
) -> DataFrame:
    """`docs` without contaminated documents; with `spans`, the rest loses its hit words too.

    All columns pass through; rows and texts without a hit are unchanged.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    scanned = with_spans(packed, benchmark, width, set_words)
    verdict = F.pandas_udf(_verdicts, "struct<contaminated:boolean,text:string>")
    hit = F.when(F.col("_spans").isNotNull(), verdict("_text", "_spans"))
    judged = scanned.withColumn("_verdict", hit).where(~F.coalesce(F.col("_verdict.contaminated"), F.lit(False)))
    if not spans:
        return judged.select("_row.*")
    cleaned = F.coalesce(F.col("_verdict.text"), F.col("_text"))
    return judged.select(*[cleaned.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def _verdicts(texts, spans):
    import pandas as pd

    rows = []
    for text, found in zip(texts, spans):
        found = [dict(s) for s in found] if found is not None else []
        rows.append((bool(measure(text, found)[4]), without_spans(text or "", found)))
    return pd.DataFrame(rows, columns=["contaminated", "text"])


def op9_ngram_hash_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
