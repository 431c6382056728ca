"""Token ids in compressed binary shards: one frame per document, a shared dictionary, an offset index."""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, attempt_name, file_system, new_folder, read, text_of

END_ID = 2
MAGIC = b"TOKDOC01"
LEVEL = 3
#: The dictionary is trained on this many documents of at most SAMPLE_BYTES each; a compression aid only.
SAMPLE_DOCS = 256
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
SHARD_BYTES = 128 << 20
#: UTF-8 bytes of text per writing task, so that remembered stretches pay and the memory of a task stays bounded.
TASK_BYTES = 64 << 20
CACHE_ENTRIES = 250_000

# Shard layout, little-endian:
#   header  magic, id width in bytes (u8), SHA-256 of the dictionary (32 bytes; of nothing if there is none)
#   frames  one zstandard frame per document, in document order
#   index   n x (doc_id i64, has_id u8, n_tokens i64), then n + 1 frame offsets u64
#   footer  index offset u64, n u64, magic
HEADER = "<8sB32s"
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_tokens", "<i8")])
FOOTER = "<QQ8s"
HEADER_SIZE = struct.calcsize(HEADER)
FOOTER_SIZE = struct.calcsize(FOOTER)


MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself if it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def spelt_bytes(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(LETTERS)


RUNS = re.compile(r"[^\W\d_]+|[!-/:-@\[-`{-~]+|\n")
#: Characters besides the space that the splitter may take for space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


class Remembered(dict):
    """Results by key; beyond CACHE_ENTRIES the older half is forgotten."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def odd_spaces(text: str) -> bool:
    """Whether a space stands at the end or beside another space."""
    if "  " in text or text.endswith(" "):
        return True
    return any(c in text and (" " + c in text or c + " " in text) for c in SPACES)


class Encoder:
    """Whole texts to packed ids with the tokenizers library.

    Byte-level tokenizers split a text before every single space between two other characters,
    whatever follows, so the stretches between such spaces are encoded once each and
    remembered (at most twice CACHE_ENTRIES). Other tokenizers encode every text as it is, and so do all where a
    text spells a token that was added to the vocabulary, which the library finds before it splits. With
    `special_as_text` such spellings are ordinary text.
    """

    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        spelt = [re.escape(t.content) for t in added if t.content and not (special_as_text and t.special)]
        self.added = re.compile("|".join(sorted(spelt, key=len, reverse=True))).search if spelt else None
        pre = self.tokenizer.pre_tokenizer
        self.split = pre.pre_tokenize_str if pre is not None else None
        settings = pre.__getstate__() if pre is not None else b""
        self.byte_level = (
            type(pre).__name__ == "ByteLevel"
            and b'"add_prefix_space":false' in settings
            and b'"use_regex":true' in settings
            and self.tokenizer.normalizer is None
        )
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Remembered(lambda word: self.stretch(word, True))
        letter = "H" if self.dtype.itemsize == 2 else "I"
        self.packers = [struct.Struct(f"<{n}{letter}").pack for n in range(64)]
        self.bare = Remembered(lambda word: self.letters(word, False))
        self.marks = Remembered(lambda run: self.piece(spelt_bytes(run)))

    def pack(self, ids) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, dtype=self.dtype).tobytes()

    def piece(self, spelt: str) -> bytes:
        return self.pack([t.id for t in self.tokenizer.model.tokenize(spelt)])

    def stretch(self, word: str, spaced: bool) -> bytes:
        """One stretch. Runs of letters, of ASCII marks and single line ends are the pieces the
        splitter would make of it; anything else is left to the splitter."""
        if word.isalpha():
            return self.letters(word, spaced)
        if spaced and word[-1:] in MARKS and word[:-1].isalpha():
            return self.known[word[:-1]] + self.marks[word[-1]]
        runs = RUNS.findall(word)
        simple = "'" not in word and "\n\n" not in word and "".join(runs) == word
        if not simple or not all(r.isascii() or r.isalpha() for r in runs) or (spaced and runs[0] == "\n"):
            return b"".join(self.piece(spelt) for spelt, _ in self.split(" " + word if spaced else word))
        out = []
        for run in runs:
            if run.isalpha():
                out.append(self.known[run] if spaced else self.bare[run])
            else:
                out.append(self.piece(LETTERS[32] + run) if spaced else self.marks[run])
            spaced = False
        return b"".join(out)

    def letters(self, word: str, spaced: bool) -> bytes:
        spelt = word if word.isascii() else spelt_bytes(word)
        return self.piece(LETTERS[32] + spelt if spaced else spelt)

    def encode(self, text: str) -> bytes:
        if not self.byte_level or (self.added and self.added(text)):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = self.SAFE.split(text) if odd_spaces(text) else text.split(" ")
        return self.stretch(first, False) + b"".join(map(self.known.__getitem__, rest))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process, so that tasks after the first find stretches remembered."""
    return Encoder(path)


def codec(dictionary: bytes):
    import zstandard as zstd

    if not dictionary:
        return None
    trained = zstd.ZstdCompressionDict(dictionary)
    trained.precompute_compress(level=LEVEL)
    return trained


def train_dictionary(docs: DataFrame, path: str, rows: int) -> bytes:
    """A dictionary from a bounded, hash-ordered sample; empty where there is too little to learn from."""
    import zstandard as zstd

    thin = max(1, rows // (4 * SAMPLE_DOCS))  # about 4 x SAMPLE_DOCS rows are sorted
    sample = (
        docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES))
        .where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(thin)) == 0)
        .orderBy(F.xxhash64("text", "doc_id"), "text")
        .limit(SAMPLE_DOCS)
    )
    encoder = encoder_of(path)
    arrays = [encoder.encode(r["text"]) for r in sample.select("text").collect()]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b""


MANIFEST = "part int, roll int, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encode all documents into shards in ascending order of doc_id; returns the manifest.

    Rows are range-partitioned and sorted by (doc_id, hash of the text); each task streams its
    rows into shards of at most SHARD_BYTES before the index and reports finished ones. Only shards of tasks
    that succeeded are in the manifest (part, roll, path, n_docs, n_tokens), in reading order.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    rows, total = texts.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    dictionary = train_dictionary(texts, path, rows)
    digest = hashlib.sha256(dictionary).digest()
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    with fs.open_output_stream(f"{place}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)
    ordered = (
        texts.withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(max(1, -(-(total or 0) // TASK_BYTES)), "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .drop("_tie")
    )

    def run(batches):
        import zstandard as zstd
        from pyspark import TaskContext

        fs, place = file_system(folder)
        encoder = encoder_of(path)
        end = encoder.pack([end_id])
        press = zstd.ZstdCompressor(level=LEVEL, dict_data=codec(dictionary))
        part, roll, out, entries, offsets, name = TaskContext.get().partitionId(), 0, None, [], [], ""

        def finish():
            index = np.array(entries, dtype=ENTRY)
            out.write(index.tobytes() + np.array(offsets, dtype="<u8").tobytes())
            out.write(struct.pack(FOOTER, offsets[-1], len(entries), MAGIC))
            out.close()
            return part, roll, f"{folder}/{name}", len(entries), int(index["n_tokens"].sum())

        def row(values):
            return pa.RecordBatch.from_pylist([dict(zip(("part", "roll", "path", "n_docs", "n_tokens"), values))], schema=MANIFEST_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if out is None:
                    name = attempt_name("tokens", ".tok")
                    out = fs.open_output_stream(f"{place}/{name}")
                    out.write(struct.pack(HEADER, MAGIC, encoder.dtype.itemsize, digest))
                    entries, offsets = [], [HEADER_SIZE]
                ids = encoder.encode(text.as_py()) + end
                frame = press.compress(ids)
                out.write(frame)
                entries.append((doc_id or 0, doc_id is not None, len(ids) // encoder.dtype.itemsize))
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= SHARD_BYTES:
                    yield row(finish())
                    out, roll = None, roll + 1
        if out is not None:
            yield row(finish())

    return Scratch(spark).keep(ordered.mapInArrow(run, MANIFEST), "token-manifest")


MANIFEST_ARROW = pa.schema(
    [("part", pa.int32()), ("roll", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
)


class Shard:
    """Random access to one shard: the index is read once, a document by its own frame."""

    def __init__(self, uri: str):
        import zstandard as zstd

        fs, place = file_system(uri)
        self.file = fs.open_input_file(place)
        magic, width, digest = struct.unpack(HEADER, self.file.read_at(HEADER_SIZE, 0))
        size = self.file.size()
        at, n, tail = struct.unpack(FOOTER, self.file.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} is not a complete token shard")
        with fs.open_input_stream(f"{place.rsplit('/', 1)[0]}/dictionary-{digest.hex()}") as source:
            dictionary = source.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {uri} is damaged")
        self.dtype = np.dtype(f"<u{width}")
        index = self.file.read_at(size - FOOTER_SIZE - at, at)
        self.entries = np.frombuffer(index, dtype=ENTRY, count=n)
        self.offsets = np.frombuffer(index, dtype="<u8", offset=n * ENTRY.itemsize)
        self.unpress = zstd.ZstdDecompressor(dict_data=codec(dictionary))

    def ids(self, i: int) -> np.ndarray:
        lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
        ids = np.frombuffer(self.unpress.decompress(self.file.read_at(hi - lo, lo)), dtype=self.dtype)
        if len(ids) != self.entries["n_tokens"][i]:
            raise ValueError("a frame does not hold the tokens of its index")
        return ids


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    `start` counts the ids of all documents before: shard totals (one row per shard) are summed in a window, the rest comes
    from each shard's index. Every shard is one task's work.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))
    shards = placed.select("path", "start").repartition(max(1, min(manifest.count(), 4096)))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields)
    text = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                for lo in range(0, len(shard.entries), 1024):
                    rows = []
                    for i in range(lo, min(lo + 1024, len(shard.entries))):
                        entry, ids = shard.entries[i], shard.ids(i)
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        rows.append((int(entry["doc_id"]) if entry["has_id"] else None, start, len(ids), crc, *([ids.astype("i4")] if with_ids else [])))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return shards.mapInArrow(run, text)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Write all documents as token shards and read them back.

    Null and empty texts hold the end id alone; null ids come first; rows with one id follow
    each other by the hash of their texts; an empty table writes no shard and gives no rows.
    Other columns are not read.
    """
    return read_shards(write_shards(docs, path, end_id), with_ids)


def op10_zstd_dictionary_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenized(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
