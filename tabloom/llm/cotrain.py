"""Quality and toxicity classifiers by co-training a text view and a page-metadata view.

Each view is a sparse logistic regression over hashed features: for the text its words, for the metadata source,
language, lengths and layout. Texts are read as features once, into a table in the shared folder, 4 bytes per distinct
word. The labelled sample is bounded and fitted by one task per head; the features of every unlabelled
document are scored in every round, and the surest become pseudo-labels of the
other view. The driver holds weights, counts per bin of the margins and the keys picked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, read, text_of

#: Labelled documents that models are fitted on; all others of a larger table only get scores.
MAX_LABELLED = 20_000
ROUNDS = 2
#: Pseudo-labels a view hands over per round and head, as a share of the labelled fitting rows, and the least confidence.
HANDED = 0.1
CONFIDENT = 0.95
SURE = math.log(CONFIDENT / (1 - CONFIDENT))
CALIBRATION = 5  # one labelled row in so many calibrates and is never fitted on
VIEWS = ("text", "meta")
HEADS = ("quality", "toxic")
#: Places of hashed features, and the penalty on the sum of absolute weights, per view.
PLACES = {"text": 1 << 20, "meta": 1 << 16}
PENALTY = {"text": 3e-3, "meta": 1e-3}
STEPS = 300
STILL = 1e-6  # no weight moves further: done
#: Margins are counted in bins of this width when the surest are looked for.
BINS_PER_UNIT = 64
KNOWN_WORDS = 500_000

_MARKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
_BARE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_ODD = b"#*$%&|<>!?{}[]_=+~^"
_STOPS = b".,;:"


class Features:
    """Texts and their metadata to the places of their hashed features, each once."""

    def __init__(self):
        import xxhash

        places = PLACES["text"]

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                self[word] = value = xxhash.xxh3_64_intdigest(word) % places
                return value

        self.words, self.hash = Words(), xxhash.xxh3_64_intdigest

    def __call__(self, text: str, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        low = raw.lower()
        words = low.split()
        known = set(words)
        variety = len(known)
        known.update(b" ".join(known).translate(_BARE).split())  # as of the whole text, each word once
        found = np.unique(np.fromiter(map(self.words.__getitem__, known), dtype=np.int32, count=len(known)))
        return found, self.metadata(text, raw, len(words), variety, source, lang, n_chars)

    def metadata(self, text: str, raw: bytes, n_words: int, variety: int, source, lang, n_chars) -> np.ndarray:
        """Source, language, and steps of length and layout, as hashed words."""
        size = max(1, len(text))
        count = lambda chars: len(raw) - len(raw.translate(None, chars))
        step = lambda n: math.floor(2 * math.log2(1 + max(n, 0)))
        lines = 1 + raw.count(b"\n")
        named = {
            "source": source or "", "lang": lang or "", "chars": step(len(text) if n_chars is None else n_chars),
            "lines": step(lines), "line_length": step(size / lines), "word_length": size // max(1, n_words),
            "capitals": 20 * count(_UPPER) // size, "digits": 20 * count(_DIGITS) // size, "marks": 20 * count(_ODD) // size,
            "stops": 20 * count(_STOPS) // size, "variety": 20 * variety // max(1, n_words),
        }
        return np.unique([self.hash(f"{k}={v}".encode("utf-8", "surrogatepass")) % PLACES["meta"] for k, v in named.items()]).astype(np.int32)


READ = ["text", "source", "lang", "n_chars"]
NAMES = ["key", "same", "doc_id"]


def featured(docs: DataFrame) -> DataFrame:
    """Per row its names and (words, facts): the places of both views' features."""
    places = [pa.field(c, pa.binary()) for c in ("words", "facts")]
    names = docs.select(*NAMES).schema

    def run(batches):
        features = Features()
        for batch in batches:
            made = [features(*(v.as_py() for v in r)) for r in zip(*(batch.column(c) for c in READ))]
            columns = [batch.column(c) for c in NAMES] + [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(batch.schema.field(c) for c in NAMES), *places]))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)
    return docs.select(*NAMES, *READ).mapInArrow(run, f"{ddl}, words binary, facts binary")


# --- fitting a bounded sample ---------------------------------------------------------------


@dataclass
class Rows:
    """Rows of hashed features, one after the other."""

    places: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(parts: list[bytes]) -> "Rows":
        arrays = [np.frombuffer(p, np.int32) for p in parts]
        return Rows(np.concatenate([np.zeros(0, np.int32), *arrays]), np.cumsum([0, *map(len, arrays)]))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """As margins, but no row's sum hangs on the rows beside it."""
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return np.bincount(owner, weights=weights[self.places], minlength=len(self.starts) - 1)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(weights[self.places])])
        return upto[self.starts[1:]] - upto[self.starts[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_view(rows: Rows, label: np.ndarray, penalty: float, size: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of few places and a free constant: logistic loss in which both classes weigh the same, by accelerated proximal steps."""
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    owner = np.repeat(np.arange(len(label)), np.diff(rows.starts))
    used, at = np.unique(rows.places, return_inverse=True)
    # a place's slope is at most the share of the rows that have it: with no more than the penalty its weight is always 0
    able = np.bincount(at, weights=share[owner], minlength=len(used)) > penalty
    keep = able[at]
    used, at, owner = used[able], (np.cumsum(able) - 1)[at[keep]], owner[keep]
    small = Rows(at, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(label)))])
    v = np.ones(len(used) + 1)
    curve = 1.0
    for _ in range(12):  # the largest curvature, by powers
        z = small.margins(v[:-1]) + v[-1]
        push = share * z / 4
        v = np.r_[np.bincount(at, weights=push[owner], minlength=len(used)), push.sum()]
        curve = float(np.linalg.norm(v)) or 1.0
        v /= curve
    rate = 1 / (1.1 * curve)
    w = ahead = np.zeros(len(used) + 1)
    momentum = 1.0
    for _ in range(steps):
        error = share * (sigmoid(small.margins(ahead[:-1]) + ahead[-1]) - label)
        slope = np.r_[np.bincount(at, weights=error[owner], minlength=len(used)), error.sum()]
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        if ((ahead - new) @ (new - w)) > 0:  # start over when a step turns back
            momentum, ahead = 1.0, w
            w = new
            continue
        if np.abs(new - w).max() < STILL:
            w = new
            break
        later = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    out = np.zeros(size, dtype=np.float32)
    out[used] = w[:-1]
    return out, float(w[-1])


def calibrate(margins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression on a few margins, lightly penalised, by Newton's method; the constant comes last."""
    x = np.c_[margins, np.ones(len(label))]
    w = np.zeros(x.shape[1])
    hold = np.r_[np.full(x.shape[1] - 1, 1e-3 * len(label)), 1e-9]
    for _ in range(100):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold), x.T @ (p - label) + hold * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Head:
    """One target: weights and constant per view, a calibration per view and of both; or a constant where labels hold one class."""

    constant: float | None
    weights: dict[str, np.ndarray]
    constants: dict[str, float]
    sigmoids: dict[str, list[float]]
    quota: dict[int, int]


TASKS = [(h, v) for h in HEADS for v in VIEWS]
FITTED = pa.schema([("task", pa.int32()), ("ones", pa.int64()), ("zeros", pa.int64()), ("weights", pa.binary()), ("constant", pa.float64())]
                   + [(c, pa.list_(pa.float64())) for c in ("labels", "margins")])
FITTED_DDL = "task int, ones long, zeros long, weights binary, constant double, labels array<double>, margins array<double>"


def fit_task(group: pa.Table, steps: int = STEPS) -> pa.Table:
    """Fit one view of one head on its bounded rows; with it come the labels and margins of the rows that calibrate, by key."""
    task = group.column("task")[0].as_py()
    order = np.argsort(group.column("key").to_numpy(), kind="stable")
    label = group.column("label").to_numpy()[order].astype(float)
    aside, given = (np.array(group.column(c).to_pylist())[order] for c in ("calibrates", "given"))
    places = np.array(group.column("places").to_pylist(), dtype=object)[order]
    own = ~aside & ~given
    ones, zeros = int((label[own] == 1).sum()), int((label[own] == 0).sum())
    row = (task, ones, zeros, None, 0.0, label[aside].tolist(), [])
    if ones and zeros and aside.any():
        view = TASKS[task][1]
        weights, constant = fit_view(Rows.of(list(places[~aside])), label[~aside], PENALTY[view], PLACES[view], steps)
        margins = Rows.of(list(places[aside])).margins(weights.astype(float)) + constant
        row = (task, ones, zeros, weights.tobytes(), constant, label[aside].tolist(), margins.tolist())
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, FITTED)], schema=FITTED)


def fit_heads(rows: DataFrame, steps: int) -> dict[str, Head]:
    """One task per head and view; rows: head, view, key, label, calibrates, words, facts, bounded by MAX_LABELLED and the quotas.

    `view` is null for labelled rows, which both views fit. The driver calibrates, on as many margins as there are rows kept aside.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("task"), F.col(c).alias("places"), F.lit(h).alias("_h"), F.lit(v).alias("_v"))
                      for i, ((h, v), c) in enumerate(zip(TASKS, ("words", "facts") * len(HEADS)))])
    dealt = rows.select("head", "view", "key", "label", "calibrates", F.inline(sides)).where("_h = head AND (view IS NULL OR _v = view)")
    dealt = dealt.select("task", "key", "label", "calibrates", F.col("view").isNotNull().alias("given"), "places").repartitionByRange(len(TASKS), "task")
    found = {TASKS[r["task"]]: r for r in dealt.groupBy("task").applyInArrow(lambda group: fit_task(group, steps), FITTED_DDL).collect()}
    out = {}
    for h in HEADS:
        parts = [found.get((h, v)) for v in VIEWS]
        if parts[0] is None:
            out[h] = Head(0.5, {}, {}, {}, {})
            continue
        ones, zeros = parts[0]["ones"], parts[0]["zeros"]
        quota = {1: int(HANDED * ones), 0: int(HANDED * zeros)}
        label = np.array(parts[0]["labels"])
        if not ones or not zeros or set(label.tolist()) != {0.0, 1.0}:
            out[h] = Head(ones / (ones + zeros) if ones + zeros else 0.5, {}, {}, {}, quota)
            continue
        margins = [np.array(p["margins"]) for p in parts]
        sigmoids = {v: calibrate(m[:, None], label).tolist() for v, m in zip(VIEWS, margins)} | {"both": calibrate(np.stack(margins, 1), label).tolist()}
        weights = {v: np.frombuffer(p["weights"], np.float32) for v, p in zip(VIEWS, parts)}
        out[h] = Head(None, weights, {v: p["constant"] for v, p in zip(VIEWS, parts)}, sigmoids, quota)
    return out


# --- scoring --------------------------------------------------------------------------------

MARGINS = [f"{h}_{v}" for h in HEADS for v in VIEWS]


def margins_of(rows: DataFrame, heads: dict[str, Head], kept: list[str]) -> DataFrame:
    """The columns `kept` and the margin of every head and view (0 for a constant head), per row of features, where it is read."""
    schema = rows.select(*kept).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", " + ", ".join(f"{m} double" for m in MARGINS)
    shared = rows.sparkSession.sparkContext.broadcast({h: (m.weights, m.constants) for h, m in heads.items() if m.weights})  # 9 MB at most

    def run(batches):
        models = shared.value
        for batch in batches:
            found = {v: Rows.of(batch.column(c).to_pylist()) for v, c in zip(VIEWS, ("words", "facts"))}
            columns = [batch.column(c) for c in kept]
            for h in HEADS:
                for v in VIEWS:
                    margins = found[v].sums(models[h][0][v]) + models[h][1][v] if h in models else np.zeros(batch.num_rows)
                    columns.append(pa.array(margins, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *MARGINS])

    return rows.select(*dict.fromkeys([*kept, "words", "facts"])).mapInArrow(run, ddl)


def picked(scores: DataFrame, heads: dict[str, Head], used: dict[str, set[int]]) -> list[tuple[int, str, str, int]]:
    """(key, head, receiving view, label): of every head, view and class the surest rows up to the quota.

    The rows are counted per bin of the margin first; only those in bins that can hold the surest are ordered. A view
    names rows with a calibrated confidence of CONFIDENT at least, and no row that its head has used before.
    """
    tests, bins = [], []
    for h, head in heads.items():
        for v in VIEWS if head.weights else ():
            slope, constant = head.sigmoids[v]
            for label, sign in ((1, 1.0), (0, -1.0)):
                z = sign * (F.col(f"{h}_{v}") * slope + constant)
                if head.quota[label] and slope > 0:
                    tests.append((h, v, label, z))
                    step = F.when(z >= SURE, F.least(F.floor(z * BINS_PER_UNIT), F.lit(1 << 16)))
                    bins.append(F.struct(F.lit(len(tests) - 1).alias("test"), step.alias("bin")))
    if not tests:
        return []
    counts = scores.select(F.inline(F.array(*bins))).where("bin IS NOT NULL").groupBy("test", "bin").count().collect()  # at most 2^16 bins each
    out = []
    for i, (h, v, label, z) in enumerate(tests):
        quota, left, cut = heads[h].quota[label], heads[h].quota[label] + len(used[h]), None
        for r in sorted((r for r in counts if r["test"] == i), key=lambda r: -r["bin"]):
            cut, left = r["bin"], left - r["count"]
            if left <= 0:
                break
        if cut is None:
            continue
        # rows used before are fewer than the quotas of all rounds
        best = scores.select("key", z.alias("z")).where((F.floor(F.col("z") * BINS_PER_UNIT) >= cut) & (F.col("z") >= SURE)).orderBy(F.desc("z"), "key").limit(quota + len(used[h]))
        new = [r["key"] for r in best.collect() if r["key"] not in used[h]][:quota]
        used[h].update(new)
        out += [(key, h, VIEWS[1 - VIEWS.index(v)], label) for key in new]
    return out


# --- the whole ------------------------------------------------------------------------------


def labels_of(labels: DataFrame) -> DataFrame:
    """One row per id: quality 1 only if all its labels say so, toxic 1 if any does."""
    return (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )


def co_train(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[dict[str, Head], list]:
    """The fitted heads and the pseudo-labels handed over, as (round, key, head, receiving view, label); docs: NAMES, READ."""
    made = scratch.keep(featured(docs), "document-features")
    try:
        return trained(made, labels, scratch, max_labelled, rounds, steps)
    finally:
        scratch.drop(made)


def trained(made: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[dict[str, Head], list]:
    """As co_train, of the features of the documents.

    A round fits and calibrates both views of each head, scores all unlabelled documents, of copies the least key, and lets each view hand
    the ones it is surest of to the other view. A last fit uses all pseudo-labels.
    """
    spark = made.sparkSession
    known = labels_of(labels)
    chosen = known.join(made.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(max_labelled)
    chosen = scratch.keep(chosen.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(CALIBRATION)) == 0), "labelled-ids")
    sample = made.select(*NAMES).join(F.broadcast(chosen), "doc_id").groupBy("same", *HEADS).agg(F.min(F.struct("key", "calibrates")).alias("row"))  # copies would weigh their words up
    sample = scratch.keep(sample.select("row.*", *HEADS).dropDuplicates(["key"]), "labelled-keys")
    places = made.select("key", "words", "facts")
    features = places.join(F.broadcast(sample.select("key")), "key", "left_semi").dropDuplicates(["key"])
    one = F.inline(F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("label")) for h in HEADS]))
    base = features.join(F.broadcast(sample), "key").select("key", "calibrates", "words", "facts", one).where("label IS NOT NULL")
    base = scratch.keep(base.withColumn("view", F.lit(None).cast("string")), "labelled-rows")
    rows, handed, used = base, [], {h: set() for h in HEADS}
    heads = fit_heads(rows, steps)
    for turn in range(rounds):
        if all(not h.weights for h in heads.values()):
            break
        scores = margins_of(made, heads, NAMES).join(known.select("doc_id"), "doc_id", "left_anti")
        scores = scratch.keep(scores.groupBy("same").agg(F.min(F.struct("key", *MARGINS)).alias("row")).select("same", "row.*"), "pool-margins")
        new = picked(scores, heads, used)
        scratch.drop(scores)
        if not new:
            break
        handed += [(turn, *x) for x in new]
        names = F.broadcast(spark.createDataFrame(new, "key long, head string, view string, label int"))  # within the quotas
        found = places.join(F.broadcast(spark.createDataFrame([(k,) for k in {x[0] for x in new}], "key long")), "key", "left_semi")
        fresh = found.dropDuplicates(["key"]).join(names, "key").withColumn("calibrates", F.lit(False))
        rows = rows.unionByName(scratch.keep(fresh, "pseudo-labels"))
        heads = fit_heads(rows, steps)
    return heads, handed


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every document: doc_id, p_quality, p_toxic, the views' margins, kept (p_quality >= 0.5 > p_toxic).

    Models are fitted on at most `max_labelled` labelled documents, in hash order of their ids, and on pseudo-labels
    from all unlabelled documents; all whole texts are scored. Null and empty texts have no words and are judged by
    their metadata; a null source, language or length is a value like any other; rows of one id share
    its label, and rows without an id have none. Without labels of both classes a head scores the share of its positives, or 0.5
    without labels. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = text_of(F.col("text"))
    named = {c: F.col(c).cast("string").alias(c) for c in ("source", "lang")}
    rows = docs.select(
        F.xxhash64("doc_id", text).alias("key"), F.xxhash64(text).alias("same"), "doc_id", text.alias("text"), *named.values(),
        F.col("n_chars").cast("long").alias("n_chars"),
    )
    made = scratch.keep(featured(rows), "document-features")
    heads, _ = trained(made, labels, scratch, max_labelled)
    scored = margins_of(made, heads, ["doc_id"])

    def probability(name: str):
        head = heads[name]
        if head.constant is not None:
            return F.lit(float(head.constant))
        a, b, c = head.sigmoids["both"]
        return 1 / (1 + F.exp(-(a * F.col(f"{name}_text") + b * F.col(f"{name}_meta") + c)))

    judged = scored.select(
        "doc_id", *[probability(n).alias(f"p_{n}") for n in HEADS], *[F.col(m).alias(f"{m}_margin") for m in MARGINS]
    )
    return judged.withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))


def op2_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
