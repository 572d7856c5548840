"""Toxicity scores behind a noisy-channel decoder.

Disguised words are restored before scoring. A word with digits or signs among its letters, with
letters repeated three times and more, with separators between its letters, or a run of single
letters (whatever signs stand around them) spells a lattice: every observed character could stand for
several letters, be a repeat, or be a mere separator, each at a cost. In a run, words may also end
after any letter, and for scoring every piece of its letters counts that is a word with a weight. The
Viterbi path under a trigram model of letters, which is counted over the characters of all documents, is the word restored. Words without such marks stay as they are.

The restored text is then scored by its words and word beginnings: a document's score is the
logistic function of the summed weights of what it holds. The weights are those of a logistic
regression on all features of the labelled rows under a Laplace prior of rate ``PENALTY``, whatever
their number; the prior leaves most of them zero. Near copies count once.

Bounds: labels are learned from at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hashes; the driver holds two numbers for each feature of each of these rows, some 200 bytes a row at a
hundred words. Letter counts are taken over the whole table and have at most 28 ** 3 entries. Workers
hold the features of ``FEATURE_ROWS`` texts at a time.

Nulls and edge cases: a null text counts as empty; an empty text gets the score of a document
without any feature; a null ``doc_id`` is neither learned from nor held out; labels without a
``doc_id`` or a mark are not used; where nothing can be learned every score is the prior; long
texts are scored whole; repeated rows are scored alike; of paths of equal cost the first is taken,
and a score of just the threshold is toxic; a ``doc_id`` labelled both ways is toxic; an empty table
gives an empty result; other columns of the input are ignored by ``score`` and kept by
``without_toxic``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, id_remainder, read
from vitaeflow.llm.near_duplicates import Sketcher, values, words_of

FOLDS = 4
HELD_OUT_FOLD = 2
THRESHOLD = 0.3
#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 20_000
#: Rate of the weights' prior: the log likelihood that a weight of 1 must bring.
PENALTY = 0.5
#: Rounds of fitting, at most; features taken in by a round; a fit ends at this excess of a slope.
ROUNDS, ENTERING, TOLERANCE = 60, 1000, 0.05
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: Letters of a piece of a spelled run that is looked up as a word, at least.
PIECE = 3
CACHE_ENTRIES = 50_000
#: Rows whose features are held as Python objects at once.
FEATURE_ROWS = 100
#: Slices in which the features of labelled rows come to the driver.
SLICES = 8

# The letters that a character may stand for, with channel costs in nats.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
MASKS = {"*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_~·'’"
COST_SAME, COST_LEET, COST_MASK, COST_REPEAT, COST_SEPARATOR = 0.05, 0.5, 1.6, 0.7, 0.3
#: Signs that are taken off at both ends of a word.
EDGES = ".,;:?\"'()[]{}<>«»“”„‘’…-–—_~·`%&/\\^=|*#"

LETTERS = 28  # 0: no letter, 1 to 26: a to z, 27: another character than those of ASCII
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, dtype=np.int64)
    for batch in batches:
        column = batch.column(0).cast(pa.large_string())
        raw = column.buffers()[2]
        if raw is None or not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, dtype=np.uint8)
        before = np.zeros(2, dtype=np.int64)
        for a in range(int(offsets[0]), int(offsets[-1]), 1 << 21):
            part = data[a : min(a + (1 << 21), int(offsets[-1]))]
            first = (part & 0xC0) != 0x80  # a character's further bytes don't count
            starts = np.unique(offsets[:-1][(offsets[:-1] >= a) & (offsets[:-1] < a + len(part))]) - a
            # Texts have nothing before them.
            kind = np.insert(_CLASS[part[first]], np.repeat(np.cumsum(first)[starts] - 1, 2), 0)
            kind = np.concatenate([before, kind])
            total += np.bincount((kind[:-2] * LETTERS + kind[1:-1]) * LETTERS + kind[2:], minlength=LETTERS**3)
            before = kind[-2:]
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Costs in nats of each letter after two others, from all texts of ``docs``."""
    counted = (
        docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .transform(arrow_map, _letter_counts, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    three = np.zeros(LETTERS**3)
    three[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    three = three.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def decode(word: str, costs: np.ndarray, ends: bool = False) -> str:
    """The likeliest letters behind a lower-case disguised word: the Viterbi path of its lattice.

    With ``ends`` a word may end after any letter, and the words are joined by spaces.
    """
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for char in word:
        options: list[tuple[int, str, float]] = []
        if "a" <= char <= "z":
            options.append((ord(char) - 96, char, COST_SAME))
        elif char.isalpha():
            options.append((27, char, COST_SAME))
        for x in LEET.get(char, ""):
            options.append((ord(x) - 96, x, COST_LEET))
        for x in MASKS.get(char, ""):
            options.append((ord(x) - 96, x, COST_MASK))
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, way) in paths.items():
            for kind, letter, price in options:
                now = cost + price + costs[a, b, kind]
                if (b, kind) not in after or now < after[b, kind][0]:
                    after[b, kind] = (now, (way, letter))
                if kind == b and way and way[1] == letter and (now := cost + price + COST_REPEAT) < after.get((a, b), (math.inf,))[0]:
                    after[a, b] = (now, way)
            if char in SEPARATORS or not options:
                now = cost + (COST_SEPARATOR if char in SEPARATORS else 2.0)
                if now < after.get((a, b), (math.inf,))[0]:
                    after[a, b] = (now, way)
        if ends:
            for (a, b), (cost, way) in list(after.items()):
                if b and (now := cost + costs[a, b, 0]) < after.get((b, 0), (math.inf,))[0]:
                    after[b, 0] = (now, (way, " "))
        paths = after
    way = min(((cost + (costs[a, b, 0] if b or not ends else 0.0), k, way) for k, ((a, b), (cost, way)) in enumerate(paths.items())), default=(0, 0, ()))[2]
    out = []
    while way:
        way, letter = way
        out.append(letter)
    return "".join(reversed(out))


_DISGUISED = re.compile(r"(.)\1\1|[^\W\d_].*[^\w'’-]|[^\w'’-].*[^\W\d_]|[^\W\d_].*\d|\d.*[^\W\d_]|(?:^|[.\-_~·'’])[^\W\d_](?:[.\-_~·'’][^\W\d_]){2}")
_THRICE = re.compile(r"(.)\1\1")
_EDGE_RUN = re.compile(r"^([^\w])\1\1+|([^\w])\2\2+$")


def core(word: str) -> str:
    """A lower-case word without the signs around it."""
    return _EDGE_RUN.sub("", word.strip(EDGES)).strip(EDGES)


class Restorer:
    """Restores words of texts; results by word are kept, in a table emptied when full."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, str] = {}

    def word(self, word: str) -> str:
        if word.isalpha() and not _THRICE.search(word):
            return word
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            found = core(word)
            if found and not (found[-1] != "!" and found.isalpha() and not _THRICE.search(found)):
                bare = found.rstrip("!")
                if not bare or bare.isdigit():
                    found = bare
                elif _DISGUISED.search(bare):
                    found = decode(bare, self.costs)
                else:
                    found = bare
            self.known[word] = found
        return found

    def runs(self, words: list[str]) -> list[str]:
        """Runs of three and more single characters, without the signs around each."""
        out, run, last = [], [], -2
        singles = [(i, w if len(w) == 1 else x) for i, w in enumerate(words) if len(w) == 1 or not w.isalpha() and len(x := core(w) if w[-1] != "!" else core(w.rstrip("!"))) == 1]
        if len(singles) < 3:
            return out
        for i, char in [*singles, (-5, "")]:
            if i == last + 1:
                run.append(char)
            else:
                if len(run) > 2:
                    out.append("".join(run))
                run = [char]
            last = i
        return out

    def spelled(self, runs: list[str]) -> list[str]:
        """Words spelled by runs of single characters, as they are likeliest divided."""
        return [w for run in runs for w in decode(run, self.costs, True).split()]

    def divisions(self, runs: list[str], longest: int) -> Iterator[str]:
        """All pieces of the letters spelled by runs of single characters, however divided."""
        for run in runs:
            for x in {decode(run, self.costs), decode(run, self.costs, True).replace(" ", "")}:
                yield from (x[i:j] for i in range(len(x)) for j in range(i + PIECE, min(len(x), i + longest) + 1))

    def text(self, text: str) -> list[str]:
        words = text.lower().split()
        return [*map(self.word, words), *self.spelled(self.runs(words))]


def features(word: str) -> list[str]:
    """A restored word and its beginnings (marked by a dash)."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)] if word else []


def _feature_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for k in range(0, batch.num_rows, FEATURE_ROWS):
                part = batch.slice(k, FEATURE_ROWS)
                held = [sorted({f for w in set(restorer.text(text)) for f in features(w)}) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(held, pa.list_(pa.string()))], names=["toxic", "features"])

    return run


def _least_hash(text: Column) -> Column:
    """The least hash of a text's shingles, which most near copies share."""

    def least(texts: pd.Series) -> pd.Series:
        sketcher = Sketcher()
        return pd.Series([int(own[0] >> np.uint64(1)) if len(own := sketcher.hashes(words_of(t.encode()))) else -1 for t in texts], dtype="int64")

    return F.pandas_udf(least, "long")(text)


def fit_weights(rows: np.ndarray, ends: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """The intercept and the weight of each feature by penalised logistic regression.

    Feature j stands in the rows ``rows[ends[j] : ends[j + 1]]``; ``toxic`` is 0 or 1 by row. Newton
    steps by coordinate over the features that are in use or whose slope exceeds the penalty.
    """
    weights = np.zeros(len(ends) - 1)
    cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), len(weights)])  # about a million pairs at once
    intercept = math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    margin = np.full(len(toxic), intercept)
    chance = 1 / (1 + np.exp(-margin))
    for _ in range(ROUNDS):
        left = toxic - chance
        slopes = np.concatenate([np.add.reduceat(left[rows[ends[a] : ends[b]]], ends[a:b] - ends[a]) for a, b in zip(cuts, cuts[1:], strict=False)] or [weights])
        used = np.flatnonzero(weights)
        aside = np.abs(slopes[used] - PENALTY * np.sign(weights[used]))
        excess = np.abs(slopes, out=slopes)
        excess -= PENALTY
        excess[used] = aside
        if excess.max(initial=0.0) < TOLERANCE:
            break
        wanted = np.flatnonzero((weights == 0) & (excess >= TOLERANCE))
        wanted = wanted[np.argsort(-excess[wanted], kind="stable")[:ENTERING]]
        active = np.union1d(np.flatnonzero(weights), wanted)
        for _ in range(3):
            step = float((toxic - chance).sum() / max(1e-6, (chance * (1 - chance)).sum()))
            step = max(-1.0, min(1.0, step))
            intercept += step
            margin += step
            chance = 1 / (1 + np.exp(-margin))
            for j in active.tolist():
                own = rows[ends[j] : ends[j + 1]]
                p = chance[own]
                bend = max(float((p * (1 - p)).sum()), 0.01)
                aim = weights[j] + float((toxic[own] - p).sum()) / bend
                aim = math.copysign(max(0.0, abs(aim) - PENALTY / bend), aim)
                step = max(-1.0, min(1.0, aim - weights[j]))
                if step:
                    weights[j] += step
                    margin[own] += step
                    chance[own] = 1 / (1 + np.exp(-margin[own]))
    return intercept, weights


class Model:
    """Letter costs, weights by feature, and the log odds of a document without any."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], prior: float):
        self.costs, self.weights, self.prior = costs, weights, prior


def learn(docs: DataFrame, labels: DataFrame, eligible: Column, costs: np.ndarray) -> Model:
    """Weights from the labelled rows of ``docs`` whose ``doc_id`` is eligible."""
    sample = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(eligible & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    # TRAIN_ROWS rows of two numbers at most, so it may be broadcast.
    labelled = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = labelled.withColumn("sketch", _least_hash(F.col("text"))).groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    model = docs.sparkSession.sparkContext.broadcast(costs)
    held = cut(rows.transform(arrow_map, _feature_rows(model), "toxic int, features array<string>"))
    hashed = cut(held.select(F.monotonically_increasing_id().alias("row"), "toxic", F.transform("features", lambda f: F.xxhash64(f)).alias("hashes")))
    light = hashed.select("row", "toxic", F.size("hashes").alias("n")).toArrow()
    order = np.argsort(light.column("row").to_numpy())
    ids, toxic = light.column("row").to_numpy()[order], light.column("toxic").to_numpy().astype(np.float64)[order]
    if not 0 < toxic.sum() < len(toxic):
        return Model(costs, {}, -4.0)
    # The pairs of rows and features are many, so they come in slices, each with all rows of its features.
    rows = np.empty(int(light.column("n").to_numpy().sum()), dtype=np.int32)
    hashes, ends, at = [], [], 0
    for k in range(SLICES):
        table = hashed.select("row", F.filter("hashes", lambda h: F.pmod(h, F.lit(SLICES)) == k).alias("hashes")).toArrow()  # noqa: B023
        lists = table.column("hashes").combine_chunks()
        owner = np.repeat(np.searchsorted(ids, table.column("row").to_numpy()).astype(np.int32), pa.compute.list_value_length(lists).to_numpy())
        flat = lists.flatten().to_numpy()
        by = np.argsort(flat, kind="stable")
        rows[at : at + len(by)], flat = owner[by], flat[by]
        new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]][: len(flat)])
        hashes.append(flat[new])
        ends.append(new + at)
        at += len(by)
    del table, lists, owner, flat, by, new
    hashes, ends = np.concatenate(hashes), np.concatenate([*ends, [at]])
    intercept, weights = fit_weights(rows, ends, toxic)
    used = np.flatnonzero(weights)
    by_hash = dict(zip(hashes[used].tolist(), weights[used].tolist(), strict=True))
    # As many rows as the prior leaves weights.
    wanted = docs.sparkSession.createDataFrame([(h,) for h in by_hash], "hash long")
    names = held.select(F.explode("features").alias("feature")).distinct().withColumn("hash", F.xxhash64("feature")).join(F.broadcast(wanted), "hash").collect()
    return Model(costs, {r["feature"]: by_hash[r["hash"]] for r in names}, intercept)


_kept: list = []


def _kept_for(model: Model) -> tuple[Restorer, dict[str, float], dict[str, tuple]]:
    """What a worker process keeps for a model: its restorer and the features of known words."""
    if not _kept or _kept[0] is not model:
        _kept[:] = [model, (Restorer(model.costs), model.weights, {})]
    return _kept[1]


def _scoring(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        restorer, weights, known = _kept_for(own)
        longest = max(map(len, weights), default=0)

        def hits(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                found = known[word] = tuple(f for f in features(restorer.word(word)) if f in weights)
                restorer.known.clear()
            return found

        for batch in batches:
            scores = []
            for text in values(batch.column("text")):
                words = text.lower().split()
                held = {f for found in map(hits, set(words)) if found for f in found}
                runs = restorer.runs(words)
                for spelled in restorer.spelled(runs):
                    held.update(f for f in features(spelled) if f in weights)
                for piece in restorer.divisions(runs, longest):
                    if weights.get(piece, 0.0) > 0 or weights.get(piece + "-", 0.0) > 0:
                        held.update(f for f in features(piece) if f in weights)
                odds = own.prior + sum(sorted(weights[f] for f in held))
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
            score = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), score, pa.array((np.asarray(score) >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    light = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return light.transform(arrow_map, _scoring(shipped, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = batch.column("text").fill_null("")
            none = pa.nulls(batch.num_rows)
            return pa.RecordBatch.from_arrays([none, none, text], names=["doc_id", "held_out", "text"])

        for batch in batches:
            for scored in _scoring(shipped, threshold)(iter([texts(batch)])):
                yield batch.filter(pa.compute.equal(scored.column("predicted"), 0))

    return docs.transform(arrow_map, run, docs.schema)


def restore(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """doc_id and the restored words of each text, joined by spaces (spelled words at the end)."""
    model = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        restorer = Restorer(model.value)
        for batch in batches:
            texts = [" ".join(filter(None, restorer.text(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    light = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return light.transform(arrow_map, run, light.schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a table and its labels; rows of one fold in four are not learned from."""
    return learn(docs, labels, id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD, letter_model(docs))


def held_out() -> Column:
    return F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")), held_out())


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op4_toxicity": op4_toxicity}
