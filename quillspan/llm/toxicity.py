"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm._common import carried, give_back, map_arrow, spool, strings, text_slices, uncarried

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Chance that a term of no bearing enters the learned lexicon, over all terms.
LEXICON_ERROR = 0.01
CACHED = 150_000

#: Common English insults.
INSULTS = frozenset(
    "asshole bastard bitch bozo brainless bum clown coward creep cretin crap cunt degenerate dickhead dimwit dirtbag disgusting dope dumb dumbass dunce "
    "failure filth filthy fool fraud freak garbage goon halfwit hypocrite idiot idiotic ignorant imbecile jackass jerk joke kill lame liar loser lowlife lunatic maggot "
    "moron moronic nasty nitwit parasite pathetic phony pig psycho rat repulsive retard scum scumbag shit shut sicko simpleton skank slime slob slut sucker "
    "stupid swine thug trash twit ugly useless vermin vile weasel whore wimp worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre you're".split())
#: Digits and signs that stand for letters in disguised words.
LOOKALIKE = str.maketrans("013457@$!|+", "oieastasiit")
EDGES = "\"'`.,;:!?()[]{}<>|/\\-_~"
SEED, LEARNED, DISGUISED, SECOND, SHOUT = 1, 2, 4, 8, 16
FEATURES = ("seed_density", "learned_density", "hits", "distinct_hits", "near_second_person", "shouting", "exclaiming", "punctuation", "disguised", "repeating", "words")


def terms_of(token: str) -> list[str]:
    """A word, and its first four and five letters marked by *: inflected words share those."""
    word = token.strip(EDGES).lower()
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)] if word.isalpha() else []


class TokenClasses(dict):
    """What a white-space token is, worked out once a worker."""

    def __init__(self, learned: frozenset[str]):
        super().__init__()
        self.learned = learned

    def __missing__(self, token: str) -> int:
        word = token.strip(EDGES)
        low = word.lower()
        kind = SEED * (low in INSULTS) | SECOND * (low in SECOND_PERSON) | SHOUT * (len(word) > 2 and word.isupper())
        kind |= LEARNED * any(t in self.learned for t in terms_of(token))
        if not low.isalpha() and not low.isdigit() and low:
            plain = re.sub(r"[^a-z]", "", low.translate(LOOKALIKE))
            kind |= DISGUISED | SEED if plain in INSULTS else DISGUISED * bool(re.search(r"[a-z][0-9@$!*#|+]+[a-z]", low))
        elif re.sub(r"(.)\1+", r"\1", low) in _SQUEEZED and low not in INSULTS:
            kind |= SEED | DISGUISED
        if len(self) >= CACHED:
            self.clear()
        self[token] = kind
        return kind


_SQUEEZED = frozenset(re.sub(r"(.)\1+", r"\1", w) for w in INSULTS)
_repeats = re.compile(r"(.)\1{3}")


def features(text: str, classes: TokenClasses) -> list[float]:
    """FEATURES of a whole text; densities are per 100 words."""
    tokens = text.split()
    kinds = np.frombuffer(bytes(map(classes.__getitem__, tokens)), np.uint8)
    n = max(1, len(tokens))
    hits = np.flatnonzero(kinds & (SEED | LEARNED))
    second = np.flatnonzero(kinds & SECOND)
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        near = int(np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)])).__le__(5).sum())
    marks = sum(map(text.count, ",.;:-*#@$%"))
    return [
        100 * np.count_nonzero(kinds & SEED) / n,
        100 * np.count_nonzero(kinds & LEARNED) / n,
        math.log1p(len(hits)),
        float(len({tokens[i].strip(EDGES).lower() for i in hits.tolist()})),
        100 * near / n,
        100 * np.count_nonzero(kinds & SHOUT) / n,
        100 * (text.count("!") + text.count("?")) / n,
        100 * marks / n,
        100 * np.count_nonzero(kinds & DISGUISED) / n,
        float(bool(_repeats.search(text))),
        math.log1p(len(tokens)),
    ]


def feature_rows(docs: DataFrame, learned: list[str], id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of `docs`: id_col, features (array of double), carried (struct). Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(learned))

    @F.arrow_udf("array<double>")
    def of_texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back(True)
        classes = TokenClasses(shared.value)
        for column in columns:
            flat = np.array([features(x, classes) for _, texts in text_slices(column) for x in texts], np.float64).reshape(-1, len(FEATURES))
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32)), pa.array(flat.ravel()))
        give_back()

    # only texts go to Python: the other columns wait in Spark
    return docs.select(F.col(id_col), of_texts(F.col(text_col).cast("string")).alias("features"), carried(carry, (id_col, "score")))


def learned_lexicon(sample: DataFrame) -> list[str]:
    """Terms of `sample` (text, label) that labelled texts hold more often than chance allows, the surest first.

    Equal texts count once. A term found in n texts, a share q of them toxic, against a base share p, has by Chernoff
    a chance of at most exp(-n KL(q, p)) to be so one-sided; this times the number of terms must be below LEXICON_ERROR.
    All terms that pass are learned. `sample` has a bounded number of rows, and a term must stand in three of them.
    """
    texts = sample.groupBy("text").agg(F.max("label").alias("label"))
    total, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return []

    def work(batch: pa.RecordBatch):
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, held in text_slices(batch.column(0), 1_000_000):
            own = [{t for x in set(text.split()) for t in terms_of(x)} for text in held]
            yield pa.RecordBatch.from_arrays([pa.array([y for x in own for y in x], pa.string()), pa.array(np.repeat(labels[start : start + len(held)], [len(x) for x in own]))], ["term", "label"])

    terms = map_arrow(texts.select("text", F.col("label").cast("long")), work, "term string, label long").groupBy("term").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n"))
    p, q = F.lit(toxic / total), F.col("k") / F.col("n")
    clean = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    sure = terms.where("k >= 3").where(q > p).withColumn("gain", F.col("n") * (q * F.log(q / p) + clean)).where(q > 0.5)
    count = terms.count()
    return [r["term"] for r in sure.where(F.col("gain") > math.log(max(count, 1) / LEXICON_ERROR)).orderBy(F.desc("gain"), "term").collect()]


class ToxicityModel:
    """Boosted trees and their calibration; `constant` stands for both where the labels have one class only."""

    def __init__(self, learned: list[str], trees=None, curve=None, constant: float = 0.0):
        self.learned, self.trees, self.curve, self.constant = learned, trees, curve, constant

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
        """One row for each row of `docs`: id_col, score (0 to 1), then `carry`. See `toxicity_scores`."""
        if self.trees is None:
            return uncarried(docs.select(id_col, F.lit(float(self.constant)).alias("score"), carried(carry, (id_col, "score"))), id_col, "score")
        rows = feature_rows(docs, self.learned, id_col, text_col, carry).withColumn("features", array_to_vector("features"))
        raw = _raw(self.trees.transform(rows))
        # the curve is flat in places: a thousandth of the trees' own probability keeps their order there
        score = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))) + 0.001 * F.col("raw")) / 1.001
        return uncarried(self.curve.transform(raw).select(id_col, score.alias("score"), "carried"), id_col, "score")


def _raw(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw", vector_to_array("probability")[1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """Fit on at most `sample_rows` labelled rows, those with the smallest hash of their id; `usable` tells which labels may be used.

    Labels that are null or neither 0 nor 1, and those of ids without a document, are left out; of an id's several
    labels the largest counts. A quarter of the sample, by another hash, is held from the lexicon and the trees, and fits
    the curve; where it has fewer than five toxic rows, all rows do.
    """
    usable = F.lit(True) if usable is None else usable
    chosen = (
        labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = spool(sample.withColumn("curve", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) == 0), "toxicity-sample")
    learned = learned_lexicon(sample.where("NOT curve"))
    rows = feature_rows(sample, learned, "id", carry=["label", "curve"]).select(array_to_vector("features").alias("features"), "carried.*")
    rows = spool(rows, "toxicity-features")
    n = {(r["curve"], r["label"]): r["count"] for r in rows.groupBy("curve", "label").count().collect()}
    if not n.get((False, 0.0)) or not n.get((False, 1.0)):
        total = sum(n.values())
        return ToxicityModel(learned, constant=sum(k for (_, y), k in n.items() if y) / total if total else 0.0)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=16, maxDepth=3, stepSize=0.3, seed=11).fit(rows.where("NOT curve"))
    held = _raw(trees.transform(rows.where("curve") if sum(k for (c, y), k in n.items() if c and y) >= 5 else rows))
    # equal probabilities as one point with their mean, which is what the curve needs of them
    points = held.groupBy("raw").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(points)
    return ToxicityModel(learned, trees, curve)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row for each row of `docs`: id_col, score (0 to 1, higher: likelier toxic).

    Scores read texts only. Null and empty texts get the score of a text without words; texts of any length are read
    whole. Null ids and repeated rows pass through. Without labels of both classes every row gets the labels' mean, or
    0 where there are none. An empty table gives no rows. Other columns are not read.
    """
    return fit_toxicity(docs, labels, usable, id_col, text_col, label_col, sample_rows).score(docs, id_col, text_col)
