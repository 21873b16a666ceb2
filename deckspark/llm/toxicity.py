"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Voters are lexicons (fixed ones, and words that the labelled training rows associate with toxic
texts, counted over all of them and dealt to several lexicons) and patterns of the whole text. A voter fires or not; one of
learned words goes by their log odds per word of the text, as any long text holds some of them, and fires above what nearly all
texts labelled clean have. The label model is a two-class mixture over the votes: it is fitted by expectation maximisation on the counts of vote
patterns of all texts, of which there are at most 2^voters, with the labelled training rows held to their
class. It starts with independent voters, finds pairs whose votes are correlated within the classes,
and refits with joint tables for them. Its posterior, or the label where there is one, is the target of a bounded sample of
rows, on which a logistic classifier over hashed words, votes and the learned words' odds per word is trained; that
classifier scores every text.

Defined cases: null and empty texts cast no vote and get the classifier's bias; a label that repeats for an id counts
as toxic if one of them is; null labels do not count; without any label the fixed voters alone
make the model; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckspark.llm.common import cut
from deckspark.llm.linear import SparseRows, fit_logistic
from deckspark.llm.words import ALPHANUMERIC, Slice, slices, words
from deckspark.operators.skew import fits_broadcast, lookup_join

#: Words of abuse by kind. Fixed values.
LEXICONS = {
    "insults": "idiot idiots moron morons loser losers clown clowns fool fools imbecile scum trash jerk creep freak",
    "contempt": "stupid dumb pathetic worthless disgusting useless ridiculous ugly filthy vile hateful",
    "threats": "kill die hurt destroy beat punch burn shoot suffer",
    "other_languages": "dumm dummkopf trottel abschaum idiota estupido imbécil basura crétin abruti ordure",
}
#: Lexicons that share the words learned from labels, and the least z-score of such a word.
LEARNED, LEAST_Z = 4, 4.5
#: Log odds per word are counted in such steps, up to a most; a text has so many words more, so that one word says little.
RATE_STEP, MOST_STEPS, MORE_WORDS = 1 / 4096, 1 << 14, 5
#: Share of the texts labelled clean in which a lexicon of learned words does not fire.
LEFT_ALONE = 0.95
#: Scale of the odds per word as a feature of the classifier, and its highest value.
RATE_SCALE, HIGHEST_RATE = 10.0, 10.0
#: Least size of the z-score of a hashed word for the classifier to use it.
SLOT_Z = 3.0
PATTERNS = ("shouting", "exclaiming", "repeating")
#: Most learned words that the lexicons take, those with the highest z-scores.
LEXICON_WORDS = 1 << 20
#: Rows of each posterior class that the classifier is trained on: those with the smallest hashes of their ids.
TRAINING_ROWS = 4000
#: Hashed word features of the classifier; a feature for each voter follows.
SLOTS = 1 << 16
_SPAN = np.uint64(48)
CORRELATED = 0.15


@dataclass
class Voters:
    """Lexicons; the last ones, of learned words, have log odds, and steps of odds per word above which they fire."""

    lexicons: list[np.ndarray] = field(default_factory=list)
    odds: list[np.ndarray] = field(default_factory=list)
    cuts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def number(self) -> int:
        return len(self.lexicons) + len(PATTERNS)

    def votes(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(votes of each text as a row of 0 and 1, its steps of odds per word by learned lexicon and in all, owner and hash of each word)."""
        own = words(part, ALPHANUMERIC)
        hashes = own.hashes()
        n = len(part)
        out = np.zeros((n, self.number), np.uint8)
        fixed = len(self.lexicons) - len(self.odds)
        rates = np.zeros((n, len(self.odds) + 1))
        more = 1 / (np.bincount(own.doc, minlength=n) + MORE_WORDS)
        for k, lexicon in enumerate(self.lexicons):
            if len(lexicon):
                at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
                hit = np.flatnonzero(lexicon[at] == hashes)
                if k < fixed:
                    out[own.doc[hit], k] = 1
                else:
                    rates[:, k - fixed] = np.bincount(own.doc[hit], self.odds[k - fixed][at[hit]], minlength=n) * more
        rates[:, -1] = rates.sum(1)
        steps = np.minimum(rates / RATE_STEP, MOST_STEPS).astype(np.int64)
        out[:, fixed : len(self.lexicons)] = steps[:, :-1] > self.cuts
        size = np.maximum(1, np.diff(part.ends))
        border = part.ends

        def per_text(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[border[1:]] - sums[border[:-1]]

        upper = per_text((part.data >= ord("A")) & (part.data <= ord("Z")))
        marks = per_text((part.data == ord("!")) | (part.data == ord("?")))
        counts = np.bincount(own.doc, minlength=n)
        repeated = np.zeros(n, np.int64)
        if len(hashes) > 1:
            again = (hashes[1:] == hashes[:-1]) & (own.doc[1:] == own.doc[:-1])
            repeated = np.bincount(own.doc[1:][again], minlength=n)
        out[:, -3] = upper > 0.3 * size
        out[:, -2] = marks > 0.01 * size
        out[:, -1] = repeated > 0.02 * np.maximum(counts, 50)
        return out, steps, own.doc, hashes


def hashed(text: str) -> np.ndarray:
    """Sorted hashes of the words of a text."""
    whole = [w for part in slices(pa.array([text])) for w in words(part, ALPHANUMERIC).hashes()]
    return np.unique(np.array(whole, np.uint64))


def association(values: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, z-score of its log odds ratio) of the distinct values of some texts."""
    if not len(values) or not toxic.any() or toxic.all():
        return np.empty(0, np.uint64), np.empty(0)
    names, at = np.unique(np.concatenate(values), return_inverse=True)
    label = np.repeat(toxic, [len(v) for v in values])
    bad = np.bincount(at[label], minlength=len(names)) + 0.5
    good = np.bincount(at[~label], minlength=len(names)) + 0.5
    n_bad, n_good = toxic.sum() + 1, (~toxic).sum() + 1
    odds = np.log(bad / (n_bad - bad)) - np.log(good / (n_good - good))
    return names, odds / np.sqrt(1 / bad + 1 / (n_bad - bad) + 1 / good + 1 / (n_good - good))


def _cuts(clean: DataFrame, parts: list[str]) -> np.ndarray:
    """For each part the steps that all but a share of the clean texts stay within; there are at most as many counts as steps."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(p).alias("steps")) for k, p in enumerate(parts)]))
    counted = clean.select(pairs.alias("s")).groupBy("s.part", "s.steps").count().collect()
    cuts = np.full(len(parts), MOST_STEPS)
    for k in range(len(parts)):
        steps, counts = np.array(sorted((r[1], r[2]) for r in counted if r[0] == k) or [(MOST_STEPS, 1)]).T
        cuts[k] = steps[np.searchsorted(np.cumsum(counts), LEFT_ALONE * counts.sum())]
    return cuts


@dataclass
class LabelModel:
    """Two classes; voters in groups, each with a table of its joint votes in each class."""

    prior: float
    groups: list[list[int]]
    tables: list[np.ndarray]
    accuracies: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for group, joint in zip(self.groups, self.tables, strict=True):
            code = votes[:, group].astype(np.int64) @ (1 << np.arange(len(group)))
            odds += np.log(joint[1, code]) - np.log(joint[0, code])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @staticmethod
    def fit(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, first: np.ndarray) -> LabelModel:
        """votes: distinct patterns; known: 1, 0, or -1 for each; first: starting posterior."""
        groups = [[k] for k in range(votes.shape[1])]
        post = np.where(known >= 0, known, first)
        model = _expect(votes, counts, known, post, groups)
        post = np.where(known >= 0, known, model.posterior(votes))
        groups = _joined(votes.shape[1], model.correlations)
        return _expect(votes, counts, known, post, groups)


def _expect(votes, counts, known, post, groups) -> LabelModel:
    for _ in range(60):
        mass = np.stack([counts * (1 - post), counts * post])
        prior = float((mass[1].sum() + 1) / (counts.sum() + 10))
        tables = []
        for group in groups:
            code = votes[:, group].astype(np.int64) @ (1 << np.arange(len(group)))
            joint = np.stack([np.bincount(code, m, minlength=1 << len(group)) for m in mass]) + 0.5
            tables.append(joint / joint.sum(1, keepdims=True))
        model = LabelModel(prior, groups, tables, np.empty(0), np.empty(0))
        new = np.where(known >= 0, known, model.posterior(votes))
        done = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if done:
            break
    mass = np.stack([counts * (1 - post), counts * post])
    rates = np.stack([(m @ votes + 0.5) / (m.sum() + 1) for m in mass])
    model.accuracies = model.prior * rates[1] + (1 - model.prior) * (1 - rates[0])
    covariance = np.zeros((votes.shape[1],) * 2)
    for m, rate in zip(mass, rates, strict=True):
        off = votes - rate
        covariance += (off * m[:, None]).T @ off / max(1.0, counts.sum())
    spread = np.sqrt(np.maximum(1e-9, np.diag(covariance)))
    model.correlations = covariance / np.outer(spread, spread)
    return model


def _joined(number: int, correlations: np.ndarray, most: int = 4) -> list[list[int]]:
    """Voters whose votes are correlated within the classes share a table, strongest pairs first."""
    group = {k: [k] for k in range(number)}
    pairs = [(abs(correlations[i, j]), i, j) for i in range(number) for j in range(i)]
    for strength, i, j in sorted(pairs, reverse=True):
        a, b = group[i], group[j]
        if strength >= CORRELATED and a is not b and len(a) + len(b) <= most:
            a += b
            for k in b:
                group[k] = a
    return [list(g) for g in {id(g): g for g in group.values()}.values()]


def _texts_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts of a bounded set of ids, one for each id."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.dropDuplicates(["doc_id"])


def learned_words(docs: DataFrame, known: DataFrame, doc_id: str, text: str, most: int = LEXICON_WORDS) -> np.ndarray:
    """Sorted hashes of the words that go with toxic texts, counted over all texts with a label; see ``learned_odds``."""
    return learned_odds(docs, known, doc_id, text, most)[0]


def learned_odds(
    docs: DataFrame, known: DataFrame, doc_id: str, text: str, most: int = LEXICON_WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that go with toxic texts, and the logarithms of their odds ratios, over all texts with a label.

    ``known`` has (doc_id, value), unique by id. A row that repeats an id is no further text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    numbers = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    present = cut(known.join(numbers, "doc_id"))
    sizes = {r[0]: r[1] for r in present.groupBy(F.col("value") > 0).count().collect()}
    if len(sizes) < 2:
        return np.empty(0, np.uint64), np.empty(0)
    alone = present.filter("rows = 1").drop("rows")  # has no hot key, so the texts need not be stored
    side = F.broadcast(alone) if fits_broadcast(alone) else alone
    labelled = rows.join(side, "doc_id").select("value", "text")
    repeated = present.filter("rows > 1").drop("rows")
    if not repeated.isEmpty():
        again = lookup_join(rows, repeated, ["doc_id"], "inner").groupBy("doc_id")
        again = again.agg(F.max("value").alias("value"), F.min("text").alias("text"))
        labelled = labelled.unionByName(again.select("value", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) > 0
            for part in slices(batch.column(1)):
                own = words(part, ALPHANUMERIC)
                names, at = np.unique(own.hashes(), return_inverse=True)
                each = np.unique(own.doc * np.int64(len(names)) + at)  # a word counts once in a text
                if not len(each):
                    continue
                label = toxic[part.first + each // len(names)]
                sums = [np.bincount(each[side] % len(names), minlength=len(names)) for side in (label, ~label)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names.view(np.int64), *sums)], ["word", "bad", "good"])

    sums = (
        labelled.mapInArrow(count, "word bigint, bad bigint, good bigint")
        .groupBy("word")
        .agg((F.sum("bad") + 0.5).alias("bad"), (F.sum("good") + 0.5).alias("good"))
    )
    bad, good, n_bad, n_good = F.col("bad"), F.col("good"), F.lit(sizes[True] + 1.0), F.lit(sizes[False] + 1.0)
    odds = F.log(bad / (n_bad - bad)) - F.log(good / (n_good - good))
    z = odds / F.sqrt(1 / bad + 1 / (n_bad - bad) + 1 / good + 1 / (n_good - good))
    best = sums.select("word", odds.alias("odds"), z.alias("z")).filter(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "word").limit(most)
    found = best.select("word", "odds").toArrow()
    hashes = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["odds"].to_numpy()[order]


def _smallest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` ids of each value of ``by``, those with the smallest hashes."""
    for keys in ([by, "_lane"], [by]):  # in lanes first, so that no task gets a whole class
        window = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = rows.withColumn("_lane", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        rows = rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= most)
    return rows.drop("_rank", "_lane")


def _collected(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, voters: Voters) -> list:
    """(value, votes, distinct word hashes, steps of odds) of a bounded set of texts; ``ids`` has (doc_id, value)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                votes, steps, owner, hashes = voters.votes(part)
                border = np.searchsorted(owner, np.arange(len(part) + 1))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array([v.tobytes() for v in votes], pa.binary()),
                        pa.array(sets, pa.binary()),
                        pa.array(steps[:, -1]),
                    ],
                    ["value", "votes", "words", "steps"],
                )

    frame = _texts_of(docs, ids, doc_id, text).select("value", "text")
    rows = frame.mapInArrow(take, "value double, votes binary, words binary, steps bigint").collect()
    return sorted((r[0], bytes(r[1]), bytes(r[2]), r[3]) for r in rows)


def rate_feature(steps: np.ndarray) -> np.ndarray:
    return np.minimum(steps * (RATE_STEP * RATE_SCALE), HIGHEST_RATE)


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, part: Slice) -> np.ndarray:
        votes, steps, owner, hashes = self.voters.votes(part)
        slots = np.unique(owner.astype(np.int64) * SLOTS + (hashes >> _SPAN).astype(np.int64))
        total = np.bincount(slots // SLOTS, self.weights[slots % SLOTS], minlength=len(part))
        total = total + votes @ self.weights[SLOTS:-1] + rate_feature(steps[:, -1]) * self.weights[-1] + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """``labels`` has (doc_id, toxic) for training rows only. Texts of ``docs`` without label count for the votes."""
    known = cut(
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("value"))
    )
    fixed = [hashed(entry) for entry in LEXICONS.values()]
    found, odds = learned_odds(docs, known, doc_id, text)
    dealt = [found % np.uint64(LEARNED) == np.uint64(k) for k in range(LEARNED)]
    voters = Voters([*fixed, *(found[d] for d in dealt)], [odds[d] for d in dealt], np.full(LEARNED, MOST_STEPS))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(voters)
    parts = [f"part{k}" for k in range(LEARNED)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.votes(part)[:2] for part in slices(batch.column(1))]
            codes = [votes.astype(np.int64) @ (1 << np.arange(sent.value.number)) for votes, _ in found]
            steps = np.concatenate([np.empty((0, LEARNED + 1), np.int64), *(s for _, s in found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *codes])), *map(pa.array, steps.T[:-1])],
                ["doc_id", "votes", *parts],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    measured = cut(rows.mapInArrow(measure, "doc_id bigint, votes bigint, " + ", ".join(f"{p} bigint" for p in parts)))
    measured = lookup_join(measured, known, ["doc_id"])
    voters.cuts = _cuts(measured.filter("value <= 0"), parts)
    bits = [F.when(F.col(p) > int(c), 1 << len(fixed) + k).otherwise(0) for k, (p, c) in enumerate(zip(parts, voters.cuts, strict=True))]
    cast = measured.select("doc_id", "value", sum(bits, F.col("votes")).alias("votes"))
    counted = (
        cast.groupBy("votes", F.coalesce("value", F.lit(-1.0)).alias("value"))
        .count()
        .orderBy("votes", "value")
        .collect()
    )
    codes = np.array([r[0] for r in counted], np.int64)
    patterns = (codes[:, None] >> np.arange(voters.number)) & 1
    lexical = patterns[:, : -len(PATTERNS)].sum(1)
    model = LabelModel.fit(
        patterns,
        np.array([r[2] for r in counted], float),
        np.array([r[1] for r in counted]),
        np.where(lexical > 0, 0.9, 0.05),
    )
    distinct = np.unique(codes)
    post = model.posterior((distinct[:, None] >> np.arange(voters.number)) & 1)
    # The posterior follows from the pattern, of which there are at most 2^voters.
    posterior = spark.createDataFrame(
        [(int(c), float(p)) for c, p in zip(distinct, post, strict=True)],
        "votes bigint, posterior double",
    )
    judged = cast.join(F.broadcast(posterior), "votes").filter("doc_id IS NOT NULL")
    judged = judged.select("doc_id", F.coalesce((F.col("value") > 0).cast("double"), "posterior").alias("value"))
    judged = judged.withColumn("high", F.col("value") >= 0.5)
    shares = dict(judged.groupBy("high").count().collect())
    ids = _smallest(judged.dropDuplicates(["doc_id"]), "high", TRAINING_ROWS).select("doc_id", "value")
    chosen = _collected(docs, ids, doc_id, text, voters)
    target = np.array([r[0] for r in chosen])
    high = target >= 0.5
    slots = [np.unique((np.frombuffer(r[2], np.uint64) >> _SPAN).astype(np.int64)) for r in chosen]
    names, z = association(slots, high)
    # Words that do not go with the labels would add noise with the length of a text.
    telling = np.zeros(SLOTS, bool)
    telling[names[np.abs(z) > SLOT_Z].astype(np.int64)] = True
    size = SLOTS + voters.number + 1
    columns = [
        np.concatenate([s[telling[s]], SLOTS + np.flatnonzero(np.frombuffer(r[1], np.uint8)), [size - 1]])
        for s, r in zip(slots, chosen, strict=True)
    ]
    rates = rate_feature(np.array([r[3] for r in chosen]))
    values = [np.append(np.ones(len(c) - 1), rate) for c, rate in zip(columns, rates, strict=True)]
    weight = np.where(high, shares.get(True, 0) / max(1, high.sum()), shares.get(False, 0) / max(1, (~high).sum()))
    if not len(chosen):
        return ToxicityModel(voters, model, np.zeros(size), -3.0)
    weights, bias = fit_logistic(SparseRows(columns, values), target, size, weight=weight)
    return ToxicityModel(voters, model, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every text; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.drop(out)
    names, at = [*frame.columns, out], frame.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(part) for part in slices(batch.column(at))]
            column = pa.array(np.concatenate([np.empty(0), *scores]))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names)

    return frame.mapInArrow(judge, frame.withColumn(out, F.lit(0.0)).schema)
