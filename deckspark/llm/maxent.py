"""Language-model scores of whole texts by a hashed maximum-entropy model.

A token is predicted from its class and then within its class, both by a softmax over sums of hashed weight
rows: one for the word before (n-gram), one for the two words before together, and one for the word before
that alone (skip). Every word counts as itself there, by its hash; only in the feature of two words together an uncommon one
counts by its class. The commonest words of the training texts are
in classes of equal size by frequency; all others are one class more, which a tree of equal branches, picked by the hash of
the word, cuts into leaves: each node of the tree is a softmax of its own, and within a leaf a word has its smoothed
relative frequency. The probabilities of all words that training saw, and of one unseen word in each leaf, add up to one.

Texts are cut once into a table of batches: token codes of some hundred texts and the distinct words of them.
Counts are exact and by word; they come back to the batches by a join on words. Training goes over all
training tokens: in each round every task makes gradient steps from the common model on its share, and the changes
are averaged row by row, weighed by how often a row was used. Sums go up a tree of bounded groups. The
leaves grow with the counted vocabulary, at a cost per token of its logarithm, the rows with its fourth root, so a vocabulary of
10^8 words makes a model of some 20 MB.

Defined cases: a null text is an empty one, which has one token, its end; without training texts all
leaves, and the unseen words in them, are equally likely; repeated rows count and score each for itself; an empty table gives no
rows. Long texts are a batch of their own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckspark.llm.common import cut
from deckspark.llm.words import SPACED, slices, words
from deckspark.session import shared_dir

#: Classes of the common words, and words in each.
CLASSES, CLASS_WORDS = 32, 32
#: Bits of the number of rows of hashed weights, for classes and for words within them, of a vocabulary of 2^16 words or
#: fewer; one more for each further factor of 16.
CLASS_BITS, WORD_BITS, BASE_BITS = 12, 14, 16
#: The tree of uncommon words has one level for vocabularies below 2^24 words, one more for each further factor of 2^10.
FIRST_BITS, LEVEL_BITS = 24, 10
FEATURES = 3
#: Context of a word that is not there; hashes of words are below. The end of a text counts as a word of its own.
NONE, END = np.uint64(1 << 32), b"\n"
#: Rounds of training; each takes its share of the training batches, all together take all.
ROUNDS = 2
#: Text of one batch. Larger batches have fewer distinct words in all, which is what travels to be counted.
BATCH_BYTES = 8 << 20
STEP_TOKENS, RATE = 4096, 0.2
#: Highest score of a softmax, so that its exponentials stay finite; biases are logarithms of probabilities.
HIGHEST = 60.0
#: Tokens of one row of weights that are added one after the other for all rows at once.
TURNS = 6
#: Parts of a model that are added up apart, and rows that one task adds up.
SEGMENTS, FAN_IN = 16, 16


@dataclass
class Model:
    """Weights of the class softmax and of the softmax in each node: the classes of common words, then the tree.

    ``class_bias`` has the classes of common words and, last, all others; ``node_bias`` a row per node.
    """

    common: list[str]
    end_rank: int
    class_bias: np.ndarray
    node_bias: np.ndarray
    class_weights: np.ndarray
    node_weights: np.ndarray
    leaf_mass: np.ndarray
    total: int
    distinct: int
    end_count: int

    @property
    def tail(self) -> int:
        return len(self.common)

    def ids(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (uncommon words: ``tail``) and hashes of a batch's words, and of the end behind them."""
        known = pc.index_in(vocabulary, pa.array(self.common, pa.string())).fill_null(self.tail)
        rank = np.append(known.to_numpy(zero_copy_only=False), self.end_rank if self.end_rank >= 0 else self.tail)
        texts = vocabulary.cast(pa.binary()).to_pylist()
        return rank.astype(np.int64), np.array([*map(zlib.crc32, texts), zlib.crc32(END)], np.uint64)

    def leaves(self, word: np.ndarray) -> np.ndarray:
        return (word % np.uint64(len(self.leaf_mass))).astype(np.int64)

    def contexts(self, rank: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token the word before it and the one before that, and both once more with leaves for uncommon words."""
        kind = np.where(rank < self.tail, word, NONE + np.uint64(1) + self.leaves(word).astype(np.uint64))
        return np.stack([*before(word, first), *before(kind, first)])

    def choices(self, rank: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, node, branch) by level: common words choose once, in their class, others on each level of the tree."""
        common = rank < self.tail
        heads = len(self.class_bias) - 1
        leaf, width = self.leaves(word), len(self.leaf_mass) // CLASS_WORDS
        node = np.where(common, rank // CLASS_WORDS, heads)
        yield np.arange(len(rank)), node, np.where(common, rank % CLASS_WORDS, leaf // width)
        rare, level, nodes = np.flatnonzero(~common), 1, 1
        while width > 1:
            above = leaf[rare] // width
            width //= CLASS_WORDS
            yield rare, heads + nodes + above, leaf[rare] // width % CLASS_WORDS
            level *= CLASS_WORDS
            nodes += level

    def predictions(self, rank: np.ndarray, word: np.ndarray, context: np.ndarray):
        """(which weights, tokens, choice made, rows, probabilities) for classes, then for each level of nodes."""
        hashes = features(context)
        rows = _rows(hashes, 0xD6E8FEB86659FD93, len(self.class_weights))
        group = np.where(rank < self.tail, rank // CLASS_WORDS, len(self.class_bias) - 1)
        yield "class", np.arange(len(rank)), group, rows, _softmax(self.class_bias, self.class_weights, rows)
        for tokens, node, branch in self.choices(rank, word):
            if len(tokens):
                rows = _rows(hashes[:, tokens] + node.astype(np.uint64), 0xA0761D6478BD642F, len(self.node_weights))
                yield "node", tokens, branch, rows, _softmax(self.node_bias.take(node, 0), self.node_weights, rows)

    def log_probabilities(self, rank: np.ndarray, word: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural logarithms of the tokens' probabilities; counts matter for uncommon words."""
        rare = np.flatnonzero(rank >= self.tail)
        out = np.zeros(len(rank))
        out[rare] = np.log((count[rare] + 0.5) / self.leaf_mass[self.leaves(word[rare])])
        context = self.contexts(rank, word, first)
        for a in range(0, len(rank), STEP_TOKENS):
            part = slice(a, a + STEP_TOKENS)
            for _, tokens, choice, _, chances in self.predictions(rank[part], word[part], context[:, part]):
                chance = chances[np.arange(len(tokens)), choice].astype(float)
                out[a + tokens] += np.log(np.maximum(chance, 1e-38))
        return out

    def train(self, rank: np.ndarray, word: np.ndarray, first: np.ndarray, state: dict) -> None:
        """One pass of steps over the tokens of a batch. Rates fall with a row's own squared gradients."""
        context = self.contexts(rank, word, first)
        for a in range(0, len(rank), STEP_TOKENS):
            part = slice(a, a + STEP_TOKENS)
            for name, tokens, choice, rows, error in self.predictions(rank[part], word[part], context[:, part]):
                error[np.arange(len(tokens)), choice] -= 1
                weights = self.class_weights if name == "class" else self.node_weights
                _step(weights, state[name], state[f"{name}_used"], rows, error)


def before(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before each token and of the one before that; ``first`` marks the first token of a text."""
    one, two = np.full(len(word), NONE), np.full(len(word), NONE)
    one[1:] = word[:-1]
    one[first] = NONE
    two[2:] = word[:-2]
    two[first] = NONE
    two[1:][first[:-1]] = NONE
    return one, two


def features(context: np.ndarray) -> np.ndarray:
    """Hashes of a token's features: the word before, the two before together, the second one alone."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    three = np.uint64(3)
    one, two, near, far = context
    codes = [one * three + np.uint64(1), (near * np.uint64(0xC2B2AE3D27D4EB4F) + far) * three + np.uint64(2), two * three]
    out = np.stack([c * mix for c in codes])
    return out ^ (out >> np.uint64(29))


def _rows(hashes: np.ndarray, factor: int, rows: int) -> np.ndarray:
    """Rows of weights by the high bits; ``rows`` is a power of two."""
    return ((hashes * np.uint64(factor)) >> np.uint64(65 - rows.bit_length())).astype(np.int64)


def _softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = weights.take(rows[0], 0)
    for r in rows[1:]:
        scores += weights.take(r, 0)
    scores += bias
    np.minimum(scores, HIGHEST, out=scores)
    np.exp(scores, out=scores)
    scores /= np.einsum("ij->i", scores)[:, None]
    return scores


def _step(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One gradient step on the rows of all features together; a row that stands in several features gets their sum."""
    flat = rows.ravel()
    # Small numbers are sorted by their digits.
    order = np.argsort(flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(starts, len(flat)))
    gradient = _sums(error, order % len(error), starts, sizes)
    hit = ordered[starts]
    squares[hit] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
    used[hit] += sizes
    gradient *= (RATE / np.sqrt(squares[hit] + 1e-6))[:, None]
    weights[hit] -= gradient


def _sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order`` of each run. Most runs are short: they go turn by turn, what is left of the long ones run by run."""
    total = values.take(order[starts], 0)
    for turn in range(1, TURNS):
        more = np.flatnonzero(sizes > turn)
        if not len(more):
            return total
        total[more] += values.take(order[starts[more] + turn], 0)
    long = np.flatnonzero(sizes > TURNS)
    if len(long):
        left = sizes[long] - TURNS
        ends = np.cumsum(left)
        places = np.arange(ends[-1]) + np.repeat(starts[long] + TURNS - (ends - left), left)
        total[long] += np.add.reduceat(values.take(order[places], 0), ends - left)
    return total


def batch_table(docs: DataFrame, doc_id: str, text: str, training: str) -> DataFrame:
    """Batches of tokenised texts, written in the shared folder; see ``BATCH`` for the columns."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(training), F.lit(False)).alias("training"),
        F.col(text).alias("text"),
    )

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch.column(2), BATCH_BYTES):
                own = words(part, SPACED)
                coded = own.arrow().dictionary_encode()
                codes = coded.indices.to_numpy().astype(np.int64)
                end = len(coded.dictionary)
                counts = np.bincount(own.doc, minlength=len(part))
                tokens = np.full(len(codes) + len(part), end, np.int64)
                tokens[np.arange(len(codes)) + own.doc] = codes
                flags = batch.column(1).slice(part.first, len(part)).to_numpy(zero_copy_only=False)
                seen = np.bincount(codes[flags[own.doc]], minlength=end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([batch.column(0).slice(part.first, len(part)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([flags.tolist()], pa.list_(pa.bool_())),
                        pa.array([(counts + 1).tolist()], pa.list_(pa.int32())),
                        pa.array([tokens.astype("<u2").tobytes()], pa.binary()),
                        pa.array([(tokens >> 16).astype("<u2").tobytes() if end >> 16 else b""], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, end], pa.int32()), coded.dictionary),
                        pa.ListArray.from_arrays(pa.array([0, end], pa.int32()), pa.array(seen, pa.int64())),
                    ],
                    BATCH_NAMES,
                )
                number += 1

    return stored(rows.mapInArrow(tokenise, BATCH), "tokens")


BATCH = (
    "batch bigint, doc_ids array<bigint>, training array<boolean>, lengths array<int>, low binary, high binary, "
    "words array<string>, seen array<bigint>"
)
BATCH_NAMES = [c.strip().split(" ")[0] for c in BATCH.split(",")]


def stored(df: DataFrame, kind: str) -> DataFrame:
    """A frame written to the shared folder as a packed table, which takes much less disk than a checkpoint, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def unpacked(low: pa.Scalar, high: pa.Scalar) -> np.ndarray:
    """Token codes from their low and high 16 bits, of which the latter are mostly zero and pack well."""
    codes = np.frombuffer(low.as_py(), "<u2").astype(np.int64)
    upper = np.frombuffer(high.as_py(), "<u2")
    return codes + (upper.astype(np.int64) << 16) if len(upper) else codes


def word_counts(batches: DataFrame) -> DataFrame:
    """(word, c): how often each word stands in training texts; only words that do."""
    each = batches.select(F.explode(F.arrays_zip("words", "seen")).alias("w")).select("w.words", "w.seen")
    counted = each.filter("seen > 0").groupBy(F.col("words").alias("word")).agg(F.sum("seen").alias("c"))
    return stored(counted, "counts")


def start_model(counts: DataFrame, training_docs: int) -> Model:
    """A model of the word frequencies alone; the common words are of bounded number, the classes of the others few."""
    size = CLASSES * CLASS_WORDS
    sums = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = [(r[0], r[1]) for r in counts.orderBy(F.desc("c"), "word").limit(size).collect()]
    end = [(None, training_docs)] if training_docs else []
    ranked = sorted(end + top, key=lambda r: (-r[1], r[0] is not None, r[0] or ""))[:size]
    common = np.array([r[1] for r in ranked], float)
    n_classes = -(-len(ranked) // CLASS_WORDS)
    padded = np.zeros(n_classes * CLASS_WORDS)
    padded[: len(common)] = common
    by_class = padded.reshape(n_classes, CLASS_WORDS)
    total, distinct = sums[1] + training_docs, sums[0] + bool(training_docs)

    # The leaves of the other words: all words by leaf, without the common ones. Each leaf has one unseen word.
    levels = 1 + max(0, distinct.bit_length() - 1 - FIRST_BITS + LEVEL_BITS) // LEVEL_BITS
    leaves = CLASS_WORDS**levels
    leaf_mass = np.full(leaves, 0.5)
    dealt = counts.groupBy((F.crc32(F.col("word").cast("binary")) % leaves).alias("k")).agg(F.sum("c"), F.count("*"))
    for k, words_of, distinct_of in dealt.collect():
        leaf_mass[k] += words_of + 0.5 * distinct_of
    for word, c in end:
        leaf_mass[zlib.crc32(END) % leaves] += c + 0.5
    for word, c in ranked:
        leaf_mass[zlib.crc32(END if word is None else word.encode()) % leaves] -= c + 0.5

    mass = np.append(by_class.sum(1), leaf_mass.sum())
    nodes = [by_class, *(leaf_mass.reshape(CLASS_WORDS ** (k + 1), -1).sum(1).reshape(-1, CLASS_WORDS) for k in range(levels))]
    by_node = np.concatenate(nodes)
    with np.errstate(divide="ignore"):
        node_bias = np.log(by_node) - np.log(np.maximum(1e-30, by_node.sum(1, keepdims=True)))
    more = max(0, distinct.bit_length() - 1 - BASE_BITS) // 4
    return Model(
        ["\n" if r[0] is None else r[0] for r in ranked],
        next((k for k, r in enumerate(ranked) if r[0] is None), -1),
        np.log(mass / mass.sum()).astype(np.float32),
        np.maximum(node_bias, -1e9).astype(np.float32),
        np.zeros((1 << CLASS_BITS + more, n_classes + 1), np.float32),
        np.zeros((1 << WORD_BITS + more, CLASS_WORDS), np.float32),
        leaf_mass,
        int(total),
        int(distinct),
        int(training_docs),
    )


def train_round(batches: DataFrame, model: Model, share: int, shares: int) -> Model:
    """Gradient steps in every task on its batches of this share, and the averaged change."""
    spark = batches.sparkSession
    sent = spark.sparkContext.broadcast(model)
    mine = batches.filter(F.pmod(F.xxhash64("batch"), F.lit(shares)) == share).select("training", "lengths", "low", "high", "words")

    def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        start = (own.class_weights.copy(), own.node_weights.copy())
        # An own copy: the broadcast value is shared by the tasks of a worker.
        local = Model(**{**own.__dict__, "class_weights": start[0].copy(), "node_weights": start[1].copy()})
        state = {
            "class": np.zeros(len(start[0]), np.float32),
            "class_used": np.zeros(len(start[0])),
            "node": np.zeros(len(start[1]), np.float32),
            "node_used": np.zeros(len(start[1])),
        }
        for frame in frames:
            for k in range(frame.num_rows):
                flags = frame.column(0)[k].values.to_numpy(zero_copy_only=False)
                lengths = frame.column(1)[k].values.to_numpy()
                keep = np.repeat(flags, lengths)
                if not keep.any():
                    continue
                first = np.zeros(len(keep), bool)
                first[np.cumsum(lengths) - lengths] = True
                codes = unpacked(frame.column(2)[k], frame.column(3)[k])[keep]
                rank, word = local.ids(frame.column(4)[k].values)
                local.train(rank[codes], word[codes], first[keep], state)
        changes = []
        for name, before, after in (
            ("class", start[0], local.class_weights),
            ("node", start[1], local.node_weights),
        ):
            used = state[f"{name}_used"]
            changes.append(np.concatenate([(after - before) * used[:, None], used[:, None]], axis=1).ravel())
        flat = np.array_split(np.concatenate(changes).astype(np.float32), SEGMENTS)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SEGMENTS), pa.int32()), pa.array([task] * SEGMENTS, pa.int32()), pa.array([f.tobytes() for f in flat])],
            ["segment", "task", "change"],
        )

    tasks = mine.rdd.getNumPartitions()
    sums = mine.mapInArrow(learn, "segment int, task int, change binary")

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.float32).astype(float) for c in group["change"])
        return pd.DataFrame(
            {"segment": [group["segment"].iloc[0]], "task": [group["task"].iloc[0]], "change": [total.astype(np.float32).tobytes()]}
        )

    # A task's change is as large as the model, so only sums are stored; what the tasks made goes to them by the exchange alone.
    while True:
        tasks = -(-tasks // FAN_IN)
        grouped = sums.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        sums = cut(grouped.groupBy("segment", "task").applyInPandas(add, "segment int, task int, change binary"))
        if tasks <= 1:
            break
    flat = np.concatenate([np.frombuffer(r[2], np.float32) for r in sums.orderBy("segment").collect()] or [np.empty(0)])
    if not len(flat):
        return model
    width = model.class_weights.shape[1] + 1
    border = len(model.class_weights) * width
    parts = (flat[:border].reshape(-1, width), flat[border:].reshape(-1, CLASS_WORDS + 1))
    moved = [(p[:, :-1] / np.maximum(1, p[:, -1:])).astype(np.float32) for p in parts]
    return Model(
        **{**model.__dict__, "class_weights": model.class_weights + moved[0], "node_weights": model.node_weights + moved[1]}
    )


def score_texts(docs: DataFrame, training: str, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every text; ``training`` is a boolean column."""
    batches = batch_table(docs, doc_id, text, training)
    counts = word_counts(batches)
    return score_batches(batches, counts, fit(batches, counts, rounds))


def fit(batches: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of the training texts in ``batches``; all of them are trained on."""
    training_docs = batches.agg(
        F.coalesce(F.sum(F.size(F.filter("training", lambda t: t))), F.lit(0))
    ).first()[0]
    model = start_model(counts, training_docs)
    for k in range(rounds):
        model = train_round(batches, model, k, rounds)
    return model


def score_batches(batches: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    # Each batch gets the counts of its own words, as many rows as it has distinct words, and the ranks of the common ones.
    spark = batches.sparkSession
    asked = batches.select("batch", F.posexplode("words").alias("place", "word"))
    ranks = [(w, k) for k, w in enumerate(model.common) if k != model.end_rank]
    ranked = counts.join(F.broadcast(spark.createDataFrame(ranks, "word string, rank int")), "word", "left")
    known = (
        asked.join(ranked, "word")
        .groupBy("batch")
        .agg(
            F.collect_list("place").alias("places"),
            F.collect_list("c").alias("counts"),
            F.collect_list(F.when(F.col("rank").isNotNull(), F.col("place"))).alias("common"),
            F.collect_list("rank").alias("ranks"),
        )
    )
    # The words stay behind; their checksums, less 2^31 to be ints, go with the tokens.
    hashes = F.transform("words", lambda w: (F.crc32(w.cast("binary")) - F.lit(1 << 31)).cast("int")).alias("hashes")
    ready = batches.select("batch", "doc_ids", "lengths", "low", "high", hashes).join(known, "batch", "left").drop("batch")
    sent = spark.sparkContext.broadcast(model)

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for frame in frames:
            for k in range(frame.num_rows):
                ids, lengths = frame.column(0)[k].values, frame.column(1)[k].values.to_numpy()
                codes = unpacked(frame.column(2)[k], frame.column(3)[k])
                word = np.append(frame.column(4)[k].values.to_numpy().astype(np.int64) + (1 << 31), zlib.crc32(END)).astype(np.uint64)
                count, rank = np.zeros(len(word)), np.full(len(word), own.tail)
                if frame.column(5)[k].is_valid:
                    places, counted, common, ranks = (frame.column(c)[k].values.to_numpy() for c in range(5, 9))
                    count[places], rank[common] = counted, ranks
                count[-1], rank[-1] = own.end_count, own.end_rank if own.end_rank >= 0 else own.tail
                token_count = count[codes]
                starts = np.cumsum(lengths) - lengths
                first = np.zeros(len(codes), bool)
                first[starts] = True
                natural = own.log_probabilities(rank[codes], word[codes], token_count, first)
                base = np.log10((token_count + 0.5) / (own.total + 0.5 * (own.distinct + 1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(lengths.astype(np.int64)),
                        pa.array(np.add.reduceat((token_count > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(lengths), own.total, np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(natural, starts) / np.log(10)),
                    ],
                    names,
                )

    return ready.mapInArrow(
        score, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
