"""Small cases of the training-data operators, against brute force or their SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from deckspark.llm import decontamination, languages, lines, maxent, mixing, near_duplicates, passages, pseudonyms, sharding, topk, toxicity
from deckspark.llm.oracle import ORACLE_SQL
from deckspark.llm.words import SPACED, slices, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _key int"


def some_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    body = " ".join(f"word{k}" for k in range(40))
    rows = [
        (1, body, "en", "a"),
        (2, body + " more", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, "1234 5678 !!", "en", "b"),
        (None, "lone text of a null id", None, "a"),
        (7, body, "en", None),
        (7, body, "en", None),
        (8, "long " * 30_000, "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], DOCS)


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    got = entry_points.queries()[name](spark, SF).select(*names)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted.fetchall()))


def test_jump_hash_is_the_published_one(spark):
    def jump(key, n):
        b, j, key = -1, 0, key % 2**64
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = [0, 1, -1, 2**62, -(2**63), *range(100, 160)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 7, 100):
        got = {r[0]: r[1] for r in df.select("k", sharding.jump_shard(F.col("k"), n)).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_words_do_not_span_texts():
    texts = pa.array(["ab", "cd e", None, "", "É A\tb"])
    (part,) = slices(texts)
    own = words(part, SPACED)
    assert own.arrow().to_pylist() == ["ab", "cd", "e", "É", "a", "b"]
    assert own.doc.tolist() == [0, 1, 1, 4, 4, 4]
    assert len(set(own.hashes().tolist())) == 6


def test_mix_meets_targets_and_schedule_is_whole(spark):
    rows = mixing.measured(some_docs(spark))
    targets = mixing.source_targets(rows)
    taken = mixing.mix(rows, targets, block=16).join(rows, "id").groupBy("source").agg(F.sum("words").alias("w"))
    got = {r[0]: r[1] for r in taken.collect()}
    for t in targets.collect():
        assert got.get(t["source"], 0) == math.floor(t["target"])
    assert mixing.source_targets(rows.limit(0)).count() == 0


def test_pseudonyms_are_one_to_one_and_linked(spark):
    texts = ["card 4539 1488 0343 6467 and 4539148803436467", "on 2024-02-29, 02/29/2024", "not 4539148803436468", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [r for r in pseudonyms.pseudonymise(df).collect()]
    new = [r["text"] for r in out]
    first, second = re.findall(r"(?:\d[ ]?){16}", new[0])
    assert first.replace(" ", "") == second and second != "4539148803436467"
    year, month, day = re.search(r"(\d{4})-(\d\d)-(\d\d)", new[1]).groups()
    assert f"{month}/{day}/{year}" in new[1]
    assert new[2:] == [texts[2], None, ""] and [r["n_changed"] for r in out] == [2, 2, 0, 0, 0]
    digits = spark.range(1000).select(pseudonyms.permute_string(F.lpad(F.col("id").cast("string"), 3, "0"), 10, "k", "t"))
    assert len({r[0] for r in digits.collect()}) == 1000


def test_long_mails_and_time_stamps_are_replaced_whole(spark):
    same = "x" * 40
    locals_ = [*(f"{same}{k:03d}" for k in range(300)), *(f"{k:03d}{same}" for k in range(300)), "z" * 64, "ab"]
    df = spark.createDataFrame([(f"to {x}@mail.example now",) for x in locals_], "text string")
    new = [r["text"] for r in pseudonyms.pseudonymise(df).collect()]
    made = [re.fullmatch("to ([0-9a-z]+)@mail.example now", t).group(1) for t in new]
    assert [len(m) for m in made] == [len(x) for x in locals_] and len(set(made)) == len(made)
    # Each symbol counts for all blocks: texts that share their head, or their tail, share neither.
    for part in (made[:300], made[300:600]):
        assert len({m[:12] for m in part}) == len({m[-12:] for m in part}) == 300
    stamps = ["2024-02-29T10:00", "2024-02-29Tue", "2024-02-29 10:00", "02/29/2024T10"]
    rows = pseudonyms.pseudonymise(spark.createDataFrame([(t,) for t in stamps], "text string")).collect()
    assert [r["n_changed"] for r in rows] == [1, 0, 1, 0]
    assert rows[0]["text"][:10] == rows[2]["text"][:10] != stamps[0][:10] and rows[0]["text"].endswith("T10:00")
    head = spark.range(1).select(pseudonyms.permute_string(F.lit("z" * 30), 36, "k", "t")).first()[0]
    assert head[22:] != "z" * 8


def test_passages_are_found_wherever_lines_break(spark):
    rng = np.random.default_rng(7)
    fresh = iter(range(10**6))
    passage = [f"p{k}" for k in range(14)]
    rows = []
    for k in range(40):
        w = [f"w{next(fresh)}" for _ in range(rng.integers(0, 30))]
        for _ in range(rng.integers(0, 3)):
            cut_at = rng.integers(0, len(w) + 1)
            a, b = sorted(rng.integers(0, 15, 2))
            w[cut_at:cut_at] = passage[a:b]
        rows.append((k, "".join(x + str(rng.choice([" ", "\n", "\t \n"])) for x in w)))
    rows += [(7, rows[7][1]), (None, " ".join(passage)), (50, None), (51, ""), (52, "é " * 40 + "end")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(tuple, passages.drop_repeated_passages(docs, run_words=10).collect()), key=str)
    seen, wanted = set(), []
    done = {}
    for key, whole in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (key, whole) not in done:
            spans = [m.span() for m in re.finditer("[^ \t-\r]+", whole or "")]
            w, drop = [whole[a:b] for a, b in spans], set()
            for i in range(len(w) - 9):
                drop |= set(range(i, i + 10)) if tuple(w[i : i + 10]) in seen else set()
                seen.add(tuple(w[i : i + 10]))
            text = whole
            for i in sorted(drop, reverse=True):
                text = text[: spans[i][0]] + text[spans[i + 1][0] if i + 1 < len(w) else spans[i][1] :]
            done[key, whole] = (key, text, len(drop))
        wanted.append(done[key, whole])
    assert sum(r[2] > 0 for r in wanted) > 5
    assert got == sorted(wanted, key=str)


def test_index_finds_all_windows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(30)] + [None]
    items = [" ".join(rng.choice(list("abc"), n)) for n in (0, 2, 5, 9)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for blocks in (1000, 2):
        found = decontamination.find_contamination(docs, bench, width=4, block_phrases=blocks)
        for row in found.collect():
            w, hit, names = (row["text"] or "").split(), set(), set()
            for k, item in enumerate(items):
                v = (item or "").split()
                for i in range(max(1, len(v) - 3) if v else 0):
                    p = v[i : i + 4]
                    for j in range(len(w) - len(p) + 1):
                        if w[j : j + len(p)] == p:
                            hit.update(range(j, j + len(p)))
                            names.add(str(k))
            assert {k for a, b in row["found"]["spans"] for k in range(a, b)} == hit
            assert row["found"]["items"] == sorted(names) and row["found"]["n_words"] == len(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(8):
        base = [f"w{x}" for x in rng.integers(0, 500, 80)]
        for edits in (0, 1, 2, 4, 6):
            copy = list(base)
            for at in rng.integers(0, 80, edits):
                copy[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(76)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_groups(docs).collect()}
    assert got == dict(enumerate(root))


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 2**63, 300).astype(np.uint64)
    owner = np.repeat([0, 1], 250)
    signed = near_duplicates.dart_signatures(owner, np.concatenate([code[:250], code[50:]]), 3, 2000)
    assert abs((signed[0] == signed[1]).mean() - 200 / 300) < 0.05 and np.isinf(signed[2]).all()


def test_hard_rows(spark):
    docs = some_docs(spark)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 8]
    out = lines.drop_repeated_runs(docs.withColumn("n_removed", F.lit("clash")))
    assert out.count() == 9 and out.filter("text is null").count() == 1
    model = languages.train(docs)
    said = {r["doc_id"]: r["lang_pred"] for r in languages.predict(docs, model).collect()}
    assert said[3] == said[4] == said[5] == "und" and said[1] == "en"
    for frame in (docs, docs.limit(0)):
        assert sharding.assign_shards(frame, "doc_id", 3).count() == frame.count()
        assert languages.predict(frame, None).count() == frame.count()


def test_scores_are_whole_and_add_up(spark):
    docs = some_docs(spark).withColumn("training", F.coalesce(F.col("doc_id") != 2, F.lit(True)))
    got = maxent.score_texts(docs, "training").collect()
    assert len(got) == 9
    counts = Counter()
    for r in docs.filter("training").collect():
        counts.update([*plain_words(r["text"]), None])
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        if r["doc_id"] == 2:
            tokens = [*(f"word{k}" for k in range(40)), "more", None]
            base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
            assert r["n_tokens"] == 42 and r["n_known"] == 41 and abs(r["base_score"] - base) < 1e-9
    assert all(r["score"] < 0 and r["train_tokens"] == total for r in got)
    assert maxent.score_texts(docs.limit(0), "training").count() == 0


def test_toxic_words_are_counted_over_all_labels(spark):
    # 60 of 1000 toxic and none of 12,000 clean texts: too few beside 4000 clean ones, enough beside all.
    rows = spark.range(13_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 60, "plain text rareword, rareword").otherwise("plain text").alias("text"),
    )
    labels = rows.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("toxic"))
    known = labels.select("doc_id", F.col("toxic").cast("double").alias("value"))
    wanted = toxicity.hashed("rareword").tolist()
    assert toxicity.learned_words(rows, known, "doc_id", "text").tolist() == wanted
    # Rows that repeat an id are one text, and null and empty texts have no words.
    odd = rows.union(rows.filter("doc_id < 60")).union(spark.createDataFrame([(20_000, None), (20_001, "")], "doc_id long, text string"))
    assert toxicity.learned_words(odd, known, "doc_id", "text").tolist() == wanted
    assert not len(toxicity.learned_words(rows, known.filter("value = 0"), "doc_id", "text"))
    model = toxicity.train(rows, labels)
    assert wanted[0] in np.concatenate(model.voters.lexicons)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd.filter("doc_id in (5, 5000, 20000, 20001)"), model).collect()}
    assert scores[5] > scores[5000] and scores[20_000] == scores[20_001]


def test_toxic_words_weigh_by_the_length_of_a_text(spark):
    """Long clean texts hold as many toxic words as short toxic ones; who has more of them per word is toxic."""
    rng = random.Random(3)
    rows = []
    for k in range(1200):
        bad = k % 6 == 0
        size, hits = (rng.randint(40, 80), 5) if bad else (rng.randint(300, 900), rng.randint(1, 8))
        text = [f"w{rng.randrange(300)}" for _ in range(size)] + [f"bad{rng.randrange(60)}" for _ in range(hits)]
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = F.floor(F.col("doc_id") / 6) % 4 == 1
    model = toxicity.train(docs, docs.filter(~held).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model).filter(held).collect()
    bad, good = ([r["score"] for r in scored if r["toxic"] == t] for t in (1, 0))
    assert len(bad) == 50 and np.mean(np.array(bad) > np.quantile(good, 0.9)) > 0.95
    assert min(bad) >= 0 and max(bad + good) <= 1


def test_training_stores_sums_only(spark, monkeypatch):
    """What each task made of the model is added up without being stored first."""
    docs = spark.createDataFrame([(k, f"a b c{k % 7} d", True) for k in range(60)], "doc_id long, text string, training boolean").repartition(5)
    batches = maxent.batch_table(docs, "doc_id", "text", "training").repartition(5).checkpoint()
    model = maxent.start_model(maxent.word_counts(batches), 60)
    stored = []

    def cut(df):
        out = df.checkpoint()
        stored.append(out.count())
        return out

    monkeypatch.setattr(maxent, "cut", cut)
    moved = maxent.train_round(batches, model, 0, 1)
    assert np.abs(moved.node_weights).sum() > 0 and stored == [maxent.SEGMENTS]


def test_scoring_moves_no_words(spark, capsys):
    """Tokens go to the counts of their words with checksums; unknown words are scored too."""
    docs = spark.createDataFrame([(k, f"a b c{k % 7} d{k}", k % 3 > 0) for k in range(60)], "doc_id long, text string, training boolean")
    batches = maxent.batch_table(docs.repartition(3), "doc_id", "text", "training")
    counts = maxent.word_counts(batches)
    model = maxent.fit(batches, counts, 1)
    scored = maxent.score_batches(batches, counts, model)
    scored.explain("formatted")
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out)
    assert [e for e in exchanges if "low#" in e] and not [e for e in exchanges if "low#" in e and "words#" in e]
    # The same from the words themselves.
    for row in batches.collect():
        c = dict(counts.collect())
        rank, word = model.ids(pa.array(row["words"], pa.string()))
        count = np.array([*(c.get(w, 0) for w in row["words"]), model.end_count], float)
        codes = np.frombuffer(row["low"], "<u2").astype(int)
        starts = np.cumsum(row["lengths"]) - row["lengths"]
        first = np.zeros(len(codes), bool)
        first[starts] = True
        natural = model.log_probabilities(rank[codes], word[codes], count[codes], first)
        wanted = dict(zip(row["doc_ids"], np.add.reduceat(natural, starts) / np.log(10), strict=True))
        got = {r["doc_id"]: r["score"] for r in scored.collect() if r["doc_id"] in wanted}
        assert got == pytest.approx(wanted, rel=1e-12)


def test_top_k_leaves_bad_vectors_out(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=6).tolist() for _ in range(60)] + [None, [float("nan")] * 6, [None] * 6]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, F.col("id") % 20 == 0, 5).collect()
    whole = [np.floor(np.array(v) * 64).astype(int) for v in vectors[:60]]
    for q in (0, 20, 40):
        scored = sorted((-int(whole[q] @ whole[c]), c) for c in range(60) if c != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(-s, v) for _, v, s in mine] == scored


def test_pipeline_stages_keep_their_columns(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.filter("shard is null").count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def plain_probabilities(model, before, count_of, vocabulary):
    """Log probabilities of all words after the two words ``before``, by plain loops over the model's weights."""
    whole, none = 2**64, 1 << 32
    two, one = hashed = [none if w is False else zlib.crc32(b"\n" if w is None else w.encode()) for w in before]
    leaves, heads = len(model.leaf_mass), len(model.class_bias) - 1
    common = {"\n" if w is None else w for w in before} & set(model.common)
    far, near = [
        h if w is False or ("\n" if w is None else w) in common else none + 1 + h % leaves
        for w, h in zip(before, hashed)
    ]
    codes = [one * 3 + 1, (near * 0xC2B2AE3D27D4EB4F + far) * 3 + 2, two * 3]
    codes = [c % whole * 0x9E3779B97F4A7C15 % whole for c in codes]
    codes = [c ^ (c >> 29) for c in codes]

    def softmax(bias, weights, rows):
        scores = [float(b) + sum(float(weights[r][j]) for r in rows) for j, b in enumerate(bias)]
        top = max(scores)
        total = sum(math.exp(s - top) for s in scores)
        return [s - top - math.log(total) for s in scores]

    def rows(weights, factor, shift):
        bits = len(weights).bit_length() - 1
        return [(c + shift) % whole * factor % whole >> (64 - bits) for c in codes]

    classes = softmax(model.class_bias, model.class_weights, rows(model.class_weights, 0xD6E8FEB86659FD93, 0))
    rank = {None if w == "\n" else w: k for k, w in enumerate(model.common)}
    out = {}
    nodes = {}

    def branch(node, place):
        if node not in nodes:
            nodes[node] = softmax(model.node_bias[node], model.node_weights, rows(model.node_weights, 0xA0761D6478BD642F, node))
        return nodes[node][place]

    def leaf(k):
        """Down the tree, digit by digit of the leaf's number; nodes are numbered level by level."""
        chance, node, width, path = classes[heads], heads, leaves, 0
        nodes_of = 1
        while width > 1:
            width //= maxent.CLASS_WORDS
            place = k // width % maxent.CLASS_WORDS
            chance += branch(node + path, place)
            path = path * maxent.CLASS_WORDS + place
            node += nodes_of
            nodes_of *= maxent.CLASS_WORDS
        return chance

    for word in vocabulary:
        if word in rank:
            group, place = divmod(rank[word], maxent.CLASS_WORDS)
            out[word] = classes[group] + branch(group, place)
        else:
            k = zlib.crc32(b"\n" if word is None else word.encode()) % leaves
            out[word] = leaf(k) + math.log((count_of.get(word, 0) + 0.5) / model.leaf_mass[k])
    return out, sum(math.exp(leaf(k)) * 0.5 / m for k, m in enumerate(model.leaf_mass))


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """Few classes, so that most words are uncommon: each still has features, and a leaf in a tree of two levels."""
    monkeypatch.setattr(maxent, "CLASSES", 3)
    monkeypatch.setattr(maxent, "FIRST_BITS", 4)
    monkeypatch.setattr(maxent, "LEVEL_BITS", 5)
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame([(k, t, k % 5 != 1) for k, t in enumerate(texts)], "doc_id int, text string, training boolean")
    batches = maxent.batch_table(docs, "doc_id", "text", "training")
    counts = maxent.word_counts(batches)
    model = maxent.fit(batches, counts)
    assert len(model.common) == 96 and len(model.leaf_mass) == 32**2 and model.class_weights[:, -1].any()
    got = {r["doc_id"]: r["score"] for r in maxent.score_batches(batches, counts, model).collect()}
    count_of = Counter(t for k, text in enumerate(texts) if k % 5 != 1 for t in [*text.split(), None])
    for k in (0, 1, 2, 6, 11):
        tokens, expected = [False, False, *texts[k].split(), None], 0.0
        for at in range(2, len(tokens)):
            expected += plain_probabilities(model, tokens[at - 2 : at], count_of, [tokens[at]])[0][tokens[at]]
        assert abs(got[k] - expected / math.log(10)) < 1e-3 * max(1, abs(got[k]) / 100)
    for before in ([False, False], ["w1", "w2"], ["w399", "unseen"]):
        known, unseen = plain_probabilities(model, before, count_of, count_of)
        assert abs(sum(map(math.exp, known.values())) + unseen - 1) < 1e-5
