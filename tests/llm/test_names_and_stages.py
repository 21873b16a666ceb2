"""Columns with clashing names keep their values; lines differ by any byte; stages of the pipeline by brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deckspark.llm import languages, lines, passages, pseudonyms, sharding

CLASHES = ("_letter", "_doc", "_gone", "_key", "_score", "_lang", "_items", "_jump", "_at", "_found", "_row", "_copies", "_text")
LONG = " ".join(f"word{k}" for k in range(60))


def clashing(spark):
    rows = [(1, LONG + "\nend", "en", "a"), (2, LONG, "en", "a"), (3, "mail me@example.org on 2024-02-29", "en", "b"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in CLASHES})


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: languages.predict(df, None),
        lambda df: lines.drop_repeated_runs(df),
        lambda df: passages.drop_repeated_passages(df),
        lambda df: pseudonyms.pseudonymise(df),
        lambda df: sharding.assign_shards(df, "doc_id", 4, grown="more"),
        lambda df: corpus_pipeline.drop_near_duplicates(df.sparkSession, df, ""),
        lambda df: corpus_pipeline.mix_sources(df.sparkSession, df, ""),
    ],
)
def test_clashing_names_keep_their_values(spark, operator):
    rows = operator(clashing(spark)).collect()
    assert rows
    for row in rows:
        assert [row[c] for c in CLASHES] == [f"{c} of {row['doc_id']}" for c in CLASHES]


def test_lines_are_compared_byte_for_byte(spark):
    other = [LONG.title(), LONG.replace(" ", "\t"), LONG.replace(" ", "  "), LONG.replace(" ", "\x0b"), LONG]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([LONG, *other])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_runs(df).collect()}
    assert got == {0: LONG, **{k + 1: t for k, t in enumerate(other[:-1])}, 5: ""}


def test_language_sample_is_bounded_and_has_every_language(spark):
    rows = [("en", f"english text {k}") for k in range(3000)] + [("en", "one hot text")] * 3000 + [("de", "wenig"), ("fr", None), (None, "x")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = languages.labelled_sample(df, "text", "lang", 200).collect()
    counts = Counter(r["lang"] for r in got)
    assert counts["de"] == 1 and set(counts) == {"en", "de"} and 130 < counts["en"] < 270
    assert len(set(got)) == len(got)


# --- stages of the pipeline ---------------------------------------------------------------------


def shingles(text):
    found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def test_near_duplicate_stage_equals_brute_force(spark):
    """The smallest id of each connected group of similarity 0.8 stays."""
    base = [[f"w{17 * s + k}" for k in range(120)] for s in range(6)]
    texts = []
    for s, tokens in enumerate(base):
        for step in range(4):
            own = list(tokens)
            for k in range(0, 2 * step):
                own[5 * k] = f"x{s}.{step}.{k}"
            texts.append(" ".join(own))
    texts += [texts[0], "", None, "short one", "short one", "Short ONE"]
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    group = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted(k for k in range(len(texts)) if group[k] == k)


def test_decontamination_stage_equals_brute_force(spark, tmp_path):
    item = [f"item{k}" for k in range(30)]
    texts = [" ".join(item), "before " + " ".join(item[3:20]) + " after", " ".join(item[:12]), None, "", "tiny item", "a tiny item here",
             " ".join(f"z{k}" for k in range(400)) + " " + " ".join(item[:13])]
    spark.createDataFrame([(1, " ".join(item)), (2, "Tiny, ITEM"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")

    def cut(text):
        return re.findall("[a-z0-9]+", (text or "").lower())

    windows = {tuple(item[k : k + 13]) for k in range(18)} | {("tiny", "item")}
    kept = []
    for k, text in enumerate(texts):
        own = cut(text)
        hit = {j for w in windows for s in range(len(own) - len(w) + 1) if tuple(own[s : s + len(w)]) == w for j in range(s, s + len(w))}
        if not (hit and 20 * len(hit) >= len(own)):
            kept.append(k)
    got = sorted(r["doc_id"] for r in corpus_pipeline.decontaminate(spark, df, str(tmp_path)).collect())
    assert got == kept and 7 in kept and 1 not in kept


def test_mixing_stage_takes_whole_documents_near_the_targets(spark):
    """A row comes at most twice, repeats share, and each source's words come near its target."""
    rows = [(k, "w " * (20 + k % 13), "en", "abc"[min(2, k % 5)], k) for k in range(3000)] + [(9000, "same words " * 9, "en", "a", 1)] * 7
    rows += [(9001, None, None, None, 0), (9002, "", "de", None, 0), (9003, "same id", "de", "b", 0), (9003, "same id", "fr", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = [tuple(r) for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    counts = Counter(got)
    held = Counter(rows)
    assert all(counts[r] <= 2 * held[r] for r in counts) and set(counts) <= set(held)
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in "abc"}
    taken = {s: sum(len((r[1] or "").split()) for r in got if r[3] == s) for s in "abc"}
    total, weight = sum(size.values()) * 1.5, {"a": 5, "b": 2, "c": 1}
    target, open_sources = {}, set("abc")
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if level * weight[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2 * size[s] for s in over}
        open_sources -= over
    target |= {s: level * weight[s] for s in open_sources}
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 100 for s in "abc")


def test_language_stage_drops_only_texts_without_a_language(spark):
    english = "the quick brown fox jumps over the lazy dog and the cat".split()
    german = "der schnelle braune fuchs springt und die katze ist ein tier".split()
    rows = [(2 * k, " ".join(english[j % 11] for j in range(k, k + 12)), "en") for k in range(60)]
    rows += [(2 * k + 1, " ".join(german[j % 11] for j in range(k, k + 12)), "de") for k in range(60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "en"), (903, "the dog and the cat over the fox", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert got == {k: v for k, _, v in rows if k < 900} | {903: "en"}
