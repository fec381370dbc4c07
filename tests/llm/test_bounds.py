"""What lies beyond bounds that operators had or have: sizes, numbers of labels, types of ids."""

import random
import zlib

import numpy as np

from hornlog.llm import bpe, decontam, langid, lm_scoring, neardup, quality_clf, quality_rules, substring

from hornlog.llm.common import Segments

from . import brute


def test_more_languages_than_two_hundred(spark):
    rows = [(k, chr(0x4E00 + k % 230) * 90, f"l{k % 230}") for k in range(690)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5}
    assert len(learned) > 220 and langid.fit(docs, per_lang=2).langs == sorted(learned)


def test_segments_to_learn_from_are_bounded_and_do_not_follow_the_layout(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid.ByteTagger, "train", lambda self, segments, target: seen.append((segments.tobytes(), target.tolist())))
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(("ab", "cd", "ef") if k % 2 else ("xy", "zu", "vw")) for _ in range(900)), "en" if k % 2 else "de") for k in range(60)]
    rows += [(k, rows[1][1], "en") for k in range(100, 160)] + [(None, rows[1][1], "en")] * 20
    for parts in (1, 5):
        langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts), per_lang=30)
    assert seen[0] == seen[1] and seen[0][1].count(0) == 30 and seen[0][1].count(1) == 30


def test_targets_by_broadcast_or_shuffle(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    one, other = (quality_rules.fit(documents, labels, broadcast_rows=n) for n in (10**6, 0))
    assert (one[0] == other[0]).all() and one[1] == other[1]
    ids = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    words = sum(max(0, 2 * len(brute.words(r["text"])) - 1) for r in documents.collect() if r["doc_id"] in ids and not quality_rules_aside(r["doc_id"]))
    seen = [r["text"] for r in documents.collect() if r["doc_id"] in ids and not quality_rules_aside(r["doc_id"])]
    raw = [r["text"] for r in documents.collect()]
    total, every = (np.bincount(np.concatenate([np.concatenate([u, b[w]]) for u, b, w in (quality_rules.ngram_buckets(Segments([t]), quality_rules.BUCKETS) for t in texts)]), minlength=quality_rules.BUCKETS) for texts in (seen, raw))
    assert total.sum() == words
    assert np.allclose(one[0], np.log((total + 1) / (total.sum() + quality_rules.BUCKETS)) - np.log((every + 1) / (every.sum() + quality_rules.BUCKETS)))


def quality_rules_aside(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_pairs_at_the_threshold_are_candidates_and_pass_the_estimate():
    """10,000 pairs of sets of 130 to 1,000 shingles at a similarity of just 0.8 or more."""
    rng = np.random.default_rng(8)
    missed = dropped = 0
    for a in range(0, 10_000, 500):
        pairs = []
        for _ in range(500):
            n = int(rng.integers(130, 1000))
            shared = -(-8 * 2 * n // 18)  # of two sets of n: shared / (2 n - shared) >= 0.8
            h = np.unique(rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64) << np.uint64(1))
            pairs += [np.sort(h[:0]), np.sort(h[:0])]
            order = rng.permutation(len(h))
            pairs[-2], pairs[-1] = np.sort(h[order[:n]]), np.sort(h[order[len(h) - n :]])
        r = neardup.registers(pairs)
        keys = neardup.band_keys(r)
        missed += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
        n = np.array([len(p) for p in pairs], float)
        j, used = neardup.estimate(r[::2], r[1::2], n[::2], n[1::2])
        dropped += int((j < 0.8 - neardup.CUT * np.sqrt(0.16 / np.maximum(used, 1))).sum())
    assert (missed, dropped) == (0, 0)


def test_very_long_texts_and_small_ids(spark, small):
    """A text of 2 MB and more than 400,000 words, a word of 100 kB, ids of 32 bits."""
    rng = random.Random(5)
    item = "an odd phrase of ten words that only the benchmark has"
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(420_000)) + " " + item + " end"
    rows = [(1, long), (2, "x " * 60 + long[:40_000]), (3, "b" * 100_000 + " c"), (4, None), (5, "short text")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    benchmark = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert [tuple(r) for r in decontam.decontaminate(docs, benchmark).where("contaminated").select("doc_id", "n_words", "n_hit").collect()] == [(1, 420_012, 11)]
    want = [(i, n, m) for i, n, m, _ in brute.repeats(rows, 50)]
    assert sorted(tuple(r) for r in substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()) == sorted(want)
    near = {r["doc_id"]: r for r in neardup.near_duplicates(docs, 4).collect()}
    assert all(near[i]["n_shingles"] == len(brute.shingles(t, 4)) and near[i]["component_id"] == i for i, t in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score_texts(docs).collect()} == {i: len(brute.words(t)) + 1 for i, t in rows}
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (5, 0, 0)], "doc_id int, quality int, toxic int")
    assert quality_clf.classify(docs, labels).count() == 5
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.quality_rules(docs, labels).collect()} == {i: len(brute.words(t)) for i, t in rows}
    assert bpe.decode(bpe.encode(docs)).where("doc_id = 1").first()["text"] == long
    tagged = langid.identify(docs.selectExpr("doc_id", "text", "case when doc_id = 5 then 'en' when doc_id = 2 then 'xx' end as lang"))
    assert tagged.count() == 5
