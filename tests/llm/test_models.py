"""Operators with a fitted part: exact parts by brute force, the fitted part by held-out accuracy."""

import collections
import math
import os
import re
import time
import zlib

import numpy as np
import pytest

from hornlog.llm import langid, lm_scoring, quality_clf, quality_rules, queries
from hornlog.llm.common import Segments

from . import brute

MIDDLE = "/root/testdata/sf0.01"


def fold(i, m):
    return -1 if i is None else zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def labels(spark, small):
    extra = spark.createDataFrame([(9004, 1, 0), (9004, 0, 0), (None, 1, 1), (9005, None, None)], "doc_id bigint, quality int, toxic int")
    return spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").union(extra)


def base_rules(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    n = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)]
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality_rules(spark, documents, labels):
    rows = documents.select("doc_id", "text").collect()
    got = quality_rules.quality_rules(documents, labels).collect()
    assert sorted((r[:7] for r in map(tuple, got)), key=str) == sorted(((r["doc_id"], *base_rules(r["text"])) for r in rows), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(documents.limit(0), labels).count() == 0
    alone = quality_rules.quality_rules(documents, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in alone)


def test_quality_rules_score_is_the_mean_log_ratio(spark):
    texts = ["a b c", "b c d d", "", "e", None]
    table = np.arange(64) / 64
    w = Segments(texts)
    want = []
    for t in texts:
        h = Segments([t])
        uni, bi, _ = quality_rules.ngram_buckets(h, 64)
        want.append((table[uni].sum() + table[bi].sum()) / max(1, 2 * len(uni) - 1))
    assert np.allclose(quality_rules._score(w, table), want)


def test_lm_base_scores_and_model(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    counts, texts = collections.Counter(), []
    for r in rows:
        w = [*brute.words(r["text"], True), None]
        texts.append((r["doc_id"], w))
        if fold(r["doc_id"], 7) != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, fold(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in texts), key=str)
    got = lm_scoring.score_texts(documents).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in got)
    assert lm_scoring.score_texts(documents.limit(0)).count() == 0


def brute_model(rows):
    """Scores of rows (doc_id, text) by loops over dictionaries; only hashes and slots are the operator's."""
    L = lm_scoring
    seqs = []
    for i, t in rows:
        w = Segments([t], lower=True)
        seqs.append((i, brute.words(t, True), w.hash, L.tail_units(w, np.arange(len(w.hash)))))
    counts, tail_of, hash_of = collections.Counter(), {}, {}
    for i, words, h, tails in seqs:
        tail_of.update(zip(words, tails.tolist()))
        hash_of.update(zip(words, h.view(np.int64).tolist()))
        if L.group_of(i) != L.ROUNDS:
            counts.update(words)
    docs = sum(L.group_of(i) != L.ROUNDS for i, *_ in seqs)
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], hash_of[w]))[: L.OWN - 1], 1)}
    unit = {w: own.get(w, t) for w, t in tail_of.items()}
    n, v = [0] * L.UNITS, [0] * L.UNITS
    n[0] = docs
    for w, c in counts.items():
        n[unit[w]] += c
        v[unit[w]] += unit[w] >= L.OWN
    bits = min(L.MOST_SLOT_BITS, max(L.LEAST_SLOT_BITS, math.ceil(math.log2(max(1, (len(counts) + 1) / L.WORDS_A_SLOT)))))
    size = 1 << bits
    weights = [collections.defaultdict(float), collections.defaultdict(float)]
    for c in range(L.CLASSES):
        mine = sum(n[u] + 1 for u in range(L.UNITS) if u % L.CLASSES == c)
        weights[0][size, c] = math.log(mine / (sum(n) + L.UNITS))
        for m in range(L.MEMBERS):
            weights[1][size + c, m] = math.log((n[m * L.CLASSES + c] + 1) / mine)

    def steps(words, h):
        s = L.Sequences(np.arange(len(words)), np.array([len(words)]), h, np.array([unit[w] for w in words], np.int64))
        tables = s.slots(0, len(s.unit), bits)
        return s.unit.tolist(), [[(int(what[k]), [int(x[k]) for x in slots]) for k in range(len(what))] for what, slots in tables]

    def softmax(t, slots):
        z = [sum(weights[t][x, k] for x in slots) for k in range(L.CLASSES)]
        total = math.log(sum(map(math.exp, z)))
        return [x - total for x in z]

    for r in range(L.ROUNDS):
        sums = [collections.defaultdict(lambda: [0.0, 0.0]) for _ in range(2)]
        for i, words, h, _ in seqs:
            if L.group_of(i) == r:
                for t, events in enumerate(steps(words, h)[1]):
                    for what, slots in events:
                        z = softmax(t, slots)
                        for x in slots:
                            sums[t][x, what][0] += 1
                            for k in range(L.CLASSES):
                                sums[t][x, k][1] += math.exp(z[k])
        for t in range(2):
            for at, (o, e) in sums[t].items():
                weights[t][at] += L.RATE / 3 * (o - e) / ((o + e) / 2 + L.DAMPING)
    out = []
    for i, words, h, _ in seqs:
        units, tables = steps(words, h)
        total = sum(softmax(t, slots)[what] for t in range(2) for what, slots in tables[t]) / math.log(10)
        total += sum(math.log10((counts[w] + 1) / (n[u] + v[u] + 1)) for w, u in zip(words, units) if u >= L.OWN)
        out.append((i, total))
    return out


def lm_rows(spark, rows, parts, **how):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return sorted((r["doc_id"], r["score"]) for r in lm_scoring.score_texts(docs, **how).collect())


def test_lm_score_against_brute_force_and_layouts(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 1500] + [(90_001, None), (90_002, ""), (90_003, "odd " * 300), (90_003, "odd " * 300)]
    want = sorted(brute_model(rows))
    one = lm_rows(spark, rows, 1)
    assert [x[0] for x in one] == [x[0] for x in want]
    assert max(abs(a[1] - b[1]) for a, b in zip(one, want)) < 0.02  # probabilities are summed in steps of 1 / ONE
    eight = lm_rows(spark, rows, 8)
    assert max(abs(a[1] - b[1]) for a, b in zip(one, eight)) < 1e-6


def test_lm_blocks_do_not_change_scores(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows.append((90_001, "a very long text of words " * 60_000))  # 1.5 MB
    assert max(abs(a[1] - b[1]) for a, b in zip(lm_rows(spark, rows, 2), lm_rows(spark, rows, 2, block_bytes=20_000))) < 1e-5


def test_lm_held_out_gain(spark):
    got = lm_scoring.score_texts(spark.read.parquet(f"{MIDDLE}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got) > 0.05


def test_lm_probabilities_sum_to_one():
    """Units of any history, times each unit's words and its unknown mass, are one."""
    L = lm_scoring
    rng = np.random.default_rng(2)
    tails = {u: (int(rng.integers(1, 50)), int(rng.integers(1, 9))) for u in range(L.OWN, L.UNITS)}
    model = L.Model.start(1000, [(7, 5, L.OWN), (-3, 4, L.OWN + 1)], {u: (n + 9, v + 2) for u, (n, v) in tails.items()}, 3)
    model.weights = tuple(rng.normal(0, 1, w.shape).astype(np.float32) for w in model.weights)
    s = L.Sequences(np.array([0, 1, 0]), np.array([2, 0, 1]), np.array([5, 9], np.uint64), np.array([3, 200]))
    assert s.starts.tolist() == [0, 3, 4, 6] and s.unit.tolist() == [3, 200, 0, 0, 3, 0]
    assert s.features[0][0] == s.features[0][3] == s.features[0][4] and s.features[1][1] == s.features[1][0]  # texts do not see each other
    total = np.zeros(len(s.unit))
    for u in range(L.UNITS):
        s.unit[:] = u
        (cls, cs), (member, ms) = s.slots(0, len(s.unit), model.bits)
        total += L.probabilities(model.weights[0], cs)[0][cls, np.arange(len(cls))] * L.probabilities(model.weights[1], ms)[0][member, np.arange(len(cls))]
    assert np.allclose(total, 1, atol=1e-5)


def test_lm_query_conditions_words_beyond_the_own_units(spark, tmp_path):
    """Two words of one shared unit and one count: what went before tells them apart."""
    L = lm_scoring
    w = Segments([" ".join(f"w{a}{b}zz" for a in range(9) for b in range(9))], lower=True)
    assert len(set(L.tail_units(w, np.arange(len(w.hash))).tolist())) == 1
    common = " ".join(f"c{k}" for k in range(L.OWN)) + " "
    rows = [(k, common * 4 + ("red w11zz " * 3 + "blue w22zz " * 3)) for k in range(200)]
    rows += [(1_000, "red w11zz"), (1_001, "red w22zz"), (1_002, "blue w22zz"), (1_003, "blue w11zz")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query, units = (
        {r["doc_id"]: r["score"] for r in df.where("doc_id >= 1000").collect()}
        for df in (queries.op4_lm_scoring(spark, str(tmp_path)), L.score_texts(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    )
    got = {i: query[i] - units[i] for i in query}  # without what the units' own history gives, the ends' included
    counts = collections.Counter(x for i, t in rows if L.group_of(i) != L.ROUNDS for x in t.split())
    own = sorted(counts, key=lambda x: -counts[x])[: L.OWN - 1]
    assert abs(counts["w11zz"] - counts["w22zz"]) <= 2 and not {"w11zz", "w22zz"} & set(own)
    assert got[1_000] > got[1_001] + 0.1 and got[1_002] > got[1_003] + 0.1


def brute_paths(words):
    """By halves of (word, mass) from the first on: each word's splits as (rank, right, mass right of it, mass left of it)."""
    out = {w: [] for w, _ in words}

    def halve(lo, hi):
        if hi - lo < 2:
            return
        mass = lambda a, b: sum(m for _, m in words[a:b])
        at = max(k for k in range(lo, hi) if mass(lo, k) <= mass(lo, hi) / 2)
        at = max(at, lo + 1)
        for k in range(lo, hi):
            out[words[k][0]].append((at, k >= at, mass(at, hi), mass(lo, at)))
        halve(lo, at)
        halve(at, hi)

    halve(0, len(words))
    return out


def test_lm_tree_against_brute_force():
    """Every known word of every unit is reached by its own path, whose frequencies give the word's."""
    L, rng = lm_scoring, np.random.default_rng(3)
    sizes = {(L.OWN, 1): 37, (L.OWN, 2): 5, (L.OWN, 900): 1, (L.OWN + 3, 4): 1, (L.UNITS - 1, 7): 2, (L.UNITS - 1, 1): 300}
    order = rng.permutation(len(sizes))
    unit, c, m = np.array([(u, c, m) for (u, c), m in sizes.items()])[order].T
    tree, base = L.Tree(unit, c, m), 0
    for u in sorted(set(unit.tolist())):
        words = [((c, k), c + 1) for (x, c), m in sorted(sizes.items(), key=lambda s: -s[0][1]) if x == u for k in range(m)]
        want = brute_paths(words)
        ranks = tree.ranks(np.full(len(words), u), np.array([c for (c, _), _ in words]), np.array([k for (_, k), _ in words]))
        assert ranks.tolist() == list(range(base, base + len(words)))
        starts, split, right, odds = tree.paths(ranks)
        for k, (w, mass) in enumerate(words):
            mine = slice(starts[k], starts[k + 1])
            assert [(int(a) - base, bool(b)) for a, b in zip(split[mine], right[mine])] == [x[:2] for x in want[w]]
            assert np.allclose(odds[mine], [math.log(x[2] / x[3]) for x in want[w]])
            p = np.prod(1 / (1 + np.exp(np.where(right[mine], -odds[mine], odds[mine]))))
            assert math.isclose(p, mass / sum(m for _, m in words), rel_tol=1e-5)
        base += len(words)


def test_lm_within_against_brute_force_and_layouts(spark, small, monkeypatch):
    """What the splits add to the model that test_lm_score_against_brute_force_and_layouts goes over, by loops; only hashes and slots are the operator's."""
    L = lm_scoring
    monkeypatch.setattr(L, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(L, "PACKED_ROWS", 700)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [r for r in rows if len(r[1] or "") < 1500] + [(90_001, None), (90_003, "odd " * 300), (90_003, "odd " * 300), (90_004, "unseen1 unseen2")]
    seqs, counts, hash_of, tail_of = [], collections.Counter(), {}, {}
    for i, t in rows:
        w = Segments([t], lower=True)
        words = brute.words(t, True)
        seqs.append((i, words, w.hash))
        hash_of.update(zip(words, w.hash.view(np.int64).tolist()))
        tail_of.update(zip(words, L.tail_units(w, np.arange(len(words))).tolist()))
        if L.group_of(i) != L.ROUNDS:
            counts.update(words)
    buckets = 1 + (sum(counts.values()) + sum(L.group_of(i) != L.ROUNDS for i, *_ in seqs)) // 500
    assert buckets > 3
    own = set(sorted(counts, key=lambda w: (-counts[w], hash_of[w]))[: L.OWN - 1])
    in_row = sorted((w for w in counts if w not in own), key=lambda w: (tail_of[w], -counts[w], hash_of[w] % buckets, hash_of[w]))
    paths, base = {}, 0
    for u in sorted({tail_of[w] for w in in_row}):
        mine = [(w, counts[w] + 1) for w in in_row if tail_of[w] == u]
        paths |= {w: [(base + a, *rest) for a, *rest in p] for w, p in brute_paths(mine).items()}
        base += len(mine)
    bits = min(L.MOST_SLOT_BITS, max(L.LEAST_SLOT_BITS, math.ceil(math.log2(max(1, (len(counts) + 1) / L.WORDS_A_SLOT)))))
    pairs = L.SPLIT_SLOTS << bits
    weights = collections.defaultdict(float)

    def steps(words, h):
        """(right, odds, slots) of each split of each word"""
        s = L.Sequences(np.arange(len(words)), np.array([len(words)]), h, np.zeros(len(words), np.int64))
        for k, w in enumerate(words):
            for at, right, above, below in paths.get(w, ()):
                salt = L.mix64(np.array([at], np.uint64)) >> np.uint64(32)
                slots = [L.split_slots((f[k : k + 1] >> np.uint64(32)).astype(np.uint32), salt.astype(np.uint32), pairs) for f in s.features]
                yield right, math.log(above / below), [int(x[0]) for x in slots]

    def chance(odds, slots):
        return 1 / (1 + math.exp(-odds - sum(weights[x, 1] - weights[x, 0] for x in slots)))

    for r in range(L.ROUNDS):
        sums = collections.defaultdict(lambda: [0.0, 0.0])
        for i, words, h in seqs:
            if L.group_of(i) == r:
                for right, odds, slots in steps(words, h):
                    p = chance(odds, slots)
                    for x in slots:
                        sums[x, int(right)][0] += 1
                        sums[x, 1][1] += p
                        sums[x, 0][1] += 1 - p
        for at, (o, e) in sums.items():
            weights[at] += L.RATE / 3 * (o - e) / ((o + e) / 2 + L.DAMPING)
    want = []
    for i, words, h in seqs:
        got = sum(math.log10(p if right else 1 - p) for right, p in ((right, chance(odds, slots)) for right, odds, slots in steps(words, h)))
        want.append((i, got - sum(math.log10(p if right else 1 - p) for w in words for right, p in ((right, a / (a + b)) for _, right, a, b in paths.get(w, ())))))
    assert max(abs(x) for _, x in want) > 0.1
    plain, one = lm_rows(spark, rows, 1), lm_rows(spark, rows, 1, within=True)
    assert [x[0] for x in one] == [x[0] for x in sorted(want)]
    assert max(abs(a[1] - b[1] - c[1]) for a, b, c in zip(one, plain, sorted(want))) < 0.01  # probabilities are summed in steps of 1 / ONE
    assert max(abs(a[1] - b[1]) for a, b in zip(one, lm_rows(spark, rows, 8, block_bytes=20_000, within=True))) < 1e-6


def test_lm_steps_leave_no_shuffle_files(spark, small, monkeypatch):
    """Before the blocks are numbered and before each round, nothing that earlier steps shuffled is on disk any more."""
    L, name = lm_scoring, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tops = [x.getPath() for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for top in tops for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    others, left, conf = files(), {}, spark.conf.get(name, None)

    def watched(step):
        run = getattr(L, step)

        def after_waiting(*args):
            end = time.time() + 10  # files go in the background
            while files() - others and time.time() < end:
                time.sleep(0.1)
            left[step, args[2] if step == "_round" else 0] = len(files() - others)
            return run(*args)

        monkeypatch.setattr(L, step, after_waiting)

    watched("_numbered")
    watched("_round")
    df = L.score_texts(spark.read.parquet(f"{small}/documents.parquet"), within=True)
    assert left == {("_numbered", 0): 0} | {("_round", k): 0 for k in range(L.ROUNDS)}
    assert spark.conf.get(name, None) == conf and df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_lm_split_probabilities_sum_to_one():
    """After any history, the known words of a unit have all of its known mass, whatever the weights."""
    L, rng = lm_scoring, np.random.default_rng(4)
    tree = L.Tree(np.array([L.OWN, L.OWN]), np.array([1, 6]), np.array([60, 3]))
    model = L.Model.start(1000, [], {L.OWN: (78, 63)}, 3, tree, within=True)
    model.weights = tuple(rng.normal(0, 1, w.shape).astype(np.float32) for w in model.weights)
    s = L.Sequences(np.arange(63), np.array([63]), rng.integers(0, 1 << 60, 63).astype(np.uint64), np.full(63, L.OWN))
    for f in s.features:
        f[:] = f[5]  # the same history before all 63 words
    score = model.of_words(np.log10(np.array([7.0] * 3 + [2.0] * 60 + [1.0])), s.unit + np.where(s.is_word, 0, L.OWN))
    L.Splits(s, model, np.arange(63), L.Paths(tree, np.arange(63))).add_scores(score)
    assert np.isclose((10 ** score).sum(), 1) and np.ptp(score[3:63]) > 0.1  # the last is the unknown words' mass


def test_quality_classifier(spark, documents, labels):
    got = quality_clf.classify(documents, labels).collect()
    rows = documents.select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in got)
    assert quality_clf.classify(documents.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_clf.classify(documents, labels.limit(0)).collect()} == {0.5}


def test_quality_classifier_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = quality_clf.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_language_id(spark, documents):
    rows = {str(r["doc_id"]): r for r in documents.collect()}
    got = langid.identify(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        text = rows[str(r["doc_id"])]["text"]
        assert r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] >= 9000:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    real = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == rows[str(r["doc_id"])]["lang"] for r in real) / len(real) > 0.85
    assert langid.identify(documents.limit(0)).count() == 0


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    g = langid.Gru(rng, 3)
    g.w, g.u = g.w.astype(np.float64), g.u.astype(np.float64)
    steps = rng.integers(0, 256, (5, 4))
    weight = rng.normal(0, 1, (5, 4, 3))
    loss = lambda: sum((h * w).sum() for h, w in zip(g.states(steps), weight))
    keep = []
    list(g.states(steps, keep))
    dw, du = g.gradients(keep, weight)
    for p, d, at in ((g.u, du, (1, 4)), (g.u, du, (2, 8)), (g.w, dw, (int(steps[2, 1]), 0)), (g.w, dw, (int(steps[0, 3]), 7))):
        before = p[at]
        p[at] = before + 1e-4
        up = loss()
        p[at] = before - 1e-4
        down = loss()
        p[at] = before
        assert abs((up - down) / 2e-4 - d[at]) < 1e-3
