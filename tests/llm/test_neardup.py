import random

import numpy as np
import pytest

from hornlog.llm import neardup

from . import brute


def rows_of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert rows_of(neardup.near_duplicates(documents, 4)) == sorted(brute.near(rows, 4, 80), key=str)


def test_chains_and_families(spark):
    """Copies that drift away from the first: links exist between neighbours only; and texts of one boilerplate, not linked."""
    rng = random.Random(3)
    rows, vocabulary = [], [f"w{k}" for k in range(4000)]
    for family in range(4):
        text = [rng.choice(vocabulary) for _ in range((30, 90, 200, 500)[family])]
        for k in range(25):
            rows.append((family * 100 + rng.randrange(100) * 1000 + k, " ".join(text)))
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    plate = [rng.choice(vocabulary) for _ in range(60)]
    rows += [(700_000 + k, " ".join(plate + [rng.choice(vocabulary) for _ in range(40)])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(neardup.near_duplicates(df, 5)) == sorted(brute.near(rows, 5, 80), key=str)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
        n = int(len(both) * share)
        extra = (len(both) - n) // 2
        a, b = np.sort(both[: n + extra]), np.sort(np.concatenate([both[:n], both[n + extra :]]))
        r = neardup.registers([a, b])
        j, _ = neardup.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))
        assert abs(j[0] - n / len(both)) < 0.15


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 200), (150, 200), (150, 160)], "a bigint, b bigint")
    got = {(r["doc_id"], r["component"]) for r in neardup.components(edges).collect()}
    assert got == {(k, 0) for k in range(n + 1)} | {(k, 100) for k in (100, 150, 160, 200)}


def test_empty_table(spark, documents):
    assert neardup.near_duplicates(documents.limit(0)).count() == 0


def test_one_large_family(spark):
    """Variants of one text, some linked and some not: buckets beyond what a join compares."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for size in (100, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(160):
            text = list(base)
            for _ in range(rng.randrange(1, 1 + size // 14)):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000 + size * 1000, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(neardup.near_duplicates(df, 4)) == sorted(brute.near(rows, 4, 80), key=str)


def test_small_sets_share_a_band_and_pass_the_estimate():
    """10,000 pairs at the threshold, of 4 to 160 shingles: each meets in a band and none is dropped by its estimate."""
    rng = np.random.default_rng(11)
    missed = dropped = 0
    for n in range(4, 129, 4):
        sets, sizes = [], []
        for k in range(320):
            both = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            more = rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)
            cut = len(more) * (k % 3) // 2  # the larger has all others, half of them or none
            sets += [np.unique(np.concatenate([both, more[:cut]])), np.unique(np.concatenate([both, more[cut:]]))]
        sizes = [len(s) for s in sets]
        raw = neardup.sketches_of(sets, 80)
        keys, who = neardup.keys_of(raw, sizes, 80)
        own = [set() for _ in sets]
        for key, k in zip(keys.tolist(), who.tolist(), strict=True):
            own[k].add(key)
        for k in range(0, len(sets), 2):
            missed += not own[k] & own[k + 1]
            a, b = (np.frombuffer(neardup.row_beside(raw[i], sizes[i], sizes[j], 80), np.uint16)[None] for i, j in ((k, k + 1), (k + 1, k)))
            times = neardup.copies(min(max(sizes[k : k + 2]), neardup.FEW), 80)[0]
            j, used = neardup.estimate(a, b, np.array([sizes[k] * times]), np.array([sizes[k + 1] * times]))
            dropped += bool(j[0] < 0.8 - neardup.CUT * np.sqrt(0.16 / used[0]))
    assert (missed, dropped) == (0, 0)


def test_copies_of_small_sets():
    """Any two sizes that may be linked have a number of copies in common: the larger one's own."""
    for percent in (50, 80, 95):
        for n in range(1, 200):
            for m in range(n, n * 100 // percent + 1):
                assert neardup.copies(m, percent)[0] in neardup.copies(n, percent)
    assert neardup.copies(0, 80) == ()


def test_forest_joins_the_same_with_fewer_edges():
    rng = np.random.default_rng(4)

    def parts(edges, n):
        up = list(range(n))
        for a, b in edges:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    for n, m in ((1, 0), (30, 20), (40, 400), (60, 60)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        at = neardup.forest(a, b)
        assert parts(zip(a, b, strict=True), n) == parts(zip(a[at], b[at], strict=True), n)
        assert len(at) == n - len(set(parts(zip(a, b, strict=True), n)))
