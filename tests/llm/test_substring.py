from hornlog.llm import substring

from . import brute


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_covers_have_every_difference():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert rows_of(substring.remove_repeats(documents)) == sorted(brute.repeats(rows, 50), key=str)


def test_other_windows_and_digest(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()][-60:]
    some = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (5, 12):
        want = [(i, n, m, brute.sha(k)) for i, n, m, k in brute.repeats(rows, window)]
        assert rows_of(substring.remove_repeats(some, window, keep_text=False)) == sorted(want, key=str)


def test_empty_table(spark, documents):
    assert substring.remove_repeats(documents.limit(0)).count() == 0
