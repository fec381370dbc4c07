from hornlog.llm import decontam

from . import brute


def test_against_brute_force(spark, documents, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(900, "Quick brown FOX jumps"), (901, None), (902, " !! "), (None, "over a lazy dog and then"), (900, "its den before night falls on all hills the quick brown fox")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i, n, h, k, brute.sha(x), h > 0) for i, n, h, k, x in brute.hits([(r["doc_id"], r["text"]) for r in documents.collect()], items)]
    got = [tuple(r) for r in decontam.decontaminate(documents, benchmark).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # a benchmark in several blocks, over an index of all terms
    blocks = [tuple(r) for r in decontam.Search(documents, benchmark, block_bytes=2000).digest().collect()]
    assert sorted(blocks, key=str) == sorted(want, key=str)


def test_matches_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x c y a b z"), (3, "a q q q b q q q c"), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    rows = lambda slop: sorted((r["doc_id"], r["start"], r["length"]) for r in decontam.Search(docs, items, 3, slop).matches().collect())
    assert rows(0) == [(1, 0, 3)]

    def brute_near(slop):
        texts = {1: "a b c d e", 2: "x c y a b z", 3: "a q q q b q q q c"}
        return sorted((d, s, 3 + slop) for d, t in texts.items() for s in range(len(t.split())) if {"a", "b", "c"} <= set(t.split()[s : s + 3 + slop]))

    for slop in (1, 2, 7):
        assert rows(slop) == brute_near(slop)


def test_empty_tables(spark, documents, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontam.decontaminate(documents.limit(0), benchmark).count() == 0
    got = decontam.decontaminate(documents, benchmark.limit(0)).collect()
    assert len(got) == documents.count() and not any(r["contaminated"] for r in got)
