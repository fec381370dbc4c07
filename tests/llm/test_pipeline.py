import collections

import corpus_pipeline as cp
from hornlog.llm import quality_clf

from . import brute


def table(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def benchmark_text(spark, small):
    return spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]


def test_stages_against_brute_force(spark, documents, small, tmp_path):
    """Each stage on its own input; the first one's network is trusted, its effect is not."""
    more = [(9020, "alpha beta gamma delta epsilon zeta eta theta"), (9020, "one two three four five six seven eight nine ten"), (None, benchmark_text(spark, small))]
    docs = documents.union(spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in more], documents.schema))
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        rows = docs.collect()
        docs.unpersist()
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        got = out.collect()
        if name == "quality_classifier":
            scores = quality_clf.classify(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()
            want = sorted([str(r["doc_id"]) for r in scores if r["predicted"] == 1])
            assert sorted(str(r["doc_id"]) for r in got) == want
        elif name == "minhash_near_dedup":
            ids = collections.Counter(r["doc_id"] for r in rows)
            # rows of one id that others share have keys of their own, below all ids
            keys = {(r["doc_id"], r["text"]): -1000 - n if ids[r["doc_id"]] > 1 else r["doc_id"] for n, r in enumerate(rows) if r["doc_id"] is not None}
            groups = {}
            for key, _, group, _ in brute.near([(keys.get((r["doc_id"], r["text"])), r["text"]) for r in rows], 5, 80):
                groups.setdefault(group, set()).add(key)
            left = collections.Counter(keys[r["doc_id"], r["text"]] for r in got if r["doc_id"] is not None)
            assert all(sum(left[k] for k in members) == 1 for group, members in groups.items() if group is not None)
            assert all(min(members) in left for group, members in groups.items() if group is not None and min(members) >= 0)
            assert sum(r["doc_id"] is None for r in got) == sum(r["doc_id"] is None for r in rows)
        elif name == "substring_dedup":
            judged = brute.repeats([(r["doc_id"], r["text"]) for r in rows], 50)
            want = [(str(i), r["text"] if not m else kept) for r, (i, _, m, kept) in zip(rows, judged) if not m or kept]
            assert sorted(((str(r["doc_id"]), r["text"]) for r in got), key=str) == sorted(want, key=str)
        elif name == "benchmark_decontamination":
            judged = brute.hits([(r["doc_id"], r["text"]) for r in rows], benchmark)
            assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r["doc_id"]), r["text"]) for r, j in zip(rows, judged) if not j[2])
        else:
            assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r["doc_id"]), r["text"]) for r in rows)
            assert all(len(r["token_ids"]) == r["n_tokens"] for r in got)
        if k < len(cp.STAGES) - 1:
            assert out.columns == list(cp.COLUMNS)
        docs = out


def test_empty_documents(spark, documents, small):
    docs = documents.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
