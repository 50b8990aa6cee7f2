"""What must hold whatever the data: isolation by authorization, independence of row order, exact windows, ties."""

from pyspark.sql import functions as F

from evidentia.operators import graph, ledger, retrieval

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_statistics_stay_within_the_scope(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = spark.createDataFrame([(1, "the of and that"), (2, "la de que")], "query_id long, text string")
    allowed = docs.filter("doc_id % 3 = 0")
    noise = docs.filter("doc_id % 3 = 1").withColumn("text", F.concat("text", F.lit(" the the the")))
    scoped = allowed.unionByName(noise).join(allowed.select("doc_id"), "doc_id", "left_semi")
    assert rows(retrieval.bm25(scoped, asked)) == rows(retrieval.bm25(allowed, asked))
    assert retrieval.bm25(docs.filter("false"), asked).count() == 0


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = spark.createDataFrame([(1, "the of and that")], "query_id long, text string")
    assert rows(retrieval.bm25(docs.repartition(7), asked)) == rows(retrieval.bm25(docs.orderBy(F.desc("doc_id")), asked))


def test_dense_blocks_agree(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    assert rows(retrieval.dense(e, asked, lane=5)) == rows(retrieval.dense(e.repartition(3), asked, lane=5, block=3))
    first = retrieval.dense(e, asked, lane=1)
    assert first.filter("abs(score - 1) > 1e-6").count() == 0


def test_windows_cover_every_word(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, "one"), (3, ""), (4, None)], "doc_id long, text string")
    p = retrieval.passages(docs, size=160, overlap=32)
    spans = [(r.word_start, r.word_end) for r in p.filter("doc_id = 1").orderBy("seq").collect()]
    assert spans == [(0, 160), (128, 288), (256, 416), (384, 500)]
    assert p.filter("doc_id > 1").count() == 1


def test_overlaps_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    spans = [(b, s, s + rng.randrange(1, 40)) for b in range(3) for s in (rng.randrange(200) for _ in range(40))]
    got = {tuple(r) for r in retrieval.overlapping(spark.createDataFrame(spans, "block long, start long, end long")).collect()}
    want = set()
    for x in spans:
        for y in spans:
            if x[0] == y[0] and x[1:] < y[1:]:
                shared = max(0, min(x[2], y[2]) - max(x[1], y[1]))
                if shared >= 0.65 * min(x[2] - x[1], y[2] - y[1]):
                    want.add((x[0], *x[1:], *y[1:], shared))
    assert got == want


def test_closure_ends_at_its_limit_and_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert rows(graph.closure(spark, seeds, edges, 9)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
    assert rows(graph.closure(spark, seeds, edges, 1)) == [(1, 1, 0), (1, 2, 1)]


def test_expired_leases_are_free(spark):
    items = spark.createDataFrame([(1, 1, "claimed", 5), (1, 2, "queued", None), (2, 3, "claimed", 10), (3, 4, "done", None)], "run long, item long, status string, lease_until long")
    assert [(r.run, r.item) for r in ledger.claim_next(items, "run", F.lit(10), ["item"]).orderBy("run").collect()] == [(1, 1)]
