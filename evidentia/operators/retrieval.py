"""Retrieval: passages, BM25 and dense lanes, reciprocal-rank fusion, and the ordering of evidence.

Statistics are always those of the rows handed in, so an authorization semi-join comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import file_system, materialized

#: Fixed values of the ranking formulas.
K1, B, RRF_K, LANE = 1.2, 0.75, 60, 128
#: Query vectors of a block, vectors of a slab, and scores that a task computes at once.
QUERY_BLOCK, SLAB, SCORES = 4096, 1 << 15, 1 << 20


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 160, overlap: int = 32) -> DataFrame:
    """Word windows: doc_id, seq, word_start, word_end and passage_text (words joined by blanks)."""
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.ceil((F.size(w) - overlap) / step).cast("int") - 1
        one = lambda k: F.struct(k.cast("long").alias("seq"), (k * step).cast("long").alias("word_start"), F.least(k * step + size, F.size(w)).cast("long").alias("word_end"), F.array_join(F.slice(w, k * step + 1, F.lit(size)), " ").alias("passage_text"))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), one))

    # the words of a text are taken once, and its windows cut before they become rows, which need not carry all words
    cut = F.transform(F.array(t.words(F.col(text))), windows)[0]
    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(cut))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(t.words(F.col(text)))).alias("term"))


def scored_terms(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored tables: (doc_id, own: the query terms that a document has with their parts of a score), and (query_id, term, most).

    Texts are tokenised once: each gives its terms and a mark (the empty term), so that one aggregation has the
    frequencies of the queries' terms and the lengths of all documents; it is a table of its own, which the document
    frequencies, the mean length and the parts read. Terms are a semi-join, not a broadcast by hand. `most` is the largest
    part that any document has of a term.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").unionByName(queries.sparkSession.sql("SELECT '' AS term")).distinct()
    w = docs.select(F.col(doc_id).alias("doc_id"), t.words(F.col(text)).alias("w"))
    rows = w.select("doc_id", F.size("w").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term")).join(wanted, "term", "left_semi")
    tf = materialized(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")), "postings")
    df = tf.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    stats = tf.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    weighted = tf.filter("term <> ''").join(df, "term").crossJoin(F.broadcast(stats))  # one row
    average = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    own = materialized(weighted.groupBy("doc_id").agg(F.collect_list(F.struct("term", part.alias("part"))).alias("own")), "parts")
    most = own.select(F.inline("own")).groupBy("term").agg(F.max("part").alias("most"))
    return own, materialized(terms.join(most, "term").select("query_id", "term", "most"), "terms")


def _parts(own: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): what the terms (query_id, term) add to the score of every document that has one."""
    return own.select("doc_id", F.inline("own")).join(terms.select("query_id", "term"), "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def lexical_candidates(own: DataFrame, terms: DataFrame, lane: int) -> DataFrame:
    """(query_id, doc_id, score, rest): the documents that can be among a query's best `lane`, scored but for the terms `rest`.

    A sample of documents, scored in full, gives each query a floor that its last place cannot fall below. Terms whose
    largest parts together stay below the floor, the common ones, cannot bring a document in by themselves: only the
    others make candidates, and of these go on those that all of the rest could lift to the floor.
    """
    # a sixteenth at least, of large tables as few as give a lane 64 times over
    share = min(256, max(16, own.count() // (64 * lane)))
    tried = _parts(own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), terms)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = tried.withColumn("nth", nth).filter(F.col("nth") == lane).select("query_id", (F.col("score") - 1e-6).alias("floor"))
    w = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = terms.join(floor, "query_id", "left").withColumn("rest", F.coalesce(F.sum("most").over(w) < F.col("floor"), F.lit(False)))
    split = materialized(split, "split")
    plan = split.groupBy("query_id").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("rest"), F.col("most"))), F.lit(0.0)).alias("more"), F.collect_list(F.when(F.col("rest"), F.col("term"))).alias("rest"))
    found = _parts(own, split.filter("not rest"))
    return found.join(plan, "query_id").filter(F.col("floor").isNull() | (F.col("score") + F.col("more") >= F.col("floor"))).select("query_id", "doc_id", "score", "rest")


def lexical_lane(own: DataFrame, terms: DataFrame, lane: int, block: int = 256, slab: int = 1 << 14) -> DataFrame:
    """(query_id, doc_id, score): for each slab of documents the best `lane` of every query; own and terms as by `scored_terms`.

    Queries are a stored table of their terms, of which a task reads one block after the other for each slab: documents by
    terms times terms by queries is one matrix product, a few documents at a time. So no pair of a query and a document is
    shuffled but for these, however many terms the two share.
    """
    asked = materialized(terms.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "asked")
    files, kind = asked.inputFiles(), dict(own.dtypes)["doc_id"]
    plain = own.filter("doc_id is not null").select("doc_id", F.transform("own", lambda x: x["term"]).alias("term"), F.transform("own", lambda x: x["part"]).alias("part"))
    ids = asked.schema["query_id"].dataType.simpleString()

    def blocks():
        import pyarrow.parquet as pq

        for file in files:
            system, path = file_system(file)
            with system.open_input_file(path) as f:
                for part in pq.ParquetFile(f).iter_batches(block):
                    if part.num_rows:
                        yield part.column(0), part.column(1)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, rows = [], 0

        def found():
            names = pa.concat_arrays([b.column(0) for b in held])
            lists = pa.concat_arrays([b.column(1) for b in held])
            flat, parts = lists.flatten(), pa.concat_arrays([b.column(2) for b in held]).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            # ties fall to the smaller key
            order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            for query, own_terms in blocks():
                words = own_terms.flatten()
                known = pc.unique(words)
                column = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                has = np.zeros((len(known), len(query)))
                has[pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False), pc.list_parent_indices(own_terms).to_numpy(zero_copy_only=False)] = 1.0
                score = np.empty((len(names), len(query)))
                step = max(1, SCORES // len(known))
                for a in range(0, len(names), step):
                    b = min(len(names), a + step)
                    x, y = ends[a - 1] if a else 0, ends[b - 1]
                    mine = np.flatnonzero(column[x:y] >= 0) + x
                    weights = np.zeros((b - a, len(known)))
                    weights[np.searchsorted(ends, mine, "right") - a, column[mine]] = parts[mine]
                    score[place[a:b]] = weights @ has
                hit = score > 0
                score = np.round(score, 9)
                score[~hit] = -1.0
                for q in range(len(query)):
                    own = score[:, q]
                    d = np.flatnonzero(own >= 0)
                    if len(d) > lane:
                        # what reaches the lane-th score, ties included
                        d = d[own[d] >= np.partition(own[d], -lane)[-lane]]
                    d = d[np.argsort(-own[d], kind="stable")][:lane]
                    yield pa.RecordBatch.from_arrays([query.take(pa.array(np.full(len(d), q))), names.take(pa.array(order[d])), pa.array(own[d], pa.float64())], names=["query_id", "doc_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= slab:
                yield from found()
                held, rows = [], 0
        if rows:
            yield from found()

    return plain.mapInArrow(run, f"query_id {ids}, doc_id {kind}, score double")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", lane: int = LANE, small: int = 16) -> DataFrame:
    """The lexical lane: query_id, doc_id, score and rank, the best `lane` documents of each query.

    Of `small` times a lane of documents or fewer all are joined with the queries, which spares starting Python; the result
    is the same either way.
    """
    own, terms = scored_terms(docs, queries, doc_id, text)
    if own.count() <= small * lane:
        return ranked(_parts(own, terms).withColumn("score", F.round("score", 9)), "doc_id", lane)
    return ranked(lexical_lane(own, terms, lane), "doc_id", lane)


def ranked(scores: DataFrame, key: str, lane: int) -> DataFrame:
    """Adds rank: by score downwards, then key; the best `lane` of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= lane)


def dense(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", lane: int = LANE, block: int = QUERY_BLOCK) -> DataFrame:
    """The dense lane, exact: query_id, vec_id, score, rank. `queries` has query_id and embedding.

    Queries are a stored table, of which a task reads one block of `block` vectors after the other for each slab of its
    vectors: one matrix product for each pair, of which the best `lane` of each query go on. So one scan of the vectors
    serves any number of queries, and none passes through the driver.
    """
    asked = materialized(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    key = own.schema["vec_id"].dataType.simpleString()
    files = asked.inputFiles()

    def blocks():
        import pyarrow.parquet as pq

        for file in files:
            system, path = file_system(file)
            with system.open_input_file(path) as f:
                for part in pq.ParquetFile(f).iter_batches(block):
                    if part.num_rows:
                        yield part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, rows = [], 0

        def found():
            names = pa.concat_arrays([b.column(0) for b in held])
            order = np.argsort(np.array(names.to_pylist(), object), kind="stable") if len(names) else np.zeros(0, np.int64)
            every = np.concatenate([_matrix(b.column(1)) for b in held])[order]
            step = max(1, SCORES // len(every))
            for ids, asked_ in blocks():
                for a in range(0, len(ids), step):
                    score = np.round(asked_[a : a + step] @ every.T, 9)
                    if score.shape[1] > lane:
                        # what reaches the lane-th score of its query, ties included
                        q, v = np.nonzero(score >= np.partition(score, -lane, axis=1)[:, -lane, None])
                    else:
                        q, v = np.indices(score.shape).reshape(2, -1)
                    s = score[q, v]
                    # ties fall to the smaller key: vectors are in the order of their keys
                    order_ = np.lexsort((v, -s, q))
                    q, v, s = q[order_], v[order_], s[order_]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < lane
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + q[best]], pa.int64()), names.take(pa.array(order[v[best]], pa.int64())), pa.array(s[best])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SLAB:
                yield from found()
                held, rows = [], 0
        if rows:
            yield from found()

    out = own.mapInArrow(run, f"query_id long, vec_id {key}, score double")
    return ranked(out, "vec_id", lane)


def _matrix(column):
    """An Arrow list column of vectors of one length as rows."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1))


def fuse(lanes: list[DataFrame], limit: int = LANE, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lanes (query_id, key, rank): query_id, key, score, rank, n_lanes."""
    every = lanes[0]
    for x in lanes[1:]:
        every = every.unionByName(x)
    scores = every.groupBy("query_id", "key").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.count("*").alias("n_lanes"))
    return ranked(scores.withColumn("score", F.round("score", 9)), "key", limit)


def search(passages: DataFrame, queries: DataFrame, encode: Callable[[Column], Column] | None = None, limit: int = 32, k: int = RRF_K) -> DataFrame:
    """Hybrid search over passages (key, text; only those that the asker may see) for the query variants of each question.

    queries: question, query_id (one for each variant) and text. A lexical lane for every variant and, with an encoder,
    a dense one; every rank adds 1 / (k + rank) to its passage's score for the question. The best `limit` passages of a
    question: question, key, score, rank and evidence (query_id, lexical_rank, lexical_score, dense_rank, dense_score of
    the variants that found it). `encode` makes a unit vector (array<double>) of a text column; without one, or where it
    is not to be had, the lexical lane stands alone.
    """
    asked = queries.select("query_id", "text")
    lexical = bm25(passages, asked, "key").select("query_id", F.col("doc_id").alias("key"), F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    none = [F.lit(None).cast("long").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score")]
    if encode is None:
        found = lexical.select("*", *none)
    else:
        vectors = passages.select("key", encode(F.col("text")).alias("embedding"))
        near = dense(vectors, asked.select("query_id", encode(F.col("text")).alias("embedding")), "key")
        near = near.select("query_id", F.col("vec_id").alias("key"), F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
        found = lexical.join(near, ["query_id", "key"], "full")
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    found = found.join(queries.select("question", "query_id"), "query_id").withColumn("part", one("lexical_rank") + one("dense_rank"))
    evidence = F.sort_array(F.collect_list(F.struct("query_id", "lexical_rank", "lexical_score", "dense_rank", "dense_score")))
    g = found.groupBy("question", "key").agg(F.round(F.sum("part"), 9).alias("score"), evidence.alias("evidence"))
    w = Window.partitionBy("question").orderBy(F.desc("score"), "key")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def neighbours(passages: DataFrame, row: Column) -> DataFrame:
    """`passages` with near: the `row` structs of the passages that give one its context, nearest first.

    passages: key, doc, block (an ordinal), section (null: none), kind and seq (a passage's place in its block). Near are
    the passages before and after it in its block, the last one of the block before and the first one of the block after,
    these where they are of the same section or a table's header.
    """
    own = passages.withColumn("_row", row)
    w = Window.partitionBy("doc", "block").orderBy("seq")
    own = own.withColumns({"_before": F.lag("_row").over(w), "_after": F.lead("_row").over(w)})
    edges = passages.withColumn("_row", row).groupBy("doc", "block").agg(F.min_by("_row", "seq").alias("first"), F.max_by("_row", "seq").alias("last"), F.first("section").alias("section"), F.first("kind").alias("kind"))
    b = Window.partitionBy("doc").orderBy("block")

    def beside(step, edge: str) -> Column:
        fits = F.col("section").eqNullSafe(step("section").over(b)) | (step("kind").over(b) == "table_header")
        return F.when(fits, step(edge).over(b))

    links = edges.select("doc", "block", beside(F.lag, "last").alias("_previous"), beside(F.lead, "first").alias("_next"))
    near = F.array_compact(F.array("_before", "_after", "_previous", "_next"))
    return own.join(links, ["doc", "block"]).withColumn("near", near).drop("_row", "_before", "_after", "_previous", "_next")


def letter_vector(size: int = 16) -> Callable[[Column], Column]:
    """An encoder without a model, for fixtures: how many words have each length (modulo `size`), plus 0.2, as a unit vector."""

    def encode(text: Column) -> Column:
        # the words are taken once, as one character for each word's length; every count reads that
        lengths = F.array_join(F.transform(t.words(text), lambda w: F.char(F.lit(48) + F.char_length(w) % size)), "")
        count = lambda v, k: (F.char_length(v) - F.char_length(F.replace(v, F.lit(chr(48 + k)), F.lit("")))) + 0.2
        counts = F.transform(F.array(lengths), lambda v: F.array(*[count(v, k) for k in range(size)]))
        normed = F.transform(counts, lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)).alias("n")))
        return F.transform(normed, lambda x: F.transform(x["v"], lambda c: c / x["n"]))[0]

    return encode


def lane_checks(vectors: DataFrame, size: int, embedding: str = "embedding") -> DataFrame:
    """`vectors` with `ok`: right size, finite, of unit length within 2e-3."""
    e = F.col(embedding).cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v))
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.withColumn("ok", F.coalesce((F.size(e) == size) & finite & (F.abs(norm - 1) <= 0.002), F.lit(False)))


def diversified(hits: DataFrame, group: str, weight: float = 0.12) -> DataFrame:
    """Re-ranks hits of a query with a penalty for each better hit of the same group."""
    nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank")) - 1
    new = hits.withColumn("adjusted", F.round(F.col("score") / (1 + weight * nth), 9))
    return new.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted"), "rank")).cast("long"))


def overlapping(spans: DataFrame, least: float = 0.65) -> DataFrame:
    """Pairs of spans of a block that share `least` of the shorter one: block, a_start, a_end, b_start, b_end, shared.

    Spans meet by length class (the power of two above the length) in buckets of that width: a span visits the buckets of
    its own class that it touches, three at most, and one bucket of every longer class for each end. So one long span
    makes no block all-pairs.
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    s = spans.select("block", "start", "end").distinct().withColumn("class", F.ceil(F.log2(length)).cast("int"))
    classes = s.groupBy("block").agg(F.collect_set("class").alias("classes"))
    width = lambda c: F.pow(F.lit(2), c)
    bucket = lambda v, c: F.floor(v / width(c)).cast("long")
    own = s.select("*", F.explode(F.sequence(bucket(F.col("start"), F.col("class")), bucket(F.greatest(F.col("end") - 1, F.col("start")), F.col("class")))).alias("bucket"))
    asked = s.join(classes, "block").select("block", "start", "end", F.col("class").alias("own_class"), F.explode("classes").alias("class")).filter("class >= own_class")
    ends = F.array_distinct(F.array(bucket(F.col("start"), F.col("class")), bucket(F.greatest(F.col("end") - 1, F.col("start")), F.col("class"))))
    asked = asked.select("block", F.col("start").alias("s2"), F.col("end").alias("e2"), "class", F.explode(ends).alias("bucket"))
    met = own.join(asked, ["block", "class", "bucket"]).filter("start <> s2 or end <> e2").select("block", "start", "end", "s2", "e2").distinct()
    first = F.struct("start", "end") < F.struct(F.col("s2"), F.col("e2"))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    met = met.select("block", pick("start", "s2").alias("a_start"), pick("end", "e2").alias("a_end"), pick("s2", "start").alias("b_start"), pick("e2", "end").alias("b_end")).distinct()
    shared = F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return met.withColumn("shared", shared).filter(F.col("shared") >= least * shorter)


def fitting_prefix(rows: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


def match_documents(docs: DataFrame, tokens: list[str], mode: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and n_matched of documents that hold all, any or the phrase of `tokens` (at most 64)."""
    wanted = list(dict.fromkeys(tokens))[:64]
    w = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(t.PART), F.lit(0)).alias("w"))
    if mode == "phrase":
        phrase = " " + " ".join(tokens[:64]) + " "
        hit = F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.lit(phrase))
        return w.filter(hit).select("doc_id", F.lit(len(wanted)).cast("long").alias("n_matched"))
    n = F.size(F.array_intersect("w", F.array(*map(F.lit, wanted)))).cast("long")
    return w.select("doc_id", n.alias("n_matched")).filter(F.col("n_matched") >= (len(wanted) if mode == "all" else 1))
