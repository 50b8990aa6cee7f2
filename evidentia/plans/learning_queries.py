"""Queries over learnt policies, evaluation and the checks of answers. Labels of `embeddings` are actions, users policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import answers as a
from ..operators import learning as g
from .registry import query

_N = 16


def _rows(x):
    """Sixteen features and a reward (the seventeenth coordinate) of each vector."""
    e = F.col("embedding").cast("array<double>")
    return x.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.slice(e, 1, _N).alias("x"), F.get(e, F.lit(_N)).alias("y"))


_ROWS = f"r AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[])[1:{_N}] AS x, CAST(embedding AS DOUBLE[])[{_N + 1}] AS y FROM embeddings)"
_MOMENTS = f"""{_ROWS}, ij AS (SELECT i, j FROM (SELECT unnest(generate_series(1, {_N})) AS i), (SELECT unnest(generate_series(1, {_N})) AS j)),
m AS (SELECT label, i, j, sum(x[i] * x[j]) + max(CASE WHEN i = j THEN 1 ELSE 0 END) AS v FROM r, ij GROUP BY ALL)"""


@query("A32", f"WITH {_MOMENTS} SELECT label, i, j, round(v, 6) AS moment FROM m")
def ridge_moments(x):
    """The regularized second moments of sixteen features by action."""
    m = g.moments(_rows(x), "label", "x", "y", _N)
    rows = m.select("label", F.posexplode("a").alias("i", "row")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.posexplode("row").alias("j", "v"))
    return rows.select("label", "i", (F.col("j") + 1).cast("long").alias("j"), F.round("v", 6).alias("moment"))


@query("A32", f"""WITH {_MOMENTS}, b AS (SELECT label, i, sum(x[i] * y) AS b FROM r, (SELECT unnest(generate_series(1, {_N})) AS i) GROUP BY ALL)
SELECT label, i, round(b, 6) AS right_side, true AS solves FROM b""")
def ridge_solution(x):
    """Whether the weights of each action solve its normal equations, row by row: (A w) next to b."""
    m = g.moments(_rows(x), "label", "x", "y", _N)
    s = m.join(g.solved(m, "label").select("label", "weights"), "label")
    left = F.transform("a", lambda row: g.dot(row, F.col("weights")))
    rows = s.select("label", F.posexplode(F.arrays_zip(left.alias("l"), F.col("b"))).alias("i", "v"))
    return rows.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("v.b", 6).alias("right_side"), (F.abs(F.col("v.l") - F.col("v.b")) < 1e-6).alias("solves"))


@query("M7 W18 C33 M8", f"""WITH {_MOMENTS}, w AS (SELECT label, list(avg ORDER BY i) AS w FROM (SELECT label, i, avg(x[i]) AS avg FROM r, (SELECT unnest(generate_series(1, {_N})) AS i) GROUP BY ALL) GROUP BY label),
q AS (SELECT vec_id, r.label, sum(x[i] * x[j] * v) AS q FROM r JOIN m USING (label) GROUP BY ALL),
s AS (SELECT vec_id, label, round(list_dot_product(w, x) + 0.5 * sqrt(greatest(0, q)), 6) AS score FROM r JOIN w USING (label) JOIN q USING (vec_id, label))
SELECT vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank, round(1 / (1 + exp(-score)), 6) AS probability FROM s""")
def action_scores(x):
    """Upper-confidence scores: the mean features of an action as weights, its second moments as spread; ranks and a probability."""
    rows = _rows(x)
    mean = rows.groupBy("label").agg(*[F.avg(F.get("x", F.lit(i))).alias(f"w{i}") for i in range(_N)]).select("label", F.array(*[f"w{i}" for i in range(_N)]).alias("w"))
    s = rows.join(mean, "label").join(g.moments(rows, "label", "x", "y", _N).select("label", "a"), "label")
    s = s.withColumn("score", F.round(g.upper_score(F.col("x"), F.col("w"), F.col("a"), 0.5), 6))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")).cast("long")
    return s.select("vec_id", "score", rank.alias("rank"), F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("probability"))


_STAGES = ["F", "O", "P"]


@query("C33 A25", """
WITH o AS (SELECT o_custkey AS run, max_by(o_orderstatus, o_orderkey) AS stage, count(*) AS n, count(DISTINCT o_orderpriority) AS facets, count(*) FILTER (o_orderstatus = 'F') AS done, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cost FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey AS run, count(*) AS blocks, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (l_returnflag = 'R') AS returned, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT run, list_transform([1.0, CASE WHEN stage = 'F' THEN 1 ELSE 0 END, CASE WHEN stage = 'O' THEN 1 ELSE 0 END, CASE WHEN stage = 'P' THEN 1 ELSE 0 END, n / 20.0, facets / 5.0, done / greatest(1.0, n), CAST(cost AS DOUBLE) / 500000000.0, coalesce(blocks, 0) / 100.0, coalesce(parts, 0) / greatest(1.0, coalesce(blocks, 0)),
  coalesce(sources, 0) / 50.0, coalesce(returned, 0) / greatest(1.0, coalesce(blocks, 0)), coalesce(quantity, 0) / 3000.0], lambda v: round(least(1.0, greatest(0.0, CAST(v AS DOUBLE))), 6)) AS features, true AS valid FROM o LEFT JOIN l USING (run)""")
def state_features(x):
    """A run's state as features: its stage and nine clamped fractions."""
    o = x.orders.groupBy(F.col("o_custkey").alias("run")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("stage"), F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("facets"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cost"),
    )
    l = x.lineitem.join(x.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run")), "l_orderkey").groupBy("run").agg(
        F.count("*").alias("blocks"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("sources"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("quantity"),
    )
    j = o.join(l, "run", "left").fillna(0, ["blocks", "parts", "sources", "returned", "quantity"])
    part = lambda p, w: g.fraction(F.col(p), F.lit(w) if not isinstance(w, str) else F.col(w))
    nine = [part("n", 20), part("facets", 5), part("done", "n"), part("cost", 500_000_000), part("blocks", 100), part("parts", "blocks"), part("sources", 50), part("returned", "blocks"), part("quantity", 3000)]
    f = g.encoded(F.col("stage"), _STAGES, nine)
    return j.select("run", F.transform(f, lambda v: g.rounded(v, 6)).alias("features"), g.valid_context(f, 13).alias("valid"))


@query("RL6", """
WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'candidate' WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'rollback' ELSE 'other' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(user_id, n, state, version) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'none', CAST(0 AS BIGINT) FROM e UNION ALL
  SELECT e.user_id, e.n, CASE WHEN k = 'candidate' AND state <> 'promoted' THEN 'candidate' WHEN k = 'promote' AND state = 'candidate' THEN 'promoted' WHEN k = 'rollback' AND state = 'promoted' THEN 'rolled_back' ELSE state END,
    version + CASE WHEN (k = 'candidate' AND state <> 'promoted') OR (k = 'promote' AND state = 'candidate') OR (k = 'rollback' AND state = 'promoted') THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, arg_max(state, n) AS state, max(version) AS version FROM w GROUP BY user_id""")
def policy_states(x):
    """Where each policy stands after its candidates, promotions and rollbacks."""
    kind = F.when(F.col("event_type") == "signup", "candidate").when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "error", "rollback").otherwise("other")
    return g.policy_states(x.events.select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind")


@query("SK9", """
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sha256('{' || string_agg('"' || event_type || '": ' || n, ', ' ORDER BY event_type) || '}') AS export_sha, count(*) FILTER (event_type <> 'error') AS after_reset FROM s GROUP BY user_id""")
def policy_exports(x):
    """Each policy's counts as one JSON text, and how many entries stay after a reset of its failures."""
    s = x.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("event_type", "n"))), lambda v: F.concat(F.lit('"'), v["event_type"], F.lit('": '), v["n"].cast("string")))
    g_ = s.groupBy("user_id").agg(F.array_join(own, ", ").alias("j"), F.count_if(F.col("event_type") != "error").alias("after_reset"))
    return g_.select("user_id", F.sha2(F.concat(F.lit("{"), "j", F.lit("}")).cast("binary"), 256).alias("export_sha"), "after_reset")


@query("A30 C3", """
WITH c AS (SELECT user_id AS run, event_id, CAST(floor(value) AS BIGINT) AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ms, event_type = 'error' AS failed FROM events),
d AS (SELECT run, max_by(ms, event_id) % 3 AS off FROM c GROUP BY run)
SELECT run, count(*) AS calls, count(DISTINCT event_id) = count(*) AS distinct_ids, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / (sum(ms) / 1000.0), 6) AS per_second, count(*) FILTER (failed) AS failures, off = 0 AS consistent FROM c JOIN d USING (run) GROUP BY run, off""")
def call_totals(x):
    """Totals of each run recomputed from its calls, beside what it declared (a third of them right)."""
    c = x.events.select(F.col("user_id").alias("run"), "event_id", F.floor("value").alias("tokens"), F.get_json_object("props", "$.k").cast("long").alias("ms"), (F.col("event_type") == "error").alias("failed"))
    own = c.groupBy("run").agg(F.count("*").alias("calls"), (F.countDistinct("event_id") == F.count("*")).alias("distinct_ids"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), F.count_if("failed").alias("failures"), (F.max_by("ms", "event_id") % 3).alias("off"))
    declared = own.select("run", (F.col("tokens") + F.col("off")).alias("declared"))
    return own.join(declared, "run").select("run", "calls", "distinct_ids", "tokens", F.round(F.col("tokens") / (F.col("ms") / 1000), 6).alias("per_second"), "failures", (F.col("tokens") == F.col("declared")).alias("consistent"))


_CASES = """
c AS (SELECT item_id AS case_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1] AS first_word, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[2] AS second_word, CASE WHEN item_id % 4 = 0 THEN 'not_found' ELSE 'answer' END AS expected FROM benchmark),
s AS (SELECT l_orderkey AS case_id, list(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_orderkey),
r AS (SELECT doc_id AS case_id, text, CASE WHEN doc_id % 5 = 0 THEN 'not_found' ELSE 'answer' END AS status FROM documents)"""


@query("K10 A27 J28 S4 C35", f"""WITH {_CASES}
SELECT c.case_id, r.case_id IS NULL AS missing, coalesce(status = expected, false) AS status_ok, coalesce(contains(lower(text), first_word), false) AS phrases_ok, coalesce(NOT contains(lower(text), second_word || ' ' || second_word), false) AS forbidden_ok,
  coalesce(len(list_filter(coalesce(sources, []), lambda v: v % 10 = c.case_id % 10)) > 0, false) AS required_ok, coalesce(len(list_filter(coalesce(sources, []), lambda v: v % 13 = 0)) = 0, true) AS sources_ok, len(coalesce(sources, [])) <= 4 AS cap_ok,
  coalesce(NOT contains(text, 'src' || (c.case_id % 9)), false) AS leak_ok FROM c LEFT JOIN r USING (case_id) LEFT JOIN s USING (case_id)""")
def case_scores(x):
    """Every case against its answer: status, phrases that must and must not be there, sources, their number, leaks."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(t.PART), F.lit(0))
    c = x.benchmark.select(F.col("item_id").alias("case_id"), F.array(w[0]).alias("required"), F.array(F.concat(w[1], F.lit(" "), w[1])).alias("forbidden"), F.when(F.col("item_id") % 4 == 0, "not_found").otherwise("answer").alias("expected"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 9).cast("string"))).alias("secrets"), F.lit(4).alias("most"))
    r = x.documents.select(F.col("doc_id").alias("case_id"), "text", F.when(F.col("doc_id") % 5 == 0, "not_found").otherwise("answer").alias("status"))
    s = x.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_suppkey").alias("sources"))
    return a.case_scores(c, r.join(s, "case_id", "left"), lambda v, case: v % 10 == case % 10, lambda v, case: v % 13 == 0)


@query("J24 J22 J30 C9", r"""
WITH b AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS block FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id AS cite, CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc, 0 AS ordinal, CASE WHEN doc_id % 13 = 0 THEN 100000 ELSE 0 END AS s, CASE WHEN doc_id % 13 = 0 THEN 100010 ELSE least(10, length(block)) END AS e, CASE WHEN doc_id % 7 = 0 THEN 'x' || substr(block, 1, 9) ELSE substr(block, 1, 10) END AS quote FROM b WHERE block <> '')
SELECT cite, CASE WHEN b.doc_id IS NULL THEN 'unknown block' WHEN e > length(block) OR e <= s THEN 'outside' WHEN substr(block, s + 1, e - s) <> quote THEN 'text differs' ELSE 'ok' END AS verdict FROM q LEFT JOIN b ON b.doc_id = q.doc""")
def citation_binding(x):
    """Citations against the blocks that they name: the block must exist, the span lie inside, the text be the same."""
    blocks = x.documents.filter("text is not null").select(F.col("doc_id").alias("doc"), F.lit(0).alias("ordinal"), F.trim(F.split("text", "\n")[0]).alias("block_text"))
    k, far = F.col("doc"), F.col("doc") % 13 == 0
    n = F.least(F.lit(10), F.char_length("block_text"))
    quote = F.when(k % 7 == 0, F.concat(F.lit("x"), F.substring("block_text", 1, 9))).otherwise(F.substring("block_text", 1, 10))
    cites = blocks.filter("block_text <> ''").select(k.alias("cite"), F.when(k % 11 == 0, -k - 1).otherwise(k).alias("doc"), "ordinal", F.when(far, 100000).otherwise(0).alias("start"), F.when(far, 100010).otherwise(n).alias("end"), quote.alias("quote"))
    return a.bound_citations(cites, blocks).select("cite", "verdict")


@query("S7 A16", """
WITH c AS (SELECT l_orderkey AS draft, l_linenumber AS n, l_partkey % 6 AS facet, l_returnflag AS side, l_quantity > 45 AS flagged, l_suppkey FROM lineitem),
g AS (SELECT draft, side, n, facet, bool_or(flagged) AS flagged, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS sources FROM c GROUP BY ALL)
SELECT DISTINCT draft, facet, sources FROM g o WHERE side = 'R' AND NOT flagged AND NOT EXISTS (SELECT 1 FROM g x WHERE x.draft = o.draft AND x.side = 'N' AND x.facet = o.facet AND x.sources = o.sources)""")
def retention_omissions(x):
    """Claims of an old draft, by facet and sources, that nobody flagged and the new draft lacks."""
    c = x.lineitem.groupBy(F.col("l_orderkey").alias("draft"), F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 6).alias("facet")).agg(F.bool_or(F.col("l_quantity") > 45).alias("flagged"), F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("sources"))
    return a.omitted(c.filter("side = 'R'"), c.filter("side = 'N'"), "draft", ["facet", "sources"]).select("draft", "facet", "sources")


@query("H2 H5", """
SELECT doc_id, sha256('["' || source || '", "' || lang || '", []]') AS record_sha, sha256('{"doc": ' || doc_id || ', "lang": "' || lang || '", "source": "' || source || '"}') AS draft_sha FROM documents""")
def canonical_hashes(x):
    """Digests of records as canonical JSON: a list, and an object with sorted keys."""
    text = lambda c: t.json_text(F.col(c))
    row = F.concat(F.lit("["), F.concat_ws(", ", text("source"), text("lang"), F.lit("[]")), F.lit("]"))
    return x.documents.select("doc_id", F.sha2(row.cast("binary"), 256).alias("record_sha"), t.canonical_digest({"source": text("source"), "lang": text("lang"), "doc": F.col("doc_id")}).alias("draft_sha"))


@query("T5", """
WITH e AS (SELECT event_id, value AS now, 60.0 + value % 7 AS deadline, 2.0 + value % 5 AS least, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS packets, value + 10 + value % 11 AS soft FROM events), r AS (SELECT *, greatest(0.0, deadline - now) AS remaining FROM e)
SELECT event_id, round(least(deadline, now + least(remaining, greatest(1.5 * r.least, 15.0), greatest(1.5 * r.least, remaining * 0.2))), 6) AS cutoff,
  round(CASE WHEN deadline - now < r.least THEN 0 WHEN packets > 0 AND soft - now < r.least THEN 0 ELSE least(deadline - now, greatest(r.least, soft - now)) END, 6) AS reader_window FROM r""".replace("least(deadline, now + least(remaining", "least(deadline, now + least(remaining"))
def time_windows(x):
    """How long screening may take, and a reader's window within the soft and the hard cutoff."""
    v = F.col("value")
    e = x.events.select("event_id", v.alias("now"), (60.0 + v % 7).alias("deadline"), (2.0 + v % 5).alias("need"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("packets"), (v + 10 + v % 11).alias("soft"))
    return e.select("event_id", F.round(a.screening_cutoff(F.col("now"), F.col("deadline"), F.col("need")), 6).alias("cutoff"), F.round(a.reader_window(F.col("now"), F.col("deadline"), F.col("soft"), F.col("need"), F.col("packets")), 6).alias("reader_window"))


@query("C19 C20 C38", """
WITH d AS (SELECT l_orderkey AS run, l_linenumber AS n, l_partkey % 3 AS screened, l_quantity > 10 AS done, l_suppkey % 9 = 0 AS warned FROM lineitem),
r AS (SELECT run, count(*) AS planned, bool_and(screened = 2) AS all_unlikely, bool_and(done) AS all_done, count(*) FILTER (NOT done) AS remaining, bool_or(warned AND done) AS gaps FROM d GROUP BY run)
SELECT run, all_unlikely, all_done AND run % 4 <> 0 AS complete, concat_ws(' ', CASE WHEN gaps THEN 'extraction' END, CASE WHEN remaining > 0 AND run % 2 = 0 THEN 'window:' || remaining WHEN run % 4 = 0 THEN 'catalogue' END, CASE WHEN run % 6 = 0 THEN 'errors' END) AS notes FROM r""")
def research_ends(x):
    """Whether a run's candidates were all unlikely, whether its research is complete, and what its readers are told."""
    d = x.lineitem.select(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 3 == 2).alias("unlikely"), (F.col("l_quantity") > 10).alias("done"), (F.col("l_suppkey") % 9 == 0).alias("warned"))
    k = F.col("run")
    return a.research_ends(d, "run", k % 2 == 0, k % 4 == 0, k % 6 == 0)


@query("C26", """
SELECT o_custkey AS answer, string_agg('- ' || o_orderpriority || ' [E:' || o_orderkey || ']', chr(10) ORDER BY o_orderkey) AS lines FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
UNION ALL SELECT o_custkey, string_agg('order ' || o_orderkey || ': ' || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0""")
def fallback_answers(x):
    """An answer without a model: the cards of evidence as lines, or without any card the proposed answers."""
    card = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("- "), "o_orderpriority", F.lit(" [E:"), F.col("o_orderkey").cast("string"), F.lit("]")))
    plain = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(": "), "o_orderpriority")
    listed = lambda c: F.filter(F.sort_array(F.collect_list(F.struct("o_orderkey", c.alias("v")))), lambda r: r["v"].isNotNull())["v"]
    g_ = x.orders.groupBy(F.col("o_custkey").alias("answer")).agg(listed(card).alias("cards"), listed(plain).alias("plain"))
    return g_.select("answer", F.when(F.size("cards") > 0, F.array_join("cards", "\n")).otherwise(F.array_join("plain", "\n\n")).alias("lines"))


@query("W10 W11 W12", r"""
WITH c AS (SELECT doc_id, lang = 'en' AS prior, source IN ('src1', 'src2') AS exact, len(regexp_extract_all(text, '[0-9]+')) AS spec, len(regexp_extract_all(lower(text), '\bthe\b')) AS occurrences FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN prior THEN 0 WHEN exact THEN 1 ELSE 2 END AS class, -0.75 * CASE WHEN prior THEN 1 ELSE 0 END - 0.5 * CASE WHEN exact THEN 1 ELSE 0 END AS semantic FROM c),
a AS (SELECT *, row_number() OVER (ORDER BY class, spec DESC, doc_id) AS admitted FROM k)
SELECT doc_id, admitted, row_number() OVER (ORDER BY semantic, spec DESC, occurrences DESC, doc_id) AS turn FROM a WHERE admitted <= 200""")
def candidate_admission(x):
    """Candidates by class (seen before, exact, catalogue) and specificity up to the capacity of 200 (the operator's own), and their turn in the reading queue."""
    t_ = F.col("text")
    c = x.documents.filter("text is not null").select("doc_id", (F.col("lang") == "en").alias("prior"), F.col("source").isin("src1", "src2").alias("exact"), F.regexp_count(t_, F.lit("[0-9]+")).alias("spec"), F.regexp_count(F.lower(t_), F.lit(r"\bthe\b")).alias("occurrences"))
    c = c.withColumn("class", F.when(F.col("prior"), 0).when(F.col("exact"), 1).otherwise(2))
    top = c.orderBy("class", F.desc("spec"), "doc_id").limit(200)
    semantic = -0.75 * F.col("prior").cast("int") - 0.5 * F.col("exact").cast("int")
    n = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")
    return top.select("doc_id", n("class", F.desc("spec"), "doc_id").alias("admitted"), n(semantic, F.desc("spec"), F.desc("occurrences"), "doc_id").alias("turn"))


@query("W23", """
WITH e AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM e WHERE ts > last - INTERVAL 4 HOUR)
SELECT user_id, event_id FROM k WHERE n <= 3""")
def kept_entries(x):
    """What a cache keeps of each session: entries of the last four hours, three at most, the newest."""
    e = x.events.withColumn("last", F.max("ts").over(Window.partitionBy("user_id"))).filter(F.col("ts") > F.col("last") - F.expr("INTERVAL '4' HOUR"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return e.withColumn("n", n).filter("n <= 3").select("user_id", "event_id")


@query("C2 PF11 C24", """
WITH u AS (SELECT DISTINCT l_orderkey AS answer, l_suppkey AS source, CASE WHEN l_quantity < 5 THEN '' ELSE 'q' || l_partkey % 3 END AS quote, CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 60 END AS seconds FROM lineitem),
k AS (SELECT * FROM u WHERE quote <> ''), f AS (SELECT *, dense_rank() OVER (PARTITION BY answer ORDER BY source) AS d, dense_rank() OVER (PARTITION BY answer ORDER BY quote) AS g FROM k)
SELECT answer, 'S' || row_number() OVER (PARTITION BY answer ORDER BY source, quote, coalesce(seconds, -1)) AS id, 'D' || d AS document, 'T' || g AS topic, seconds FROM f""")
def source_rows(x):
    """Rows of an answer's sources for readers: no empty quotes, no repeats, unusable times blank, aliases in place of ids."""
    u = x.lineitem.select(F.col("l_orderkey").alias("answer"), F.col("l_suppkey").alias("source"), F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("q"), (F.col("l_partkey") % 3).cast("string"))).alias("quote"), F.when(F.col("l_tax") >= 0.02, F.col("l_quantity").cast("long") * 60).alias("seconds"))
    return a.source_rows(u.filter("quote <> ''").distinct())


@query("M9 F24", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS kind, greatest(1, CAST(floor(value) AS BIGINT)) AS requested, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS measured, event_id % 7 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(user_id, n, event_id, open, made, charged, admitted, cost) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT) FROM e
  UNION ALL SELECT user_id, n, event_id, open AND NOT (ok AND kind = 'view'), made + CASE WHEN ok THEN 1 ELSE 0 END, charged + CASE WHEN ok THEN c ELSE 0 END, ok, CASE WHEN ok THEN c ELSE 0 END FROM (
    SELECT *, CASE WHEN failed OR measured IS NULL THEN least(requested, room) ELSE measured END AS c, 12 - made - held >= 1 AND room >= 1 AS ok FROM (
      SELECT e.*, w.open, w.made, w.charged, CASE WHEN w.open AND e.kind <> 'view' THEN 1 ELSE 0 END AS held, 600 - w.charged - CASE WHEN w.open AND e.kind <> 'view' THEN 50 ELSE 0 END AS room FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)))
SELECT user_id, event_id, admitted, cost AS charged, charged AS total FROM w WHERE n > 0""")
def budget_ledger(x):
    """Calls of each user, in order of their events, against twelve calls and 600 tokens, of which a view has 50 in reserve."""
    from ..operators import sequential as q

    e = x.events.select("user_id", "event_id", "event_type", F.floor("value").alias("requested"))

    def start(user):
        ledger = q.Ledger(12, 600, {"view": 50})

        def step(r):
            own = r["requested"]
            c = ledger.call({"kind": r["event_type"], "requested": max(1, own), "measured": None if r["event_id"] % 3 else own, "failed": r["event_id"] % 7 == 0})
            return user, r["event_id"], c["admitted"], c["charged"], c["total"]

        return step

    return q.in_order(e, "user_id", "event_id", start, "user_id long, event_id long, admitted boolean, charged long, total long")
