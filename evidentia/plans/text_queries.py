"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as t
from .registry import query

_WS = r"[ \t\n\r\f\x0B]"


@query("A1 A3 D11", r"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term""")
def vocabulary_df(x):
    """Document and collection frequency of every word."""
    return x.documents.select("doc_id", F.explode(t.words(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("F20 A36", r"""
SELECT doc_id, greatest(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]')), CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents""")
def token_estimates(x):
    return x.documents.select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query("F21", r"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[ \t\n\r\f\x0B]+|[^A-Za-z0-9 \t\n\r\f\x0B]+')) AS p FROM documents),
c AS (SELECT doc_id, CASE
   WHEN regexp_matches(p, '^[A-Za-z0-9]') THEN CASE WHEN regexp_matches(p, '[0-9]') THEN length(p) ELSE CAST(ceil(length(p) / 4.0) AS BIGINT) END
   WHEN regexp_matches(p, '^[ \t\n\r\f\x0B]') THEN greatest(1, CAST(ceil(strlen(p) / 4.0) AS BIGINT)) ELSE strlen(p) END AS c FROM p)
SELECT doc_id, CAST(coalesce(sum(c), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(c), 0) + 32 AS BIGINT) AS passage_cost FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def conservative_costs(x):
    cost = t.conservative_tokens(F.col("text"))
    return x.documents.select("doc_id", cost.alias("tokens")).withColumn("passage_cost", F.col("tokens") + 32)


@query("F2 F3", r"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) > 1 AND w NOT IN (STOP)), ' ') AS search_tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS n_distinct FROM documents""".replace("STOP", ",".join(f"'{w}'" for w in t.SEARCH_STOP_WORDS)))
def search_token_lists(x):
    parts = F.regexp_extract_all(F.lower("text"), F.lit(t.PART), F.lit(0))
    return x.documents.select("doc_id", F.array_join(t.search_tokens(F.col("text")), " ").alias("search_tokens"), F.size(F.array_distinct(parts)).cast("long").alias("n_distinct"))


@query("F7 F8", r"""
SELECT doc_id,
  sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS source_sha,
  sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS pre_sha FROM documents""")
def normal_forms(x):
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return x.documents.select("doc_id", sha(t.source_text(F.col("text"))).alias("source_sha"), sha(t.preformatted(F.col("text"))).alias("pre_sha"))


@query("F4 F5 F6", r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(replace(lower(replace(translate(t, '‐‑', '--'), '’', chr(39))), 'ß', 'ss')) AS corpus_sha, sha256(replace(t, '’', chr(39))) AS identity_sha, sha256(replace(lower(t), 'ß', 'ss')) AS folded_sha FROM n""")
def surface_forms(x):
    """The three forms by which surfaces are compared, under compatibility normalization and full case folding."""
    forms = F.array(*[spans.applied(f, "string", F.col("text")) for f in (spans.corpus_surface, spans.identity_surface, spans.folded_surface)])
    d = x.documents.filter("text is not null").select("doc_id", F.transform(forms, lambda v: F.sha2(v.cast("binary"), 256)).alias("s"))
    return d.select("doc_id", *[F.col("s")[k].alias(n) for k, n in enumerate(("corpus_sha", "identity_sha", "folded_sha"))])


@query("F9")
def literal_surfaces(x):
    """What ten recognisers find in every document, each normal form once for its kind."""
    found = spans.applied(lambda v: [list(p) for p in spans.literal_surfaces(v)], "array<array<string>>", F.col("text"))
    return x.documents.select("doc_id", F.explode(found).alias("p")).select("doc_id", F.col("p")[0].alias("kind"), F.col("p")[1].alias("surface"))


@query("F11")
def question_names(x):
    """Whom each turn of a user may be about, asked as it is and in two frames around its first words."""
    first = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ")
    asked = F.concat(F.lit("What does "), first, F.lit(" do? And what about "), F.lower(first), F.lit("? "), F.col("text"))
    found = spans.applied(spans.question_names, "array<string>", asked)
    return x.conversations.filter("role = 'user' and text is not null").select("conv_id", "turn", F.posexplode(found).alias("position", "name"))


@query("F10")
def question_anchors(x):
    """What each question names literally, the first 32."""
    found = spans.applied(spans.question_surfaces, "array<string>", F.col("text"))
    return x.conversations.filter("role = 'user'").select("conv_id", "turn", F.posexplode(found).alias("position", "anchor"))


@query("D7 A37", r"""
WITH s AS (""" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS surface FROM documents" for k, p in t.SURFACES.items()) + r"""
  UNION ALL SELECT doc_id, 'acronym', unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]{1,9}$'))) FROM documents)
SELECT doc_id, kind, lower(surface) AS term, count(*) AS n, min(surface) AS first_surface FROM s GROUP BY ALL""")
def exact_terms(x):
    """Postings of exact surfaces, one row for each document, kind and normal form."""
    s = x.documents.select("doc_id", F.explode(t.surfaces(F.col("text"))).alias("s")).select("doc_id", "s.*")
    return s.groupBy("doc_id", "kind", F.lower("surface").alias("term")).agg(F.count("*").alias("n"), F.min("surface").alias("first_surface"))


@query("F12 F13 J27", r"""
SELECT d.doc_id, r.r_regionkey, CASE WHEN contains(lower(d.text), lower(r.r_name)) THEN 2e0 ELSE 0e0 END AS bonus,
  len(regexp_extract_all(lower(d.text), '(^|[^a-z0-9_])' || lower(split_part(r.r_name, ' ', 1)) || '($|[^a-z0-9_])')) > 0 AS whole_word
FROM documents d CROSS JOIN region r""")
def alias_occurrence(x):
    """Known aliases, a bounded registry, in every text: anywhere, and as whole words."""
    d = x.documents.select("doc_id", F.lower("text").alias("t"))
    r = x.region.select("r_regionkey", F.lower("r_name").alias("a")).withColumn("first", F.split("a", " ")[0])
    # an expression looks only at the few texts that hold the word at all
    whole = F.contains("t", "first") & F.rlike("t", F.concat(F.lit(r"(?:^|[^a-z0-9_])\Q"), "first", F.lit(r"\E(?:$|[^a-z0-9_])")))
    return d.join(F.broadcast(r), F.lit(True)).select("doc_id", "r_regionkey", F.when(F.contains("t", "a"), 2.0).otherwise(0.0).alias("bonus"), whole.alias("whole_word"))  # five rows


@query("F15 F16 F27 F31 SK7 C8", r"""
SELECT doc_id, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS has_control, regexp_matches(text, '\[[EPS][0-9]+\]') AS has_marker,
  regexp_matches(text, '""" + t.CREDENTIAL.replace("'", "''") + r"""') AS has_credential, sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha FROM documents""")
def text_screens(x):
    c = F.col("text")
    return x.documents.select("doc_id", c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("has_control"), c.rlike(r"\[[EPS][0-9]+\]").alias("has_marker"), t.has_credential(c).alias("has_credential"), F.sha2(t.escaped(c).cast("binary"), 256).alias("escaped_sha"))


@query("PF17 PF18 PF19", r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(?:all|every|each|list)\b') THEN 'exhaustive' WHEN regexp_matches(lower(text), '\b(?:overview|summary|summarize|about)\b') THEN 'overview' ELSE 'targeted' END AS mode,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '\b(?:than|versus|compare|difference)\b') THEN 'comparison' END, CASE WHEN regexp_matches(lower(text), '\b(?:when|before|after|date|year)\b') THEN 'temporal' END,
     CASE WHEN regexp_matches(lower(text), '\b(?:how|step|process)\b') THEN 'procedure' END, CASE WHEN regexp_matches(lower(text), '[0-9]') THEN 'exact' END], lambda v: v IS NOT NULL), ','), ''), 'general') AS shape,
  CASE WHEN regexp_matches(lower(text), '\b(?:video|chapter|recording)\b') THEN 'video' WHEN regexp_matches(lower(text), '\b(?:who|role|head|director)\b') THEN 'role' ELSE 'document' END AS route
FROM conversations WHERE role = 'user'""")
def question_routing(x):
    c = F.col("text")
    route = F.when(F.lower(c).rlike(r"\b(?:video|chapter|recording)\b"), "video").when(F.lower(c).rlike(r"\b(?:who|role|head|director)\b"), "role").otherwise("document")
    return x.conversations.filter("role = 'user'").select("conv_id", "turn", t.question_mode(c).alias("mode"), t.question_shape(c).alias("shape"), route.alias("route"))


@query("PF20 C1 F32 D18", r"""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations WHERE role = 'user')
SELECT conv_id, turn, prior IS NOT NULL AND (regexp_matches(lower(text), '\b(?:it|that|this|they|those)\b') OR len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) <= 6) AS follow_up,
  CASE WHEN prior IS NULL THEN length(text) ELSE length('Current: ' || text || chr(10) || 'Prior: ' || prior) END AS effective_chars FROM u""")
def session_followups(x):
    """A turn follows up if it has a prior one and points back or is short."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = x.conversations.filter("role = 'user'").withColumn("prior", F.lag("text").over(w))
    short = F.size(t.words(F.col("text"))) <= 6
    follow = F.col("prior").isNotNull() & (F.lower("text").rlike(r"\b(?:it|that|this|they|those)\b") | short)
    effective = F.when(F.col("prior").isNull(), F.col("text")).otherwise(F.concat(F.lit("Current: "), "text", F.lit("\nPrior: "), "prior"))
    return u.select("conv_id", "turn", follow.alias("follow_up"), F.char_length(effective).cast("long").alias("effective_chars"))


@query("W24 ST5", r"""
WITH u AS (SELECT conv_id, turn, text, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM u WHERE p IS NULL OR p <> lower(text))
SELECT conv_id, turn, recency FROM k WHERE recency <= 6""")
def recent_turns(x):
    """The six latest questions of a session, a question that repeats its predecessor counted once."""
    w = Window.partitionBy("conv_id")
    u = x.conversations.filter("role = 'user'").withColumn("p", F.lag(F.lower("text")).over(w.orderBy("turn")))
    k = u.filter("p is null or p <> lower(text)").withColumn("recency", F.row_number().over(w.orderBy(F.desc("turn"))).cast("long"))
    return k.filter("recency <= 6").select("conv_id", "turn", "recency")


@query("H1 PF23 H3", r"""
SELECT doc_id, 'doc_' || substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR) || chr(0)), 1, 24) AS logical_id, sha256(text) AS text_sha256, length(text) = n_chars AS source_ok FROM documents""")
def content_addresses(x):
    """Ids and digests of contents; a source is as it was stored if the digest of its text of the stored length agrees."""
    stored = F.sha2(F.rpad("text", F.col("n_chars").cast("int"), F.lit("\0")).cast("binary"), 256)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return x.documents.select("doc_id", F.concat(F.lit("doc_"), F.substring(t.digest(F.col("source"), F.col("doc_id")), 1, 24)).alias("logical_id"), sha.alias("text_sha256"), (sha == stored).alias("source_ok"))


@query("H4 D1", r"""
WITH b AS (SELECT lang, doc_id // 1000 AS bucket, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS d, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS fingerprint, CAST(sum(n) AS BIGINT) AS documents FROM b GROUP BY lang""")
def snapshot_fingerprint(x):
    """A digest of all members of a generation, in order, as a tree of two levels: a bucket of a thousand ids has a digest
    of its members' ids and digests, a generation one of its buckets'. No group holds more than a bucket's lines or the
    buckets' digests."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(F.col("text").cast("binary"), 256))
    rows = x.documents.select("lang", F.floor(F.col("doc_id") / 1000).alias("bucket"), "doc_id", line.alias("line"))
    whole = lambda c: F.sha2(F.array_join(c, "\n").cast("binary"), 256)
    b = rows.groupBy("lang", "bucket").agg(F.sort_array(F.collect_list(F.struct("doc_id", "line"))).alias("m"), F.count("*").alias("n"))
    b = b.select("lang", "bucket", whole("m.line").alias("d"), "n")
    g = b.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "d"))).alias("m"), F.sum("n").alias("documents"))
    return g.select("lang", whole("m.d").alias("fingerprint"), "documents")


@query("T1 T2", r"""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 97 AS s FROM lineitem),
f AS (SELECT *, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE CAST((s // 60) % 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM c)
SELECT l_orderkey, l_linenumber, clock, s AS seconds FROM f""")
def clock_round_trip(x):
    s = x.lineitem.select("l_orderkey", "l_linenumber", t.clock_of(F.col("l_quantity").cast("long") * 97).alias("clock"))
    return s.withColumn("seconds", t.seconds_of(F.col("clock")))


@query("T3 T4", r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(o_orderdate + INTERVAL 900 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS lease_until FROM orders""")
def lease_times(x):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return x.orders.select("o_orderkey", iso(at).alias("at"), iso(at + F.expr("INTERVAL '900' SECOND")).alias("lease_until"))


@query("R1 A34 C5 C31", r"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS p FROM benchmark),
f AS (SELECT item_id, w, min(p) AS p FROM w GROUP BY ALL)
SELECT item_id, string_agg(w, ' ' ORDER BY p) AS words, count(*) AS n FROM f GROUP BY item_id""")
def ordered_unique_words(x):
    d = F.array_distinct(t.words(F.col("text")))
    return x.benchmark.select("item_id", F.array_join(d, " ").alias("words"), F.size(d).cast("long").alias("n"))


@query("D20", r"""
SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b(?:section|version|chapter|page)[ ]+([0-9]+(?:\.[0-9]+)*)', 1)) AS label FROM documents""")
def section_labels(x):
    return x.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:section|version|chapter|page)[ ]+([0-9]+(?:\.[0-9]+)*)"), F.lit(1))).alias("label"))


@query("F10", r"""
SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '"([^"\n]{1,64})"', 1))) AS quoted FROM documents""")
def quoted_surfaces(x):
    return x.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r'"([^"\n]{1,64})"'), F.lit(1)))).alias("quoted"))
