"""Queries that SQL cannot express: sequential selection, packing, parsing and streams. Tests hold them against hand-made results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as functions_text
from ..operators import sequential as q
from ..operators import tokens
from ..sources import documents as docs
from ..session import shared_dir
from ..streaming import runs
from .registry import query


@query("F25")
def block_splits(x):
    """Documents in pieces of at most 384 estimated tokens."""

    def pieces(text):
        return (("prose", "", f"piece {n + 1}", p) for n, p in enumerate(q.split_block(text, 384)))

    return docs.parsed(x.documents, "doc_id", "text", pieces).select("doc_id", "ordinal", F.char_length("block_text").cast("long").alias("chars"), F.sha2(F.col("block_text").cast("binary"), 256).alias("sha"))


@query("F25", r"""
WITH RECURSIVE t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text <> ''),
w(doc_id, part, start, "end", rest) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), t FROM t
  UNION ALL SELECT doc_id, part + 1, "end", "end" + n, substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN low < length(rest) AND contains(left(rest, low), chr(10)) THEN low - strpos(reverse(left(rest, low)), chr(10)) + 1 ELSE low END AS n
    FROM (SELECT *, length(regexp_extract(left(rest, 384), '^(?:[ \t\n\r\f\x0B]*(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B])){0,96}[ \t\n\r\f\x0B]*')) AS low FROM w WHERE rest <> '') a) b)
SELECT w.doc_id, part, start, "end", sha256(substr(t, start + 1, "end" - start)) AS sha FROM w JOIN t USING (doc_id) WHERE part >= 0""")
def preformatted_slices(x):
    """Texts as preformatted blocks in slices of at most 96 estimated tokens, cut after lines where they can be."""
    t = functions_text.preformatted(F.col("text"))
    found = spans.applied(lambda v: [{"start": a, "end": b} for a, b in q.preformatted_slices(v, 96)], "array<struct<start:long,end:long>>", F.col("t"))
    p = x.documents.filter("text is not null").select("doc_id", t.alias("t")).select("doc_id", "t", F.posexplode(found).alias("part", "s"))
    own = F.substr("t", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int"))
    return p.select("doc_id", F.col("part").cast("long").alias("part"), "s.start", "s.end", F.sha2(own.cast("binary"), 256).alias("sha"))


@query("F26 D9")
def token_passages(x):
    """Passages of 384 tokens of a public tokenizer, 64 shared: slices of the text by its offsets."""
    import public_tokenizers

    w = tokens.passage_windows(x.documents, public_tokenizers.path("word_bpe_49k.json"))
    j = w.join(x.documents.select("doc_id", "text"), "doc_id")
    own = F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return j.select("doc_id", "ordinal", "start", "end", "tokens", F.sha2(own.cast("binary"), 256).alias("sha"))


_POOLED = r"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:64] AS w FROM conversations),
t AS (SELECT conv_id, turn, (unicode(v) * 7 + length(v)) % n AS token FROM (SELECT conv_id, turn, unnest(w) AS v FROM w), n),
d AS (SELECT conv_id, turn, d, avg(CAST(e[d] AS DOUBLE)) AS m FROM (SELECT t.*, embedding AS e, unnest(generate_series(1, 64)) AS d FROM t JOIN embeddings ON vec_id = token) GROUP BY ALL),
l AS (SELECT conv_id, turn, list(m ORDER BY d) AS m FROM d GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(round(m[1] / sqrt(list_sum(list_transform(m, lambda v: v * v))), 6), 0) AS first, coalesce(round(m[64] / sqrt(list_sum(list_transform(m, lambda v: v * v))), 6), 0) AS last, m IS NOT NULL AS any_token FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn"""


@query("M4", _POOLED)
def pooled_vectors(x):
    """Turns as the unit mean of the vectors of their first 64 words; a word's token is one of the embeddings."""
    n = x.embeddings.agg(F.count("*").alias("n"))
    word = lambda v, n: (F.ascii(v) * 7 + F.char_length(v)) % n
    rows = x.conversations.crossJoin(F.broadcast(n)).select(F.struct("conv_id", "turn").alias("row"), F.transform(functions_text.words(F.col("text")), lambda v: word(v, F.col("n"))).alias("tokens"))
    out = tokens.pooled(rows, x.embeddings.select(F.col("vec_id").alias("token"), "embedding"), 64)
    return out.select("row.conv_id", "row.turn", F.round(F.col("pooled")[0], 6).alias("first"), F.round(F.col("pooled")[63], 6).alias("last"), F.exists("pooled", lambda v: v != 0).alias("any_token"))


@query("F26 D9", r"""
WITH t AS (SELECT doc_id, text, length(text) - length(regexp_replace(text, '^[ \t\n\r\f\x0B]+', '')) AS lead, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS n FROM t), p AS (SELECT u.doc_id, n, lead + coalesce(sum(length(u.w)) OVER (PARTITION BY u.doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM u JOIN t USING (doc_id)),
k AS (SELECT doc_id, text, len(w) AS len, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 160) / 128.0) AS BIGINT)))) AS ordinal FROM t WHERE len(w) > 0),
s AS (SELECT k.doc_id, ordinal, text, CAST(CASE WHEN ordinal = 0 THEN 0 ELSE a.place END AS BIGINT) AS start, CAST(CASE WHEN ordinal * 128 + 160 >= len THEN length(text) ELSE b.place END AS BIGINT) AS "end" FROM k LEFT JOIN p a ON a.doc_id = k.doc_id AND a.n = ordinal * 128 LEFT JOIN p b ON b.doc_id = k.doc_id AND b.n = ordinal * 128 + 160)
SELECT doc_id, ordinal, start, "end", sha256(substr(text, start + 1, "end" - start)) AS sha FROM s""")
def passage_spans(x):
    """Exact slices of 160 white-space tokens, 32 shared: offsets in code points."""

    def windows(text):
        return (("passage", str(a), str(b), text[a:b]) for a, b in q.token_windows(text))

    p = docs.parsed(x.documents, "doc_id", "text", windows)
    return p.select("doc_id", "ordinal", F.col("section_path").cast("long").alias("start"), F.col("locator").cast("long").alias("end"), F.sha2(F.col("block_text").cast("binary"), 256).alias("sha"))


@query("SC6 SC8 SC13")
def html_blocks(x):
    return docs.parsed(x.pages, "page_id", "html", docs.html_blocks)


#: Folders that `extracted_files` deals its files to, so that many tasks list them.
_FOLDERS = 1000


@query("SC1 SC2 SC3 SC4", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents), p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t\f\x0B\n]*\n')) AS p FROM t),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(p, chr(160), ' '), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS p FROM p)
SELECT doc_id, count(*) AS blocks, CAST(sum(length(p)) AS BIGINT) AS chars, CASE doc_id % 4 WHEN 1 THEN 'decoded as utf-16' WHEN 2 THEN 'decoded as utf-32' ELSE '' END AS note FROM c WHERE p <> '' GROUP BY doc_id""")
def extracted_files(x):
    """Documents written as files in four encodings, found by suffix, decoded, and parsed into paragraphs."""
    folder = f"{shared_dir(x.spark)}/files-{uuid.uuid4().hex}"

    def write(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if re.match(r"[a-z0-9]+:", folder) else (fs.LocalFileSystem(), folder)
        made: set[int] = set()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codec = ("utf-8", "utf-16", "utf-32", "utf-8-sig")[doc % 4]
                own = doc % _FOLDERS
                if own not in made:
                    system.create_dir(f"{base}/{own}", recursive=True)
                    made.add(own)
                with system.open_output_stream(f"{base}/{own}/{doc}.txt", compression=None) as out:
                    out.write((text or "").encode(codec))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"])

    x.documents.select("doc_id", "text").mapInArrow(write, "doc_id long").agg(F.count("*")).collect()
    files = docs.decoded(docs.collect_files(x.spark, folder))
    b = docs.extracted(files).join(files.select(F.col("path").alias("doc_id"), "note"), "doc_id")
    name = F.regexp_extract("doc_id", r"([0-9]+)\.txt$", 1).cast("long")
    return b.groupBy(name.alias("doc_id")).agg(F.count("*").alias("blocks"), F.sum(F.char_length("block_text").cast("long")).alias("chars"), F.first("note").alias("note"))


@query("SC5 SC2")
def markdown_blocks(x):
    return docs.parsed(x.documents, "doc_id", "text", docs.markdown_blocks)


def _drain(x, make):
    """The stream's result over the events that there are; its tables are in the shared folder."""
    found = runs.event_stream(x.spark, x.folder, x.events.schema, pathGlobFilter="events.parquet")
    return runs.drained(found, make, f"{shared_dir(x.spark)}/stream-{uuid.uuid4().hex}")


@query("ST1 RL1 ST6", """
SELECT date_trunc('hour', ts) AS hour, user_id, max_by(CASE WHEN regexp_matches(event_type, '^[a-z][a-z0-9_.]{0,39}$') THEN event_type ELSE 'other' END, event_id) AS state, max(event_id) AS last_event, count(*) AS n_events FROM events GROUP BY ALL""")
def stream_run_state(x):
    return _drain(x, runs.run_states).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("ST3", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(x):
    s = _drain(x, runs.idle_sessions)
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


@query("ST2 RL3", """
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'done' ELSE event_type END AS event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
w(user_id, n, until, event_id, verdict) AS (
  SELECT user_id, n, CASE WHEN event_type = 'done' THEN 0 ELSE t + 900 END, event_id, CASE WHEN event_type = 'done' THEN 'released' ELSE 'claimed' END FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN event_type = 'done' THEN 0 WHEN t >= until THEN t + 900 ELSE until END, e.event_id, CASE WHEN event_type = 'done' THEN 'released' WHEN t >= until THEN 'claimed' ELSE 'refused' END
  FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, verdict FROM w""")
def stream_leases(x):
    """Sign-ups stand for work that is done."""
    return _drain(x, lambda e: runs.leases(e.withColumn("event_type", F.when(F.col("event_type") == "signup", "done").otherwise(F.col("event_type")))))


@query("ST4 RL5", """
SELECT user_id, date_trunc('hour', ts) AS hour, date_trunc('hour', ts) + INTERVAL 2 HOUR AS expires, count(*) AS n_jobs, max(event_id) AS last_job FROM events WHERE event_type = 'purchase' GROUP BY ALL""")
def stream_expired_jobs(x):
    """Finished jobs by hour, and when their hour of grace ends."""
    return _drain(x, runs.expired_jobs).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("hour", "expires")})


@query("ST5", """
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
c AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS cleared FROM e)
SELECT c.user_id, c.event_id, least(6, n - cleared) AS remembered, CASE WHEN n > cleared THEN (SELECT o.event_id FROM e o WHERE o.user_id = c.user_id AND o.n = c.n - least(6, c.n - c.cleared) + 1) END AS oldest FROM c""")
def stream_recent(x):
    """How much of a session is remembered after each event, and its oldest part."""
    return _drain(x, runs.recent)


@query("ST8", """
WITH n AS (SELECT max(ts) AS newest FROM events), f AS (SELECT user_id, event_id, ts, 50 + CAST(floor(value) AS BIGINT) AS size FROM events, n WHERE ts >= newest - INTERVAL 10 DAY),
r AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM f)
SELECT user_id, event_id FROM r WHERE running <= 1500""")
def stream_retention(x):
    """Traces of a user of the last ten days, 1500 bytes of them at most, swept as the files of a stream come in."""
    base = f"{shared_dir(x.spark)}/retention-{uuid.uuid4().hex}"
    rows = x.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (50 + F.floor("value")).cast("long").alias("size"))
    rows.repartition(4, "event_id").write.parquet(f"{base}/in")
    files = x.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return runs.swept(files, f"{base}/state", "user_id", "event_id", days=10, most_bytes=1500).select("user_id", "event_id")
