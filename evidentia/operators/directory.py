"""Directory of people, roles and videos: searches with as-of filters, scores, ranks and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def in_force(at: Column, start: Column, end: Column) -> Column:
    """Role dates compare as text, the reference day included at the start and excluded at the end."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def token_score(haystack: Column, query: Column) -> Column:
    """2 for the whole phrase, plus the share of query tokens found (repeats count above, not below the line)."""
    asked, own = t.search_tokens(query), t.search_tokens(haystack)
    hit = F.size(F.filter(asked, lambda w: F.array_contains(own, w)))
    phrase = F.when(F.contains(t.surface(haystack), t.surface(query)), 2.0).otherwise(0.0)
    return F.round(phrase + hit / F.greatest(F.size(F.array_distinct(asked)), F.lit(1)), 6)


def competing(roles: DataFrame, role: str, organization: str, person: str) -> DataFrame:
    """Roles of an organization that more than one person holds."""
    return roles.groupBy(role, organization).agg(F.countDistinct(person).alias("holders")).filter("holders > 1")


def successor_chain(roles: DataFrame, key: list[str], start: str, order: list[str]) -> DataFrame:
    """Closes each row where its successor begins: adds valid_until and current."""
    w = Window.partitionBy(*key).orderBy(start, *order)
    until = F.lead(start).over(w)
    return roles.withColumn("valid_until", until).withColumn("current", until.isNull())


def best_part(parts: DataFrame, key: str, score: str, ordinal: str) -> DataFrame:
    """The part of each key with the highest score, the first of equals."""
    return parts.groupBy(key).agg(F.max_by(F.struct(ordinal, score), F.struct(F.col(score), -F.col(ordinal))).alias("b")).select(key, "b.*")


def search_videos(videos: DataFrame, chapters: DataFrame, query: Column, limit: int = 20) -> DataFrame:
    """Videos (video_id, title, about) by score with their best chapter; chapters: video_id, ordinal, about.

    The score is 2 for the whole phrase, plus the query's tokens in the video and one and a half times those in its best
    chapter (the first of equals), over the number of different tokens. Without any of these a video does not show, unless
    the query has no token. Videos and chapters are the caller's to authorize; the limit is the search's own.
    """
    asked = t.search_tokens(query)
    found = lambda own: F.size(F.filter(asked, lambda w: F.array_contains(t.search_tokens(own), w)))
    scored = chapters.select("video_id", "ordinal", found(F.col("about")).alias("hits"))
    best = scored.groupBy("video_id").agg(F.max_by(F.struct("ordinal", "hits"), F.struct(F.col("hits"), -F.col("ordinal"))).alias("b"))
    v = videos.join(best, "video_id", "left").withColumn("base", found(F.col("about")))
    v = v.withColumn("top", F.coalesce("b.hits", F.lit(0))).withColumn("phrase", F.when((query != "") & F.contains(t.surface(F.col("about")), t.surface(query)), 2.0).otherwise(0.0))
    v = v.filter((F.size(asked) == 0) | (F.col("base") > 0) | (F.col("top") > 0) | (F.col("phrase") > 0))
    score = F.round(F.col("phrase") + (F.col("base") + 1.5 * F.col("top")) / F.greatest(F.size(F.array_distinct(asked)), F.lit(1)), 6)
    v = v.withColumn("score", score).withColumn("chapter", F.when(F.col("top") > 0, F.col("b.ordinal"))).withColumn("name", F.lower("title"))
    top = v.orderBy(F.desc("score"), "name", "video_id").limit(max(1, min(limit, 100)))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "name", "video_id")).cast("long")
    return top.select("video_id", "chapter", "score", rank.alias("rank"))


def import_issues(videos: DataFrame, chapters: DataFrame, known: DataFrame) -> DataFrame:
    """(video_id, issue) of videos that may not be imported: videos have external_id, fingerprint and duration (seconds).

    Issues: an external id or fingerprint that the catalogue (`known`: external_id, fingerprint) or another video of the
    import has, a chapter that is empty, begins before its predecessor ends, or ends after the video.
    """
    out = []
    for c in ("external_id", "fingerprint"):
        twice = videos.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(c)
        taken = known.select(c).distinct()
        out += [videos.join(x, c, "left_semi").select("video_id", F.lit(f"{how} {c}").alias("issue")) for how, x in (("repeated", twice), ("known", taken))]
    w = Window.partitionBy("video_id").orderBy("ordinal")
    c = chapters.withColumn("prior", F.lag("end").over(w)).join(videos.select("video_id", "duration"), "video_id")
    each = F.array(F.when(F.col("end") <= F.col("start"), "empty chapter"), F.when(F.col("prior") > F.col("start"), "chapter order"), F.when((F.col("end") > F.col("duration")) | (F.col("start") < 0), "chapter bounds"))
    out.append(c.select("video_id", F.explode(F.filter(each, lambda v: v.isNotNull())).alias("issue")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_.distinct()


def answer_lines(hits: DataFrame, group: str, order: list, line: Column, most: int) -> DataFrame:
    """The first `most` lines of each group as one answer, and whether there were more (the answer's own limit)."""
    w = Window.partitionBy(group)
    k = hits.withColumn("_line", line).withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).filter(F.col("_rn") <= most)
    g = k.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_rn", "_line"))).alias("t"), F.max("_n").alias("n"))
    return g.select(group, F.array_join("t._line", "\n").alias("answer"), (F.col("n") > most).alias("truncated"))
