"""JSON files as tables: entity registries, profiles, video files and pinned manifests, each with its own schema.

A file is one text; what is wrong with a file or a record is a row with an issue, never the end of the job. Values keep
their JSON types (VARIANT) until a field says what it must be, so a list of mixed records is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MB = 1 << 20


def json_files(spark: SparkSession, folder: str, most_bytes: int = 2 * MB, pattern: str = "*.json") -> DataFrame:
    """path, text and issue (null, or too_large: then the text is null) of the files of a folder, read recursively; empty files have no row."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    large = F.col("length") > most_bytes
    return f.select("path", F.when(~large, F.decode("content", "UTF-8")).alias("text"), F.when(large, "too_large").alias("issue"))


def parsed(files: DataFrame) -> DataFrame:
    """`files` (path, text and maybe issue) with value (VARIANT), null where there is none, and issue."""
    value = F.try_parse_json("text")
    before = F.col("issue") if "issue" in files.columns else F.lit(None).cast("string")
    return files.select("path", value.alias("value"), F.coalesce(before, F.when(value.isNull(), "invalid_json")).alias("issue"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _strings(v: Column, path: str) -> Column:
    """The strings of a list, in order; nothing if it is none."""
    return F.coalesce(F.filter(F.transform(_get(v, path, "array<variant>"), lambda x: F.when(_kind(x) == "STRING", _get(x, "$", "string"))), lambda s: s.isNotNull()), F.array().cast("array<string>"))


def registry_entities(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, version, id, name, aliases, distinct_from) of the entities of registries, and (path, issue).

    A registry is an object with a list of entities; entries without an id and a name are passed over. An alias is a
    string, which counts in its own case, or an object with text and mode; an entity's name is its last alias, in any case.
    """
    p = parsed(files)
    whole = _kind(F.col("value")).startswith("OBJECT")
    listed = _get(F.col("value"), "$.entities", "array<variant>")
    absent = F.expr("variant_get(value, '$.entities', 'variant')").isNull()
    issue = F.coalesce("issue", F.when(~whole | ~(listed.isNotNull() | absent), "not_a_registry"))
    p = p.withColumn("issue", issue)
    # the file's value stays below the explode, else every entity would carry it
    lists = p.filter("issue is null").select("path", F.coalesce(_get(F.col("value"), "$.version", "int"), F.lit(1)).alias("version"), listed.alias("listed"))
    rows = lists.select("path", "version", F.explode("listed").alias("e")).filter(_kind(F.col("e")).startswith("OBJECT"))
    one = lambda c, path: F.trim(F.coalesce(_get(c, path, "string"), F.lit("")))
    e = F.col("e")
    entry = lambda text, mode: F.struct(text.alias("text"), mode.alias("mode"))

    def alias(v: Column) -> Column:
        plain = F.when(_kind(v) == "STRING", entry(_get(v, "$", "string"), F.lit("exact_case")))
        text = one(v, "$.text")
        return plain.when(_kind(v).startswith("OBJECT") & (text != ""), entry(text, F.coalesce(_get(v, "$.mode", "string"), F.lit("exact_case"))))

    aliases = F.filter(F.transform(F.coalesce(_get(e, "$.aliases", "array<variant>"), F.array().cast("array<variant>")), alias), lambda a: a.isNotNull())
    name = one(e, "$.name")
    out = rows.select("path", "version", one(e, "$.id").alias("id"), name.alias("name"), F.concat(aliases, F.array(entry(name, F.lit("casefold")))).alias("aliases"), F.filter(_strings(e, "$.distinct_from"), lambda s: s != "").alias("distinct_from"))
    return out.filter("id <> '' and name <> ''"), p.filter("issue is not null").select("path", "issue")


#: What a profile says if its file does not.
PROFILE = {"answer_style": "Direct, natural, and concise; add detail when the question needs it.", "language": "Match the user's language."}


def profiles(files: DataFrame) -> DataFrame:
    """path, answer_style, language, custom_instructions, glossary and issue; a field of another type keeps its default."""
    p = parsed(files)
    v = F.col("value")
    issue = F.coalesce("issue", F.when(~_kind(v).startswith("OBJECT"), "not_an_object"))
    field = lambda name: F.expr(f"try_variant_get(value, '$.{name}', 'variant')")
    text = lambda name: F.coalesce(F.when(_kind(field(name)) == "STRING", _get(v, f"$.{name}", "string")), F.lit(PROFILE[name]))
    glossary = F.coalesce(_get(v, "$.glossary", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return p.select("path", text("answer_style").alias("answer_style"), text("language").alias("language"), _strings(v, "$.custom_instructions").alias("custom_instructions"), glossary.alias("glossary"), issue.alias("issue"))


def records(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(path, nth, and the fields of `schema`) of files that hold one object or a list of them, and (path, nth, issue)."""
    p = parsed(files)
    v = F.col("value")
    every = F.coalesce(_get(v, "$", "array<variant>"), F.array(v))
    rows = p.filter("issue is null").select("path", F.posexplode(every).alias("nth", "v"))
    good = _kind(F.col("v")).startswith("OBJECT")
    out = rows.withColumn("r", F.when(good, F.from_json(F.to_json("v"), schema)))
    bad = out.filter("r is null").select("path", "nth", F.lit("not_an_object").alias("issue"))
    return out.filter("r is not null").select("path", "nth", "r.*"), bad.unionByName(p.filter("issue is not null").select("path", F.lit(None).cast("int").alias("nth"), "issue"))


#: The files that an encoder's manifest must name, and those that it need not.
REQUIRED_FILES, HARMLESS_NAMES = ("config.json", "model.safetensors", "tokenizer.json", "tokenizer_config.json"), ("license", "license.txt", "notice", "notice.txt", "manifest.json")


def manifest_issues(files: DataFrame, found: DataFrame, pinned: dict[str, str], required: tuple[str, ...] = REQUIRED_FILES) -> DataFrame:
    """path and issue of every manifest that does not pin its folder: what differs from it, and what it leaves out.

    files: path, text of manifests; found: path (the manifest's), name, bytes, sha256 of the files that there are. `pinned`
    are fields that must have these values; `required` the names that must be listed. Issues: invalid_json,
    unrecognized:field, listed_twice:name, missing:name, changed:name, omits:name, unlisted:name.
    """
    p = parsed(files)
    v = F.col("value")
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(_get(v, f"$.{k}", "string") == F.lit(x), F.lit(False)), f"unrecognized:{k}") for k, x in pinned.items()]))
    entry = "array<struct<path:string,bytes:bigint,sha256:string>>"
    file = "struct<bytes:bigint,sha256:string>"
    nothing = F.lit(None)

    def fact(name=nothing, listed=nothing, there=nothing, asked=False, known=False, issues=nothing):
        own = {"name": name.cast("string"), "listed": listed.cast(file), "there": there.cast(file), "asked": F.lit(asked), "known": F.lit(known), "issues": issues.cast("array<string>")}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    # all that a manifest says is rows of one pass, which meet the files that there are by name
    named = F.transform(F.coalesce(_get(v, "$.files", entry), F.array().cast(entry)), lambda f: fact(f["path"], F.struct(f["bytes"], f["sha256"])))
    whole = F.concat(F.array(fact(known=True, issues=wrong)), named, *[F.array(fact(F.lit(x), asked=True)) for x in required])
    said = p.select("path", F.when(F.col("issue").isNull(), whole).otherwise(F.array(fact(issues=F.array("issue")))).alias("facts")).select("path", F.inline("facts"))
    rows = said.unionByName(found.select("path", F.inline(F.array(fact(F.col("name"), there=F.struct("bytes", "sha256"))))))
    own = rows.groupBy("path", "name").agg(
        F.count("listed").alias("n"), F.first("listed", ignorenulls=True).alias("listed"), F.collect_list("there").alias("there"),
        F.max("asked").alias("asked"), F.max("known").alias("known"), F.flatten(F.collect_list("issues")).alias("issues"),
    )
    n, name, listed = F.col("n"), F.col("name"), F.col("listed")
    harmless = F.lower("name").isin(*HARMLESS_NAMES) | F.lower("name").endswith(".md") | (name.startswith("provenance_") & name.endswith(".json"))

    def code(f: Column) -> Column:
        changed = ~f["bytes"].eqNullSafe(listed["bytes"]) | ~f["sha256"].eqNullSafe(listed["sha256"])
        return F.when(n > 1, "listed_twice").when(n == 0, F.when(~harmless, "unlisted")).when(changed, "changed")

    absent = F.when(n > 1, F.array(F.lit("listed_twice"))).when(n == 1, F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    codes = F.concat(F.when(F.size("there") > 0, F.transform("there", code)).otherwise(absent), F.array(F.when(F.col("asked") & (n == 0), "omits")))
    every = F.concat("issues", F.array_compact(F.transform(codes, lambda c: F.concat(c, F.lit(":"), name))))
    # files of a folder without a readable manifest count for nothing
    told = own.select("path", "name", "known", every.alias("issues")).filter(F.col("known") | (F.size("issues") > 0))
    told = told.withColumn("known", F.max("known").over(Window.partitionBy("path"))).filter(F.col("known") | name.isNull())
    return told.select("path", F.explode("issues").alias("issue"))
