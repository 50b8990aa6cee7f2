"""Access control: principals, system roles, validity, wildcard grants, deny before allow. Sets are DataFrames; `at` is an argument.

Verdicts stay symbolic: a grant for `*` is one row however many resources there are, and only what is asked for, or what
grants name, is joined. Nothing here is a product of users and resources.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each system role may do.
ROLE_PERMISSIONS = {
    "administrator": ("*",),
    "corpus_manager": (
        "question.ask", "document.search", "document.read", "document.cite", "document.manage", "video.search", "video.metadata.read", "video.open", "video.manage",
        "org_role.search", "org_role.read", "org_role.manage", "identity.manage", "corpus.manage", "trace.read_own",
    ),
    "researcher": (
        "question.ask", "document.search", "document.read", "document.cite", "video.search", "video.metadata.read", "video.open", "org_role.search", "org_role.read", "trace.read_own",
    ),
    "viewer": ("question.ask", "document.search", "document.read", "document.cite", "video.search", "video.metadata.read", "org_role.search", "org_role.read", "trace.read_own"),
    "guest": ("question.ask", "document.search", "document.read", "document.cite", "video.search", "video.metadata.read", "org_role.search", "org_role.read"),
    "trace_auditor": ("trace.read_any", "audit.read"),
}
#: Reading, finding and citing a document are asked for together.
DOCUMENT_ACTIONS = ("document.search", "document.read", "document.cite")


def valid(at: Column, start: Column, end: Column) -> Column:
    """start <= at < end, null meaning unbounded."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def principal_keys(users: DataFrame, memberships: DataFrame, at: Column) -> DataFrame:
    """(user_id, principal_type, principal_id): the active user itself and the active groups it is a member of at that time."""
    own = users.filter("active").select("user_id", F.lit("user").alias("principal_type"), F.col("user_id").alias("principal_id"))
    m = memberships.filter(F.col("group_active") & valid(at, F.col("valid_from"), F.col("valid_until")))
    groups = m.join(users.filter("active").select("user_id"), "user_id", "left_semi").select("user_id", F.lit("group").alias("principal_type"), F.col("group_id").alias("principal_id"))
    return own.unionByName(groups).distinct()


def role_table(spark) -> DataFrame:
    """(role_name, permission) of the system roles."""
    return spark.createDataFrame([(k, v) for k, vs in ROLE_PERMISSIONS.items() for v in vs], "role_name string, permission string")


def held_roles(principals: DataFrame, assigned: DataFrame, at: Column) -> DataFrame:
    """(user_id, role_name) of the roles in force of the user and its groups."""
    live = assigned.filter(valid(at, F.col("valid_from"), F.col("valid_until")))
    return principals.join(live, ["principal_type", "principal_id"]).select("user_id", "role_name").distinct()


def permissions(principals: DataFrame, assigned: DataFrame, at: Column) -> DataFrame:
    """(user_id, permission) from the system roles in force."""
    return held_roles(principals, assigned, at).join(F.broadcast(role_table(principals.sparkSession)), "role_name").select("user_id", "permission").distinct()  # a fixed table of 50 rows


def in_force(grants: DataFrame, at: Column) -> DataFrame:
    return grants.filter(~F.col("revoked") & valid(at, F.col("valid_from"), F.col("valid_until")))


def _mask(action: Column, actions: tuple) -> Column:
    """A bit for each of `actions` that the column names, all for `*`."""
    return reduce(Column.bitwiseOR, [F.when(action.isin("*", a), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, a in enumerate(actions)])


def _either(deny: str = "deny", allow: str = "allow") -> list[Column]:
    return [F.bit_or(deny).alias("deny"), F.bit_or(allow).alias("allow")]


def standing(principals: DataFrame, held: DataFrame, grants: DataFrame, actions: tuple, at: Column) -> tuple[DataFrame, DataFrame]:
    """(people, named): what the grants in force say about `actions`, a bit each, without a product of members and grants.

    people: user_id, gate (what its roles hold), own (it is a principal of its own), groups (its other principals) and wide
    (type or `*` to the deny and allow of its grants for all resources). named: the grants for one resource, still their
    principal's: principal_type, principal_id, resource_type (may be `*`), resource_id, deny, allow.
    """
    mask = F.col("_mask")
    live = in_force(grants, at).withColumn("_mask", _mask(F.col("action"), actions)).filter("_mask <> 0 and resource_type is not null and resource_id is not null")
    side = lambda effect: F.when(F.col("effect") == effect, mask).otherwise(0)
    each = live.select("principal_type", "principal_id", "resource_type", "resource_id", side("deny").alias("deny"), side("allow").alias("allow"))
    each = each.groupBy("principal_type", "principal_id", "resource_type", "resource_id").agg(*_either())
    wide = principals.join(each.filter("resource_id = '*'"), ["principal_type", "principal_id"]).groupBy("user_id", "resource_type").agg(*_either())
    wide = wide.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("resource_type", F.struct("deny", "allow")))).alias("wide"))  # a row a type
    gate = held.select("user_id", _mask(F.col("permission"), actions).alias("gate")).filter("gate <> 0").groupBy("user_id").agg(F.bit_or("gate").alias("gate"))
    own = (F.col("principal_type") == "user") & (F.col("principal_id") == F.col("user_id"))
    people = principals.groupBy("user_id").agg(F.bool_or(own).alias("own"), F.sort_array(F.collect_set(F.when(~own, F.struct("principal_type", "principal_id")))).alias("groups"))
    return people.join(gate, "user_id").join(wide, "user_id", "left"), each.filter("resource_id <> '*'")


def _for_all(side: str, kind: Column) -> Column:
    """The bits that a person's grants for all resources of a type set on one side."""
    got = [F.coalesce(F.try_element_at("wide", k)[side], F.lit(0).cast("long")) for k in (kind, F.lit("*"))]
    return got[0].bitwiseOR(got[1])


def judged(asked: DataFrame, people: DataFrame, named: DataFrame) -> DataFrame:
    """`asked` (user_id, resource_type, resource_id and others) with gate, deny, allow and wide; gate is null for strangers.

    `named` gives the type of each grant. Groups answer once for a resource, however many of their members ask for it.
    """
    key = ["resource_type", "resource_id"]
    j = asked.join(people, "user_id", "left")
    mine = named.filter("principal_type = 'user'").select(F.col("principal_id").alias("user_id"), *key, F.col("deny").alias("_deny"), F.col("allow").alias("_allow"))
    sets = j.filter("size(groups) > 0").select("groups", *key).distinct().select("groups", *key, F.explode("groups").alias("g")).select("groups", *key, "g.*")
    theirs = sets.join(named, ["principal_type", "principal_id", *key]).groupBy("groups", *key).agg(F.bit_or("deny").alias("_denied"), F.bit_or("allow").alias("_allowed"))
    j = j.join(mine, ["user_id", *key], "left").join(theirs, ["groups", *key], "left")
    none = F.lit(0).cast("long")

    def side(name: str, own: str, others: str) -> Column:
        return _for_all(name, F.col("resource_type")).bitwiseOR(F.when(F.col("own"), F.coalesce(own, none)).otherwise(none)).bitwiseOR(F.coalesce(others, none))

    return j.select(*asked.columns, "gate", "wide", side("deny", "_deny", "_denied").alias("deny"), side("allow", "_allow", "_allowed").alias("allow"))


def _has(bits: int, gate: Column, deny: Column, allow: Column) -> Column:
    b = F.lit(bits).cast("long")
    return F.coalesce((gate.bitwiseAND(b) == b) & (deny.bitwiseAND(b) == 0) & (allow.bitwiseAND(b) == b), F.lit(False))


def _on_resources(requests: DataFrame, principals: DataFrame, held: DataFrame, resources: DataFrame, grants: DataFrame, actions: tuple, at: Column) -> DataFrame:
    """`requests` as judged, with _owners: an array for active resources, else null. A grant for `*` as type goes to the types of its resource."""
    active = resources.filter("active").groupBy("resource_type", "resource_id").agg(F.collect_set("owner").alias("_owners"))
    people, named = standing(principals, held, grants, actions, at)
    typed = named.filter("resource_type = '*'").drop("resource_type").join(active.select("resource_type", "resource_id"), "resource_id")
    named = named.filter("resource_type <> '*'").unionByName(typed).groupBy("principal_type", "principal_id", "resource_type", "resource_id").agg(*_either())
    return judged(requests, people, named).join(active, ["resource_type", "resource_id"], "left")


def can(requests: DataFrame, principals: DataFrame, held: DataFrame, resources: DataFrame, grants: DataFrame, action: str, at: Column) -> DataFrame:
    """`requests` (user_id, resource_type, resource_id and others) with `allowed`, for one action.

    Allowed are active users whose roles hold the action, on active resources that a grant in force allows and none
    denies; a grant may name `*` for the type, the resource or the action. An owner may read its own traces.
    """
    j = _on_resources(requests, principals, held, resources, grants, (action,), at)
    own = (F.col("resource_type") == "trace") & F.lit(action == "trace.read_own") & F.coalesce(F.array_contains("_owners", F.col("user_id")), F.lit(False))
    allow = F.when(own, F.lit(1).cast("long")).otherwise(F.col("allow"))
    return j.withColumn("allowed", F.col("_owners").isNotNull() & _has(1, F.col("gate"), F.col("deny"), allow)).select(*requests.columns, "allowed")


def has_permission(principals: DataFrame, held: DataFrame, grants: DataFrame, action: str, at: Column) -> DataFrame:
    """user_id of those who hold the action for all resources: by a role, and by a `*` grant of its type that nothing denies."""
    people, _ = standing(principals, held, grants, (action,), at)
    kind = F.lit(action.split(".")[0])
    return people.filter(_has(1, F.col("gate"), _for_all("deny", kind), _for_all("allow", kind))).select("user_id")


class Scope(NamedTuple):
    """Who may do all of some actions on which documents, before the resources are looked at; `every` has a bit for each action."""

    people: DataFrame
    named: DataFrame
    every: int


def document_scope(principals: DataFrame, held: DataFrame, grants: DataFrame, at: Column, actions: tuple = DOCUMENT_ACTIONS) -> Scope:
    """The scope of all of `actions`: grants stay their principals', so neither users nor groups are multiplied by documents."""
    people, named = standing(principals, held, grants, actions, at)
    named = named.filter(F.col("resource_type").isin("*", "document")).groupBy("principal_type", "principal_id", "resource_id").agg(*_either())
    every = (1 << len(actions)) - 1
    return Scope(people.filter(F.col("gate") == every), named.withColumn("resource_type", F.lit("document")), every)


def in_scope(asked: DataFrame, scope: Scope) -> DataFrame:
    """The rows of `asked` (user_id, resource_id and others) that a scope allows; resources are the caller's to check."""
    j = judged(asked.withColumn("resource_type", F.lit("document")), scope.people, scope.named)
    return j.filter(_has(scope.every, F.col("gate"), F.col("deny"), F.col("allow"))).select(*asked.columns)


def scope_sizes(users: DataFrame, scope: Scope, documents: DataFrame) -> DataFrame:
    """(user_id, n_documents): how many of `documents` (resource_id of active ones) a scope allows each user, without listing them.

    Each set of groups counts its documents by what their grants say, which takes few values; a user's own grants correct that.
    """
    kind, none, every = F.lit("document"), F.lit(0).cast("long"), F.lit(scope.every).cast("long")
    docs = documents.select("resource_id")
    people = scope.people.select("user_id", "own", "groups", _for_all("deny", kind).alias("deny"), _for_all("allow", kind).alias("allow"))
    sets = people.filter("size(groups) > 0").select("groups").distinct().select("groups", F.explode("groups").alias("g")).select("groups", "g.*")
    theirs = sets.join(scope.named, ["principal_type", "principal_id"]).groupBy("groups", "resource_id").agg(F.bit_or("deny").alias("_denied"), F.bit_or("allow").alias("_allowed"))
    counts = theirs.join(docs, "resource_id").groupBy("groups", "_denied", "_allowed").agg(F.count("*").alias("n"))
    counts = counts.groupBy("groups").agg(F.collect_list(F.struct("_denied", "_allowed", "n")).alias("counts"), F.sum("n").alias("named"))  # 4 to the power of the actions at most
    total = documents.agg(F.count("*").alias("total"))
    yes = lambda deny, allow: (deny == 0) & (allow.bitwiseAND(every) == every)
    j = people.join(counts, "groups", "left").crossJoin(F.broadcast(total))  # one row
    of_groups = F.aggregate(
        F.coalesce("counts", F.array().cast("array<struct<_denied:bigint,_allowed:bigint,n:bigint>>")), none,
        lambda n, c: n + F.when(yes(F.col("deny").bitwiseOR(c["_denied"]), F.col("allow").bitwiseOR(c["_allowed"])), c["n"]).otherwise(0),
    )
    rest = F.when(yes(F.col("deny"), F.col("allow")), F.col("total") - F.coalesce("named", none)).otherwise(0)
    j = j.select("user_id", (of_groups + rest).alias("_n"))
    mine = scope.named.filter("principal_type = 'user'").select(F.col("principal_id").alias("user_id"), "resource_id", F.col("deny").alias("_deny"), F.col("allow").alias("_allow"))
    own = people.filter("own").join(mine.join(docs, "resource_id"), "user_id").join(theirs, ["groups", "resource_id"], "left")
    deny, allow = F.col("deny").bitwiseOR(F.coalesce("_denied", none)), F.col("allow").bitwiseOR(F.coalesce("_allowed", none))
    change = yes(deny.bitwiseOR(F.col("_deny")), allow.bitwiseOR(F.col("_allow"))).cast("long") - yes(deny, allow).cast("long")
    own = own.groupBy("user_id").agg(F.sum(change).alias("_change"))
    met = users.select("user_id").join(j, "user_id", "left").join(own, "user_id", "left")
    return met.select("user_id", (F.coalesce("_n", none) + F.coalesce("_change", none)).cast("long").alias("n_documents"))


def reauthorized(dependencies: DataFrame, principals: DataFrame, held: DataFrame, resources: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """`dependencies` (answer, user_id, resource_type, resource_id, opened) with `allowed`: what delivery checks afresh.

    A document must be searchable, readable and citable; a role entry readable by one who may search roles; a video's
    metadata readable by one who may search videos, and the video openable if the answer holds its address. Whoever may
    not ask has nothing; other types are never allowed. All actions are judged in one pass.
    """
    actions = (*DOCUMENT_ACTIONS, "org_role.read", "video.metadata.read", "video.open", "org_role.search", "video.search", "question.ask")
    j = _on_resources(dependencies, principals, held, resources, grants, actions, at)

    def on_it(*names: str) -> Column:
        return _has(sum(1 << actions.index(n) for n in names), F.col("gate"), F.col("deny"), F.col("allow"))

    def on_all(name: str) -> Column:
        kind = F.lit(name.split(".")[0])
        return _has(1 << actions.index(name), F.col("gate"), _for_all("deny", kind), _for_all("allow", kind))

    kind = F.col("resource_type")
    rule = F.when(kind == "document", on_it(*DOCUMENT_ACTIONS)).when(kind == "org_role", on_it("org_role.read") & on_all("org_role.search"))
    rule = rule.when(kind == "video", on_it("video.metadata.read") & on_all("video.search") & (~F.coalesce("opened", F.lit(False)) | on_it("video.open"))).otherwise(False)
    return j.withColumn("allowed", F.col("_owners").isNotNull() & on_all("question.ask") & rule).select(*dependencies.columns, "allowed")


def revised(writes: DataFrame, order: str, key: list[str], block: int = 100_000) -> DataFrame:
    """`writes` with revision (1, 2, ... in order) and last: whether no later write has the key. `order` is a unique integer.

    Revisions are numbered within blocks of the order and shifted by the blocks before, so that no task holds all writes.
    """
    b = writes.withColumn("_b", F.floor(F.col(order) / block))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = b.groupBy("_b").agg(F.count("*").alias("n")).select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # one row a block
    own = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    newest = writes.groupBy(*key).agg(F.max(order).alias("_newest"))
    j = b.withColumn("_own", own).join(shift, "_b").join(newest, key)
    return j.select(*writes.columns, (F.col("_own") + F.col("shift")).cast("long").alias("revision"), (F.col(order) == F.col("_newest")).alias("last"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The row of each key that comes last: an upsert's result."""
    value = F.struct(*[c for c in rows.columns if c not in key])
    g = rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("v"))
    return g.select(*key, "v.*")


def added_users(requests: DataFrame, existing: DataFrame, block: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The writes that requests to add users come to, and the requests that are refused.

    requests: nth (a unique integer, their order), actor, user, name, role; existing: user. A new user is written, gets its
    role, and may ask questions of anything, which alone shows it no document. Writes: nth, actor, user, step (1 to 3),
    kind, value, revision (one a write, in order: also the number of its audit entry) and last (of its kind and user).
    Refused: nth, user and issue (user_exists, also for all but the first request for a user; unknown_role).
    """
    first = F.min("nth").over(Window.partitionBy("user"))
    known = existing.select("user").distinct().withColumn("there", F.lit(True))
    j = requests.withColumn("first", first).join(known, "user", "left")
    issue = F.when(~F.coalesce(F.col("role").isin(*ROLE_PERMISSIONS), F.lit(False)), "unknown_role").when(F.col("there") | (F.col("nth") > F.col("first")), "user_exists")
    j = j.withColumn("issue", issue)
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), value.alias("value")) for k, (kind, value) in enumerate((("user", F.col("name")), ("role", F.col("role")), ("grant", F.lit("*:*:question.ask"))), 1)])
    writes = j.filter("issue is null").select("nth", "actor", "user", F.inline(steps)).withColumn("order", F.col("nth") * 3 + F.col("step"))
    return revised(writes, "order", ["user", "kind"], block).drop("order"), j.filter("issue is not null").select("nth", "user", "issue")
