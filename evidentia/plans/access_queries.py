"""Queries over access control. Users are customers, groups nations, resources suppliers; grants and answers derive from orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import access as a
from .registry import query

#: The fixture in SQL: grants are valid a year from the order's date; some name `*` for the type, the resource or the
#: action, some deny, some are revoked. Roles belong to users and groups, and some have run out.
_FIX = """
u AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS user_id, c_acctbal > 0 AS active FROM customer),
m AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS user_id, 'g' || CAST(c_nationkey AS VARCHAR) AS group_id FROM customer WHERE c_nationkey % 6 <> 0 AND c_custkey % 8 <> 5),
pk AS (SELECT user_id, 'user' AS pt, user_id AS pid FROM u WHERE active UNION SELECT m.user_id, 'group', group_id FROM m JOIN u USING (user_id) WHERE active),
ro AS (SELECT 'user' AS pt, 'u' || CAST(c_custkey AS VARCHAR) AS pid, CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'researcher' ELSE 'guest' END AS role_name FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 9 <> 0
  UNION ALL SELECT 'group', 'g' || CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 12 = 1 THEN 'administrator' ELSE 'trace_auditor' END FROM nation WHERE n_nationkey % 4 = 1),
pe AS (SELECT DISTINCT user_id, role_name, permission FROM pk JOIN ro USING (pt, pid) JOIN (VALUES ROLES) rp(role_name, permission) USING (role_name)),
res AS (SELECT CASE s_suppkey % 4 WHEN 2 THEN 'video' WHEN 3 THEN 'org_role' ELSE 'document' END AS rt, 's' || CAST(s_suppkey AS VARCHAR) AS rid, s_acctbal > 0 AS active FROM supplier),
gr AS (SELECT o_orderkey AS grant_id, CASE WHEN o_custkey % 3 = 0 THEN 'user' ELSE 'group' END AS pt,
  CASE WHEN o_custkey % 3 = 0 THEN 'u' || CAST(o_custkey AS VARCHAR) ELSE 'g' || CAST(o_custkey % 25 AS VARCHAR) END AS pid,
  CASE WHEN o_orderkey % 13 = 0 THEN '*' ELSE rt END AS rt, CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE rid END AS rid,
  CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 11 <> 0 OR o_orderkey % 1001 = 0 THEN 'deny' ELSE 'allow' END AS effect,
  CASE WHEN o_orderkey % 5 < 2 THEN '*' WHEN rt = 'document' THEN CASE o_orderkey % 3 WHEN 0 THEN 'document.search' WHEN 1 THEN 'document.read' ELSE 'document.cite' END
       WHEN rt = 'video' THEN CASE o_orderkey % 3 WHEN 0 THEN 'video.search' WHEN 1 THEN 'video.metadata.read' ELSE 'video.open' END
       ELSE CASE o_orderkey % 2 WHEN 0 THEN 'org_role.search' ELSE 'org_role.read' END END AS action
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN res ON rid = 's' || CAST(l_suppkey AS VARCHAR)
  WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate + INTERVAL 365 DAY > TIMESTAMP '1996-06-01'),
dep AS (SELECT DISTINCT l_orderkey AS answer, 'u' || CAST(o_custkey AS VARCHAR) AS user_id, rt, rid, l_linenumber = 2 AS opened FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN res ON rid = 's' || CAST(l_suppkey AS VARCHAR))
""".replace("ROLES", ", ".join(f"('{k}', '{v}')" for k, vs in a.ROLE_PERMISSIONS.items() for v in vs))


def _rule(name: str, requests: str, action: str) -> str:
    """A relation of the requests (user_id, rt, rid) that the rule for one action allows, written from the rule itself."""
    return f"""{name} AS (SELECT q.user_id, q.rt, q.rid FROM (SELECT DISTINCT user_id, rt, rid FROM {requests}) q JOIN res ON res.rt = q.rt AND res.rid = q.rid AND res.active JOIN pk ON pk.user_id = q.user_id
  JOIN gr ON gr.pt = pk.pt AND gr.pid = pk.pid AND gr.rt IN ('*', q.rt) AND gr.rid IN ('*', q.rid) AND gr.action IN ('*', '{action}')
  WHERE EXISTS (SELECT 1 FROM pe WHERE pe.user_id = q.user_id AND pe.permission IN ('*', '{action}')) GROUP BY ALL HAVING NOT bool_or(effect = 'deny'))"""


def _wide(name: str, action: str) -> str:
    """A relation of the users who hold an action for all resources."""
    return f"""{name} AS (SELECT pk.user_id FROM pk JOIN gr USING (pt, pid) WHERE gr.rid = '*' AND gr.rt IN ('*', '{action.split(".")[0]}') AND gr.action IN ('*', '{action}')
  AND EXISTS (SELECT 1 FROM pe WHERE pe.user_id = pk.user_id AND pe.permission IN ('*', '{action}')) GROUP BY pk.user_id HAVING NOT bool_or(effect = 'deny'))"""


#: A user's documents for one action: nothing if a grant denies `*`, else those that a grant names (or all) less those denied.
_DOCS = """{name} AS (SELECT user_id, d.rid FROM
  (SELECT pk.user_id, list(DISTINCT gr.rid) FILTER (effect = 'deny') AS denied, list(DISTINCT gr.rid) FILTER (effect = 'allow') AS named FROM pk JOIN gr USING (pt, pid)
   WHERE gr.rt IN ('*', 'document') AND gr.action IN ('*', '{action}') AND EXISTS (SELECT 1 FROM pe WHERE pe.user_id = pk.user_id AND pe.permission IN ('*', '{action}')) GROUP BY pk.user_id) s
  JOIN res d ON d.rt = 'document' AND d.active AND NOT list_contains(coalesce(denied, []), '*') AND (list_contains(named, '*') OR list_contains(named, d.rid)) AND NOT list_contains(coalesce(denied, []), d.rid))"""
_SCOPES = ", ".join(_DOCS.format(name=f"d{k}", action=x) for k, x in enumerate(a.DOCUMENT_ACTIONS))
_BOTH = "s AS (SELECT * FROM d0 INTERSECT SELECT * FROM d1 INTERSECT SELECT * FROM d2)"


def _at():
    return F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")


def _id(lead: str, c: str):
    return F.concat(F.lit(lead), F.col(c).cast("string"))


def _users(x):
    return x.customer.select(_id("u", "c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))


def _memberships(x):
    """Every eighth membership has ended."""
    ended = F.when(F.col("c_custkey") % 8 == 5, F.lit("1996-01-01").cast("timestamp_ntz"))
    return x.customer.select(
        _id("u", "c_custkey").alias("user_id"), _id("g", "c_nationkey").alias("group_id"), (F.col("c_nationkey") % 6 != 0).alias("group_active"), F.lit(None).cast("timestamp_ntz").alias("valid_from"), ended.alias("valid_until"),
    )


def _roles(x):
    key, none = F.col("c_custkey"), F.lit(None).cast("timestamp_ntz")
    ended = F.when(key % 9 == 0, F.lit("1996-01-01").cast("timestamp_ntz"))
    own = x.customer.filter(key % 4 != 3).select(
        F.lit("user").alias("principal_type"), _id("u", "c_custkey").alias("principal_id"), F.when(key % 4 == 0, "viewer").when(key % 4 == 1, "researcher").otherwise("guest").alias("role_name"), none.alias("valid_from"), ended.alias("valid_until"),
    )
    n = F.col("n_nationkey")
    groups = x.nation.filter(n % 4 == 1).select(F.lit("group"), _id("g", "n_nationkey"), F.when(n % 12 == 1, "administrator").otherwise("trace_auditor"), none, none)
    return own.union(groups)


def _resources(x):
    kind = F.when(F.col("s_suppkey") % 4 == 2, "video").when(F.col("s_suppkey") % 4 == 3, "org_role").otherwise("document")
    return x.supplier.select(kind.alias("resource_type"), _id("s", "s_suppkey").alias("resource_id"), (F.col("s_acctbal") > 0).alias("active"), F.lit(None).cast("string").alias("owner"))


def _grants(x):
    key, user = F.col("o_orderkey"), F.col("o_custkey") % 3 == 0
    first = x.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), _id("s", "l_suppkey").alias("rid"))
    o = x.orders.join(first, "o_orderkey").join(_resources(x).select(F.col("resource_id").alias("rid"), F.col("resource_type").alias("rt")), "rid")
    third = lambda *names: F.when(key % 3 == 0, names[0]).when(key % 3 == 1, names[1]).otherwise(names[2])
    action = F.when(F.col("rt") == "document", third("document.search", "document.read", "document.cite")).when(F.col("rt") == "video", third("video.search", "video.metadata.read", "video.open"))
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        key.alias("grant_id"), F.when(user, "user").otherwise("group").alias("principal_type"),
        F.when(user, _id("u", "o_custkey")).otherwise(F.concat(F.lit("g"), (F.col("o_custkey") % 25).cast("string"))).alias("principal_id"),
        F.when(key % 13 == 0, "*").otherwise(F.col("rt")).alias("resource_type"), F.when(key % 11 == 0, "*").otherwise(F.col("rid")).alias("resource_id"),
        F.when((key % 17 == 0) & (key % 11 != 0) | (key % 1001 == 0), "deny").otherwise("allow").alias("effect"),
        F.when(key % 5 < 2, "*").otherwise(F.coalesce(action, F.when(key % 2 == 0, "org_role.search").otherwise("org_role.read"))).alias("action"),
        start.alias("valid_from"), (start + F.expr("INTERVAL '365' DAY")).alias("valid_until"), (F.col("o_orderstatus") == "P").alias("revoked"),
    )


def _dependencies(x):
    """An order is an answer for its customer; its lines' suppliers are what it depends on, the second line's was opened."""
    o = x.lineitem.join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("answer"), _id("u", "o_custkey").alias("user_id"), _id("s", "l_suppkey").alias("resource_id"), (F.col("l_linenumber") == 2).alias("opened"))
    return o.join(_resources(x).select("resource_id", "resource_type"), "resource_id").distinct()


def _principals(x):
    return a.principal_keys(_users(x), _memberships(x), _at())


def _held(x):
    return a.permissions(_principals(x), _roles(x), _at())


def _scope(x, actions=a.DOCUMENT_ACTIONS):
    return a.document_scope(_principals(x), _held(x), _grants(x), _at(), actions)


def _documents(x):
    return _resources(x).filter("active and resource_type = 'document'")


@query("PF4 PF5", f"WITH {_FIX} SELECT grant_id, pt AS principal_type, pid AS principal_id, rt AS resource_type, rid AS resource_id, effect FROM gr WHERE action IN ('*', 'document.read') AND rt IN ('*', 'document')")
def grants_in_force(x):
    """Grants that hold for reading documents at one instant, with `*` for type, resource or action."""
    g = a.in_force(_grants(x), _at()).filter(F.col("action").isin("*", "document.read") & F.col("resource_type").isin("*", "document"))
    return g.select("grant_id", "principal_type", "principal_id", "resource_type", "resource_id", "effect")


@query("AC1 J7 J8 S11 AC7", f"""WITH {_FIX}, k AS (SELECT user_id, count(*) AS n_keys, max(CASE WHEN pt = 'group' THEN pid END) AS group_id FROM pk GROUP BY user_id),
p AS (SELECT user_id, count(DISTINCT permission) AS n_permissions, string_agg(DISTINCT role_name, ',' ORDER BY role_name) AS roles FROM pe GROUP BY user_id)
SELECT k.user_id, n_keys, group_id, coalesce(n_permissions, 0) AS n_permissions, coalesce(roles, '') AS roles FROM k LEFT JOIN p USING (user_id)""")
def principal_snapshot(x):
    """Keys, groups, system roles and permissions of every active user."""
    k = _principals(x).groupBy("user_id").agg(F.count("*").alias("n_keys"), F.max(F.when(F.col("principal_type") == "group", F.col("principal_id"))).alias("group_id"))
    roles = a.held_roles(_principals(x), _roles(x), _at()).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("role_name")), ",").alias("roles"))
    n = _held(x).groupBy("user_id").agg(F.count("*").alias("n_permissions"))
    return k.join(n, "user_id", "left").join(roles, "user_id", "left").select("user_id", "n_keys", "group_id", F.coalesce("n_permissions", F.lit(0)).cast("long").alias("n_permissions"), F.coalesce("roles", F.lit("")).alias("roles"))


@query("AC2 J9 S3", f"WITH {_FIX}, {_rule('ok', 'dep', 'document.read')} SELECT answer, user_id, rt AS resource_type, rid AS resource_id, opened, ok.user_id IS NOT NULL AS allowed FROM dep LEFT JOIN ok USING (user_id, rt, rid)")
def can_requests(x):
    """Whether each answer's reader may read what it depends on: requested pairs only."""
    return a.can(_dependencies(x), _principals(x), _held(x), _resources(x), _grants(x), "document.read", _at()).select("answer", "user_id", "resource_type", "resource_id", "opened", "allowed")


_HELD = ("question.ask", "document.read", "video.search", "org_role.search")


@query("AC3 J8", f"WITH {_FIX}, " + ", ".join(_wide(f"w{k}", x) for k, x in enumerate(_HELD)) + " " + " UNION ALL ".join(f"SELECT user_id, '{x}' AS action FROM w{k}" for k, x in enumerate(_HELD)))
def held_for_all(x):
    """Who holds an action for every resource: a role's permission, a `*` grant and no denial of one."""
    keys, held, grants = _principals(x), _held(x), _grants(x)
    out = None
    for action in _HELD:
        own = a.has_permission(keys, held, grants, action, _at()).withColumn("action", F.lit(action))
        out = own if out is None else out.unionByName(own)
    return out


@query("AC4 J10 J6", f"WITH {_FIX}, {_SCOPES} SELECT user_id, count(d1.rid) AS n_documents FROM u LEFT JOIN d1 USING (user_id) GROUP BY user_id")
def allowed_documents(x):
    """How many documents each user may read: wildcards stay symbolic."""
    return a.scope_sizes(_users(x), _scope(x, ("document.read",)), _documents(x))


@query("S1 PF3", f"WITH {_FIX}, {_SCOPES}, {_BOTH} SELECT user_id, count(s.rid) AS n_documents FROM u LEFT JOIN s USING (user_id) GROUP BY user_id")
def scope_intersection(x):
    """How many documents each user may search, read and cite."""
    return a.scope_sizes(_users(x), _scope(x), _documents(x))


@query("J14 AC8", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_registrations(x):
    return x.customer.join(x.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("AC5 J15 A11 J2", """
SELECT p_partkey AS resource_id, CASE WHEN p_partkey % 2 = 0 THEN (SELECT max(s_name) FROM supplier WHERE s_nationkey = p_size % 25) ELSE (SELECT max(n_name) FROM nation WHERE n_nationkey = p_size % 25) END AS title FROM part""")
def resource_listing(x):
    """Titles from two tables by type: correlated scalar subqueries as left joins."""
    k = (F.col("p_size") % 25).alias("k")
    one = x.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("one"))
    two = x.nation.groupBy(F.col("n_nationkey").alias("k")).agg(F.max("n_name").alias("two"))
    p = x.part.select("p_partkey", k).join(one, "k", "left").join(two, "k", "left")
    return p.select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("one")).otherwise(F.col("two")).alias("title"))


@query("W17 AC5 D14", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def audit_page(x):
    """Keyset paging (the limit is the feature)."""
    return x.events.filter("event_id > 100").orderBy("event_id").limit(50).select("event_id", "event_type")


@query("AC10", """
WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 3 AS revision FROM events), c AS (SELECT *, revision <> coalesce(lag(revision) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS changed FROM e)
SELECT user_id, event_id, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session_no FROM c""")
def session_invalidation(x):
    """A session ends where the authorization revision changes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = x.events.select("user_id", "event_id", (F.floor("value") % 3).alias("revision"))
    c = e.withColumn("changed", F.col("revision") != F.coalesce(F.lag("revision").over(w), F.lit(-1)))
    return c.select("user_id", "event_id", F.sum(F.col("changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no"))


@query("SK3 AC6 DV7", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def upsert_latest(x):
    return a.latest(x.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


_OPEN = {"document.search": "c0", "document.read": "c1", "document.cite": "c2", "org_role.read": "c3", "video.metadata.read": "c4", "video.open": "c5"}
_CHECK = f"""WITH {_FIX}, {", ".join(_rule(v, "dep", k) for k, v in _OPEN.items())}, {_wide("ask", "question.ask")}, {_wide("vs", "video.search")}, {_wide("os", "org_role.search")},
x AS (SELECT *, user_id IN (SELECT user_id FROM ask) AND CASE rt
  WHEN 'document' THEN (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c0) AND (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c1) AND (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c2)
  WHEN 'org_role' THEN user_id IN (SELECT user_id FROM os) AND (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c3)
  WHEN 'video' THEN user_id IN (SELECT user_id FROM vs) AND (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c4) AND (NOT opened OR (user_id, rt, rid) IN (SELECT user_id, rt, rid FROM c5))
  ELSE false END AS ok FROM dep)"""


def _checked(x):
    return a.reauthorized(_dependencies(x), _principals(x), _held(x), _resources(x), _grants(x), _at())


@query("S8 AC9 S5 C11 C17", _CHECK + " SELECT answer, count(*) AS n, count(*) FILTER (NOT ok) AS missing, bool_and(ok) AS released FROM x GROUP BY answer")
def reauthorize_answers(x):
    """Each answer's dependencies as delivery checks them for its reader, by the rules of their type."""
    d = _checked(x).groupBy("answer").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("missing"))
    return d.withColumn("released", F.col("missing") == 0)


@query("J31", f"""WITH {_FIX}, {_SCOPES}, c AS (SELECT user_id, rid, 'page' AS via FROM dep WHERE rt = 'document' UNION SELECT 'u' || CAST(o_custkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR), 'exact' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
n AS (SELECT user_id, rid, string_agg(DISTINCT via, ',' ORDER BY via) AS via FROM c GROUP BY ALL)
SELECT user_id, rid AS resource_id, via FROM n JOIN d0 USING (user_id, rid) WHERE (user_id, rid) NOT IN (SELECT user_id, rid FROM dep WHERE opened)""")
def unread_candidates(x):
    """Documents that a reader's pages or exact matches name, may be found, and have not been read."""
    dep = _dependencies(x)
    exact = x.lineitem.filter("l_returnflag = 'A'").join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_id("u", "o_custkey").alias("user_id"), _id("s", "l_suppkey").alias("resource_id"), F.lit("exact").alias("via"))
    both = dep.filter("resource_type = 'document'").select("user_id", "resource_id", F.lit("page").alias("via")).unionByName(exact)
    named = both.groupBy("user_id", "resource_id").agg(F.array_join(F.sort_array(F.collect_set("via")), ",").alias("via"))
    named = named.join(_documents(x).select("resource_id"), "resource_id", "left_semi").join(dep.filter("opened").select("user_id", "resource_id"), ["user_id", "resource_id"], "left_anti")
    return a.in_scope(named, _scope(x, ("document.search",))).select("user_id", "resource_id", "via")


@query("PF13", f"WITH {_FIX}, {_rule('ok', 'dep', 'video.open')} SELECT DISTINCT dep.user_id, dep.rid AS resource_id, CASE WHEN ok.user_id IS NOT NULL THEN 'https://media.example/' || dep.rid ELSE '' END AS uri FROM dep LEFT JOIN ok USING (user_id, rt, rid) WHERE rt = 'video'")
def video_locators(x):
    """The address of each video that an answer names, blank for readers who may not open it."""
    asked = _dependencies(x).filter("resource_type = 'video'").select("user_id", "resource_type", "resource_id").distinct()
    out = a.can(asked, _principals(x), _held(x), _resources(x), _grants(x), "video.open", _at())
    return out.select("user_id", "resource_id", F.when(F.col("allowed"), F.concat(F.lit("https://media.example/"), "resource_id")).otherwise("").alias("uri"))


@query("PF14", f"""WITH {_FIX}, seg AS (SELECT 'g' || CAST(c_nationkey AS VARCHAR) AS grp, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS aliases FROM customer GROUP BY c_nationkey)
SELECT u.user_id, CASE WHEN EXISTS (SELECT 1 FROM pe WHERE pe.user_id = u.user_id AND permission IN ('*', 'identity.manage', 'org_role.read')) THEN aliases ELSE '' END AS aliases FROM u JOIN customer ON user_id = 'u' || CAST(c_custkey AS VARCHAR) JOIN seg ON grp = 'g' || CAST(c_nationkey AS VARCHAR)""")
def visible_aliases(x):
    """Aliases of each user's group, for those only who manage identities or may read roles."""
    seg = x.customer.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), " | ").alias("aliases"))
    may = _held(x).filter(F.col("permission").isin("*", "identity.manage", "org_role.read")).select("user_id").distinct().withColumn("may", F.lit(True))
    rows = x.customer.join(seg, "c_nationkey").select(_id("u", "c_custkey").alias("user_id"), "aliases").join(may, "user_id", "left")
    return rows.select("user_id", F.when(F.col("may"), F.col("aliases")).otherwise("").alias("aliases"))


@query("H6", f"""WITH {_FIX}, r AS (SELECT user_id, string_agg(DISTINCT '"' || role_name || '"', ', ' ORDER BY '"' || role_name || '"') AS roles FROM pe GROUP BY user_id), g AS (SELECT user_id, string_agg('"' || pid || '"', ', ' ORDER BY pid) FILTER (pt = 'group') AS groups FROM pk GROUP BY user_id)
SELECT g.user_id, sha256('{{"groups": [' || coalesce(groups, '') || '], "roles": [' || coalesce(roles, '') || '], "user": "' || g.user_id || '"}}') AS scope_hash FROM g LEFT JOIN r USING (user_id)""")
def scope_hashes(x):
    """A digest of what decides a user's scope: the user, its groups and its roles, as canonical JSON."""
    keys = _principals(x)
    groups = keys.groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(F.col("principal_type") == "group", F.col("principal_id")))).alias("groups"))
    roles = a.held_roles(keys, _roles(x), _at()).groupBy("user_id").agg(F.sort_array(F.collect_set("role_name")).alias("roles"))
    j = groups.join(roles, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    return j.select("user_id", t.canonical_digest({"user": t.json_text(F.col("user_id")), "groups": t.json_list(F.col("groups")), "roles": t.json_list(F.col("roles"))}).alias("scope_hash"))


@query("AC6", """
WITH w AS (SELECT o_orderkey AS write, o_custkey % 400 AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'revoke' ELSE 'grant' END AS action FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY write) AS revision FROM w)
SELECT write, subject, action, revision, action = 'grant' AND write = max(write) OVER (PARTITION BY subject) AS in_force FROM r""")
def write_log(x):
    """Every write has the next revision and its row of audit; what holds for a subject is its last write."""
    w = x.orders.select(F.col("o_orderkey").alias("write"), (F.col("o_custkey") % 400).alias("subject"), F.when(F.col("o_orderkey") % 3 == 0, "revoke").otherwise("grant").alias("action"))
    return a.revised(w, "write", ["subject"]).withColumn("in_force", F.col("last") & (F.col("action") == "grant")).drop("last")


@query("AC7 J8", "SELECT role_name, permission FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in a.ROLE_PERMISSIONS.items() for v in vs) + ") t(role_name, permission)")
def role_matrix(x):
    return a.role_table(x.spark)
