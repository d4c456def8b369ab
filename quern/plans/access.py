"""Queries over access lists, folders, tags and other relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import access as A
from quern.operators import retrieval as R
from quern.plans import bindings as B

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_UP = "up AS (SELECT folder_id, folder_id AS ancestor_id, 0 AS depth FROM folders UNION ALL SELECT u.folder_id, f.parent_id, u.depth + 1 FROM up u JOIN folders f ON f.folder_id = u.ancestor_id WHERE f.parent_id IS NOT NULL AND u.depth < 20)"
_EFFECTIVE = """found AS (
  SELECT d.document_id, g.principal, 'document' AS source, 0 AS priority FROM placed_documents d JOIN grants g ON g.resource_type = 'document' AND g.resource_id = CAST(d.document_id AS VARCHAR) AND g.permission = 'read'
  UNION ALL SELECT d.document_id, g.principal, 'folder', 10 + u.depth FROM placed_documents d JOIN up u ON u.folder_id = d.folder_id JOIN grants g ON g.resource_type = 'folder' AND g.resource_id = CAST(u.ancestor_id AS VARCHAR)
  UNION ALL SELECT d.document_id, g.principal, 'space', 100 FROM placed_documents d JOIN grants g ON g.resource_type = 'space' AND g.resource_id = d.space_id),
effective AS (SELECT document_id, principal, source, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY document_id, principal ORDER BY priority) AS n FROM found) WHERE n = 1
  UNION ALL SELECT document_id, owner, 'owner', 1000 FROM placed_documents WHERE document_id NOT IN (SELECT document_id FROM found))"""


@query(B.with_(B.FOLDERS, B.GRANTS, B.PLACED_DOCUMENTS, _UP, _EFFECTIVE) + "SELECT * FROM effective")
def acl_effective(spark, sf_dir):
    return A.effective_readers(B.placed_documents(spark, sf_dir), B.folders(spark, sf_dir), B.grants(spark, sf_dir))


@query(B.with_(B.FOLDERS, B.GRANTS, B.PLACED_DOCUMENTS, _UP, _EFFECTIVE) + "SELECT * FROM effective")
def acl_recompute(spark, sf_dir):
    docs, folders, grants = B.placed_documents(spark, sf_dir), B.folders(spark, sf_dir), B.grants(spark, sf_dir)
    return A.recompute_readers(A.effective_readers(docs, folders, grants), docs, folders, grants, 1)


@query(B.with_(B.FOLDERS, "down AS (SELECT folder_id, 0 AS depth FROM folders WHERE folder_id = 3 UNION ALL SELECT f.folder_id, d.depth + 1 FROM down d JOIN folders f ON f.parent_id = d.folder_id)") + "SELECT * FROM down")
def folder_descendants(spark, sf_dir):
    return A.descendants(B.folders(spark, sf_dir), 3)


@query(B.with_(B.FOLDERS, "down AS (SELECT folder_id, 0 AS depth FROM folders WHERE folder_id = 1 UNION ALL SELECT f.folder_id, d.depth + 1 FROM down d JOIN folders f ON f.parent_id = d.folder_id)") + "SELECT coalesce(bool_or(folder_id = 7), false) AS cyclic FROM down")
def folder_move_check(spark, sf_dir):
    return A.move_is_cyclic(B.folders(spark, sf_dir), 1, 7)


@query("""WITH ur AS (SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer), rp AS (SELECT n_nationkey AS role_id, r_name AS permission FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey AS user_id, 'user:' || c_custkey AS principal FROM customer UNION SELECT user_id, 'role:' || role_id FROM ur UNION SELECT user_id, 'permission:' || permission FROM ur JOIN rp USING (role_id)""")
def principal_expansion(spark, sf_dir):
    users = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    perms = B.read(spark, sf_dir, "nation").join(B.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("role_id"), F.col("r_name").alias("permission"))
    return A.expand_principals(users, users, perms)


@query(B.with_(B.GRANTS, """e AS (SELECT resource_type, resource_id, principal, unnest(CASE WHEN permission = 'manage' THEN ['manage', 'publish', 'update'] ELSE [permission] END) AS permission FROM grants)""") + """
SELECT resource_type, resource_id, principal, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions, count(DISTINCT permission) AS n FROM e GROUP BY 1, 2, 3""")
def permission_sets(spark, sf_dir):
    return A.permission_sets(B.grants(spark, sf_dir))


@query(B.with_(B.FOLDERS, B.GRANTS, B.PLACED_DOCUMENTS) + """SELECT document_id, owner = 'user:7' OR document_id IN (SELECT CAST(resource_id AS BIGINT) FROM grants WHERE resource_type = 'document' AND principal = 'user:7' AND permission IN ('publish', 'manage')) AS allowed FROM placed_documents""")
def document_permission(spark, sf_dir):
    return A.may_act(B.placed_documents(spark, sf_dir), B.grants(spark, sf_dir), "user:7", "publish")


@query(B.with_(B.FOLDERS) + """SELECT doc_id AS document_id, f IS NULL OR (s IS NOT NULL AND coalesce(fs = s, false)) AS valid FROM (
  SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN doc_id % 60 END AS f, CASE WHEN doc_id % 4 > 0 THEN 'space' || (doc_id % 5) END AS s FROM documents) d LEFT JOIN (SELECT folder_id, space_id AS fs FROM folders) ON folder_id = f""")
def placement_check(spark, sf_dir):
    docs = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 60).alias("folder_id"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("space"), F.col("doc_id") % 5)).alias("space_id"))
    return A.placement(docs, B.folders(spark, sf_dir))


@query("""SELECT doc_id AS document_id, 't' || (doc_id % 4) AS tenant_id, CASE WHEN doc_id % 3 < 2 THEN 't' || (doc_id % 3) END AS space_tenant FROM documents WHERE 't' || (doc_id % 4) IS DISTINCT FROM CASE WHEN doc_id % 3 < 2 THEN 't' || (doc_id % 3) END""")
def tenant_consistency(spark, sf_dir):
    docs = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("t"), F.col("doc_id") % 4).alias("tenant_id"), (F.col("doc_id") % 3).alias("space_id"))
    spaces = spark.createDataFrame([(0, "t0"), (1, "t1")], "space_id long, tenant_id string")
    return A.out_of_scope(docs, spaces)


@query("""SELECT c_custkey AS id, CASE WHEN ok THEN split_part(p, ':', 1) END AS kind, CASE WHEN ok THEN split_part(p, ':', 2) END AS value, ok AS valid FROM (
  SELECT *, regexp_matches(p, '^(user|department|group|role|tenant):[A-Za-z0-9-]+$') AS ok FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'user:' || c_custkey WHEN 1 THEN 'bad' WHEN 2 THEN 'role:a b' ELSE 'department:x-' || c_custkey END AS p FROM customer))""")
def principal_parse(spark, sf_dir):
    k = F.col("c_custkey")
    p = F.when(k % 4 == 0, F.concat(F.lit("user:"), k)).when(k % 4 == 1, "bad").when(k % 4 == 2, "role:a b").otherwise(F.concat(F.lit("department:x-"), k))
    kind, value, ok = A.split_principal(p)
    return B.read(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("kind"), value.alias("value"), ok.alias("valid"))


@query("SELECT 'user:' || u AS principal FROM (SELECT DISTINCT user_id AS u FROM events) WHERE u NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unknown_principals(spark, sf_dir):
    name = lambda c: F.concat(F.lit("user:"), c).alias("principal")
    return A.unknown_principals(B.read(spark, sf_dir, "events").select(name(F.col("user_id"))), B.read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(name(F.col("c_custkey"))))


_READABLE = "'user:7', 'group:3', 'role:1'"


@query(B.with_(B.FOLDERS, B.GRANTS, B.PLACED_DOCUMENTS, B.CATALOG_DOCUMENTS, _UP, _EFFECTIVE) + f"""
SELECT document_id, title, count(*) OVER () AS total FROM catalog_documents WHERE status = 'published' AND title ILIKE '%th%' AND document_id IN (SELECT document_id FROM effective WHERE principal IN ({_READABLE})) ORDER BY document_id LIMIT 20 OFFSET 10""")
def documents_visible_page(spark, sf_dir):
    readers = A.effective_readers(B.placed_documents(spark, sf_dir), B.folders(spark, sf_dir), B.grants(spark, sf_dir)).filter(F.col("principal").isin("user:7", "group:3", "role:1"))
    own = B.catalog_documents(spark, sf_dir).filter((F.col("status") == "published") & F.col("title").ilike("%th%")).join(readers, "document_id", "left_semi")
    total = own.agg(F.count("*")).scalar()
    return own.select("document_id", "title", total.alias("total")).orderBy("document_id").offset(10).limit(20)


@query(B.with_(B.CATALOG_DOCUMENTS, B.DOCUMENT_TAGS) + "SELECT document_id, status FROM catalog_documents d WHERE (SELECT count(DISTINCT tag) FROM document_tags t WHERE t.document_id = d.document_id AND tag IN ('q1', 't0')) = 2")
def documents_all_tags(spark, sf_dir):
    return A.with_all_tags(B.catalog_documents(spark, sf_dir), B.document_tags(spark, sf_dir), ["q1", "t0"]).select("document_id", "status")


@query(B.with_(B.CATALOG_DOCUMENTS, B.DOCUMENT_TAGS) + "SELECT tag, count(DISTINCT d.document_id) AS n FROM document_tags t LEFT JOIN catalog_documents d ON d.document_id = t.document_id AND d.status = 'published' GROUP BY tag")
def tag_counts(spark, sf_dir):
    docs = B.catalog_documents(spark, sf_dir).filter("status = 'published'").select("document_id", F.lit(1).alias("one"))
    return B.document_tags(spark, sf_dir).join(docs, "document_id", "left").groupBy("tag").agg(F.count_distinct(F.when(F.col("one") == 1, F.col("document_id"))).alias("n"))


@query(B.with_(B.CATALOG_DOCUMENTS) + """SELECT facet, value, count(*) AS n FROM (SELECT 'space_id' AS facet, space_id AS value FROM catalog_documents WHERE status = 'published' UNION ALL SELECT 'lang', lang FROM catalog_documents WHERE status = 'published') WHERE value IS NOT NULL GROUP BY 1, 2""")
def facets(spark, sf_dir):
    return R.facets(B.catalog_documents(spark, sf_dir).filter("status = 'published'"), ["space_id", "lang"])


@query("SELECT 'customer' AS kind, c_nationkey AS id FROM customer UNION SELECT 'supplier', s_nationkey FROM supplier UNION SELECT 'order', o_custkey % 25 FROM orders")
def tenant_union(spark, sf_dir):
    a = B.read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").cast("long").alias("id"))
    b = B.read(spark, sf_dir, "supplier").select(F.lit("supplier"), F.col("s_nationkey").cast("long"))
    c = B.read(spark, sf_dir, "orders").select(F.lit("order"), F.col("o_custkey") % 25)
    return a.union(b).union(c).distinct()


@query("SELECT o_custkey, o_orderkey, o_orderstatus, max(o_orderkey % 97) OVER (PARTITION BY o_custkey) + 1 AS next_version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, sf_dir):
    """Version numbers have gaps: the next one follows the largest."""
    own = B.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", (F.col("o_orderkey") % 97).alias("version"))
    return A.next_version(own, ["o_custkey"], "version", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", "next_version")


@query("SELECT page_id, url FROM (SELECT *, TIMESTAMP '2024-01-31' - to_hours(page_id % 50) AS written FROM pages) WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) AND written < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def orphans_anti(spark, sf_dir):
    """Pages as objects that were written up to 49 hours ago, with a day of grace."""
    refs = B.read(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"))
    now = F.lit("2024-01-31").cast("timestamp")
    objects = B.read(spark, sf_dir, "pages").select("page_id", "url", (now - F.make_interval(hours=(F.col("page_id") % 50).cast("int"))).alias("written"))
    return A.orphans(objects, refs, ["page_id"], now, 24).select("page_id", "url")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def missing_embeddings(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return R.missing_embeddings(own, own.filter("doc_id % 2 = 0"), ["hash"])


@query("""SELECT c.conv_id, q.turn AS question_turn, a.turn AS answer_turn, length(q.text) AS question_length, length(a.text) AS answer_length FROM (SELECT DISTINCT conv_id FROM conversations) c
  JOIN conversations q ON q.conv_id = c.conv_id AND q.role = 'user' JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' JOIN labels l ON l.doc_id = c.conv_id WHERE l.quality = 1""")
def evaluation_candidates(spark, sf_dir):
    turns = B.read(spark, sf_dir, "conversations")
    side = lambda role, p: turns.filter(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{p}_turn"), F.length("text").alias(f"{p}_length"))
    rated = B.read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("conv_id"))
    q, a = side("user", "question"), side("assistant", "answer")
    both = q.join(a.withColumnRenamed("conv_id", "c"), (F.col("conv_id") == F.col("c")) & (F.col("answer_turn") == F.col("question_turn") + 1))
    return rated.join(both, "conv_id").select("conv_id", "question_turn", "answer_turn", "question_length", "answer_length")


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def purge_cascade(spark, sf_dir):
    purged = B.read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")).join(purged, "document_id", "left_anti")


@query("""WITH e AS (SELECT event_id AS id, 't' || (user_id % 4) AS tenant_id, event_type AS action, CASE WHEN event_id % 3 = 0 THEN 'document' ELSE 'folder' END AS resource_type, user_id AS actor_id, ts AS created_at FROM events)
SELECT id, action, actor_id, c_name AS actor_name, total FROM (SELECT *, count(*) OVER () AS total FROM e WHERE tenant_id = 't1' AND action = 'error' AND resource_type = 'document' ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10) LEFT JOIN customer ON c_custkey = actor_id""")
def audit_events_page(spark, sf_dir):
    """The second page, of ten, of a tenant's errors about documents."""
    kind = F.when(F.col("event_id") % 3 == 0, "document").otherwise("folder")
    events = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), F.col("event_type").alias("action"), kind.alias("resource_type"), F.col("user_id").alias("actor_id"), F.col("ts").alias("created_at"))
    users = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return A.audit_page(events, users, "t1", "error", "document", 2, 10).select("id", "action", "actor_id", "actor_name", "total")


@query(B.with_(B.FOLDERS, B.GRANTS, """up (folder_id, ancestor_id, depth) AS (SELECT folder_id, folder_id, 0 FROM folders UNION ALL SELECT u.folder_id, f.parent_id, u.depth + 1 FROM up u JOIN folders f ON f.folder_id = u.ancestor_id WHERE f.parent_id IS NOT NULL AND u.depth < 20)""",
  """readers AS (SELECT folder_id, principal FROM up JOIN grants ON resource_type = 'folder' AND resource_id = CAST(ancestor_id AS VARCHAR) AND permission = 'read' UNION SELECT folder_id, principal FROM folders JOIN grants ON resource_type = 'space' AND resource_id = space_id AND permission = 'read')""") + """
SELECT f.folder_id, f.space_id, coalesce(string_agg(principal, ',' ORDER BY principal), '') AS principals FROM folders f LEFT JOIN readers USING (folder_id) WHERE f.space_id IN (SELECT resource_id FROM grants WHERE resource_type = 'space' AND principal IN ('role:1', 'group:3')) GROUP BY 1, 2""")
def visible_folder_tree(spark, sf_dir):
    own = A.visible_folders(B.folders(spark, sf_dir), B.grants(spark, sf_dir), ["role:1", "group:3"])
    return own.withColumn("principals", F.array_join("principals", ","))
