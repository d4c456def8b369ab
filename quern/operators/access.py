"""Access control: principals, effective readers, visibility, folder trees, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import WHITE

# Permissions that a claim may give, and the form of a principal.
PERMISSIONS = ("access.manage", "system.manage", "knowledge.manage", "documents.create", "documents.review")
PRINCIPAL = "(?i)^(?:tenant|user|department|role):[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: Levels of a folder tree that are followed upwards.
MAX_DEPTH = 20


def may_read(principals: Column, own: list[str]) -> Column:
    """Whether lists of principals overlap; a null list or element never grants."""
    return F.coalesce(F.arrays_overlap(principals, F.array(*map(F.lit, own))), F.lit(False))


def visible(docs: DataFrame, tenant: str, own: list[str] | None = None, **equal: str | None) -> DataFrame:
    """Published documents of a tenant, of the principals where given, and with the optional equalities that are set."""
    out = docs.filter((F.col("tenant_id") == tenant) & (F.col("status") == "published"))
    if own is not None:
        out = out.filter(may_read(F.col("principals"), own))
    for column, value in equal.items():
        out = out if value is None else out.filter(F.col(column) == value)
    return out


def with_all_tags(docs: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Relational division: documents that have every wanted tag; all of them where none is wanted."""
    if not wanted:
        return docs
    n = len(set(wanted))
    have = tags.filter(F.col("tag").isin(*wanted)).groupBy("document_id").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == n)
    return docs.join(have, "document_id", "left_semi")


def ancestors(folders: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(folder_id, ancestor_id, depth): each folder with itself at depth 0 and all above it, by a recursive query."""
    return folders.sparkSession.sql(
        f"""WITH RECURSIVE up (folder_id, ancestor_id, depth) AS (
          SELECT folder_id, folder_id, 0 FROM {{folders}}
          UNION ALL SELECT u.folder_id, f.parent_id, u.depth + 1 FROM up u JOIN {{folders}} f ON f.folder_id = u.ancestor_id WHERE f.parent_id IS NOT NULL AND u.depth < {int(max_depth)})
        SELECT folder_id, ancestor_id, depth FROM up""",
        folders=folders,
    )


def descendants(folders: DataFrame, root: int) -> DataFrame:
    """(folder_id, depth) of a folder and everything below it."""
    return folders.sparkSession.sql(
        f"""WITH RECURSIVE down (folder_id, depth) AS (
          SELECT folder_id, 0 FROM {{folders}} WHERE folder_id = {int(root)}
          UNION ALL SELECT f.folder_id, d.depth + 1 FROM down d JOIN {{folders}} f ON f.parent_id = d.folder_id)
        SELECT folder_id, depth FROM down""",
        folders=folders,
    )


def move_is_cyclic(folders: DataFrame, folder: int, target: int) -> DataFrame:
    """One row: whether the target lies in the folder's own subtree."""
    return descendants(folders, folder).agg(F.coalesce(F.bool_or(F.col("folder_id") == target), F.lit(False)).alias("cyclic"))


def effective_readers(docs: DataFrame, folders: DataFrame, grants: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, principal, source, priority): union of grants on the document (priority 0), its folders (10 and
    the distance) and its space (100), the nearest of each principal; the owner where nobody else may read."""
    g = grants.filter("permission = 'read'").select("resource_type", "resource_id", "principal")
    of = lambda kind: g.filter(F.col("resource_type") == kind).drop("resource_type")
    ids = docs.select("document_id", F.col("document_id").cast("string").alias("resource_id"))
    own = ids.join(of("document"), "resource_id").select("document_id", "principal", F.lit("document").alias("source"), F.lit(0).alias("priority"))
    above = docs.select("document_id", "folder_id").join(ancestors(folders, max_depth), "folder_id").select("document_id", F.col("ancestor_id").cast("string").alias("resource_id"), "depth")
    inherited = above.join(of("folder"), "resource_id").select("document_id", "principal", F.lit("folder").alias("source"), (F.col("depth") + 10).alias("priority"))
    space = docs.select("document_id", F.col("space_id").alias("resource_id")).join(of("space"), "resource_id").select("document_id", "principal", F.lit("space").alias("source"), F.lit(100).alias("priority"))
    found = own.unionByName(inherited).unionByName(space)
    nearest = found.groupBy("document_id", "principal").agg(F.min(F.struct("priority", "source")).alias("x")).select("document_id", "principal", F.col("x.source").alias("source"), F.col("x.priority").cast("long").alias("priority"))
    orphans = docs.join(nearest.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.col("owner").alias("principal"), F.lit("owner").alias("source"), F.lit(1000).cast("long").alias("priority"))
    return nearest.unionByName(orphans)


def recompute_readers(current: DataFrame, docs: DataFrame, folders: DataFrame, grants: DataFrame, root: int) -> DataFrame:
    """current with the rows of documents under a folder computed anew."""
    below = docs.join(descendants(folders, root), "folder_id", "left_semi")
    return current.join(below.select("document_id"), "document_id", "left_anti").unionByName(effective_readers(below, folders, grants))


def expand_principals(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, principal): the user, its roles, and the permissions of those, each once."""
    roles = users.select("user_id").join(user_roles, "user_id")
    self_ = users.select("user_id", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("principal"))
    role = roles.select("user_id", F.concat(F.lit("role:"), F.col("role_id").cast("string")).alias("principal"))
    perm = roles.join(role_permissions, "role_id").select("user_id", F.concat(F.lit("permission:"), "permission").alias("principal"))
    return self_.union(role).union(perm).distinct()


def permission_sets(grants: DataFrame) -> DataFrame:
    """(resource_type, resource_id, principal, permissions, n): distinct, sorted; 'manage' implies all but reading."""
    implied = F.explode(F.when(F.col("permission") == "manage", F.array(*map(F.lit, ("manage", "publish", "update")))).otherwise(F.array("permission"))).alias("permission")
    key = ["resource_type", "resource_id", "principal"]
    return grants.select(*key, implied).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("permission")), ",").alias("permissions"), F.count_distinct("permission").alias("n"))


def may_act(docs: DataFrame, grants: DataFrame, principal: str, permission: str, admin: bool = False) -> DataFrame:
    """(document_id, allowed). Reading needs a grant; anything else is also for admins and the document's creator."""
    granted = grants.filter((F.col("resource_type") == "document") & (F.col("principal") == principal) & F.col("permission").isin(permission, *([] if permission == "read" else ["manage"])))
    hit = granted.select(F.col("resource_id").cast("long").alias("document_id")).distinct().withColumn("granted", F.lit(True))
    by_role = F.lit(False) if permission == "read" else (F.lit(admin) | (F.col("owner") == principal))
    return docs.join(hit, "document_id", "left").select("document_id", (F.coalesce("granted", F.lit(False)) | by_role).alias("allowed"))


def split_principal(principal: Column) -> tuple[Column, Column, Column]:
    """(type, id, valid) of 'type:id'."""
    ok = F.coalesce(principal.rlike("^(user|department|group|role|tenant):[A-Za-z0-9-]+$"), F.lit(False))
    return F.when(ok, F.split_part(principal, F.lit(":"), F.lit(1))), F.when(ok, F.split_part(principal, F.lit(":"), F.lit(2))), ok


def unknown_principals(principals: DataFrame, known: DataFrame) -> DataFrame:
    """Those that don't exist or are malformed."""
    return principals.distinct().join(known.select("principal").distinct(), "principal", "left_anti")


def out_of_scope(docs: DataFrame, spaces: DataFrame) -> DataFrame:
    """Documents whose space belongs to another tenant, or to none: a consistency check that expects no rows."""
    s = spaces.select("space_id", F.col("tenant_id").alias("space_tenant"))
    return docs.join(s, "space_id", "left").filter(~F.col("tenant_id").eqNullSafe(F.col("space_tenant"))).select("document_id", "tenant_id", "space_tenant")


def placement(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """(document_id, valid): a folder needs a space, and has to be in it."""
    f = folders.select("folder_id", F.col("space_id").alias("folder_space"))
    valid = F.col("folder_id").isNull() | (F.col("space_id").isNotNull() & F.coalesce(F.col("folder_space") == F.col("space_id"), F.lit(False)))
    return docs.join(f, "folder_id", "left").select("document_id", valid.alias("valid"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def next_version(rows: DataFrame, keys: list[str], version: str, *newest: Column) -> DataFrame:
    """The newest row of each key, with next_version: one more than the key's largest version."""
    whole = Window.partitionBy(*keys)
    out = rows.withColumn("next_version", F.coalesce(F.max(version).over(whole), F.lit(0)) + 1).withColumn("__n", F.row_number().over(whole.orderBy(*newest)))
    return out.filter("__n = 1").drop("__n")


def orphans(objects: DataFrame, references: DataFrame, keys: list[str], now: Column, grace_hours: int) -> DataFrame:
    """Objects that nothing refers to and that were written longer ago than the hours of grace."""
    old = objects.filter(F.col("written") < now - F.make_interval(hours=F.lit(grace_hours)))
    return old.join(references.select(*keys).distinct(), keys, "left_anti")


def folder_readers(folders: DataFrame, grants: DataFrame, permission: str = "read") -> DataFrame:
    """(folder_id, space_id, principal): who reads a folder, by a grant on its space, on itself or on a folder above."""
    own = grants.filter(F.col("permission") == permission).select("resource_type", "resource_id", "principal").distinct()
    above = ancestors(folders).select("folder_id", F.col("ancestor_id").cast("string").alias("resource_id"))
    by_folder = above.join(own.filter("resource_type = 'folder'"), "resource_id").select("folder_id", "principal")
    by_space = folders.select("folder_id", F.col("space_id").alias("resource_id")).join(own.filter("resource_type = 'space'"), "resource_id").select("folder_id", "principal")
    return by_folder.union(by_space).distinct().join(folders.select("folder_id", "space_id"), "folder_id").select("folder_id", "space_id", "principal")


def visible_folders(folders: DataFrame, grants: DataFrame, own: list[str], administrator: bool = False) -> DataFrame:
    """(folder_id, space_id, principals): folders of the spaces that one of the principals may read, with all who read
    them, sorted; every folder for an administrator."""
    readers = folder_readers(folders, grants).groupBy("folder_id").agg(F.sort_array(F.collect_set("principal")).alias("principals"))
    seen = folders.select("folder_id", "space_id")
    if not administrator:
        spaces = grants.filter((F.col("resource_type") == "space") & (F.col("permission") == "read") & F.col("principal").isin(*own)).select(F.col("resource_id").alias("space_id")).distinct()
        seen = seen.join(spaces, "space_id", "left_semi")
    nobody = F.array().cast("array<string>")
    return seen.join(readers, "folder_id", "left").select("folder_id", "space_id", F.coalesce("principals", nobody).alias("principals"))


def audit_page(events: DataFrame, users: DataFrame, tenant: str, action: str | None = None, resource_type: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of a tenant's audit events, newest first (ties: the larger id), with the actor's name and the total; the
    action and the type of resource are optional."""
    if page < 1 or size < 1:
        raise ValueError("page and size are 1 at least")
    out = events.filter(F.col("tenant_id") == tenant)
    for column, value in (("action", action), ("resource_type", resource_type)):
        out = out if value is None else out.filter(F.col(column) == value)
    total = out.agg(F.count("*")).scalar()
    shown = out.withColumn("total", total).orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    return shown.join(users.select(F.col("id").alias("actor_id"), F.col("name").alias("actor_name")), "actor_id", "left")


def owned(rows: DataFrame, tenant: str, owner: str) -> DataFrame:
    """Rows that one user of one tenant has made; nobody owns rows without an owner."""
    return rows.filter((F.col("tenant_id") == tenant) & (F.col("created_by") == owner))


def active(sessions: DataFrame, tenants: DataFrame, users: DataFrame) -> DataFrame:
    """sessions (tenant_id, user_id, …) with active: the tenant and the user are there and active, and the user is of that
    tenant. tenants: (tenant_id, status); users: (user_id, tenant_id, status)."""
    t = tenants.filter("status = 'active'").select("tenant_id").distinct().withColumn("_tenant", F.lit(True))
    u = users.filter("status = 'active'").select("user_id", "tenant_id").distinct().withColumn("_user", F.lit(True))
    own = sessions.join(t, "tenant_id", "left").join(u, ["user_id", "tenant_id"], "left")
    return own.select(*sessions.columns, F.coalesce(F.col("_tenant") & F.col("_user"), F.lit(False)).alias("active"))


def partition_claims(sessions: DataFrame) -> DataFrame:
    """sessions (tenant_id, user_id, claims array<string>, …) with principals, permissions (each once, in their order; the
    tenant and the user themselves come first) and problem: 'empty' (no claims), or of the first claim that is refused
    'permission' (an unknown one), 'principal' (malformed) or 'foreign' (another tenant or user); else null. Where there
    is a problem, both lists are empty."""
    tenant, user = F.concat(F.lit("tenant:"), "tenant_id"), F.concat(F.lit("user:"), "user_id")
    given = F.concat(F.array(tenant, user), F.col("claims"))

    def kind(claim: Column) -> Column:
        value = F.btrim(claim, F.lit(WHITE))
        is_permission = F.startswith(claim, F.lit("permission:"))
        permission = F.substring(claim, len("permission:") + 1, 1 << 20)
        foreign = (F.startswith(value, F.lit("tenant:")) & (value != tenant)) | (F.startswith(value, F.lit("user:")) & (value != user))
        problem = F.when(claim.isNull(), "principal").when(is_permission, F.when(~permission.isin(*PERMISSIONS), "permission")).when(~value.rlike(PRINCIPAL), "principal").when(foreign, "foreign")
        return F.struct(F.when(is_permission, permission).alias("permission"), F.when(~is_permission, value).alias("principal"), problem.alias("problem"))

    none = F.array().cast("array<string>")
    rows = sessions.withColumn("_each", F.transform(given, kind))
    first = F.try_element_at(F.filter(F.transform("_each", lambda x: x["problem"]), lambda x: x.isNotNull()), F.lit(1))
    rows = rows.withColumn("problem", F.when(F.coalesce(F.size("claims"), F.lit(0)) < 1, "empty").when(F.col("_each").isNull(), "principal").otherwise(first))
    part = lambda f: F.when(F.col("problem").isNotNull(), none).otherwise(F.array_distinct(F.filter(F.transform("_each", lambda x: x[f]), lambda x: x.isNotNull())))
    return rows.select(*sessions.columns, part("principal").alias("principals"), part("permission").alias("permissions"), "problem")


def source_chunks(chunks: DataFrame, documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(request, chunk row) of requests (request_id, chunk_id, tenant_id, own array<string>): the chunk, if it is of that
    tenant, one of the principals may read it, and its document is published with that version as the current one.

    chunks: (chunk_id, tenant_id, document_id, version_id, principals, …); documents: (document_id, tenant_id, status,
    deleted, current_version_id). A request that finds nothing has found = false, whatever the reason.
    """
    live = documents.filter("status = 'published' and not deleted").select("document_id", F.col("current_version_id").alias("version_id")).distinct()
    asked = wanted.select("request_id", "chunk_id", "tenant_id", "own")
    meet = asked.join(chunks, ["chunk_id", "tenant_id"]).filter(F.coalesce(F.arrays_overlap("principals", "own"), F.lit(False)))
    hit = meet.join(live, ["document_id", "version_id"], "left_semi").drop("own", "principals", "chunk_id", "tenant_id")
    return asked.join(hit.withColumn("found", F.lit(True)), "request_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("own")
