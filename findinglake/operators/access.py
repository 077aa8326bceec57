"""Who may see and do what: roles and permissions, members, audit events, and checks of names that users give.

Roles, permissions and members are joined as small tables; events and projects are filtered where they are read.  Rows
with null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.domain import ORG_WIDE_ROLES, PERMISSIONS, ROLES
from findinglake.functions.columns import rank


def permission_table(spark) -> DataFrame:
    """role, permission: what each role may do.  A role may do what lower ones may."""
    rows = [(r, p) for i, r in enumerate(ROLES) for low in ROLES[: i + 1] for p in PERMISSIONS[low]]
    return spark.createDataFrame(rows, "role string, permission string")


def permitted(members: DataFrame, permission: str) -> DataFrame:
    """The members whose role has the permission; unknown roles have none."""
    allowed = permission_table(members.sparkSession).where(F.col("permission") == permission).select("role")
    return members.join(F.broadcast(allowed), "role", "left_semi")


def may_assign(actor: Column, target: Column) -> Column:
    """Owners assign any role, administrators those below their own, others none."""
    below = (rank(target, ROLES) >= 0) & (rank(target, ROLES) < ROLES.index("ADMIN"))
    return F.coalesce((actor == "OWNER") | ((actor == "ADMIN") & below), F.lit(False))


def present(rows: DataFrame) -> DataFrame:
    """Rows that aren't deleted."""
    return rows.where(F.col("deleted_at").isNull())


def members_of(members: DataFrame, users: DataFrame, organization_id: int) -> DataFrame:
    """The members of an organization whose accounts aren't deleted, by e-mail address."""
    own = members.where(F.col("organization_id") == organization_id).select("user_id", "role")
    return own.join(present(users).select("user_id", "email"), "user_id").orderBy("email", "user_id")


def roles_of(members: DataFrame, organizations: DataFrame, user_id: int) -> DataFrame:
    """organization_id and role of a user, in organizations that aren't deleted."""
    own = members.where(F.col("user_id") == user_id).select("organization_id", "role")
    return own.join(present(organizations).select("organization_id"), "organization_id")


def owners(members: DataFrame) -> DataFrame:
    """Per organization its number of owners, 0 included."""
    return members.groupBy("organization_id").agg(F.count_if(F.col("role") == "OWNER").alias("owners"))


def projects_seen(projects: DataFrame, members: DataFrame, project_members: DataFrame, user_id: int) -> DataFrame:
    """Projects of organizations where the user's role sees all, and those of which the user is a member."""
    wide = members.where((F.col("user_id") == user_id) & F.col("role").isin(ORG_WIDE_ROLES)).select("organization_id")
    own = project_members.where(F.col("user_id") == user_id).select("project_id")
    all_ = projects.join(F.broadcast(wide.distinct()), "organization_id", "left_semi").select(*projects.columns)
    mine = projects.join(own, "project_id", "left_semi").join(F.broadcast(wide.distinct()), "organization_id", "left_anti")
    return all_.unionByName(mine.select(*projects.columns))


def audit_events(
    events: DataFrame, members: DataFrame, organization_id: int, action: str | None = None, outcome: str | None = None,
    actor: str | None = None, since=None,
) -> DataFrame:
    """Events of an organization, and those of no organization that a member did or that are about a member.

    action: how the action's name begins; outcome: without regard to case; actor: part of the label, in lower case;
    since: the earliest time.
    """
    own = members.where(F.col("organization_id") == organization_id).select(F.col("user_id").alias("member")).distinct()
    out = events.where(F.col("organization_id").eqNullSafe(F.lit(organization_id)) | F.col("organization_id").isNull())
    if action:
        out = out.where(F.col("action").startswith(action))
    if outcome:
        out = out.where(F.col("outcome") == outcome.upper())
    if actor:
        out = out.where(F.col("actor_label").contains(actor.lower()))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    inside = out.where(F.col("organization_id").isNotNull())
    free = out.where(F.col("organization_id").isNull())
    did = free.join(own, F.col("actor_user_id") == F.col("member"), "left_semi")
    about = (F.col("target_type") == "user") & (F.col("target_id") == F.col("member").cast("string"))
    rest = free.join(own, F.col("actor_user_id") == F.col("member"), "left_anti").join(own, about, "left_semi")
    return inside.unionByName(did).unionByName(rest)


_REPOSITORY = "^(?:/[A-Za-z0-9._-]+){2,5}/?$"  # owner, groups, repository


def git_url(url: Column, hosts: list[str]) -> Column:
    """The normal form of an https address of a repository on a known host, without user, port, query or fragment;
    null if it isn't one."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^https://([^/?#@:]+)(?::443)?(?:/|$)", 1))
    path = F.regexp_extract(u, r"^https://[^/?#@]+(/[^?#]*)$", 1)
    return F.when(host.isin(hosts) & path.rlike(_REPOSITORY), F.concat(F.lit("https://"), host, F.regexp_replace(path, "/+$", "")))


def branch_ok(name: Column) -> Column:
    """Whether a branch name has 1 to 200 letters, digits and . _ / -, doesn't begin with -, holds no .. or // and ends
    neither with / nor with .lock."""
    bad = name.startswith("-") | name.contains("..") | name.contains("//") | name.endswith("/") | name.endswith(".lock")
    return name.rlike("^[A-Za-z0-9._/-]{1,200}$") & ~bad


def exclude_pattern_ok(pattern: Column) -> Column:
    """Whether a pattern is relative, of 1 to 200 characters, without '..' and NUL."""
    p = F.trim(pattern)
    return (p != "") & (F.length(p) <= 200) & ~p.startswith("/") & ~p.contains("..") & ~p.contains("\x00")


def secret_reference_ok(ref: Column, prefix: str) -> Column:
    """Whether a reference names an environment variable that begins with `prefix`."""
    return ref.rlike(f"^env:{prefix}[A-Z0-9_]{{1,80}}$")


def integration_for(projects: DataFrame, integrations: DataFrame, kind: str) -> DataFrame:
    """Per project its integration of a kind: its own before its organization's, then the smallest id; none: no row."""
    some = integrations.where(F.col("kind") == kind)
    own = some.where("project_id is not null").select("project_id", F.lit(0).alias("wide"), "integration_id")
    wide = some.where("project_id is null").groupBy("organization_id").agg(F.min("integration_id").alias("integration_id"))
    wide = projects.join(F.broadcast(wide), "organization_id").select("project_id", F.lit(1).alias("wide"), "integration_id")
    own = own.join(projects.select("project_id"), "project_id", "left_semi")
    return own.unionByName(wide).groupBy("project_id").agg(F.min(F.struct("wide", "integration_id")).alias("x")).select(
        "project_id", F.col("x.integration_id").alias("integration_id"), (F.col("x.wide") == 1).alias("organization_wide")
    )
