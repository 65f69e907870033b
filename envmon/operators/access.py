"""Rights (J9-J12); login lockouts (R6) are in ``lockouts`` and offered here too.

Role and permission tables are small and bounded by configuration, users
and their role links grow with the data; joins are left to the planner.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lockouts import LOCK_SECONDS, LOCKOUT_SCHEMA, MAX_FAILURES, LoginState, login_lockouts  # noqa: F401

Tables = Mapping[str, DataFrame]


def user_roles(tables: Tables) -> DataFrame:
    """Roles of every user (bridge join)."""
    r = tables["roles"].select("role_id", "role_name", "description")
    return tables["user_roles"].select("user_id", "role_id").join(r, "role_id").select(
        "user_id", "role_id", "role_name", "description")


def role_permissions(tables: Tables, in_use: bool = False) -> DataFrame:
    """Permissions of every role (``in_use``: of the roles held by at least one user)."""
    p = tables["permissions"].select("permission_id", "permission_name", "resource", "action")
    rp = tables["role_permissions"].select("role_id", "permission_id")
    if in_use:
        rp = rp.join(tables["user_roles"].select("role_id").dropDuplicates(), "role_id", "left_semi")
    return rp.join(p, "permission_id").select(
        "role_id", "permission_id", "permission_name", "resource", "action")


def user_permissions(tables: Tables) -> DataFrame:
    """Distinct effective permissions of every user.

    De-duplication runs on the two ids only (a hash aggregate on fixed-width
    keys, combined map-side); the names are attached afterwards from the
    small permissions table.
    """
    rp = tables["role_permissions"].select("role_id", "permission_id")
    ids = (tables["user_roles"].select("user_id", "role_id").join(rp, "role_id")
           .select("user_id", "permission_id").dropDuplicates())
    p = tables["permissions"].select("permission_id", "permission_name", "resource", "action")
    return ids.join(p, "permission_id").select("user_id", "permission_id", "permission_name",
                                                      "resource", "action")


def check_permissions(tables: Tables, requests: DataFrame) -> DataFrame:
    """(user_id, resource, action) requests -> allowed flag.

    Each request meets the roles that hold the asked permission (a small
    configuration map), then the user's role links; a request is allowed when
    one of those links exists.  Requests are de-duplicated first.
    """
    req = requests.select("user_id", "resource", "action").dropDuplicates()
    holders = role_permissions(tables).select("resource", "action", "role_id").dropDuplicates()
    cand = req.join(holders, ["resource", "action"])
    links = tables["user_roles"].select("user_id", "role_id")
    granted = cand.join(links, ["user_id", "role_id"], "left_semi") \
                  .select("user_id", "resource", "action").dropDuplicates()
    g = granted.withColumn("allowed", F.lit(True))
    out = req.join(g, ["user_id", "resource", "action"], "left")
    return out.select("user_id", "resource", "action", F.coalesce("allowed", F.lit(False)).alias("allowed"))
