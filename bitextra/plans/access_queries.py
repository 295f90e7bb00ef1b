"""Bound queries: access to term collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitextra.operators import access as A
from bitextra.plans import fixtures as fx
from bitextra.plans.fixtures import check_sql
from bitextra.plans.registry import query


def users(spark, d):
    return fx.shared(spark, d, "users").withColumn("ldap_groups", F.array("ldap_group"))


def roles(spark, d):
    return (
        fx.shared(spark, d, "roles")
        .withColumn("permissions", F.split("string_perms", ","))
        .withColumn("builtin", F.col("name").isin("admin", "user", "api"))
    )


def grants(spark, d):
    return fx.shared(spark, d, "grants")


def collections(spark, d):
    names = fx.table(spark, d, "nation").select(F.col("n_name").alias("collection"))
    return names.union(fx.table(spark, d, "region").select(F.lower("r_name")))


def requests(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_id") % 26 == 25, F.lit("default"))
        .otherwise(F.concat(F.lit("NATION_"), (F.col("event_id") % 26).cast("string")))
        .alias("collection"),
        F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "create")
        .otherwise("modify").alias("action"),
    )


BASE = """
    coll_fx AS (SELECT n_name AS collection FROM nation UNION ALL SELECT lower(r_name) FROM region),
    plain_fx AS (SELECT * FROM users_fx WHERE role_name <> 'admin' AND role_enum <> 'admin'),
    subj_fx AS (
      SELECT user_id, 'group' AS subject_type, lower(ldap_group) AS key FROM plain_fx
      UNION SELECT user_id, 'role', role_name FROM plain_fx WHERE role_name <> ''
      UNION SELECT user_id, 'role', role_enum FROM plain_fx
      UNION SELECT user_id, 'user', user_id FROM plain_fx),
    hits_fx AS (
      SELECT s.user_id, g.* FROM subj_fx s JOIN grants_fx g ON s.subject_type = g.subject_type
        AND s.key = CASE g.subject_type WHEN 'group' THEN lower(g.subject) ELSE g.subject END),
    cells_fx AS (
      SELECT user_id, collection,
        max(level) FILTER (subject_type = 'role') AS rl,
        arg_min(subject, (-level, grant_ord)) FILTER (subject_type = 'role') AS rs,
        max(level) FILTER (subject_type = 'group') AS gl,
        arg_min(subject, (-level, grant_ord)) FILTER (subject_type = 'group') AS gs,
        arg_max(level, grant_ord) FILTER (subject_type = 'user') AS pl
      FROM hits_fx GROUP BY user_id, collection),
    levels_fx AS (
      SELECT user_id, collection, CASE WHEN collection = 'default' THEN greatest(lv, 1) ELSE lv END
          AS level,
        CASE WHEN pl IS NOT NULL THEN 'personal'
          WHEN rl IS NOT NULL AND rl >= coalesce(gl, 0) THEN 'role:' || rs
          WHEN gl IS NOT NULL THEN 'group:' || gs ELSE 'none' END AS source
      FROM (SELECT *, coalesce(pl, greatest(coalesce(rl, 0), coalesce(gl, 0))) AS lv FROM cells_fx)
      UNION ALL
      SELECT user_id, 'default', 1, 'default' FROM plain_fx WHERE user_id NOT IN
        (SELECT user_id FROM cells_fx WHERE collection = 'default'))"""


@query(
    "normalize_grants",
    check_sql(
        """SELECT subject_type, subject, collection, lv AS level, lv >= 1 AS read, lv >= 3 AS write
        FROM (SELECT *, CASE WHEN grant_ord % 5 = 0 THEN CASE WHEN level = 3 THEN 3 WHEN level > 0
                THEN 1 ELSE 0 END ELSE greatest(0, least(3, level * 2 - 1)) END AS lv
              FROM grants_fx)""",
        "grants",
    ),
)
def normalize_grants(spark, d):
    raw = grants(spark, d).select(
        "subject_type", "subject", "collection", (F.col("level") >= 1).alias("read"),
        (F.col("level") >= 3).alias("write"),
        F.when(F.col("grant_ord") % 5 != 0, F.col("level") * 2 - 1).cast("int").alias("level"),
    )
    return A.normalize_grants(raw)


@query(
    "migrate_roles",
    check_sql(
        """SELECT user_id, CASE WHEN r IN ('operator', 'viewer') THEN 'user' ELSE r END AS role,
          r IN ('operator', 'viewer') AS migrated, NOT manual_role AS stamped, r = 'api' AS api_preserved
        FROM (SELECT *, CASE WHEN role_name <> '' THEN role_name ELSE role_enum END AS r
              FROM users_fx)""",
        "users",
    ),
)
def migrate_roles(spark, d):
    return A.migrate_roles(users(spark, d))


@query(
    "directory_role",
    check_sql(
        """SELECT user_id, CASE WHEN lower(ldap_group) = 'africa' THEN 'admin' ELSE 'user' END
          AS directory_role FROM users_fx""",
        "users",
    ),
)
def directory_role(spark, d):
    return A.directory_role(users(spark, d), "Africa")


@query(
    "grants_for_users",
    check_sql(
        f"""WITH {BASE} SELECT user_id, subject_type, subject, collection, level FROM hits_fx""",
        "users", "grants",
    ),
)
def grants_for_users(spark, d):
    plain = users(spark, d).filter(~A.is_admin())
    return A.grants_for(plain, grants(spark, d)).drop("grant_ord")


@query(
    "effective_levels",
    check_sql(
        f"WITH {BASE} SELECT user_id, collection, level FROM levels_fx", "users", "grants"
    ),
)
def effective_levels(spark, d):
    return A.effective_levels(users(spark, d), grants(spark, d))


@query(
    "effective_levels_explained",
    check_sql(
        f"WITH {BASE} SELECT user_id, collection, level, source FROM levels_fx", "users", "grants"
    ),
)
def effective_levels_explained(spark, d):
    return A.effective_levels_explained(users(spark, d), grants(spark, d))


@query(
    "legacy_levels",
    check_sql(
        """SELECT user_id, 'default' AS collection, 1 AS level FROM users_fx
          WHERE role_name <> 'admin'
        UNION ALL
        SELECT user_id, n_name, 3 FROM users_fx JOIN region ON ldap_group = r_name
          JOIN nation ON n_regionkey = r_regionkey WHERE role_name <> 'admin'""",
        "users",
    ),
)
def legacy_levels(spark, d):
    mapped = (
        fx.table(spark, d, "nation").join(
            fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("r_name").alias("ldap_group"), F.col("n_name").alias("collection"))
    )
    return A.legacy_levels(users(spark, d), mapped, grants(spark, d).filter("level > 3"))


@query(
    "access_check",
    check_sql(
        f"""WITH {BASE}, req AS (
          SELECT event_id, cast(user_id AS VARCHAR) AS user_id,
            CASE WHEN event_id % 26 = 25 THEN 'default' ELSE 'NATION_' || (event_id % 26) END
              AS collection,
            CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'create' ELSE 'modify' END
              AS action FROM events)
        SELECT event_id, user_id, collection, action,
          coalesce(u.role_name = 'admin', false) OR coalesce(l.level, 0) >=
            CASE action WHEN 'read' THEN 1 WHEN 'create' THEN 2 ELSE 3 END AS allowed
        FROM req LEFT JOIN levels_fx l USING (user_id, collection)
          LEFT JOIN users_fx u USING (user_id)""",
        "users", "grants",
    ),
)
def access_check(spark, d):
    return A.check_access(users(spark, d), grants(spark, d), requests(spark, d))


@query(
    "accessible_collections",
    check_sql(
        f"""WITH {BASE} SELECT user_id, collection FROM levels_fx WHERE level >= 1
          AND collection IN (SELECT collection FROM coll_fx UNION ALL SELECT 'default')
        UNION ALL SELECT user_id, '*' FROM users_fx WHERE role_name = 'admin'""",
        "users", "grants",
    ),
)
def accessible_collections(spark, d):
    g = grants(spark, d)
    known = collections(spark, d).union(spark.range(1).select(F.lit("default")))
    return A.accessible_collections(users(spark, d), known, g)


@query(
    "provision_group_grants",
    check_sql(
        f"""WITH {BASE} SELECT subject, collection, 1 AS level FROM
          (SELECT DISTINCT ldap_group AS subject FROM users_fx)
          JOIN coll_fx ON lower(subject) = lower(collection)
        WHERE (subject, collection) NOT IN
          (SELECT (subject, collection) FROM grants_fx WHERE subject_type = 'group')""",
        "users", "grants",
    ),
)
def provision_group_grants(spark, d):
    return A.provision_group_grants(users(spark, d), collections(spark, d), grants(spark, d))


@query(
    "known_collections",
    check_sql(
        f"""WITH {BASE} SELECT 'default' AS collection UNION SELECT collection FROM coll_fx
        UNION SELECT collection FROM grants_fx""",
        "users", "grants",
    ),
)
def known_collections(spark, d):
    return A.known_collections(collections(spark, d), grants(spark, d))


GROUPS = """
    groups_fx AS (
      SELECT lower(name) AS folded, arg_min(name, (o1, o2)) AS name FROM (
        SELECT ldap_group AS name, 0 AS o1, ord AS o2 FROM users_fx
        UNION ALL SELECT subject, 1, grant_ord FROM grants_fx WHERE subject_type = 'group')
      GROUP BY 1)"""


@query(
    "known_groups",
    check_sql(f"WITH {GROUPS} SELECT folded, name FROM groups_fx", "users", "grants"),
)
def known_groups(spark, d):
    return A.known_groups(users(spark, d), grants(spark, d))


@query(
    "access_matrix",
    check_sql(
        f"""WITH {BASE}, {GROUPS}, subj AS (
          SELECT 'role' AS subject_type, name AS key, name AS subject, name = 'admin' AS unrestricted
          FROM roles_fx WHERE name <> 'api'
          UNION SELECT 'user', user_id, user_id, role_name = 'admin' FROM users_fx
          UNION SELECT subject_type, subject, subject, false FROM grants_fx g
            WHERE subject_type <> 'group' AND NOT EXISTS (SELECT 1 FROM users_fx u
              WHERE g.subject_type = 'user' AND u.user_id = g.subject)
              AND NOT (subject_type = 'role' AND subject = 'admin')
          UNION SELECT 'group', folded, name, false FROM groups_fx WHERE folded IN (
            SELECT lower(collection) FROM coll_fx UNION ALL SELECT lower(collection) FROM grants_fx
            UNION ALL SELECT lower(subject) FROM grants_fx WHERE subject_type = 'group')),
        cells AS (SELECT subject_type, CASE subject_type WHEN 'group' THEN lower(subject)
            ELSE subject END AS key, collection, max(level) AS level FROM grants_fx GROUP BY 1, 2, 3)
        SELECT subject_type, subject, unrestricted, collection, coalesce(level, 0) AS level
        FROM subj LEFT JOIN cells USING (subject_type, key)""",
        "users", "grants", "roles",
    ),
)
def access_matrix(spark, d):
    return A.access_matrix(
        users(spark, d), roles(spark, d), grants(spark, d), collections(spark, d)
    )


@query(
    "matching_roles",
    check_sql(
        f"""WITH {BASE},
        own AS (SELECT p.*, CASE WHEN role_name <> '' THEN role_name ELSE role_enum END AS cur
                FROM plain_fx p),
        pools AS (SELECT name, string_perms AS pool FROM roles_fx),
        open_fx AS (SELECT o.*, coalesce(p.pool, '') AS pool FROM own o LEFT JOIN pools p
                    ON p.name = o.cur
                    WHERE o.user_id IN (SELECT subject FROM grants_fx WHERE subject_type = 'user')),
        pairs AS (SELECT o.user_id, o.ldap_group, p.name,
                    CASE WHEN p.name IN ('admin', 'operator', 'viewer', 'api', 'user') THEN p.name
                      ELSE 'viewer' END AS enum_name
                  FROM open_fx o JOIN pools p ON p.pool = o.pool AND p.name <> o.cur
                    AND p.name NOT IN ('api', 'admin')),
        cand AS (SELECT user_id, name, collection, max(level) AS lv FROM (
            SELECT p.user_id, p.name, g.collection, g.level FROM pairs p JOIN grants_fx g
              ON (g.subject_type = 'role' AND g.subject IN (p.name, p.enum_name))
              OR (g.subject_type = 'group' AND lower(g.subject) = lower(p.ldap_group))
            UNION ALL SELECT user_id, name, 'default', 1 FROM pairs) GROUP BY 1, 2, 3),
        now_fx AS (SELECT p.user_id, p.name, l.collection, l.level AS lv
                   FROM pairs p JOIN levels_fx l USING (user_id))
        SELECT user_id, name AS role FROM cand FULL JOIN now_fx USING (user_id, name, collection)
        GROUP BY 1, 2 HAVING count(*) FILTER (cand.lv IS DISTINCT FROM now_fx.lv) = 0""",
        "users", "grants", "roles",
    ),
)
def matching_roles(spark, d):
    u = users(spark, d)
    pools = roles(spark, d).select(F.col("name").alias("_n"), F.col("permissions").alias("desired"))
    wanted = u.join(pools, A.canonical_role() == F.col("_n"), "left").withColumn(
        "desired", F.coalesce("desired", F.array().cast("array<string>"))
    ).drop("_n")
    return A.matching_roles(wanted, roles(spark, d), grants(spark, d))


@query(
    "erase_subject",
    check_sql(
        """WITH gone AS (SELECT user_id FROM users_fx WHERE NOT is_active)
        SELECT 'jobs' AS table_name, count(*) AS erased FROM jobs_fx
          WHERE user_id IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'grants', count(*) FROM grants_fx
          WHERE subject IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'users', count(*) FROM users_fx
          WHERE user_id IN (SELECT user_id FROM gone)""",
        "users", "grants", "jobs",
    ),
)
def erase_subject(spark, d):
    u = users(spark, d)
    tables = {
        "jobs": (fx.shared(spark, d, "jobs"), "user_id"),
        "grants": (grants(spark, d), "subject"),
        "users": (u, "user_id"),
    }
    return A.erase_subject(tables, u.filter(~F.col("is_active")))[1]


@query(
    "dashboard_counts",
    check_sql(
        """SELECT 'users' AS metric, count(*) AS n FROM users_fx
        UNION ALL SELECT 'active_users', count(*) FROM users_fx WHERE is_active
        UNION ALL SELECT 'manual_roles', count(*) FROM users_fx WHERE manual_role
        UNION ALL SELECT 'roles', count(*) FROM roles_fx
        UNION ALL SELECT 'custom_roles', count(*) FROM roles_fx
          WHERE name NOT IN ('admin', 'user', 'api')
        UNION ALL SELECT 'grants', count(*) FROM grants_fx""",
        "users", "roles", "grants",
    ),
)
def dashboard_counts(spark, d):
    return A.dashboard(users(spark, d), roles(spark, d), grants(spark, d))


@query(
    "role_members",
    check_sql(
        """SELECT name, count(user_id) AS members FROM roles_fx LEFT JOIN users_fx
          ON name = CASE WHEN role_name <> '' THEN role_name ELSE role_enum END GROUP BY name""",
        "users", "roles",
    ),
)
def role_members(spark, d):
    return A.role_members(users(spark, d), roles(spark, d))


@query(
    "role_member_list",
    check_sql(
        """SELECT user_id, username, name FROM roles_fx JOIN users_fx
          ON name = CASE WHEN role_name <> '' THEN role_name ELSE role_enum END""",
        "users", "roles",
    ),
)
def role_member_list(spark, d):
    return A.role_member_list(users(spark, d), roles(spark, d))


@query(
    "orphan_subjects",
    check_sql(
        """SELECT subject AS user_id FROM grants_fx WHERE subject_type = 'user'
        UNION SELECT cast(user_id AS VARCHAR) FROM events EXCEPT SELECT user_id FROM users_fx""",
        "users", "grants",
    ),
)
def orphan_subjects(spark, d):
    tokens = fx.table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"))
    return A.orphan_subjects(users(spark, d), grants(spark, d), tokens)


def _permissions(spark, d):
    n = F.col("ord")
    none = F.array().cast("array<string>")
    return users(spark, d).withColumn(
        "raised", F.when(n % 3 == 0, F.array(F.lit("audit"))).otherwise(none)
    ).withColumn(
        "denied", F.when(n % 4 == 0, F.array(F.lit("translate"))).otherwise(none)
    ).withColumn("desired", F.array(F.lit("read"), F.lit("export")))


@query(
    "effective_permissions",
    check_sql(
        """SELECT user_id, p AS permission FROM (
          SELECT user_id, ord, unnest(string_split(string_perms, ',')) AS p
          FROM users_fx JOIN roles_fx
            ON name = CASE WHEN role_name <> '' THEN role_name ELSE role_enum END)
          WHERE NOT (ord % 4 = 0 AND p = 'translate')
        UNION ALL SELECT user_id, 'audit' FROM users_fx WHERE ord % 3 = 0""",
        "users", "roles",
    ),
)
def effective_permissions(spark, d):
    return A.effective_permissions(_permissions(spark, d), roles(spark, d))


@query(
    "permission_deviation",
    check_sql(
        """SELECT user_id,
          array_to_string(list_sort(list_filter(['read', 'export'],
            lambda x: NOT list_contains(pool, x))), ',') AS raised,
          array_to_string(list_sort(list_filter(pool,
            lambda x: NOT list_contains(['read', 'export'], x))), ',') AS lowered
        FROM (SELECT user_id, coalesce(string_split(string_perms, ','), []::VARCHAR[]) AS pool
              FROM users_fx LEFT JOIN roles_fx
                ON name = CASE WHEN role_name <> '' THEN role_name ELSE role_enum END)""",
        "users", "roles",
    ),
)
def permission_deviation(spark, d):
    out = A.permission_deviation(_permissions(spark, d), roles(spark, d))
    return out.select(
        "user_id", F.array_join("raised", ",").alias("raised"),
        F.array_join("lowered", ",").alias("lowered"),
    )
