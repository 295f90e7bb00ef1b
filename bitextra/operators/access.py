"""Who may read or change which term collection.

Frames: users(user_id, username, role_name, role_enum, ldap_groups array, …),
grants(grant_ord, subject_type, subject, collection, level), roles(name,
permissions array), collections(collection).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitextra.operators.lookup import lookup
from bitextra.operators.ranking import salted_lookup
from bitextra.session import cut_lineage

# Names and levels of the access model.
ADMIN, API, USER = "admin", "api", "user"
LEGACY_TO_USER = ("operator", "viewer")
ROLE_ENUM = ("admin", "operator", "viewer", "api", "user")
DEFAULT = "default"
NONE, VIEW, ADD, MODIFY = 0, 1, 2, 3
REQUIRED = {"read": VIEW, "create": ADD, "write": MODIFY, "modify": MODIFY}


def normalize_grants(grants: DataFrame) -> DataFrame:
    """Level clamped to 0-3, or derived from the legacy flags when null."""
    level = F.when(
        F.col("level").isNull(),
        F.when(F.col("write"), MODIFY).when(F.col("read"), VIEW).otherwise(NONE),
    ).otherwise(F.greatest(F.lit(NONE), F.least(F.lit(MODIFY), F.col("level"))))
    return (
        grants.withColumn("level", level.cast("int"))
        .withColumn("read", F.col("level") >= VIEW)
        .withColumn("write", F.col("level") >= MODIFY)
    )


def canonical_role() -> Column:
    """The stored role name, else the enum value."""
    return F.coalesce(
        F.when(F.col("role_name") != "", F.col("role_name")), F.col("role_enum"), F.lit("")
    )


def migrate_roles(users: DataFrame) -> DataFrame:
    """Legacy roles collapse into user; api stays; missing flags are stamped."""
    role = canonical_role()
    return users.select(
        "user_id",
        F.when(role.isin(*LEGACY_TO_USER), F.lit(USER)).otherwise(role).alias("role"),
        role.isin(*LEGACY_TO_USER).alias("migrated"),
        (~F.coalesce("manual_role", F.lit(False))).alias("stamped"),
        (role == API).alias("api_preserved"),
    )


def directory_role(users: DataFrame, admin_group: str) -> DataFrame:
    """Role the directory would give: admin for members of the admin group."""
    wanted = admin_group.strip().lower()
    member = F.exists("ldap_groups", lambda g: F.lower(F.trim(g)) == wanted)
    return users.select(
        "user_id",
        F.when(member & F.lit(bool(wanted)), F.lit(ADMIN)).otherwise(F.lit(USER))
        .alias("directory_role"),
    )


def _role_names() -> Column:
    return F.array_distinct(
        F.filter(F.array("role_name", "role_enum"), lambda r: F.coalesce(r != "", F.lit(False)))
    )


def is_admin() -> Column:
    return F.array_contains(_role_names(), ADMIN)


def subjects(users: DataFrame) -> DataFrame:
    """One row per user and subject: role names, folded groups, the user itself."""
    def of(kind: str, names: Column) -> Column:
        return F.transform(
            names, lambda n: F.struct(F.lit(kind).alias("subject_type"), n.alias("key"))
        )

    groups = F.array_distinct(F.transform("ldap_groups", lambda g: F.lower(g)))
    every = F.concat(
        of("role", _role_names()), of("group", groups), of("user", F.array("user_id"))
    )
    return users.select("user_id", F.inline(every))


def _keyed(grants: DataFrame) -> DataFrame:
    return grants.withColumn(
        "key",
        F.when(F.col("subject_type") == "group", F.lower("subject")).otherwise(F.col("subject")),
    )


def grants_for(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Every grant that applies to a user; groups match ignoring case.

    A group or role with a third of all users is a hot key: its users are
    salted and only its grants are copied.
    """
    return salted_lookup(
        subjects(users), _keyed(grants), ["subject_type", "key"], ["user_id"], how="inner"
    ).select("user_id", "subject_type", "subject", "collection", "level", "grant_ord")


def _profiled(users: DataFrame) -> DataFrame:
    """Users with the roles and folded groups that decide their shared levels.

    Users of equal roles and groups have one profile; there are as many
    profiles as such combinations, however many users.
    """
    groups = F.coalesce("ldap_groups", F.array().cast("array<string>"))
    folded = F.array_sort(F.array_distinct(F.transform(groups, lambda g: F.lower(g))))
    sides = users.withColumns({"_roles": F.array_sort(_role_names()), "_groups": folded})
    return sides.withColumn("_profile", F.to_json(F.struct("_roles", "_groups")))


def _solved(profiled: DataFrame, grants: DataFrame) -> DataFrame:
    """Role and group levels of every profile and collection, solved once and written."""
    def of(kind: str, names: str) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("subject_type"), n.alias("key")))

    profiles = profiled.select("_profile", "_roles", "_groups").dropDuplicates(["_profile"])
    sides = profiles.select("_profile", F.inline(F.concat(of("role", "_roles"), of("group", "_groups"))))
    common = _keyed(grants.filter("subject_type IN ('role', 'group')"))
    hits = lookup(sides, common, ["subject_type", "key"], ["_profile"], "inner").select(
        "_profile", "subject_type", "subject", "collection", "level", "grant_ord"
    )
    floor = profiles.select(
        "_profile", F.lit("floor").alias("subject_type"), F.lit("").alias("subject"),
        F.lit(DEFAULT).alias("collection"), F.lit(VIEW).alias("level"), F.lit(0).cast("long").alias("grant_ord"),
    )
    group, role = F.col("subject_type") == "group", F.col("subject_type") == "role"
    first = F.struct("level", (-F.col("grant_ord")).alias("o"))
    return cut_lineage(
        hits.unionByName(floor).groupBy("_profile", "collection").agg(
            F.max(F.when(role, F.col("level"))).alias("role_level"),
            F.max_by(F.when(role, F.col("subject")), F.when(role, first)).alias("role_subject"),
            F.max(F.when(group, F.col("level"))).alias("group_level"),
            F.max_by(F.when(group, F.col("subject")), F.when(group, first)).alias("group_subject"),
        )
    )


def _personal(grants: DataFrame) -> DataFrame:
    """The last personal grant of every user and collection."""
    own = grants.filter("subject_type = 'user'")
    return own.groupBy(F.col("subject").alias("user_id"), "collection").agg(
        F.max_by("level", "grant_ord").alias("personal_level")
    )


def _levels(users: DataFrame, grants: DataFrame, include_personal: bool) -> DataFrame:
    plain = _profiled(users.filter(~is_admin()))
    base = lookup(plain.select("user_id", "_profile"), _solved(plain, grants), ["_profile"], ["user_id"], "inner")
    if not include_personal:
        return base.drop("_profile").withColumn("personal_level", F.lit(None).cast("int"))
    own = lookup(_personal(grants), plain.select("user_id").distinct(), ["user_id"], ["user_id", "collection"], "left_semi")
    return base.drop("_profile").join(own, ["user_id", "collection"], "full_outer")


def _level() -> Column:
    """The level of a row of shared and personal levels."""
    raw = F.coalesce("personal_level", F.greatest("role_level", "group_level"), F.lit(NONE))
    return (
        F.when(F.col("collection") == DEFAULT, F.greatest(raw, F.lit(VIEW))).otherwise(raw).cast("int")
    )


def effective_levels_explained(
    users: DataFrame, grants: DataFrame, include_personal: bool = True
) -> DataFrame:
    """Level per user and collection with its source.

    Role and group grants combine to their maximum, a personal grant replaces
    that value (level 0 is a denial; of several the last wins), ``default`` is
    floored at view. The role is named when it is at least as strong as the
    group; the earliest grant names a tie. Administrators are unrestricted and
    have no rows.
    """
    by_role = F.col("role_level").isNotNull() & (
        F.col("role_level") >= F.coalesce("group_level", F.lit(NONE))
    )
    return _levels(users, grants, include_personal).select(
        "user_id",
        "collection",
        _level().alias("level"),
        F.when(F.col("personal_level").isNotNull(), F.lit("personal"))
        .when(by_role, F.concat(F.lit("role:"), "role_subject"))
        .when(F.col("group_level").isNotNull(), F.concat(F.lit("group:"), "group_subject"))
        .when(F.col("collection") == DEFAULT, F.lit("default"))
        .otherwise(F.lit("none")).alias("source"),
    )


def effective_levels(
    users: DataFrame, grants: DataFrame, include_personal: bool = True
) -> DataFrame:
    """Level per user and collection without the source."""
    return effective_levels_explained(users, grants, include_personal).drop("source")


def legacy_levels(users: DataFrame, group_map: DataFrame, grants: DataFrame) -> DataFrame:
    """Levels from the group map, used only while no grant exists at all.

    ``group_map``: ldap_group (exact spelling), collection. Mapped collections
    are modifiable, ``default`` is viewable.
    """
    plain = users.filter(~is_admin())
    if not grants.isEmpty():
        return effective_levels(users, grants)
    members = plain.select("user_id", F.explode("ldap_groups").alias("ldap_group"))
    mapped = salted_lookup(members, group_map, ["ldap_group"], ["user_id"], how="inner").select(
        "user_id", "collection", F.lit(MODIFY).alias("level")
    )
    base = plain.select("user_id", F.lit(DEFAULT).alias("collection"), F.lit(VIEW).alias("level"))
    return mapped.unionByName(base).groupBy("user_id", "collection").agg(
        F.max("level").alias("level")
    )


def can_access(users: DataFrame, levels: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each request (user_id, collection, action) is allowed."""
    required = F.create_map(*[F.lit(x) for kv in REQUIRED.items() for x in kv])
    admins = users.select("user_id", is_admin().alias("_admin"))
    row = requests.columns
    wanted = levels.select("user_id", "collection", "level")
    leveled = salted_lookup(requests, wanted, ["user_id", "collection"], row)
    return (
        salted_lookup(leveled, admins, ["user_id"], row)
        .withColumn(
            "allowed",
            F.coalesce("_admin", F.lit(False))
            | (F.coalesce("level", F.lit(NONE))
               >= F.coalesce(required[F.col("action")], F.lit(VIEW))),
        )
        .drop("_admin", "level")
    )


def check_access(users: DataFrame, grants: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each request (user_id, collection, action) is allowed, from the grants.

    Levels are looked up for the requested users and collections only: a
    request meets its user's profile, the profile's level and the personal
    grant. ``requests`` stay one row each; a user that is unknown is refused.
    """
    required = F.create_map(*[F.lit(x) for kv in REQUIRED.items() for x in kv])
    row = requests.columns
    asked = cut_lineage(requests.select("user_id").distinct())
    known = cut_lineage(
        _profiled(lookup(users, asked, ["user_id"], ["user_id"], "left_semi"))
        .select("user_id", is_admin().alias("_admin"), "_roles", "_groups", "_profile")
    )
    solved = _solved(known.filter(~F.col("_admin")), grants).select(
        "_profile", "collection", "role_level", "group_level"
    )
    own = lookup(_personal(grants), asked, ["user_id"], ["user_id", "collection"], "left_semi")
    found = lookup(requests, known.drop("_roles", "_groups"), ["user_id"], row)
    found = lookup(found, solved, ["_profile", "collection"], row)
    found = lookup(found, own, ["user_id", "collection"], row)
    plain = F.col("_profile").isNotNull()
    enough = F.when(plain, _level()).otherwise(F.lit(NONE)) >= F.coalesce(required[F.col("action")], F.lit(VIEW))
    return found.select(*row, (F.coalesce("_admin", F.lit(False)) | enough).alias("allowed"))


def accessible_collections(users: DataFrame, collections: DataFrame, grants: DataFrame):
    """Readable collections per user (J19); ``*`` stands for all of them (admin)."""
    readable = effective_levels(users, grants).filter(F.col("level") >= VIEW)
    return (
        salted_lookup(
            readable, collections.select("collection").distinct(), ["collection"], ["user_id"],
            "left_semi",
        )
        .select("user_id", "collection")
        .unionByName(users.filter(is_admin()).select("user_id", F.lit("*").alias("collection")))
    )


def provision_group_grants(users: DataFrame, collections: DataFrame, grants: DataFrame):
    """View grants for groups named like a collection and without any grant row."""
    groups = users.select(F.explode("ldap_groups").alias("subject")).distinct()
    folded = collections.groupBy(F.lower("collection").alias("_fold")).agg(
        F.max("collection").alias("collection")
    )
    fresh = groups.filter(F.col("subject") != "").join(
        folded, F.lower("subject") == F.col("_fold")
    )
    existing = grants.filter(F.col("subject_type") == "group").select("subject", "collection")
    return fresh.join(existing, ["subject", "collection"], "left_anti").select(
        "subject", "collection", F.lit(VIEW).alias("level")
    )


def known_collections(collections: DataFrame, grants: DataFrame) -> DataFrame:
    """``default``, every table and everything granted, once."""
    spark = collections.sparkSession
    base = spark.range(1).select(F.lit(DEFAULT).alias("collection"))
    return base.union(collections.select("collection")).union(grants.select("collection")).distinct()


def known_groups(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Groups of users and grants folded by case, first spelling kept.

    Users come before grants; ``ord`` orders users, ``grant_ord`` grants.
    """
    of_users = users.select(F.explode("ldap_groups").alias("name"), F.lit(0).alias("o1"),
                            F.col("ord").alias("o2"))
    of_grants = grants.filter(F.col("subject_type") == "group").select(
        F.col("subject").alias("name"), F.lit(1).alias("o1"), F.col("grant_ord").alias("o2")
    )
    return (
        of_users.unionByName(of_grants)
        .groupBy(F.lower("name").alias("folded"))
        .agg(F.min_by("name", F.struct("o1", "o2")).alias("name"))
    )


def access_matrix(
    users: DataFrame, roles: DataFrame, grants: DataFrame, collections: DataFrame
) -> DataFrame:
    """Subjects and their cells (J21), long and sparse.

    A row per subject and granted collection with the maximum level; a subject
    without grants has one row with a null collection. A cell that has no row
    is level 0, so subjects are never multiplied by collections. The api role
    is hidden; a user's group shows when it is named like a collection or has
    a grant.
    """
    names = known_collections(collections, grants)
    shown = (
        known_groups(users, grants)
        .join(names.select(F.lower("collection").alias("folded")).distinct()
              .union(grants.filter("subject_type = 'group'").select(F.lower("subject")).distinct())
              .distinct(), "folded", "left_semi")
        .select(F.lit("group").alias("subject_type"), F.col("folded").alias("key"),
                F.col("name").alias("subject"), F.lit(False).alias("unrestricted"))
    )
    of_roles = roles.filter(F.col("name") != API).select(
        F.lit("role").alias("subject_type"), F.col("name").alias("key"),
        F.col("name").alias("subject"), (F.col("name") == ADMIN).alias("unrestricted"),
    )
    of_users = users.select(
        F.lit("user").alias("subject_type"), F.col("user_id").alias("key"),
        F.col("user_id").alias("subject"),
        F.coalesce(F.col("role_name") == ADMIN, F.lit(False)).alias("unrestricted"),
    )
    granted = grants.filter("subject_type <> 'group'").select(
        "subject_type", F.col("subject").alias("key"), "subject",
        ((F.col("subject_type") == "role") & (F.col("subject") == ADMIN)).alias("unrestricted"),
    )
    every = (
        of_roles.unionByName(of_users).unionByName(granted)
        .groupBy("subject_type", "key")
        .agg(F.first("subject").alias("subject"), F.bool_or("unrestricted").alias("unrestricted"))
        .unionByName(shown)
    )
    cells = _keyed(grants).groupBy("subject_type", "key", "collection").agg(
        F.max("level").alias("level")
    )
    return every.join(cells, ["subject_type", "key"], "left").select(
        "subject_type", "subject", "unrestricted", "collection",
        F.coalesce("level", F.lit(NONE)).alias("level"),
    )


def _permission_key(c: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def matching_roles(
    users: DataFrame, roles: DataFrame, grants: DataFrame, desired: str = "desired"
) -> DataFrame:
    """Other roles that would leave a user's rights and levels unchanged.

    Candidates share the user's desired permission set; their levels without
    personal grants must equal the user's levels with them, collection by
    collection. Users whose state already is the role's get no suggestion.
    Levels of candidates are solved once per role and set of groups; levels are
    compared by their number and two 64-bit hashes over all of them, so users
    are never multiplied by roles and collections.
    """
    plain = users.filter(~is_admin()).withColumn("_role", canonical_role()).withColumn(
        "_want", _permission_key(desired)
    )
    pools = roles.select("name", _permission_key("permissions").alias("_pool"))
    personal = grants.filter("subject_type = 'user'").select(F.col("subject").alias("user_id"))
    own = plain.join(
        pools.select(F.col("name").alias("_role"), F.col("_pool").alias("_own")), "_role", "left"
    ).join(personal.distinct().withColumn("_personal", F.lit(True)), "user_id", "left")
    open_users = own.filter(
        (F.col("_want") != F.coalesce("_own", F.lit(""))) | F.col("_personal").isNotNull()
    )
    pairs = open_users.join(
        pools.filter(~F.col("name").isin(API, ADMIN)).withColumnRenamed("_pool", "_want"), "_want"
    ).filter(F.col("name") != F.col("_role"))
    candidates = _profiled(
        pairs.select(
            "user_id", "name", F.col("name").alias("role_name"), "ldap_groups",
            F.when(F.col("name").isin(*ROLE_ENUM), F.col("name")).otherwise(F.lit("viewer")).alias("role_enum"),
        )
    )
    print_of = {
        "_n": F.count(F.lit(1)),
        "_h0": F.bit_xor(F.xxhash64("collection", "level")),
        "_h1": F.bit_xor(F.xxhash64(F.lit(1), "collection", "level")),
    }
    aggregates = [c.alias(n) for n, c in print_of.items()]
    # One print per profile of (candidate role, groups), and one per user with the state as it is.
    shared = _solved(candidates, grants).withColumn("personal_level", F.lit(None).cast("int"))
    after = shared.select("_profile", "collection", _level().alias("level")).groupBy("_profile").agg(*aggregates)
    now = effective_levels(open_users.drop(*[c for c in open_users.columns if c.startswith("_")]), grants)
    now = now.groupBy("user_id").agg(*aggregates)
    judged = lookup(
        candidates.select("user_id", "name", "_profile"),
        after.withColumnsRenamed({n: f"{n}_after" for n in print_of}), ["_profile"], ["user_id", "name"], "inner",
    )
    same = [F.col(n) == F.col(f"{n}_after") for n in print_of]
    return (
        judged.join(now, "user_id").filter(same[0] & same[1] & same[2])
        .select("user_id", F.col("name").alias("role"))
    )


def erase_subject(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame):
    """Drop the rows of the given users from every table.

    ``tables`` maps a name to (frame, owner column). Returns the cleaned frames
    and a frame with the number of rows erased per table.
    """
    gone = ids.select(F.col("user_id").alias("_gone")).distinct()
    kept, counts = {}, []
    for name, (df, owner) in tables.items():
        match = F.col(owner) == F.col("_gone")
        kept[name] = df.join(gone, match, "left_anti")
        counts.append(
            df.join(gone, match, "left_semi")
            .agg(F.count(F.lit(1)).alias("erased"))
            .select(F.lit(name).alias("table_name"), "erased")
        )
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return kept, report


def dashboard(users: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Six counters, one per row (A13); ``builtin`` marks shipped roles."""
    def rows(df: DataFrame, **counts: Column) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in counts.items()])
        pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("n")) for n in counts]
        return one.select(F.inline(F.array(*pairs)))

    every = F.count(F.lit(1))
    return (
        rows(users, users=every, active_users=F.count_if("is_active"),
             manual_roles=F.count_if("manual_role"))
        .unionByName(rows(roles, roles=every, custom_roles=F.count_if(~F.col("builtin"))))
        .unionByName(rows(grants, grants=every))
    )


def role_members(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Member count of every role, zero included."""
    counts = users.groupBy(canonical_role().alias("name")).agg(F.count(F.lit(1)).alias("members"))
    return roles.select("name").join(counts, "name", "left").select(
        "name", F.coalesce("members", F.lit(0).cast("long")).alias("members")
    )


def role_member_list(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Members of every role, one user per row."""
    named = users.select("user_id", "username", canonical_role().alias("name"))
    return salted_lookup(named, roles.select("name"), ["name"], ["user_id"], "left_semi")


def orphan_subjects(users: DataFrame, grants: DataFrame, tokens: DataFrame) -> DataFrame:
    """Ids with grants or tokens but without a user record."""
    seen = grants.filter("subject_type = 'user' AND subject <> ''").select(
        F.col("subject").alias("user_id")
    ).union(tokens.select("user_id"))
    return seen.distinct().join(users.select("user_id"), "user_id", "left_anti")


def effective_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(role pool - denied) + raised, one permission per row."""
    pools = roles.select(F.col("name").alias("_role"), F.col("permissions").alias("_pool"))
    joined = lookup(users.withColumn("_role", canonical_role()), pools, ["_role"], ["user_id"])
    pool = F.coalesce("_pool", F.array().cast("array<string>"))
    return joined.select(
        "user_id",
        F.explode(F.array_union(F.array_except(pool, F.col("denied")), F.col("raised")))
        .alias("permission"),
    )


def permission_deviation(users: DataFrame, roles: DataFrame, desired: str = "desired"):
    """What has to be raised and lowered to reach the desired set."""
    pools = roles.select(F.col("name").alias("_role"), F.col("permissions").alias("_pool"))
    joined = lookup(users.withColumn("_role", canonical_role()), pools, ["_role"], ["user_id"])
    pool = F.coalesce("_pool", F.array().cast("array<string>"))
    return joined.select(
        "user_id",
        F.array_sort(F.array_except(F.col(desired), pool)).alias("raised"),
        F.array_sort(F.array_except(pool, F.col(desired))).alias("lowered"),
    )
