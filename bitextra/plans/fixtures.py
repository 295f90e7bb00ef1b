"""Bindings of the driver's tables to the frames the operators take.

The tables hold no Cyrillic text, no glossaries and no job log, so the frames
are derived from them by deterministic expressions over whole tables. Frames
whose definition is plain SQL are kept once and used on both sides of the
check; the others have a Spark form here and a DuckDB form in ``CTE``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letter-by-letter rendering that injects Cyrillic text.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопярстуввхыз"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Bytes of files that one partition of a spread table stands for.
SPREAD_BYTES = 16 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that arrives in fewer files than there are cores.

    The number of partitions follows the size of the files, so that no task's
    share grows with the table. A table of many files passes untouched.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    places = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in places)
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)), *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line: doc_id, unit_idx, line."""
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_idx", "line"))
        .withColumn("unit_idx", F.col("unit_idx").cast("long"))
        .filter(F.col("line").rlike(r"\S"))
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel units with one injected phenomenon per class k (0..11)."""
    n = F.col("n").cast("string")
    numbered = (
        lines(spark, sf_dir)
        .withColumn("k", (F.col("doc_id") * 31 + F.col("unit_idx") * 7) % 12)
        .withColumn("n", 100 + (F.col("doc_id") * 13 + F.col("unit_idx")) % 900)
        .withColumn(
            "_source",
            F.when(
                F.col("k").isin(6, 7, 8), F.concat(F.lit("No. "), n, F.lit(" "), "line")
            ).otherwise(F.col("line")),
        )
    )
    foreign = F.translate(F.lower("line"), LATIN, CYRILLIC)
    k = F.col("k")
    target = (
        F.when(k == 0, F.lit(""))
        .when(k == 1, F.lit(None).cast("string"))
        .when(k == 2, foreign)
        .when(k == 3, F.concat(F.lit("The project "), foreign))
        .when(k == 4, F.concat(F.lit("ГОСТ 21.1101-2013 "), "line"))
        .when(k == 5, F.concat("line", F.lit(" fortheproject andSP")))
        .when(k == 6, F.concat(F.lit("No. "), (F.col("n") + 1).cast("string"), F.lit(" "), "line"))
        .when(k == 7, F.concat(F.lit("No "), n, F.lit(" "), "line"))
        .otherwise(F.col("_source"))
    )
    # The generator keeps the derived text a column: filters on it are not
    # pushed below and so do not repeat the whole derivation.
    return numbered.select(
        "doc_id", "unit_idx", "k", "n", "line",
        F.inline(F.array(F.struct(F.col("_source").alias("source"), target.alias("target")))),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms: every word of four letters or more in ``benchmark``."""
    words = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias(
            "pos", "term"
        ),
    )
    return (
        words.groupBy("term")
        .agg(F.min(F.col("item_id") * 100000 + F.col("pos")).alias("id"))
        .withColumn("replacement", F.upper(F.translate("term", LATIN, CYRILLIC)))
    )


# Frames written once in SQL both engines read; {name} stands for a table.
SHARED = {
    "glossary": f"""
        SELECT p_partkey AS id, p_name AS en_word,
               translate(p_name, '{LATIN}', '{CYRILLIC}') AS ru_word,
               CASE WHEN p_partkey % 7 = 0 THEN '' ELSE upper(p_name) END AS sb_word,
               CASE WHEN p_partkey % 9 = 0 THEN p_name ELSE '词汇' END AS ch_word,
               CASE p_partkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'cad' ELSE 'legal' END
                 AS collection_id
        FROM {{part}}""",
    "jobs": """
        SELECT cast(o_orderkey AS string) AS job_id, cast(o_custkey AS string) AS user_id,
               concat('file', cast(o_orderkey % 97 AS string),
                 CASE o_orderkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.pdf'
                 ELSE '.DXF' END) AS filename,
               CASE o_orderstatus
                 WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END
                 WHEN 'F' THEN 'completed'
                 ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'cancelled' END END AS status,
               CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'received'
                 WHEN 2 THEN 'validation' WHEN 3 THEN 'conversion' WHEN 4 THEN 'extraction'
                 WHEN 5 THEN 'glossary' WHEN 6 THEN 'translation' ELSE 'save' END AS current_stage,
               o_orderkey AS seq, o_orderdate AS created_at,
               cast(o_orderkey % 7 AS int) AS total_batches,
               cast(o_orderkey % 5 AS int) AS completed_batches,
               o_totalprice AS elapsed_seconds,
               o_orderkey % 50 = 0 AS keep_artifacts
        FROM {orders}""",
    "users": """
        SELECT cast(c_custkey AS string) AS user_id, c_name AS username,
               CASE WHEN c_custkey % 100 = 0 THEN 'admin' WHEN c_custkey % 100 = 1 THEN 'operator'
                 WHEN c_custkey % 100 = 2 THEN 'api' WHEN c_custkey % 100 = 3 THEN ''
                 ELSE c_mktsegment END AS role_name,
               CASE WHEN c_custkey % 2 = 0 THEN 'viewer' ELSE 'user' END AS role_enum,
               upper(r_name) AS ldap_group, n_nationkey AS nation_key,
               c_custkey % 11 <> 0 AS is_active, c_custkey % 13 = 0 AS manual_role,
               c_custkey AS ord
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
          JOIN {region} ON n_regionkey = r_regionkey""",
    "roles": """
        SELECT name, string_perms FROM (
          SELECT c_mktsegment AS name,
                 concat('read,translate', CASE WHEN length(c_mktsegment) % 2 = 0
                   THEN ',export' ELSE '' END) AS string_perms
          FROM {customer} GROUP BY c_mktsegment
          UNION ALL SELECT 'admin', 'admin,export,read,translate'
          UNION ALL SELECT 'user', 'read,translate'
          UNION ALL SELECT 'api', 'read')""",
    "grants": """
        SELECT subject_type, subject, collection, level,
               row_number() OVER (PARTITION BY subject_type
                 ORDER BY subject, collection, level) AS grant_ord
        FROM (
          SELECT 'group' AS subject_type,
                 CASE WHEN n_nationkey % 2 = 1 THEN lower(r_name) ELSE r_name END AS subject,
                 n_name AS collection, cast(n_nationkey % 4 AS int) AS level
          FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
          UNION ALL
          SELECT 'role', c_mktsegment, n_name, cast((n_nationkey + length(c_mktsegment)) % 4 AS int)
          FROM (SELECT c_mktsegment, n_name, n_nationkey FROM {customer}
                  JOIN {nation} ON c_nationkey = n_nationkey
                GROUP BY c_mktsegment, n_name, n_nationkey)
          WHERE (n_nationkey + length(c_mktsegment)) % 3 = 0
          UNION ALL
          SELECT 'user', cast(c_custkey AS string), n_name, cast(c_custkey % 4 AS int)
          FROM {customer} JOIN {nation} ON n_nationkey = (c_custkey * 7) % 25
          WHERE c_acctbal < 1500
          UNION ALL SELECT 'role', 'user', 'default', 2
          UNION ALL SELECT 'user', '-1', 'ghost', 2)""",
    "monitoring": """
        SELECT event_id, cast(event_id % 500 AS string) AS job_id,
               cast(user_id AS string) AS owner_id,
               concat('file', cast(event_id % 97 AS string), '.docx') AS filename,
               CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed'
                 WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts
        FROM {events}""",
    "journal": """
        SELECT event_id, ts, cast(ts AS date) AS log_date,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning'
                 WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
               concat('stage', cast(event_id % 8 AS string)) AS stage,
               concat('user ', cast(user_id AS string)) AS message,
               concat('file', cast(event_id % 97 AS string), '.docx') AS filename
        FROM {events}""",
}

_SOURCES = {
    "glossary": ("part",),
    "jobs": ("orders",),
    "users": ("customer", "nation", "region"),
    "roles": ("customer",),
    "grants": ("nation", "region", "customer"),
    "monitoring": ("events",),
    "journal": ("events",),
}


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    args = {t: table(spark, sf_dir, t) for t in _SOURCES[name]}
    return spark.sql(SHARED[name], **args)


_PLAIN = {t: t for names in _SOURCES.values() for t in names}

CTE = {
    "lines": """
        lines_fx AS (
          SELECT doc_id, unit_idx, line FROM (
            SELECT doc_id, unnest(p) AS line, cast(unnest(range(len(p))) AS BIGINT) AS unit_idx
            FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
          WHERE regexp_matches(line, '\\S'))""",
    "units": f"""
        units_fx AS (
          SELECT doc_id, unit_idx, k, n, line, source,
            CASE k WHEN 0 THEN '' WHEN 1 THEN NULL
              WHEN 2 THEN translate(lower(line), '{LATIN}', '{CYRILLIC}')
              WHEN 3 THEN 'The project ' || translate(lower(line), '{LATIN}', '{CYRILLIC}')
              WHEN 4 THEN 'ГОСТ 21.1101-2013 ' || line
              WHEN 5 THEN line || ' fortheproject andSP'
              WHEN 6 THEN 'No. ' || (n + 1) || ' ' || line
              WHEN 7 THEN 'No ' || n || ' ' || line
              ELSE source END AS target
          FROM (SELECT *, CASE WHEN k IN (6, 7, 8) THEN 'No. ' || n || ' ' || line
                          ELSE line END AS source
                FROM (SELECT *, (doc_id * 31 + unit_idx * 7) % 12 AS k,
                             100 + (doc_id * 13 + unit_idx) % 900 AS n FROM lines_fx)))""",
    "terms": f"""
        terms_fx AS (
          SELECT term, min(item_id * 100000 + pos) AS id,
                 upper(translate(term, '{LATIN}', '{CYRILLIC}')) AS replacement
          FROM (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS pos
                FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS w
                      FROM benchmark))
          GROUP BY term)""",
}
for _name, _sql in SHARED.items():
    CTE[_name] = f"{_name}_fx AS ({_sql.format(**_PLAIN)})"

_NEEDS = {"units": ("lines",)}


def check_sql(body: str, *names: str) -> str:
    """``WITH`` the named frames (name_fx) in front of a query."""
    ordered: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in ordered:
                ordered.append(n)
    ctes = ",".join(CTE[n] for n in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
