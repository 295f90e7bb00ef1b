"""The dealt operators over their whole tables: name -> (plan, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_tree import nearest
from .byte_shards import assign_shards
from .chat_format import CONTROL, ESCAPE, digests, format_conversations
from .decontaminate import leaks
from .language_mixture import held_out, learn, predict
from .license_rules import find_licenses
from .near_dup import near_duplicates
from .packing import contract_tokenizer, pack
from .pii_bootstrap import find_pii, joined
from .scaled_sketch import document_fingerprints
from .sparse_suffix import repeated_passages
from .spelling_variants import spelling_variants
from .token_alignment import align

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Plan) -> Plan:
        QUERIES[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_histogram_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_tiered_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False, tokenizer_path=contract_tokenizer())


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN []
    WHEN len(t) < 4 THEN [list_aggregate(t, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(t) - 2), lambda i: list_aggregate(t[i:i + 3], 'string_agg', ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS id, doc_id AS to_id FROM documents
  UNION
  SELECT id, b FROM reach JOIN link ON a = to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT id AS doc_id, min(to_id) AS component_id FROM reach GROUP BY id) r USING (doc_id)
"""


@query("op8_minhash_near_duplicates", NEAR_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_language_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = learn(docs)
    return predict(docs, names, model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "gain"
    )


@query("op3_contextual_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_email"),
        count(1).alias("n_ip"),
        count(2).alias("n_card"),
        count(3).alias("n_phone"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op5_license_signatures")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        "base_labels",
        "labels",
        "score",
    )


def _escaped_length(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE}a')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{ESCAPE}b')"
    return f"length({out})"


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(8 + {_escaped_length("role")} + 8 + {_escaped_length("text")} + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op2_chat_format", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digests(format_conversations(rows.unionByName(extra)))


@query("op1_kmeans_tree_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS t
  FROM documents),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(t) - 48, 1)),
    lambda i: {'i': i, 'h': md5(array_to_string(t[i:i + 49], ' '))})) AS x FROM w),
shared AS (SELECT x.h AS h FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, x.i - 1 AS a, x.i + 49 AS b FROM g SEMI JOIN shared ON g.x.h = shared.h),
cut AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), true)::INT AS fresh FROM hit),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS n FROM cut)
SELECT doc_id, min(a) AS start, max(b) AS "end" FROM run GROUP BY doc_id, n
"""


@query("op7_sparse_suffix_repeats", REPEATS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _kept_hashes(words: str) -> str:
    every = f"""list_transform(range(1, greatest(len({words}) - 4, 1) + 1),
      lambda i: substr(md5(array_to_string({words}[i:i + 4], ' ')), 1, 16))"""
    low = f"list_sort(list_distinct(list_filter({every}, lambda h: h < '2')))"
    return f"CASE WHEN len({words}) = 0 THEN []::VARCHAR[] WHEN len({low}) > 0 THEN {low} ELSE [list_min({every})] END"


def _share(a: str, b: str) -> str:
    return f"""CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a})
      WHEN len({b}) = 0 THEN 1.0 ELSE 0.0 END"""


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"


FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC),
    first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d),
e AS (SELECT doc_id, text, n, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) AS edited FROM n),
w AS (SELECT doc_id, n, edited, {_split("text")} AS wt, {_split("edited")} AS we FROM e),
f AS (SELECT doc_id, n, edited, {_kept_hashes("wt")} AS ft, {_kept_hashes("we")} AS fe FROM w),
g AS (
  SELECT *, coalesce(lead(ft) OVER (ORDER BY doc_id DESC), first_value(ft) OVER (ORDER BY doc_id DESC)) AS fn FROM f)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(ft, '') AS fingerprint,
  array_to_string(fe, '') AS edited_fingerprint, {_share("ft", "fe")} AS near_edited, {_share("ft", "fn")} AS near_next
FROM g
"""


@query("op12_scaled_sketch_fingerprints", FINGERPRINT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("fingerprint", "").alias("fingerprint"),
        F.array_join("edited_fingerprint", "").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), with_groups=False).drop("groups")
