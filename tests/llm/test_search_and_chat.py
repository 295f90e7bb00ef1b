import random

import numpy as np
import pytest
from harness import compare, duck
from pyspark.sql import functions as F

from bitextra.llm.ann_tree import nearest
from bitextra.llm.chat_format import CONTROL, digests, escape, format_conversations, parse, render, unescape
from bitextra.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op2_chat_format", "op7_sparse_suffix_repeats", "op8_minhash_near_duplicates", "op12_scaled_sketch_fingerprints"])
def test_query_against_sql(name, spark, sf_dir):
    fn, sql = QUERIES[name]
    ok, message = compare(spark, duck(sf_dir), sf_dir, name, fn, sql)
    assert ok, message


def brute(rows, k=5):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        near = np.round(unit @ unit[i], 12)
        order = [j for j in np.lexsort((ids, -near)) if ids[j] != q][:k]
        out[int(q)] = [int(ids[j]) for j in order]
    return out


def test_search_reaches_recall_and_orders_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # a large group of equal vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.filter(F.col("vec_id") % 50 == 0)
    found = {}
    for r in nearest(df, queries).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    true = brute(rows)
    assert set(found) == {q for q, _ in rows if q % 50 == 0}
    hits = sum(len(set(found[q]) & set(true[q])) for q in found)
    assert hits >= 0.9 * 5 * len(found)
    assert found[5000] == true[5000] == [7, 5001, 5002, 5003, 5004]


def test_search_leaves_out_what_has_no_direction(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (50, [0.0, 1.0], "a"), (3, [1.0, 1.0], "a"), (100, None, "a"), (150, [0.0, 0.0], "a"),
        (200, [nan, 1.0], "a"), (250, [inf, 1.0], "a"), (300, [None, 1.0], "a"), (350, [], "a"), (400, [1.0, 2.0, 3.0], "a"),
        (None, [1.0, 0.5], "a"), (3, [1.0, 1.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    got = [tuple(r) for r in nearest(df, df.filter(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert abs(got[0][3] - 0.5**0.5) < 1e-15
    assert nearest(df.filter(F.lit(False))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(5)
    parts = [*CONTROL, "␛", "␛b", "<|", "|>", "[", "INST]", " ", "\n", "é", "ab"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in CONTROL)
        turns = [("user", text), ("a" + text, text * 2)]
        assert parse(render(turns)[0]) == turns


def test_chat_masks_each_assistant_text_once(spark):
    rng = random.Random(6)
    parts = ["word ", " ", "\n", "é", "日本", "😀", "</s>", "[/INST]", "<|end|>", "1", "'s", "  x"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randint(0, 9))), 1))
    rows += [(100, 0, "assistant", None, 1), (101, 0, None, "x", 1), (None, 0, "assistant", "lost id", 1)]
    rows += [(102, 1, "assistant", "twice", 1)] * 2 + [(103, None, "user", "first", 1), (103, 0, "assistant", "second", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    formatted = format_conversations(df)
    got = {r["conv_id"]: r for r in digests(formatted).collect()}
    import hashlib

    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        told = "".join(f"{b}\n{c}\n" for _, b, c in turns)
        learnt = "".join(c for _, b, c in turns if b == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learnt)
    row = formatted.filter("conv_id = 3").first()
    assert len(row["ids"]) == len(row["loss"]) == len(row["starts"]) and row["ends"][-1] == len(row["formatted"])
    assert digests(format_conversations(df.filter("false"))).count() == 0


def test_scores_of_extreme_vectors(spark):
    from fractions import Fraction
    from math import isfinite, sqrt

    vectors = [[1e200, 1e200], [1e200, 0.9e200], [1.0, 1.0], [1e-200, 2e-200], [5e-324, 0.0], [1e308, -1e308],
               [1e200, 1.0], [1e-310, 3e-310], [-3.0, 4.0], [1.7e308, 1.7e308]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def cosine(x, y):
        x, y = [Fraction(a) for a in x], [Fraction(a) for a in y]
        dot = sum(a * b for a, b in zip(x, y, strict=True))
        square = Fraction(dot * dot, sum(a * a for a in x) * sum(b * b for b in y))
        return sqrt(square) * (1 if dot >= 0 else -1)

    got = nearest(df, k=9).collect()
    assert len(got) == 90 and all(isfinite(r["score"]) for r in got)
    for r in got:
        assert abs(r["score"] - cosine(vectors[r["query_id"]], vectors[r["vec_id"]])) < 1e-14
