"""Operators against small plain-Python statements of the rule, on random input."""

import random
import re
from collections import Counter, deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitextra.functions import numeric as N
from bitextra.operators import batching as B
from bitextra.operators import glossary as G
from bitextra.operators import joblog as J
from bitextra.operators.containment import _pieces, containing
from bitextra.operators.ranking import chunked_previous, chunked_rank, first_n, salted_lookup


def test_numeric_drift_matches_counters(spark):
    rng = random.Random(5)
    pieces = ["No. 12", "№7", "3.1", "1.02-04-2013", "24.10.2014", "55", "108", "5 км", "4.5 кПа",
              "and", ", ", "x"]
    rows = [(i, " ".join(rng.choices(pieces, k=6)), " ".join(rng.choices(pieces, k=6)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, s STRING, t STRING").select(
        "id", N.numeric_tokens(F.col("s")).alias("s"), N.numeric_tokens(F.col("t")).alias("t"),
        N.drift_of(N.numeric_tokens(F.col("s")), N.numeric_tokens(F.col("t"))).alias("d"),
    )
    for r in df.collect():
        expected = []
        for kind in ("ref", "sub", "num"):
            a = Counter(x["value"] for x in r["s"] if x["kind"] == kind)
            b = Counter(x["value"] for x in r["t"] if x["kind"] == kind)
            lost, extra = list((a - b).elements()), list((b - a).elements())
            expected += [(kind, v, extra[i] if i < len(extra) else "") for i, v in enumerate(lost)]
        assert [(x["kind"], x["source"], x["target"]) for x in r["d"]] == expected


def water_fill(runs, text):
    content = [i for i, r in enumerate(runs) if r.strip()]
    if not content:
        return [runs[0] + text, *runs[1:]]
    words, total = text.split(), sum(len(runs[i]) for i in content)
    exact = {i: len(runs[i]) / total * len(words) for i in content}
    counts = {i: int(exact[i]) for i in content}
    spare = len(words) - sum(counts.values())
    for i in sorted(content, key=lambda i: counts[i] - exact[i])[:spare]:
        counts[i] += 1
    out, at = [], 0
    for i, r in enumerate(runs):
        if i not in counts:
            out.append(r)
            continue
        tail = re.search(r"\s*$", r).group(0)
        out.append(" ".join(words[at:at + counts[i]]) + tail)
        at += counts[i]
    return out


def test_distribute_words(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        runs = ["".join(rng.choices("ab  ", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        rows.append((runs, " ".join("w%d" % i for i in range(rng.randint(0, 9)))))
    df = spark.createDataFrame(rows, "runs ARRAY<STRING>, text STRING")
    out = df.select("runs", "text", B.distribute_words(F.col("runs"), F.col("text")).alias("o"))
    for r in out.collect():
        assert r["o"] == water_fill(r["runs"], r["text"]), (r["runs"], r["text"])


def test_distribute_chars(spark):
    df = spark.createDataFrame(
        [(["ab", "c", "def"], "123456789012"), (["a", "b", "c"], "1"), (["x"], "yz"), (["", ""], "q")],
        "runs ARRAY<STRING>, text STRING",
    )
    got = [r["o"] for r in df.select(B.distribute_chars(F.col("runs"), F.col("text")).alias("o")).collect()]
    assert got == [["1234", "56", "789012"], ["1", "", ""], ["yz"], ["", ""]]


@pytest.fixture(params=["one automaton", "shards", "grams"])
def containment(request, monkeypatch):
    if request.param == "shards":
        monkeypatch.setattr("bitextra.operators.containment.SHARD_BYTES", 12)
    if request.param == "grams":
        monkeypatch.setattr("bitextra.operators.containment.MOST_SHARDS", -1)


def test_apply_glossary(spark, containment):
    rng = random.Random(9)
    words = ["Valve", "valve", "pump", "an", "seal ring", "val", "é", "ring"]
    terms = [(i, w, r) for i, (w, r) in enumerate(zip(words, ["К", "pump", "", "N", "кольцо", "v", "E", "R"]))]
    texts = [(0, i, " ".join(rng.choices(words + ["x", "Été"], k=5))) for i in range(80)] + [(0, 80, None), (None, 81, "pump an")]
    units = spark.createDataFrame(texts, "doc_id LONG, unit_idx LONG, source STRING")
    glossary = spark.createDataFrame(terms, "id LONG, term STRING, replacement STRING")
    got = {r.unit_idx: (r.modified, r.applied) for r in G.apply_glossary(units, glossary).collect()}
    for _, i, text in texts:
        out, n = text, 0
        for _, term, repl in terms:
            if text and repl and term.lower() in text.lower():
                at = out.lower().find(term.lower())
                if at >= 0:
                    out = out[:at] + repl + out[at + len(term):]
                    n += 1
        assert got[i] == (out, n)


def test_match_terms_overlapping(spark, containment):
    rng = random.Random(12)
    texts = [(0, i, "".join(rng.choices("abAB é", k=rng.randint(0, 30)))) for i in range(120)] + [(0, 120, None), (0, 121, "")]
    terms = [(i, "".join(rng.choices("abé ", k=rng.randint(0, 7))), "r%d" % i) for i in range(150)] + [(900, None, "x")]
    units = spark.createDataFrame(texts, "doc_id LONG, unit_idx LONG, source STRING")
    glossary = spark.createDataFrame(terms, "id LONG, term STRING, replacement STRING")
    got = sorted((r.unit_idx, r.id, r.term, r.replacement) for r in G.match_terms(units, glossary).collect())
    assert got == sorted((i, n, t, r) for _, i, x in texts for n, t, r in terms if x and t and t in x.lower())
    assert G.match_terms(units, glossary.filter("id < 0")).count() == 0


def test_pairs_do_not_repeat_the_text(spark, containment):
    """A text of 3 MB with 400 terms comes out as 400 small rows, not as 400 copies of it."""
    words = ["t%03dx" % i for i in range(400)]
    texts = spark.createDataFrame([(1, " ".join(words) + " y" * 1_500_000), (2, None), (3, "t007x")], "id LONG, text STRING")
    terms = spark.createDataFrame([(w,) for w in words], "term STRING")
    found = containing(texts, terms, ["id"], "text", "term")
    assert found.columns == ["id", "term"]
    assert sorted(map(tuple, found.collect())) == [(1, w) for w in words] + [(3, "t007x")]


def test_scanned_pieces():
    texts = ["a" * 700_000, "b" * 700_000, None, "c" * 3_000_000, "d", "e"]
    batch = pa.RecordBatch.from_pydict({"n": list(range(6)), "text": texts})
    pieces = [p.column(0).to_pylist() for p in _pieces(batch, 1)]
    assert pieces == [[0], [1, 2], [3], [4, 5]]


def test_substitute_terms_follows_chains(spark):
    terms = [(1, "valve", "gate pump"), (2, "pump", "motor unit"), (3, "unit", "box"), (4, "a.b", "c$1")]
    texts = ["The Valve and a valve", "unit", "nothing", "see a.b, axb", "PUMP"]
    units = spark.createDataFrame(
        [(0, i, x) for i, x in enumerate(texts)], "doc_id LONG, unit_idx LONG, source STRING"
    )
    glossary = spark.createDataFrame(terms, "id LONG, term STRING, replacement STRING")
    got = {r.unit_idx: r.modified for r in G.substitute_terms(units, glossary).collect()}
    for i, x in enumerate(texts):
        for _, term, repl in terms:
            x = re.sub(rf"\b{re.escape(term)}\b", lambda m, r=repl: r, x, flags=re.I)
        assert got[i] == x


def test_import_chains(spark):
    rng = random.Random(11)
    rows = [(n, f"слово{rng.randint(0, 60)}", f"word{rng.randint(0, 60)}", f"s{rng.randint(0, 90)}",
             f"词汇{rng.randint(0, 90)}") for n in range(2, 150)]
    df = spark.createDataFrame(
        rows, "row_num LONG, ru_word STRING, en_word STRING, sb_word STRING, ch_word STRING"
    )
    seen, kept = [set() for _ in range(4)], set()
    for n, *values in rows:
        if not any(v in s for v, s in zip(values, seen)):
            kept.add(n)
            for v, s in zip(values, seen):
                s.add(v)
    assert {r.row_num for r in G.accepted_rows(df).collect()} == kept


def test_import_of_a_long_chain(spark):
    """Each row shares a value with the next: every other one is accepted, in a bounded number of steps."""
    n = 10_000
    rows = [(k + 1, f"р{k // 2}", f"e{(k + 1) // 2}", f"s{k}", f"词{k}") for k in range(n)]
    rows += [(n + k + 1, "общее", f"x{k}", f"y{k}", f"z{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "row_num LONG, ru_word STRING, en_word STRING, sb_word STRING, ch_word STRING")
    got = {r.row_num for r in G.accepted_rows(df.repartition(4)).collect()}
    assert got == set(range(1, n + 1, 2)) | {n + 1}


def test_components_of_chains_stars_and_rings(spark):
    from bitextra.operators.components import connected_components

    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000 + i) for i in range(1, 80)]
    edges += [(2000 + i, 2000 + (i + 1) % 60) for i in range(60)] + [(7, 7), (None, 3), (3001, 3000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    sets = [range(501), range(1000, 1080), range(2000, 2060), (3000, 3001)]
    assert len(got) == sum(map(len, sets)) and len({got[s[0]] for s in sets}) == 4
    assert all(got[i] == got[s[0]] for s in sets for i in s)


def test_rate_limit(spark):
    rng = random.Random(2)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.5, 1, 3, 40])
        rows.append((i, rng.choice("aab"), at))
    df = spark.createDataFrame(rows, "event_id LONG, key STRING, s DOUBLE").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1000000).cast("long"))
    )
    got = {r.event_id: (r.allowed, r.remaining) for r in J.rate_limit(df, "key", 3, 10).collect()}
    logs = {"a": deque(), "b": deque()}
    for i, key, t in rows:
        log = logs[key]
        while log and log[0] <= t - 10:
            log.popleft()
        ok = len(log) < 3
        if ok:
            log.append(t)
        assert got[i] == (ok, 3 - len(log))


def skewed(spark):
    """One key holds far more rows than all others together."""
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
        .alias("key"), ((F.col("id") * 7919) % 3001).alias("pos"),
    )


def test_chunked_rank_equals_window(spark):
    df = skewed(spark)
    got = chunked_rank(df, ["key"], [F.col("pos")], F.floor(F.col("pos") / 64)).collect()
    df.createOrReplaceTempView("skewed")
    exp = spark.sql("SELECT id, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM skewed")
    assert {(r.id, r["rank"]) for r in got} == {(r.id, r.r) for r in exp.collect()}


def test_chunked_previous_equals_lag(spark):
    df = skewed(spark).withColumn("v", F.col("id").cast("string"))
    got = chunked_previous(df, ["key"], [F.col("pos")], F.floor(F.col("pos") / 50), "v", "prev")
    df.createOrReplaceTempView("skewed")
    exp = spark.sql("SELECT id, lag(v) OVER (PARTITION BY key ORDER BY pos) AS p FROM skewed")
    assert {(r.id, r.prev) for r in got.collect()} == {(r.id, r.p) for r in exp.collect()}


def with_nulls(spark):
    return spark.range(200).select(
        F.col("id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("key"),
        F.when(F.col("id") % 5 > 0, (F.col("id") * 37) % 101).alias("pos"), F.col("id").cast("string").alias("v"),
    )


def test_null_keys_and_orders_keep_their_rows(spark):
    df = with_nulls(spark)
    df.createOrReplaceTempView("nulls")
    order, chunk = [F.col("pos"), F.col("id")], F.floor(F.col("pos") / 10)
    ranks = chunked_rank(df, ["key"], order, chunk).select("id", "rank")
    exp = spark.sql("SELECT id, row_number() OVER (PARTITION BY key ORDER BY pos, id) AS rank FROM nulls")
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, exp.collect()))
    got = chunked_previous(df, ["key"], order, chunk, "v", "prev").select("id", "prev").collect()
    exp = spark.sql("SELECT id, lag(v) OVER (PARTITION BY key ORDER BY pos, id) AS prev FROM nulls").collect()
    assert {r.id: r.prev for r in got} == {r.id: r.prev for r in exp} and len(got) == 200


def test_salted_lookup_with_null_keys(spark):
    left = with_nulls(spark)
    right = spark.createDataFrame([("k0", 1), (None, 2)], "key string, w int")
    got = salted_lookup(left, right, ["key"], ["id"], "left", hot_rows=10, buckets=4)
    exp = left.join(right, "key", "left")
    assert sorted(got.select("id", "w").collect(), key=str) == sorted(exp.select("id", "w").collect(), key=str)


def test_rate_limit_keeps_requests_without_key_or_time(spark):
    import datetime as dt

    from bitextra.operators.joblog import rate_limit

    at = [dt.datetime(2026, 1, 1, 0, 0, s) for s in range(9)]
    rows = [("a", i, t) for i, t in enumerate(at[:7])] + [(None, 10 + i, t) for i, t in enumerate(at)]
    rows += [("a", 30, None), (None, 31, None), ("", 40, at[0])]
    got = {r.event_id: (r.key, r.allowed) for r in rate_limit(
        spark.createDataFrame(rows, "key string, event_id long, ts timestamp")).collect()}
    assert len(got) == len(rows)
    assert [got[i][1] for i in range(7)] == [True] * 5 + [False] * 2
    assert [got[10 + i][1] for i in range(9)] == [True] * 5 + [False] * 4
    assert got[30] == ("a", None) and got[31] == (None, None) and got[40] == ("", True)


def test_units_without_layer_are_layer_zero(spark):
    rows = [(1, i, [None, "0", "a"][i % 3]) for i in range(12)]
    got = B.assign_batches(spark.createDataFrame(rows, "doc_id long, unit_idx long, layer string"), 4, "layer")
    assert got.columns == ["doc_id", "unit_idx", "layer", "batch_id"] and got.count() == 12
    zero = [r for r in got.collect() if r.layer in (None, "0")]
    assert {r.batch_id for r in zero} == {1, 2} and len(zero) == 8


def test_batches_of_a_long_document_never_meet(spark):
    """Batch 100 splits and batch 1 retries; no call grows and only the failing batch loses units."""
    import json

    from bitextra.operators.inference import translate_units

    def model(payload):
        items = json.loads(payload)
        ids = [int(i["id"]) for i in items]
        if len(ids) > 5 or any(i == 42 for i in ids):
            raise RuntimeError("x" * 1000)
        if ids[0] // 5 == 99 and len(ids) > 2:
            return "broken {"
        answers = [{"id": i["id"], "text": i["text"].upper()} for i in items]
        if ids[0] == 0 and len(ids) == 5:
            answers = answers[:4]
        return json.dumps({"translations": answers})

    units = spark.createDataFrame(
        [(1, i, str(i), f"text {chr(97 + i % 26)}", "") for i in range(1050)],
        "doc_id long, unit_idx long, unit_id string, text string, context string")
    got = {r.unit_idx: (r.text, r.status) for r in translate_units(units, model, 5, None).collect()}
    assert set(range(1050)) - set(got) == {40, 41, 42, 43, 44}
    assert all(v == (f"TEXT {chr(65 + i % 26)}", "translated") for i, v in got.items())


def test_first_n(spark):
    df = skewed(spark)
    got = first_n(df, ["key"], [F.col("pos")], 5, F.col("id"), 8)
    df.createOrReplaceTempView("skewed")
    exp = spark.sql(
        "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM skewed)"
        " WHERE r <= 5"
    )
    assert {r.id for r in got.collect()} == {r.id for r in exp.collect()}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup(spark, how):
    left = skewed(spark)
    right = left.select("key").distinct().filter("key <> 'k3'").withColumn("w", F.upper("key"))
    got = salted_lookup(left, right, ["key"], ["id"], how, hot_rows=100, buckets=8)
    exp = left.join(right, ["key"], how)
    assert sorted(map(tuple, got.select("id", "w").collect())) == sorted(
        map(tuple, exp.select("id", "w").collect())
    )


def test_batches_split_and_merge(spark):
    text = "\\P".join(["long paragraph " * 8, "", "b" * 200, "\\H1;", "tail"])
    e = spark.createDataFrame([("e1", text), ("e2", "short\\Ptext"), ("e3", "\\P")],
                              "unit_id STRING, text STRING")
    parts = {r.unit_id: r for r in B.split_paragraphs(e).collect()}
    assert set(parts) == {"e1__p0", "e1__p2", "e1__p4", "e2"}
    done = B.split_paragraphs(e).filter("split_parent IS NOT NULL AND split_index <> 4").select(
        "split_parent", "split_index", F.upper("original").alias("translated")
    )
    merged = B.merge_paragraphs(e, done).first()["merged"].split("\\P")
    assert merged == [("long paragraph " * 8).upper(), "", "B" * 200, "\\H1;", "tail"]
