"""Queries against their SQL over a few documents of unusual lines."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from harness import compare
from pyspark.sql import functions as F

from bitextra.operators import inference as I
from bitextra.operators.integrity import repair_numerics
from bitextra.plans import fixtures as fx
from bitextra.plans import load_registry
from bitextra.plans.source_queries import _file_batches, write_pages
from bitextra.session import shared_root

REGISTRY = load_registry()


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares a query with its SQL over the given documents."""

    def run(name, texts: dict[int, str]):
        rows = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
        rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        ok, message = compare(spark, con, str(tmp_path), name, *REGISTRY[name])
        assert ok, message

    return run


def test_numbers_that_open_a_line_are_translated(against_sql):
    """Number 2 of a document opens with digits: only injected references are forgotten."""
    line = "1219538112535716 Éaielletre."
    against_sql("translate_and_fill", {doc: f"one\ntwo\n{line}\n56.187.231.175 in" for doc in range(12)})


def test_rounds_leave_each_unit_once_on_disk(spark, sf_dir):
    """Open units of earlier rounds and shuffles are gone; what is left holds the results once."""
    shared, local = Path(shared_root(spark).removeprefix("file:")), Path(spark.conf.get("spark.local.dir"))
    steps, shuffles = set(shared.glob("step-*/*")), set(local.rglob("shuffle_*.data"))
    got = REGISTRY["translate_and_fill"][0](spark, sf_dir)
    assert not set(local.rglob("shuffle_*.data")) - shuffles
    left = [str(s) for s in set(shared.glob("step-*/*")) - steps if s.is_dir()]
    units = fx.units(spark, sf_dir).count()
    assert spark.read.schema("unit_idx LONG").parquet(*left).count() == units == got.count()


def test_long_documents_are_translated_in_the_same_batches(spark, monkeypatch):
    """Batches are those of the rank within the document, wherever short documents end."""
    texts = [(doc, i) for doc, n in ((1, 7), (2, 95), (None, 12)) for i in range(0, 3 * n, 3)]
    units = spark.createDataFrame(
        [(doc, i, f"{doc}_{i}", f"t {chr(97 + i % 26)}", "") for doc, i in texts],
        "doc_id long, unit_idx long, unit_id string, text string, context string")
    found = []
    for short in (0, 2, 1000):
        monkeypatch.setattr(I, "SHORT_BATCHES", short)
        rows = I._first_batches(units, 10).select("doc_id", "batch_id", "units.unit_idx", "n_units").collect()
        found.append(sorted(map(tuple, rows), key=repr))
    ranks = {}
    for doc, i in texts:
        ranks.setdefault(doc, []).append(i)
    want = [(d, str(k // 10 + 1), x[k:k + 10], len(x[k:k + 10])) for d, x in ranks.items() for k in range(0, len(x), 10)]
    assert found == [sorted(want, key=repr)] * 3


def test_lost_units_are_filled_in_one_or_two_steps(spark):
    """Comparing units with results finds the units that the rounds have lost."""
    import json

    def model(payload):
        items = json.loads(payload)
        if len(items) > 2:
            raise RuntimeError("too many")
        return json.dumps([{"id": i["id"], "text": i["text"].upper()} for i in items if i["id"] != "1_4"])

    units = spark.createDataFrame(
        [(doc, i, f"{doc}_{i}", f"t {chr(97 + i)}", "") for doc, n in ((1, 5), (2, 2)) for i in range(n)],
        "doc_id long, unit_idx long, unit_id string, text string, context string")
    first = I.translate_units(units, model, 5, None)
    assert sorted(r.unit_idx for r in first.collect()) == [0, 1]
    two = I.gap_fill(units, first, model, 2, 2, None).collect()
    one = I.translate_and_fill(units, model, 5, None, 2, 2).collect()
    want = [(d, i, f"T {chr(65 + i)}", "translated") for d, n in ((1, 4), (2, 2)) for i in range(n)]
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) == sorted([*want, (1, 4, "t e", "source_fallback")])


def test_a_value_that_turns_into_a_number_with_unit_is_drift(spark):
    """By the reference kinds are compared apart: a Cyrillic ``а`` after it makes the designation a value."""
    units = spark.createDataFrame(
        [(1, "17.65.244.232 a of", "17.65.244.232 а оф"), (2, "17.65.244.232 b of", "17.65.244.232 б оф")],
        "id INT, source STRING, target STRING",
    )
    got = {r.id: (r.repaired, r.unresolved) for r in repair_numerics(units).collect()}
    assert got == {1: ("17.65.244.232 а оф", 1), 2: ("17.65.244.232 б оф", 0)}


def test_pages_take_little_more_room_than_their_texts(spark, sf_dir):
    """Words repeat their field names; the files written hold them packed."""
    texts = fx.units(spark, sf_dir).agg(F.sum(F.octet_length("target"))).first()[0]
    path = write_pages(spark, sf_dir)
    size = sum(f.stat().st_size for f in Path(path).glob("part-*"))
    assert 0 < size < 4 * texts


def test_files_are_made_row_by_row():
    """Texts of 3 MB do not leave together, and none is lost."""
    rows = pa.RecordBatch.from_pydict({"id": range(4), "text": ["x" * 3_000_000] * 4})

    def make(i, text):
        return [(str(i), text.encode()), (f"again {i}", b"y")] if i != 2 else []

    left = [b.to_pydict() for b in _file_batches([rows], make)]
    assert [b["path"] for b in left] == [["0", "again 0"], ["1", "again 1"], ["3", "again 3"], []]
    assert [[len(c) for c in b["content"]] for b in left] == [[3_000_000, 1]] * 3 + [[]]


def test_spread_follows_the_size_of_the_files(spark, tmp_path, monkeypatch):
    """A few large files become more partitions than cores."""
    path = f"{tmp_path}/two files"
    spark.range(20_000).select("id", F.uuid().alias("text")).repartition(2).write.parquet(path)
    size = sum(f.stat().st_size for f in Path(path).glob("*.parquet"))
    monkeypatch.setattr(fx, "SPREAD_BYTES", size // 25)
    table = fx.spread(spark.read.parquet(path), "id")
    assert table.rdd.getNumPartitions() >= 25 and table.count() == 20_000
    monkeypatch.setattr(fx, "SPREAD_BYTES", size)
    assert fx.spread(spark.read.parquet(path), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_manifest_files_are_made_by_many_tasks(spark, tmp_path):
    """Files of one small table come from several tasks, one file each."""
    rows = spark.range(40).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(1).alias("s_nationkey"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    before = set(Path(shared_root(spark)).glob("submitted-*"))
    found = REGISTRY["manifest_files"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, 4, "TXT") for i in range(40)]
    (path,) = set(Path(shared_root(spark)).glob("submitted-*")) - before
    assert len({f.name[:10] for f in path.rglob("part-*.txt")}) > 4
