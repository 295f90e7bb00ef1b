import corpus_pipeline
import numpy as np
import public_tokenizers
from llm_rows import words
from test_sets_and_layout import edited, near_brute
from test_text_scans import KINDS, base_spans, pii_graph
from tokenizers import Tokenizer


def planted(spark, tmp):
    import random

    rng = random.Random(8)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 300").limit(60)
    rows = [tuple(r) for r in real.collect()]
    base = rows[0][1]
    n = 10**6
    extra = [
        (n + 1, base, "en", "s", len(base)),
        (n + 2, edited(base, rng, 1), "en", "s", 1),
        (n + 3, "&&& 123 *** !!!", "en", "s", 15),
        (n + 4, None, "en", "s", None),
        (n + 5, " ".join(reversed(rows[5][1].split())) + " write to jo.doe@mail.example.com or 10.0.0.7 soon", rows[5][2], "s", 1),
        (None, rows[7][1] + " kept without id", rows[7][2], None, 3),
    ]
    item = words(44, 60)
    extra.append((n + 6, rows[9][1] + "\n" + item + "\n" + rows[10][1], rows[9][2], "s", 1))
    spark.createDataFrame(rows + extra, real.schema).coalesce(2).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return rows, n


def test_stages(spark, tmp_path):
    rows, n = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = {r[0]: r for r in docs.collect()}
    clean = {r[0] for r in rows[1:]}
    assert not {n + 3, n + 4} & set(seen["language"]) and clean <= set(seen["language"])
    # One of the planted group stays; a member of the sample may be a copy of another one itself.
    assert len({rows[0][0], n + 1, n + 2} & set(seen["near_copies"])) == 1 and None in seen["near_copies"]
    assert n + 6 in seen["near_copies"] and n + 6 not in seen["benchmark_leaks"]
    assert set(seen["benchmark_leaks"]) == set(seen["near_copies"]) - {n + 6}
    told = seen["personal_data"][n + 5]["text"]
    assert told.endswith("write to [EMAIL] or [IP] soon")
    assert set(seen["packing"]) == set(seen["personal_data"])
    # run() chains the same functions.
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(seen["packing"])


def test_empty_tables(spark, tmp_path):
    _, _ = planted(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def plain_language(spark, docs, rows):
    from bitextra.llm.language_mixture import _LETTER, buckets_of, learn, mixture

    _, table = learn(docs)
    kept = []
    for r in rows:
        if r["text"] and _LETTER.search(r["text"]):
            _, shares, gain = mixture(buckets_of(r["text"]), table)
            if shares[0] >= corpus_pipeline.LEAST_SHARE and gain > 0:
                kept.append(r)
    return kept


def plain_near_copies(rows):
    once, seen = [], set()
    for r in rows:
        if r["doc_id"] is None or (r["doc_id"], r["text"]) not in seen:
            seen.add((r["doc_id"], r["text"]))
            once.append(r)
    root = near_brute([(r["doc_id"], r["text"]) for r in once if r["doc_id"] is not None], 5)
    return [r for r in once if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]


def least_edits(pattern, text):
    """Sellers' distance of the best occurrence, a row of the table at a time."""
    from bitextra.llm.decontaminate import plain

    codes = np.array([ord(c) for c in pattern])
    row, steps = np.arange(len(pattern) + 1), np.arange(len(pattern) + 1)
    best = row[-1]
    for c in plain(text):
        down = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
        new = np.concatenate([[0], down])
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, row[-1])
    return best


def plain_mask(text, spans):
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end > at:
            out += [text[at:start] if start > at else "", f"[{KINDS[kind].upper()}]"]
            at = end
    return "".join(out) + text[at:]


def test_run_against_plain_pipeline(spark, tmp_path):
    from bitextra.llm.decontaminate import plain

    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    item = plain(spark.read.parquet(f"{tmp_path}/benchmark.parquet").first()["text"]).strip()
    rows = plain_near_copies(plain_language(spark, docs, docs.collect()))
    rows = [r for r in rows if least_edits(item, r["text"]) > len(item) // 10]
    found = pii_graph([(r["doc_id"], r["text"]) for r in rows])
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    true = []
    for k, r in enumerate(rows):
        base = [s.split(":") for s in base_spans(r["text"]).split(",") if s]
        spans = [(int(a), KINDS.index(kind), int(b)) for kind, a, b in base] + [(a, 4, b) for n, a, b in found if n == k]
        ids = whole.encode(plain_mask(r["text"], spans), add_special_tokens=False).ids + [1]
        true.append((r["doc_id"], tuple(ids)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas().sort_values(["doc_tokens", "start"])
    got = []
    for doc, g in pieces.groupby("doc_id", dropna=False):
        assert (g.doc_tokens == g.length.sum()).all()
        got.append((None if np.isnan(doc) else int(doc), tuple(x for ids in g.ids for x in ids)))
    assert sorted(got, key=repr) == sorted(true, key=repr) and len(true) > 50
