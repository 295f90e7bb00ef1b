import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from llm_rows import empty, frame, odd_rows, words
from pyspark.sql import functions as F

from bitextra.llm.byte_shards import assign_shards
from bitextra.llm.components import connected_components
from bitextra.llm.near_dup import near_duplicates
from bitextra.llm.packing import pack
from bitextra.llm.queries import QUERIES
from bitextra.llm.sparse_suffix import repeated_passages


def shingles(text, n):
    t = (text or "").encode().lower().split()
    return {tuple(t)} if 0 < len(t) < n else {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}


def near_brute(rows, n):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) and x for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def edited(text, rng, edits):
    t = text.split()
    for _ in range(edits):
        t[rng.randrange(len(t))] = "zz%d" % rng.randrange(99)
    return " ".join(t)


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in odd_rows()]
    for g in range(12):
        base = words(50 + g, rng.choice([3, 6, 12, 80, 200]))
        rows += [(1000 + 50 * g + k, edited(base, rng, rng.randrange(4))) for k in range(12)]
    for words_in in (4, 5):
        got = near_duplicates(frame(spark, rows), words=words_in).collect()
        assert len(got) == len(rows)
        true = near_brute([r for r in rows if r[0] is not None], words_in)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == true[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000 - i, 5001) for i in range(40)]
    edges += [(7, 7), (None, 3), (300, 201)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1080)} == {1000}
    assert {got[i] for i in range(4961, 5002)} == {4961} and got[300] == got[201 - 0] if 201 in got else True


def test_repeats_against_all_windows(spark):
    rng = random.Random(4)
    passages = [words(300 + k, rng.choice([49, 50, 51, 70, 160])) for k in range(8)]
    rows = [(r[0], r[1]) for r in odd_rows()]
    for d in range(60):
        parts = [words(1000 + d, rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), words(2000 + 7 * d + len(parts), rng.randint(0, 40))]
        rows.append((100 + d, " ".join(parts)))
    distinct = {(i, t) for i, t in rows if t}
    windows = defaultdict(set)
    for i, t in distinct:
        w = t.encode().lower().split()
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add((i, t))
    true = Counter()
    for i, t in distinct:
        w = t.encode().lower().split()
        cover = {x for k in range(len(w) - 49) if len(windows[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}
        true[i] += len(cover)
    got = Counter()
    for r in repeated_passages(frame(spark, rows)).collect():
        assert r["end"] - r["start"] >= 50
        got[r["doc_id"]] += r["end"] - r["start"]
    assert +got == +true
    assert repeated_passages(empty(spark)).count() == 0


def covered(rows):
    """Words of each id that lie in a window of 50 words which another text holds too."""
    distinct = {(i, t) for i, t in rows if t}
    windows = defaultdict(set)
    for i, t in distinct:
        w = t.encode().lower().split()
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add((i, t))
    true = defaultdict(set)
    for i, t in distinct:
        w = t.encode().lower().split()
        true[i] |= {x for k in range(len(w) - 49) if len(windows[tuple(w[k : k + 50])]) > 1 for x in range(k, k + 50)}
    return {i: c for i, c in true.items() if c}


def test_repeats_among_crowds(spark):
    rows, n = [], 0
    for g in range(6):
        left, middle, right = words(9000 + g, 15), words(9100 + g, 30), words(9200 + g, 15)
        # 45 words are shared with a crowd on either side, 60 by two texts only.
        texts = [f"{words(9300 + 2 * g + k, 45)} {left} {middle} {right} {words(9400 + 2 * g + k, 55)}" for k in range(2)]
        texts += [f"{words(10_000 + 200 * g + k, 45)} {middle} {right} {words(20_000 + 200 * g + k, 55)}" for k in range(120)]
        texts += [f"{words(30_000 + 200 * g + k, 45)} {left} {middle} {words(40_000 + 200 * g + k, 55)}" for k in range(120)]
        rows += [(n + k, t) for k, t in enumerate(texts)]
        n += len(texts)
    # One text's own repeats stand around the copy of another.
    passage = words(9900, 52)
    inner = " ".join(f"{passage} {words(50_000 + k, 60)}" for k in range(60))
    rows += [(n, inner), (n + 1, f"{words(9901, 60)} {passage} {words(9902, 60)}")]
    got = defaultdict(set)
    for r in repeated_passages(frame(spark, rows)).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    true = covered(rows)
    assert len(true) == 14 and got == true


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(i, r[1]) for i, r in enumerate(odd_rows())] + [(100 + i, words(i, 5 + 40 * (i % 50))) for i in range(300)]
    rows.append((999, "a <|endoftext|> b"))
    out = pack(frame(spark, rows)).toPandas()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    for d, g in out.sort_values("start").groupby("doc_id"):
        back = [x for piece in g.ids for x in piece]
        assert back == ids[d] and (g.doc_tokens == len(back)).all()
        assert list(g.start) == list(np.cumsum([0, *g.length])[:-1])
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert set(out.doc_id) == set(ids)
    padded = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        total = g.length.sum()
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and total <= 2048
        window = g.window.iloc[0]
        assert total == window or window == 2048
        padded += total & (total - 1) != 0
    assert padded <= 4  # one padded window per task at most
    groups = out.groupby("step_group").sequence_id.nunique()
    assert groups.max() <= 16 * 2048 // 256
    assert pack(empty(spark)).count() == 0


def test_packing_keeps_documents_whole_and_groups_equal(spark):
    rows = [(i, words(i, random.Random(i).choice([3, 20, 60, 150, 400, 900, 3000]))) for i in range(3000)]
    out = pack(frame(spark, rows).coalesce(1), with_ids=False).toPandas()
    pieces = out.groupby("doc_id").length.count()
    needed = -(-out.groupby("doc_id").doc_tokens.first() // 2048)
    assert (pieces == needed).mean() > 0.7 and pieces.sum() - needed.sum() <= out.sequence_id.nunique()
    totals = out.groupby("step_group").length.sum()
    assert (totals.drop(totals.index.max()) == 16 * 2048).all()
    tiers = out.groupby("window").sequence_id.nunique()
    assert {256, 512, 1024, 2048} <= set(tiers.index)
    # Where a document is cut, the piece ends its window or the document is longer than any.
    ends = out.sort_values("offset").groupby("sequence_id").tail(1)[["doc_id", "start"]].apply(tuple, axis=1)
    cut = out[(out.start + out.length < out.doc_tokens) & (out.length < 2048)]
    assert set(cut[["doc_id", "start"]].apply(tuple, axis=1)) <= set(ends)


def test_packing_added_tokens(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end}", f"a  {end}  b", f"it{end}'s 12{end}34", "<|endoftext", f"\n\n{end}\n", f"é {end}日本", f"<{end}>"]
    frame(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()}
    sums = {r["doc_id"]: r["ids_crc32"] for r in QUERIES["op9_tiered_packing"][0](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert got[i]["ids"] == ids and got[i]["doc_tokens"] == len(ids), t
        assert got[i]["ids_crc32"] == sums[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_are_level_and_gapless(spark):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows = [r for r in rows if r[0] != 4] + [(100 + i, words(i, rng.randint(1, 60))) for i in range(1500)]
    rows += [(5000 + i, words(77, 40)) for i in range(900)]  # a third of the rows is one text
    got = assign_shards(frame(spark, rows), shards=40, keep_text=True).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        data = (r.text or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
    total = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    largest = got["size"].max()
    assert total.max() - total.min() <= 2 * largest + 0.01 * total.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # Equal texts lie in neighbouring shards only as far as their bytes need it.
    hot = got[got.text == words(77, 40)]
    assert hot.shard.nunique() <= hot["size"].sum() / total.mean() + 2
    assert assign_shards(empty(spark)).count() == 0


def test_shards_of_few_rows(spark):
    got = assign_shards(frame(spark, [(1, "a"), (1, "a"), (2, None)]), shards=5).toPandas()
    assert len(got) == 3 and got.shard.between(0, 4).all() and "text" not in got
    assert got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    assert got.filter(regex="^_").empty and F is not None
