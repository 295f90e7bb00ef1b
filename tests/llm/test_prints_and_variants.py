import hashlib
import random
import re
import zlib
from collections import Counter

from llm_rows import empty, frame, odd_rows, words
from pyspark.sql import functions as F

from bitextra.llm.scaled_sketch import containment, document_fingerprints, fingerprint, merged
from bitextra.llm.spelling_variants import spelling_variants


def printed(text):
    t = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    every = {hashlib.md5(" ".join(t[i : i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(t) - 4))} if t else set()
    return sorted(h for h in every if h < "2") or sorted(every)[:1]


def share(a, b):
    return len(set(a) & set(b)) / len(a) if a else float(not b)


def test_fingerprints_against_plain_version(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(100 + k, words(k % 40, 3 * k)) for k in range(60)] + [(2**62, "far away"), (-(2**62), words(9, 300))]
    for per_chunk in (1, 7, 10_000):
        got = document_fingerprints(frame(spark, rows), rows_per_chunk=per_chunk).collect()
        assert len(got) == len(rows)
        named = sorted({(i, t or "") for i, t in rows if i is not None}, reverse=True)
        ids = Counter(i for i, t in rows if i is not None)
        by_id = {i: {t for j, t in named if j == i} for i in ids}
        order = sorted(ids, reverse=True)
        follower = {i: by_id[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
        seen = Counter()
        for r in got:
            seen[r["doc_id"]] += 1
            body = [t for i, t in rows if i == r["doc_id"] and len(t or "") == r["n_chars"]]
            assert any(r["fingerprint"] == printed(t) for t in body)
            if r["doc_id"] in (order[-1], None) or ids[r["doc_id"]] > 1:
                continue  # their next is a row without an id, or a row of the same id
            text, third = body[0] or "", r["n_chars"] // 3
            true = [(text[: len(text) - third] + n[:third], n) for n in follower[r["doc_id"]]]
            assert any(
                (r["edited_text"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
                == (e, printed(e), share(printed(text), printed(e)), share(printed(text), printed(n)))
                for e, n in true
            ), r["doc_id"]
        assert seen == Counter(i for i, _ in rows)
    assert document_fingerprints(empty(spark)).count() == 0
    lone = document_fingerprints(frame(spark, [(4, "a b c d e f g h i")])).first()
    assert lone["near_next"] == 1.0 and lone["edited_text"] == "a b c d e f a b c"
    same = document_fingerprints(frame(spark, [(None, "a b")] * 50 + [(7, "c d")] * 50), rows_per_chunk=5).collect()
    assert len(same) == 100


def test_containment_of_unequal_texts(spark):
    long, short = words(3, 6000), " ".join(words(3, 6000).split()[1000:1800])
    row = spark.createDataFrame([(short, long, words(4, 500))], "s string, l string, o string").select(
        containment(fingerprint(F.col("s")), fingerprint(F.col("l"))).alias("inside"),
        containment(fingerprint(F.col("l")), fingerprint(F.col("s"))).alias("around"),
        containment(fingerprint(F.col("o")), fingerprint(F.col("l"))).alias("other"),
        merged(fingerprint(F.col("s")), fingerprint(F.col("o"))).alias("both"),
        merged(fingerprint(F.lit("one")), fingerprint(F.col("o"))).alias("with_short"),
        fingerprint(F.col("o")).alias("single"),
    ).first()
    assert row["inside"] == 1.0 and 0.08 < row["around"] < 0.2 and row["other"] < 0.05
    assert row["both"] == sorted(set(printed(short)) | set(printed(words(4, 500))))
    assert row["with_short"] == row["single"] or min(printed("one")) < "2"


def variants_brute(rows, slip):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    vocabulary = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(u, v):
        if len(u) > len(v):
            u, v = v, u
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v, strict=True)) == 1
        return len(u) + 1 == len(v) and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))

    form, number = {}, {}
    for w, n in vocabulary.items():
        mates = [v for v in vocabulary if v != w and abs(len(v) - len(w)) < 2 and near(w, v)]
        number[w] = len(mates)
        best = min(mates, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, number[w], vocabulary.get(form[w])) for w, n in vocabulary.items()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["aabbcc", "letter", "lettre", "éclair", "zzzzzz", "abcde", "Straße", "×÷×÷×", "x" * 80, "q" * 63 + "ab"]
    rows = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 60_000] + [(None, "letter letter éclair")]
    for d in range(400):
        text = []
        for _ in range(30):
            w = list(base[min(rng.randrange(len(base)), rng.randrange(len(base)))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = rng.choice(["a", "t", "é", "z", "", "x"])
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((1000 + d, " ".join(text)))
    for slip in (97, 3):
        got = spelling_variants(frame(spark, rows), slip=slip).collect()
        assert {tuple(r) for r in got} == variants_brute(rows, slip) and len(got) == len(set(got))
        assert any(r["form"] and r["root"] != r["form"] for r in got)
    assert spelling_variants(empty(spark)).count() == 0
