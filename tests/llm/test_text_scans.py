import re

from llm_rows import empty, frame, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitextra.llm.decontaminate import Matcher, best_match, drop_leaks, leaks, masks_of
from bitextra.llm.language_mixture import held_out, learn, predict
from bitextra.llm.license_rules import BASE, BASE_WEIGHT, FAMILIES, TEXTS, find_licenses, signatures
from bitextra.llm import pii_bootstrap as P
from bitextra.llm.pii_bootstrap import KINDS, find_pii, joined, masked


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


PII_TEXTS = [
    "mail a.b@c.de, x@y or é@z.org_x@y.zz", "1.2.3.4 and 300.1.1.1 then 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (555) 010-2030 or +1 2 3", "😀 4111111111111111 日本 a@b.c", "9" * 30_000, "a@b.cc" * 2000, "+" * 500 + "1234567890",
    "1 " * 9000, "0000000000000000", "..@-.-", "10.0.0.1 " * 700,
]


def test_pii_base_spans(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(PII_TEXTS)]
    got = find_pii(frame(spark, rows)).select("doc_id", "text", "slot", joined(F.col("base")).alias("b")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["b"] == base_spans(r["text"] or ""), (r["text"] or "")[:60]
    assert find_pii(empty(spark)).count() == 0


def test_pii_bootstraps_contexts_and_masks(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117", "3530111333300000"]
    rows = [(i, f"pay with account: {c} now") for i, c in enumerate(cards * 3)]
    rows += [(50 + i, f"and account: ZX-77812{i}Q was used, room 1234567 too") for i in range(2)]
    rows += [(90, "the 4111111111111111 the the the " + words(3, 200)), (91, "the id9999x")]
    found = find_pii(frame(spark, rows))
    got = {r["doc_id"]: r for r in found.select("doc_id", joined(F.col("spans")).alias("s"), masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got[50]["m"] == "and account: [CONTEXT] was used, room 1234567 too"
    assert got[0]["m"] == "pay with account: [CARD] now"
    assert got[91]["s"] == ""


def test_pii_counts_words_of_all_texts(spark):
    rows = [(i, f"see code: AB-55{i}77Z and contact: jo{'abcdefghij'[i]}.doe@mail.org") for i in range(6)]
    rows += [(20 + i, f"code: {c}") for i, c in enumerate(["10.0.0.7", "10.0.0.8", "10.0.0.9", "10.1.0.1", "10.2.0.1", "10.3.0.1"] * 3)]
    # Addresses without digits, in texts without digits, make "owner= " a context.
    rows += [(60 + i, f"owner= {'abcdefghij'[i]}bcd.doe@mail.org") for i in range(8)] + [(70, "owner= QX77812 here")]

    def contexts(more):
        out = find_pii(frame(spark, rows + more)).select("doc_id", joined(F.col("spans")).alias("s")).collect()
        return {r["doc_id"] for r in out if "context" in r["s"]}

    assert contexts([]) == {0, 1, 2, 3, 4, 5, 70}
    # The word alone makes nothing common, the exact context does, in texts without any digit too.
    assert contexts([(200 + i, "the code of the code is code") for i in range(40)]) == {0, 1, 2, 3, 4, 5, 70}
    assert contexts([(200 + i, "a code: of the code: is code: none") for i in range(40)]) == {70}


def pii_graph(rows):
    """Context spans by the graph in plain Python: (row number, start, end)."""
    from collections import defaultdict
    from math import log1p, exp

    import regex

    letters, other = r"\p{L}", r"[^\p{L}\p{N}]"
    shapes = [regex.compile(P.EMAIL.replace(r"\G", r"(?!)")), regex.compile(P.PHONE), regex.compile(P.IP),
              regex.compile(r"[0-9]++(?:[\x20-][0-9]++)++"), regex.compile(P.IDENTIFIER)]
    every = regex.compile("|".join(f"(?:{s.pattern})" for s in shapes))

    def seed(m):
        digits = regex.sub("[^0-9]", "", m)
        return bool(
            shapes[0].fullmatch(m)
            or (regex.fullmatch(r"(\d+\.){3}\d+", m) and all(int(x) <= 255 for x in m.split(".")))
            or (shapes[1].fullmatch(m) and 9 <= len(digits) <= 15)
            or (regex.fullmatch(r"[0-9]+([ -][0-9]+)*", m) and 12 <= len(digits) <= 19 and luhn(digits))
        )

    uses, total = [], defaultdict(int)
    for row, (_, text, *_) in enumerate(rows):
        text = text or ""
        low = text.lower()
        words = regex.findall(f"{letters}+{other}*", low)
        for w in words:
            total[">" + w] += 1
        for v, w in zip(words, words[1:]):
            total[">>" + v + w] += 1
        for w in regex.findall(f"{other}*{letters}+", low):
            total["<" + w] += 1
        found = [m for m in every.finditer(text)]
        for k, m in enumerate(found):
            before = low[found[k - 1].end() if k else 0 : m.start()][-P.CONTEXT_CHARS:]
            after = low[m.end() : found[k + 1].start() if k + 1 < len(found) else len(low)][: P.CONTEXT_CHARS]
            sides = [(">", regex.search(f"({letters}+{other}*)$", before)), (">>", regex.search(f"({letters}+{other}+{letters}+{other}*)$", before)),
                     ("<", regex.search(f"^({other}*{letters}+)", after))]
            contexts = [mark + s.group(1) for mark, s in sides if s]
            if len(m.group()) >= 6:
                uses.append((row, m.start(), m.end(), m.group().lower(), seed(m.group()), contexts))
    n, seeds = defaultdict(int), set()
    for *_, instance, is_seed, contexts in uses:
        for c in contexts:
            n[c, instance] += 1
        if is_seed:
            seeds.add(instance)
    instances = defaultdict(set)
    for c, instance in n:
        instances[c].add(instance)
    edges = {k: v for k, v in n.items() if len(instances[k[0]]) >= P.MIN_INSTANCES}
    led = defaultdict(int)
    for (c, _), v in edges.items():
        led[c] += v
    score = {i: float(i in seeds) for _, i in edges}
    for _ in range(P.ROUNDS):
        good = defaultdict(float)
        for (c, i), v in edges.items():
            good[c] += v * score[i]
        confidence = {c: g / (max(total[c], led[c]) + P.SMOOTHING) for c, g in good.items()}
        miss = defaultdict(float)
        for c, i in edges:
            miss[i] += log1p(-min(confidence[c], 0.999))
        score = {i: max(float(i in seeds), 1 - exp(miss[i])) for i in miss}
    return {(row, a, b) for row, a, b, _, is_seed, contexts in uses
            if not is_seed and any(confidence.get(c, 0) >= P.MIN_CONFIDENCE for c in contexts)}


def test_pii_contexts_against_plain_graph(spark):
    import random

    rng = random.Random(8)
    letters = "abcdefghij"
    leads = ["account: ", "my customer no. ", "see the ", "IP address = ", "mail <", "ticket #", "of "]
    tails = [" was paid", "> wrote", ", verified", ".", " and"]
    kinds = [
        lambda: rng.choice(["4111111111111111", "5500005555555559", "378282246310005", "6011111111111117", "30569309025904", "4012888888881881"]),
        lambda: ".".join(str(rng.randint(1, 300)) for _ in range(4)),
        lambda: f"{rng.choice(letters)}x{rng.choice(letters)}.{rng.randint(1, 99)}@mail.org",
        lambda: f"{rng.choice('ABC')}{rng.choice('XYZ')}-{rng.randint(1000, 99999)}",
        lambda: str(rng.randint(100000, 999999)),
    ]
    rows = []
    for i in range(500):
        text = [words(i, rng.randint(0, 6), letters)]
        for _ in range(rng.randint(1, 3)):
            lead = rng.randrange(len(leads))
            text.append(f" {leads[lead]}{kinds[(lead if rng.random() < 0.75 else rng.randrange(5)) % 5]()}{rng.choice(tails)} ")
            text.append(words(9 * i, rng.randint(0, 3), letters))
        rows.append((i, "".join(text)))
    rows += [(900, None), (901, ""), (902, "account: of my customer no. one account: two")]
    true = pii_graph(rows)
    got = find_pii(frame(spark, rows)).select("doc_id", F.explode("spans").alias("s")).filter("s.kind = 4").select("doc_id", "s.start", "s.end").collect()
    by_id = {i: k for k, (i, _) in enumerate(rows)}
    assert {(by_id[r[0]], r[1], r[2]) for r in got} == true and len(got) == len(true) > 20
    measured = P.held_out_recall(frame(spark, rows)).first()
    assert measured["held_out"] > 20 and measured["found"] > 0


def test_pii_mask_merges_overlaps(spark):
    df = spark.createDataFrame([("0123456789",)], "text string").withColumn(
        "spans", F.expr("array(struct(1 AS start, 2 AS kind, 4 AS end), struct(2 AS start, 3 AS kind, 6 AS end), struct(2 AS start, 0 AS kind, 3 AS end), struct(8 AS start, 1 AS kind, 10 AS end))")
    )
    assert df.select(masked(F.col("text"), F.col("spans"))).first()[0] == "0[CARD][PHONE]67[IP]"


def license_base(text):
    text = text.translate({i: i + 32 for i in range(65, 91)})
    tokens = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    places = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        places += [(i, label) for i in range(len(tokens)) if tokens[i : i + len(p)] == p]
    places.sort()
    return len(tokens), [i for i, _ in places], ",".join(sorted({x for _, x in places}))


def test_license_base_and_rules(spark):
    texts = {
        100: "CC-BY cc by CC  BY,cc by", 101: "All rights reserved. ALL-RIGHTS\nRESERVED", 102: "the GNU General Public License v2",
        103: "all rights é reserved", 104: "cc bye acc by", 105: "Licensed under the Apache License, Version 2.0.",
        106: "SPDX-License-Identifier: MIT", 107: "Released under the MIT License", 108: "GNU Lesser General Public License",
        109: "mit licht und mit freude", 110: "cc by " * 3000, 111: "K cc by İ General Public License",
    }
    rows = odd_rows() + list(texts.items())
    got = find_licenses(frame(spark, rows)).select(
        "doc_id", "text", "n_words", F.transform("base", lambda x: x["start"]).alias("at"), "base_labels", "labels", "score"
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["at"], r["base_labels"]) == license_base(r["text"] or ""), (r["text"] or "")[:50]
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[105] == "apache-2.0" and labels[106] == "mit" and labels[107] == "mit" and labels[109] == ""
    # The longer name suppresses the shorter one inside it; the base label stays.
    assert labels[108] == "gpl,lgpl" and labels[102] == "gpl,gpl-2"
    assert find_licenses(empty(spark)).count() == 0


def forms(pattern):
    """Texts of a pattern: every alternative, optional parts left out and put in."""

    def texts(nodes):
        out = [""]
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                ends = [chr(arg)]
            elif name == "IN":
                ends = ["f" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else chr(arg[0][1][0])]
            elif name == "BRANCH":
                ends = [t for branch in arg[1] for t in texts(branch)]
            elif name == "SUBPATTERN":
                ends = texts(arg[3])
            elif name == "ANY":
                ends = ["x"]
            else:  # repeats
                low, high, body = arg
                ends = [t * n for n in sorted({low, min(high, max(low, 1))}) for t in texts(body)]
            out = [a + b for a in out for b in ends]
        return out

    return texts(list(re._parser.parse(pattern)))


def license_labels(text):
    """Labels and score by every signature over the words, without gate and keywords."""
    body = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)) + " "
    found = []
    for _, pattern, priority, weight, label in signatures():
        for m in re.finditer(pattern, body, re.ASCII):
            found.append((m.start(), -m.end(), -priority, label, weight))
    found.sort()
    kept = [x for i, x in enumerate(found) if not any(y[2] <= x[2] and y[1] <= x[1] for y in found[:i])]
    _, _, base = license_base(text)
    names = {x[3] for x in kept} | set(base.split(",")) - {""}
    return ",".join(sorted(names)), max([x[4] for x in kept] + [BASE_WEIGHT] * bool(base) + [0.0])


def test_license_separators(spark):
    names = [n for _, spdx, name, _ in FAMILIES for n in [*forms(name), *["spdx license identifier " + x for x in forms(spdx)]]]
    names += [p for p, _ in BASE]
    texts = [gap.join(n.split()) for n in names for gap in (" ", "\n", "\r\n", " " * 4, " -- ", ".\t\n * ")]
    texts += [".\t\n * ".join(n.split()) for _, p, *_ in TEXTS for n in forms(p)]
    texts += [f"x {lead} {n.translate({c: c - 32 for c in range(97, 123)})} license" for n in names for lead in ("licensed under the terms of the", "governed\nby")]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in find_licenses(frame(spark, rows)).select("doc_id", "n_words", F.transform("base", lambda x: x["start"]).alias("at"), "base_labels", "labels", "score").collect()}
    for i, t in rows:
        assert (got[i]["n_words"], got[i]["at"], got[i]["base_labels"]) == license_base(t), t
        assert (got[i]["labels"], got[i]["score"]) == license_labels(t), t
        assert got[i]["labels"], t


def sellers(pattern, text):
    row, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text):
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern):
            last, row[i + 1] = row[i + 1], min(row[i + 1] + 1, row[i] + 1, last + (p != c))
        best = min(best, (row[-1], j + 1))
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=70), st.text("ab c", max_size=90))
def test_bit_parallel_distance(pattern, text):
    assert best_match(pattern, text, masks_of(pattern)) == sellers(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 30))
def test_pigeonhole_loses_nothing(seed, edits):
    import random

    rng = random.Random(seed)
    item = words(seed, 40)
    leak = list(item)
    for _ in range(edits):
        at = rng.randrange(len(leak))
        kind = rng.randrange(3)
        leak[at : at + (kind != 0)] = ["z"] if kind != 2 else []
    text = words(seed + 1, 30) + " " + "".join(leak) + " " + words(seed + 2, 30)
    budget = int(len(item) * 0.1)
    true, _ = sellers(item, text)
    got = Matcher([(1, item)], 0.1).matches(text)
    assert [(i, d) for i, d, *_ in got] == ([(1, true)] if true <= budget else [])


def test_leaks_and_edges(spark):
    item = words(11, 40)
    rows = odd_rows() + [(20, words(12, 50) + "\n" + item.upper().replace(" ", "\t") + " " + words(13, 9)), (21, item[: len(item) // 2]), (22, "tiny item here"), (23, "destiny item heretic")]
    bench = spark.createDataFrame(
        [(1, item, "a"), (2, None, "a"), (3, "  ", "a"), (4, "tiny item", "a"), (None, words(15, 30), "a"), (1, item, "b")],
        "item_id long, text string, doc_id string",
    )
    docs = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in leaks(docs, bench).collect()}
    assert got == {(20, 1, 0), (22, 4, 0)}
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert leaks(empty(spark), bench).count() == 0 and leaks(docs, bench.filter("false")).count() == 0
    assert drop_leaks(docs, bench.filter("false")).count() == len(rows)


def test_leaks_of_long_items_and_equal_texts(spark, monkeypatch):
    long = words(31, 300)[:1200]
    one = long[420:780]
    rows = [(1, "x " + long + " y"), (2, one), (3, long[:150]), (4, words(5, 200)), (5, None), (6, words(32, 60))]
    bench = spark.createDataFrame([(7, long), (8, long), (9, words(32, 60)), (9, words(33, 60)), (None, long)], "item_id long, text string")
    # Blocks of one text each, and all in one.
    for size in (100, 4_000_000):
        monkeypatch.setattr("bitextra.llm.decontaminate.BLOCK_CHARS", size)
        got = {(r["doc_id"], r["item_id"]): r for r in leaks(frame(spark, rows), bench).collect()}
        assert set(got) == {(1, 7), (1, 8), (1, None), (2, 7), (2, 8), (2, None), (6, 9)}
        full, part = got[1, 7], got[2, 7]
        assert (full["found_segments"], full["segments"], full["distance"], full["start"]) == (3, 3, 0, 2)
        assert (part["found_segments"], part["segments"]) == (1, 3) and part["distance"] <= 40
        assert {r["doc_id"] for r in drop_leaks(frame(spark, rows), bench).collect()} == {3, 4, 5}


def test_language_accuracy_and_edges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = learn(docs)
    judged = predict(docs, names, table).withColumn("out", held_out(F.col("doc_id")))
    right = judged.filter("out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95
    odd = frame(spark, odd_rows())
    got = predict(odd, names, table).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        has_letter = bool(re.search(r"[^\W\d_]", r["text"] or ""))
        assert (r["lang_pred"] != "und") == has_letter and 0 <= r["score"] <= 1
    assert predict(empty(spark), names, table).count() == 0
    nothing, none = learn(empty(spark))
    assert nothing == [] and {r["lang_pred"] for r in predict(odd, nothing, none).collect()} == {"und"}


def test_mixture_of_two_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 800")
    names, table = learn(docs)
    one = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.first(F.substring("text", 1, 800)).alias("t")).collect()}
    a, b = sorted(one)[:2]
    both = spark.createDataFrame([(1, one[a] + " " + one[b])], "doc_id long, text string")
    shares = dict(x.split(":") for x in predict(both, names, table).first()["languages"].split(","))
    assert {a, b} <= set(shares) and all(float(shares[x]) > 0.25 for x in (a, b))


def test_all_languages_of_a_text_and_none(spark):
    import random

    rng = random.Random(1)
    syllables = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(30)] for _ in range(6)]

    def prose(language, n):
        return " ".join("".join(rng.choices(syllables[language], k=rng.randint(1, 3))) for _ in range(n))

    rows = [(i, prose(i % 6, 200), f"l{i % 6}") for i in range(300)]
    names, table = learn(frame(spark, rows))
    junk = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=600))
    texts = [(1, " ".join(prose(x, 60) for x in range(6))), (2, prose(3, 60)), (3, junk)]
    got = {r["doc_id"]: r for r in predict(frame(spark, texts), names, table).collect()}
    shares = [float(x.split(":")[1]) for x in got[1]["languages"].split(",")]
    assert len(shares) == 6 and all(0.13 < x < 0.21 for x in shares)
    assert got[2]["languages"] == "l3:1.000" and got[2]["gain"] > 1 and got[3]["gain"] < 0
