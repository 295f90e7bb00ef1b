"""Known inputs and the outcome they must have."""

import pytest
from expressions import one
from pyspark.sql import functions as F

from bitextra.functions import markup as K
from bitextra.functions import numeric as N
from bitextra.functions import text as T
from bitextra.functions.glue import glue_reason
from bitextra.operators.integrity import integrity_report, numeric_drift, repair_numerics


@pytest.mark.parametrize(
    "text, expected",
    [
        ("СН РК 1.02-04-2013 «Изыскания»", True),
        ("ГОСТ 21.1101-2013", True),
        ("- СН РК 1.02-04-2013", True),
        ("ГКИНП-02-033", True),
        ("СН РК", False),
        ("ГОСТ", False),
        ("Обычный текст", False),
    ],
)
def test_designation(spark, text, expected):
    assert one(spark, T.is_designation(F.col("t")), t=text) is expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("НПА и технические условия:", "list_heading"),
        ("ГОСТ 21.1101-2013", None),
        ("Текст на русском", "untranslated_fragment"),
        ("English only", None),
        ("   ", None),
    ],
)
def test_classify_leak(spark, text, expected):
    assert one(spark, T.classify_leak(F.col("t")), t=text) == expected


def test_mixed_unit(spark):
    assert one(spark, T.is_mixed_unit(F.col("t")), t="The project предусматривает максимально") is True
    assert one(spark, T.is_mixed_unit(F.col("t")), t="ПАО «АБВГ» company") is False
    assert one(spark, T.is_mixed_unit(F.col("t")), t="СН РК 1.02-04-2013 Инженерные works") is False


@pytest.mark.parametrize(
    "text, expected",
    [("你好世界", "zh"), ("да", "ru"), ("ok", None), ("Привет мир", "ru"), ("Hello world", "en"),
     ("12345", None), ("", None), ("  ", None)],
)
def test_detect_language(spark, text, expected):
    assert one(spark, T.detect_language(F.col("t")), t=text) == expected


@pytest.mark.parametrize(
    "token",
    ["fortheproject", "createan", "ofthesite", "theinitial", "andSP", "theProject",
     "engineeringtopographic"],
)
def test_glue_found(spark, token):
    assert one(spark, glue_reason(F.col("t")), t=token) is not None


@pytest.mark.parametrize(
    "token",
    ["AutoCAD", "HydroSystem", "GalaxyG", "OpenBSD", "everything", "another", "together",
     "underground", "Documentation"],
)
def test_glue_clean(spark, token):
    assert one(spark, glue_reason(F.col("t")), t=token) is None


def tokens(spark, text):
    return [(r["kind"], r["value"]) for r in one(spark, N.numeric_tokens(F.col("t")), t=text)]


def test_numeric_kinds(spark):
    found = tokens(spark, "№732 от 24.10.2014, табл. 3.1, 120 км")
    assert found == [("ref", "732"), ("date", "24-10-2014"), ("sub", "3.1"), ("num", "120")]
    assert tokens(spark, "Давление 1.4 кПа") == [("num", "1.4")]
    assert tokens(spark, "№ 732") == [("ref", "732")]
    assert tokens(spark, "piano 12") == [("ref", "12")]


def drift(spark, source, target):
    df = spark.createDataFrame([(1, source, target)], "id INT, source STRING, target STRING")
    return [(r.kind, r.lost, r.extra) for r in numeric_drift(df).orderBy("kind", "rank").collect()]


def test_drift(spark):
    assert drift(spark, "Приказ 24.10.2014 г. №732", "Order No. 107 of October 24, 2014") == [
        ("ref", "732", "107")
    ]
    assert drift(spark, "Давление 1.4 кПа", "Pressure 1.4 kPa") == []
    assert drift(spark, "10 10 20", "30 10") == [("num", "10", "30"), ("num", "20", "")]


def test_repair(spark):
    df = spark.createDataFrame(
        [(1, "Приказ №732", "Order No. 107 now 107"), (2, "31 т", "41 t"), (3, "п. 3.1", "see 1.2")],
        "id INT, source STRING, target STRING",
    )
    got = {r.id: (r.repaired, r.unresolved) for r in repair_numerics(df).collect()}
    assert got[1] == ("Order №732 now 107", 0)
    assert got[2] == ("41 t", 1)
    assert got[3] == ("see 3.1", 0)


def test_protect_round_trip(spark):
    text = "№732, 24.10.2014 и 1.02-04-2013, 55"
    guarded = one(spark, N.protect(F.col("t")), t=text)
    assert "732" not in guarded and guarded.count("⟦NUM") == 4
    assert one(spark, N.restore(N.protect(F.col("t")), N.registry(F.col("t"))), t=text) == text


def paragraphs(spark, texts):
    return spark.createDataFrame(
        [(1, i, x) for i, x in enumerate(texts)], "doc_id LONG, idx LONG, text STRING"
    )


def report(spark, src, tgt):
    return integrity_report(paragraphs(spark, src), paragraphs(spark, tgt)).first()


def test_integrity(spark):
    ten = [f"text {chr(97 + i)}" for i in range(10)]
    assert report(spark, ten, ten[:6]).critical and report(spark, ten, ten[:6]).lost_paragraphs == 4
    assert not report(spark, ten, ten[:7]).critical
    assert report(spark, ["No. 732"], ["No. 107"]).critical
    advisory = report(spark, ["31 kilotons"], ["41 kilotons"])
    assert advisory.numeric_mismatch_count == 1 and not advisory.critical
    assert not report(spark, ["room №3"], ["room №4"]).critical


def test_format_codes(spark):
    text = "{\\fArial|b0|i0;Valve\\PSize}"
    assert one(spark, K.encode_format_codes(F.col("t")), t=text) == "{[[F0]]Valve[[F1]]Size}"
    back = K.decode_format_codes(K.encode_format_codes(F.col("t")), K.format_code_tokens(F.col("t")))
    assert one(spark, back, t=text) == text
    got = one(spark, K.format_code_tokens(F.col("t")), t="\\PMiddle\\H1.5x;")
    assert [x["original"] for x in got] == ["\\P", "\\H1.5x;"]
    assert one(spark, K.has_content(F.col("t")), t=" [[F0]] ") is False


def test_model_output(spark):
    noisy = "Sure, here is: <think>a\nb</think>```json\n{\"x\": 1}\n```"
    assert one(spark, K.clean_model_output(F.col("t")), t=noisy) == '{"x": 1}'
    assert one(spark, K.repair_json(F.col("t")), t='[{"a":1}{"b":"\\P"},]') == '[{"a":1},{"b":"\\\\P"}]'
    assert one(spark, K.add_value_key_commas(F.col("t")), t='{"id":"1" "text":"x"}') == '{"id":"1", "text":"x"}'


@pytest.mark.parametrize(
    "response, expected",
    [
        ('{"translations":[{"id":"1","text":"a"}]}', [("1", "a")]),
        ('{"id":"1","text":"a"}', [("1", "a")]),
        ('{"id":"1","text":"a"},{"id":"2","text":"b"}', [("1", "a"), ("2", "b")]),
        ('{"translations":[{"id":"1","text":"a"},]}', [("1", "a")]),
        ('{"translations":[{"id":"1","text":"a"}]} and } more', [("1", "a")]),
        ('{"translations":[{"id":"1","text":""},{"id":2,"text":"b"}]}', [("2", "b")]),
        ('{"translations":[{"id":"1","text":"a"},{"id":"2","te', None),
        ("no json", None),
    ],
)
def test_responses(spark, response, expected):
    from bitextra.operators.responses import parse_responses

    df = spark.createDataFrame([(response,)], "response STRING")
    items = parse_responses(df).first()["items"]
    assert (None if items is None else [(i["id"], i["text"]) for i in items]) == expected


def test_multisets_are_linear_and_exact(spark):
    import random
    import time
    from collections import Counter

    from bitextra.functions.numeric import multiset_minus

    rng = random.Random(6)
    rows = [([str(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))], [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))])
            for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for a, b, got in df.select("a", "b", multiset_minus(F.col("a"), F.col("b"))).collect():
        over = Counter(a) - Counter(b)
        assert got == [v for v in dict.fromkeys(a) for _ in range(over[v])]
    wide = [([str(i % 15_000) for i in range(20_000)], [str(i) for i in range(5_000, 20_000)])]
    start = time.time()
    got = spark.createDataFrame(wide, df.schema).select(multiset_minus(F.col("a"), F.col("b"))).first()[0]
    assert Counter(got) == Counter(wide[0][0]) - Counter(wide[0][1]) and time.time() - start < 20


def test_lines_of_a_page_of_many_words(spark):
    import time

    from bitextra.sources.pagetext import page_lines, words_type

    words = [(f"w{i}", 0.0, 0.0, 0.0, 0.0, i % 4, None if i % 3 == 0 else i % 5000, i) for i in range(20_000)]
    pages = spark.createDataFrame([(1, "p", "", words), (2, "p", "a\nb", [])], f"page int, pdf string, text string, words {words_type()}")
    start = time.time()
    got = [(r.page, r.pos, r.block, r.line, r.text) for r in page_lines(pages).collect()]
    assert time.time() - start < 20
    lines = {}
    for text, *_, block, line, _ in words:
        lines.setdefault((block, line or 0), []).append(text)
    true = [(1, n, b, at, " ".join(t)) for n, ((b, at), t) in enumerate(lines.items())]
    assert sorted(got, key=lambda r: r[:2]) == true + [(2, 0, None, None, "a"), (2, 1, None, None, "b")]


def test_long_responses_are_scanned_once(spark):
    import json
    import time

    from bitextra.operators.responses import parse_responses

    item = '{"id":"%d","text":"a } \\" { b \\\\"},'
    broken = '{"translations":[' + "".join(item % i for i in range(30_000)) + '{"id":"x","te'
    tail = json.dumps({"translations": [{"id": "1", "text": 'q"}{'}]}) + " and } { more }"
    df = spark.createDataFrame([(1, broken), (2, tail), (3, "{" * 200_000 + "}" * 199_999)], "n int, response string")
    start = time.time()
    got = {r.n: r["items"] for r in parse_responses(df).collect()}
    assert time.time() - start < 30
    assert got[1] is None and got[3] is None and [(i["id"], i["text"]) for i in got[2]] == [("1", 'q"},{')]
