"""Numeric tokens: how often a text is passed over, and that one pass finds what one per group does."""

import random
import re

from pyspark.sql import functions as F

from bitextra.functions import numeric as N
from bitextra.operators.inference import post_process


def passes(plan: str, column: str, pattern: str) -> int:
    return len(re.findall(rf"regexp_\w+\({column}#\d+, {re.escape(pattern)}, ", plan))


def test_a_verdict_takes_the_tokens_of_a_text_once(spark):
    """References are looked for once; the scan is one pass, or one per group beside it."""
    units = spark.createDataFrame([(1, "№732 3.1", "No. 107 1.2")], "id INT, source STRING, target STRING")
    judged = post_process(units, "source", "target")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert passes(plan, "_restored", N.REF_PATTERN) == passes(plan, "source", N.REF_PATTERN) == 1
    for column in ("_restored", "source"):
        assert passes(plan, column, N.SCAN_PATTERN) == 6
        assert len(re.findall(rf"regexp_replace\({column}#\d+, {re.escape(N.SCAN_PATTERN)}, ", plan)) == 1
    assert judged.first()["final"] == "№732 3.1"


def test_one_pass_finds_what_one_per_group_does(spark):
    """Against the patterns without lookahead, on texts with and without the control characters."""
    rng = random.Random(17)
    pieces = ["No. 12", "№7", "nO 3.1", "n", "N", "№", "№ 3.1-2", "1.02-04-2013", "24.10.2014", "55", "7", "٣٤", "4.5 кПа",
              "3.1%x", "1.2 м/с", "$1", "\\", "\n", " ", "𝟙𝟚", " ", ".", "x"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(600)]
    texts += ["".join(rng.choices([*pieces, "\x01", "\x02"], k=9)) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    t, bare = F.col("t"), re.compile(re.escape(r"(?=[№N") + r"(?:\\d)?" + re.escape("])"))
    scan, ref, span = (bare.sub("", p) for p in (N.SCAN_PATTERN, N.REF_PATTERN, N.SPAN_PATTERN))
    assert len({scan, ref, span, N.SCAN_PATTERN, N.REF_PATTERN, N.SPAN_PATTERN}) == 6

    def found(pattern, group=0):
        return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))

    rows = df.select(
        N.scan_groups(t).alias("groups"), F.array(*[found(scan, i) for i in range(5)]).alias("each"),
        F.array(found(N.REF_PATTERN), found(N.SPAN_PATTERN)).alias("new"), F.array(found(ref), found(span)).alias("old"),
    ).collect()
    matches = 0
    for r in rows[:-1]:
        assert [tuple(g) for g in r["groups"]] == list(zip(*r["each"])) and r["new"] == r["old"]
        matches += len(r["groups"])
    assert matches > 1000 and rows[-1]["groups"] is None
