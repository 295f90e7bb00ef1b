"""Personal data: fixed entity shapes, and identifiers found by bootstrapped contexts.

Everything is DataFrame functions. Entities of the four base kinds are seeds.
The words and punctuation around an identifier-like string are its lexical
patterns: the word before with what parts them, the two words before, and the
word after. Patterns and instances form a bipartite graph that is scored in
rounds: a pattern is as good as the share of its places that lead to good
instances - counted against all places of exactly this context in all texts,
so that common contexts never qualify - and an instance is as good as its
patterns together make it. Uses of good patterns that are no base entity are
the newly found identifiers.

Texts are read where they are. Contexts that lead to too few instances cannot
qualify and are not counted; only spans, counts and scores are shuffled, all of
them pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.containment import fits_broadcast
from ..session import cut_lineage
from .spans import let, places, running

# Fixed by the contract, written so that long runs of digits or letters take linear time:
# possessive runs, and no start in the middle of a run (\G: right after the last match).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
# An identifier-like string: a token of at least six characters with a digit.
IDENTIFIER = r"(?<![\p{L}\p{N}])(?=[\p{L}._@-]{0,24}[0-9])[\p{L}\p{N}][\p{L}\p{N}._@-]{4,62}[\p{L}\p{N}](?![\p{L}\p{N}])"

ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_INSTANCES = 5
SMOOTHING = 2.0
CONTEXT_CHARS = 48


def _matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, m, before, after)> of the leftmost matches, in code points."""
    return places(
        text,
        F.lit(pattern),
        F.length,
        lambda start, length, m, before, after: F.struct(
            start.alias("start"),
            (start + length).alias("end"),
            m.alias("m"),
            F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
            F.substring(after, 1, CONTEXT_CHARS).alias("after"),
        ),
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(
        figures,
        lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _kind_spans(text: Column, number: int, pattern: str) -> Column:
    valid = F.filter(_matches(text, pattern), lambda x: _valid(KINDS[number], x["m"]))
    return F.transform(
        valid, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"))
    ).cast(_SPANS)


def base_spans(text: Column) -> Column:
    """Sorted (start, kind number, end) of all base entities; empty for null."""
    none = F.array().cast(_SPANS)
    email, ip, card, phone = (_kind_spans(text, k, p) for k, p in enumerate((EMAIL, IP, CARD, PHONE)))
    email = F.when(F.contains(text, F.lit("@")), email).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), phone).otherwise(none)
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(email, ip, card, phone))).otherwise(none)


# What leads to an identifier, and what follows it; a context within a text is read in the same way.
ONE_BEFORE = r"(\p{L}+[^\p{L}\p{N}]*)$"
TWO_BEFORE = r"(\p{L}+[^\p{L}\p{N}]+\p{L}+[^\p{L}\p{N}]*)$"
ONE_AFTER = r"^([^\p{L}\p{N}]*\p{L}+)"


def _contexts(before: Column, after: Column) -> Column:
    """Contexts of a place: marked by kind, so that equal strings of two kinds differ."""
    sides = ((">", before, ONE_BEFORE), (">>", before, TWO_BEFORE), ("<", after, ONE_AFTER))
    found = [F.concat(F.lit(mark), F.regexp_extract(side, pattern, 1)) for mark, side, pattern in sides]
    return F.filter(F.array(*found), lambda c: ~c.isin(">", ">>", "<"))


def _all_contexts(text: Column) -> Column:
    """Every context of a text, wherever it leads."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+[^\p{L}\p{N}]*"), F.lit(0))

    def pairs(w: Column) -> Column:
        one = F.transform(w, lambda x: F.concat(F.lit(">"), x))
        two = F.transform(
            F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
            lambda x, i: F.concat(F.lit(">>"), F.get(w, i), x),
        )
        return F.concat(one, two)

    after = F.transform(
        F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}]*\p{L}+"), F.lit(0)), lambda x: F.concat(F.lit("<"), x)
    )
    return F.concat(let(words, pairs), after)


def _uses(text: Column) -> Column:
    """Identifier-like strings with their contexts and whether a base entity is one."""
    every = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, IP, r"[0-9]++(?:[\x20-][0-9]++)++", IDENTIFIER))

    def use(x: Column) -> Column:
        m = x["m"]
        seed = (
            m.rlike(f"^(?:{EMAIL})$")
            | (m.rlike(f"^(?:{IP})$") & _valid("ip", m))
            | (m.rlike(f"^(?:{PHONE})$") & _valid("phone", m))
            | (m.rlike(f"^(?:{CARD})$") & _valid("card", m))
        )
        return F.struct(
            _contexts(F.lower(x["before"]), F.lower(x["after"])).alias("contexts"),
            F.lower(m).alias("instance"), seed.alias("seed"), x["start"].alias("start"), x["end"].alias("end"),
        )

    kind = "array<struct<contexts:array<string>,instance:string,seed:boolean,start:int,end:int>>"
    found = F.filter(F.transform(_matches(text, every), use), lambda u: F.length(u["instance"]) >= 6).cast(kind)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(kind))


def score_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(context, confidence) after ROUNDS rounds over the graph of uses.

    ``edges`` has context, instance, n and seed, one row each; ``totals`` the places of each context. A common instance or pattern is one
    pre-aggregated row per edge.
    """
    every = cut_lineage(edges.join(totals, "context"))
    scores = every.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    confidence = None
    for _ in range(ROUNDS):
        good = every.join(scores, "instance").groupBy("context").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.max("total").alias("total")
        )
        confidence = cut_lineage(
            good.select("context", (F.col("good") / (F.col("total") + SMOOTHING)).alias("confidence"))
        )
        miss = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        scores = every.join(confidence, "context").groupBy("instance").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(miss)).alias("score")
        )
    return confidence


def _held_out(instance: Column) -> Column:
    """A fifth of the instances, for measuring."""
    return F.pmod(F.xxhash64(F.lit(5), instance), F.lit(5)) == 0


def _good_patterns(uses: DataFrame, lowered: DataFrame) -> DataFrame:
    """The contexts that qualify; ``lowered`` has the texts in lower case."""
    edges = uses.select(F.explode("contexts").alias("context"), "instance", "seed").groupBy(
        "context", "instance"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = cut_lineage(edges)
    enough = (
        edges.groupBy("context").agg(F.count(F.lit(1)).alias("instances"))
        .filter(F.col("instances") >= MIN_INSTANCES).select("context")
    )
    edges = cut_lineage(edges.join(enough, "context", "left_semi"))
    asked = cut_lineage(edges.select("context").distinct())
    places_of = lowered.select(F.explode(_all_contexts(F.col("text"))).alias("context"))
    # Of measured size, or met by their sums.
    if fits_broadcast(asked):
        totals = places_of.join(F.broadcast(asked), "context").groupBy("context").agg(F.count(F.lit(1)).alias("total"))
    else:
        totals = places_of.groupBy("context").agg(F.count(F.lit(1)).alias("total")).join(asked, "context")
    # A context at the very edge of a match may be read otherwise within the text: never fewer than its uses.
    led = edges.groupBy("context").agg(F.sum("n").alias("led"))
    totals = led.join(totals, "context", "left").select(
        "context", F.greatest("led", F.coalesce("total", F.lit(0))).alias("total")
    )
    return score_patterns(edges, totals).filter(F.col("confidence") >= MIN_CONFIDENCE).select("context")


def held_out_recall(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: base entities of a fifth of the instances, and how many of them the contexts find.

    These instances are no seeds while patterns are scored; what comes back
    tells how well the contexts of a table lead to identifiers not seen before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    read = cut_lineage(docs.select(F.lower(body).alias("text"), _uses(body).alias("u")))
    uses = read.select(F.explode("u").alias("u")).select("u.*").withColumn("held", _held_out(F.col("instance")))
    known = uses.withColumn("seed", F.col("seed") & ~F.col("held"))
    good = _good_patterns(known, read.select("text"))
    asked = uses.filter(F.col("seed") & F.col("held")).withColumn("_use", F.monotonically_increasing_id())
    found = asked.select("_use", F.explode("contexts").alias("context")).join(good, "context", "left_semi")
    return asked.select("_use").join(found.select("_use").distinct().withColumn("hit", F.lit(1)), "_use", "left").agg(
        F.count(F.lit(1)).alias("held_out"), F.count("hit").alias("found")
    )


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of start, kind, end, sorted).

    Positions are code points, ends exclusive; kinds are numbers into KINDS.
    Null and empty texts have no spans; every row keeps a row of its own,
    repeated ones too; an empty table gives an empty result. All columns are
    kept; input columns named like a result or ``_pii_*`` are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c not in ("base", "spans") and not c.startswith("_pii_")]
    read = cut_lineage(
        docs.select(
            *kept,
            F.monotonically_increasing_id().alias("_pii_row"),
            base_spans(body).alias("base"),
            _uses(body).alias("_pii_uses"),
        )
    )
    uses = read.select("_pii_row", F.explode("_pii_uses").alias("u")).select("_pii_row", "u.*")
    # All texts count, to weigh a context against all its places; only sums are shuffled.
    texts = read if text in kept else docs
    good = _good_patterns(uses, texts.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")))
    fresh = (
        uses.filter(~F.col("seed")).select("_pii_row", "start", "end", F.explode("contexts").alias("context"))
        .join(good, "context", "left_semi").select("_pii_row", "start", "end").distinct()
    )
    more = fresh.groupBy("_pii_row").agg(
        F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("_pii_more")
    )
    # Rows without an unseen identifier are complete; only the others meet the join.
    rest = F.exists("_pii_uses", lambda u: ~u["seed"])
    plain = read.filter(~rest).withColumn("spans", F.col("base"))
    spans = F.array_sort(F.concat("base", F.coalesce(F.col("_pii_more").cast(_SPANS), F.array().cast(_SPANS))))
    met = read.filter(rest).join(more, "_pii_row", "left").withColumn("spans", spans)
    return plain.select(*kept, "base", "spans").unionByName(met.select(*kept, "base", "spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

    def mark(s: Column, at: Column) -> Column:
        gap = F.when(s["start"] > at, F.substring(text, at + 1, s["start"] - at)).otherwise("")
        return F.when(s["end"] <= at, "").otherwise(F.concat(gap, F.get(names, s["kind"])))

    rest = let(
        F.array_max(F.transform(spans, lambda s: s["end"])),
        lambda last: F.substring(text, last + 1, F.length(text)),
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(F.zip_with(spans, done, mark), ""), rest)
    )
