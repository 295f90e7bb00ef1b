"""Language proportions of a document by expectation-maximisation over n-gram likelihoods.

Each language is a distribution over hashed byte trigrams of letters, learnt
from a bounded sample of labelled documents. A document is a mixture of these
distributions: EM estimates the proportions, and the set of languages is the
one with the largest penalised likelihood among the nested sets of the
proportions' order. Documents are scored where they are, whole, in one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15
# Expected number of documents per language used for learning; the documented bound of the sample.
SAMPLE_PER_LANGUAGE = 2000
ROUNDS = 12
# Adjacent trigrams share letters: they count as a third of independent ones.
DEPENDENCE = 1 / 3
SMOOTHING = 0.5

_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def buckets_of(text: str) -> np.ndarray:
    """The hashed trigrams of a whole text; only letters and word ends count."""
    data = _CLASS[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    blank = data == 32
    used = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    wide = data.astype(np.uint32)
    code = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    return (code[used] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by id; rows without id are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities (buckets x languages).

    Learns from about ``per_language`` documents of each label, those of the
    lowest hashes of the id. Rows with null id, label or text are not used.
    """
    labelled = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # A hash below the share that each label needs: no label's rows meet in a task.
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    share = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One row per language, and the model that travels has a column for each.
    sample = labelled.join(F.broadcast(counts), "lang").filter(share * F.col("total") < per_language).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = sums.setdefault(label, np.zeros(1 << BUCKET_BITS, np.int64))
                found = buckets_of(body.as_py())
                held += np.bincount(found, minlength=1 << BUCKET_BITS)
        for label, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(held[at])],
                names=["lang", "bucket", "n"],
            )

    counts = sample.mapInArrow(count, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((1 << BUCKET_BITS, len(names)), SMOOTHING)
    if names:
        column = np.searchsorted(np.array(names), np.array(rows.column("lang").to_pylist()))
        table[rows.column("bucket").to_numpy(), column] += rows.column("n").to_numpy()
    return names, np.log(table / table.sum(0)).astype(np.float32)


def _em(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture of the columns."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(ROUNDS):
        mixed = likelihood @ share
        share = share * (likelihood.T @ (counts / mixed)) / total
    return share, float(counts @ np.log(likelihood @ share))


def mixture(found: np.ndarray, table: np.ndarray) -> tuple[list[int], list[float], float]:
    """Languages (column numbers), proportions, largest first, and the gain over a background.

    Sets of every size up to all learnt languages are compared, nested in the
    order of their shares in the mixture of all; a size whose penalty exceeds
    what the mixture of all could gain ends the search. The gain is the log
    likelihood per trigram of the chosen mixture over that of a background in
    which all trigrams are alike.
    """
    bucket, counts = np.unique(found, return_counts=True)
    counts = counts.astype(float)
    logs = table[bucket].astype(float)
    # Scaling a row by a constant changes no proportion and no comparison of sets.
    scale = logs.max(1, keepdims=True)
    likelihood = np.exp(logs - scale)
    shares, best_of_all = _em(likelihood, counts)
    order = np.argsort(-shares, kind="stable")
    penalty = 0.5 * np.log(max(2.0, counts.sum() * DEPENDENCE))
    chosen, kept, top, value_of = order[:1], np.ones(1), -np.inf, 0.0
    for size in range(1, len(order) + 1):
        if best_of_all * DEPENDENCE - penalty * (2 * size - 1) <= top:
            break
        share, value = _em(likelihood[:, order[:size]], counts)
        best_of_all = max(best_of_all, value)
        if value * DEPENDENCE - penalty * (2 * size - 1) > top:
            chosen, kept, value_of = order[:size], share, value
            top = value * DEPENDENCE - penalty * (2 * size - 1)
    rank = np.argsort(-kept, kind="stable")
    total = counts.sum()
    gain = (value_of + float(counts @ scale[:, 0])) / total + np.log(len(table))
    return [int(chosen[i]) for i in rank], [float(kept[i]) for i in rank], gain


def predict(
    docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, languages and gain.

    ``languages`` lists the chosen set with proportions, ``gain`` is the log
    likelihood per trigram over a background of equal trigrams: below 0 the
    text is in no learnt language. A null text, a text without letters and any
    text when nothing was learnt get ``und``, score and gain 0 and no languages. Only the text is looked at. An empty table gives an
    empty result; a kept column named like a result is replaced.
    """
    from pyspark.sql import types as T

    results = ("lang_pred", "score", "languages", "gain")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in results]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField(results[0], T.StringType()), T.StructField(results[1], T.DoubleType()),
           T.StructField(results[2], T.StringType()), T.StructField(results[3], T.DoubleType())]
    )
    place = keep.index(text) if text in keep else len(keep)
    wanted = docs.select(*keep) if text in keep else docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            labels, scores, sets, gains = [], [], [], []
            for body in batch.column(place):
                body = body.as_py()
                found = buckets_of(body) if body and names and _LETTER.search(body) else ()
                if len(found):
                    which, share, gain = mixture(found, table)
                    gains.append(float(gain))
                    labels.append(names[which[0]])
                    scores.append(min(1.0, share[0]))
                    sets.append(",".join(f"{names[w]}:{s:.3f}" for w, s in zip(which, share, strict=True)))
                else:
                    labels.append("und")
                    scores.append(0.0)
                    gains.append(0.0)
                    sets.append("")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(labels, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(sets, pa.string()), pa.array(gains, pa.float64())],
                names=schema.names,
            )

    return wanted.mapInArrow(run, schema)
