"""Conversations as training text with a loss mask aligned by offsets.

A conversation is rendered whole by one template, encoded once with character
offsets, and the sorted spans of its turns are intersected with the spans of
the tokens by binary search. Control strings inside texts and roles are
escaped reversibly, so the output can be read back without loss.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's marks. They are tokens of their own, so no token crosses a mark.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that steer some model or template, fixed values; each is escaped in texts.
CONTROL = (
    TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
# The escape character; a text's own ones are escaped too.
ESCAPE = "␛"
_CODES = {c: ESCAPE + chr(ord("b") + i) for i, c in enumerate(CONTROL)} | {ESCAPE: ESCAPE + "a"}
_BACK = {v: k for k, v in _CODES.items()}
_FIND = re.compile("|".join(re.escape(c) for c in sorted(_CODES, key=len, reverse=True)))
_UNDO = re.compile(re.escape(ESCAPE) + "[a-z]")
_PARSE = re.compile(
    f"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}\n", re.DOTALL
)
# Conversations encoded in one call of the tokenizer; their texts are bounded by the Arrow batch.
ENCODE_AT_ONCE = 64


def escape(text: str) -> str:
    """No control string is left, and ``unescape`` gives the text back.

    Every control string begins with a bracket and holds no escape character;
    what replaces it is an escape character and a letter, so no new one arises.
    """
    return _FIND.sub(lambda m: _CODES[m.group()], text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: _BACK[m.group()], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the span of each turn's (escaped) text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role)}{BODY}"
        body = escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at = spans[-1][1] + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The vocabulary with the template's marks as extra tokens; offsets are exact."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, BODY, END)])
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that touch one of the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    # The last span that begins before the token ends is the only one it can touch last.
    at = np.searchsorted(starts, offsets[:, 1], "left") - 1
    return (at >= 0) & (offsets[:, 0] < ends[np.maximum(at, 0)]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All characters under the mask, each once, unescaped.

    Tokens of one character (a character may be several byte tokens) share its span.
    """
    pieces, done = [], 0
    for a, b in offsets[mask]:
        a = max(int(a), done)
        if b > a:
            pieces.append(formatted[a:b])
            done = int(b)
    return unescape("".join(pieces))


_SCHEMA = (
    "conv_id long, n_turns long, formatted string, ids array<int>, loss array<boolean>, "
    "starts array<int>, ends array<int>"
)


def format_conversations(
    conversations: DataFrame, tokenizer_path: str | None = None, loss_role: str = "assistant"
) -> DataFrame:
    """One row per conv_id: formatted, ids, loss (per token) and the tokens' starts and ends.

    Rows are ordered by turn, then role and text; repeated rows stay. Null
    texts and roles are empty, null turns come first, rows with null conv_id
    form one conversation with null id. A conversation is the unit of the
    format and is held by one task; conversations are spread by id, and one
    must fit in a row. Other columns are ignored. An empty table gives an empty
    result. Loss is on the texts of ``loss_role``.
    """
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    gathered = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    gathered = gathered.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            for first in range(0, batch.num_rows, ENCODE_AT_ONCE):
                part = batch.slice(first, ENCODE_AT_ONCE)
                turns = [
                    list(zip(r, t, strict=True))
                    for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ]
                rendered = [render(t) for t in turns]
                encoded = tokenizer.encode_batch([f for f, _ in rendered], add_special_tokens=False)
                rows = []
                for (text, spans), e, held in zip(rendered, encoded, turns, strict=True):
                    offsets = _exact(text, e)
                    wanted = [s for s, (role, _) in zip(spans, held, strict=True) if role == loss_role and s[1] > s[0]]
                    rows.append((len(held), text, e.ids, loss_mask(offsets, wanted), offsets[:, 0], offsets[:, 1]))
                kinds = (
                    pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
                    pa.list_(pa.int32()), pa.list_(pa.int32()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)]
                    + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["conv_id", "n_turns", "formatted", "ids", "loss", "starts", "ends"],
                )

    return gathered.mapInArrow(run, _SCHEMA)


def _exact(text: str, encoding) -> np.ndarray:
    """Token offsets that cover the text without the trimming of leading blanks."""
    offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    if len(offsets):
        # A trimmed blank lies between a token's end and the next one's start.
        previous = np.concatenate([[0], np.maximum.accumulate(offsets[:, 1])[:-1]])
        offsets[:, 0] = np.where(offsets[:, 0] > previous, previous, offsets[:, 0])
        offsets[-1, 1] = len(text)
    return offsets


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: their turns and the text under the loss mask."""
    import hashlib

    def run(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(n) for n in ("conv_id", "formatted", "loss", "starts", "ends")]
            for i in range(batch.num_rows):
                text = columns[1][i].as_py()
                mask, starts, ends = (columns[k][i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                turns = parse(text)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                learnt = masked_text(text, np.stack([starts, ends], 1), mask.astype(bool))
                rows.append(
                    (
                        columns[0][i].as_py(), len(turns), hashlib.sha256(told.encode()).hexdigest(),
                        len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text),
                    )
                )
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                )

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
