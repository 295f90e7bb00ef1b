import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from llm_rows import empty, frame, odd_rows, words

from bitextra.llm.token_alignment import align, leaf_groups


def tokens(texts):
    """(ids, bytes) of both sides by the tokenizers themselves; None where they do not spell the text."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    stand = {}
    extra = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            stand[chr(b)] = b
        else:
            stand[chr(256 + extra)] = b
            extra += 1
    for text in texts:
        if not text:
            yield None
            continue
        found = whole.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(stand[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)]
        b = []
        for i in piece.encode(text):
            p = piece.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
        data = (" " + text).encode()
        yield (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == data else None


def groups_of(a, b):
    """Groups by walking both sides token by token."""
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    while i < len(a):
        ga, gb = [a[i][0]], [b[j][0]]
        at_a, at_b = at_a + len(a[i][1]), at_b + len(b[j][1])
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                ga.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                gb.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
        out.append((ga, gb))
    return out


def brute(rows):
    found = [None if x is None else groups_of(*x) for x in tokens([t for _, t in rows])]
    count = Counter()
    for groups in found:
        count.update({(x, y) for ga, gb in groups or [] for x in ga for y in gb})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), groups in zip(rows, found, strict=True):
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            i, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest(), text,
        ))
    return out


def test_alignment_against_walk(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(50, "</s>[INST] <|endoftext|> ok <s> <unk>"), (51, "▁ marks"), (52, " lead"), (53, "tab\t\n  two  "),
             (54, "日本語のテキスト 😀😀 ñandú"), (55, "\u0000 x"), (56, "aaaaaaaaaaa" * 300), (57, "=-" * 3000), (58, " ")]
    rows += [(100 + k, words(k, 5 * k, "abcdeé 1.")) for k in range(40)]
    true = sorted(brute(rows), key=repr)
    for hot in (1 << 18, 200, 0):
        got = align(frame(spark, rows), hot_pairs=hot)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == true
    slow = align(frame(spark, rows[-20:]), byte_path=P.path("byte_bpe_50k.json"), with_groups=False)
    assert sorted((tuple(r)[:8] for r in slow.collect()), key=repr) == sorted((r[:8] for r in brute(rows[-20:])), key=repr)
    assert align(empty(spark)).count() == 0


def test_leaf_groups_of_any_ends():
    rng = random.Random(1)
    for _ in range(300):
        a, b, starts_a, starts_b, base = [], [], [0], [0], 0
        for _ in range(rng.randint(1, 4)):
            size = rng.randint(1, 400)
            share = rng.random()
            for ends, starts in ((a, starts_a), (b, starts_b)):
                ends += sorted({base + x for x in range(1, size) if rng.random() < share} | {base + size})
                starts.append(len(ends))
            base += size
        first_a, first_b = leaf_groups(*(np.array(x) for x in (a, b, starts_a, starts_b)))
        cuts = sorted(set(a) & set(b))
        assert first_a.tolist() == [0] + [a.index(c) + 1 for c in cuts[:-1]]
        assert first_b.tolist() == [0] + [b.index(c) + 1 for c in cuts[:-1]]


def test_wide_groups_link_alike(monkeypatch):
    from bitextra.llm import token_alignment as T

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 500), rng.integers(0, 30, 500)
    first_a, first_b, doc = np.array([0, 3, 4, 200]), np.array([0, 1, 9, 250]), np.array([0, 0, 1, 1])
    plain = T._links(a, b, first_a, first_b, doc, 30)
    for bound in (1, 10, 10**9):
        monkeypatch.setattr(T, "WIDE_GROUP", bound)
        assert all((x == y).all() for x, y in zip(plain, T._links(a, b, first_a, first_b, doc, 30), strict=True))
    assert plain[2].sum() == 3 * 1 + 1 * 8 + 196 * 241 + 300 * 250
