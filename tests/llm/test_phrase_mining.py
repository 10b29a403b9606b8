"""Phrase mining against counting all phrases in one dictionary."""

import collections
import random
import re

import numpy as np
import pytest

from tunelake.llm.phrase_mining import packed, phrase_collocations, pieces_of, unpacked

SCHEMA = "doc_id long, text string, lang string"


def expected(rows, least, most_words, share, top):
    counts, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: f for p, f in counts.items() if f >= least and len(p) > 2}
    out = collections.defaultdict(list)
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        if any(
            q[0] == lang and len(q) > len(p) and 100 * f >= share * a and any(q[i : i + len(words)] == words for i in range(1, len(q)))
            for q, f in candidates.items()
        ):
            continue
        score, _, l, r = min((10**6 * a * a // (counts[p[: k + 1]] * counts[(lang, *words[k:])]), k, counts[p[: k + 1]], counts[(lang, *words[k:])]) for k in range(1, len(words)))
        out[lang].append((-score, -a, b" ".join(words), l, r))
    return {(lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, w, l, r) in enumerate(sorted(found)[:top])}


def made_rows():
    draw = random.Random(8)
    rows = []
    for i in range(300):
        words = draw.choices(["the", "The", "a", "New", "york", "city", "ein", "é", "漢字", "x-y", "\x00", "hot"], [30, 5, 8, 4, 4, 4, 3, 2, 2, 2, 1, 9], k=draw.choice([0, 1, 5, 60]))
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"]) for w in words)
        rows.append((i, text, draw.choice(["en", "en", "de", None, "und", ""])))
    passage = "one long passage of words that many documents share, and a second piece of it"
    return rows + [(900 + i, passage, "en") for i in range(40)] + [(7, None, "en"), (None, "hot hot hot hot hot", None)] * 3


@pytest.mark.parametrize("most_words, least, block", [(3, 10, 4 << 20), (3, 2, 300), (4, 3, 2000), (2, 5, 500)])
def test_equals_one_dictionary(spark, most_words, least, block):
    rows = made_rows()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS block", "1 AS number", "2 AS id").repartition(5)
    got = {tuple(r) for r in phrase_collocations(frame, least, most_words, 50, 30, block).collect()}
    want = expected(rows, least, most_words, 50, 30)
    assert want and got == want


def test_one_text_over_many_blocks(spark):
    words = ["alpha", "beta", "gamma", "delta."]
    draw = random.Random(1)
    rows = [(1, " ".join(draw.choice(words) for _ in range(60_000)), "en")]
    assert {tuple(r) for r in phrase_collocations(spark.createDataFrame(rows, SCHEMA), block=5000).collect()} == expected(rows, 10, 3, 50, 2000)


def test_no_phrases(spark):
    assert phrase_collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrase_collocations(spark.createDataFrame([(1, None, None), (2, "a b. c", "en")], SCHEMA)).collect() == []


def test_counts_beyond_64_bits_of_product(spark):
    """1000000 * a * a passes 64 bits from a = 3,037,000 on; counted here in one text of few pieces."""
    n = 3_200_000
    got = phrase_collocations(spark.createDataFrame([(1, "a b\n" * n, "en")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", n, n, n, 2 * n, 1_000_000)]


def test_packing_and_parts():
    values = np.array([0, -1, 5, 1 << 40, -(1 << 62)], dtype=np.int64)
    assert unpacked(packed(values), np.int64).tolist() == values.tolist()
    assert unpacked(packed(values[:0]), np.int64).tolist() == []
    text = b"A b. c d, " + b"w" * 50 + b" e;f"
    for most in (1, 5, 20, 1000):
        assert b"".join(pieces_of(text, most)) == b"a b\n c d\n " + b"w" * 50 + b" e\nf"
        assert all(p.endswith(b"\n") for p in list(pieces_of(text, most))[:-1])
