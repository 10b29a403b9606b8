"""Operators against brute force on small tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tunelake.llm import best_fit_packing, byte_bpe, hilbert_sharding, ngram_jaccard_join, parsing_fingerprint, pitman_yor_lm, sketch, suffix_dedup
from tunelake.llm.crf_language_id import op6_crf_language_id
from tunelake.llm.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def rows(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return list(zip(table["doc_id"], table["text"], strict=True))


def components(rows, words, over, under):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and under * both >= over * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    made = random.Random(5)
    rows = []
    for i in range(240):
        n = made.choice([3, 5, 8, 11, 12, 13, 20, 22, 25, 40])
        base = random.Random(i // 8 * 100 + n)
        words = [base.choice("abcdefgh") + str(base.randint(0, 40)) for _ in range(n)]
        for _ in range(made.choice([0, 0, 1, 1, 2])):
            words[made.randrange(n)] = made.choice("xyz")
        rows.append((i, " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, " \n")]


@pytest.mark.parametrize("words, similarity", [(3, (90, 100)), (5, (80, 100))])
def test_jaccard_on_documents(spark, sf_dir, rows, words, similarity):
    found = ngram_jaccard_join.linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), words, similarity)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, words, *similarity)


@pytest.mark.parametrize("light", [0, 12, 20, None])
def test_jaccard_for_every_border(spark, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(ngram_jaccard_join, "light_border", lambda *_: light)
    rows = near_rows()
    found = ngram_jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1, (90, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, 1, 90, 100)


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard_join, "BLOCK_SETS", 3)
    rows = near_rows()
    found = ngram_jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2, (80, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, 2, 80, 100)


def test_subsets_are_shared_by_linked_sets():
    similarity = (80, 100)
    for n, m in itertools.product(range(1, 16), repeat=2):
        need = ngram_jaccard_join.needed(n, m, similarity)
        if need <= min(n, m):
            a, b = np.arange(n, dtype=np.uint64), np.concatenate([np.arange(need), 100 + np.arange(m - need)]).astype(np.uint64)
            keys = [set(ngram_jaccard_join.subset_keys(x, 16, similarity).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_sketch_tells_single_names():
    names = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    cells = np.sort((names >> np.uint64(48)).astype(np.int64))
    assert (sketch.unpacked(sketch.packed(cells)) == cells).all()


def removal(rows, length=200):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[p : p + length] for b in texts.values() for p in range(len(b) - length + 1))
    found = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        found[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def passage_rows():
    made = random.Random(3)
    passages = ["".join(made.choice("abc é") for _ in range(made.randint(150, 420))) for _ in range(12)]
    kinds = [
        lambda: made.choice(passages),
        lambda: made.choice(passages)[made.randint(0, 60) :],
        lambda: "".join(made.choice("abcdef ") for _ in range(made.randint(0, 300))),
        lambda: "la " * made.randint(1, 150),
    ]
    rows = [(i, "".join(made.choice(kinds)() for _ in range(made.randint(0, 4)))) for i in range(100)]
    return [*rows, (200, None), (201, ""), (202, "x" * 199), (203, "x" * 199), (204, "y" * 200), (205, "y" * 201), (206, "z" * 200), (207, "z" * 200)]


def test_suffixes_on_documents(spark, sf_dir, rows):
    found = suffix_dedup.removal_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == removal(rows)


def test_suffixes_on_passages(spark):
    rows = passage_rows()
    found = suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == removal(rows)


def test_runs_cover_every_suffix_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "_powers", [])
    texts = [(t or "").encode() for _, t in passage_rows()]
    seen = collections.Counter()
    for block in suffix_dedup.blocks(texts):
        first, last, anchor, piece = block.runs()
        assert ((anchor >= last) & (anchor - first < suffix_dedup.WINDOW)).all()
        for a, b, k in zip(first, last, piece, strict=True):
            shift = block.offset[k] - block.start[k]
            seen.update((int(block.text[k]), int(p + shift)) for p in range(a, b + 1))
    assert seen == collections.Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 199))


def test_line_dedup_and_exact_dedup_match_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in oracle_sql().items():
        found = queries()[name](spark, sf_dir)
        columns = sorted(found.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in found.collect())


ODD = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "é", "É", "İ", "Σ", "ß", "x'S", "'ll", "23", "½", "٣", "漢字", "́", "​", "!", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "\x00", "Hello", " ", "᠎", "🙂"]


def odd_texts():
    made = random.Random(1)
    return ["".join(made.choice(ODD) for _ in range(made.randint(0, 30))) for _ in range(600)]


def test_byte_bpe_is_that_of_the_library(rows):
    with open(byte_bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe()
    texts = [t for _, t in rows] + odd_texts() + ["w" * 3000]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_word_ids_are_those_of_the_library(rows):
    library, words = Tokenizer.from_file(best_fit_packing.VOCABULARY), best_fit_packing.WordIds()
    for text in [t for _, t in rows] + odd_texts():
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_word_token_encodes_to_itself():
    """What makes merging by the lowest rank the same in both libraries."""
    model = Tokenizer.from_file(best_fit_packing.VOCABULARY)
    for token in model.get_vocab(with_added_tokens=False):
        if token.endswith("</w>"):
            assert [t.value for t in model.model.tokenize(token[:-4])] == [token]


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_bins_without_gaps(seed):
    made = np.random.default_rng(seed)
    lengths = made.integers(1, 2049 if seed % 2 else 700, 3000)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    counts[1], counts[2048] = 2500, 3
    plan = best_fit_packing.plan_bins(counts)
    bins = collections.defaultdict(list)
    for i, (n, first, sequence, each, offset) in enumerate(plan.tolist()):
        last = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == n else counts[n]
        for k in range(last - first):
            bins[sequence + k // each].append((offset + k % each * n, n))
    assert sum(map(len, bins.values())) == sum(counts.values()) and sorted(bins) == list(range(len(bins)))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and sum(3 * n > 2048 for _, n in pieces) <= 2
    assert len(bins) <= 1.02 * math.ceil(sum(n * c for n, c in counts.items()) / 2048) + 1


def test_packing_of_documents(spark, sf_dir, rows):
    found = best_fit_packing.op4_best_fit_packing(spark, sf_dir).collect()
    library = Tokenizer.from_file(best_fit_packing.VOCABULARY)
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    bins = collections.defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 2048 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in found) == sum(map(len, ids.values()))
    for pieces in bins.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(pieces)) and sum(pieces[-1]) <= 2048


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_moves_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    index = hilbert_sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(index)))
    assert (np.abs(np.diff(cells[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, sf_dir, rows):
    found = hilbert_sharding.op10_hilbert_sharding(spark, sf_dir).collect()
    texts = dict(rows)
    slots = collections.defaultdict(list)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_fingerprints(spark, sf_dir, rows):
    found = {r.doc_id: r for r in parsing_fingerprint.op3_parsing_fingerprint(spark, sf_dir).collect()}
    ordered = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(text) // 3
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
    near = [r.near_edited - r.near_next for r in found.values() if r.n_chars > 500]
    assert np.mean(near) > 0.5 and np.mean(np.array(near) > 0.2) > 0.97


def test_phrases_do_not_depend_on_the_offset(rows):
    body = max((t for _, t in rows), key=len).encode()[:6000]
    a, b = parsing_fingerprint.fingerprints([body, b"some other words before " + body])
    assert parsing_fingerprint.likeness(a[None], b[None])[0] > 0.9


def test_language_on_held_out_rows(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op6_crf_language_id(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert np.mean(right) > 0.95


def test_language_model(spark, sf_dir, rows):
    found = {r.doc_id: r for r in pitman_yor_lm.op7_pitman_yor_lm(spark, sf_dir).collect()}
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in words.items():
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score - r.base_score for r in found.values() if r.held_out) > 0


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(0, 1 << 62, 40, dtype=np.uint64))
    pairs = sorted({(int(w), int(u)) for w, u in zip(rng.integers(0, 40, 150), rng.integers(0, 5, 150), strict=True)} | {(w, 0) for w in range(40)})
    counts = rng.integers(1, 9, len(pairs))
    entries = np.bincount([w for w, _ in pairs], minlength=40)
    contexts = np.array([u for _, u in pairs])
    blob = pitman_yor_lm.blob
    bucket = pitman_yor_lm.Bucket(0, blob(words, "<u8"), blob(entries, "<u4"), blob(contexts, "<u2"), blob(counts, "<u4"))
    zeros = pitman_yor_lm.CONTEXTS
    shared = pitman_yor_lm.Shared(
        tokens=int(counts.sum()), words=40, customers=np.bincount(contexts, counts, minlength=zeros), tables=[np.bincount(contexts, minlength=zeros)],
        parent_customers=[float(len(pairs))], parent_tables=[40.0],
    )
    for sweep in (1, 2):
        *_, (tables, customers, parents) = bucket.states(shared, sweep)
        assert (tables >= 1).all() and (tables <= counts).all() and (parents >= 1).all() and (parents <= customers).all()
        shared.tables.append(np.bincount(contexts, tables, minlength=zeros))
        shared.parent_customers.append(float(customers.sum()))
        shared.parent_tables.append(float(parents.sum()))
    scorer = pitman_yor_lm.Scorer(bucket, shared, 2, 1)
    for u in (*range(5), 77):
        known = 10 ** scorer.of(words, np.ones(40, dtype=int), np.full(40, u))[2]
        unknown = 10 ** scorer.of(np.array([1], dtype=np.uint64), np.ones(1, dtype=int), np.array([u]))[2]
        assert known.sum() + unknown.sum() == pytest.approx(1)


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r.text for r in docs.collect()}
    told = steps["language_id"](spark, docs, sf_dir)
    kept = {r.doc_id for r in told.collect()}
    assert len(kept) > 0.97 * len(before)
    exact = {r.doc_id for r in steps["exact_dedup"](spark, docs, sf_dir).collect()}
    last = {}
    for i in sorted(before):
        last[(before[i] or "").encode().lower()] = i
    assert exact == set(last.values())
    near = {r.doc_id for r in steps["ngram_jaccard_join"](spark, docs, sf_dir).collect()}
    assert near == {i for i, (_, c) in components(before.items(), 5, 80, 100).items() if i == c}
    cut = {r.doc_id: r for r in steps["suffix_array_dedup"](spark, docs, sf_dir).collect()}
    for i, (size, gone, _, digest) in removal(before.items()).items():
        if gone == size and size:
            assert i not in cut
        elif gone:
            assert size - gone - len(cut[i].text.encode()) <= 3 * cut[i].text.count("") and cut[i].n_chars == len(cut[i].text)
        else:
            assert cut[i].text == before[i]
    packed = steps["best_fit_packing"](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_whole_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert found and all(r.offset + r.length <= 2048 for r in found)
