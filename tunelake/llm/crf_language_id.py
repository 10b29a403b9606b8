"""Language identification by a linear-chain conditional random field over words.

Every word has a score for each language: the weights of its letter n-grams (those at its
borders are its affixes) and of the word itself (the lexicon), hashed into a table of fixed
size. Learned transitions tie neighbouring words together, and forward-backward gives the
probability of each language for each word of code-switched text. A document takes the
language with the largest expected share of its words; that share is the score.

Training takes at most SAMPLE_DOCS labelled documents per language and SEGMENTS pieces of
each. Sequences of two documents spliced together teach the transitions what a switch looks
like. Weights and transitions follow the exact gradient of the conditional likelihood.

A sequence has at most SPAN words; longer texts are a row of sequences, none is left out.
Texts that are null or have no letter are `und` with score 0, and so is every text if no row
has a label. Repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.common import CACHE_WORDS, documents, id_remainder, slices_by_bytes, text_bytes

SPAN = 64
SAMPLE_DOCS = 300
SEGMENTS = 8
MOST_BYTES = 64  # of a word in training; a bound on what the driver gets
FEATURE_BITS = 18
GRAMS = (2, 3, 4)
ROUNDS = 40
UNDETERMINED = "und"
BATCH_BYTES = 2 << 20

_NO_LETTERS = (string.punctuation + string.digits + "".join(map(chr, range(32))) + "\x7f").encode()


def letters_of(word: bytes) -> bytes:
    """The word in lower case without marks and digits; empty if it has no letter."""
    kept = word.translate(None, _NO_LETTERS).lower()
    if kept.isascii():
        return kept
    text = kept.decode().lower()
    return text.encode() if any(c.isalpha() for c in text) else b""


def features(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and how many each word has."""
    marked = [b"^" + w + b"$" for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    found, owners = [], []
    key = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        key[: len(key) - n + 1] = key[: len(key) - n + 1] * np.uint64(257) + codes[n - 1 :]
        if n in GRAMS:
            ok = at + n <= ends
            found.append(key[ok] * np.uint64(8) + np.uint64(n))
            owners.append(owner[ok])
    found.append(np.array([xxhash.xxh3_64_intdigest(w) | 7 for w in words], dtype=np.uint64))
    owners.append(np.arange(len(words)))
    numbers = (np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return numbers[order].astype(np.int64), np.bincount(owners, minlength=len(words))


def segment_sums(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, `counts` of them each (every count is positive)."""
    return np.add.reduceat(rows, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)


def forward_backward(scores: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of sequences (time x sequence x label), and both messages.

    `real` marks the words of each sequence; they come first. `moves` are the exponentiated transitions.
    """
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    ahead, back = np.empty_like(local), np.ones_like(local)
    ahead[0] = local[0]
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for t in range(1, len(local)):
        step = (ahead[t - 1] @ moves) * local[t]
        ahead[t] = step / step.sum(axis=1, keepdims=True)
    for t in range(len(local) - 2, -1, -1):
        step = (local[t + 1] * back[t + 1]) @ moves.T
        step /= step.sum(axis=1, keepdims=True)
        back[t] = np.where(real[t + 1][:, None], step, 1.0)
    both = ahead * back
    return both / both.sum(axis=2, keepdims=True), ahead, local * back


@dataclass
class Model:
    """What is learned: labels, feature weights, transition scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, words: Sequence[bytes]) -> np.ndarray:
        numbers, counts = features(words)
        return segment_sums(self.weights[numbers], counts)


def train(segments: list[tuple[str, list[bytes]]], rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fits a model to labelled pieces of text."""
    labels = sorted({lang for lang, _ in segments})
    label = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(segments))
    sequences = []
    for i, j in zip(order, np.roll(order, 1), strict=True):
        (a, first), (b, second) = segments[i], segments[j]
        cut = int(rng.integers(1, SPAN)) if rng.random() < 0.5 else SPAN
        words = first[:cut] + second[: SPAN - cut]
        tags = [label[a]] * len(first[:cut]) + [label[b]] * len(second[: SPAN - cut])
        sequences.append((words[:SPAN], tags[:SPAN]))
    vocabulary = sorted({w for words, _ in sequences for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids, tags = np.zeros((SPAN, len(sequences)), dtype=np.int64), np.zeros((SPAN, len(sequences)), dtype=np.int64)
    real = np.zeros((SPAN, len(sequences)), dtype=bool)
    for s, (words, own) in enumerate(sequences):
        ids[: len(words), s], tags[: len(words), s] = [number[w] for w in words], own
        real[: len(words), s] = True
    numbers, counts = features(vocabulary)
    lettered = np.array([bool(w) for w in vocabulary])
    size, n = len(labels), len(vocabulary)
    weights = np.zeros((1 << FEATURE_BITS, size))
    transitions = np.zeros((size, size))
    square_w, square_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    seen = real & lettered[ids]
    owner = np.repeat(np.arange(n), counts)
    pair = real[1:] & real[:-1]
    moved = np.bincount((tags[:-1] * size + tags[1:])[pair], minlength=size * size).reshape(size, size)
    for _ in range(rounds):
        per_word = segment_sums(weights[numbers], counts) * lettered[:, None]
        scores = per_word[ids] * real[:, :, None]
        moves = np.exp(transitions)
        marginal, ahead, behind = forward_backward(scores, real, moves)
        miss = -marginal
        np.put_along_axis(miss, tags[:, :, None], np.take_along_axis(miss, tags[:, :, None], 2) + 1, 2)
        by_word = np.stack([np.bincount(ids[seen], miss[:, :, k][seen], minlength=n) for k in range(size)], axis=1)
        grad = np.stack([np.bincount(numbers, by_word[owner, k], minlength=1 << FEATURE_BITS) for k in range(size)], axis=1) - 0.05 * weights
        left, right = ahead[:-1][pair], behind[1:][pair]
        mass = ((left @ moves) * right).sum(axis=1, keepdims=True)
        turn = moved - moves * ((left / mass).T @ right) - 0.05 * transitions
        square_w += grad**2
        square_t += turn**2
        weights += 0.3 * grad / np.sqrt(square_w)
        transitions += 0.3 * turn / np.sqrt(square_t)
    return Model(labels, weights.astype(np.float32), transitions.astype(np.float32))


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def training_segments(docs: DataFrame) -> list[tuple[str, list[bytes]]]:
    """Pieces of at most SAMPLE_DOCS documents per language, those with the smallest hashed ids."""
    labelled = docs.filter("lang IS NOT NULL").select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.withColumn("_rank", rank).filter(F.col("_rank") <= SAMPLE_DOCS).select("doc_id", "lang")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), text_bytes(batch), strict=True):
                words = [w for w in map(letters_of, words_of(text)) if len(w) <= MOST_BYTES]
                starts = np.arange(0, len(words), SPAN)
                if len(starts) > SEGMENTS:
                    starts = np.sort(np.random.default_rng(abs(doc_id)).choice(starts, SEGMENTS, replace=False))
                out += [(lang, b" ".join(w or b"0" for w in words[s : s + SPAN])) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "words"])

    found = rows.mapInArrow(cut, "lang string, words binary").collect()
    return sorted((r["lang"], [b"" if w == b"0" else w for w in bytes(r["words"]).split()]) for r in found)


class Scorer:
    """Scores of words, remembered while they fit, and the predictions of whole texts."""

    def __init__(self, model: Model):
        self.model, self.moves = model, np.exp(model.transitions)
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.model.labels)), dtype=np.float32)
        self.lettered = np.zeros(0, dtype=bool)

    def learn(self, words: set[bytes]) -> None:
        if len(self.row) + len(words) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.row]
        if new:
            plain = [letters_of(w) for w in new]
            lettered = np.array([bool(w) for w in plain])
            start = len(self.row)
            self.row.update(zip(new, range(start, start + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.scores(plain) * lettered[:, None]]).astype(np.float32)
            self.lettered = np.concatenate([self.lettered, lettered])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        size = len(self.model.labels)
        split = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        if not size or not lengths.sum():
            return [(UNDETERMINED, 0.0)] * len(texts)
        self.learn({w for words in split for w in words})
        ids = np.fromiter((self.row[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
        spans = -(-lengths // SPAN)
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat((np.cumsum(spans) - spans) * SPAN, lengths)
        time, sequence = place % SPAN, place // SPAN
        scores = np.zeros((SPAN, int(spans.sum()), size), dtype=np.float32)
        real = np.zeros(scores.shape[:2], dtype=bool)
        scores[time, sequence], real[time, sequence] = self.table[ids], True
        marginal = forward_backward(scores, real, self.moves)[0][time, sequence]
        seen = self.lettered[ids]
        share = np.stack([np.bincount(doc[seen], marginal[seen, k], minlength=len(texts)) for k in range(size)], axis=1)
        words = np.bincount(doc[seen], minlength=len(texts))
        best = share.argmax(axis=1)
        score = np.clip(share[np.arange(len(texts)), best] / np.maximum(words, 1), 0.0, 1.0)
        return [(self.model.labels[b], float(s)) if n else (UNDETERMINED, 0.0) for b, s, n in zip(best, score, words, strict=True)]


def with_language(docs: DataFrame, training: DataFrame) -> DataFrame:
    """`docs` with `lang_pred` and `score`, learned from the labelled rows of `training`."""
    segments = training_segments(training)
    model = train(segments) if segments else Model([], np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    frame = docs.toDF(*plain)
    at = plain[docs.columns.index("text")]

    def predict(batches):
        scorer = Scorer(model)
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            found = scorer.predict(text_bytes(batch, at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*plain, "_lang", "_score"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields) + ", _lang string, _score double"
    return frame.mapInArrow(predict, schema).toDF(*docs.columns, "lang_pred", "score")


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    found = with_language(rows, docs.filter(id_remainder(4) != 2))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op6_crf_language_id": op6_crf_language_id}


def oracle_sql() -> dict[str, str]:
    return {}
