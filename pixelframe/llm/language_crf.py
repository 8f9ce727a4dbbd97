"""Language identification of words by a linear-chain conditional random field.

A word's features are its byte n-grams (those that touch an end are its affixes) and its place in a lexicon of
words of the training sample. Weights and transitions between languages are learned together by stochastic
gradient on forward-backward marginals. Labelled texts hardly ever switch language, so training sequences join
pieces of texts of different languages; that is where transitions come from. A text's language is the one with
the largest expected number of words, its score that share.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.durable import durable
from pixelframe.llm.columns import packed, take, unpacked
from pixelframe.llm.wordhash import hash_runs, mixed
from pixelframe.llm.workers import map_slices, prepare, text_expression

UNDETERMINED = "und"
_WORD = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_GRAMS = (2, 3, 4)
_BUCKETS = 1 << 16
_AREA = 200_000  # padded words per forward-backward pass


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram of every word between end marks, word after word, and each word's first."""
    raw = [b"\x01" + w.encode() + b"\x02" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), sizes)
    buckets, owners = [], []
    code = data.copy()
    for n in range(2, max(_GRAMS) + 1):
        code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        whole = np.flatnonzero(word[: len(code)] == word[n - 1 :])
        buckets.append((mixed(code[whole] * np.uint64(8) + np.uint64(n)) % np.uint64(_BUCKETS)).astype(np.int32))
        owners.append(word[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(len(raw)))


def word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return hash_runs(np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), sizes)


@dataclass
class Model:
    """Languages in order, weights of n-gram buckets and lexicon words, and transitions. A few MB at most: the
    sizes are parameters times the number of languages."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray  # sorted hashes
    lexical: np.ndarray  # weights of lexicon words, with one row of zeros at the end
    moves: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        buckets, firsts = gram_features(words)
        scores = np.add.reduceat(self.grams[buckets], firsts, axis=0)
        return scores + self.lexical[self.entry(word_hashes(words))]

    def entry(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, hashes)
        known = at < len(self.lexicon)
        known[known] = self.lexicon[at[known]] == hashes[known]
        return np.where(known, at, len(self.lexicon))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For every text the probabilities of the languages, word by word."""
        ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        found = [np.zeros((0, len(self.langs)), np.float32)] * len(texts)
        if not ids:
            return found
        scores = self.emissions(list(ids))
        chances = np.exp(scores - scores.max(axis=1, keepdims=True))
        coded = [np.fromiter((ids[w] for w in t), np.int32, len(t)) for t in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        start = 0
        while start < len(order):
            stop = start + max(1, _AREA // len(texts[order[start]]))
            part = order[start:stop]
            padded = np.zeros((len(texts[part[0]]), len(part)), np.int32)
            for k, i in enumerate(part):
                padded[: len(coded[i]), k] = coded[i]
            lengths = np.array([len(coded[i]) for i in part])
            result = forward_backward(chances[padded], np.exp(self.moves), lengths)
            for k, i in enumerate(part):
                found[i] = result[: lengths[k], k]
            start = stop
        return found


def forward_backward(
    chances: np.ndarray, moves: np.ndarray, lengths: np.ndarray, pairs: np.ndarray | None = None
) -> np.ndarray:
    """Marginals of ``chances`` (step, sequence, label); sequences are sorted by falling length.

    The expected number of each transition is added to ``pairs`` if given.
    """
    steps = len(chances)
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than the step
    forward = np.zeros_like(chances)
    a = chances[0] / chances[0].sum(axis=1, keepdims=True)
    forward[0] = a
    for t in range(1, steps):
        n = active[t]
        a = (a[:n] @ moves) * chances[t, :n]
        a /= a.sum(axis=1, keepdims=True)
        forward[t, :n] = a
    b = np.ones(chances.shape[1:], chances.dtype)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = b[:n] * chances[t + 1, :n]
        if pairs is not None:
            both = forward[t, :n, :, None] * moves * ahead[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b[:n] = ahead @ moves.T
        b[:n] /= b[:n].sum(axis=1, keepdims=True)
        forward[t, :n] *= b[:n]
    total = forward.sum(axis=2, keepdims=True)
    return forward / np.where(total > 0, total, 1)


def _least(hashes: DataFrame, n: int) -> DataFrame:
    """The rows of ``hashes`` (``lang, h``, distinct) up to the bucket of leading 16 bits that holds the ``n``-th hash of a
    language, so that little is left to rank of a language that many texts have."""
    bucket = F.shiftrightunsigned("h", 47)
    counts = hashes.groupBy("lang", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")))
    last = upto.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("bucket"))), F.lit(1 << 16)).alias("last"))
    return hashes.join(durable(last), "lang").where(bucket <= F.col("last")).select("lang", "h")


def training_pieces(
    docs: DataFrame, learn: Column, texts_per_language: int, pieces: int, piece_words: int
) -> list[tuple[str, list[str]]]:
    """``(lang, words)`` pieces, evenly spread over at most ``texts_per_language`` texts of each language."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    hashes = _least(durable(usable.select("lang", "h").distinct()), texts_per_language)
    ranked = hashes.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    # a written table of known size: texts meet it where they are read, and only those chosen move
    wanted = durable(ranked.where(F.col("k") <= texts_per_language).select("lang", "h"))
    chosen = usable.join(wanted, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, out = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = words_of(text)
            starts = np.linspace(0, max(0, len(own) - piece_words), pieces).astype(int)
            for s in sorted(set(starts.tolist())) if own else ():
                langs.append(lang)
                out.append(own[s : s + piece_words])
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(out, pa.list_(pa.string()))], ["lang", "words"]
        )

    rows = map_slices(chosen, cut, "lang string, words array<string>", "text").collect()
    return sorted((r.lang, list(r.words)) for r in rows)


def fit(
    docs: DataFrame,
    learn: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_language: int = 300,
    pieces: int = 8,
    piece_words: int = 24,
    epochs: int = 4,
    seed: int = 7,
) -> Model:
    """Learn from the rows of ``docs`` for which ``learn`` holds and the language is known.

    At most ``texts_per_language`` different texts of each language (those with the smallest hashes) give ``pieces``
    pieces of ``piece_words`` words, so the sample on the driver is bounded whatever the size of ``docs``.
    Only texts and languages are used. Without labelled text the model knows no language.
    """
    learned = docs.where(learn)
    marked = take(learned, text=text_col, lang=lang_col).withColumn("learn", F.lit(True))
    sample = training_pieces(marked, F.col("learn"), texts_per_language, pieces, piece_words)
    langs = sorted({lang for lang, _ in sample})
    count, rng = len(langs), np.random.default_rng(seed)
    vocabulary = sorted({w for _, words in sample for w in words})
    if not vocabulary:
        return Model([], np.zeros((_BUCKETS, 0)), np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros((0, 0)))
    hashes = word_hashes(vocabulary)
    often = Counter(w for _, words in sample for w in words)
    lexicon = np.unique(hashes[[often[w] > 2 for w in vocabulary]])
    model = Model(
        langs,
        np.zeros((_BUCKETS, count), np.float32),
        lexicon,
        np.zeros((len(lexicon) + 1, count), np.float32),
        np.zeros((count, count), np.float32),
    )
    ids = {w: i for i, w in enumerate(vocabulary)}
    code = {lang: i for i, lang in enumerate(langs)}
    coded = [(code[lang], np.array([ids[w] for w in words])) for lang, words in sample]
    buckets, firsts = gram_features(vocabulary)
    spread = np.diff(np.append(firsts, len(buckets)))
    entries = model.entry(hashes)
    squares = [np.full_like(x, 1e-2) for x in (model.grams, model.lexical, model.moves)]
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), 256):
            batch = [sequence(coded, i, order, rng, piece_words) for i in order[at : at + 256]]
            _step(model, batch, buckets, firsts, spread, entries, squares)
    return model


def sequence(coded, i, order, rng, size) -> tuple[np.ndarray, np.ndarray]:
    """Words and labels of piece ``i``; half of the time it switches to another piece and perhaps back."""
    lang, own = coded[i]
    if rng.random() < 0.5:
        return own, np.full(len(own), lang)
    other_lang, other = coded[order[rng.integers(len(order))]]
    a, b = rng.integers(1, len(own) + 1), rng.integers(1, len(other) + 1)
    words = np.concatenate([own[:a], other[:b], own[a:]])
    labels = np.concatenate([np.full(a, lang), np.full(b, other_lang), np.full(len(own) - a, lang)])
    return words[: 2 * size], labels[: 2 * size]


def _step(model: Model, batch, buckets, firsts, spread, entries, squares, rate: float = 0.3) -> None:
    """One Adagrad step on the mean log-likelihood of ``batch``."""
    batch = sorted(batch, key=lambda s: -len(s[0]))
    lengths = np.array([len(w) for w, _ in batch])
    count = len(model.langs)
    used, inverse = np.unique(np.concatenate([w for w, _ in batch]), return_inverse=True)
    sizes = spread[used]
    ends = np.cumsum(sizes)
    features = buckets[np.repeat(firsts[used] - ends + sizes, sizes) + np.arange(ends[-1])]
    scores = np.add.reduceat(model.grams[features], ends - sizes, axis=0) + model.lexical[entries[used]]
    row, step = np.repeat(np.arange(len(batch)), lengths), np.concatenate([np.arange(n) for n in lengths])
    padded = np.zeros((lengths[0], len(batch)), np.int64)
    padded[step, row] = inverse
    labels = np.concatenate([y for _, y in batch])
    chances = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)[padded]
    moves = np.exp(model.moves.astype(np.float64))
    expected = np.zeros((count, count))
    seen = forward_backward(chances, moves, lengths, expected)[step, row]
    error = seen.copy()
    error[np.arange(len(labels)), labels] -= 1
    at_word = np.stack([np.bincount(inverse, error[:, k], len(used)) for k in range(count)], 1) / len(batch)
    spread_out = np.repeat(at_word, sizes, axis=0)
    on_grams = np.stack([np.bincount(features, spread_out[:, k], _BUCKETS) for k in range(count)], 1)
    on_words = np.stack(
        [np.bincount(entries[used], at_word[:, k], len(model.lexical)) for k in range(count)], 1
    )
    on_words[-1] = 0
    inner = step[1:] > 0
    wanted = np.zeros((count, count))
    np.add.at(wanted, (labels[:-1][inner], labels[1:][inner]), 1)
    on_moves = (expected - wanted) / len(batch)
    for weights, grad, square in zip((model.grams, model.lexical, model.moves), (on_grams, on_words, on_moves), squares):
        grad = grad + 1e-6 * weights
        square += grad**2
        weights -= rate * grad / np.sqrt(square)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, lang_pred, score, shares, spans``, one row per input row.

    ``shares`` has the expected part of the words in each language, ``spans`` the runs of words with one most
    probable language (``lang, n_words``). A null text, or one without letters, is ``und`` with score 0, as is
    every text if the model knows no language; of equal shares the language first in order wins.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
        langs, scores, shares, spans = [], [], [], []
        for chances in model.marginals(texts) if model.langs else [()] * len(texts):
            share = np.sum(chances, axis=0, dtype=np.float64) / len(chances) if len(chances) else None
            best = None if share is None else int(share.argmax())
            langs.append(UNDETERMINED if best is None else model.langs[best])
            scores.append(0.0 if best is None else min(1.0, float(share[best])))
            shares.append([] if best is None else list(zip(model.langs, share.tolist())))
            spans.append([] if best is None else _runs(model.langs, chances.argmax(axis=1)))
        share_type, span_type = pa.map_(pa.string(), pa.float64()), pa.struct(
            [("lang", pa.string()), ("n_words", pa.int32())]
        )
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array(langs, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(shares, share_type),
                pa.array(spans, pa.list_(span_type)),
            ],
            ["doc_id", "n_words", "lang_pred", "score", "shares", "spans"],
        )

    chosen = take(docs, doc_id=id_col, text=text_col)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words bigint, lang_pred string, score double, "
        "shares map<string, double>, spans array<struct<lang: string, n_words: int>>"
    )
    return map_slices(chosen, run, schema, "text")


def _runs(langs: list[str], best: np.ndarray) -> list[dict]:
    starts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    sizes = np.diff(np.append(starts, len(best)))
    return [{"lang": langs[k], "n_words": n} for k, n in zip(best[starts].tolist(), sizes.tolist())]


def keep_known(
    docs: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language with at least ``min_score``.

    Texts without letters go, and texts so mixed that no language has a fair share of the words.
    """
    prepare(docs.sparkSession)

    def best(text: pa.Array) -> pa.Array:
        words = [words_of(t) if t else [] for t in text.to_pylist()]
        found = model.marginals(words) if model.langs else [()] * len(words)
        return pa.array([float(np.max(np.mean(c, axis=0, dtype=np.float64))) if len(c) else -1.0 for c in found], pa.float64())

    score = text_expression(best, "double")
    whole = packed(docs, text=text_col)
    return unpacked(whole.where(score(F.col("text")) >= min_score), docs.columns)
