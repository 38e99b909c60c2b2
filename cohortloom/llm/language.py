"""Language of a text by a linear-chain conditional random field over its words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back, let_go

UNDETERMINED = "und"
#: Bounds of the training sample: whole documents of each language, none longer than this.
DOCS_PER_LANGUAGE, LONGEST_IN_SAMPLE = 250, 20_000
#: Features are hashed into tables of these sizes: pieces of words, and words of the lexicon.
PIECES, LEXICON = 1 << 15, 1 << 17
WIDTH = 24
SPAN, SEQUENCE, BATCH, STEPS, RATE = 20, 80, 48, 240, 0.08
WORDS_KEPT, WORDS_AT_ONCE, DOCS_AT_ONCE = 100_000, 250_000, 128
SEPARATORS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"})


def words_of(text: str) -> list[str]:
    """Lower-cased words without ASCII marks and digits; runs over ``WIDTH`` code points are cut."""
    words = text.translate(SEPARATORS).lower().split()
    if words and max(map(len, words)) > WIDTH:
        words = [w[i : i + WIDTH] for w in words for i in range(0, len(w), WIDTH)]
    return words


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def word_features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed piece features (affixes, two and three letters in a row) and the lexicon entry of each word.

    Cells without a feature hold ``PIECES``, which has no weight.
    """
    codes = np.array([f"\x02{w}\x03" for w in words], f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))[:, None] + 2
    place = np.arange(codes.shape[1])[None, :]

    def hashed(length: int, salt: int) -> np.ndarray:
        h = np.full((len(words), codes.shape[1] - length + 1), salt, np.uint64)
        for i in range(length):
            h = (h ^ codes[:, i : codes.shape[1] - length + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h >> np.uint64(20)).astype(np.int64) & (PIECES - 1)
        return np.where(place[:, : h.shape[1]] + length <= size, h, PIECES)

    twos, threes, fours = hashed(2, 1), hashed(3, 2), hashed(4, 3)
    end = np.maximum(size - 4, 0)
    affixes = np.concatenate((fours[:, :1], np.take_along_axis(fours, end, axis=1)), axis=1)
    whole = np.full(len(words), 7, np.uint64)
    for i in range(codes.shape[1]):
        whole = (whole ^ codes[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        whole ^= whole >> np.uint64(31)
    longest = int(size.max()) if len(words) else 2
    pieces = np.concatenate((twos[:, : longest - 1], threes[:, : max(longest - 2, 1)], affixes), axis=1)
    return pieces, (whole >> np.uint64(8)).astype(np.int64) & (LEXICON - 1)


@dataclass
class Model:
    """Weights of a fitted field: scores of pieces and words by label, of neighbouring labels, and of the first."""

    mark: str
    labels: list[str]
    pieces: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """Score of each label for each word: the sum of its features' weights."""
        parts = []
        for at in range(0, len(words), 8192):
            pieces, entry = word_features(words[at : at + 8192])
            parts.append(self.pieces[pieces].sum(axis=1) + self.lexicon[entry])
        return np.concatenate([*parts, np.zeros((0, len(self.labels)), np.float32)])


def forward_backward(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word of many sequences at once.

    ``emit`` (positive factors) is ordered by place and then by sequence, longest first;
    the words at place t are rows ``starts[t]`` to ``starts[t + 1]``.
    """
    ahead = np.empty_like(emit)
    starts = starts.tolist()
    steps = len(starts) - 1
    for t in range(steps):
        a, b = starts[t], starts[t + 1]
        now = emit[a:b] * (first if t == 0 else ahead[starts[t - 1] : starts[t - 1] + b - a] @ moves)
        ahead[a:b] = now / now.sum(axis=1, keepdims=True)
    behind = np.ones((0, emit.shape[1]), emit.dtype)
    for t in range(steps - 1, -1, -1):
        a, b = starts[t], starts[t + 1]
        if len(behind) < b - a:
            behind = np.concatenate((behind, np.ones((b - a - len(behind), emit.shape[1]), emit.dtype)))
        both = ahead[a:b] * behind
        ahead[a:b] = both / both.sum(axis=1, keepdims=True)
        behind = (emit[a:b] * behind) @ moves.T
        behind /= behind.sum(axis=1, keepdims=True)
    return ahead


def fit(texts: Sequence[str], langs: Sequence[str], seed: int = 1) -> Model:
    """Fit the field to texts of one language each, mixed into code-switched sequences.

    A training sequence strings spans of random documents together, ``SPAN`` words on average, so that
    transitions are learned too.  The gradient of the log likelihood is observed less expected
    counts, from forward-backward; Adagrad steps follow it.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded, by_label = [], [[] for _ in labels]
    for text, lang in zip(texts, langs, strict=True):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int64)
        if ids.size:
            by_label[labels.index(lang)].append(len(coded))
            coded.append(ids)
    n = len(labels)
    model = Model(uuid.uuid4().hex, labels, np.zeros((PIECES + 1, n), np.float32), np.zeros((LEXICON, n), np.float32), np.zeros((n, n)), np.zeros(n))
    if not coded or n < 2:
        model.moves, model.first = np.ones((n, n)), np.ones(n)
        return model
    pieces, entries = word_features(list(vocabulary))
    usable = [i for i in range(n) if by_label[i]]
    squares = {k: np.full_like(getattr(model, k), 1e-3) for k in ("pieces", "lexicon", "moves", "first")}

    def sequence() -> tuple[np.ndarray, np.ndarray]:
        ids, gold = [], []
        while sum(map(len, ids)) < SEQUENCE:
            label = usable[rng.integers(len(usable))]
            doc = coded[by_label[label][rng.integers(len(by_label[label]))]]
            size = min(len(doc), 1 + int(rng.exponential(SPAN)))
            at = rng.integers(len(doc) - size + 1)
            ids.append(doc[at : at + size])
            gold.append(np.full(size, label))
        return np.concatenate(ids)[:SEQUENCE], np.concatenate(gold)[:SEQUENCE]

    for _ in range(STEPS):
        ids, gold = (np.stack(x) for x in zip(*(sequence() for _ in range(BATCH)), strict=True))
        flat, truth = ids.T.ravel(), gold.T.ravel()
        score = model.pieces[pieces[flat]].sum(axis=1) + model.lexicon[entries[flat]]
        emit = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
        moves, first = np.exp(model.moves), np.exp(model.first)
        ahead = np.empty((SEQUENCE, BATCH, n))
        cube = emit.reshape(SEQUENCE, BATCH, n)
        for t in range(SEQUENCE):
            now = cube[t] * (first if t == 0 else ahead[t - 1] @ moves)
            ahead[t] = now / now.sum(axis=1, keepdims=True)
        behind, expected_moves = np.ones((BATCH, n)), np.zeros((n, n))
        posterior = np.empty_like(ahead)
        for t in range(SEQUENCE - 1, -1, -1):
            both = ahead[t] * behind
            posterior[t] = both / both.sum(axis=1, keepdims=True)
            if t:
                pair = ahead[t - 1][:, :, None] * moves[None] * (cube[t] * behind)[:, None, :]
                expected_moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                behind = (cube[t] * behind) @ moves.T
                behind /= behind.sum(axis=1, keepdims=True)
        error = (np.eye(n)[truth] - posterior.reshape(-1, n)).astype(np.float32)
        observed_moves = np.zeros((n, n))
        np.add.at(observed_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        where = pieces[flat]
        gradients = {
            "pieces": np.stack([np.bincount(where.ravel(), np.repeat(error[:, k], where.shape[1]), PIECES + 1) for k in range(n)], axis=1),
            "lexicon": np.stack([np.bincount(entries[flat], error[:, k], LEXICON) for k in range(n)], axis=1),
            "moves": observed_moves - expected_moves,
            "first": error[:BATCH].sum(axis=0),
        }
        gradients["pieces"][PIECES] = 0
        for k, g in gradients.items():
            g = (g / BATCH).astype(squares[k].dtype)
            squares[k] += g * g
            setattr(model, k, getattr(model, k) + RATE * g / np.sqrt(squares[k]))
    model.moves, model.first = np.exp(model.moves), np.exp(model.first)
    return model


def training_sample(docs: DataFrame, key: str, text: str, label: str, allowed: Column, per_language: int, longest: int) -> DataFrame:
    """``text`` and ``label`` of up to ``per_language`` documents of each language, chosen by a hash of the key."""
    order = Window.partitionBy(label).orderBy("_hash", key)
    chosen = (
        docs.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull() & (F.char_length(text) <= longest))
        .select(key, label, F.xxhash64(key).alias("_hash"))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= per_language)
        .select(key)
        .distinct()
    )
    rows = docs.where(F.col(label).isNotNull() & (F.char_length(text) <= longest))
    return rows.join(F.broadcast(chosen), key, "left_semi").select(text, label)


def detect(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or those of ``keep``) with ``lang_pred``, ``score`` and ``n_words`` of every row; columns of these names are replaced.

    Every word of the whole text gets a posterior over the labels; ``lang_pred`` is the label
    with the largest mean and ``score`` that mean.  A text that is null or has no letter is
    ``und`` with score 0, as is every text where no label could be learned.  Documents
    are followed in step, longest first, so a batch takes one pass over its places.  Only the text goes to
    Python; what a task has learned of words goes with the task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        model = held.value
        n = len(model.labels)
        moves, first = model.moves.astype(np.float32), model.first.astype(np.float32)
        if n:
            moves, first = moves / moves.sum(axis=1, keepdims=True), first / first.sum()
        kept = {"known": {}, "emit": np.ones((0, n), np.float32)}

        def encode(split: list[list[str]]) -> list[np.ndarray]:
            """Numbers of the words, under which ``kept["emit"]`` has their factors."""
            known = kept["known"]
            new = list(set().union(*split).difference(known))
            if new:
                score = model.scores(new)
                factors = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-6)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                kept["emit"] = np.concatenate((kept["emit"], factors))
            return [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in split]

        def posteriors(coded: list[np.ndarray], emit: np.ndarray) -> np.ndarray:
            """Mean posterior of each label for each sequence (all of at least one word)."""
            size = np.array([len(c) for c in coded])
            order = np.argsort(-size, kind="stable")
            size = size[order]
            at_place = np.searchsorted(-size, -np.arange(size[0]), "left")
            starts = np.concatenate(([0], np.cumsum(at_place))).astype(np.int32)
            ends = np.cumsum(size)
            to = starts[np.arange(ends[-1], dtype=np.int32) - np.repeat((ends - size).astype(np.int32), size)]
            to += np.repeat(np.arange(len(size), dtype=np.int32), size)
            rows = np.empty(len(to), np.int32)
            rows[to] = np.concatenate([coded[i] for i in order])
            found = forward_backward(emit[rows], moves, first, starts)
            sums = np.add.reduceat(found[to], ends - size, axis=0, dtype=np.float64)
            means = np.empty((len(size), n))
            means[order] = sums / size[:, None]
            return means

        for batch in batches:
            langs, score, count = [UNDETERMINED] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            at = 0
            while at < len(batch) and n:
                if len(kept["known"]) > WORDS_KEPT:
                    kept.update(known={}, emit=np.ones((0, n), np.float32))
                which, coded, total = [], [], 0
                while at < len(batch) and total < WORDS_AT_ONCE:
                    some = range(at, min(len(batch), at + DOCS_AT_ONCE))
                    split = [words_of(t) if t and has_letter(t) else [] for t in batch.slice(at, len(some)).to_pylist()]
                    which += [i for i, words in zip(some, split, strict=True) if words]
                    coded += encode([words for words in split if words])
                    total += sum(map(len, split))
                    at = some.stop
                if coded:
                    count[which] = [len(c) for c in coded]
                    means = posteriors(coded, kept["emit"])
                    score[which] = np.minimum(means.max(axis=1), 1.0)
                    for i, best in zip(which, means.argmax(axis=1).tolist(), strict=True):
                        langs[i] = model.labels[best]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(count)], ["lang_pred", "score", "n_words"])
        kept.clear()
        give_back()

    # Told not to be repeatable, so that no plan runs it twice.
    found = F.arrow_udf(label, "lang_pred string, score double, n_words long").asNondeterministic()
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "n_words")]
    return docs.select(*rest, found(F.col(text)).alias("_found_language")).select(*rest, "_found_language.*")


def learn(
    docs: DataFrame,
    allowed: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    per_language: int = DOCS_PER_LANGUAGE,
    longest: int = LONGEST_IN_SAMPLE,
) -> Model:
    """Fit to a bounded sample: ``per_language`` whole documents of each label, none over ``longest`` code points."""
    rows = training_sample(docs, key, text, label, allowed, per_language, longest).toPandas().sort_values([label, text])
    return fit(rows[text].tolist(), rows[label].tolist())


def allowed_to_learn(key: str = "doc_id") -> Column:
    """Rows whose key, as text, has a CRC-32 that is not 1 modulo 3; the others are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1
