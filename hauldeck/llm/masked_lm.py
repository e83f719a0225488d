"""Masked pseudo-likelihood: a small network predicts every word from the words on both sides.

The vocabulary comes from word counts of the whole corpus: the most frequent
words have an id of their own, all others share hashed ids, and each has the
part of its id's probability that it has of the id's words in the corpus. The network
(embeddings of two words on each side, one tanh layer, a two-level softmax of
CLASSES x CLASSES) is trained in numpy on every word of the corpus: each task
runs over its own documents from the same start, and Spark averages the
parameters by the words they have seen. A text's score is the sum of the log
probabilities of its words, each given its neighbours. The counts of the LISTED
next frequent words (no more, and none where equal ones would not fit) are broadcast; those of all others stay distributed and
meet a text's rare words in a join by word.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks
from .shared import free_name, stage

CLASSES = 32
SIZE = CLASSES * CLASSES  # ids of the softmax; SIZE itself is the padding at a text's ends
OWN = SIZE // 2  # most frequent words with an id of their own
LISTED = 100_000  # words after these whose counts every task has
SIDE, EMBEDDING, HIDDEN = 2, 8, 16
BATCH, RATE, ROUNDS = 16384, 0.2, 1
LIMIT = 60.0
BLOCK_BYTES = 4 << 20

SHAPES = {"e": (SIZE + 1, EMBEDDING), "w": (2 * SIDE * EMBEDDING, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (CLASSES, HIDDEN, CLASSES), "ob": (CLASSES, CLASSES)}


@dataclass
class Model:
    """Vocabulary and parameters, of a fixed size; `counts` (word, n) has all words of the corpus, `seen` how often each hashed id's words occur, `listed` the counts of some.

    Without counts the score of a word without an id of its own is that of its hashed id.
    """

    ids: dict[bytes, int]
    p: dict[str, np.ndarray]
    counts: DataFrame | None = None
    seen: np.ndarray | None = None
    listed: dict[bytes, int] | None = None


def start(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"e": 0.1, "w": 1 / np.sqrt(2 * SIDE * EMBEDDING), "c": 0.1, "o": 0.1}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = values[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def id_of(word: bytes, ids: dict[bytes, int]) -> int:
    found = ids.get(word)
    return OWN + zlib.crc32(word) % (SIZE - OWN) if found is None else found


def split_words(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
    """Words (A-Z lower-cased, between ASCII white space) of all texts, and where each text's words begin and end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(texts)))
    words, ends = parts.values, parts.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]


def windows(texts: pa.StringArray, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target ids, ids of the SIDE words before and after each, text bounds); the padding stands beyond a text's ends."""
    return _windows(*split_words(texts), ids)[:3]


def _windows(words: pa.Array, bounds: np.ndarray, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The same, and the words themselves."""
    coded = words.dictionary_encode()
    table = np.array([id_of(w, ids) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0], np.int64)
    target = table[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    around = np.full((len(target), 2 * SIDE), SIZE, np.int64)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), len(target) - max(0, d)
        if b > a:
            same = text[a:b] == text[a + d : b + d]
            around[a:b, k] = np.where(same, target[a + d : b + d], SIZE)
    return target, around, bounds, coded


def rare_words(rare: np.ndarray, bounds: np.ndarray, coded: pa.DictionaryArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, word, how often) of the words at these places, once per text and word."""
    n = max(1, len(coded.dictionary))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair, times = np.unique(text[rare] * n + coded.indices.to_numpy()[rare], return_counts=True)
    return pair // n, coded.dictionary.cast(pa.binary()).take(pa.array(pair % n)), times


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, log of the normaliser); logits are cut at +-LIMIT. Works in place."""
    np.clip(x, -LIMIT, LIMIT, out=x)
    e = np.exp(x)
    s = e.sum(1)
    e /= s[:, None]
    return e, np.log(s)


def forward(p: dict, target: np.ndarray, around: np.ndarray, step: float = 0.0, seen: dict | None = None) -> np.ndarray:
    """Log probability of each target; with `seen` (sums of squared gradients) also one Adagrad step on p.

    The words are sorted by their class first, so each class's inner softmax works on one slice.
    """
    n = len(target)
    group = target % CLASSES
    order = np.argsort(group, kind="stable")
    group, member, around, rows = group[order], (target // CLASSES)[order], around[order], np.arange(n)
    cuts = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    x = p["e"][around].reshape(n, -1)
    h = x @ p["w"]
    h += p["b"]
    np.tanh(h, out=h)
    logits = h @ p["c"]
    logits += p["cb"]
    prob, norm = _softmax(logits)
    score = logits[rows, group] - norm
    train = seen is not None
    if train:
        prob[rows, group] -= 1
        grads = {k: np.zeros_like(v) for k, v in p.items() if k in ("e", "o", "ob")}
        grads["c"], grads["cb"] = h.T @ prob, prob.sum(0)
        dh = prob @ p["c"].T
    for g in range(CLASSES):
        a, b = cuts[g], cuts[g + 1]
        if a == b:
            continue
        inner = h[a:b] @ p["o"][g]
        inner += p["ob"][g]
        q, inner_norm = _softmax(inner)
        mine = rows[: b - a]
        score[a:b] += inner[mine, member[a:b]] - inner_norm
        if train:
            q[mine, member[a:b]] -= 1
            grads["o"][g], grads["ob"][g] = h[a:b].T @ q, q.sum(0)
            dh[a:b] += q @ p["o"][g].T
    if train:
        dh *= 1 - h * h
        grads["w"], grads["b"] = x.T @ dh, dh.sum(0)
        dx = (dh @ p["w"].T).reshape(n * 2 * SIDE, EMBEDDING)
        ids = around.ravel()
        for d in range(EMBEDDING):
            grads["e"][:, d] = np.bincount(ids, dx[:, d], SIZE + 1)
        for k in p:
            grad = grads[k] / n
            seen[k] += grad * grad
            p[k] -= step * grad / (np.sqrt(seen[k]) + 1e-9)
    out = np.empty(n, score.dtype)
    out[order] = score
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents, stored."""

    def count(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES * 4):
                found = pc.value_counts(split_words(texts.slice(a, b - a))[0])
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], ["word", "n"])

    return stage(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> tuple[dict[bytes, int], np.ndarray, dict[bytes, int]]:
    """Ids of the OWN most frequent words, equally frequent ones in byte order, how often the words of each hashed id occur, and the counts of up to LISTED next words."""
    top = {bytes(w): n for w, n in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()}
    # the least count that at most OWN + LISTED words reach: only these words go to the driver, not the first of every partition
    least, words = None, 0
    for n, w in sorted(counts.groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        words += w
        if words > OWN + LISTED:
            break
        least = n
    listed = {} if least is None else {bytes(w): n for w, n in counts.filter(F.col("n") >= least).collect() if bytes(w) not in top}
    ids, seen = {w: i for i, w in enumerate(top)}, np.zeros(SIZE, np.int64)
    hashed = F.lit(OWN) + F.crc32("word") % (SIZE - OWN)
    for i, n in counts.groupBy(hashed).agg(F.sum("n")).collect():  # a row per hashed id, whatever the corpus
        seen[i] = n
    for w, n in top.items():
        seen[id_of(w, {})] -= n
    return ids, seen, listed


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of all words of all documents. Without words it is the untrained start."""
    counts = word_counts(docs)
    (ids, seen_words, listed), p = vocabulary(counts), start()
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((ids, p))

        def learn(batches):
            ids, first = shared.value
            own, seen, words = {k: v.copy() for k, v in first.items()}, {k: np.full(s, 1e-8, np.float32) for k, s in SHAPES.items()}, 0
            for batch in batches:
                texts = pc.fill_null(batch.column(0), "")
                for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                    target, around, _ = windows(texts.slice(a, b - a), ids)
                    for i in range(0, len(target), BATCH):
                        forward(own, target[i : i + BATCH], around[i : i + BATCH], RATE, seen)
                    words += len(target)
            if words:
                values = flat(own).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * words), pa.array(np.full(len(values), words))], ["k", "v", "n"])

        sums = docs.select("text").mapInArrow(learn, "k int, v double, n long").groupBy("k").agg((F.sum("v") / F.sum("n")).alias("v"))
        found = sums.collect()  # one row per parameter, whatever the corpus
        if found:
            values = np.zeros(len(found))
            for k, v in found:
                values[k] = v
            p = shaped(values)
        shared.unpersist()
    return Model(ids, p, counts, seen_words, listed)


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, n_tokens, log_likelihood (sum over all words given both sides) and its mean per word.

    Null, empty and wordless texts have 0 words, sum 0 and a null mean. Repeated rows stay. A word that the
    corpus of the model does not have counts as if it were there once.
    """
    keep = list(keep)
    if model.counts is None:
        found = _id_scores(docs, model, keep)
        sums = found.select(*keep, "n_tokens", "log_likelihood")
    else:
        row, word, times, n = (free_name(c, keep) for c in ("_row", "_word", "_times", "_n"))
        emitted = _id_scores(docs, model, keep, (row, word, times))
        often = model.counts.filter("n > 1").select(F.col("word").alias(word), F.log("n").alias(n))  # a word that is there once adds nothing
        both = emitted.join(often, word, "left").groupBy(row)
        first = lambda c: F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c)
        summed = both.agg(*(first(c) for c in keep), first("n_tokens"), first("log_likelihood"), F.sum(F.col(times) * F.coalesce(n, F.lit(0.0))).alias(n))
        sums = summed.select(*keep, "n_tokens", (F.col("log_likelihood") + F.col(n)).alias("log_likelihood"))
    return sums.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def _id_scores(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] | None = None) -> DataFrame:
    """The `keep` columns, n_tokens and log_likelihood by ids, a word's part of its hashed id taken as 1 / (how often the id's words occur).

    With names (row, word, times) the counts of listed words are in the score, and each text's other rare words follow as rows of their own, without the other columns.
    The row of the text itself has a word that no text has.
    """
    share = np.zeros(SIZE)
    if names:
        share[OWN:] = -np.log(np.maximum(model.seen[OWN:], 1))
    listed = {w: math.log(n) for w, n in model.listed.items()} if names else {}
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.p, share, listed))

    def run(batches):
        (ids, p, share, listed), row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            for a, b in blocks(pc.binary_length(texts).to_pylist(), BLOCK_BYTES):
                target, around, bounds, coded = _windows(*split_words(texts.slice(a, b - a)), ids)
                scores = np.concatenate([np.zeros(1), *(forward(p, target[i : i + BATCH], around[i : i + BATCH]).astype(np.float64) for i in range(0, len(target), BATCH))])
                scores[1:] += share[target]
                if names:
                    often = np.array([listed.get(w, -1.0) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0.0])[coded.indices.to_numpy()] if len(target) else np.empty(0)
                    scores[1:] += np.maximum(often, 0)
                columns = [*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(np.diff(bounds)), pa.array(np.diff(np.cumsum(scores)[bounds]))]
                if names:
                    rows = row + np.arange(b - a)
                    text, words, times = rare_words(np.flatnonzero((target >= OWN) & (often < 0)), bounds, coded)
                    own = pa.array([b"\xff" + r.to_bytes(8, "big") for r in rows.tolist()], pa.binary())  # no UTF-8 text has this byte
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(rows), own, pa.array(np.zeros(b - a, np.int64))], [*head, *names])
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(text), c.type) for c in columns), pa.array(rows[text]), words, pa.array(times)], [*head, *names])
                    row += b - a
                else:
                    yield pa.RecordBatch.from_arrays(columns, head)

    head = [*keep, "n_tokens", "log_likelihood"]
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", n_tokens long, log_likelihood double"
    if names:
        fields += ", `{}` long, `{}` binary, `{}` long".format(*names)
    return docs.select(*keep, "text").mapInArrow(run, fields)


def train_and_score(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))

