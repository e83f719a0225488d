"""Toxic passages by maximum-scoring segments.

Words and word beginnings get log-odds between toxic and clean labelled
documents under an informative Dirichlet prior (Monroe et al. 2008); those
that are significant count, negative ones too. A linear-time scan (Ruzzo and Tompa 1999) finds all maximal scoring segments of
a text; extreme-value statistics (Karlin and Altschul 1990) turn a segment's
score and the text's length into evidence, and a logistic curve turns the
evidence of all significant segments into a score between 0 and 1.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stage, texts_of

LABELLED = 100_000  # labelled documents that a model is fitted on, at most; those of the lowest hash are taken
PRIOR = 0.1  # weight of the prior, as a share of all counts; it draws rare features' log-odds to 0
MIN_Z = 2.5  # significance of a log-odds that counts, of either sign
MOST_ODDS = 20.0  # token scores are cut here in the extreme-value law's histogram
COST = 1.0  # what every token takes off a segment's score
MOST = 60.0  # evidence of a text is cut here; the curve is flat long before
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    """Everything that scoring needs: the significant features of at most LABELLED documents, which bound its size."""

    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0  # log of its K
    base: float = 0.0  # the curve: base + slope * evidence
    slope: float = 0.0


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class TokenScores(dict):
    """Score of a word, worked out when first asked for; forgets all when full.

    A word has its own log-odds if they are known, else those of its longest known beginning, else 0; every word costs COST.
    """

    def __init__(self, odds: dict[str, float], most: int = 100_000):
        super().__init__()
        self.odds, self.most = odds, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        own, *beginnings = features(word)
        self[word] = value = next((self.odds[f] for f in (own, *reversed(beginnings)) if f in self.odds), 0.0) - COST
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), left to right.

    Runs of tokens that score nothing only lower the running sum, so the scan
    visits positive tokens alone. Each candidate remembers the nearest one
    before it whose left sum is lower; following these links keeps it linear.
    """
    total = np.cumsum(scores)
    found: list[tuple] = []  # from, to, sum before, sum after, link
    for i in np.flatnonzero(scores > 0).tolist():
        after = float(total[i])
        begin, end, low, high = i, i + 1, after - float(scores[i]), after
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((begin, end, low, high, j))
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def token_scores(text: bytes, scores: TokenScores) -> np.ndarray:
    words = WORD.findall(text.decode().lower())
    return np.fromiter(map(scores.__getitem__, words), np.float64, len(words))


def passages(text: bytes, scores: TokenScores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens of the whole text, and its segments in tokens."""
    values = token_scores(text, scores)
    return len(values), segments(values) if len(values) and values.max() > 0 else []


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, toxic): labelled documents to learn from, none held out; a document labelled twice is toxic if one label says so."""
    rows = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _count(batches):
    """(feature, documents labelled 1, 0) per batch: a feature counts once per document."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[toxic == 1].update({f for w in set(WORD.findall(text.decode().lower())) for f in features(w)})
            if sum(map(len, counts)) > 500_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)


def _counted(counts) -> pa.RecordBatch:
    names = list(counts[0].keys() | counts[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))], ["feature", "t", "c"])


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model from at most `most` labelled documents (see LABELLED), whose labels are broadcast.

    Without labels of both kinds every text gets the base rate.
    """
    train = stage(training_rows(labels, most), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic")
    counts = stage(rows.mapInArrow(_count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "features")
    all_t, all_c = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if not all_t or not all_c:
        found = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
        return Model(base=math.log((found.get(1, 0) + 1) / (sum(found.values()) - found.get(1, 0) + 1)))
    prior = PRIOR * (all_t + all_c)
    a = (F.col("t") + F.col("c")) * F.lit(PRIOR)
    side = lambda n, every: F.log((F.col(n) + a) / (F.lit(every + prior) - F.col(n) - a))
    odds = counts.select("feature", (side("t", all_t) - side("c", all_c)).alias("odds"), F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a)).alias("sd"))
    strong = odds.filter(F.abs("odds") >= MIN_Z * F.col("sd"))
    model = Model(odds=dict(sorted((r[0], float(r[1])) for r in strong.select("feature", "odds").collect())))
    return _calibrated(rows, model)


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """Adds the extreme-value law and the curve, both from the training documents' segments."""

    def scan(batches):
        scores = TokenScores(model.odds)
        for batch in batches:
            values = [token_scores(t, scores) for t in texts_of(batch.column(0))]
            found = [[s for *_, s in segments(v)] for v in values]
            law = [np.unique(np.round(np.clip(v, -MOST_ODDS, MOST_ODDS) * 8) / 8, return_counts=True) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([len(v) for v in values], pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array([list(zip(v.tolist(), k.tolist(), strict=True)) for v, k in law], pa.map_(pa.float64(), pa.int64()))], ["toxic", "n", "s", "law"])

    seen = stage(rows.mapInArrow(scan, "toxic int, n long, s array<double>, law map<double, long>"), "segments")
    # how often each token score occurs in clean text, rounded to eighths: a bounded histogram
    clean = seen.filter("toxic != 1")
    tokens, documents = clean.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    law = {float(r[0]): float(r[1]) for r in clean.select(F.explode("law")).groupBy("key").agg(F.sum("value")).collect()}
    positive = [x for x in model.odds.values() if x > COST]
    typical = max(float(np.median(positive)) - COST if positive else 1.0, 0.5)
    law[typical] = law.get(typical, 0) + 0.5  # as if half a positive token more had been seen
    model.rate = _rate(np.array(list(law)), np.array(list(law.values())) / max(tokens, 1))
    evidence = lambda log_k: F.transform("s", lambda s: F.greatest(F.lit(0.0), s * model.rate - F.log(F.col("n")) - log_k))
    above = clean.select(F.size(F.filter(evidence(0.0), lambda x: x > 0)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    model.log_k = math.log(max(1e-3, min(1.0, (above + 1) / (documents + 1))))
    total = F.least(F.lit(MOST), F.aggregate(evidence(model.log_k), F.lit(0.0), lambda x, y: x + y))
    histogram = seen.select((F.col("toxic") == 1).alias("toxic"), F.round(total, 1).alias("x")).groupBy("toxic", "x").count().collect()
    model.base, model.slope = _curve(np.array([r["x"] for r in histogram]), np.array([r["toxic"] for r in histogram], float), np.array([r["count"] for r in histogram], float))
    return model


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p_s exp(lambda s) = 1 over one token of clean text."""
    rest = max(1e-9, 1 - shares.sum())
    excess = lambda x: math.log(rest * math.exp(-x * COST) + float((shares * np.exp(np.minimum(x * scores, 700))).sum()))
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on a histogram by Newton's steps, with Platt's softened targets."""
    ones, zeros = float((weight * y).sum()), float((weight * (1 - y)).sum())
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design, w = np.stack([np.ones_like(x), x], 1), np.array([0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (goal - p)) - 1e-3 * w
        curvature = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def judge(text: bytes, model: Model, scores: TokenScores) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text and its significant passages (from, to, evidence) in tokens."""
    n, found = passages(text, scores)
    real = [(a, b, e) for a, b, s in found if (e := s * model.rate - math.log(n) - model.log_k) > 0]
    total = min(MOST, sum(e for *_, e in real))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.base + model.slope * total)))), real


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The `keep` columns, `score`, and `passages` (from, to, evidence) of every whole text, without a shuffle.

    Null, empty and wordless texts have no passage and get the curve's start.
    Repeated rows stay; labels and other columns are not read.
    """
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("evidence", pa.float64())]))

    def run(batches):
        scores = TokenScores(shared.value.odds)
        for batch in slices(batches):
            found = [judge(t, shared.value, scores) for t in texts_of(batch.column(len(keep)))]
            spans = [[dict(zip(("from", "to", "evidence"), p, strict=True)) for p in g] for _, g in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([s for s, _ in found], pa.float64()), pa.array(spans, kind)], [*keep, "score", "passages"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, text).mapInArrow(run, f"{head}, score double, passages array<struct<`from`: int, `to`: int, evidence: double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        scores = TokenScores(shared.value.odds)
        for batch in slices(batches):
            yield batch.filter(pa.array([judge(t, shared.value, scores)[0] < threshold for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
