"""Operator 1, quality: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are its own shape, the shape of the lines before and
after it, and whether it repeats in the document; the chain adds a weight for each pair of
neighbouring labels. Forward-backward gives each line's probability of being good, and a
document's score is their mean weighted by line length.

Training: at most SAMPLE_DOCS labelled documents (those first by a hash of doc_id, so the sample
does not depend on the input's order), whole ones in that order until SAMPLE_LINES lines are
reached; every line takes its document's label. Of a document of more than LONGEST lines there
are WINDOWS stretches from its first line to its last. Line features are computed on executors;
the bounded sample, less than (SAMPLE_LINES + LONGEST) x FEATURES floats, is fitted on the driver
by gradient ascent on the conditional likelihood. Scoring reads every line of every text.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SAMPLE_DOCS = 2_000
SAMPLE_LINES = 64_000
LONGEST, WINDOWS = 8_000, 8
ROUNDS = 200
THRESHOLD = 0.3

#: Short function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it with as was on be at by this are or an from "
    "der die das und in zu den ist von mit des auf für im nicht ein eine dem sich als auch "
    "le la les de des et en un une du que qui dans pour est sur par au aux pas avec "
    "el los las del y se por con para no lo su al más como".split()
)
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = bytes(range(48, 58))
_ODD = b"!#$%&*+/<=>@[\\]^_`{|}~"
_PAUSES = b".,;:?'\"()-"
OWN = 16
FEATURES = 3 * OWN + 4


def _shape(line: str) -> list[float]:
    data = line.encode("utf-8", "surrogatepass")
    size = len(data) or 1
    left = lambda chars: (size - len(data.translate(None, chars))) / size if data else 0.0
    words = line.split()
    n = len(words) or 1
    lower = line.lower().split()
    letters, odd = left(_LETTERS), left(_ODD)
    kinds = len(set(words)) / n
    repeats = sum(map(eq, words, words[1:])) / n
    return [
        1.0,
        np.log1p(len(data)) / 5.0,
        np.log1p(len(words)) / 4.0,
        letters,
        left(_UPPER) / max(letters, 0.05),
        left(_DIGITS),
        min(1.0, 8 * odd),
        min(1.0, 100 * odd),
        left(_PAUSES) * 8,
        kinds if len(words) > 1 else 1.0,
        repeats,
        min(1.0, 4 * repeats),
        sum(w in STOP_WORDS for w in lower) / n,
        min(2.0, len(line) / n / 8),
        float(line.rstrip()[-1:] in {".", "!", "?", ":", '"', "»", "”"}),
        float(max(map(len, words), default=0) > 40),
    ]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (a row per line) and weights (characters) of the lines that are not blank.

    A text without such lines is one empty line.
    """
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    shape = {x: _shape(x) for x in seen}
    own = np.array([shape[x] for x in lines])
    out = np.zeros((len(lines), FEATURES))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, 3 * OWN] = out[-1, 3 * OWN + 1] = 1.0
    out[:, 3 * OWN + 2] = [min(1.0, (seen[x] - 1) / 3) for x in lines]
    out[:, 3 * OWN + 3] = min(1.0, np.log1p(len(lines)) / 5)
    return out, np.array([len(x) + 1.0 for x in lines])


def training_features(text: str) -> np.ndarray:
    """The text's line features; of more than LONGEST lines evenly spread stretches, each line with its true neighbours."""
    x = line_features(text)[0]
    if len(x) <= LONGEST:
        return x
    size = LONGEST // WINDOWS
    return np.concatenate([x[a : a + size] for a in np.linspace(0, len(x) - size, WINDOWS).astype(int)])


def _forward_backward(unary: np.ndarray, pairs: np.ndarray, mask: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label good, pair marginals and log normalisers of padded chains (documents x lines).

    unary: score of good over bad, per line. pairs: 2 x 2 scores of neighbouring labels. share:
    what a document's pair marginals count for in their sum (1).
    """
    docs, length = unary.shape
    node = np.stack([np.zeros_like(unary), unary], -1)
    forward = np.zeros((docs, length, 2))
    backward = np.zeros((docs, length, 2))
    forward[:, 0] = node[:, 0]
    for t in range(1, length):
        step = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + node[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = backward[:, t + 1] + node[:, t + 1]
        step = np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1])
        backward[:, t] = np.where(mask[:, t + 1, None], step, backward[:, t + 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    good = np.exp(np.clip(forward[..., 1] + backward[..., 1] - total[:, None], -50, 0)) * mask
    joint = np.zeros((2, 2))
    for t in range(1, length):
        p = forward[:, t - 1, :, None] + pairs[None] + (backward[:, t] + node[:, t])[:, None, :] - total[:, None, None]
        joint += (np.exp(np.clip(p, -50, 0)) * (mask[:, t] if share is None else mask[:, t] * share)[:, None, None]).sum(0)
    return good, joint, total


def _padded(documents: list[np.ndarray], labels: list[int]) -> list[tuple]:
    """Documents of like length together: features of all lines, mask, labels and shares of the lines, labels and lines of the documents."""
    n, lines, label = len(documents), np.array([len(d) for d in documents]), np.array(labels)
    alike: dict[int, list[int]] = {}
    for i, m in enumerate(lines.tolist()):
        alike.setdefault(m.bit_length() // 2, []).append(i)
    out = []
    for own in alike.values():
        mask = np.arange(lines[own].max()) < lines[own][:, None]
        share = 1.0 / (lines[own] * n)  # a document counts once, however many lines it has
        out.append((np.concatenate([documents[i] for i in own]), mask, np.repeat(label[own], lines[own]), share, label[own], lines[own]))
    return out


def _gradient(batch: list[tuple], w: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean over documents of log p(labels | lines) / lines, by the line and the pair weights."""
    slope, pair_slope = np.zeros(len(w)), np.zeros((2, 2))
    for x, mask, y, share, label, lines in batch:
        unary = np.zeros(mask.shape)
        unary[mask] = x @ w
        good, joint, _ = _forward_backward(unary, pairs, mask, share)
        slope += ((y - good[mask]) * np.repeat(share, lines)) @ x
        steps = share * (lines - 1)
        pair_slope += np.diag([steps[label == 0].sum(), steps[label == 1].sum()]) - joint
    return slope, pair_slope


class LineChain:
    """The fitted field: line weights (good over bad) and 2 x 2 pair weights."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def fit(cls, documents: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, ridge: float = 5e-4, rate: float = 0.08) -> LineChain:
        """Adam on the ridge-penalised conditional log-likelihood, a document's divided by its lines; no documents give weights of 0."""
        w, pairs = np.zeros(FEATURES), np.zeros((2, 2))
        if not documents:
            return cls(w, pairs)
        batch = _padded(documents, labels)
        first, second = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for k in range(1, rounds + 1):
            slope, pair_slope = _gradient(batch, w, pairs)
            theta = np.concatenate([slope - ridge * w, (pair_slope - ridge * pairs).ravel()])
            first, second = 0.9 * first + 0.1 * theta, 0.999 * second + 0.001 * theta**2
            move = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
            w, pairs = w + move[:FEATURES], pairs + move[FEATURES:].reshape(2, 2)
        return cls(w, pairs)

    def score(self, text: str) -> float:
        """Length-weighted mean of the lines' probabilities of being good."""
        features, size = line_features(text)
        unary = (features @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.pairs.tolist()
        # Log-odds messages: one number per line and direction is enough for two labels.
        n = len(unary)
        ahead, message = [0.0] * n, 0.0
        for t in range(n):
            ahead[t] = message
            d = message + unary[t]
            message = _log_add(ab, bb + d) - _log_add(aa, ba + d)
        message, odds = 0.0, [0.0] * n
        for t in range(n - 1, -1, -1):
            odds[t] = ahead[t] + unary[t] + message
            d = message + unary[t]
            message = _log_add(ba, bb + d) - _log_add(aa, ab + d)
        p = 1.0 / (1.0 + np.exp(-np.clip(np.array(odds), -50, 50)))
        return float((p * size).sum() / size.sum())


def _log_add(a: float, b: float) -> float:
    from math import exp, log1p

    high, low = (a, b) if a > b else (b, a)
    return high + log1p(exp(low - high)) if low - high > -700 else high


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineChain:
    """Fit on labelled rows that are not held out; null labels and unlabelled rows are left out."""
    known = labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("int").alias("__label")).filter(
        F.col("__label").isin(0, 1) & ~held_out("__label_id")
    )
    chosen = known.orderBy(F.xxhash64("__label_id"), "__label_id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), F.col("__id") == F.col("__label_id"))
    size = F.coalesce(F.size(F.split("__text", "\n")), F.lit(1)).cast("long")
    place = F.struct(F.xxhash64("__id"), F.col("__id"), F.col("__label"), F.xxhash64("__text"))
    sample = materialize(rows.select("__id", "__label", "__text", place.alias("__place"), F.least(size, F.lit(LONGEST)).alias("__lines")), "sample")
    taken, lines = [], 0
    for r in sample.select("__place", "__lines").orderBy("__place").limit(2 * SAMPLE_DOCS).collect():
        if lines >= SAMPLE_LINES:
            break
        taken, lines = r["__place"], lines + r["__lines"]

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data = training_features(batch.column("__text")[i].as_py() or "").astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("__id")[i : i + 1], batch.column("__label")[i : i + 1], pa.array([data], pa.binary())], ["__id", "__label", "__x"])

    if taken:
        last = F.struct(*(F.lit(v).cast(f.dataType) for v, f in zip(taken, sample.schema["__place"].dataType)))
        sample = sample.filter(F.col("__place") <= last)
    got = sample.select("__id", "__label", "__text").mapInArrow(features, "__id long, __label int, __x binary").limit(2 * SAMPLE_DOCS).collect()
    got.sort(key=lambda r: (r["__id"], r["__label"], bytes(r["__x"])))
    return LineChain.fit([np.frombuffer(r["__x"], "<f4").reshape(-1, FEATURES).astype(float) for r in got], [r["__label"] for r in got])


def with_score(docs: DataFrame, chain: LineChain, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with their score; the other columns pass unchanged. A null text counts as empty."""

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [chain.score(t.as_py() or "") for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Scores depend on the text alone. Empty, blank and null texts are scored as one empty line;
    repeated rows are scored alike; a null id counts as held out. An empty table gives no rows;
    without labelled rows every score is 0.5.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(rows, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, chain: LineChain) -> DataFrame:
    """The documents that the fitted chain predicts good, with all their columns."""
    return with_score(docs, chain, score_col="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")
