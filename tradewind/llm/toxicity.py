"""Toxicity of documents: a support vector machine over a subsequence string kernel.

The kernel counts the four-character subsequences that two pieces of text share, each with at most
one skipped character between its neighbours and weighed down for every skip, so that insults with
inserted or spaced characters still match. Nyström landmarks (words) span the space the machine
works in; its decision is a sum over landmarks of kernel values, and so one weight per
subsequence, which is all that scoring needs. A sentence is read through a window that slides
over it, and a text is as toxic as the worst window of its sentences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.words import IS_SPACE, blocks
from tradewind.llm.words import text_column as strings

# Labelled documents of each class that the machine is fitted on, at most; they are collected to
# the driver. Every fourth of them only sets the score's scale.
PER_CLASS = 1200
# Landmarks, and how many of them are merely frequent words.
LANDMARKS = 256
FREQUENT = 48
# Weight of a skipped character, and the binary logarithm of the number of weights.
DECAY = 0.8
BITS = 18
# Places of a window at which its subsequences start.
WIDTH = 12
# From this score on a document is predicted toxic.
PREDICTED = 0.7
# Rounds of fitting, and the worst windows of a clean and of a toxic text that a round learns from.
ROUNDS = 4
OF_CLEAN, OF_TOXIC = 4, 3
RIDGE = 1e-3
# Texts of each class that a quarter must have to scale the score alone, and the least slope.
ENOUGH = 100
LEAST_SLOPE = 0.2

# Places of the 2nd to 4th character behind the first, and the number of skipped characters.
_PATTERNS = [
    (1 + a, 2 + a + b, 3 + a + b + c, a + b + c) for a, b, c in product((0, 1), repeat=3)
]
_SPREAD = np.uint32(0x9E3779B1)
FIXED = 1 << 24


def subsequences(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For every pattern of skips: the bucket of the subsequence that starts at each byte, the
    number of skips, and the places whose subsequence would leave its text."""
    code = np.zeros(len(buf) + 8, np.uint32)
    code[: len(buf)] = buf
    shifted = [code << np.uint32(8 * i) for i in range(4)]
    n = len(buf)
    starts, ends = bounds[:-1], bounds[1:]
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    for a, b, c, skips in _PATTERNS:
        four = shifted[0][:n] | shifted[1][a : a + n]
        four |= shifted[2][b : b + n]
        four |= shifted[3][c : c + n]
        four *= _SPREAD
        four >>= np.uint32(32 - BITS)
        yield four, skips, np.maximum(ends[:, None] - np.arange(1, c + 1), starts[:, None]).ravel()


def sentence_starts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A text is cut after . ! ? before white space, and at line ends."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    stop = (buf == 0x2E) | (buf == 0x21) | (buf == 0x3F)
    cut[1:n] = IS_SPACE[buf[1:]] & stop[:-1]
    cut[:n] |= buf == 0x0A
    cut[bounds] = True
    return np.flatnonzero(cut[:n])


def window_sums(buf: np.ndarray, bounds: np.ndarray, scaled: list[np.ndarray]) -> np.ndarray:
    """Weight of the window that starts at each byte and ends with its sentence at the latest. Weights
    are whole numbers of 1/FIXED, so that a sum is the same whatever texts stand before it."""
    total = np.zeros(len(buf), np.int64)
    for bucket, skips, outside in subsequences(buf, bounds):
        found = scaled[skips][bucket]
        found[outside] = 0
        total += found
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(total, out=sums[1:])
    starts = sentence_starts(buf, bounds)
    ends = np.append(starts[1:], len(buf))
    last = np.minimum(np.arange(WIDTH, len(buf) + WIDTH), np.repeat(ends, ends - starts))
    return (sums[last] - sums[:-1]) / FIXED


@dataclass
class Model:
    """Weight of each subsequence bucket, bias, and the line that maps a margin to a score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scaled(self) -> list[np.ndarray]:
        return [np.rint(self.weights.astype(np.float64) * DECAY**k * FIXED).astype(np.int64) for k in range(4)]

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The greatest margin of a window of each text; that of nothing for an empty one."""
        out = np.full(len(texts), self.bias)
        scaled = self.scaled()
        for low, high, buf, bounds in blocks(pc.utf8_lower(texts)):
            if not len(buf):
                continue
            sums = window_sums(buf, bounds, scaled)
            filled = np.flatnonzero(np.diff(bounds))
            out[low:high][filled] = np.maximum.reduceat(sums, bounds[filled]) + self.bias
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


def _landmarks(texts: list[str], toxic: np.ndarray, count: int, frequent: int):
    """The words that tell the classes apart best, by documents, and the most frequent ones; and
    how much more likely each is in toxic texts. A landmark is the first 64 bytes of a word with a
    space on both sides; texts are scored whole."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        seen[int(label)].update({w.strip(".,;:!?\"'()").lower() for w in text.split()} - {""})
    n = [max(int((toxic == k).sum()), 1) for k in (0, 1)]
    rows = []
    for word in seen[0].keys() | seen[1].keys():
        clean, bad = seen[0][word], seen[1][word]
        if clean + bad < 2:
            continue
        p, q = (bad + 0.5) / (n[1] + 1), (clean + 0.5) / (n[0] + 1)
        rows.append(((p - q) * np.log(p / q), clean + bad, word, np.log(p / q)))
    common = sorted(rows, key=lambda r: (-r[1], r[2]))[:frequent]
    known = {r[2] for r in common}
    telling = [r for r in sorted(rows, key=lambda r: (-r[0], r[2])) if r[2] not in known]
    chosen = common + telling[: count - len(common)]
    return [f" {r[2]} ".encode()[:64] for r in chosen], np.array([r[3] for r in chosen])


@dataclass
class Landmarks:
    """Subsequence weights of the landmarks, for the buckets that any of them has."""

    index: np.ndarray
    dense: np.ndarray

    def weights(self, of_each: np.ndarray) -> np.ndarray:
        """One weight per bucket: the landmarks' own, weighed by ``of_each``."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.index >= 0] = (self.dense @ of_each)[self.index[self.index >= 0]]
        return out

    def kernel(self, pieces: list[bytes]) -> np.ndarray:
        """Kernel of each piece with each landmark. Subsequences start at the first ``WIDTH``
        bytes of a piece."""
        out = np.zeros((len(pieces), self.dense.shape[1]), np.float32)
        buf, bounds, row = _joined(pieces)
        inside = np.arange(len(buf)) - bounds[row] < WIDTH
        for bucket, skips, outside in subsequences(buf, bounds):
            hit = np.where(inside, self.index[bucket], -1)
            hit[outside] = -1
            places = np.flatnonzero(hit >= 0)
            for at in range(0, len(places), 20_000):
                part = places[at : at + 20_000]
                of = row[part]
                new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                out[of[new]] += DECAY**skips * np.add.reduceat(self.dense[hit[part]], new, axis=0)
        return out


def _joined(pieces: list[bytes]):
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return buf, bounds, np.repeat(np.arange(len(pieces)), lengths)


def _vectors(words: list[bytes]) -> Landmarks:
    buf, bounds, row = _joined(words)
    length = np.diff(bounds)[row]
    found = []
    for bucket, skips, outside in subsequences(buf, bounds):
        weight = DECAY**skips / np.sqrt(length)
        weight[outside] = 0
        found.append((bucket.astype(np.int64), row, weight))
    buckets, rows, weights = (np.concatenate(x) for x in zip(*found, strict=True))
    used, place = np.unique(buckets[weights > 0], return_inverse=True)
    dense = np.zeros((len(used), len(words)), np.float32)
    np.add.at(dense, (place, rows[weights > 0]), weights[weights > 0])
    index = np.full(1 << BITS, -1, np.int32)
    index[used] = np.arange(len(used))
    return Landmarks(index, dense)


def _worst_windows(text: bytes, scaled: list[np.ndarray], count: int) -> list[bytes]:
    """The windows with the greatest weights that do not overlap, with what they reach into."""
    buf = np.frombuffer(text, np.uint8)
    if not len(buf):
        return []
    sums = window_sums(buf, np.array([0, len(buf)]), scaled)
    found = []
    for _ in range(count):
        at = int(np.argmax(sums))
        if sums[at] == -np.inf:
            break
        found.append(text[at : at + WIDTH + 6])
        sums[max(at - WIDTH + 1, 0) : at + WIDTH] = -np.inf
    return found


def _disguised(piece: bytes, place: int) -> list[bytes]:
    """The piece with a foreign character in the middle of its longest word, and spelled out."""
    filler = b".-*_ "[place % 5 : place % 5 + 1]
    word = max(piece.split() or [b""], key=len)
    half = len(word) // 2
    inserted = piece.replace(word, word[:half] + filler + word[half:], 1)
    spelled = piece.replace(word, filler.join(word[i : i + 1] for i in range(len(word))), 1)
    return [inserted, spelled]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float):
    """Squared-hinge support vector machine by Newton steps on the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        inside = y * (x @ w) < 1
        if not inside.any():
            break
        xs = x[inside]
        xw = xs * weight[inside][:, None]
        step = np.linalg.solve(xs.T @ xw + np.diag(penalty), xw.T @ y[inside])
        if np.abs(step - w).max() < 1e-5:
            w = step
            break
        w = step
    return w[:-1], w[-1]


def _learned(texts: list[str], toxic: np.ndarray, count: int, frequent: int) -> Model:
    """The machine, its score not yet scaled."""
    lowered = [t.lower().encode() for t in texts]
    words, odds = _landmarks(texts, toxic, count, frequent)
    vectors = _vectors(words)
    values, directions = np.linalg.eigh((vectors.dense.T @ vectors.dense).astype(np.float64))
    good = values > values.max() * 1e-4
    whiten = directions[:, good] / np.sqrt(values[good])
    weights, bias = vectors.weights(np.maximum(odds, 0)), 0.0
    clean: dict[bytes, np.ndarray] = {}
    for _ in range(ROUNDS):
        scaled = Model(weights, 0, 0, 0).scaled()
        worst = [
            _worst_windows(text, scaled, OF_TOXIC if label else OF_CLEAN)
            for text, label in zip(lowered, toxic, strict=True)
        ]
        new = sorted({w for ws, label in zip(worst, toxic, strict=True) if not label for w in ws} - clean.keys())
        if new:
            clean |= dict(zip(new, vectors.kernel(new) @ whiten, strict=True))
        guilty = [ws for ws, label in zip(worst, toxic, strict=True) if label]
        bad = [w for ws in guilty for w in ws]
        if not bad or not clean:
            break
        share = np.array([1 / (1 + k) for ws in guilty for k in range(len(ws))])
        odd = [d for k, w in enumerate(bad) for d in _disguised(w, k)]
        x = np.concatenate([
            np.array(list(clean.values())), vectors.kernel(bad) @ whiten, vectors.kernel(odd) @ whiten
        ]).astype(np.float64)
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(bad) + len(odd))])
        weight = np.concatenate([
            np.full(len(clean), 1.0 / len(clean)),
            share / share.sum() * 0.7,
            np.repeat(share, 2) / share.sum() * 0.15,
        ])
        w, bias = _machine(x, y, weight, RIDGE)
        weights = vectors.weights(whiten @ w)
    return Model(weights, float(bias), 1.0, 0.0)


def fit(texts: list[str], toxic: np.ndarray, count: int = LANDMARKS, frequent: int = FREQUENT) -> Model:
    """Fits the machine on labelled texts.

    Which sentence makes a text toxic is not labelled. So each round scores all sentences, takes
    the worst windows of toxic texts as toxic and those of clean texts as clean, adds disguised
    copies of the toxic ones, and fits again; the clean windows of earlier rounds stay. Scores
    are scaled on texts that the machine did not learn from: every fourth one, or, where that
    leaves few of a class, each quarter by a machine of the others. Texts of one class alone
    give a model that scores everything nearly 0."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -40.0)
    part = np.arange(len(texts)) % 4
    enough = min(toxic[part == 3].sum(), (~toxic[part == 3]).sum()) >= ENOUGH
    margins = np.full(len(texts), np.nan)
    model = None
    for out in [3] if enough else range(4):
        learned, rest = np.flatnonzero(part != out), np.flatnonzero(part == out)
        if len(rest) and 0 < toxic[learned].sum() < len(learned):
            model = _learned([texts[i] for i in learned], toxic[learned], count, frequent)
            margins[rest] = model.margins(pa.array([texts[i] for i in rest], pa.large_string()))
    if not enough:
        model = _learned(texts, toxic, count, frequent)
    known = ~np.isnan(margins)
    if len(set(toxic[known])) < 2:
        known[:] = True
        margins = model.margins(pa.array(texts, pa.large_string()))
    margins, label = margins[known], toxic[known]
    share = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())
    model.slope = max(_sigmoid(margins, label, share)[0], LEAST_SLOPE)
    border = _border(margins, label)
    model.shift = float(np.log(PREDICTED / (1 - PREDICTED)) - model.slope * border)
    return model


def _border(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The margin that divides the classes best, in the middle of the gap around it. A clean text
    on the wrong side weighs as much as three toxic ones."""
    order = np.argsort(margin, kind="stable")
    margin, toxic = margin[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    alarms = np.concatenate([[0], np.cumsum(~toxic)])
    alarms = (alarms[-1] - alarms) / alarms[-1]
    edges = np.concatenate([[margin[0] - 1], margin, [margin[-1] + 1]])
    between = np.flatnonzero(edges[1:] > edges[:-1])
    cost = (missed + 3 * alarms)[between]
    best = between[np.flatnonzero(cost <= cost.min() + 1e-12)[-1]]
    return float((edges[best] + edges[best + 1]) / 2)


def _sigmoid(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the margins, with Platt's soft targets."""
    target = np.where(toxic, 1 - 1 / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (p - target))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def held_out(id_column: str):
    """Rows whose labels are kept for testing."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    per_class: int = PER_CLASS,
) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class, in the order of a hash of
    their ids and never on held-out ones. A document with several labels is toxic if one says so."""
    known = (
        labels.where(F.col(label_column).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
        .where("id IS NOT NULL")
    )
    order = F.md5(F.col("id").cast("string"))
    ids = known.where("toxic = 0").orderBy(order, "id").limit(per_class).unionByName(
        known.where("toxic = 1").orderBy(order, "id").limit(per_class)
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most 2 * per_class ids.
    sample = texts.where("text IS NOT NULL").join(F.broadcast(ids), "id").toPandas()
    sample = sample.sort_values(["id", "text"]).reset_index(drop=True)
    return fit(list(sample["text"]), sample["toxic"].to_numpy() > 0)


def score(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Adds a score from 0 to 1 to every document: that of its worst sentence.

    The whole text is read. A null or empty text scores as a sentence without known
    subsequences; repeated rows score alike; a model fitted without labels of both kinds scores
    nearly 0. Nothing is shuffled. Other columns are ignored, except those in ``carry``.

    Columns: the id column, score, then ``carry``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept"),
        F.col(text_column).alias("text"),
    )

    def scored(batches):
        for batch in batches:
            found = held.value.scores(strings(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(found, pa.float64())], ["kept", "score"]
            )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(scored, f"kept {kind}, score double").select(
        F.col("kept.id").alias(id_column),
        "score",
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)],
    )



def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
    )
