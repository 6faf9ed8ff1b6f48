"""A quality classifier trained by co-training two views of a document.

The content view sees the words of a text, the metadata view its source, language, size and the
make-up of its page. Both are fitted to a bounded sample of labelled documents. In each round both
score all other documents where these lie; how often each feature comes in those that a view is sure
of is added up by Spark, and the other view is fitted anew around the log odds that these counts
give. Views are calibrated and combined on labelled documents held out. All documents are then scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptych.llm.hashing import BYTE, SEPARATOR, U64, chunks, mix, text_buffer, word_hashes
from triptych.llm.text import whole
from triptych.staging import staged

# Bound of the labelled documents that are gathered. Others count as unlabelled.
LABELLED_ROWS = 8_000
HELD_OUT = 4  # one labelled document of a class in so many
ROUNDS = 3
SURE = 0.97
# Words and word endings by their hashes.
WORDS = 1 << 16
ENDINGS = 1 << 12
FEATURES = WORDS + ENDINGS
# Words that tell the labels apart by fewer standard errors are left out.
LEAST_Z = 3.5
BINS = 16
SOURCES = 256
LANGUAGES = 64
THRESHOLD = 0.5

CLASSES = np.full(256, 5, dtype=np.uint8)
CLASSES[0x41:0x5B] = 0
CLASSES[0x61:0x7B] = 1
CLASSES[0x30:0x3A] = 2
CLASSES[0x20] = 3
CLASSES[0x0A] = 4
CLASSES[0x7C] = 6
CLASSES[0x80:] = 7
NUMBERS = 12
METADATA = NUMBERS * BINS + SOURCES + LANGUAGES
TARGETS = ("quality", "toxic")

SCORES = "struct<p_content: double, p_metadata: double, p_quality: double, p_toxic: double>"


def content_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts, and the text of each; a feature may come more than once."""
    words, first = word_hashes(data, starts)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    features = (words >> U64(48)).astype(np.int64)
    # The last two bytes of each word: endings and what follows them.
    inside = ~SEPARATOR[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[1:][np.diff(starts) > 0] - 1
    last[ends] = inside[ends]
    at = np.flatnonzero(last)
    before = np.maximum(at - 1, 0)
    ending = mix(BYTE[data[at]] + U64(3) * BYTE[data[before]]) >> U64(52)
    owner = np.searchsorted(starts, at, side="right") - 1
    return np.concatenate([features, WORDS + ending.astype(np.int64)]), np.concatenate([text, owner])


def metadata_numbers(data: np.ndarray, starts: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Size and make-up of each text: NUMBERS columns."""
    size = np.diff(starts)
    out = np.zeros((len(size), NUMBERS))
    filled = size > 0
    if filled.any():
        kinds = CLASSES[data]
        for kind in range(8):
            out[filled, kind] = np.add.reduceat(kinds == kind, starts[:-1][filled], dtype=np.int64)
    lines = out[:, 4] + 1
    words = out[:, 3] + lines
    out[:, :8] /= np.maximum(size, 1)[:, None]
    out[:, 8] = np.log1p(size)
    out[:, 9] = np.log1p(np.where(n_chars >= 0, n_chars, size))
    out[:, 10] = np.log1p(size / lines)
    out[:, 11] = np.log1p(size / words)
    return out


def _codes(values: pa.Array, size: int) -> np.ndarray:
    known = {}
    return np.array([known.setdefault(v, xxhash.xxh3_64_intdigest(v or "") % size) for v in values.to_pylist()], dtype=np.int64)


@dataclass
class View:
    """An additive logistic model over sparse features."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def logit(self, features: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Calibrated log odds from distinct (text, feature) pairs."""
        a, b = self.scale
        return a * (np.bincount(text, self.weights[features], texts) + self.bias) + b


@dataclass
class Model:
    """The two views of one target, the bins of the numbers, and how the views are combined."""

    content: View
    metadata: View
    edges: np.ndarray
    combined: np.ndarray

    def views(self, pair: np.ndarray, binned: np.ndarray) -> list[np.ndarray]:
        """Log odds of the two views from distinct (text, word feature) pairs and the metadata of the texts."""
        texts, columns = binned.shape
        content = self.content.logit(pair % FEATURES, pair // FEATURES, texts)
        return [content, self.metadata.logit(binned.ravel(), np.repeat(np.arange(texts), columns), texts)]

    def logits(self, pair: np.ndarray, binned: np.ndarray) -> np.ndarray:
        """The log odds of both views, and combined."""
        both = np.stack(self.views(pair, binned), axis=1)
        return np.stack([both[:, 0], both[:, 1], both @ self.combined[:2] + self.combined[2]])


def telling_pairs(data: np.ndarray, starts: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Distinct pairs of a text and a telling word feature, as text * FEATURES + feature."""
    features, text = content_features(data, starts)
    used = np.flatnonzero(telling[features])
    return np.unique(text[used] * FEATURES + features[used])


def binned_metadata(numbers: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature ids of the metadata view: a bin of each number, the source, the language."""
    bins = [np.searchsorted(edges[k], numbers[:, k]) + k * BINS for k in range(NUMBERS)]
    return np.stack([*bins, NUMBERS * BINS + codes[:, 0], NUMBERS * BINS + SOURCES + codes[:, 1]], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_view(features: np.ndarray, text: np.ndarray, size: int, label: np.ndarray, prior: np.ndarray) -> View:
    """Logistic regression by full-batch Adam: a multiple of the prior weights, and what differs from it.

    Only the difference is held small, so the labelled rows say how far the prior is to be trusted.
    """
    used, column = np.unique(features, return_inverse=True)
    said = np.bincount(text, prior[features], len(label))
    unit = max(float(np.abs(said).max(initial=0.0)), 1e-9)
    said, n = said / unit, max(len(label), 1)
    w, decay = np.zeros(len(used) + 2), np.append(np.full(len(used), 1e-4), [0.0, 0.0])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 301):
        error = sigmoid(np.bincount(text, w[:-2][column], len(label)) + w[-2] * said + w[-1]) - label
        gradient = np.append(np.bincount(column, error[text], len(used)), [error @ said, error.sum()]) / n + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = w[:-2]
    return View(weights + w[-2] / unit * prior, w[-1])


def fit_dense(x: np.ndarray, label: np.ndarray, start: list[float]) -> np.ndarray:
    """Logistic regression on a few columns and a constant, near `start` while rows are few.

    By Newton steps, each halved until it lowers the loss.
    """
    x, start = np.column_stack([x, np.ones(len(x))]), np.array(start)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - label @ (x @ w) + (w - start) @ (w - start) / 2
    w = start.copy()
    for _ in range(25):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step, now = np.linalg.solve(hessian, x.T @ (p - label) + w - start), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w


@dataclass
class Sample:
    """Labelled documents: distinct (text, telling feature) pairs, metadata features, labels, who is held out."""

    features: np.ndarray
    text: np.ndarray
    binned: np.ndarray
    label: np.ndarray
    held: np.ndarray


@dataclass
class Counts:
    """How many documents a view is sure to be of the class and not to be, and how many of them have each feature."""

    up: np.ndarray
    down: np.ndarray
    ups: int = 0
    downs: int = 0

    @property
    def log_odds(self) -> np.ndarray:
        """Smoothed by one document more that is divided like all others, so that features without any have 0."""
        if not self.ups or not self.downs:
            return np.zeros(len(self.up))
        more = 1 / (self.ups + self.downs)
        return np.log(self.up / self.ups + more) - np.log(self.down / self.downs + more)


def fitted(sample: Sample, edges: np.ndarray, priors: list[np.ndarray]) -> Model:
    """The two views around their priors, fitted to the labelled documents that are not held out."""
    train = ~sample.held
    place, label = np.cumsum(train) - 1, sample.label[train].astype(float)
    on = train[sample.text]
    content = fit_view(sample.features[on], place[sample.text[on]], FEATURES, label, priors[0])
    binned = sample.binned[train]
    rows = np.repeat(np.arange(len(binned)), binned.shape[1])
    return Model(content, fit_view(binned.ravel(), rows, METADATA, label, priors[1]), edges, np.array([0.5, 0.5, 0.0]))


def calibrated(model: Model, sample: Sample) -> Model:
    """The model with its views scaled, and combined, as fits the documents held out.

    While these are few, the views stay nearly as they are and count alike.
    """
    pair = sample.text.astype(np.int64) * FEATURES + sample.features
    seen = [logit[sample.held] for logit in model.views(pair, sample.binned)]
    truth = sample.label[sample.held].astype(float)
    for view, logit in zip((model.content, model.metadata), seen):
        view.scale = tuple(fit_dense(logit[:, None], truth, [1.0, 0.0]))
    scaled = [view.scale[0] * logit + view.scale[1] for view, logit in zip((model.content, model.metadata), seen)]
    model.combined = fit_dense(np.column_stack(scaled), truth, [0.5, 0.5, 0.0])
    return model


def _telling(counts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """Features whose frequencies in the two classes differ by several standard errors."""
    (a, b), (n, m) = counts, [max(size, 1) for size in sizes]
    share = (a + b + 1) / (n + m + 2)
    return np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m)) >= LEAST_Z


def train(documents: DataFrame, labels: DataFrame) -> dict[str, Model | None]:
    """Models of quality and toxicity; None where the gathered labels do not hold both classes."""
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    texts = documents.select("doc_id", *_inputs(documents))
    there = marked.join(documents.select("doc_id"), "doc_id", "left_semi")
    chosen = staged(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS), "quality-chosen")
    # At most LABELLED_ROWS rows of three numbers.
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", "toxic", "text", "source", "lang", "n_chars")
        .mapInArrow(_features, "doc_id bigint, quality int, toxic int, features binary, numbers binary, codes binary")
        .dropDuplicates(["doc_id"])
        .toArrow()
    )
    samples, edges, telling = _samples(rows)
    if not samples:
        return dict.fromkeys(TARGETS)
    others = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("text", "source", "lang", "n_chars")
    priors = {name: [np.zeros(FEATURES), np.zeros(METADATA)] for name in samples}
    models = {name: fitted(sample, edges[name], priors[name]) for name, sample in samples.items()}
    for _ in range(ROUNDS):
        for name, counts in taught(others, models, telling).items():
            priors[name] = [counts[0].log_odds * telling, counts[1].log_odds]
        models = {name: fitted(sample, edges[name], priors[name]) for name, sample in samples.items()}
    return dict.fromkeys(TARGETS) | {name: calibrated(model, samples[name]) for name, model in models.items()}


def taught(documents: DataFrame, models: dict[str, Model], telling: np.ndarray) -> dict[str, list[Counts]]:
    """What each view of each target learns from the documents that the other view is sure of.

    All documents are scored. A task hands on one row per feature, whose number the models bound.
    """

    def count(batches):
        totals = {}
        for batch in batches:
            for data, starts, numbers, codes, first, after in _pieces(batch.columns):
                pair = telling_pairs(data, starts, telling)
                features, text = pair % FEATURES, pair // FEATURES
                for target, model in models.items():
                    binned = binned_metadata(numbers, codes, model.edges)
                    sure = [sigmoid(logit) for logit in model.views(pair, binned)]
                    for learner, p in enumerate(reversed(sure)):
                        for side, mask in enumerate((p >= SURE, p <= 1 - SURE)):
                            found = features[mask[text]] if learner == 0 else binned[mask].ravel()
                            size = FEATURES if learner == 0 else METADATA
                            total = totals.setdefault((target, learner, side), np.zeros(size + 1, dtype=np.int64))
                            total[:-1] += np.bincount(found, minlength=size)
                            total[-1] += mask.sum()
        for (target, learner, side), total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([target] * len(at), pa.string()), pa.array(np.full(len(at), learner, np.int32)), pa.array(np.full(len(at), side, np.int32))]
                + [pa.array(at.astype(np.int32)), pa.array(total[at])],
                ["target", "learner", "side", "feature", "n"],
            )

    parts = documents.mapInArrow(count, "target string, learner int, side int, feature int, n bigint")
    sizes = (FEATURES, METADATA)
    out = {name: [Counts(np.zeros(size), np.zeros(size)) for size in sizes] for name in models}
    for r in parts.groupBy("target", "learner", "side", "feature").agg(F.sum("n").alias("n")).collect():
        counts = out[r.target][r.learner]
        if r.feature < sizes[r.learner]:
            (counts.down if r.side else counts.up)[r.feature] = r["n"]
        elif r.side:
            counts.downs = r["n"]
        else:
            counts.ups = r["n"]
    return out


def _inputs(documents: DataFrame) -> list[Column]:
    return [
        whole("text").alias("text"),
        whole(F.col("source").cast("string")).alias("source"),
        whole(F.col("lang").cast("string")).alias("lang"),
        F.coalesce(F.col("n_chars").cast("bigint"), F.lit(-1)).alias("n_chars"),
    ]


def _pieces(columns: list[pa.Array]):
    """Texts of a batch in chunks, with numbers and codes: data, starts, numbers, codes, first, after."""
    text, source, lang, n_chars = columns
    data, offsets = text_buffer(text)
    codes = np.stack([_codes(source, SOURCES), _codes(lang, LANGUAGES)], axis=1)
    size = n_chars.to_numpy(zero_copy_only=False)
    for first, after in chunks(offsets):
        part, starts = data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        yield part, starts, metadata_numbers(part, starts, size[first:after]), codes[first:after], first, after


def _features(batches):
    for batch in batches:
        for data, starts, numbers, codes, first, after in _pieces([batch.column(c) for c in ("text", "source", "lang", "n_chars")]):
            features, text = content_features(data, starts)
            pair = np.unique(text * FEATURES + features)
            cuts = np.searchsorted(pair, np.arange(after - first + 1) * FEATURES)
            mine = [_packed(pair[s:e] % FEATURES) for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(first, after - first) for c in ("doc_id", "quality", "toxic")]
                + [pa.array(mine, pa.binary())]
                + [pa.array([row.tobytes() for row in part], pa.binary()) for part in (numbers, codes)],
                ["doc_id", "quality", "toxic", "features", "numbers", "codes"],
            )


def _packed(features: np.ndarray) -> bytes:
    """The ids, or one bit for each possible id where that is shorter."""
    if 4 * len(features) < FEATURES // 8:
        return features.astype(np.uint32).tobytes()
    bits = np.zeros(FEATURES, dtype=bool)
    bits[features] = True
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) < FEATURES // 8:
        return np.frombuffer(data, dtype=np.uint32).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))


def _samples(rows: pa.Table) -> tuple[dict[str, Sample], dict[str, np.ndarray], np.ndarray]:
    """For each target with both classes the sample and the bins of the numbers, and the features that tell any apart."""
    order = np.argsort([xxhash.xxh3_64_intdigest(str(i)) for i in rows.column("doc_id").to_pylist()], kind="stable")
    rows = rows.take(pa.array(order))
    numbers = np.array([np.frombuffer(b) for b in rows.column("numbers").to_pylist()]).reshape(-1, NUMBERS)
    codes = np.array([np.frombuffer(b, dtype=np.int64) for b in rows.column("codes").to_pylist()], dtype=np.int64).reshape(-1, 2)
    label = {name: rows.column(name).to_numpy().astype(np.int64) for name in TARGETS}
    label = {name: mine for name, mine in label.items() if len(np.unique(mine)) == 2}
    held, counts = {}, {}
    for name, mine in label.items():
        held[name] = np.zeros(len(mine), dtype=bool)
        for value in (0, 1):  # in the order of a hash
            held[name][np.flatnonzero(mine == value)[HELD_OUT - 1 :: HELD_OUT]] = True
        counts[name] = np.zeros((2, FEATURES), dtype=np.int64)
    packed = rows.column("features").to_pylist()
    for i, data in enumerate(packed):
        features = _unpacked(data)
        for name, mine in label.items():
            if not held[name][i]:
                counts[name][mine[i], features] += 1
    telling = np.zeros(FEATURES, dtype=bool)
    for name, mine in label.items():
        telling |= _telling(list(counts[name]), [int(((mine == value) & ~held[name]).sum()) for value in (0, 1)])
    # Only telling features are kept, a small part of all.
    kept = [f[telling[f]].astype(np.int32) for f in map(_unpacked, packed)]
    features = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int32)
    text = np.repeat(np.arange(len(kept), dtype=np.int32), [len(f) for f in kept])
    samples, edges = {}, {}
    for name, mine in label.items():
        edges[name] = np.quantile(numbers[~held[name]], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        samples[name] = Sample(features, text, binned_metadata(numbers, codes, edges[name]), mine, held[name])
    return samples, edges, telling


def score(documents: DataFrame, models: dict[str, Model | None]) -> Column:
    """Probabilities of the row's document; null for a target without a model."""
    telling = np.zeros(FEATURES, dtype=bool)
    for model in filter(None, models.values()):
        telling |= model.content.weights != 0

    @F.arrow_udf(SCORES)
    def scored(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        parts = []
        for data, starts, numbers, codes, first, after in _pieces([text, source, lang, n_chars]):
            pair, out = telling_pairs(data, starts, telling), {}
            for name, model in models.items():
                logits = model and model.logits(pair, binned_metadata(numbers, codes, model.edges))
                out[name] = [None] * 3 if model is None else [pa.array(sigmoid(row)) for row in logits]
            columns = [*out["quality"], out["toxic"][2]]
            parts.append([pa.nulls(after - first, pa.float64()) if c is None else c for c in columns])
        joined = [pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], pa.float64()) for k in range(4)]
        return pa.StructArray.from_arrays(joined, ["p_content", "p_metadata", "p_quality", "p_toxic"])

    return scored(*_inputs(documents))


def accepted(scores: Column) -> Column:
    """Whether a document is of good quality and not toxic."""
    good = F.coalesce(scores["p_quality"] >= THRESHOLD, F.lit(True))
    return good & F.coalesce(scores["p_toxic"] < THRESHOLD, F.lit(True))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (the row of `documents`), p_content, p_metadata, p_quality, p_toxic, kept.

    Labels with a null doc_id or quality are not used, a null toxic counts as 0; where labels of a
    doc_id differ, the worse counts. All documents but the labelled ones that are gathered teach the
    views as unlabelled ones. Without labelled documents of both classes the probabilities of
    a target are null and it rejects nothing.

    A null text counts as empty, a null source or language as an empty one, and a null n_chars as
    the size of the text; empty texts are scored like others. Rows with a null doc_id are
    unlabelled; of rows with the same labelled doc_id one is trained on, and all are scored. Other columns are only handed on. An
    empty table gives an empty result.
    """
    models = train(documents, labels)
    rows = documents.select(F.struct("*").alias("doc"), score(documents, models).alias("scores"))
    return rows.select("doc", "scores.*", accepted(F.col("scores")).alias("kept"))
