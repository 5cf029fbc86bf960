"""Quality classification by co-training of two views.

One classifier sees a text's content (which classes of characters follow each other, how words
repeat), the other the page's metadata (language, source, and how length and number of lines go
together). Both are logistic and start from the same labelled documents. In each round each
view, calibrated on labelled documents held out for that, ranks all unlabelled documents; those that it
is surest of, the same share of each class, teach the other view. A pseudo-label is the
calibrated probability, weighted by how far it lies from the share of good documents, so that a
view that knows little says little. In the end the calibrated views are combined by a logistic model on the
held-out part with weights of zero or more, and the combination scores every whole document.

Ranks come from a histogram of all unlabelled documents, and a view learns by a step against the gradient
summed over all pseudo-labelled ones, with a bound of the curvature from the labelled ones, so a round reads
the written features twice and the driver only gets sums (some thousand numbers).
Only the labelled sample is bounded, at ``MOST_LABELLED`` documents chosen by a hash of doc_id; all
other documents are unlabelled to the fit.

Defined results: a null text is an empty one; null metadata are values of their own; labels with
null doc_id or quality are ignored, of several labels for a document the highest counts; of rows that share
a labelled doc_id one is fitted on, by the order of their features. Every fourth label of a class is held out; the only label of a class is
used for both. Without labels of both classes every document is kept with the score of the class
there is (1 if there is none); repeated rows are scored alike; an empty table gives an
empty result; columns with the names of the results are replaced, other ones pass through ``score`` whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import chunks
from .common import lean, named, other_names, plain, trim, written

MOST_LABELLED = 6_000
#: Rounds, the share of the unlabelled documents that a view passes on in each, and their weight against all labelled ones.
ROUNDS, SHARE, PSEUDO = 3, 0.1, 0.5
#: Documents whose combined probability of good quality is lower are rejected.
THRESHOLD = 0.5
#: Bins of logits between -LIMIT and LIMIT, and rows that a worker holds as floats.
BINS, LIMIT, ROWS = 8192, 60.0, 2_000

CLASSES = 32
# Characters with a class of their own.
MARKS = ".,;:!?'\"()-_/|#*$%&<>@+="
CLASS_OF = np.full(256, 31, dtype=np.uint8)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[32, 9, 11, 12, 13]], CLASS_OF[10] = 3, 4
CLASS_OF[192:], CLASS_OF[128:192] = 5, 6
for _i, _c in enumerate(MARKS):
    CLASS_OF[ord(_c)] = 7 + _i
N_STATS = 6
N_TEXT = CLASSES * CLASSES + N_STATS
N_LANG, N_SOURCE, N_SIZES, N_LINES = 16, 64, 32, 12
#: A document has one of each kind: language, source, and size with lines.
META_KINDS = 3
N_META = N_LANG + N_SOURCE + N_SIZES * N_LINES
SCORES = ["p_text", "p_metadata", "quality_score", "kept"]


def text_features(text: str) -> np.ndarray:
    """Square roots of the shares of pairs of character classes, and shares of repeated words; 255 stands for 1."""
    out = np.zeros(N_TEXT, dtype=np.uint8)
    data = text.encode()
    if not data:
        return out
    c = CLASS_OF[np.frombuffer(data, dtype=np.uint8)].astype(np.uint16)
    if len(c) > 1:
        out[: CLASSES * CLASSES] = np.rint(255 * np.sqrt(np.bincount(c[:-1] * np.uint16(CLASSES) + c[1:], minlength=CLASSES * CLASSES) / (len(c) - 1)))
    words = data.split()
    if words:
        n = len(words)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        lines = [x for x in data.split(b"\n") if x]
        stats = np.array((len(set(words)) / n, again / n, min(len(data) / n, 40) / 40, len(set(lines)) / max(1, len(lines)), float(n < 5), min(np.log1p(n) / 15, 1)))
        out[CLASSES * CLASSES :] = np.rint(255 * stats)
    return out


def _bucket(value: str | None, n: int) -> int:
    h = 0 if value is None else 1
    for b in (value or "").encode():
        h = (h * 131 + b + 1) % 1_000_003
    return h % n


def meta_features(lang: str | None, source: str | None, n_chars: int, n_lines: int) -> np.ndarray:
    """The numbers of the document's metadata features, one of each kind."""
    size = min(N_SIZES - 1, int(2 * np.log2(n_chars + 1)))
    shape = size * N_LINES + min(N_LINES - 1, int(n_lines).bit_length())
    return np.array((_bucket(lang, N_LANG), N_LANG + _bucket(source, N_SOURCE), N_LANG + N_SOURCE + shape), dtype=np.uint16)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Text:
    """The content view: rows of ``text_features``."""

    ridge = 0.05
    size = N_TEXT + 1

    @staticmethod
    def dense(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), x.shape[1] + 1), dtype=np.float32)
        out[:, :-1] = x
        out[:, :-1] /= 255
        return out


class Meta:
    """The metadata view: rows of ``meta_features``."""

    ridge = 1.0
    size = N_META + 1

    @staticmethod
    def dense(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), N_META + 1), dtype=np.float32)
        out[np.arange(len(x))[:, None], x] = 1
        out[:, -1] = 1
        return out


VIEWS = {"text": Text, "meta": Meta}


def logits(view, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    parts = [view.dense(x[k : k + ROWS]) @ w for k in range(0, len(x), ROWS)]
    return np.clip(np.concatenate(parts) if parts else np.zeros(0), -LIMIT, LIMIT)


def curvature(view, x: np.ndarray, y: np.ndarray, w: np.ndarray, bound: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the ridged loss on labelled rows; the bias, the last weight, has no ridge to speak of.
    With ``bound`` the Hessian has that many times the most curvature that any targets give these rows on top."""
    penalty = np.full(len(w), view.ridge)
    penalty[-1] = 1e-6
    grad, h = penalty * w, np.diag(penalty)
    for k in range(0, len(x), ROWS):  # some rows at a time: the driver's memory stays small
        part = view.dense(x[k : k + ROWS]).astype(np.float64)
        p = sigmoid(np.clip(part @ w, -LIMIT, LIMIT))
        grad += part.T @ (p - y[k : k + ROWS])
        h += (part.T * (np.maximum(p * (1 - p), 1e-6) + 0.25 * bound)) @ part
    return grad, h


class Plain:
    """Columns as they are, for calibration and combination."""

    ridge = 0.05

    @staticmethod
    def dense(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def fit_logistic(view, x: np.ndarray, y: np.ndarray, size: int, steps: int = 12) -> np.ndarray:
    """Weights, the last one the bias, by Newton's method."""
    w = np.zeros(size)
    for _ in range(steps):
        step = np.linalg.solve(*reversed(curvature(view, x, y, w)))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def combination(views: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the views' logits (columns), and an offset: a view that would count against itself counts nothing."""
    used = list(range(views.shape[1]))
    while True:
        w = fit_logistic(Plain, views[:, used], y, len(used) + 1)
        bad = [k for k in range(len(used)) if w[k] < 0]
        if not bad:
            break
        used.pop(min(bad, key=lambda k: w[k]))
    out = np.zeros(views.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, offset) that make a view's logits probabilities; the slope is never negative."""
    return combination(z[:, None], y)


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, offset), and of the combination (text, metadata,
    offset). ``rounds`` has for each round the pseudo-labels given: by text good, bad, by metadata good, bad."""

    weights: dict[str, np.ndarray]
    calibrated: dict[str, np.ndarray]
    combine: np.ndarray
    constant: float | None = None
    rounds: tuple = ()

    def view_logits(self, view: str, x: np.ndarray) -> np.ndarray:
        slope, offset = self.calibrated[view]
        return np.clip(slope * logits(VIEWS[view], x, self.weights[view]) + offset, -LIMIT, LIMIT)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by metadata, combined."""
        if self.constant is not None:
            same = np.full(len(text), self.constant)
            return same, same, same
        a, b = self.view_logits("text", text), self.view_logits("meta", meta)
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(self.combine[0] * a + self.combine[1] * b + self.combine[2], -LIMIT, LIMIT))


def bins(z: np.ndarray) -> np.ndarray:
    return np.minimum(((z + LIMIT) * (BINS / (2 * LIMIT))).astype(np.int64), BINS - 1)


def limits(counts: np.ndarray, prior: float, share: float = SHARE) -> tuple[int, int]:
    """(lowest bin of the surest good documents, highest bin of the surest bad ones) from a view's
    histogram: whole bins, from each end, up to the first that makes ``share`` of a class, and
    only on that class's side of the prior."""
    n, middle = counts.sum(), int(bins(np.log(np.array([prior / (1 - prior)])))[0])
    good = BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), share * prior * n))
    bad = int(np.searchsorted(np.cumsum(counts), share * (1 - prior) * n))
    return max(good, middle + 1), min(bad, middle - 1)


def lessons(model: Model, cuts: dict[str, tuple[int, int]], prior: float, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each view the sums over the rows that the other view is sure of: gradient, diagonal of the Hessian,
    then weight, and numbers of good and bad pseudo-labels."""
    z = {v: model.view_logits(v, x[v]) for v in VIEWS}
    out = {}
    for teacher, pupil in (("text", "meta"), ("meta", "text")):
        at = bins(z[teacher])
        good, bad = at >= cuts[teacher][0], at <= cuts[teacher][1]
        sure = np.flatnonzero(good | bad)
        p = sigmoid(z[teacher][sure])
        weight = np.where(p >= prior, (p - prior) / (1 - prior), (prior - p) / prior)
        size = VIEWS[pupil].size
        sums = np.zeros(2 * size + 3)
        for k in range(0, len(sure), ROWS):
            rows = VIEWS[pupil].dense(x[pupil][sure[k : k + ROWS]])
            q = sigmoid(np.clip(rows @ model.weights[pupil], -LIMIT, LIMIT))
            w = weight[k : k + ROWS]
            sums[:size] += (w * (q - p[k : k + ROWS])) @ rows
            sums[size : 2 * size] += (w * q * (1 - q)) @ np.square(rows)
        sums[-3:] = weight.sum(), good.sum(), bad.sum()
        out[pupil] = sums
    return out


class Pool(Protocol):
    """The unlabelled documents."""

    def histograms(self, model: Model) -> dict[str, np.ndarray]: ...

    def lessons(self, model: Model, cuts: dict[str, tuple[int, int]], prior: float) -> dict[str, np.ndarray]: ...


class Arrays:
    """A pool in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.x = {"text": text, "meta": meta}

    def histograms(self, model: Model) -> dict[str, np.ndarray]:
        return {v: np.bincount(bins(model.view_logits(v, self.x[v])), minlength=BINS) for v in VIEWS}

    def lessons(self, model: Model, cuts: dict[str, tuple[int, int]], prior: float) -> dict[str, np.ndarray]:
        return lessons(model, cuts, prior, self.x)


class Table:
    """A pool in a table of features (text, meta: binary), summed over the cluster."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("text", "meta")

    def _sums(self, of_batch, sizes: dict[str, int]) -> dict[str, np.ndarray]:
        """The sums over all rows of the arrays by view that ``of_batch`` gives for a part of them."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {v: np.zeros(n) for v, n in sizes.items()}
            for batch in batches:
                x = unpacked(batch)
                for v, part in of_batch(x).items():
                    total[v] += part
            for v, sums in total.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.float64())], names=["view", "at", "value"])

        # ordered sums, so that reruns agree to the last bit
        added = self.rows.mapInArrow(lean(run), "view string, at int, value double").groupBy("view", "at").agg(F.aggregate(F.sort_array(F.collect_list("value")), F.lit(0.0), lambda a, b: a + b).alias("value"))
        out = {v: np.zeros(n) for v, n in sizes.items()}
        for row in added.collect():  # as many rows as numbers in ``sizes``
            out[row["view"]][row["at"]] = row["value"]
        return out

    def histograms(self, model: Model) -> dict[str, np.ndarray]:
        return self._sums(lambda x: {v: np.bincount(bins(model.view_logits(v, x[v])), minlength=BINS) for v in VIEWS}, dict.fromkeys(VIEWS, BINS))

    def lessons(self, model: Model, cuts: dict[str, tuple[int, int]], prior: float) -> dict[str, np.ndarray]:
        return self._sums(lambda x: lessons(model, cuts, prior, x), {v: 2 * VIEWS[v].size + 3 for v in VIEWS})


def unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The features of a batch's columns text and meta."""
    text, meta = (b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("text", "meta"))
    return {"text": np.frombuffer(text, dtype=np.uint8).reshape(-1, N_TEXT), "meta": np.frombuffer(meta, dtype=np.uint16).reshape(-1, META_KINDS)}


def held_out(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows to train on, rows held out): every fourth of each class is held out; a single one is both."""
    train, held = np.ones(len(y), dtype=bool), np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        held[at[::4]] = True
        train[at[::4]] = len(at) == 1
    return train, held


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """From labelled rows (``y`` is 1 for good ones, rows in random order) and the unlabelled ``pool``."""
    y = np.asarray(y, dtype=float)
    if len(np.unique(y)) < 2:
        return Model({}, {}, np.zeros(3), constant=float(y[0]) if len(y) else 1.0)
    x = {"text": text, "meta": meta}
    train, held = held_out(y)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    model = Model({v: fit_logistic(VIEWS[v], x[v][train], y[train], VIEWS[v].size) for v in VIEWS}, {}, np.zeros(3))

    def calibrate() -> None:
        model.calibrated = {v: calibration(logits(VIEWS[v], x[v][held], model.weights[v]), y[held]) for v in VIEWS}

    calibrate()
    for _ in range(rounds):
        cuts = {v: limits(counts, prior) for v, counts in pool.histograms(model).items()}
        taught = pool.lessons(model, cuts, prior)
        for v, sums in taught.items():
            if sums[-3] > 0:
                size = VIEWS[v].size
                much = PSEUDO * train.sum() / sums[-3]  # all pseudo-labels weigh PSEUDO times as much as the labelled ones
                grad, h = curvature(VIEWS[v], x[v][train], y[train], model.weights[v], PSEUDO)
                step = np.linalg.solve(h + np.diag(much * sums[size : 2 * size]), grad + much * sums[:size])
                model.weights[v] = model.weights[v] - step
        calibrate()
        model.rounds += ((*(int(n) for n in taught["meta"][-2:]), *(int(n) for n in taught["text"][-2:])),)
    for k, view in ((0, "text"), (2, "metadata")):
        if rounds and not any(r[k] + r[k + 1] for r in model.rounds):
            warnings.warn(f"the {view} view gave the other one no labels", stacklevel=2)
    model.combine = combination(np.stack([model.view_logits(v, x[v][held]) for v in VIEWS], axis=1), y[held])
    return model


def _meta_rows(rows: pa.RecordBatch, texts: list[str]) -> list[np.ndarray]:
    lang, source = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
    return [meta_features(a, b, len(t), t.count("\n") + 1) for a, b, t in zip(lang, source, texts, strict=True)]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of at most MOST_LABELLED labelled documents, by a hash."""
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    there = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return there.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(MOST_LABELLED)


def features(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, quality, text, meta) of every row: features as bytes, quality null where it isn't in ``chosen``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                made = [text_features(t).tobytes() for t in texts]
                meta = [m.tobytes() for m in _meta_rows(rows, texts)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(made, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "quality", "text", "meta"])

    rows = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "quality", "text", "lang", "source")
    return rows.mapInArrow(lean(run), docs.select("doc_id").schema.add("quality", "integer").add("text", "binary").add("meta", "binary"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for ``docs`` (doc_id, text, lang, source) from ``labels`` (doc_id, quality)."""
    rows = written(features(docs, sample(docs, labels)), "quality-features")
    # of rows with one doc_id the least, before anything comes to the driver: MOST_LABELLED rows at most
    known = rows.where("quality is not null").groupBy("doc_id").agg(F.min(F.struct("text", "meta", "quality")).alias("least"))
    known = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").select("least.*").toArrow().to_pandas()
    x = unpacked(pa.RecordBatch.from_pandas(known[["text", "meta"]], preserve_index=False, schema=pa.schema([("text", pa.binary()), ("meta", pa.binary())])))
    y = (known["quality"].to_numpy(dtype=np.int64) > 0).astype(int)
    del known
    model = co_train(x["text"], x["meta"], y, Table(rows.where("quality is null")))
    trim()
    return model


def score(docs: DataFrame, model: Model, only_kept: bool = False) -> DataFrame:
    """``docs`` with SCORES; with ``only_kept`` the kept documents as they are."""
    others = other_names(docs, *SCORES) if not only_kept else docs.columns
    docs = docs.select(*named(*others))
    schema = StructType(list(docs.schema.fields))
    for name in SCORES[:3] if not only_kept else []:
        schema = schema.add(name, "double")
    if not only_kept:
        schema = schema.add("kept", "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                scores = model.score(np.stack([text_features(t) for t in texts]), np.stack(_meta_rows(rows, texts)))
                kept = pa.array(scores[2] >= THRESHOLD, pa.bool_())
                if only_kept:
                    yield rows.filter(kept).rename_columns(others)
                else:
                    yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(s, pa.float64()) for s in scores), kept], names=[*others, *SCORES])

    return plain(docs).mapInArrow(lean(run), schema)
