"""Quality classifier by co-training (operator 6).

Two views of a document: its text's content (shares of character classes, repetition, and a hashed profile of byte pairs) and its
metadata (source, language, length, time-free facts beside the text). Each has a logistic regression of its own. In each
round either classifier marks all unlabelled documents of which it is sure (calibrated log odds beyond ``SURE``), and the other learns from them, good and bad weighed in the ratio of the labels. At the end each view's
log odds are calibrated on held-out labelled documents (Platt), weighted by a joint fit there, and the sum scores all documents.

Only the labelled side is sampled: at most ``LABELLED`` labelled documents (a parameter), those of least seeded hash of ``doc_id``, reach the driver, one feature vector of fixed width an id.
The unlabelled side is every unlabelled document: their vectors are written once, and each Newton step is a pass over them that sums gradients and curvatures in the tasks,
then in two stages, so the driver gets a few vectors of fixed length. Scoring reads every whole text once and broadcasts the weights, a few kB.

Defined results: a null text is an empty text; null source or language are values of their own; without labels of both kinds nothing can be
learned: every document scores the share of good labels (1 if there are none) and is kept if that is 0.5 or more; repeated labels of an id count once, the least; documents with repeated ids are each scored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import flat_map, ship
from .common import discard, materialize

LABELLED, ROUNDS, STEPS, SEED = 6000, 4, 2, 6
#: Calibrated log odds from which a view is sure, and what all pseudo-labels weigh together, as a share of the labels.
SURE, TRUST = 3.0, 0.5
#: Vectors that are handled at once, and sums that reach the driver.
PIECE, LAST = 4096, 4
#: Parts of one in which sums over the pool are added up.
GRAIN = 1 << 24
PAIRS, META = 256, 128
_PLAIN = 14


def content(text: str | None) -> np.ndarray:
    """The text view: shares, then a hashed profile of byte pairs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(_PLAIN + PAIRS, np.float32)
    if not data:
        return out
    codes = np.frombuffer(data, np.uint8)
    seen = np.bincount(codes, minlength=256)
    words, n = data.split(), len(data)
    lines = data.split(b"\n")
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    count = max(len(words), 1)
    out[:_PLAIN] = (
        1, letters / n, seen[65:91].sum() / max(letters, 1), seen[48:58].sum() / n, sum(seen[ord(c)] for c in "#*$%&|<>") / count, seen[ord("!")] / count,
        len(set(words)) / count, sum(a == b for a, b in zip(words, words[1:], strict=False)) / count, (n - seen[[9, 10, 11, 12, 13, 32]].sum()) / count / 10,
        len(set(lines)) / len(lines), math.log1p(count) / 10, math.log1p(len(lines)) / 10, (seen[ord(".")] + seen[ord(",")]) / count, seen[ord("|")] / count,
    )
    if n > 1:
        pairs = (codes[:-1].astype(np.uint32) * 31 + codes[1:]) % PAIRS
        out[_PLAIN:] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / (n - 1))
    return out


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: hashed source and language, length class, length."""
    out = np.zeros(META, np.float32)
    out[0], out[1] = 1, math.log1p(max(n_chars or 0, 0)) / 10
    for value in (f"lang={lang}", f"source={source}", f"size={int(math.log2(max(n_chars or 0, 0) + 1))}"):
        out[2 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (META - 2)] += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Newton's method for a weighted ridge logistic regression."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    total = max(weight.sum(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / total + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x / total + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sure_sums(pool: list[np.ndarray], weights: list[np.ndarray], limits: list[tuple[float, float]]) -> np.ndarray:
    """What each view learns from the pool: for both views and labels the number, gradient and curvature (upper triangle) of the documents that the other view is sure of, as one vector of fixed length.

    ``limits``: below and above which log odds a view is sure.
    """
    out = []
    for v in (0, 1):
        odds = pool[1 - v].astype(np.float64) @ weights[1 - v]
        for label in (0, 1):
            low, high = limits[1 - v]
            x = pool[v][odds > high if label else odds < low].astype(np.float64)
            p = _sigmoid(x @ weights[v])
            out += [[len(x)], x.T @ (p - label), ((x * (p * (1 - p))[:, None]).T @ x)[np.triu_indices(x.shape[1])]]
    return np.concatenate(out)


def _unpacked(sums: np.ndarray, widths: list[int]):
    """``sure_sums`` -> for each view and label (number, gradient, curvature)."""
    at = 0
    for n in widths:
        both = []
        for _ in (0, 1):
            rows, columns = np.triu_indices(n)
            curve = np.zeros((n, n))
            curve[rows, columns] = curve[columns, rows] = sums[at + 1 + n : at + 1 + n + len(rows)]
            both.append((sums[at], sums[at + 1 : at + 1 + n], curve))
            at += 1 + n + len(rows)
        yield both


def _taught(w: np.ndarray, x: np.ndarray, y: np.ndarray, from_pool: list, ridge: float = 1e-3) -> np.ndarray:
    """One Newton step on the labelled rows and the pseudo-labelled ones; these weigh ``TRUST`` of the labelled in all, good and bad in the ratio of the labels."""
    p, share = _sigmoid(x @ w), y.mean()
    gradient, curve, total = x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x, float(len(y))
    for part, (n, g, c) in zip((1 - share, share), from_pool, strict=True):
        if n:
            gradient, curve, total = gradient + TRUST * len(y) * part / n * g, curve + TRUST * len(y) * part / n * c, total + TRUST * len(y) * part
    return w - np.linalg.solve(curve / total + ridge * np.eye(len(w)), gradient / total + ridge * w)


def co_train(views: list[np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """(weights of both views, [bias, slope, slope] that combine their log odds).

    ``pool``: both views of the unlabelled documents, or a function from weights and limits to their ``sure_sums``.
    """
    gather = pool if callable(pool) else lambda weights, limits: sure_sums(pool, weights, limits)
    n = len(y)
    held = np.arange(n) % 4 == 0
    fit = ~held if len(set(y[held])) == 2 and len(set(y[~held])) == 2 else np.ones(n, bool)
    rows = [v[fit].astype(np.float64) for v in views]
    weights = [logistic(x, y[fit], np.ones(len(x))) for x in rows]
    check = held if fit.sum() < n else np.ones(n, bool)

    def calibrated_by() -> tuple[np.ndarray, list[np.ndarray]]:
        odds = np.stack([np.ones(int(check.sum())), *(np.clip(views[v][check] @ weights[v], -20, 20) for v in (0, 1))], axis=1)
        return odds, [logistic(odds[:, [0, v]], y[check], np.ones(int(check.sum())), 1e-4) for v in (1, 2)]

    for _ in range(rounds):
        # a view passes on only what it is sure of by odds that held-out labels have calibrated; one that says nothing passes on nothing
        limits = [((-SURE - b) / k, (SURE - b) / k) if k > 1e-3 else (-np.inf, np.inf) for b, k in calibrated_by()[1]]
        for _ in range(STEPS):
            learnt = list(_unpacked(gather(weights, limits), [x.shape[1] for x in rows]))
            weights = [_taught(weights[v], rows[v], y[fit], learnt[v]) for v in (0, 1)]
    odds, platt = calibrated_by()
    calibrated = np.stack([odds[:, 0], *(odds[:, [0, v]] @ platt[v - 1] for v in (1, 2))], axis=1)
    joint = logistic(calibrated, y[check], np.ones(int(check.sum())), 1e-3)
    bias = joint[0] + joint[1] * platt[0][0] + joint[2] * platt[1][0]
    return weights, np.array([bias, joint[1] * platt[0][1], joint[2] * platt[1][1]])


_FACTS = {"lang": "string", "source": "string", "n_chars": "long"}


def _facts(docs: DataFrame) -> list:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(f"_{c}") for c, t in _FACTS.items()]


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, _text and facts -> the key and both views in half precision."""
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.BinaryType()) for c in ("_a", "_b"))])

    def make():
        def work(batch):
            for k, body, *facts in zip(batch[key], batch["_text"], *(batch[f"_{c}"] for c in _FACTS), strict=True):
                yield k, content(body).astype(np.float16).tobytes(), metadata(*facts).astype(np.float16).tobytes()

        return work

    return flat_map(rows, schema, make)


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float16).reshape(-1, width).astype(np.float32)


def _summed(parts: DataFrame, partitions: int) -> DataFrame:
    """Vectors of one length in a column of binaries -> a sum a partition; a task holds one sum and reads the parts one by one."""
    def run(batches):
        total = None
        for batch in batches:
            for cell in batch.column(0):
                x = np.frombuffer(cell.as_py(), np.int64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return parts.repartition(partitions).mapInArrow(run, "sums binary")


def pool_sums(vectors: DataFrame, weights: list[np.ndarray], limits: list[tuple[float, float]]) -> np.ndarray:
    """``sure_sums`` over a table of vectors of any size: a sum a task, then sums of these in two stages; the driver gets ``LAST`` vectors.

    A task's sums are passed on as whole multiples of 1 / ``GRAIN``, which add up alike in any order, so reruns give the same weights to the last bit.
    """
    ship(vectors.sparkSession)

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                sums = sure_sums([_matrix(piece.column(k).to_pylist(), len(w)) for k, w in enumerate(weights)], weights, limits)
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.rint(total * GRAIN).astype(np.int64).tobytes()], pa.binary())], ["sums"])

    each = vectors.select("_a", "_b").mapInArrow(run, "sums binary")
    some = _summed(_summed(each, vectors.sparkSession.sparkContext.defaultParallelism), LAST).collect()
    none = np.zeros(sum(2 * (1 + n + n * (n + 1) // 2) for n in map(len, weights)), np.int64)
    return sum((np.frombuffer(r[0], np.int64) for r in some), none) / GRAIN


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", labelled: int = LABELLED):
    """Weights (see ``co_train``), or the share of good labels where there is nothing to tell apart."""
    order = F.xxhash64(F.lit(SEED), key)
    y = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_y"))
    vectors = materialize(_vectors(docs.select(key, F.col(text).alias("_text"), *_facts(docs)), key))
    chosen = F.broadcast(y.join(vectors.select(key).distinct(), key, "left_semi").orderBy(order, key).limit(labelled))  # at most ``labelled`` rows of two numbers
    # one row an id, however often it is repeated
    known = vectors.join(chosen, key).groupBy(key).agg(F.min("_y").alias("_y"), F.min(F.struct("_a", "_b")).alias("x")).collect()
    known = sorted(known, key=lambda r: (r["_y"], bytes(r["x"]["_a"]), bytes(r["x"]["_b"])))
    target = np.array([float(r["_y"] > 0) for r in known])
    if len(set(target)) < 2:
        discard(vectors)
        return float(target.mean()) if len(target) else 1.0
    free = materialize(vectors.join(y.select(key), key, "left_anti").select("_a", "_b"))
    mixed = np.random.default_rng(SEED).permutation(len(known))
    views = [_matrix([bytes(r["x"][c]) for r in known], n)[mixed] for c, n in (("_a", _PLAIN + PAIRS), ("_b", META))]
    model = co_train(views, target[mixed], lambda weights, limits: pool_sums(free, weights, limits))
    for held in (vectors, free):
        discard(held)
    return model


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """``docs`` (or their columns ``keep``) with ``quality_score`` and ``kept``."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_score", "kept")]
    model = fit(docs, labels, text, key, **options)
    if isinstance(model, float):
        return docs.select(*names, F.lit(model).alias("quality_score"), F.lit(model >= 0.5).alias("kept"))
    (a, b), (bias, of_a, of_b) = model
    rows = docs.select(*names, F.col(text).alias("_text"), *_facts(docs))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("quality_score", T.DoubleType())])

    def make():
        def work(batch):
            for row in zip(*(batch[c] for c in names), batch["_text"], *(batch[f"_{c}"] for c in _FACTS), strict=True):
                own, (body, *facts) = row[: len(names)], row[len(names) :]
                odds = bias + of_a * np.clip(content(body) @ a, -20, 20) + of_b * np.clip(metadata(*facts) @ b, -20, 20)
                yield (*own, float(1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))))

        return work

    return flat_map(rows, schema, make).withColumn("kept", F.col("quality_score") >= 0.5)
