"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise
interactions cost as much as the linear part, by the sum-of-squares identity. x holds square roots of word
shares by hash bucket (length 1), standardised structure statistics of the whole text, and a one-hot bucket
of the recorded length (metadata; null or absent has a bucket of its own). Labels, lang, source and doc_id are
no inputs. Trained in numpy with Adam on about `per_label` rows of each label (chosen by a hash of the id,
2 * 2 * `per_label` rows at most), whole texts, never a held-out document; rows are weighted so that the
learning sample's odds are the corpus' own. Every row is scored over its whole text.

Null or empty text: no words and zero statistics, scored like any other vector. No labelled rows: 0.5 for all.
doc_ids with conflicting labels are not learned from. Repeated rows get equal scores. Empty table: empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, groups, slices, word_hashes
from .sampling import held_out, sigmoid, thinned

BUCKETS, FACTORS, LENGTHS, PER_LABEL, THRESHOLD = 1 << 11, 8, 24, 1500, 0.3
STATS = ("words", "word length", "upper", "digits", "symbols", "marks", "distinct", "commonest", "lines", "line length", "repeated lines", "bars", "non-ascii")


_CLASS = np.zeros((5, 256), np.int64)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
for _c in b"#$%&*@^~<>=+\\{}_":
    _CLASS[2, _c] = 1
for _c in b"!?":
    _CLASS[3, _c] = 1
_CLASS[4, 128:] = 1


def statistics(text: bytes, at: np.ndarray, n: int) -> np.ndarray:
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    upper, digits, symbols, marks, wide = _CLASS @ byte
    size, lines = max(1, len(text)), text.split(b"\n")
    counts = at[at > 0]
    return np.array([
        np.log1p(n), np.log1p(len(text) / max(n, 1)), upper / size, digits / size, symbols / max(n, 1), marks / max(n, 1),
        len(counts) / max(1, min(n, BUCKETS)), counts.max(initial=0) / max(n, 1), np.log1p(len(lines)), np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines), byte[124] / max(n, 1), wide / size,
    ])


def vectors(texts: list[bytes | None], lengths: list[int | None]) -> np.ndarray:
    """A row per text: word buckets, raw statistics, one-hot recorded length."""
    out = np.zeros((len(texts), BUCKETS + len(STATS) + LENGTHS), np.float32)
    for a, b in groups(texts):
        h, counts = word_hashes(texts[a:b])
        bucket, end = (h % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(counts)
        for i, (stop, n) in enumerate(zip(end.tolist(), counts.tolist()), a):
            at = np.bincount(bucket[stop - n : stop], minlength=BUCKETS)
            out[i, :BUCKETS] = np.sqrt(at / max(n, 1))
            out[i, BUCKETS : BUCKETS + len(STATS)] = statistics(texts[i] or b"", at, n)
            n_chars = lengths[i]
            out[i, BUCKETS + len(STATS) + (0 if n_chars is None or n_chars < 0 else min(LENGTHS - 1, 1 + int(n_chars).bit_length()))] = 1
    return out


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        s = slice(BUCKETS, BUCKETS + len(STATS))
        x[:, s] = np.clip((x[:, s] - self.centre) / self.spread, -4, 4) * 0.5
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Of scaled rows, in time linear in the features."""
        pair = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1) / 2
        return self.bias + x @ self.linear + pair

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self.scaled(x)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    rnd = np.random.default_rng(seed)
    s = slice(BUCKETS, BUCKETS + len(STATS))
    fm = FactorisationMachine(0.0, np.zeros(x.shape[1]), rnd.normal(0, 0.01, (x.shape[1], FACTORS)), x[:, s].mean(axis=0), x[:, s].std(axis=0) + 1e-3)
    x = fm.scaled(x)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), fm.linear, fm.factors)]
    step = 0
    for _ in range(epochs):
        order = rnd.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = order[i : i + batch]
            part, step = x[rows], step + 1
            err = (sigmoid(fm.margin(part)) - y[rows]) * weight[rows] / len(rows)
            both = part @ fm.factors
            grads = (np.array([err.sum()]), part.T @ err + decay * fm.linear, part.T @ (err[:, None] * both) - fm.factors * ((part**2).T @ err)[:, None] + decay * fm.factors)
            moves = []
            for (m, v), g in zip(state, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            fm.bias -= float(moves[0][0])
            fm.linear -= moves[1]
            fm.factors -= moves[2]
    return fm


def _vectors(rows: DataFrame, extra: str) -> DataFrame:
    def work(batches):
        for batch, texts in slices(batches):
            x = [v.astype("<f4").tobytes() for v in vectors(texts, batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(x, pa.binary())], [extra, "x"])

    return rows.select("text", "n_chars", extra).mapInArrow(work, f"{extra} {dict(rows.dtypes)[extra]}, x binary")


def _read(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", n_chars.alias("n_chars"))


def learn(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL) -> FactorisationMachine | None:
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other").drop("_other")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    sample = thinned(known, counts, "quality", per_label)  # 4 * per_label rows at most, so it can be broadcast
    rows = _vectors(_read(docs).join(F.broadcast(sample), "doc_id").limit(8 * per_label), "quality").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    y = np.array([r["quality"] for r in rows], float)
    got, total = {v: max(1, (y == v).sum()) for v in counts}, sum(counts.values())
    weight = np.array([counts[int(v)] / total / (got[int(v)] / len(y)) for v in y])
    return train(np.stack([np.frombuffer(r["x"], "<f4") for r in rows]).astype(float), y, weight)


def score(docs: DataFrame, labels: DataFrame, *, model: FactorisationMachine | None = None, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model or learn(docs, labels, per_label=per_label))
    id_type = dict(docs.dtypes)["doc_id"]

    def work(batches):
        fm = shared.value
        for batch, texts in slices(batches):
            lengths, out = batch.column("n_chars").to_pylist(), np.full(len(texts), 0.5)
            if fm is not None:
                for s in range(0, len(texts), 128):
                    out[s : s + 128] = fm.score(vectors(texts[s : s + 128], lengths[s : s + 128]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = _read(docs).mapInArrow(work, f"doc_id {id_type}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
