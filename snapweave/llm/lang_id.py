"""Language identification by error-correcting output codes over hashed letter n-grams.

Every language gets a codeword; for each bit a binary logistic classifier over hashed byte n-grams (2 to 4
bytes of the lower-cased text, with every run of other ASCII characters as one space) is trained in numpy. Decoding is
loss-weighted: each bit's margin costs log(1 + exp(-margin)) against a codeword's bit, weighted by the bit's
accuracy on the learning sample, and the codeword with the smallest total wins. `score` is the winner's
share (softmax of the negative losses), `ambiguous` flags a runner-up closer than `min_margin`.

Learning uses about `per_lang` rows of each language (fewer for more than MAX_ROWS / per_lang languages), chosen
by a hash of the id, 2 * MAX_ROWS rows at most, with whole texts, and never a held-out document. Every row is scored over its whole text.

Null text or text without a letter: `und`, score 0, ambiguous. No labelled row: every text is `und`. One
language: it is the answer for every text with a letter. Repeated rows get equal answers. Empty table:
empty result. Only doc_id, text and lang are read, so extra columns can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release_memory, slices
from .sampling import held_out, sigmoid, thinned

BUCKETS, GRAMS, CHUNK = 1 << 12, (2, 3, 4), 1 << 20
PER_LANG, MAX_ROWS, MIN_MARGIN, CERTAIN, UNKNOWN = 400, 4000, 0.05, 0.99, "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters count as space.
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text)) if text else False


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram shares by hash bucket, of length 1."""
    raw = np.frombuffer(b" %b " % b" ".join(text.lower().encode("utf-8", "replace").translate(SPACED).split()), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    for s in range(0, len(raw), CHUNK):
        part = raw[s : s + CHUNK + max(GRAMS) - 1]
        for n in GRAMS:
            m = min(CHUNK, len(part) - n + 1)
            if m > 0:
                h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for j in range(n):
                    h = (h ^ part[j : j + m]) * np.uint32(0x01000193)
                counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    v = np.sqrt(counts)
    return v / max(np.linalg.norm(v), 1e-12)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all splits for few languages, else random ones with the best least distance found."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [[1 if (m >> i) & 1 or i == 0 else -1 for i in range(n)] for m in range(0, 1 << n, 2)]
        return np.array([s for s in splits if -1 in s]).T.astype(float)
    rnd, best, least = np.random.default_rng(seed), None, -1
    bits = max(15, 10 * int(np.ceil(np.log2(n))))
    for _ in range(200):
        code = rnd.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, np.inf)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its share, and the lead over the runner-up."""
        loss = self.losses(x)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if share.shape[1] > 1 else 0)


def train(x: np.ndarray, langs_of: np.ndarray, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> Model:
    """Logistic regression of every bit at once, by full-batch gradient steps with momentum."""
    langs = sorted(set(langs_of.tolist()))
    code = codewords(len(langs))
    y = (code[np.searchsorted(langs, langs_of)] + 1) / 2
    share = np.bincount(np.searchsorted(langs, langs_of), minlength=len(langs))
    per_row = (1 / share)[np.searchsorted(langs, langs_of)][:, None] / len(langs)  # languages count alike
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        err = (sigmoid(x @ w + b) - y) * per_row
        vw = 0.9 * vw - rate * (x.T @ err + decay * w)
        vb = 0.9 * vb - rate * err.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b > 0) == (y > 0.5)).mean(axis=0)
    trust = np.log(np.clip(right, 0.51, 0.999) / np.clip(1 - right, 0.001, 0.49))
    return Model(langs, code, w, b, trust / trust.mean())


def learn(docs: DataFrame, *, per_lang: int = PER_LANG) -> Model | None:
    bound_batches(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def work(batches):
        for batch in batches:
            langs, vectors = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if has_letter(text):
                    langs.append(lang)
                    vectors.append(features(text).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], ["lang", "x"])

    rows = thinned(known, counts, "lang", max(1, min(per_lang, MAX_ROWS // max(1, len(counts))))).mapInArrow(work, "lang string, x binary").collect() if counts else []
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x, langs = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]).astype(float), np.array([r["lang"] for r in rows])
    rows.clear()
    model = train(x, langs)
    del x
    release_memory()  # the driver's Python lives as long as the session
    return model


def _decoded(docs: DataFrame, keep: list[str], model: Model | None, min_margin: float) -> DataFrame:
    """row (a struct of the columns to keep), lang_pred, score, ambiguous, letters (whether the text has any)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").alias("text"))

    def work(batches):
        m = shared.value
        for batch, texts in slices(batches):
            lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            texts = [t.decode("utf-8", "replace") if t is not None else None for t in texts]
            letters = [has_letter(t) for t in texts]
            some = [i for i, yes in enumerate(letters) if yes and m is not None]
            for s in range(0, len(some), 256):
                part = some[s : s + 256]
                for i, best, share, lead in zip(part, *m.predict(np.stack([features(texts[i]) for i in part]))):
                    lang[i], score[i], unsure[i] = m.langs[best], float(share), bool(lead < min_margin)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang), pa.array(score), pa.array(unsure), pa.array(letters)], ["row", "lang_pred", "score", "ambiguous", "letters"])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("letters", "boolean")
    return rows.mapInArrow(work, schema)


def identify(docs: DataFrame, *, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",), per_lang: int = PER_LANG, min_margin: float = MIN_MARGIN) -> DataFrame:
    """`keep` columns + lang_pred, score, ambiguous for every row."""
    return _decoded(docs, list(keep), model or learn(docs, per_lang=per_lang), min_margin).select("row.*", "lang_pred", "score", "ambiguous")


def drop_unidentified(docs: DataFrame, *, model: Model | None = None, per_lang: int = PER_LANG, min_margin: float = MIN_MARGIN, certain: float = CERTAIN) -> DataFrame:
    """The documents whose language is told. Columns unchanged, whatever their names.

    Those go that have no text or letter, whose codeword is ambiguous, or whose own lang is another than the predicted
    one although that has a score of at least `certain`. Without any labelled row there is no model, and all with letters stay.
    """
    model = model or learn(docs, per_lang=per_lang)
    out = _decoded(docs, docs.columns, model, min_margin).where("letters")
    if model is not None:
        out = out.where(~F.col("ambiguous") & ~F.coalesce((F.col("row.lang") != F.col("lang_pred")) & (F.col("score") >= certain), F.lit(False)))
    return out.select("row.*")
