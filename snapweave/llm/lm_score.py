"""Document scores by masked pseudo-likelihood: every word predicted from the words on both sides.

Vocabulary: the commonest words of the whole corpus (counted over every document, by 64-bit hash), the rest hashed into a
fixed number of buckets. A word in a bucket costs log p(bucket | both sides), from the network, and
log p(word | bucket), its share of the bucket's count, from the table of all counted words, which grows with the
corpus and is joined by shuffle. The network sums one embedding per place of the window (`SIDE` words left and right,
the predicted word masked), applies tanh, and predicts a class of words and the word within its class, so a
prediction costs the square root of the vocabulary. Biases start at the corpus' log frequencies.

Training in numpy: in each of `rounds` rounds the documents of that round (by a hash of the id) are read by
all tasks; a task trains its copy of the network by mini-batches on every `stride`-th position (all: 1) of its
documents, and the copies are averaged by positions trained on, as a Spark sum per parameter (every document
takes part in exactly one round, so what is gathered grows with the corpus; only the averaged network, of
fixed size, reaches the driver). Scoring: the sum of log p(word | both sides) over every word of every whole
text, without sampling.

Null or empty text, or text without words: n_words 0, log_prob 0, mean_log_prob and perplexity null. Repeated
rows get equal scores. Empty table: empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, groups, slices, word_hashes

CLASSES, MEMBERS, HASHED, SIDE, WIDTH = 32, 32, 64, 2, 16
SIZE = CLASSES * MEMBERS
#: Positions of a mini-batch, AdaGrad's step, every how many-th position is trained on, rounds, positions scored together.
BATCH, RATE, STRIDE, ROUNDS, CHUNK = 2048, 0.1, 1, 2, 1 << 15


class Ids:
    """Ids of words by their hashes: the vocabulary's, else a hashed bucket."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words).astype(np.int64)
        self.sorted = words[self.order]

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with SIDE pads (SIZE) around each, and each text's number of words."""
        h, n = word_hashes(texts)
        ids = (SIZE - HASHED + (h >> np.uint64(32)) % np.uint64(HASHED)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            ids = np.where(self.sorted[at] == h, self.order[at], ids)
        out = np.full(len(h) + SIDE * (len(n) + 1), SIZE, np.int64)
        out[np.arange(len(h)) + SIDE * (1 + np.repeat(np.arange(len(n)), n))] = ids
        return out, n.astype(np.int64)


def chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of every row at one place."""
    own = z[np.arange(len(z)), at]
    z -= own[:, None]
    top = z.max(axis=1)
    z -= top[:, None]
    return -top - np.log(np.exp(z, out=z).sum(axis=1))


@dataclass
class Network:
    places: np.ndarray  # (2 * SIDE, SIZE + 1, WIDTH)
    hidden: np.ndarray  # (WIDTH,)
    classes: np.ndarray  # (WIDTH + 1, CLASSES), the last row the biases
    members: np.ndarray  # (CLASSES, WIDTH + 1, MEMBERS), the last row the biases
    squares: "Network | None" = None  # while training: sums of squared slopes

    SHAPES = ((2 * SIDE, SIZE + 1, WIDTH), (WIDTH,), (WIDTH + 1, CLASSES), (CLASSES, WIDTH + 1, MEMBERS))

    @classmethod
    def first(cls, counts: np.ndarray, seed: int = 3) -> "Network":
        rnd = np.random.default_rng(seed)
        net = cls(*(rnd.normal(0, 0.1, s).astype(np.float32) for s in cls.SHAPES))
        share = np.log((counts + 1) / (counts + 1).sum()).reshape(CLASSES, MEMBERS)
        net.classes[-1] = np.log(np.exp(share).sum(axis=1))
        net.members[:, -1, :] = share - net.classes[-1][:, None]
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.places, self.hidden, self.classes, self.members)])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Network":
        cuts = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])[:-1]
        return cls(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cuts), cls.SHAPES)))

    def state(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        around = [ids[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]
        h = self.places[0][around[0]]
        for k, c in enumerate(around[1:], 1):
            h += self.places[k][c]
        h += self.hidden
        return np.tanh(h, out=h), around

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p(ids[at] | both sides)."""
        h, _ = self.state(ids, at)
        out = np.empty(len(at))
        group, member = ids[at] // MEMBERS, ids[at] % MEMBERS
        out[:] = chosen(h @ self.classes[:-1] + self.classes[-1], group)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        edges = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[edges[c] : edges[c + 1]]
            if len(rows):
                out[rows] += chosen(h[rows] @ self.members[c, :-1] + self.members[c, -1], member[rows])
        return out

    def train(self, ids: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """Mini-batch AdaGrad steps on the positions `at`, in their order."""
        if self.squares is None:
            self.squares = Network(*(np.full(p.shape, 1e-4, np.float32) for p in (self.places, self.hidden, self.classes, self.members)))
        past = self.squares

        def step(value: np.ndarray, square: np.ndarray, slope: np.ndarray) -> None:
            square += slope * slope
            value -= rate * slope / np.sqrt(square)

        for s in range(0, len(at), BATCH):
            part = at[s : s + BATCH]
            part = part[np.argsort((ids[part] // MEMBERS).astype(np.uint8), kind="stable")]  # by class
            h, around = self.state(ids, part)
            n, group, member = len(part), ids[part] // MEMBERS, ids[part] % MEMBERS
            one = np.concatenate([h, np.ones((n, 1), np.float32)], axis=1)
            z = one @ self.classes
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), group] -= 1
            back = z @ self.classes[:-1].T
            step(self.classes, past.classes, one.T @ z)
            edges = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
            for c, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                if i < j:
                    m = self.members[c]
                    y = one[i:j] @ m
                    y = np.exp(y - y.max(axis=1, keepdims=True))
                    y /= y.sum(axis=1, keepdims=True)
                    y[np.arange(j - i), member[i:j]] -= 1
                    back[i:j] += y @ m[:-1].T
                    step(m, past.members[c], one[i:j].T @ y)
            back *= 1 - h * h
            step(self.hidden, past.hidden, back.sum(axis=0))
            for k, ctx in enumerate(around):
                order = np.argsort(ctx.astype(np.uint16), kind="stable")
                ctx = ctx[order]
                first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
                slope = np.add.reduceat(back[order], first, axis=0)
                square = past.places[k][ctx[first]] + slope * slope
                past.places[k][ctx[first]] = square
                self.places[k][ctx[first]] -= rate * slope / np.sqrt(square)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents."""

    def work(batches):
        for _, texts in slices(batches):
            for a, b in groups(texts):
                words, n = np.unique(word_hashes(texts[a:b])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return checkpoint(docs.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, counted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest words of all documents, and a count for every id."""
    counted = word_counts(docs) if counted is None else counted
    top = counted.orderBy(F.desc("n"), "word").limit(SIZE - HASHED).collect()
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    rest = max(0, total - sum(r["n"] for r in top)) / HASHED
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    return words, np.array([*(r["n"] for r in top), *[0] * (SIZE - HASHED - len(top)), *[rest] * HASHED], float)


def train(docs: DataFrame, words: np.ndarray, counts: np.ndarray, *, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    spark = docs.sparkSession
    net = Network.first(counts)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((words, net))

        def work(batches, shared=shared):
            words, start = shared.value
            own, vocab, seen = Network.of(start.flat()), Ids(words), 0
            for _, texts in slices(batches):
                for a, b in groups(texts):
                    ids, _ = vocab.of(texts[a:b])
                    at = np.nonzero(ids < SIZE)[0][seen % stride :: stride]
                    own.train(ids, at)
                    seen += len(at)
            if seen:
                moved = np.round(own.flat().astype(float), 6)
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([moved], pa.list_(pa.float64()))], ["n", "values"])

        mine = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(rounds)) == k).select("text")
        sums = mine.mapInArrow(work, "n double, values array<double>").select("n", F.posexplode("values").alias("i", "v")).groupBy("i").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
        got = sums.toArrow()  # one row per parameter, whatever the corpus
        if got.num_rows:
            flat = np.empty(got.num_rows)
            flat[got.column("i").to_numpy()] = got.column("v").to_numpy()
            net = Network.of(np.round(flat, 5))
    return net


def within_buckets(docs: DataFrame, words: np.ndarray, counted: DataFrame) -> DataFrame:
    """(key, within): of every text, by its hash, the sum of log p(word | bucket) over its words outside the vocabulary."""
    known = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(np.sort(words.view(np.int64)))}))
    rest = counted.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.expr(f"shiftrightunsigned(word, 32) % {HASHED}"))
    sizes = rest.groupBy("bucket").agg(F.sum("n").alias("size"))
    share = rest.join(F.broadcast(sizes), "bucket").select("word", F.log(F.col("n") / F.col("size")).alias("share"))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(words))

    def work(batches):
        words = shared.value
        for _, texts in slices(batches):
            for a, b in groups(texts):
                h, n = word_hashes(texts[a:b])
                rare = np.flatnonzero(words[np.minimum(np.searchsorted(words, h), len(words) - 1)] != h) if len(words) else np.arange(len(h))
                out, owner = h[rare], np.repeat(np.arange(len(n)), n)[rare]
                order = np.lexsort((out, owner))
                out, owner = out[order], owner[order]
                new = np.flatnonzero(np.append(True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1]))) if len(out) else np.zeros(0, int)
                keys = np.array([key_of(t) for t in texts[a:b]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys, keys[owner[new]]])),
                        pa.array(np.concatenate([np.zeros(len(n), np.int64), out[new].view(np.int64)]), mask=np.arange(len(n) + len(new)) < len(n)),
                        pa.array(np.concatenate([np.ones(len(n), np.int64), np.diff(np.append(new, len(out)))])),
                    ],
                    ["key", "word", "times"],
                )

    # a row without a word stands for each copy of a text, so that copies count once
    held = docs.select("text").mapInArrow(work, "key long, word long, times long").join(share, "word", "left")
    return held.groupBy("key").agg((F.sum(F.coalesce(F.col("times") * F.col("share"), F.lit(0.0))) / F.sum(F.col("word").isNull().cast("long"))).alias("within"))


def key_of(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"")


def score(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob, perplexity for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    counted = word_counts(docs)
    words, counts = vocabulary(docs, counted)
    shared = spark.sparkContext.broadcast((words, train(docs, words, counts, **kw)))

    def work(batches):
        words, net = shared.value
        vocab = Ids(words)
        for batch, texts in slices(batches):
            counts, sums = [], []
            for a, b in groups(texts):
                ids, n = vocab.of(texts[a:b])
                at = np.nonzero(ids < SIZE)[0]
                owner = np.repeat(np.arange(len(n)), n)
                total = np.zeros(len(n))
                for s in range(0, len(at), CHUNK):
                    total += np.bincount(owner[s : s + CHUNK], net.log_probs(ids, at[s : s + CHUNK]), len(n))
                counts.append(n)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums)), pa.array(np.array([key_of(t) for t in texts], np.uint64).view(np.int64))], ["doc_id", "n_words", "base", "key"])

    scored = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, base double, key long")
    scored = scored.join(within_buckets(docs, words, counted), "key").withColumn("log_prob", F.col("base") + F.col("within"))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
