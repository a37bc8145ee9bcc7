"""Components of a similarity graph from bucket keys: stars first, then what is left of each bucket, in place.

Rows of one key are mates; only mates whose sketches lie within `limit` bits and whose sizes are within
`ratio` of each other (the caller's gate) are ever compared. Every row is first compared with one centre: of the
least ids of its buckets the one it shares most buckets with. Buckets that then still hold several components
are settled in place (`tiles.py`): rows without a possible partner drop out, the others fetch their contents and
are compared tile by tile; a tile returns a spanning set of links. So the components are those of all verified
links between mates that pass the gate, no list of all pairs of a bucket is made, and no tile holds more than a
bounded number of rows and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpoint, let_go, new_table, remove_table, written
from .components import components
from .tiles import BLOCK, TILE_BYTES, Gate, deal, settle, wanted

#: Rows of an Arrow batch of keys (three longs each).
KEYS = 8192


def distance(x: str, y: str, words: int) -> Column:
    """Population count of the XOR of two sketches of so many longs."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(words)), F.lit(0))


def shared(keyed: DataFrame) -> DataFrame:
    """keyed (id, key) -> (key, id, center) of the keys that several ids have, each id once; center is the least of them.

    One shuffle and one sort: sorted rows are read in passing, with the last one held, so a key may have any number of rows.
    """

    def work(batches):
        last_key, last_id, last_center = (np.zeros(0, np.int64) for _ in range(3))
        mated = False  # whether the row that is held has a mate before it

        def found(key, id_, center, some):
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, id_, center)], ["key", "id", "center"])

        for batch in batches:
            key, id_ = np.concatenate([last_key, batch.column("key").to_numpy()]), np.concatenate([last_id, batch.column("id").to_numpy()])
            if not len(key):
                continue
            new = np.append(True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))
            key, id_ = key[new], id_[new]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            least, several = id_[first], n > 1
            if len(last_center):
                least[0] = last_center[0]
                several[0] |= mated
            center, some = np.repeat(least, n), np.repeat(several, n)
            mated = bool(some[-1])
            last_key, last_id, last_center = key[-1:], id_[-1:], center[-1:]
            some[-1] = False
            yield found(key, id_, center, some)
        if mated:
            yield found(last_key, last_id, last_center, np.array([True]))

    return keyed.select("key", "id").repartition("key").sortWithinPartitions("key", "id").mapInArrow(work, "key long, id long, center long")


def _stars(mates: DataFrame, nodes: DataFrame, words: int, gate: Gate, block: int) -> DataFrame:
    """Rows (tile, id, label, side, sketch, size): every row with its centre, large stars in several tiles."""
    pairs = mates.where("id <> center").select("id", "center").repartition("id").groupBy("id", "center").agg(F.count(F.lit(1)).alias("n"))  # both groupings in one shuffle
    best = pairs.groupBy("id").agg(F.max(F.struct("n", "center")).alias("s")).select("id", F.col("s.center").alias("center"))
    both = best.join(nodes, "id").join(nodes.select(F.col("id").alias("center"), F.col("sketch").alias("y"), F.col("size").alias("m")), "center")
    alike = (distance("sketch", "y", words) <= gate.limit) | (F.greatest("size", "m") < gate.free)
    near = both.where(alike & (F.least("size", "m") >= F.lit(gate.ratio) * F.greatest("size", "m") - 1e-9))
    near = checkpoint(near.select("center", "id", "sketch", "size"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    large = near.groupBy("center").agg(F.count(F.lit(1)).alias("n")).select("center", salts.alias("salts"))
    members = near.join(large, "center").select(F.xxhash64("center", F.pmod(F.xxhash64("id"), F.col("salts"))).alias("tile"), "id", F.col("id").alias("label"), F.lit(1).alias("side"), "sketch", "size")
    hubs = large.select(F.col("center").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt")).join(nodes, "id")
    return members.unionByName(hubs.select(F.xxhash64("id", "salt").alias("tile"), "id", F.col("id").alias("label"), F.lit(2).alias("side"), "sketch", "size"))


def _mixed(mates: DataFrame, labels: DataFrame, nodes: DataFrame, ratio: float, block: int) -> DataFrame:
    """Rows (tile, id, label, side, sketch, size) of the buckets that hold several components; of buckets with the same members, one.

    A bucket of over `block` rows is parted by size first: rows whose sizes are within `ratio` share a part.
    """
    labelled = mates.select("key", "id").join(labels.select("id", "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    members = F.sum(F.xxhash64("id").cast("decimal(20,0)"))
    by_key = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("id").alias("first"), members.alias("members"), F.count(F.lit(1)).alias("n"))
    one = checkpoint(by_key.where("x <> y").groupBy("first", "members", "n").agg(F.min("key").alias("key")).select("key", "n"))
    step = (F.floor(F.log(F.col("size")) / F.lit(float(-np.log(ratio)))) if ratio < 1 else F.col("size")).cast("long")
    parts = F.array(step, step + 1) if ratio < 1 else F.array(step)

    def rows_of(keys: DataFrame) -> DataFrame:
        rows = labelled.join(keys, "key").join(nodes, "id")
        part = F.explode(F.when(F.col("n") > block, parts).otherwise(F.array(F.lit(-1).cast("long"))))
        return rows.withColumn("part", part).withColumn("key", F.when(F.col("n") > block, F.xxhash64("key", "part")).otherwise(F.col("key"))).drop("part")

    by_label = rows_of(one.where(F.col("n") > block)).groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    most = by_label.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all")).where(F.col("all") > block).select("key", F.col("top.label").alias("most"))
    rows = rows_of(one).join(most, "key", "left").withColumn("side", F.when(F.col("label") == F.col("most"), 1).otherwise(0))
    return deal(rows, F.lit(1), block, F.col("n") > block)


def connect(keyed: DataFrame, nodes: DataFrame, *, words: int, gate: Gate, contents: Callable[[DataFrame], DataFrame], same: Callable, unit: int, sift: Callable | None = None, keys_read: Callable | None = None, block: int | None = None, tile_bytes: int | None = None) -> DataFrame | None:
    """keyed (id, key), nodes (id, sketch of `words` longs, size) -> (id, component) of the linked ids; None if no two share a key.

    contents(ids) gives (id, content) with content binary of about `unit` bytes per unit of size;
    same(xs, ys) says of lists of contents which pairs are linked; sift as in settle(). keys_read() is called when keyed is needed no more.
    """
    block, tile_bytes = block or BLOCK, tile_bytes or TILE_BYTES
    path = new_table(keyed.sparkSession)
    with batches_of(keyed.sparkSession, KEYS):
        mates = written(shared(keyed), path)
    if keys_read:
        keys_read()
    if not mates.limit(1).count():
        remove_table(keyed.sparkSession, path)
        return None

    def links(rows: DataFrame) -> DataFrame:
        rows = rows if "lead" in rows.columns else rows.withColumn("lead", F.col("tile"))
        rows = deal(rows.withColumnRenamed("tile", "key"), F.col("size") * unit, tile_bytes)
        heavy = rows.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // 4).select("lead", F.lit(True).alias("heavy"))
        rows = rows.join(heavy, "lead", "left").withColumn("lead", F.when(F.col("heavy"), F.col("tile")).otherwise(F.col("lead"))).drop("heavy")
        content = contents(rows.select("id").distinct())
        let_go(keyed.sparkSession)  # before the largest shuffles; a collection just after a job may still find its files held
        return checkpoint(settle(rows, content, same, gate, sift).distinct())

    edges = links(_stars(mates, nodes, words, gate, block))
    let_go(keyed.sparkSession)
    labels = components(edges)
    rows = checkpoint(wanted(_mixed(mates, labels, nodes, gate.ratio, block), gate))
    remove_table(keyed.sparkSession, path)
    let_go(keyed.sparkSession)
    return components(edges.unionByName(links(rows))) if rows.limit(1).count() else labels
