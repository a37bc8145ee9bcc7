import hashlib
import re

import pytest

from snapweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, t in items:
            iw = words(t)
            k = min(n, len(iw))
            wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Item"), (10, "é ß 12 fünf"), (3, ""), (4, None), (None, "x y"), (5, "two three four five six seven eight nine ten eleven other words"), (2, "again a short")]
DOCS = [
    (1, "zero ONE two, three four five six seven eight nine ten eleven -- short item! short item"), (2, None), (3, ""), (4, "one two three four five six seven eight nine"),
    (5, "É ß 12 fünf and é ß 12 fünf"), (6, "short. item"), (6, "short. item"), (7, "word " * 5000 + "one two three four five six seven eight nine ten"), (None, "again a short"),
]


@pytest.mark.parametrize("most", [4_000_000, 20])
def test_against_brute_force(spark, most):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, n_words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination_report(docs, items, max_broadcast_words=most).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(DOCS, [i for i in ITEMS if i[0] is not None])))


def test_given_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {tuple(r) for r in decontam.contamination_report(docs, items).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == set(want) and any(r[-1] for r in want)


def test_empty_tables_and_dropping(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontam.contamination_report(docs, none).collect())
    assert decontam.contamination_report(docs.limit(0), none).collect() == []
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
