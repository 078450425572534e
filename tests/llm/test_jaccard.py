"""Links and components against comparing all pairs."""

import random
import re

import pyarrow as pa
import pytest

from subdrift.llm import jaccard
from subdrift.llm.common import batches_of
from subdrift.llm.components import components
from subdrift.llm.jaccard import Threshold, jaccard_components, one_of_each
from tests.llm.helpers import awkward, frame, tuples


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    all_sets = [(d, sets(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(all_sets):
        for b, y in all_sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in all_sets), key=repr)


def near_copies(spark):
    """Chains of edits whose ends are not alike, short texts, and a passage many texts share."""
    random.seed(2)
    words = [f"w{i}" for i in range(4000)]
    more, chain = [], random.sample(words, 60)
    for i in range(40):
        more.append((3000 + i, " ".join(chain)))
        chain = list(chain)
        chain[random.randrange(60)] = random.choice(words)
    for i in range(60):
        more.append((3100 + i, " ".join(random.choice(["a", "b", "c"]) for _ in range(random.randint(1, 9)))))
    passage = " ".join(random.sample(words, 40))
    for i in range(50):
        more.append((3200 + i, passage + " " + " ".join(random.sample(words, random.randint(2, 30)))))
    copy = random.sample(words, 80)
    for i in range(50):
        edited = list(copy)
        edited[random.randrange(80)] = "edited"
        more.append((3300 + i, " ".join(edited).upper()))
    return awkward(spark, more)


@pytest.mark.parametrize("small,block_bytes", [(None, 8 << 20), (0, 60_000), (5, 60_000), (12, 60_000)])
def test_components(spark, small, block_bytes):
    rows = near_copies(spark)
    assert tuples(jaccard_components(frame(spark, rows), small=small, block_bytes=block_bytes)) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = near_copies(spark)
    df = frame(spark, rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute(rows) if d is not None and d == c}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 2


def test_sizes_of_linked_sets():
    t = Threshold()
    for n in range(1, 40):
        for m in range(1, 40):
            for shared in range(min(n, m) + 1):
                if 100 * shared >= 75 * (n + m - shared):
                    assert shared >= t.shared(n, m) and m in t.partners(n) and shared > n - t.listed(n)


def test_components_of_links(spark):
    random.seed(6)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)]
    links += [(500, i) for i in range(501, 560)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert tuples(components(spark.createDataFrame(links, "a long, b long"))) == sorted(((x, find(x)) for x in linked), key=repr)


def test_empty_table(spark):
    empty = frame(spark, awkward(spark)).limit(0)
    assert jaccard_components(empty).count() == 0 and one_of_each(empty).count() == 0


def test_words_are_parted_by_ascii_blanks_only(spark):
    """A word with other blanks inside is one word wherever sets are compared."""
    random.seed(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], "  ".join(f"{i}p{random.random()}" for _ in range(40)), *words[30:]])) for i in range(6)]
    assert tuples(jaccard_components(frame(spark, rows))) == brute(rows)
    assert {c for _, _, c in brute(rows)} == {0}


def test_batches_are_cut_by_rows_and_the_setting_comes_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    counted = lambda: [r.n for r in spark.range(3000).coalesce(1).mapInArrow(sizes, "n long").collect()]
    with batches_of(spark, 256):
        assert max(counted()) <= 256
    assert spark.conf.get(name) == before and sum(counted()) == 3000 and max(counted()) > 256


@pytest.mark.parametrize("few", [True, False])
def test_whole_rows_stay_where_they_are_read(spark, monkeypatch, few):
    """Also where Spark takes no table for small: if the ids that go are few, rows are joined where they are read."""
    rows = near_copies(spark)
    df = frame(spark, rows)
    if not few:
        monkeypatch.setattr(jaccard, "_BROADCAST_BYTES", 0)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = one_of_each(df)
        got = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
        plan = one_of_each(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert got == sorted({d for d, _, c in brute(rows) if d is not None and d == c})
    assert few == (not re.search(r"SortMergeJoin \[doc_id#\d+L\], \[doc_id#\d+L\]", plan))


@pytest.mark.parametrize("told_bits", [4, 12, 64])
def test_keys_that_are_told_alike(spark, told_bits):
    rows = near_copies(spark)
    assert tuples(jaccard_components(frame(spark, rows), Threshold(told_bits=told_bits), block_bytes=60_000)) == brute(rows)
