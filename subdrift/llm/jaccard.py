"""Jaccard join of word n-gram sets, with different ways for small and large sets.

Small sets enumerate their subsets of the size that a link needs: two sets of sizes n and
m link exactly if they share a subset of that size. Large sets scan inverted lists: of
every set only the rarest part is listed, so large that linked sets must meet in it.
The boundary between the two is where the counted cost of both is least. Rarity is exact:
every element is first exchanged once per block of documents (``exchange``), which tells
those of one document only from repeated ones, and these by the number of blocks that hold them;
elements of one document lead the order and are never listed.

Lists are not turned into all their pairs: some lists of every document first check their
documents against the smallest one; then all lists that still hold documents of
different components have their pairs across components checked. Elements are listed with
their place in the set by rarity: the first common element of two sets must leave enough
behind it on both sides. A set looks for partners that are not larger, which have to
list fewer elements than the set itself. Pairs are first compared by sketches whose size
follows that of the sets, which lose no link; texts are fetched for what is left.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdrift.llm.common import batches_of, steps, text_column, utf8, written
from subdrift.llm.components import components
from subdrift.llm.exchange import among, answered_levels, blocked, distinct_keys, mixed, repeated_keys
from subdrift.llm.repeated_words import Words

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Sizes that may be taken for small; their subsets stay few.
_LARGEST_SMALL = 12
# Text of a block: its elements take about as many bytes again, several times while they are sorted.
BLOCK_BYTES = 4 << 20
# Bits of a sketch for each element of its set.
_BITS_EACH = 4
# Numbers of blocks that tell frequent elements from rarer ones.
_LEVELS = tuple(1 << k for k in range(32))
# Ids up to so many bytes are broadcast to fetch their texts.
_BROADCAST_BYTES = 16 << 20
# Partial sums of counters are added up in two steps, the first in so many groups.
_SPREAD = 256
# Lists of a document that are tried first; all others follow, so this only changes the cost.
_TRIED_FIRST = 4
# Pairs of texts that a task holds at a time.
_PAIR_ROWS = 256


@dataclass(frozen=True)
class Threshold:
    """Sets link if ``percent`` of their union is shared; ``slots`` counters show how often lists
    meet, for the cost of the boundary. Blocks exchange the high ``told_bits`` of a key: keys that
    are equal there are told as repeated and listed, which changes the cost, not the links."""

    percent: int = 75
    n: int = 5
    slots: int = 1 << 18
    told_bits: int = 48

    def shared(self, n: int, m: int) -> int:
        """Elements two linked sets of these sizes share at least."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def listed(self, n: int) -> int:
        """Elements of a set that must be listed."""
        return n - -(-self.percent * n // 100) + 1

    def partners(self, n: int) -> range:
        """Sizes that a set of size n may link with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def told(self, keys: np.ndarray) -> np.ndarray:
        """Keys as blocks exchange them."""
        low = np.uint64(64 - self.told_bits)
        return keys >> low << low

    def subsets(self, n: int, largest: int) -> int:
        return sum(comb(n, self.shared(n, m)) for m in self.partners(n) if m <= largest and self.shared(n, m) <= n)


def shingles(text: bytes, words: Words, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text; of a shorter text, the whole."""
    hashes = words.hashes(text.translate(_LOWER).split())
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    grams = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        grams = grams * _STEP + hashes[i : len(hashes) - width + 1 + i]
    return np.unique(mixed(grams))


def _sets(table: pa.Table, threshold: Threshold):
    words = Words(threshold.n, threshold.n)
    ids = table.column("doc_id").to_pylist() if table.num_rows else []
    texts = table.column("text").cast(pa.binary()).to_pylist() if table.num_rows else []
    for doc_id, text in zip(ids, texts):
        yield doc_id, text, shingles(text, words, threshold.n)


def _statistics(docs: DataFrame, threshold: Threshold, pieces: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Counters of hashed n-grams over all documents, and how many sets have each small size
    (the last place: larger ones). Both are of fixed size."""
    schema = "piece int, counts binary"

    def count(batches):
        slots, sizes = np.zeros(threshold.slots, np.int64), np.zeros(_LARGEST_SMALL + 2, np.int64)
        words = Words(threshold.n, threshold.n)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = shingles(text, words, threshold.n)
                np.add.at(slots, (found % np.uint64(threshold.slots)).astype(np.int64), 1)
                sizes[min(len(found), _LARGEST_SMALL + 1)] += 1
        parts = [*np.split(slots, pieces), sizes]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            names=["piece", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, schema).withColumn("spread", F.pmod(F.spark_partition_id(), F.lit(_SPREAD)))
    partial = counted.groupBy("piece", "spread").applyInArrow(add, schema)
    rows = partial.groupBy("piece").applyInArrow(add, schema).collect()
    parts = {r["piece"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    if not parts:
        return np.zeros(threshold.slots, np.int64), np.zeros(_LARGEST_SMALL + 2, np.int64)
    return np.concatenate([parts[i] for i in range(pieces)]), parts[pieces]


def boundary(sizes: np.ndarray, slots: np.ndarray, threshold: Threshold) -> int:
    """The largest size taken for small: least cost of subsets below and lists above it.

    A subset or a listed element costs one row; a listed element also meets, on average,
    as many others as its counter holds beyond chance, and checks them by their size.
    """
    chance = max(1.0, float(np.median(slots)))
    meets = float((slots.astype(float) ** 2).sum() / max(1, slots.sum()) / chance)

    def cost(x: int) -> float:
        small = sum(sizes[n] * threshold.subsets(n, x) for n in range(1, x + 1))
        large = sum(sizes[n] * threshold.listed(n) * (1 + meets * n / 8) for n in range(x + 1, _LARGEST_SMALL + 1))
        # Small sets that a large one may link with are listed as well.
        both = sum(sizes[n] * threshold.listed(n) for n in range(1, x + 1) if x + 1 in threshold.partners(n))
        return small + large + both

    return min(range(_LARGEST_SMALL + 1), key=cost)


def _subsets(found: np.ndarray, small: int, threshold: Threshold) -> np.ndarray:
    """The keys of a small set: its subsets of every size that a link with a small one needs."""
    n, keys = len(found), [np.zeros(0, np.uint64)]
    if 0 < n <= small:
        values = found.tolist()
        for m in threshold.partners(n):
            share = threshold.shared(n, m)
            if m <= small and share <= min(n, m):
                # Both sizes are part of the key, so its sets link without further elements.
                kind = np.uint64((min(n, m) << 16) + (max(n, m) << 8) + 1)
                for subset in combinations(values, share):
                    key = np.array([kind], np.uint64)
                    for v in subset:
                        key = mixed(key * _STEP + np.uint64(v))
                    keys.append(key)
    return np.concatenate(keys)


def _is_listed(n: int, small: int, threshold: Threshold) -> bool:
    return n > small or (n > 0 and max(threshold.partners(n)) > small)


def _keys(
    found: np.ndarray, repeated: np.ndarray, levels: np.ndarray, small: int, threshold: Threshold
) -> tuple[np.ndarray, np.ndarray]:
    """The repeated keys of a set, sorted: subsets of a small one, the rarest elements of a large
    one; and the places of the elements by rarity (below 0: a subset)."""
    subsets = _subsets(found, small, threshold)
    keys, places = [subsets[among(threshold.told(subsets), repeated)[0]]], []
    places.append(np.full(len(keys[0]), -1, np.int32))
    n = len(found)
    if _is_listed(n, small, threshold):
        there, at = among(threshold.told(found), repeated)
        level = np.where(there, 1 + levels[at].astype(np.int64), 0) if len(repeated) else np.zeros(n, np.int64)
        order = np.lexsort((found, level))[: threshold.listed(n)]
        place = np.flatnonzero(there[order]).astype(np.int32)
        keys.append(found[order[place]])
        places.append(place)
    distinct, first = np.unique(np.concatenate(keys), return_index=True)
    return distinct, np.concatenate(places)[first]


def jaccard_components(
    documents: DataFrame, threshold: Threshold = Threshold(), block_bytes: int = BLOCK_BYTES, small: int | None = None
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents`` (``doc_id``, ``text``).

    ASCII letters are lowered, words parted by ASCII white space. A null or empty text and
    one without words has an empty set and links with nothing. Rows of equal id are one
    node of the links, each with the size of its own set; a row without an id links with
    nothing and has no component. Other columns are ignored; an empty table gives an empty
    result. ``small`` sets the boundary instead of the counted costs.
    """
    blocks, n_blocks = blocked(documents, block_bytes)
    slots, sizes = _statistics(blocks, threshold)
    limit = boundary(sizes, slots, threshold) if small is None else small

    def keys_of(table: pa.Table):
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for doc_id, _, found in _sets(table, threshold):
            if doc_id is not None:
                keys.append(_subsets(found, limit, threshold))
                owners.append(np.full(len(keys[-1]), doc_id, np.int64))
                keys.append(found if _is_listed(len(found), limit, threshold) else found[:0])
                owners.append(np.full(len(keys[-1]), doc_id, np.int64))
        return distinct_keys(threshold.told(np.concatenate(keys)), np.concatenate(owners))

    def describe(docs: pa.Table, told: pa.Table) -> pa.Table:
        repeated, levels = answered_levels(told)
        out = {"doc_id": [], "n_shingles": [], "content": [], "keys": [], "places": [], "parity": []}
        seen = set()  # equal rows are in one block
        for doc_id, text, found in _sets(docs, threshold):
            content = _digest(found)
            keys, places = found[:0], np.zeros(0, np.int32)
            if doc_id is not None and (doc_id, content) not in seen:
                seen.add((doc_id, content))
                keys, places = _keys(found, repeated, levels, limit, threshold)
            out["doc_id"].append(doc_id)
            out["n_shingles"].append(len(found))
            out["content"].append(content)
            out["keys"].append(keys.view(np.int64))
            out["places"].append(places)
            out["parity"].append(_parity(found) if len(keys) else None)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})

    repeated = repeated_keys(blocks, n_blocks, keys_of, _LEVELS)
    schema = "doc_id long, n_shingles long, content binary, keys array<long>, places array<int>, parity array<long>"
    described = written(
        blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(describe, schema), "described"
    )
    # Equal sets link to the smallest id that has them; only that one goes on.
    counted = described.where("n_shingles > 0 and doc_id is not null").select("doc_id", "content")
    first = written(counted.groupBy("content").agg(F.min("doc_id").alias("first")), "first")
    equal = written(
        counted.join(first, "content").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")),
        "equal",
    )
    chosen = written(
        described.where(F.size("keys") > 0)
        .select("content", "doc_id", F.col("n_shingles").alias("n"), "keys", "places", "parity")
        .join(first.withColumnRenamed("first", "doc_id"), ["content", "doc_id"], "left_semi"),
        "chosen",
    )

    listed = F.explode(F.arrays_zip("keys", "places")).alias("at")
    entry = ["at.keys as key", "at.places as place", "doc_id", "n"]
    tried = chosen.withColumns({c: F.slice(c, 1, _TRIED_FIRST) for c in ("keys", "places")}).select(listed, "doc_id", "n").selectExpr(*entry)
    heads = written(tried.groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "place"), "doc_id").alias("head")), "heads")
    starred = (
        tried.join(heads.select("key", *[F.col(f"head.{c}").alias(b) for c, b in (("doc_id", "b"), ("n", "n_b"), ("place", "place_b"))]), "key")
        .where((F.col("doc_id") != F.col("b")) & _may_link(threshold))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
        .distinct()
    )
    checked = written(starred, "pairs")
    links = linked(checked, chosen, blocks, threshold)

    # All lists, for what the first ones have not joined.
    parts = components(links).withColumnRenamed("node", "doc_id")
    labelled = written(
        chosen.join(parts, "doc_id", "left").select("doc_id", "n", "keys", "places", F.coalesce("component", "doc_id").alias("component")),
        "labelled",
    )
    lists = labelled.select(listed, "doc_id", "n", "component").selectExpr(*entry, "component")
    spread = lists.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left = written(lists.join(written(spread.where("low < high").select("key"), "open"), "key"), "left")
    # Partners that are not larger: their first common element stands among still fewer of theirs.
    smaller = left.where(F.col("place") < 0).unionByName(left.where((F.col("place") >= 0) & _leaves_enough(threshold, "n", "n", "place")))
    smaller = smaller.select("key", *[F.col(c).alias(f"{c}_b" if c != "doc_id" else "b") for c in ("doc_id", "n", "place", "component")])
    across = (
        left.join(smaller, "key")
        .where((F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("doc_id") < F.col("b"))))
        .where((F.col("component") != F.col("component_b")) & _may_link(threshold))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
        .distinct()
    )
    unchecked = written(across.join(checked, ["a", "b"], "left_anti"), "pairs")
    more = linked(unchecked, chosen, blocks, threshold)
    final = written(components(links.union(more).union(equal)), "components")
    return described.select("doc_id", "n_shingles").join(final, described["doc_id"] == final["node"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def _shared(threshold: Threshold, n: str, m: str):
    return F.ceil(threshold.percent * (F.col(n) + F.col(m)) / F.lit(100 + threshold.percent))


def _leaves_enough(threshold: Threshold, n: str, m: str, place: str):
    """Whether a common element at this place, the first one, leaves a set of size ``n`` enough for a
    link with one of size ``m``."""
    return F.col(n) - F.col(place) >= _shared(threshold, n, m)


def _may_link(threshold: Threshold):
    """What sizes and places of two entries of a list tell (``n``, ``place``, ``n_b``, ``place_b``)."""
    sizes_fit = 100 * F.least("n", "n_b") >= threshold.percent * F.greatest("n", "n_b")
    enough = _leaves_enough(threshold, "n", "n_b", "place") & _leaves_enough(threshold, "n_b", "n", "place_b")
    return sizes_fit & ((F.col("place") < 0) | (F.col("place_b") < 0) | enough)


def _parity(found: np.ndarray) -> np.ndarray:
    """For each of some slots, whether an odd number of elements falls there. The number of
    slots is a power of two; half as many give the halves of the sketch laid over each other."""
    bits = 1 << max(8, int(_BITS_EACH * len(found) - 1).bit_length())
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digest(found: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def linked(pairs: DataFrame, chosen: DataFrame, documents: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough, by their sketches, then by their
    texts; written, since a task holds the texts of few pairs at a time only while this runs."""
    sketch = lambda side: chosen.select(*[F.col(c).alias(f"{c}_{side}") for c in ("n", "parity")], F.col("doc_id").alias(side))
    # Linked sets differ in so many elements at most, and parities in no more bits than the
    # sets in elements. Of two sizes that fit one sketch is at most twice as long.
    together = F.col("n_a") + F.col("n_b")
    apart = together - 2 * F.ceil(threshold.percent * together / F.lit(100 + threshold.percent))
    shorter = F.least(F.size("parity_a"), F.size("parity_b"))

    def halved(name: str):
        half = F.zip_with(F.slice(name, 1, shorter), F.slice(name, shorter + 1, shorter), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > shorter, half).otherwise(F.col(name))

    bits = F.zip_with(halved("parity_a"), halved("parity_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differing = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    sketched = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(F.size("parity_a") <= 2 * F.size("parity_b"))
    likely = written(sketched.where((F.size("parity_b") <= 2 * F.size("parity_a")) & (differing <= apart)).select("a", "b").distinct(), "likely")

    # Texts of the documents that are left, whose ids are broadcast if they are few.
    ids = written(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "ids")
    texts = written(documents.select("doc_id", "text").join(_broadcast_if_few(ids), "doc_id", "left_semi").distinct(), "texts")
    second = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches):
        words = Words(threshold.n, threshold.n)
        held, of = None, None
        for batch in steps(steps(batches, "text_a"), "text_b"):
            keep = []
            for text_a, text_b in zip(utf8(batch, "text_a"), utf8(batch, "text_b")):
                if of != text_a:  # pairs of one document mostly come one after another
                    held, of = shingles(text_a, words, threshold.n), text_a
                other = shingles(text_b, words, threshold.n)
                shared = int(among(other, held)[0].sum())
                keep.append(100 * shared >= threshold.percent * (len(held) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with batches_of(pairs.sparkSession, _PAIR_ROWS):
        return written(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "links")


def _broadcast_if_few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if 8 * ids.count() <= _BROADCAST_BYTES else ids


def one_of_each(documents: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """The rows of ``documents`` without those linked to a smaller id. Of rows of equal id the one
    with the least digest of all its columns stays; rows without an id stay.

    Ids that go or come several times are broadcast if they are few, so that whole rows need no
    exchange; else they are joined like any table."""
    found = written(jaccard_components(documents, threshold), "found")
    gone = _broadcast_if_few(written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    rows = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    several = _broadcast_if_few(written(rows.where("_rows > 1").select("doc_id"), "several"))
    named = documents.where("doc_id is not null")
    single = named.join(gone, "doc_id", "left_anti").join(several, "doc_id", "left_anti")
    digest = F.md5(F.to_json(F.struct(*[F.col(c) for c in documents.columns]), {"ignoreNullFields": "false"}))
    repeated = named.join(several, "doc_id", "left_semi").withColumn("_digest", digest)
    least = written(repeated.groupBy("doc_id").agg(F.min("_digest").alias("_digest")), "least")
    chosen = repeated.join(least, ["doc_id", "_digest"], "left_semi").drop("_digest").dropDuplicates(["doc_id"])
    return single.select(documents.columns).unionByName(chosen.select(documents.columns)).unionByName(documents.where("doc_id is null"))
