"""Ranked lexical search: Block-Max MaxScore over the shards of an inverted index.

Every task turns its documents into shards of bounded text. A shard has one row per term:
the postings in compressed blocks and, for each block, its last document and the pairs of
(occurrences, length) no other posting of the block exceeds in both, so that the bound of a
block is known for any corpus statistics, which are only complete when all shards are.

A search takes the lists of the queries' terms only. In a shard, the bounds of whole lists
part a query's terms into essential ones, of which a document needs at least one to
enter the heap, and others. Windows of documents are scored over the essential lists; the
others are gone through from the largest bound down, and a candidate whose block
maximum cannot lift it into the heap goes before that block is decompressed. The heaps of
all shards are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subdrift.llm.common import shared_folder, steps, text_column, utf8, written

# Bytes that part terms, and the constants of the score.
_LOWER_OR_SPACE = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
SCALE, STEEPNESS, LENGTH_SHARE = 1000, 8, 75

BLOCK = 128  # postings
FIRST_WINDOW, WINDOW = 256, 1024  # documents
GROUPS_A_TASK = 4  # shards, each with a block of queries

ROW = (
    "shard long, term binary, df int, last array<int>, ends array<int>, impact_ends array<int>, impacts array<long>, "
    "postings binary, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>"
)
_LIST = ["shard", "term", "df", "last", "ends", "impact_ends", "impacts", "postings"]


@dataclass(frozen=True)
class Settings:
    """Shards hold about ``shard_bytes`` of text (at least one document). Queries are dealt
    over blocks of about ``query_bytes``; their terms are broadcast up to
    ``broadcast_bytes`` and joined by a shuffle beyond."""

    k: int = 10
    shard_bytes: int = 8 << 20
    query_bytes: int = 256 << 10
    broadcast_bytes: int = 16 << 20


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lowered) and digits and of all other characters beyond ASCII."""
    return text.translate(_LOWER_OR_SPACE).split()


# -- the index ---------------------------------------------------------------


def build_index(documents: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """Writes an index of every row of ``documents`` (``doc_id``, ``text``) to ``path``, a new
    folder that all executors share, in one pass and without a shuffle, and returns it.

    A null, empty or blank text and one without terms has no postings. Rows are documents
    of their own, with equal and null ids too. Other columns are ignored; an empty table
    gives an empty index.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(steps(_joined(batches, settings.shard_bytes), "text", settings.shard_bytes)):
            yield from shard_rows(first + number, part.column("doc_id"), utf8(part, "text"))

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    docs.mapInArrow(index, ROW).write.parquet(path)
    return open_index(documents.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Puts small batches together up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def shard_rows(shard: int, doc_ids: pa.Array, texts: list[bytes], rows_each: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: first the shard itself with its documents, then a row per term."""
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in terms_of(t)], np.int32) for t in texts]
    lengths = np.array([len(x) for x in numbers], np.int64)
    kinds = pa.schema([(n, t) for n, t in zip((x.split()[0] for x in ROW.split(", ")), _KINDS)])

    def rows(n: int, **columns) -> pa.RecordBatch:
        shard_column = pa.array(np.full(n, shard), pa.int64())
        given = {"shard": shard_column, **columns}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds)

    documents = {"doc_ids": pa.array([doc_ids.to_pylist()], kinds.field("doc_ids").type), "lengths": pa.array([lengths], kinds.field("lengths").type)}
    yield rows(1, n_docs=pa.array([int((lengths > 0).sum())]), n_terms=pa.array([int(lengths.sum())]), **documents)
    if not vocabulary:
        return

    # Postings by term, then document.
    n_docs = len(texts)
    key, tf = np.unique(
        np.concatenate(numbers).astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), lengths), return_counts=True
    )
    term, doc = key // n_docs, key % n_docs
    lists = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(lists, append=len(term))
    within = np.arange(len(term)) - np.repeat(lists, df)
    blocks = np.flatnonzero(within % BLOCK == 0)
    block_ends = np.append(blocks[1:], len(term))
    blocks_of = -(-df // BLOCK)

    gap = np.diff(doc, prepend=-1)
    gap[lists] = doc[lists] + 1
    packed, ends = pack(np.stack([gap, tf], axis=1).ravel())
    ends = ends[1::2]  # of whole postings
    list_bytes = np.append(0, ends[np.append(lists[1:], len(term)) - 1])

    # Of each block the postings that no shorter document has as often.
    block = np.repeat(np.arange(len(blocks)), block_ends - blocks)
    shortest = np.empty(n_docs, np.int64)
    shortest[np.argsort(lengths, kind="stable")] = np.arange(n_docs)
    order = np.argsort(block * n_docs + shortest[doc], kind="stable")
    wide = int(tf.max()) + 1
    highest = np.maximum.accumulate(block[order] * wide + tf[order])
    kept = np.append(True, highest[1:] > highest[:-1])
    front = order[kept]
    impacts = (tf[front] << 32) | np.minimum(lengths[doc[front]], (1 << 32) - 1)
    impact_ends = np.cumsum(np.bincount(block[front], minlength=len(blocks)))

    first_block = np.append(0, np.cumsum(blocks_of))
    first_impact = np.append(0, impact_ends)[first_block]
    names = pa.array(list(vocabulary), pa.binary())
    bodies = pa.Array.from_buffers(
        pa.binary(), len(df), [None, pa.py_buffer(list_bytes.astype(np.int32)), pa.py_buffer(packed)]
    )
    by_block = lambda x: pa.ListArray.from_arrays(pa.array(first_block, pa.int32()), pa.array(x, pa.int32()))
    yield from _sliced(
        rows(
            len(df),
            term=names,
            df=pa.array(df, pa.int32()),
            last=by_block(doc[block_ends - 1]),
            ends=by_block(ends[block_ends - 1] - np.repeat(list_bytes[:-1], blocks_of)),
            impact_ends=by_block(impact_ends - np.repeat(first_impact[:-1], blocks_of)),
            impacts=pa.ListArray.from_arrays(pa.array(first_impact, pa.int32()), pa.array(impacts, pa.int64())),
            postings=bodies,
        ),
        rows_each,
    )


_KINDS = [
    pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
    pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
]


def _sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, the last of each below 128; and where each ends."""
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >> bits > 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for k in range(int(sizes.max()) if len(sizes) else 0):
        there = sizes > k
        part = (values[there] >> 7 * k) & 127
        out[starts[there] + k] = part + 128 * (sizes[there] > k + 1)
    return out, ends


def unpack(packed: np.ndarray) -> np.ndarray:
    if not len(packed) or packed.max() < 128:
        return packed.astype(np.int64)
    starts = np.append(0, np.flatnonzero(packed < 128)[:-1] + 1)
    place = np.arange(len(packed)) - np.repeat(starts, np.diff(starts, append=len(packed)))
    return np.add.reduceat((packed & 127).astype(np.int64) << 7 * place, starts)


# -- a shard ------------------------------------------------------------------


class Postings:
    """The list of one term in a shard. Contributions are those of weight 1."""

    def __init__(self, row: dict, norm: np.ndarray, norm_of):
        self.last = np.array(row["last"], np.int64)
        self.ends = np.append(0, np.array(row["ends"], np.int64))
        self.packed = np.frombuffer(row["postings"], np.uint8)
        self.norm, self.df, self.weight = norm, row["df"], row["weight"]
        impacts = np.array(row["impacts"], np.int64)
        value = _part(impacts >> 32, norm_of(impacts & ((1 << 32) - 1)))
        self.block_bounds = np.maximum.reduceat(value, np.append(0, row["impact_ends"][:-1]).astype(np.int64))
        self.bound = int(self.block_bounds.max())
        self.docs = np.zeros(self.df, np.int64)
        self.parts = np.zeros(self.df, np.int64)
        self.known = np.zeros(len(self.last), bool)

    def open(self, first: int, stop: int) -> slice:
        """Decompresses the blocks of a range that are not yet; the place of their postings."""
        at = slice(first * BLOCK, min(stop * BLOCK, self.df))
        if not self.known[first:stop].all():
            values = unpack(self.packed[self.ends[first] : self.ends[stop]])
            docs = np.cumsum(values[::2]) + (self.last[first - 1] if first else -1)
            self.docs[at], self.parts[at] = docs, _part(values[1::2], self.norm[docs])
            self.known[first:stop] = True
        return at


def _part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return SCALE**3 * tf // (SCALE * tf + STEEPNESS * norm)


def search_shard(
    lists: list[tuple[int, Postings]], n_docs: int, ids: np.ndarray, k: int, first_window: int = FIRST_WINDOW, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``k`` best documents with a score above 0, best first; equal
    scores by ``ids``. ``lists``: the weight of each term of the query and its postings."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda x: x[0] * x[1].bound)
    reach = np.cumsum([w * p.bound for w, p in lists])  # of a document in the first lists only
    docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    a, b = 0, min(first_window, n_docs)
    while a < b:
        essential = int(np.searchsorted(reach, least, "left"))
        if essential == len(lists):
            break  # no document can enter any more
        gathered = np.zeros(b - a, np.int64)
        for w, p in lists[essential:]:
            first, stop = np.searchsorted(p.last, (a, b - 1))
            at = p.open(first, min(stop + 1, len(p.last)))
            there = p.docs[at]
            low, high = np.searchsorted(there, (a, b))
            gathered[there[low:high] - a] += w * p.parts[at][low:high]
        found = np.flatnonzero(gathered)
        for j in range(essential - 1, -1, -1):
            found = found[gathered[found] + reach[j] >= least]
            if not len(found):
                break
            found = _add(lists[j], int(reach[j - 1]) if j else 0, found, gathered, a, least)
        if len(found):
            docs, scores = np.append(docs, found + a), np.append(scores, gathered[found])
            best = np.lexsort((ids[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            least = int(scores[-1]) if len(scores) == k else 1
        a, b = b, min(b + window, n_docs)
    return docs, scores


def _add(entry: tuple[int, Postings], rest: int, found: np.ndarray, gathered: np.ndarray, a: int, least: int) -> np.ndarray:
    """Adds a list to the candidates its block maxima leave, and returns these."""
    w, p = entry
    block = np.searchsorted(p.last, found + a)
    inside = block < len(p.last)
    bound = np.where(inside, w * p.block_bounds[np.minimum(block, len(p.last) - 1)], 0)
    left = gathered[found] + bound + rest >= least
    found, block, inside = found[left], block[left], inside[left]
    for one in np.unique(block[inside]).tolist():
        at = p.open(one, one + 1)
        own = found[block == one]
        place = np.searchsorted(p.docs[at], own + a)
        hit = p.docs[at][place] == own + a
        gathered[own[hit]] += w * p.parts[at][place[hit]]
    return found


# -- the search ---------------------------------------------------------------


def search(index: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score`` for every row of ``queries`` (``item_id``, ``text``): the
    ``k`` best documents of the index with a score above 0, or all if there are fewer.

    Equal scores are ranked by ascending document id, null ids last. A query row that stands
    twice is asked once; rows of equal id and different texts are ranked each for itself. A
    null id is an id like any other; a text that is null or has no terms finds nothing,
    as does every query in an empty index. Other columns are ignored.
    """
    spark = index.sparkSession
    asked = written(_queries(queries, settings), "queries")
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    totals = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    if not n_terms:
        return empty

    # The lists of the terms that are asked for, with the weights of the terms.
    wanted = asked.select("block", F.explode("terms").alias("t")).select("block", "t.term").distinct()
    distinct = written(wanted.select("term").distinct(), "terms")
    size = distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    lists = index.where("term is not null").select(_LIST)
    found = written(lists.join(F.broadcast(distinct) if size <= settings.broadcast_bytes else distinct, "term"), "lists")
    everywhere = F.sum(F.col("df").cast("long"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * everywhere + 1)))
    weights = found.groupBy("term").agg(weight.alias("weight"))
    per_block = found.join(weights, "term").join(wanted, "term")

    # Beside them, for every block of queries and shard: the queries and the shard's documents.
    shards = index.where("term is null").select("shard", "doc_ids", "lengths")
    blocks = asked.groupBy("block").agg(F.collect_list(F.struct("item_id", "query", "terms")).alias("queries"))
    beside = found.select("shard", "term").join(wanted, "term").select("block", "shard").distinct().join(shards, "shard").join(blocks, "block")
    beside = written(beside.withColumnsRenamed({"block": "of_block", "shard": "of_shard"}), "beside")

    def best(lists: pa.Table, beside: pa.Table) -> pa.Table:
        return _search_group(lists, beside, n_docs, n_terms, settings.k)

    # Searching costs much more than its bytes show: a few groups a task, however small they are.
    n_tasks = -(-beside.select("of_block", "of_shard").count() // GROUPS_A_TASK)
    heaps = (
        per_block.repartition(max(1, n_tasks), "block", "shard")
        .groupBy("block", "shard")
        .cogroup(beside.repartition(max(1, n_tasks), "of_block", "of_shard").groupBy("of_block", "of_shard"))
        .applyInArrow(best, "item_id long, query string, doc_id long, score long")
    )
    ranked = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= settings.k).select("item_id", "rank", "doc_id", "score")


def search_documents(documents: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``search`` over an index of ``documents`` made for it in the shared folder."""
    return search(build_index(documents, f"{shared_folder(documents.sparkSession)}/index", settings), queries, settings)


def _queries(queries: DataFrame, settings: Settings) -> DataFrame:
    """Queries with their terms, dealt over blocks of bounded size."""
    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), text_column().alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // settings.query_bytes))

    def split(batches):
        for batch in batches:
            for part in steps([batch], "text"):
                terms = []
                for text in utf8(part, "text"):
                    names, times = np.unique(np.array(terms_of(text), object), return_counts=True)
                    terms.append([{"term": n, "times": t} for n, t in zip(names.tolist(), times.tolist())])
                kind = pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("item_id", "query", "block")), pa.array(terms, kind)],
                    names=["item_id", "query", "block", "terms"],
                )

    keyed = rows.select("item_id", F.md5("text").alias("query"), F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"), "text")
    return keyed.mapInArrow(split, "item_id long, query string, block long, terms array<struct<term:binary,times:long>>").where(F.size("terms") > 0)


def _search_group(lists: pa.Table, beside: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    out = {"item_id": [], "query": [], "doc_id": [], "score": []}
    if lists.num_rows and beside.num_rows:
        here = beside.select(["doc_ids", "lengths", "queries"]).to_pylist()[0]
        ids = here["doc_ids"]
        # Null ids are ranked behind all others.
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
        norm_of = lambda n: SCALE // 10 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
        norm = norm_of(np.array(here["lengths"], np.int64))
        postings = {row["term"]: Postings(row, norm, norm_of) for row in lists.to_pylist()}
        for query in here["queries"]:
            own = [(t["times"] * p.weight, p) for t in query["terms"] if (p := postings.get(t["term"]))]
            docs, scores = search_shard(own, len(ids), rank, k)
            out["item_id"] += [query["item_id"]] * len(docs)
            out["query"] += [query["query"]] * len(docs)
            out["doc_id"] += [ids[d] for d in docs.tolist()]
            out["score"] += scores.tolist()
    return pa.table({c: pa.array(v, pa.string() if c == "query" else pa.int64()) for c, v in out.items()})
