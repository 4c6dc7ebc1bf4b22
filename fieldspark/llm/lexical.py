"""Exact ranked search over an inverted index with geometrically blocked postings.

Documents are indexed in shards of a bounded size. In a shard the posting list of each
query term is cut into blocks of similar documents: some of its documents are taken as
centres and every document goes to the centre whose impacts are most like its own. A
block keeps, for every term, the largest impact that one of its documents has. No
document of a block can score more than the query does on these maxima, so a block is
passed over only if that bound is below the score that the k-th best document is known
to reach; the others are scored exactly, best bound first. So are all documents of a
list of very few.

A sixteenth of the shards is searched first. What their k-th best documents score is the
bound that the search of all shards starts with.

Terms are named by 64-bit hashes.
"""

import json
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.common import iterate_batches, map_batches, mix
from fieldspark.llm.words import ALPHANUMERIC, word_hashes
from fieldspark.storage import new_path

BATCH = 1 << 20
# Items searched together have at most about so many terms; the others follow in turn.
GROUP_TERMS = 8192
SHARD_DOCS = 2048
SHARD_CELLS = 1 << 23
BLOCK = 96
# Posting lists of so few documents have no maxima: those would be longer than the list.
SHORT = 8
# Maxima are kept in steps of so much, rounded up, so that each fits a byte.
STEP = 4096
SKETCH = 32
# Bytes of a row group of the index, a few shards.
ROW_GROUP = 8 << 20
SEED_SHARDS = 16
BOUNDLESS = np.iinfo(np.int64).max


# -- the queries ---------------------------------------------------------------


class Queries:
    """Some items, their terms and how often each item has them."""

    def __init__(self, items):
        self.items = [item for item, _ in items]
        hashes, counts = word_hashes(pa.array([text or "" for _, text in items], pa.string()), ALPHANUMERIC)
        self.terms = np.unique(hashes)
        places = np.searchsorted(self.terms, hashes)
        self.wanted = [np.unique(own, return_counts=True) for own in np.split(places, np.cumsum(counts)[:-1])]

    def weighted(self, weights):
        return [(terms, weights[terms] * times) for terms, times in self.wanted]


def groups_of(items, id_col, text_col, most=GROUP_TERMS):
    """Distinct items in groups with about ``most`` terms; one group is held at a time."""
    rows = items.select(
        F.col(id_col).cast("long").alias("item_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    group, terms = [], set()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        group.append((row["item_id"], row["text"]))
        terms.update(word_hashes(pa.array([row["text"]], pa.string()), ALPHANUMERIC)[0].tolist())
        if len(terms) >= most:
            yield Queries(group)
            group, terms = [], set()
    if group:
        yield Queries(group)


# -- the index -----------------------------------------------------------------


def term_counts(docs, terms, id_col="doc_id", text_col="text"):
    """``doc_id, n, places, counts``: the terms in each document, and which of the sorted
    hashes ``terms`` it holds how often. Documents without any term are left out."""

    def count(batch):
        hashes, lengths = word_hashes(batch.column("text"), ALPHANUMERIC)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = np.searchsorted(terms, hashes)
        known = place < len(terms)
        known[known] = terms[place[known]] == hashes[known]
        cells, times = np.unique(doc[known] * max(len(terms), 1) + place[known], return_counts=True)
        keep = np.flatnonzero(lengths)
        offsets = np.searchsorted(cells, np.append(keep, len(lengths)) * max(len(terms), 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
        return {
            "doc_id": batch.column("doc_id").take(pa.array(keep)),
            "n": lengths[keep],
            "places": lists(cells % max(len(terms), 1)),
            "counts": lists(times),
        }

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts.where("text IS NOT NULL"), count, "doc_id long, n long, places array<int>, counts array<int>", BATCH)


def impact(counts, lengths, documents, total):
    """What an occurrence count is worth in a document of a given length, in integers."""
    m = 25 + (75 * lengths * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def cluster(docs, sketches, size=BLOCK):
    """Documents of one posting list in the order of their blocks, and the blocks' ends."""
    n = len(docs)
    if n <= size:
        return docs, np.array([n])
    centres = docs[np.argsort(mix(docs.astype(np.uint64)), kind="stable")[: -(-n // size)]]
    nearest = np.argmax(sketches[docs] @ sketches[centres].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    ends = []
    for end, count in zip(*_runs(nearest[order])):
        # Copies can make one cluster of all; equal parts of it are as good.
        ends.extend(range(end - count + size, end, size))
        ends.append(end)
    return docs[order], np.array(ends)


def _runs(values):
    last = np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1) + 1
    return last.tolist(), np.diff(last, prepend=0).tolist()


def build_shard(doc, place, value, n_docs, n_terms):
    """The blocks of a shard's posting lists, given its cells in the order of documents."""
    coarse = np.zeros((n_docs, n_terms), np.uint8)
    coarse[doc, place] = -(-value // STEP)
    signs = np.where(mix(np.arange(n_terms * SKETCH, dtype=np.uint64)) & np.uint64(1), 1, -1).reshape(n_terms, SKETCH)
    signs = signs.astype(np.float32)
    parts = [coarse[at : at + 256].astype(np.float32) @ signs for at in range(0, n_docs, 256)]
    sketches = np.concatenate(parts)
    sketches /= np.linalg.norm(sketches, axis=1, keepdims=True) + 1e-9
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(n_terms + 1))
    members, ends, first_block, base = [], [], [0], 0
    for term in range(n_terms):
        docs = doc[order[starts[term] : starts[term + 1]]]
        own = []
        if len(docs):
            docs, own = cluster(docs, sketches)
            members.append(docs)
            ends.append(own + base)
            base += len(docs)
        first_block.append(first_block[-1] + len(own))
    members = np.concatenate([np.zeros(0, np.int32), *members]).astype(np.int32)
    ends = np.concatenate([np.zeros(0, np.int64), *ends])
    first_block = np.array(first_block)
    # The block's row among the maxima, or -1.
    begins = np.append(0, ends[:-1])[: len(ends)]
    in_list = np.repeat(np.diff(starts), np.diff(first_block))
    kept = np.flatnonzero(in_list > SHORT)
    summary = np.full(len(ends), -1, np.int32)
    summary[kept] = np.arange(len(kept))
    maxima = np.zeros((len(kept), n_terms), np.uint8)
    for row, block in enumerate(kept.tolist()):
        coarse[members[begins[block] : ends[block]]].max(axis=0, out=maxima[row])
    return {"members": members, "ends": ends, "maxima": maxima, "summary": summary, "first_block": first_block}


def to_bytes(arrays):
    """Arrays as one compressed value."""
    head = json.dumps([(n, a.dtype.str, a.shape) for n, a in arrays.items()]).encode()
    out = zstandard.ZstdCompressor(1).compressobj()
    parts = [out.compress(len(head).to_bytes(8, "little") + head)]
    parts += [out.compress(np.ascontiguousarray(a)) for a in arrays.values() if a.size]
    return b"".join([*parts, out.flush()])


def from_bytes(value):
    data = zstandard.ZstdDecompressor().decompressobj().decompress(value)
    at = 8 + int.from_bytes(data[:8], "little")
    arrays = {}
    for name, kind, shape in json.loads(data[8:at]):
        count = math.prod(shape)
        arrays[name] = np.frombuffer(data, kind, count, at).reshape(shape)
        at += count * np.dtype(kind).itemsize
    return arrays


def write_index(counted, n_terms, documents, total, path):
    """Shards of documents with their blocked posting lists, as rows of a table."""
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // max(n_terms, 1)))

    def shard(rows, number):
        lengths = np.array(rows["n"], np.int64)
        doc = np.repeat(np.arange(len(lengths)), [len(p) for p in rows["places"]])
        place = np.concatenate([np.zeros(0, np.int64), *rows["places"]]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.int64), *rows["counts"]]).astype(np.int64)
        value = impact(count, lengths[doc], documents, total)
        null = np.array([i is None for i in rows["doc_id"]])
        arrays = build_shard(doc, place, value, len(lengths), n_terms)
        arrays |= {
            "doc": doc.astype(np.int32), "place": place.astype(np.int32), "value": value.astype(np.int32),
            "null": null, "id": np.array([i or 0 for i in rows["doc_id"]], np.int64),
        }
        seed = int(mix(np.array([number]))[0]) % SEED_SHARDS == 0
        return {"seed": [seed], "shard": [to_bytes(arrays)]}

    def shards(batches):
        number = TaskContext.get().partitionId() << 32
        held = {c: [] for c in ("doc_id", "n", "places", "counts")}
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                for c in ("doc_id", "n"):
                    held[c].extend(part.column(c).to_pylist())
                for c in ("places", "counts"):
                    held[c].extend(x.values.to_numpy() for x in part.column(c))
                if len(held["n"]) >= most:
                    yield shard({c: v[:most] for c, v in held.items()}, number)
                    held, number = {c: v[most:] for c, v in held.items()}, number + 1
        if held["n"]:
            yield shard(held, number)

    # Documents with none of the terms count above but are in no list.
    listed = counted.where(F.size("places") > 0)
    rows = iterate_batches(listed, shards, "seed boolean, shard binary", BATCH)
    # Values of megabytes: a row group is closed as soon as it is full, and its values are
    # compressed already.
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "compression": "none"}
    rows.write.options(**options).parquet(path)


# -- the search ----------------------------------------------------------------


def search_shard(index, wanted, least, best, k):
    """Add the shard's documents that may be among the ``k`` best of each query.

    ``least`` holds a score that the k-th best of all documents is known to reach;
    ``best`` a list of (score, has no id, id) for each query, best first, which is
    brought up to date. Returns how many blocks were looked at and how many scored.
    """
    n_docs, n_terms = len(index["id"]), index["maxima"].shape[1]
    values = np.zeros((n_docs, n_terms), np.int32)
    values[index["doc"], index["place"]] = index["value"]
    starts, first = np.append(0, index["ends"][:-1]), index["first_block"]
    seen_blocks = scored_blocks = 0
    for q, (terms, weights) in enumerate(wanted):
        blocks = np.concatenate([np.zeros(0, np.int64), *[np.arange(first[t], first[t + 1]) for t in terms]])
        if not len(blocks):
            continue
        row = index["summary"][blocks]
        bounds = np.full(len(blocks), BOUNDLESS)
        told = np.flatnonzero(row >= 0)
        bounds[told] = (index["maxima"][row[told][:, None], terms].astype(np.int64) * STEP) @ weights
        order = np.argsort(-bounds, kind="stable")
        blocks, bounds = blocks[order], bounds[order]
        seen = np.zeros(n_docs, dtype=bool)
        seen_blocks += len(blocks)
        at, width = 0, 4
        while at < len(blocks):
            floor = max(least[q], best[q][k - 1][0] if len(best[q]) >= k else 1)
            # A document at the bound itself may still win by its id.
            until = min(at + width, int(np.searchsorted(-bounds, -floor, side="right")))
            if until <= at:
                break
            docs = np.unique(np.concatenate([index["members"][starts[b] : index["ends"][b]] for b in blocks[at:until].tolist()]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            scored_blocks += until - at
            at, width = until, 2 * width
            scores = values[docs[:, None], terms].astype(np.int64) @ weights
            keep = np.flatnonzero((scores >= floor) & (scores > 0))
            if len(keep) > k:
                ids, null = index["id"][docs[keep]], index["null"][docs[keep]]
                keep = keep[np.lexsort((ids, null, -scores[keep]))[:k]]
            new = [(int(scores[i]), bool(index["null"][docs[i]]), int(index["id"][docs[i]])) for i in keep]
            best[q] = sorted([*best[q], *new], key=lambda x: (-x[0], x[1], x[2]))[:k]
    return seen_blocks, scored_blocks


def search_index(shards, wanted, least, k):
    """``query, doc_id, score`` of each task's ``k`` best documents for every query."""

    def search(batches):
        best = [[] for _ in wanted]
        for batch in batches:
            for blob in batch.column("shard"):
                search_shard(from_bytes(blob.as_py()), wanted, least, best, k)
        rows = [(q, None if null else i, score) for q, own in enumerate(best) for score, null, i in own]
        yield {c: [r[j] for r in rows] for j, c in enumerate(("query", "doc_id", "score"))}

    return iterate_batches(shards.select("shard"), search, "query int, doc_id long, score long", BATCH)


def _ranked(found, k):
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs, items, k=10, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
    """``item_id, rank, doc_id, score`` of the ``k`` best documents for each item.

    Null texts and texts without a term are no documents; a document without an id comes
    after those of equal score; each of repeated rows is a document. Items that are
    repeated as a whole count once, and those that share only an id are ranked each for
    itself. Without documents or items the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in groups_of(items, item_col, item_text):
        counted_at, index_at = new_path(spark, "term-counts"), new_path(spark, "blocked-index")
        counted = term_counts(docs, queries.terms, id_col, text_col)
        counted.write.parquet(counted_at)
        counted = spark.read.schema(counted.schema).parquet(counted_at)
        documents, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents or not len(queries.terms):
            continue
        holding = np.zeros(len(queries.terms), np.int64)
        # A number for each term of the group.
        for place, n in counted.select(F.explode("places").alias("place")).groupBy("place").count().collect():
            holding[place] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()])
        write_index(counted, len(queries.terms), documents, total, index_at)
        shards = spark.read.schema("seed boolean, shard binary").parquet(index_at)
        wanted = queries.weighted(weights)
        least = [1] * len(wanted)
        seeds = _ranked(search_index(shards.where("seed"), wanted, least, k), k).where(F.col("rank") == k)
        for query, score in seeds.select("query", "score").collect():
            least[query] = score
        names = spark.createDataFrame(list(enumerate(queries.items)), "query int, item_id long")
        found = _ranked(search_index(shards, wanted, least, k), k).join(F.broadcast(names), "query")
        result = result.union(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return result
