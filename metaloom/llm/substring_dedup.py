"""Substring dedup: repeated token k-mers as edges, compacted to paths, verified at their source coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .words import word_hashes

#: Words of an edge (k-mer), and of the seeds that tell which edges can repeat.
EDGE, SEED = 20, 6
#: Words whose edges one task holds at a time.
CHUNK_WORDS = 2_000_000
#: Text that is hashed in one go.
STEP_BYTES = 4_000_000

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def _rolled(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Mixed hash of each run of `width` words."""
    n, by = len(h) - width + 1, _MUL + _U(2 * salt)
    total = np.zeros(max(n, 0), _U)
    for j in range(width if n > 0 else 0):
        total = total * by + h[j : n + j]
    total = (total ^ (total >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return total ^ (total >> _U(29))


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, made for about 4 MB of text at a time."""
    upto = np.cumsum(pa.compute.binary_length(texts).to_numpy())
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STEP_BYTES, "right")))
        h, sizes = word_hashes(texts.slice(low, high - low).to_pylist())
        yield from np.split(h, np.cumsum(sizes)[:-1])
        low = high


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of `width`, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _seeds(h: np.ndarray, edge: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every seed run, and for each edge the smallest of its seeds: equal edges have equal ones."""
    every = _rolled(h, seed)
    return every, _lowest(every, edge - seed + 1) if len(h) >= edge else every[:0]


def repeated_spans(docs: DataFrame, edge: int = EDGE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", hash_bits: tuple[int, ...] = ()) -> DataFrame:
    """Spans of windows that also start earlier: doc_id, start, n_windows, first_doc, first_start.

    A token k-mer (`edge` words) is an edge of the De Bruijn graph; its earliest coordinate (id, start) is
    its representative. 1. Every document gives the minimal seed hashes of its edges, an eighth of its
    positions; only edges whose seed occurs twice can repeat. 2. Those edges are dealt out by hash, after
    each task has resolved the repeats inside its own documents, and every later occurrence learns an
    earlier coordinate. 3. Runs of successive edges whose earlier coordinates are successive too have no
    branch between them: they compact to one path occurrence. 4. A join on both coordinates rereads the
    words of each span and of its earlier span, as 128-bit digests. Where two differ, edges of different words
    share a hash and may hide a repeat, so steps 2 to 4 are done again with another hash until none differ.
    hash_bits: bits of the first hashes tried, for tests; 64 after those.

    Null id or text: no spans. Rows that repeat an id are one document if their texts are equal, else they have no
    verified spans. Texts shorter than an edge: none. Empty table: no rows. Extra columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null and text is not null")
    kind = source.schema["id"].dataType.simpleString()
    seeds = staged(source.mapInArrow(_seed_rows(edge, seed), f"id {kind}, seeds array<long>, again array<boolean>"), "span-seeds")
    single = seeds.select("id", F.inline(F.arrays_zip("seeds", "again")).alias("seed", "again"))
    times = F.sum(F.when(F.col("again"), 2).otherwise(1))
    twice = staged(single.groupBy("seed").agg(times.alias("n")).where("n > 1").select("seed"), "span-twice")
    of_doc = staged(single.join(twice, "seed").groupBy("id").agg(F.collect_list("seed").alias("seeds")), "span-doc-seeds")

    edges = source.join(of_doc.withColumnRenamed("id", "own"), F.col("id") == F.col("own")).select("id", "text", "seeds")
    for salt, bits in enumerate([*hash_bits, 64, 64, 64]):
        spans = _spans(edges, edge, seed, kind, salt, bits)
        judged = staged(_judged(source, spans, edge), "span-judged")
        if judged.where("not same").isEmpty():
            return judged.where("same").select(F.col("id").alias(id_col), "start", F.col("n").alias("n_windows"), "first_doc", "first_start")
    raise ValueError("three independent hashes collide")


def _spans(edges: DataFrame, edge: int, seed: int, kind: str, salt: int, bits: int) -> DataFrame:
    """Runs of edges whose hashes have an earlier coordinate, with that coordinate."""
    edges = staged(edges.mapInArrow(_edge_rows(edge, seed, kind, salt, bits), f"h long, id {kind}, start int, n int, first_doc {kind}, first_start int"), "span-edges")  # before they are dealt out, the shuffled texts go
    at = F.first(F.struct("id", "start")).over(Window.partitionBy("h").orderBy(F.col("n").isNotNull(), "id", "start"))
    known = F.col("n").isNotNull()
    later = edges.withColumn("first", at).where(known | ~((F.col("first.id") == F.col("id")) & (F.col("first.start") == F.col("start"))))
    later = later.select(
        "id", "start", F.coalesce("n", F.lit(1)).alias("n"), F.when(known, F.col("first_doc")).otherwise(F.col("first.id")).alias("first_doc"),
        F.when(known, F.col("first_start")).otherwise(F.col("first.start")).alias("first_start"),
    )
    itself = (F.col("first_doc") == F.col("id")) & (F.col("first_start") == F.col("start"))  # a repeated row
    later = later.where(~itself).repartition("id").sortWithinPartitions("id", "start")
    return staged(later.mapInArrow(_paths(kind), f"id {kind}, start int, n int, first_doc {kind}, first_start int"), "spans")


def _seed_rows(edge: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, again = [], []
            for h in _hashed(batch.column(1)):
                every, least = _seeds(h, edge, seed)
                own = np.unique(least)
                values, n = np.unique(every, return_counts=True)
                made.append(own.view(np.int64))
                again.append(n[np.searchsorted(values, own)] > 1)  # a seed that its own document repeats counts twice
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64())), pa.array(again, pa.list_(pa.bool_()))], names=["id", "seeds", "again"])

    return run


def _edge_rows(edge: int, seed: int, kind: str, salt: int, bits: int):
    """Edges that can repeat: of each hash the task's first, for the other tasks; and spans for those after it."""
    names = ["h", "id", "start", "n", "first_doc", "first_start"]

    def flush(ids: list, parts: list, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        doc = np.repeat(np.arange(len(ids)), [len(parts[i][0]) for i in order])
        start, h = np.concatenate([parts[i][0] for i in order]), np.concatenate([parts[i][1] for i in order])
        value, at, back = np.unique(h, return_index=True, return_inverse=True)
        own = pa.array([ids[i] for i in order], arrow)
        none = pa.nulls(len(value))
        seen = np.argsort(at)  # in document order: neighbours share their bytes in the shuffle files
        yield pa.RecordBatch.from_arrays([pa.array(value[seen].view(np.int64)), own.take(pa.array(doc[at[seen]])), pa.array(start[at[seen]], pa.int32()), none.cast(pa.int32()), none.cast(arrow), none.cast(pa.int32())], names=names)
        first = at[back]
        later = np.flatnonzero(first != np.arange(len(h)))
        if len(later):
            a, n = _runs(doc[later], start[later], doc[first[later]], start[first[later]])
            i = later[a]
            alone = _rolled(np.stack([i, np.full(len(i), len(h))], 1).astype(_U).ravel(), 2)[::2]
            yield pa.RecordBatch.from_arrays([pa.array(alone.view(np.int64)), own.take(pa.array(doc[i])), pa.array(start[i], pa.int32()), pa.array(n, pa.int32()), own.take(pa.array(doc[first[i]])), pa.array(start[first[i]], pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, held = [], [], 0
            for i, h, own in zip(batch.column(0).to_pylist(), _hashed(batch.column(1)), batch.column(2), strict=True):
                _, least = _seeds(h, edge, seed)
                start = np.flatnonzero(np.isin(least.view(np.int64), own.values.to_numpy(zero_copy_only=False)))
                ids.append(i)
                parts.append((start, _rolled(h, edge, salt)[start] >> _U(64 - bits)))
                held += len(h)
                if held >= CHUNK_WORDS:
                    yield from flush(ids, parts, batch.schema.field(0).type)
                    ids, parts, held = [], [], 0
            if ids:
                yield from flush(ids, parts, batch.schema.field(0).type)

    return run


def _runs(doc: np.ndarray, start: np.ndarray, first_doc: np.ndarray, first_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the runs in which all coordinates go on by one."""
    follows = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (first_doc[1:] == first_doc[:-1]) & (first_start[1:] == first_start[:-1] + 1)
    at = np.flatnonzero(np.concatenate([[True], ~follows]))
    return at, np.diff(np.append(at, len(doc)))


def _paths(kind: str):
    """Compacts sorted rows; a run that meets a batch's end goes on as a second span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            number = lambda c: batch.column(c).dictionary_encode() if pa.types.is_string(batch.column(c).type) else batch.column(c)
            both = pa.chunked_array([number(0), number(3)]) if not pa.types.is_string(batch.column(0).type) else pa.chunked_array([batch.column(0), batch.column(3)]).dictionary_encode().unify_dictionaries()
            ids = [c.indices.to_numpy() if isinstance(c, pa.DictionaryArray) else c.to_numpy(zero_copy_only=False) for c in both.chunks]
            start, n, first = (batch.column(i).to_numpy() for i in (1, 2, 4))
            # A span of several windows ends a run: its successor starts anew.
            follows = (ids[0][1:] == ids[0][:-1]) & (start[1:] == start[:-1] + n[:-1]) & (ids[1][1:] == ids[1][:-1]) & (first[1:] == first[:-1] + n[:-1])
            at = np.flatnonzero(np.concatenate([[True], ~follows]))
            length = np.add.reduceat(n, at)
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(length, pa.int32()), picked.column(3), picked.column(4)], names=["id", "start", "n", "first_doc", "first_start"])

    return run


def _judged(source: DataFrame, spans: DataFrame, edge: int) -> DataFrame:
    """Spans, and whether their words equal those at the earlier coordinates, by 128-bit digests made from the texts."""
    kind = source.schema["id"].dataType.simpleString()
    here = spans.select("id", "start", "n")
    there = spans.select(F.col("first_doc").alias("id"), F.col("first_start").alias("start"), "n")
    wanted = here.union(there).distinct().groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, n, digest = [], [], [], []
            for i, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                for s in own:
                    ids.append(i)
                    start.append(s["start"])
                    n.append(s["n"])
                    digest.append(hashlib.blake2b(b" ".join(words[s["start"] : s["start"] + s["n"] + edge - 1]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary())], names=["id", "start", "n", "digest"])

    wanted = staged(wanted, "span-wanted").withColumnRenamed("id", "own")
    read = source.join(wanted, F.col("id") == F.col("own")).select("id", "text", "spans")
    read = staged(read.mapInArrow(digests, f"id {kind}, start int, n int, digest binary").groupBy("id", "start", "n").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")), "span-digests").where("digest = other")
    mine = read.select("id", "start", "n", "digest")
    theirs = read.select(F.col("id").alias("first_doc"), F.col("start").alias("first_start"), "n", F.col("digest").alias("first_digest"))
    return spans.join(mine, ["id", "start", "n"]).join(theirs, ["first_doc", "first_start", "n"]).select("id", "start", "n", "first_doc", "first_start", F.expr("digest = first_digest").alias("same"))


def without_repeats(docs: DataFrame, spans: DataFrame, edge: int = EDGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_words, n_removed, kept_text (kept words joined by one space).

    Null text: no words. Null id: never removed from. Rows that repeat an id are one document of the spans, and each
    loses the same words. Texts shorter than an edge stay whole. Empty table: no rows. Extra columns are ignored.
    """
    own = spans.groupBy(F.col(id_col).alias("own")).agg(F.collect_list(F.struct("start", F.col("n_windows").alias("n"))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.join(staged(own, "span-own"), F.col("id") == F.col("own"), "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n_words, n_removed, kept = [], [], []
                for text, own in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    words = (text.as_py() or b"").split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    for s in own or ():
                        edges[s["start"]] += 1
                        edges[min(len(words), s["start"] + s["n"] + edge - 1)] -= 1
                    keep = np.cumsum(edges[:-1]) == 0 if own else np.ones(len(words), bool)
                    n_words.append(len(words))
                    n_removed.append(int(len(words) - keep.sum()))
                    kept.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if own else words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {EDGE - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {EDGE} + 2)) AS i FROM d WHERE len(w) >= {EDGE})),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {EDGE})) AS j FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
