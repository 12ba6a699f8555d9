"""MinHash near-dedup: banded candidates, odd sketches, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .graph import components
from .words import LOWER, mixed, word_hashes

WORDS = 5
THRESHOLD = 80
#: A pair at the threshold shares no band with probability (1 - 0.8^4)^24, about 3 in a million.
BANDS, ROWS = 24, 4
SKETCH_BITS = 512
#: Documents of one side of a block comparison.
BLOCK = 256

_U = np.uint64
_HASHES = BANDS * ROWS
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64) << _U(1)
_MUL = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64) << _U(1) | _U(1)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)



def shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; a shorter text is one shingle, no words give none."""
    h, sizes = word_hashes([x or b"" for x in texts], LOWER)
    total = np.zeros(max(0, len(h) - width + 1), _U)
    for i in range(width):
        total += h[i : len(total) + i] * (_STEP[i % 8] ** _U(1 + i // 8))
    total, out, begin = mixed(total), [], 0
    for n in sizes.tolist():
        if n < width:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[begin : begin + n].tobytes(), n)] if n else [], _U))
        else:
            s = np.sort(total[begin : begin + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        begin += n
    return out


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Shingle sets of an Arrow array of texts, 256 at a time."""
    for at in range(0, len(texts), 256):
        yield from shingles(texts.slice(at, 256).to_pylist(), width)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the odd sketch: one bit flipped for each MinHash sample."""
    least = np.full(_HASHES, np.iinfo(_U).max, _U)
    for i in range(0, len(s), 2048):
        least = np.minimum(least, ((s[i : i + 2048, None] ^ _XOR) * _MUL).min(0))
    bands = np.array([xxhash.xxh3_64_intdigest(row.tobytes(), j) for j, row in enumerate(least.reshape(BANDS, ROWS))], _U)
    bits = np.bincount(mixed(least ^ _XOR) % _U(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    return bands.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_bound(threshold: int) -> int:
    """Most differing sketch bits of a pair at the threshold: each differing sample flips two bits at most, six deviations allowed."""
    t = threshold / 100
    return 2 * math.ceil(_HASHES * (1 - t) + 6 * math.sqrt(_HASHES * t * (1 - t)))


def linked(inter, n_a, n_b, threshold: int):
    return 100 * inter >= threshold * (n_a + n_b - inter)


def near_groups(docs: DataFrame, width: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents are linked when the Jaccard similarity of their shingle sets is threshold percent or more.
    1. Equal sets become one class. 2. Classes that share a band key form a bucket; each is compared with
    the bucket's smallest member: odd sketches first, then full sets. 3. Components. 4. Where a bucket still
    holds several components, its members outside the largest one are compared with all the others in blocks
    of bounded size, which report a spanning set of links instead of all pairs. 5. Components again. So
    every pair that shares a band is compared, unless it is already in one component.

    Sets are of 64-bit hashes: two of the distinct shingles of one pair of texts share one with probability below
    n^2 / 2^64, which a verdict off the exact threshold by one shingle would need. Null text or no words: empty set, linked with nothing. Rows that repeat an id are one document. Null
    id: no links, component null, kept. Very long texts use all their shingles. Empty table: no rows. Extra
    columns are ignored.
    """
    ids, text = F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")
    rows = staged(docs.select(ids, text).mapInArrow(_signatures(width), f"id {_type(docs, id_col)}, n long, digest binary, bands array<long>, sketch array<long>"), "near-rows")
    sets = rows.where("n > 0 and id is not null")
    nodes = staged(sets.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-nodes")

    entries = nodes.select("node", F.explode("bands").alias("band"))
    hubs = staged(entries.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub != last").select("band", "hub"), "near-hubs")
    buckets = staged(entries.join(hubs, "band"), "near-buckets")

    stars = buckets.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sketches = nodes.select("node", "sketch")
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = staged(stars.join(right, "b").join(left, "a").where(differ <= sketch_bound(threshold)).select("a", "b"), "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = staged(_texts(docs, ids, text, wanted), "near-texts")
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    kind = _type(docs, id_col)
    links = staged(pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(_confirmed(width, threshold), f"a {kind}, b {kind}"), "near-links")

    labels = components(links)
    rest = _residual(docs, ids, text, buckets, labels, sketches, width, threshold, kind)
    if not rest.isEmpty():
        labels = components(links.union(rest))

    label_of = labels.select(F.col("node").alias("rep"), "label")
    member = nodes.select("digest", F.col("node").alias("rep"))
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(member, "digest", "left").join(label_of, "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def _texts(docs: DataFrame, ids, text, wanted: DataFrame) -> DataFrame:
    return docs.select(ids, text).join(staged(wanted.distinct(), "near-wanted"), F.col("id") == F.col("node")).select("node", "text")


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands, sketch = [], [], [], []
            for s in _sets_of(batch.column(1), width):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                one = signature(s) if len(s) else (None, None)
                bands.append(one[0])
                sketch.append(one[1])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs)], names=["id", "n", "digest", "bands", "sketch"])

    return run


def _confirmed(width: int, threshold: int):
    """Pairs whose full sets are similar; pairs arrive sorted by a, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_text = None, None
        for batch in batches:
            keep = []
            for ta, s in zip(batch.column(2), _sets_of(batch.column(3), width), strict=True):
                ta = ta.as_py()
                if ta != held_text or held is None:
                    held_text, held = ta, shingles([ta], width)[0]
                keep.append(bool(linked(len(np.intersect1d(held, s, assume_unique=True)), len(held), len(s), threshold)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _residual(docs: DataFrame, ids, text, buckets: DataFrame, labels: DataFrame, sketches: DataFrame, width: int, threshold: int, kind: str) -> DataFrame:
    """Links between the components that a bucket still holds, hubs aside, whose pairs are done."""
    label_of = labels.select(F.col("node").alias("at"), "label")
    left = buckets.where("node != hub").join(label_of, F.col("node") == F.col("at"), "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    left = staged(left, "near-left")
    open_ = left.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    by_label = left.join(staged(open_, "near-open"), "band").groupBy("band", "label").agg(F.count("*").alias("n"))
    tops = by_label.groupBy("band").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("top"))
    tops = staged(tops.select("band", "top", F.ceil(F.col("m") / BLOCK).cast("long").alias("wide"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("long").alias("high")), "near-tops")
    rest = staged(left.join(tops, "band"), "near-rest")
    kinds = staged(_texts(docs, ids, text, rest.select("node")).mapInArrow(_sets(width), f"node {kind}, items binary"), "near-sets")
    rest = rest.join(kinds, "node").join(sketches, "node")
    slot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    minor = rest.where("label != top").select("band", (slot % F.col("high")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("j"), F.lit(True).alias("minor"), "node", "label", "items", "sketch")
    other = rest.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("i"), (slot % F.col("wide")).alias("j"), F.lit(False).alias("minor"), "node", "label", "items", "sketch")
    found = minor.unionByName(other).groupBy("band", "i", "j").applyInPandas(_block(threshold), f"a {kind}, b {kind}")
    return staged(found.distinct(), "near-more")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets_of(batch.column(1), width)], pa.binary())], names=["node", "items"])

    return run


def _block(threshold: int):
    """A spanning set of the links between the minor members and the others of one block."""
    bound = sketch_bound(threshold)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        minor, other = rows[rows["minor"]], rows[~rows["minor"]]
        out: list[tuple] = []
        if len(minor) and len(other):
            sets = [np.frombuffer(x, _U) for x in other["items"]]
            size = np.array([len(s) for s in sets])
            owner, every = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            sketch = np.stack(other["sketch"].to_list()).view(_U)
            names, label, root = other["node"].to_numpy(), other["label"].to_numpy(), {}

            def find(x):
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for node, own, items, mine in zip(minor["node"], minor["label"], minor["items"], minor["sketch"], strict=True):
                near = (np.bitwise_count(sketch ^ np.asarray(mine).view(_U)).sum(1) <= bound) & (label != own)
                if not near.any():
                    continue
                s = np.frombuffer(items, _U)
                lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
                met = np.concatenate([owner[x:y] for x, y in zip(lo, hi, strict=True) if x < y] or [np.zeros(0, int)])
                inter = np.bincount(met, minlength=len(sets))
                for k in np.flatnonzero(near & linked(inter, len(s), size, threshold)):
                    x, y = find(own), find(label[k])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((min(node, names[k]), max(node, names[k])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def oracle(width: int, threshold: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i:i + {width - 1}]) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width}, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {threshold} * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m.least, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS least FROM reach GROUP BY node) m USING (doc_id)
"""
