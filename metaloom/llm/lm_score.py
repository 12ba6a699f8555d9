"""LM scoring: stupid backoff over word 2-grams, as count tables joined to exploded n-grams and summed by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import LOWER, mixed, word_hashes

DISCOUNT = 0.4
#: Log scores are whole micro-nats, so that sums don't depend on their order.
UNIT = 1_000_000
#: Text whose n-grams one task holds at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 6_000_000
#: Rows of an Arrow batch that carries n-grams.
BATCH_ROWS = 200_000

_U = np.uint64
_TOP = _U(1 << 63)
#: The place before a text's first word, as a context; words have the top bit.
START = 0
#: In place of a context's count, on a document's own line.
OWN_LINE = -1


def _chunks(batches: Iterator[pa.RecordBatch], of: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their numbers of words, and all word hashes end to end with their contexts; ASCII letters folded."""
    for batch in batches:
        size = pa.compute.coalesce(pa.compute.binary_length(batch.column(of)), 0).to_numpy()
        upto = np.cumsum(size)
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(upto, CHUNK_BYTES + upto[low] - size[low], "right")))
            part = batch.slice(low, high - low)
            words, sizes = word_hashes([x or b"" for x in part.column(of).to_pylist()], LOWER)
            words = words | _TOP
            yield part, sizes, words, _before(words, sizes)
            low = high


def _before(of_words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What stands before each word; START at the beginning of a text."""
    before = np.zeros_like(of_words)
    before[1:] = of_words[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return before


def _runs(first: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(first, end))


def _by_document(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of each document: a place of each, how often it occurs; and the number of each place's key."""
    order, begin = np.empty(len(keys), np.int64), 0
    for size in sizes.tolist():
        order[begin : begin + size] = keys[begin : begin + size].argsort()
        order[begin : begin + size] += begin
        begin += size
    doc, keys = np.repeat(np.arange(len(sizes)), sizes), keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    number, first = np.empty(len(keys), np.int64), np.flatnonzero(new)
    number[order] = np.cumsum(new) - 1
    return order[first], _runs(first, len(keys)), number


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of each chunk: the hashes of context and word of its distinct 2-grams, and how often each occurs."""
    for _, _, words, before in _chunks(batches, 0):
        key = mixed(words * _U(0x9E3779B97F4A7C15) + before * _U(0xC2B2AE3D27D4EB4F))
        order = key.argsort()
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        at, n = order[first], _runs(first, len(key))
        yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(n)], names=["a", "b", "n"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nr, id, a, b, n, own_a, own_b): a document's own line with its number of words, then its distinct 2-grams.

    own_a and own_b are how often the document has the context and the word.
    """
    names = ["nr", "id", "a", "b", "n", "own_a", "own_b"]
    for rows, sizes, words, before in _chunks(batches, 2):
        nr, ids = rows.column(0).to_numpy(), rows.column(1)
        none = np.zeros(len(nr), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nr), ids, pa.array(nr), pa.array(none), pa.array(sizes.astype(np.int64)), pa.array(none + OWN_LINE), pa.array(none)], names=names)
        _, times, number = _by_document(words, sizes)
        times = np.concatenate([[1], times])  # a document has its beginning once
        number += 1
        context = _before(number, sizes)
        at, n, _ = _by_document(context * len(times) + number, sizes)
        doc = np.repeat(nr, sizes)[at]
        for k in range(0, len(at), BATCH_ROWS):
            part = at[k : k + BATCH_ROWS]
            columns = doc[k : k + BATCH_ROWS], before[part].view(np.int64), words[part].view(np.int64), n[k : k + BATCH_ROWS], times[context[part]], times[number[part]]
            own, *others = map(pa.array, columns)
            yield pa.RecordBatch.from_arrays([own, pa.nulls(len(part), ids.type), *others], names=names)


def _micro(share: Column) -> Column:
    return F.round(F.log(share) * UNIT).cast("long")


def count_tables(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every 2-gram of the corpus with its count n and the counts of its context (in_a) and its word (of_b); the number of words.

    rows has one column, the texts as binary. Counts are combined in each task, then summed by hash.
    """
    pairs = staged(rows.mapInArrow(_pair_rows, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs")
    words = pairs.groupBy("b").agg(F.sum("n").alias("of_b"))
    beginnings = pairs.where(F.col("a") == START).agg(F.lit(START).cast("long").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("of_b"))
    words = staged(words.unionByName(beginnings), "lm-words")
    total = words.where(F.col("b") != START).agg(F.sum("of_b")).first()[0] or 0
    contexts = words.select(F.col("b").alias("a"), F.col("of_b").alias("in_a"))
    return pairs.join(words, "b").join(contexts, "a").select("a", "b", "n", "in_a", "of_b"), total


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_grams (words scored), log_score (sum of natural logs, in millionths), mean_log.

    The model of a document is the corpus without that document: its own counts are taken from each count
    before a score is made. A word's score is count(2-gram) / count(context) if the rest of the corpus has its
    2-gram, else 0.4 * count(word) / words of the rest, where a word that the rest hasn't counts 1. The start
    of a text is the context of its first word. Words are runs of characters that aren't ASCII white space, with
    ASCII letters folded.

    1. 2-grams are counted in each task and summed by hash into a table of all of them; words and contexts are
    sums of that table, and every 2-gram gets the counts of both. 2. Every document's distinct 2-grams are
    exploded with the document's own counts, joined to the table by hash, and summed by document. That is one
    way for every n-gram at every size: a frequent one has a row for each document that holds it, all in
    shuffled blocks, which AQE splits where they make a partition skewed. The hashes have 63 bits: of a billion
    n-grams, about one in twenty corpora has two with one key.

    Null or empty text: 0 words, log_score 0, null mean. A document alone: its words count 1 of 1. Null and
    repeated ids: a row each. Repeated rows know each other's n-grams. Very long texts are scored whole, in
    memory of their own size. Empty table: no rows. Extra columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("nr"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted, total = count_tables(rows.select("text"))
    counts = staged(counted.select(F.xxhash64("a", "b").alias("gram"), F.col("n").alias("of_all"), "in_a", "of_b"), "lm-counts")

    lines = rows.mapInArrow(_gram_rows, f"nr long, id {kind}, a long, b long, n long, own_a long, own_b long")
    lines = lines.select("nr", "id", F.xxhash64("a", "b").alias("gram"), "n", "own_a", "own_b").join(counts, "gram", "left")
    own_line, known = F.col("own_a") == OWN_LINE, F.col("of_all") > F.col("n")
    seen = _micro((F.col("of_all") - F.col("n")) / (F.col("in_a") - F.col("own_a")))
    alone = _micro(DISCOUNT * F.greatest(F.col("of_b") - F.col("own_b"), F.lit(1)))
    out = lines.groupBy("nr").agg(
        F.max("id").alias("id"),
        F.sum(F.when(own_line, F.col("n")).otherwise(0)).alias("n_grams"),
        F.sum(F.when(own_line, 0).otherwise(F.col("n") * F.when(known, seen).otherwise(alone))).alias("parts"),
        F.sum(F.when(own_line | known, 0).otherwise(F.col("n"))).alias("backed_off"),
    )
    rest = _micro(F.greatest(F.lit(total) - F.col("n_grams"), F.lit(1)))
    out = out.withColumn("log_score", F.col("parts") - F.col("backed_off") * rest)
    mean = F.expr("-((n_grams - 2 * log_score) div (2 * nullif(n_grams, 0)))") / UNIT  # in whole millionths, half away from zero
    return out.select(F.col("id").alias(id_col), "n_grams", "log_score", mean.alias("mean_log"))


def _micro_sql(share: str) -> str:
    return f"CAST(round(ln({share}) * {UNIT}) AS BIGINT)"


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS nr, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS MATERIALIZED (SELECT nr, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS context, w[i] AS word FROM (SELECT nr, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
own2 AS MATERIALIZED (SELECT nr, context, word, count(*) AS n FROM p GROUP BY ALL),
own1 AS MATERIALIZED (SELECT nr, word, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT nr, '', 1 FROM d WHERE len(w) > 0),
all2 AS (SELECT context, word, CAST(sum(n) AS BIGINT) AS n FROM own2 GROUP BY ALL),
all1 AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM own1 GROUP BY word),
rest1 AS MATERIALIZED (SELECT nr, word, all1.n - own1.n AS n FROM own1 JOIN all1 USING (word)),
rest2 AS (SELECT nr, context, word, own2.n AS times, all2.n - own2.n AS n FROM own2 JOIN all2 USING (context, word)),
size AS (SELECT nr, greatest((SELECT count(*) FROM p) - len(w), 1) AS others FROM d),
t AS (SELECT r.nr, CAST(sum(r.times) AS BIGINT) AS n_grams, CAST(sum(r.times * CASE WHEN r.n > 0 THEN {_micro_sql("CAST(r.n AS DOUBLE) / c.n")}
  ELSE {_micro_sql(f"CAST({DISCOUNT} AS DOUBLE) * greatest(w.n, 1)")} - {_micro_sql("CAST(others AS DOUBLE)")} END) AS BIGINT) AS log_score
  FROM rest2 r JOIN rest1 c ON c.nr = r.nr AND c.word = r.context JOIN rest1 w ON w.nr = r.nr AND w.word = r.word JOIN size ON size.nr = r.nr GROUP BY r.nr)
SELECT doc_id, coalesce(n_grams, 0) AS n_grams, coalesce(log_score, 0) AS log_score, CAST(-((n_grams - 2 * log_score) // (2 * nullif(n_grams, 0))) AS DOUBLE) / {UNIT} AS mean_log FROM d LEFT JOIN t USING (nr)
"""
