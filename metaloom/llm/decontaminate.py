"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

WINDOW = 13
#: Item text that one automaton may hold (a MB takes some 120 MB in a worker); more items make more automata, each scanned over all documents.
BLOCK_BYTES = 2_000_000
#: Number of every word that no item has.
OTHER = 0

#: Maps every byte to itself, a lower-case letter, or a space where the byte ends a word.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

SPANS = "array<struct<start:long,end:long,item_id:string>>"
_built: dict = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def automaton(items: list[tuple[str, bytes]], window: int):
    """Automaton of the items' windows, as sequences of numbers of words, and those numbers; a match gives (length in words, item ids).

    A node stands for a word, not for a byte: 13 a window at most.
    """
    ids, number = defaultdict(set), {}
    for item_id, text in items:
        words = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            ids[tuple(words[i : i + window])].add(item_id)
    if not ids:
        return None
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, owners in ids.items():
        made.add_word(words, (len(words), sorted(owners)))
    made.make_automaton()
    return made, number


def _scan(text: bytes | None, search) -> tuple[int, list[dict], list[str], list[dict]]:
    """Words, hit word ranges, item ids, and spans of one text."""
    folded = (text or b"").translate(_FOLD)
    words = folded.split()
    if search is None or not words:
        return len(words), [], [], []
    made, number = search
    every, by_item = [], defaultdict(list)
    for last, (n, owners) in made.iter(tuple(map(number.get, words, repeat(OTHER)))):
        every.append((last + 1 - n, last + 1))
        for item in owners:
            by_item[item].append((last + 1 - n, last + 1))
    if not every:
        return len(words), [], [], []
    inside = np.frombuffer(folded, np.uint8) != 32
    flips = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = [
        {"start": int(points[flips[2 * a]]), "end": int(points[flips[2 * b - 1]]), "item_id": item}
        for item, runs in sorted(by_item.items())
        for a, b in _joined(runs)
    ]
    return len(words), [{"a": a, "b": b} for a, b in _joined(every)], sorted(by_item), spans


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: the id, n_words, n_hit, items (sorted ids), spans (code points of the original).

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is `window`
    consecutive words of an item; an item with fewer words is one window. A word inside any occurrence of
    a window is hit. Each text is scanned once by an automaton that every task builds from the items;
    the items' size is measured first, and beyond block_bytes they are dealt to several automata, each
    scanned over all documents, whose hit words are united.

    Null or empty text: no words, no hits. Null, empty or wordless items, or a null item id: no window.
    Repeated items: every id is reported once. Null and repeated document ids pass through, a row each.
    Empty tables: no documents, or no hits. Further columns of docs, clashing or not, are ignored.
    """
    texts, n_blocks = _blocks(items, item_id, item_text, block_bytes)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("nr")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    if n_blocks > 1:
        rows = staged(rows, "decontaminate-rows")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<a:long,b:long>>, items array<string>, spans {SPANS}"

    def scanned(k: int) -> DataFrame:
        search = _on_workers(texts, n_blocks, k, window)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [_scan(x.as_py(), search()) for x in batch.column(1)]
                made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(_TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "n_words", "runs", "items", "spans"])

        return rows.mapInArrow(scan, schema)

    found = scanned(0)
    if n_blocks > 1:
        for k in range(1, n_blocks):
            found = found.unionByName(scanned(k).where("size(runs) > 0"))
        found = found.groupBy("key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
    covered = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["b"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["upto"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    return found.select(F.col("key.id").alias(id_col), "n_words", covered.alias("n_hit"), "items", "spans")


def _blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    texts = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).where("id is not null and text is not null")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return texts, max(1, math.ceil(size / block_bytes))


def _on_workers(texts: DataFrame, n_blocks: int, k: int, window: int):
    """A function that gives the automaton of one block of items, built once in each Python worker."""
    block = texts.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k).collect()
    shared, name = texts.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in block]), uuid.uuid4().hex

    def search():
        if name not in _built:
            _built.clear()
            _built[name] = automaton(shared.value, window)
        return _built[name]

    return search


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated, each judged by itself.

    By row number with several automata, without a join where one holds the items. Null or empty text: stays. Null and
    repeated ids: each row by its own text. No items, or an empty table: the rows as they are.
    """
    texts, n_blocks = _blocks(items, item_id, item_text, block_bytes)
    if n_blocks > 1:
        nr = free_name(docs, "__nr")
        rows = staged(docs.withColumn(nr, F.monotonically_increasing_id()), "decontaminate-docs")
        hits = verdicts(benchmark_hits(rows, items, window, nr, text_col, item_id, item_text, block_bytes))
        return rows.join(hits.where("contaminated").select(nr), nr, "left_anti").select(*docs.columns)
    search, at = _on_workers(texts, 1, 0, window), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = [_scan(x.as_py(), search()) for x in part.column(at).cast(pa.binary())]
                hit = [sum(r["b"] - r["a"] for r in runs) for _, runs, _, _ in got]
                yield part.filter(pa.array([not (h and 20 * h >= n) for h, (n, _, _, _) in zip(hit, got, strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


_TYPES = (pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string())])))


def verdicts(hits: DataFrame) -> DataFrame:
    """The digest columns of benchmark_hits: a document is contaminated when at least a twentieth of its words is hit."""
    return hits.withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join("items", ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
