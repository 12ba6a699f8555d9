"""Language ID: prediction by partial matching, one variable-order byte context tree per language."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ORDER = 3
#: Training rows of one language, chosen by a hash of the id; the fitted trees are bounded by these rows' bytes.
ROWS_PER_LANGUAGE = 4000
UNDETERMINED = "und"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_PIECE = 1 << 18
_cache: dict = {}


@dataclass
class Tree:
    """One language's code lengths in bits by order: keys are a context's bytes with the byte after them, contexts those bytes alone."""

    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]


@dataclass
class Model:
    """A sparse tree for each language; unseen contexts use their longest seen suffix."""

    languages: list[str]
    trees: list[Tree]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _grams(text: bytes) -> np.ndarray:
    """Each byte with the three before it, packed; a text starts after line ends."""
    a = np.frombuffer(b"\n" * ORDER + text.translate(_LOWER), np.uint8).astype(np.uint32)
    return (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Counts of (language, packed four bytes) over all rows of docs, combined per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(_grams(text))
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Context trees from a bounded sample of labelled rows: about rows_per_language for each language, whole texts.

    Every non-null lang is learned, in a tree of its own. Null text or lang: not learned from. Null id: hashed as
    null. Repeated rows count as often as they are drawn. No labelled rows, or an empty table: None. The sample
    hangs on ids alone, so the same rows give the same model on any partitioning.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    per = rows.groupBy(F.col("lang").alias("of")).agg((F.lit(float(rows_per_language)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    per = staged(per, "language-shares")  # a row for each language: written, so that the planner knows its size and texts needn't move
    got = count_grams(rows.join(per, F.col("lang") == F.col("of")).where(draw < F.col("share"))).toArrow()
    return build(np.array(got.column("lang").to_pylist(), object), got.column("gram").to_numpy(), got.column("n").to_numpy())


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model | None:
    """Frozen code lengths, escape method C: a context gives its unseen bytes distinct / (total + distinct). No grams: None."""
    if not len(gram):
        return None
    order = np.argsort(lang.astype(str), kind="stable")
    lang, gram, n = lang[order], gram[order].astype(np.uint32), n[order]
    at = np.flatnonzero(np.concatenate([[True], lang[1:] != lang[:-1]]))
    return Model(lang[at].tolist(), [_tree(g, c) for g, c in zip(np.split(gram, at[1:]), np.split(n, at[1:]), strict=True)])


def _tree(gram: np.ndarray, n: np.ndarray) -> Tree:
    made = Tree([], [], [], [])
    for order in range(ORDER + 1):
        keys, back = np.unique(_last(gram, order + 1), return_inverse=True)
        times = np.bincount(back, n)
        contexts, back, distinct = np.unique(keys >> np.uint32(8), return_inverse=True, return_counts=True)
        whole = np.bincount(back, times) + distinct
        made.keys.append(keys)
        made.bits.append(np.log2(whole[back] / times).astype(np.float32))
        made.contexts.append(contexts)
        made.escape.append(np.log2(whole / distinct).astype(np.float32))
    return made


def _last(gram: np.ndarray, n: int) -> np.ndarray:
    return gram & np.uint32((1 << 8 * n) - 1)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _bits(tree: Tree, gram: np.ndarray) -> np.ndarray:
    """Bits of each gram's last byte after the bytes before it."""
    out, left = np.zeros(len(gram)), np.arange(len(gram))
    for order in range(ORDER, -1, -1):
        at, hit = _found(tree.keys[order], _last(gram[left], order + 1))
        out[left[hit]] += tree.bits[order][at[hit]]
        left = left[~hit]
        at, hit = _found(tree.contexts[order], _last(gram[left] >> np.uint32(8), order))
        out[left[hit]] += tree.escape[order][at[hit]]
    out[left] += 8
    return out


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text under each language; texts are cut into pieces that keep their context."""
    bits = np.zeros((len(texts), len(model.languages)))
    own, parts, held = [], [], 0
    for d, text in enumerate(texts):
        whole = b"\n" * ORDER + text.translate(_LOWER)
        for i in range(0, len(text), _PIECE):
            own.append(d)
            parts.append(whole[i : i + _PIECE + ORDER])
            held += len(parts[-1])
            if held >= _PIECE:
                _add(model, own, parts, bits)
                own, parts, held = [], [], 0
    if parts:
        _add(model, own, parts, bits)
    return bits


def _add(model: Model, own: list[int], parts: list[bytes], bits: np.ndarray) -> None:
    """Adds the bits of the parts; each begins with the three bytes before it. Equal grams of a part are looked up once."""
    a = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    gram = (a[:-3] << 24) | (a[1:-2] << 16) | (a[2:-1] << 8) | a[3:]
    size = np.array([len(p) for p in parts])
    inside = np.ones(len(a), bool)
    begin = np.cumsum(size) - size
    for k in range(ORDER):
        inside[begin + k] = False
    part = np.repeat(np.arange(len(parts), dtype=np.uint64), size - ORDER)
    keys = np.sort(part << np.uint64(32) | gram[inside[ORDER:]].astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times, keys = np.diff(np.append(first, len(keys))), keys[first]
    doc, gram = np.array(own)[(keys >> np.uint64(32)).astype(np.int64)], keys.astype(np.uint32)
    for k, tree in enumerate(model.trees):
        bits[:, k] += np.bincount(doc, _bits(tree, gram) * times, len(bits))


def predict_many(model: Model | None, texts: list[bytes | None]) -> list[tuple[str, float, float | None]]:
    """Of each text: its language, that language's share of the probability of all, and bits a byte."""
    out: list[tuple[str, float, float | None]] = [(UNDETERMINED, 0.0, None)] * len(texts)
    at = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
    if at:
        bits = code_lengths(model, [texts[i] for i in at])
        best = bits.argmin(1)
        least = bits[np.arange(len(at)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for i, b, s, x in zip(at, best.tolist(), share.tolist(), least.tolist(), strict=True):
            out[i] = (model.languages[b], s, x / len(texts[i]))
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, lang_pred, score, bits_per_byte.

    The language is the one under which the whole text has the shortest exact code; score is 2^-bits of
    that language over the sum for all languages. Ties go to the first language by name.

    Null text, empty text or no letter, or no training rows: 'und', score 0, null bits. Null and repeated
    ids pass through, a row each. Very long texts are coded in pieces that keep their context. Empty
    table: no rows. Further columns, clashing or not, are ignored.
    """
    own = _on_workers(docs, model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [g for i in range(0, len(batch), 256) for g in predict_many(own(), batch.column(1).slice(i, 256).to_pylist())]
            made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "lang_pred", "score", "bits_per_byte"])

    out = rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is decided with a score of `least` or more; no join, no shuffle.

    Null or empty text, or no letter: dropped. Without a model no language can be told, so no row is rejected: all
    rows stay. Null and repeated ids: each row is judged by itself. Empty table: no rows.
    """
    if model is None:
        return docs
    own, at = _on_workers(docs, model), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = predict_many(own(), part.column(at).cast(pa.binary()).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in got], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def _on_workers(docs: DataFrame, model: Model | None):
    """A function that gives the broadcast model, unpacked once in each Python worker."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def own() -> Model | None:
        if name not in _cache:
            _cache.clear()
            _cache[name] = shared.value
        return _cache[name]

    return own
