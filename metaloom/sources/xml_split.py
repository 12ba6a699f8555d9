"""Large XML exports read in ranges of bytes by many tasks, to the node table of xml_export."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut
from .xml_export import NODE

#: Whole constructs: comments, CDATA sections, instructions, document types, tags.
_WHOLE = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>|<(/?)([^\s/>!?]+)(?:[^"'>]|"[^"]*"|'[^']*')*>""", re.S)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_PASS = "doc string, block long, starts int, levels array<struct<added:int,last:int>>, opened array<struct<local:int,kids:int,last:int,tag:string>>, rest string"
_KIND = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("added", pa.int32()), ("last", pa.int32())])), pa.list_(pa.struct([("local", pa.int32()), ("kids", pa.int32()), ("last", pa.int32()), ("tag", pa.string())])), pa.string()]
_NODE_KIND = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int64()]
#: In levels: the last child that ended is the open element of the level below.
_BELOW = -1


def _rest(text: str) -> tuple[list[re.Match], str]:
    """The whole constructs of a range, and what it begins and doesn't end."""
    found = list(_WHOLE.finditer(text))
    tail = text[found[-1].end() if found else 0 :]
    return found, tail[tail.index("<") :] if "<" in tail else ""


def _effect(doc: str, block: int, text: str) -> tuple:
    """What a range does to the elements that are open before it: children added at each level that it comes back to, elements that it leaves open."""
    found, rest = _rest(text)
    starts, levels, opened = 0, [{"added": 0, "last": None}], []
    for m in found:
        if m.group(2) is None:
            continue
        if m.group(1):
            if opened:
                ended = opened.pop()["local"]
            else:
                ended = _BELOW
                levels.append({"added": 0, "last": None})
            (opened[-1] if opened else levels[-1])["last"] = ended
            continue
        if opened:
            opened[-1]["kids"] += 1
        else:
            levels[-1]["added"] += 1
        if m.group().endswith("/>"):
            (opened[-1] if opened else levels[-1])["last"] = starts
        else:
            opened.append({"local": starts, "kids": 0, "last": None, "tag": m.group(2)})
        starts += 1
    return doc, block, starts, levels, opened, rest


def _by_block(rows: DataFrame, schema: str, kinds: list, solve: Callable[[str, int, str], list[tuple]]) -> DataFrame:
    """What solve makes of each range's text. A task reads its ranges in order, each after the other."""
    names = [part.split()[0] for part in re.sub(r"<.*?>(?=,|$)", "", schema).split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found[at : at + 5000]], k) for i, k in enumerate(kinds)], names)

        key, parts = None, []
        for batch in batches:
            for doc, block, ends, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, block) != key:
                    if key:
                        yield from packed(solve(*key, _text(parts)))
                    key, parts = (doc, block), []
                parts.append((value, ends))
        if key:
            yield from packed(solve(*key, _text(parts)))

    return rows.mapInArrow(stream, schema)


def _text(parts: list[tuple[str, bool]]) -> str:
    """Records with the `>` that parted them; a blank one at the end of a file has none."""
    last, ends = parts[-1]
    return "".join(v + ">" for v, _ in parts[:-1]) + (last if ends and not last.strip() else last + ">")


def _nodes(doc: str, block: int, text: str, base: int, stack: list[tuple]) -> list[tuple]:
    """Nodes of a range, and texts that belong to nodes before it, as rows without a tag. stack: (id, children, last child, tag) of the elements open before it."""
    rows: dict[int, list] = {}
    open_, kids, last = [s[0] for s in stack], [s[1] for s in stack], [s[2] for s in stack]
    parser, made = expat.ParserCreate("utf-8"), [base]
    parser.buffer_text = parser.ordered_attributes = True
    ready = [False]

    def begin(tag, attributes):
        if not ready[0]:
            return
        node = made[0]
        rows[node] = [doc, node, open_[-1] if open_ else None, kids[-1] if kids else 0, len(open_), tag, list(zip(attributes[::2], attributes[1::2], strict=True)), None, None, block]
        made[0] += 1
        if kids:
            kids[-1] += 1
        open_.append(node)
        kids.append(0)
        last.append(None)

    def end(_):
        closed = open_.pop()
        kids.pop()
        last.pop()
        if last:
            last[-1] = closed

    def data(value):
        if ready[0] and value.strip() and open_:
            node, k = (open_[-1], 7) if last[-1] is None else (last[-1], 8)
            row = rows.setdefault(node, [doc, node, None, None, None, None, None, None, None, block])
            row[k] = (row[k] or "") + value

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, data
    try:
        parser.Parse("".join(f"<{s[3]}>" for s in stack), False)
        ready[0] = True
        parser.Parse(text, False)
        parser.buffer_text = False  # gives out what is held
    except expat.ExpatError as e:
        return [(doc, 0, None, 0, 0, None, [], str(e), None, -1)]
    return [tuple(r) for r in rows.values()]


@contextmanager
def _small_splits(spark: SparkSession, block_bytes: int) -> Iterator[None]:
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(block_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _ranges(spark: SparkSession, path: str) -> tuple[DataFrame, dict, dict]:
    """The files' records with their range; what each range does; and what each begins with of the range before it."""
    meta = F.col("_metadata")
    ends = meta["file_block_start"] + meta["file_block_length"] >= meta["file_size"]
    raw = spark.read.option("lineSep", ">").text(path).select(meta["file_path"].alias("doc"), meta["file_block_start"].alias("block"), ends.alias("ends"), "value")
    found = {(r["doc"], r["block"]): r for r in _by_block(raw, _PASS, _KIND, lambda doc, block, text: [_effect(doc, block, text)]).collect()}
    order, given = sorted(found), {}
    while True:  # ranges that begin inside a construct are told anew with its beginning
        fresh = {k: found[p]["rest"] for p, k in zip(order, order[1:], strict=False) if p[0] == k[0] and found[p]["rest"] != given.get(k, "")}
        if not fresh:
            return raw, found, given
        given |= fresh
        some = raw.where(F.concat_ws("|", "doc", "block").isin([f"{d}|{b}" for d, b in fresh]))
        told = _by_block(some, _PASS, _KIND, lambda doc, block, text, held=fresh: [_effect(doc, block, held.get((doc, block), "") + text)])
        found |= {(r["doc"], r["block"]): r for r in told.collect()}


def xml_nodes_split(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """The node table of xml_export.xml_nodes, of files that several tasks share, in ranges of about block_bytes.

    Records end at `>`, so that every range begins after one. The first pass tells what each range does to the open elements, a few numbers for a range, which are
    chained by file on the driver (a row for each range: a terabyte has some 16,000); where a tag, comment or CDATA section goes over a range's end, its beginning goes to the next. The second pass parses each range below the elements that
    are open before it. Text that goes on in later ranges is joined to its node.

    Files must be UTF-8 and keep to entities that XML itself knows; a single tag, comment or section must fit in a task, blank text is left out for each range. A file that is not well-formed gives a row with a null tag and the parser's message
    besides what its other ranges hold. Empty files: no rows.
    """
    with _small_splits(spark, block_bytes):
        raw, found, given = _ranges(spark, path)
        plan, stack, base, doc = {}, [], 0, None
        for key in sorted(found):
            if key[0] != doc:
                stack, base, doc = [], 0, key[0]
            plan[key] = (given.get(key, ""), base, [tuple(s) for s in stack])
            for at, level in enumerate(found[key]["levels"]):
                below = stack.pop()[0] if at and stack else None
                if stack:
                    stack[-1][1] += level["added"]
                    if level["last"] is not None or at:
                        stack[-1][2] = base + level["last"] if (level["last"] or 0) >= 0 and level["last"] is not None else below
            stack += [[base + o["local"], o["kids"], None if o["last"] is None else base + o["last"], o["tag"]] for o in found[key]["opened"]]
            base += found[key]["starts"]

        def parsed(doc: str, block: int, text: str) -> list[tuple]:
            begun, base, stack = plan[doc, block]
            whole = begun + text
            rest = _rest(whole)[1]
            whole = whole[: len(whole) - len(rest)]
            return _nodes(doc, block, whole, base, stack) if whole.strip() else []

        rows = cut(_by_block(raw, NODE + ", block long", _NODE_KIND, parsed), "xml-nodes")
    own, more = rows.where("tag is not null or block = -1"), rows.where("tag is null and block <> -1")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("block", c)))), lambda s: s[c]), "").alias(f"__{c}")
    late = more.groupBy("doc", "node_id").agg(joined("text"), joined("tail"))
    out = own.join(late, ["doc", "node_id"], "left")
    both = lambda c: F.nullif(F.concat(F.coalesce(c, F.lit("")), F.coalesce(f"__{c}", F.lit(""))), F.lit("")).alias(c)
    return out.select("doc", "node_id", "parent_id", "ord", "depth", "tag", "attributes", both("text"), both("tail"))


def lossless_check_split(spark: SparkSession, path: str, block_bytes: int = 64 << 20) -> DataFrame:
    """(doc, elements, attributes, source_elements, source_attributes, lossless): the node table's elements and attributes against those that a pattern counts in the ranges' tags."""
    nodes = xml_nodes_split(spark, path, block_bytes).groupBy("doc").agg(F.count("tag").alias("elements"), F.sum(F.coalesce(F.size("attributes"), F.lit(0))).alias("attributes"))
    with _small_splits(spark, block_bytes):
        raw, _, given = _ranges(spark, path)

        def counted(doc: str, block: int, text: str) -> list[tuple]:
            tags = [m.group() for m in _rest(given.get((doc, block), "") + text)[0] if m.group(2) and not m.group(1)]
            return [(doc, len(tags), sum(len(_VALUE.findall(t)) for t in tags))]

        source = cut(_by_block(raw, "doc string, n long, m long", [pa.string(), pa.int64(), pa.int64()], counted).groupBy("doc").agg(F.sum("n").alias("source_elements"), F.sum("m").alias("source_attributes")), "xml-tags")
    return source.join(nodes, "doc", "left").fillna(0, ["elements", "attributes"]).withColumn("lossless", (F.col("elements") == F.col("source_elements")) & (F.col("attributes") == F.col("source_attributes")))
