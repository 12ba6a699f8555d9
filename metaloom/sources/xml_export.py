"""XML exports as tables: lossless node rows, typed mapping tables, and canonical JSON (family A)."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import graph

NODE = "doc string, node_id int, parent_id int, ord int, depth int, tag string, attributes map<string,string>, text string, tail string"


def xml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of every file: all attributes, document order, non-blank text and tail.

    Files are parsed one at a time as a stream of events, many files in parallel. A file that is not
    well-formed gives one row with a null tag and the parser's message as text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["doc", "node_id", "parent_id", "ord", "depth", "tag", "attributes", "text", "tail"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = _parsed(doc, content.as_py())
                for i in range(0, len(rows), 5000):
                    part = rows[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, kind in enumerate(kinds)], names=names)

    return files.mapInArrow(run, NODE)


def _parsed(doc: str, content: bytes) -> list[list]:
    rows: list[list] = []
    open_: list[int] = []
    children: list[int] = []
    last: list[int | None] = [None]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.ordered_attributes = True

    def begin(tag, attributes):
        rows.append([doc, len(rows), open_[-1] if open_ else None, children[-1] if children else 0, len(open_), tag, list(zip(attributes[::2], attributes[1::2], strict=True)), None, None])
        if children:
            children[-1] += 1
        open_.append(len(rows) - 1)
        children.append(0)
        last.append(None)

    def end(_):
        closed = open_.pop()
        children.pop()
        last.pop()
        last[-1] = closed

    def text(data):
        if data.strip() and open_:
            at, k = (open_[-1], 7) if last[-1] is None else (last[-1], 8)
            rows[at][k] = (rows[at][k] or "") + data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        return [[doc, 0, None, 0, 0, None, [], str(e), None]]
    return rows


def xml_prolog(spark: SparkSession, path: str) -> DataFrame:
    """XML declaration and document type from the first 4096 bytes."""
    head = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), F.decode(F.substring("content", 1, 4096), "ISO-8859-1").alias("head"))
    pick = lambda p: F.nullif(F.regexp_extract("head", p, 0), F.lit(""))
    return head.select("doc", pick(r"<\?xml[^>]*\?>").alias("declaration"), pick(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>").alias("doctype"))


def lossless_check(spark: SparkSession, path: str) -> DataFrame:
    """Elements in the node table against opening tags counted in the files' text."""
    nodes = xml_nodes(spark, path).groupBy("doc").agg(F.count("tag").alias("elements"), F.sum(F.size("attributes")).alias("attributes"))
    bare = F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    tags = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), F.size(F.regexp_extract_all(bare, F.lit(r"<([A-Za-z_])"), 1)).alias("source_elements"))
    return nodes.join(tags, "doc").withColumn("lossless", F.col("elements") == F.col("source_elements"))


def children(nodes: DataFrame, parents: DataFrame, tag: str) -> DataFrame:
    """Children by tag of the given nodes."""
    up = parents.select("doc", F.col("node_id").alias("parent_id"))
    return nodes.where(F.col("tag") == tag).join(up, ["doc", "parent_id"], "left_semi")


def attributes(nodes: DataFrame, tag: str, *names: str) -> DataFrame:
    """The elements of a tag with attributes as columns; a missing one is ''. Order of the document in ord."""
    cols = [F.coalesce(F.col("attributes")[n], F.lit("")).alias(n.lower()) for n in names]
    return nodes.where(F.col("tag") == tag).select("doc", "node_id", "parent_id", F.col("node_id").alias("ord"), *cols)


def mapping_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """Instances, connectors and sessions of all exports with the mapping that they lie in."""
    owner = nodes.where("tag = 'MAPPING'").select("doc", F.col("node_id").alias("parent_id"), F.col("attributes")["NAME"].alias("mapping"))
    own = lambda df: df.join(owner, ["doc", "parent_id"])
    return {
        "instance": own(attributes(nodes, "INSTANCE", "NAME", "TYPE", "TRANSFORMATION_NAME", "TRANSFORMATION_TYPE")),
        "connector": own(attributes(nodes, "CONNECTOR", "FROMINSTANCE", "FROMFIELD", "TOINSTANCE", "TOFIELD")),
        "target_load_order": own(attributes(nodes, "TARGETLOADORDER", "TARGETINSTANCE", "ORDER")).withColumn("place", F.col("order").try_cast("int")),
        "session": attributes(nodes, "SESSION", "NAME", "MAPPINGNAME"),
        "workflow_link": attributes(nodes, "WORKFLOWLINK", "FROMTASK", "TOTASK", "CONDITION"),
        "task_instance": attributes(nodes, "TASKINSTANCE", "NAME", "TASKNAME", "TASKTYPE", "ISENABLED"),
    }


def descendants(nodes: DataFrame, starts: DataFrame, tag: str | None = None) -> DataFrame:
    """(doc, start, node_id) of all nodes below the given ones (doc, node_id), of one tag or of all; one closure for all files."""
    edges = nodes.where("parent_id is not null").select("doc", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))
    found = graph.closure(starts.select("doc", F.col("node_id").alias("start")), edges, ["doc"]).where("depth > 0").select("doc", "start", F.col("node").alias("node_id"))
    return found if tag is None else found.join(nodes.where(F.col("tag") == tag).select("doc", "node_id"), ["doc", "node_id"], "left_semi")


def ancestor(nodes: DataFrame, starts: DataFrame, tag: str) -> DataFrame:
    """(doc, node_id, ancestor) the nearest node of a tag above each of the given ones; none: no row."""
    edges = nodes.where("parent_id is not null").select("doc", F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
    up = graph.closure(starts.select("doc", F.col("node_id").alias("start")), edges, ["doc"]).where("depth > 0")
    up = up.join(nodes.where(F.col("tag") == tag).select("doc", F.col("node_id").alias("node")), ["doc", "node"])
    return up.groupBy("doc", F.col("start").alias("node_id")).agg(F.min_by("node", "depth").alias("ancestor"))


def lineage_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables that the tracers read (inst, port, attr, conn, target_field, load_order) from the exports' nodes.

    A mapping's id is 'folder/mapping', a subject's its folder. A transformation's definition is the mapping's own before the
    folder's; an instance's attributes stand before its definition's. Sources and targets take their ports from the folder.
    """
    el = lambda tag, *names: attributes(nodes, tag, *names)
    folder = el("FOLDER", "NAME").select("doc", F.col("node_id").alias("folder_id"), F.col("name").alias("subject_id"))
    mapping = el("MAPPING", "NAME").select("doc", F.col("parent_id").alias("folder_id"), F.col("node_id").alias("map_node"), F.col("name").alias("mapping")).join(folder, ["doc", "folder_id"])
    mapping = mapping.withColumn("mapping_id", F.concat_ws("/", "subject_id", "mapping"))
    inside = lambda df: df.withColumnRenamed("parent_id", "map_node").join(mapping, ["doc", "map_node"])

    raw = inside(el("INSTANCE", "NAME", "TYPE", "TRANSFORMATION_NAME", "TRANSFORMATION_TYPE", "REUSABLE_TRANSFORMATION_NAME"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    raw = raw.withColumn("definition", F.coalesce(blank("transformation_name"), blank("reusable_transformation_name"), F.col("name")))
    made = el("TRANSFORMATION", "NAME", "TYPE", "TEMPLATENAME").select("doc", "parent_id", F.col("node_id").alias("def_id"), F.col("name").alias("definition"), F.col("type").alias("def_type"), "templatename")
    own = made.select("doc", F.col("parent_id").alias("map_node"), "definition", F.struct("def_id", "def_type", "templatename").alias("own"))
    shared = made.select("doc", F.col("parent_id").alias("folder_id"), "definition", F.struct("def_id", "def_type", "templatename").alias("shared"))
    inst = raw.join(own, ["doc", "map_node", "definition"], "left").join(shared, ["doc", "folder_id", "definition"], "left").withColumn("of", F.coalesce("own", "shared"))
    kind = F.when(F.upper("type") == "SOURCE", "Source Definition").when(F.upper("type") == "TARGET", "Target Definition").otherwise(F.coalesce(F.nullif("of.def_type", F.lit("")), blank("transformation_type"), blank("type")))
    inst = inst.select("doc", "node_id", "folder_id", "mapping_id", "subject_id", F.col("name").alias("instance"), F.substring_index("name", ".", 1).alias("base"), "definition", kind.alias("type"), blank("of.templatename").alias("template"), "of.def_id", "ord")

    fields = el("TRANSFORMFIELD", "NAME", "PORTTYPE", "EXPRESSION", "GROUP", "SORTORDER").select("doc", F.col("parent_id").alias("def_id"), F.col("name").alias("field"), "ord", "porttype", F.col("group").alias("grp"), F.col("sortorder").alias("sort_order"), blank("expression").alias("expression"))
    ports = inst.drop("ord").join(fields, ["doc", "def_id"])
    tables = None
    for tag in ("SOURCE", "TARGET"):
        owner = el(tag, "NAME").select("doc", F.col("node_id").alias("table_id"), F.col("parent_id").alias("folder_id"), F.col("name").alias("definition"), F.lit(f"{tag.title()} Definition").alias("type"))
        column = el(f"{tag}FIELD", "NAME").select("doc", F.col("parent_id").alias("table_id"), F.col("name").alias("field"), "ord")
        tables = owner.join(column, ["doc", "table_id"]) if tables is None else tables.unionByName(owner.join(column, ["doc", "table_id"]))
    of_tables = inst.drop("ord").join(tables, ["doc", "folder_id", "definition", "type"])
    columns = ["mapping_id", "instance", "type", "template", "field", "ord"]
    text = F.lit(None).cast("string")
    port = ports.select(*columns, "porttype", "grp", "sort_order", "expression").unionByName(of_tables.select(*columns, F.lit("").alias("porttype"), F.lit("").alias("grp"), F.lit("").alias("sort_order"), text.alias("expression")))

    values = el("TABLEATTRIBUTE", "NAME", "VALUE").select("doc", F.col("parent_id").alias("owner"), F.col("name"), "value")
    of_definition = inst.select("doc", F.col("def_id").alias("owner"), "mapping_id", "instance", "type", F.lit(0).alias("rank"))
    of_instance = inst.select("doc", F.col("node_id").alias("owner"), "mapping_id", "instance", "type", F.lit(1).alias("rank"))
    attr = values.join(of_definition.unionByName(of_instance), ["doc", "owner"]).where("name <> ''").groupBy("mapping_id", "instance", "type", "name").agg(F.max_by("value", "rank").alias("value"))

    conn = inside(el("CONNECTOR", "FROMINSTANCE", "FROMFIELD", "TOINSTANCE", "TOFIELD")).select("mapping_id", F.col("frominstance").alias("from_inst"), F.col("fromfield").alias("from_field"), F.col("toinstance").alias("to_inst"), F.col("tofield").alias("to_field"))
    loads = inside(el("TARGETLOADORDER", "TARGETINSTANCE", "ORDER")).select("mapping_id", F.col("targetinstance").alias("target_instance"), F.col("order").alias("ord"))
    return {
        "inst": inst.drop("doc", "node_id", "folder_id", "def_id"), "port": port, "attr": attr,
        "conn": conn.where("from_inst <> '' and from_field <> '' and to_inst <> '' and to_field <> ''"),
        "target_field": tables.where("type = 'Target Definition'").select("definition", "field").distinct(), "load_order": loads,
    }


def detail_sheets(spark: SparkSession, path: str) -> DataFrame:
    """{sheets: {name: {records}}} files as (file, sheet, seq, record); records all blank are dropped."""
    schema = "sheets map<string, struct<row_count: long, columns: array<string>, records: array<map<string,string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("j"))
    rows = rows.select("file", F.explode("j.sheets").alias("sheet", "body")).select("file", "sheet", F.posexplode("body.records").alias("seq", "record"))
    return rows.where(F.exists(F.map_values("record"), lambda v: F.trim(v) != ""))


def unique_headers(headers: DataFrame) -> DataFrame:
    """A10: (sheet, pos, name) to names without blanks or repeats: column_N, and _2, _3 for later ones."""
    from pyspark.sql import Window

    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("column_"), (F.col("pos") + 1).cast("string")))
    n = F.row_number().over(Window.partitionBy("sheet", "fixed").orderBy("pos"))
    return headers.withColumn("fixed", name).withColumn("n", n).select("sheet", "pos", F.when(F.col("n") > 1, F.concat_ws("_", "fixed", F.col("n").cast("string"))).otherwise(F.col("fixed")).alias("name"))


def consolidate_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Per file its root's type; and the records of all files, where every root is a list."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    kind = F.when(F.col("value").startswith("["), "list").when(F.col("value").startswith("{"), "object").otherwise("scalar")
    inputs = raw.select("file", kind.alias("root_type"))
    all_lists = inputs.agg(F.coalesce(F.bool_and(F.col("root_type") == "list"), F.lit(False)).alias("ok"))  # one row
    merged = raw.crossJoin(F.broadcast(all_lists)).where("ok").select("file", F.posexplode(F.from_json("value", "array<string>")).alias("seq", "record"))
    return inputs, merged


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    """One folder of JSON lines for each mapping or type."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).json(path)
