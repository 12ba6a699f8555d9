"""From an export to lineage: each kind of edge on a mapping made by hand; navigation; mapplets; details."""

from metaloom.operators import details
from metaloom.operators import typed_edges as T
from metaloom.sources import records, xml_export


def field(name, porttype="INPUT/OUTPUT", expression="", group=""):
    return f'<TRANSFORMFIELD NAME="{name}" PORTTYPE="{porttype}" EXPRESSION="{expression}" GROUP="{group}"/>'


def transformation(name, kind, *inner, template=""):
    return f'<TRANSFORMATION NAME="{name}" TYPE="{kind}" TEMPLATENAME="{template}">{"".join(inner)}</TRANSFORMATION>'


def instance(name, kind, definition=None, inner="", of="TRANSFORMATION"):
    return f'<INSTANCE NAME="{name}" TYPE="{of}" TRANSFORMATION_TYPE="{kind}" TRANSFORMATION_NAME="{definition or name}">{inner}</INSTANCE>'


def connector(a, b):
    (fi, ff), (ti, tf) = a.rsplit(".", 1), b.rsplit(".", 1)
    return f'<CONNECTOR FROMINSTANCE="{fi}" FROMFIELD="{ff}" TOINSTANCE="{ti}" TOFIELD="{tf}"/>'


XML = "<POWERMART><REPOSITORY><FOLDER NAME='F'><SOURCE NAME='S'><SOURCEFIELD NAME='A'/><SOURCEFIELD NAME='B'/></SOURCE><TARGET NAME='T'>" + "".join(f"<TARGETFIELD NAME='{c}'/>" for c in ("C1", "C2", "C3", "C4", "C5", "C6")) + "</TARGET>" + "".join([
    transformation("EX", "Expression", field("X"), field("COUNT"), field("R", "OUTPUT", "IIF(COUNT &gt; 0, x, 1)")),
    "<MAPPING NAME='m'>",
    transformation("EX", "Expression", field("X"), field("COUNT"), field("P", "OUTPUT", "X"), field("R", "OUTPUT", "IIF(COUNT &gt; 0, x, 1)")),
    transformation("LK", "Lookup Procedure", field("IN_K"), field("K", "LOOKUP/OUTPUT"), field("V", "RETURN"), '<TABLEATTRIBUTE NAME="Lookup condition" VALUE="K = IN_K"/><TABLEATTRIBUTE NAME="Lookup table name" VALUE="OLD"/>'),
    transformation("UN", "Custom Transformation", field("U"), template="Union Transformation"),
    transformation("NR", "Normalizer", field("GK_1")), transformation("RT", "Router", field("F1")),
    transformation("SQ", "Source Qualifier", field("A"), field("B")),
    instance("S", "Source Definition", of="SOURCE"), instance("SQ", "Source Qualifier"), instance("EX", "Expression"), instance("LK", "Lookup Procedure", inner='<TABLEATTRIBUTE NAME="Lookup table name" VALUE="NEW"/>'),
    instance("UN", "Custom Transformation"), instance("NR", "Normalizer"), instance("RT.G1", "Router", "RT"), instance("T", "Target Definition", of="TARGET"),
    *[connector(a, b) for a, b in [("S.A", "SQ.A"), ("S.B", "SQ.B"), ("SQ.a", "EX.X"), ("SQ.B", "EX.COUNT"), ("EX.R", "T.C1"), ("SQ.B", "LK.IN_K"), ("LK.K", "T.C2"), ("LK.V", "T.C3"), ("SQ.A", "UN.G1.U"), ("SQ.B", "UN.G2.u"), ("UN.U", "T.C4"), ("NR.GK_1", "T.C5"), ("SQ.A", "RT.F1"), ("RT.G1.F1", "T.C6")]],
    "</MAPPING></FOLDER></REPOSITORY></POWERMART>",
])


def test_export_to_lineage(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    nodes = xml_export.xml_nodes(spark, str(tmp_path)).cache()
    t = xml_export.lineage_tables(nodes)
    port, attr, conn = t["port"].cache(), t["attr"].cache(), t["conn"].cache()
    assert {r["value"] for r in attr.where("name = 'Lookup table name'").collect()} == {"NEW"} and port.where("instance = 'EX'").count() == 4
    parent = T.parents(port, attr, conn).cache()
    trace = T.traced(T.target_starts(port, conn), parent).cache()
    seen = {}
    for r in trace.collect():
        seen.setdefault(r["start"], set()).add(r["node"])
    source = {"A": {"SQ.A", "S.A"}, "B": {"SQ.B", "S.B"}}
    assert seen["T.C1"] == {"T.C1", "EX.R", "EX.X", "EX.COUNT"} | source["A"] | source["B"]
    assert seen["T.C2"] == {"T.C2", "LK.K", "LK.IN_K"} | source["B"] and seen["T.C3"] == {"T.C3", "LK.V"}
    assert seen["T.C4"] == {"T.C4", "UN.U"} | source["A"] | source["B"] and seen["T.C5"] == {"T.C5", "NR.GK_1"} and seen["T.C6"] == {"T.C6", "RT.G1.F1"} | source["A"]
    found = {r["start"]: r["sources"] for r in T.sources_of(trace, parent, port).collect()}
    assert found["T.C1"] == "S.A, S.B" and found["T.C3"] == "" and found["T.C6"] == "S.A"
    assert {(r["start"], r["lookup_table"]) for r in T.lookups_used(trace, port, attr).collect()} == {("T.C2", "NEW"), ("T.C3", "NEW")}
    assert T.missing_fields(T.target_fields(t["inst"], t["target_field"], conn), trace).count() == 0
    top = nodes.where("tag = 'FOLDER'").select("doc", "node_id")
    assert xml_export.descendants(nodes, top, "CONNECTOR").count() == 14
    assert xml_export.ancestor(nodes, nodes.where("tag = 'TARGETFIELD'").select("doc", "node_id"), "FOLDER").select("ancestor").distinct().count() == 1


def test_nested_mapplets_of_one_chain(spark):
    conn = spark.createDataFrame([(1, "A", "F", "M", "F"), (1, "M", "F", "N", "F"), (1, "N", "F", "T", "F")], "mapping_id int, from_inst string, from_field string, to_inst string, to_field string")
    inst = spark.createDataFrame([(1, "M", "D"), (1, "N", "E")], "mapping_id int, instance string, definition string")
    inner = spark.createDataFrame([("D", "IN", "F", "X", "F"), ("D", "X", "F", "OUT", "F"), ("E", "IN", "F", "D1", "F"), ("E", "D1", "F", "OUT", "F")], "definition string, from_inst string, from_field string, to_inst string, to_field string")
    nested = spark.createDataFrame([("E", "D1", "D")], "definition string, instance string, inner_definition string")
    got = {(r["from_inst"], r["to_inst"]) for r in details.expand_mapplets(conn, inst, inner, nested).collect()}
    assert got == {("A", "M/X"), ("M/X", "N/D1/X"), ("N/D1/X", "T")}


def test_canonical_trees(spark):
    texts = ['{"root": {"tag": "a", "attributes": {"x": "1"}, "children": [{"tag": "b", "children": [{"tag": "c", "text": "t"}]}, {"tag": "d", "tail": "z"}]}}', '{"tag": "only"}', "no json", None, '{"x": 1}']
    got = records.canonical_nodes(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "id", "j").collect()
    assert sorted((r["doc"], r["path"], r["tag"], r["text"], r["tail"]) for r in got) == sorted([(0, [], "a", None, None), (0, [0], "b", None, None), (0, [0, 0], "c", "t", None), (0, [1], "d", None, "z"), (1, [], "only", None, None)], key=lambda x: (x[0], x[1]))
