from metaloom.sources import xml_export

XML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE EXPORT SYSTEM "export.dtd">
<EXPORT><REPOSITORY NAME="R"><FOLDER NAME="F">
<MAPPING NAME="m1"><INSTANCE NAME="SQ" TYPE="TRANSFORMATION" TRANSFORMATION_TYPE="Source Qualifier"/>
<INSTANCE NAME="T" TYPE="TARGET" TRANSFORMATION_NAME="T_DEF"/><CONNECTOR FROMINSTANCE="SQ" FROMFIELD="A" TOINSTANCE="T" TOFIELD="B"/>
<TARGETLOADORDER TARGETINSTANCE="T" ORDER="x1"/></MAPPING>note <SESSION NAME="s" MAPPINGNAME="m1">body</SESSION>
</FOLDER></REPOSITORY></EXPORT>"""


def test_xml_nodes_and_tables(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("<EXPORT><X A='1' B='2'/></EXPORT>")
    (tmp_path / "bad.xml").write_text("<EXPORT><X>")
    nodes = xml_export.xml_nodes(spark, str(tmp_path)).cache()
    rows = {(r["doc"][-5:], r["tag"]): r for r in nodes.collect()}
    assert rows["a.xml", "SESSION"]["text"] == "body" and rows["a.xml", "MAPPING"]["tail"].strip() == "note" and rows["b.xml", "X"]["attributes"] == {"A": "1", "B": "2"}
    assert rows["d.xml", None]["text"]
    tables = xml_export.mapping_tables(nodes)
    assert [(r["mapping"], r["frominstance"], r["tofield"]) for r in tables["connector"].collect()] == [("m1", "SQ", "B")]
    assert tables["instance"].count() == 2 and tables["target_load_order"].first()["place"] is None
    check = {r["doc"][-5:]: r["lossless"] for r in xml_export.lossless_check(spark, str(tmp_path)).collect()}
    assert check["a.xml"] and check["b.xml"] and not check["d.xml"]
    prolog = {r["doc"][-5:]: r for r in xml_export.xml_prolog(spark, str(tmp_path)).collect()}
    assert "export" in prolog["a.xml"]["doctype"] and prolog["b.xml"]["declaration"] is None


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"sheets": {"S": {"row_count": 2, "columns": ["A"], "records": [{"A": "x"}, {"A": " "}]}}}')
    assert [(r["sheet"], r["seq"]) for r in xml_export.detail_sheets(spark, str(tmp_path / "d.json")).collect()] == [("S", 0)]
    heads = spark.createDataFrame([("S", 0, "A"), ("S", 1, " "), ("S", 2, "A"), ("T", 0, "A")], "sheet string, pos int, name string")
    assert sorted(r["name"] for r in xml_export.unique_headers(heads).collect()) == ["A", "A", "A_2", "column_2"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "l" / "b.json").write_text("[3]")
    assert xml_export.consolidate_json(spark, str(tmp_path / "l"))[1].count() == 3
    (tmp_path / "l" / "c.json").write_text("{}")
    inputs, merged = xml_export.consolidate_json(spark, str(tmp_path / "l"))
    assert merged.count() == 0 and sorted(r["root_type"] for r in inputs.collect()) == ["list", "list", "object"]
