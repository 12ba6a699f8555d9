"""Split reading gives the node table of whole reading, whatever the ranges."""

import random

import pytest

from metaloom.sources import xml_export, xml_split

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE EXPORT SYSTEM "x.dtd">\n'
HAND = HEAD + """<EXPORT><FOLDER NAME="é &gt; ü"><A X="1 > 2" Y='"&amp;>'/>tail of A<B>text<!-- no <C> here > --><C/>after C<![CDATA[raw <D> > text]]></B>
<?pi some > thing?><E><F><G>deep</G></F>back</E></FOLDER>end of folder
</EXPORT>
"""


def random_xml(seed, size):
    rng, out, stack = random.Random(seed), [HEAD, "<ROOT>"], ["ROOT"]
    while len(out) < size:
        move = rng.random()
        if move < 0.35 and len(stack) < 9:
            stack.append(rng.choice(["FOLDER", "MAPPING", "T"]))
            out.append(f'<{stack[-1]} NAME="n{len(out)}" V="{rng.choice(["a", "x > y", "&lt;"])}">')
        elif move < 0.6:
            out.append(f"<LEAF A='{len(out)}'/>")
        elif move < 0.75:
            out.append(f"word{len(out)} ")
        elif move < 0.8:
            out.append(f"<!-- c > <X> {len(out)} -->")
        elif len(stack) > 1:
            out.append(f"</{stack.pop()}>")
    return "".join(out + [f"</{t}>" for t in reversed(stack)])


def listed(df):
    return sorted(((r["doc"].split("/")[-1], r["node_id"], r["parent_id"], r["ord"], r["depth"], r["tag"], sorted((r["attributes"] or {}).items()), r["text"], r["tail"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [300, 64 << 20])
def test_ranges_give_the_same_nodes(spark, tmp_path, block):
    (tmp_path / "hand.xml").write_text(HAND)
    (tmp_path / "random.xml").write_text(random_xml(3, 400))
    (tmp_path / "empty.xml").write_text("")
    want = [r for r in listed(xml_export.xml_nodes(spark, str(tmp_path))) if r[5] is not None]
    assert listed(xml_split.xml_nodes_split(spark, str(tmp_path), block)) == want and len(want) > 200
    check = {r["doc"].split("/")[-1]: r["lossless"] for r in xml_split.lossless_check_split(spark, str(tmp_path), block).collect()}
    assert check == {"hand.xml": True, "random.xml": True}


def test_several_tasks_share_a_file(spark, tmp_path):
    (tmp_path / "large.xml").write_text(random_xml(4, 60_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = xml_split.xml_nodes_split(spark, str(tmp_path), 100_000)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert listed(found) == listed(xml_export.xml_nodes(spark, str(tmp_path)))
    assert sum(len(r[5]) > 0 for r in listed(found)) > 20_000


def test_not_well_formed(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<A><B></A>")
    assert [r["text"] for r in xml_split.xml_nodes_split(spark, str(tmp_path)).where("tag is null").collect()]
