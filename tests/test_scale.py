"""What keeps the queries within their limits on larger tables."""

import os
import random
import re

from pyspark.sql import functions as F

from metaloom.operators import chain_order, chains, details, graph, lineage, typed_edges
from metaloom.plans import extras
from metaloom.plans import lineage as plans_lineage
from metaloom.sources import fixture
from metaloom.sources.store import cut, keeps_texts_once, shared_folder, written

FACTOR = "spark.sql.sources.fileCompressionFactor"
LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_broadcast_by_their_rows_in_memory(spark):
    spark.conf.unset(FACTOR)
    path = written(spark.range(200_000).select((F.col("id") % 1000).alias("k"), F.lit("INST_1.F1").alias("node")), "repeating")
    fixture.repository(spark, "/root/testdata/sf0.001")
    held = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "1m")  # the files are smaller, the rows are not
        rows = spark.read.parquet(path)
        assert "SortMergeJoin" in _plan(rows.join(rows.withColumnRenamed("node", "other"), "k"))
        tiny = spark.read.parquet(written(spark.range(10).withColumnRenamed("id", "k"), "tiny"))
        assert "BroadcastHashJoin" in _plan(rows.join(tiny, "k"))
        spark.conf.set(FACTOR, "3")
        fixture.repository(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(FACTOR) == "3"
    finally:
        spark.conf.set(LIMIT, held)
        spark.conf.unset(FACTOR)


def test_small_graphs_are_walked_in_one_shuffle_as_in_rounds(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in ["ab", "bc", "cb", "ad", "de", "ce"]] + [(2, "a", "b"), (3, "x", "x"), (None, "a", "b")], "k int, src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "z"), (3, "x"), (None, "a")], "k int, start string")
    group = spark.sparkContext.statusTracker().getJobIdsForGroup
    rows = {}
    for bound in (100, 0, 3):  # walked, in rounds, both
        spark.sparkContext.setJobGroup(f"closure-{bound}", "")
        rows[bound] = sorted(map(str, graph.closure(starts, edges, ["k"], bound=bound).collect()))
    assert rows[100] == rows[0] == rows[3] and len(rows[0]) == 13
    assert len(group("closure-100")) < len(group("closure-0"))
    seeds = spark.createDataFrame([(1, "p", "a"), (1, "p", "d"), (1, "q", "c"), (2, "p", "b")], "k int, s string, node string")
    spreads = [sorted(map(tuple, graph.spread(seeds, edges, ["k", "s"], bound=b).collect())) for b in (100, 0, 3)]
    assert spreads[0] == spreads[1] == spreads[2] and len(spreads[0]) == 9
    plain = [sorted(map(tuple, graph.spread(seeds.select("k", "node"), edges, ["k"], bound=b).collect())) for b in (100, 0)]
    assert plain[0] == plain[1] and len(plain[0]) == 6


def test_cross_session_links_gather_no_pairs(spark):
    rows = [("T", "F", m, m % 2 + 1) for m in range(400)] + [("T", "G", 3, 1), ("U", "F", 5, 1), ("U", "F", 2, 2), ("U", "F", None, 2)]
    found = lineage.cross_session_links(spark.createDataFrame(rows, "table_name string, field_name string, mapping_id long, widget_type int"))
    got = {(r["table_name"], r["field_name"], r["reader"]): r for r in found.collect()}
    assert len(got) == 200 and got["U", "F", 5]["links"] == "m_2.U.F" and got["T", "F", 4]["links"] == "m_1.T.F\nm_3.T.F" and got["T", "F", 398]["n_links"] == 199
    plan = _plan(found)
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Exchange" not in above, plan  # pairs are neither dealt out nor gathered


def test_detail_texts_of_one_name_are_dealt_out(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(details, "PIECE_CHARS", 20)
    monkeypatch.setattr(details, "cut", lambda df, name: tables.setdefault(name, cut(df, name)))
    inst = [(f"S{i}", f"M{i}", "Big") for i in range(40)] + [("S", "M", "None"), ("S", "M", None)]
    rows = [("s0", "m0", " big", "t0"), (None, "M1", "BIG", "t1"), (None, None, "big", "t2"), (None, None, "Big", "t2"), (None, None, "big", None)]
    found = details.detail_match(spark.createDataFrame(inst, "session_name string, mapping_name string, name string"), spark.createDataFrame(rows, "session_name string, mapping_name string, name string, text string"))
    got = {(r["session_name"], r["name"]): (r["level"], r["details"]) for r in found.collect()}
    assert len(got) == 42 and got["S0", "Big"] == (1, "t0") and got["S1", "Big"] == (2, "t1") and got["S", "None"] == got["S", None] == (None, None)
    assert {got[f"S{i}", "Big"] for i in range(2, 40)} == {(3, "t0\nt1\nt2")}
    big = tables["detail-names"].where("__name = 'big'").first()
    assert big["n"] == 38 and big["pieces"] == 17


def test_dependencies_deal_out_their_rows_once(spark):
    rows = [(1, "E.G1", "Expression", None, f, "INPUT/OUTPUT", e) for f, e in [("a", None), ("A", None), ("X", "a + B + a"), ("X", "a + B + a"), ("B", "b")]] + [(2, "E", "Expression", None, "X", "OUTPUT", "A")]
    port = spark.createDataFrame(rows, "mapping_id long, instance string, type string, template string, field string, porttype string, expression string")
    held = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "-1")
        found = typed_edges.dependencies(port)
        assert sorted(tuple(r) for r in found.collect()) == [(1, "E.G1.X", "E.G1.A"), (1, "E.G1.X", "E.G1.B"), (1, "E.G1.X", "E.G1.a")]
        assert _plan(typed_edges.dependencies(port)).count("Exchange hashpartitioning") == 2  # the two sides of the join
    finally:
        spark.conf.set(LIMIT, held)


def test_parents_deal_out_their_edges_once(spark):
    """Against the same edges joined one by one; ports given twice, of which one stops or ends a walk, and nodes that two instances spell alike."""
    rng = random.Random(3)
    kinds = [("Expression", None), ("Router", None), ("Joiner", None), ("Lookup Procedure", None), ("Custom Transformation", "Union Transformation"), ("SQL", None), ("Rank", None), ("Normalizer", None), ("Source Definition", None), ("Target Definition", None)]
    ports, conn, attr = [], [], []
    for m in (1, 2):
        names = [(f"I{i}" + (".G1" if k[0] in ("Router", "Joiner") and i % 2 else ""), *k) for i, k in enumerate(kinds * 2)]
        for inst, type_, template in names + rng.sample(names, 5) + [("I0.A", "Expression", None)]:
            for field in rng.sample(["A", "b", "B", "A.A", "RANKINDEX", "GK_1"], 4):
                ports.append((m, inst, type_, template, field, rng.choice(["INPUT", "OUTPUT", "RETURN"]), rng.choice([None, "", "A", "A + B", "b = A", "f(gk_1)"])))
        for _ in range(300):
            (a, *_), (b, *_) = rng.sample(names, 2)
            conn.append((m, a, rng.choice(["a", "A", "b", "B"]), rng.choice([b, b.split(".")[0], f"{b}.IN1"]), rng.choice(["A", "b", "B", "RANKINDEX"])))
        attr += [(m, i, t, n, v) for i, t, _ in names for n, v in (("Lookup condition", "A = B AND b = A"), ("Sql Query", "select :a, :B")) if (t == "SQL") == (n == "Sql Query")]
    port = spark.createDataFrame(ports, "mapping_id long, instance string, type string, template string, field string, porttype string, expression string")
    links = spark.createDataFrame(conn, "mapping_id long, from_inst string, from_field string, to_inst string, to_field string")
    attrs = spark.createDataFrame(attr, "mapping_id long, instance string, type string, name string, value string")
    T = typed_edges
    key = ["mapping_id", "node"]
    walked = T.connector_edges(port, links).join(T.stops(port), key, "left_anti")
    inner = T.dependencies(port).unionByName(T.lookup_edges(attrs, port)).unionByName(T.bind_edges(attrs, port)).unionByName(T.opaque_edges(port))
    ends = T.generated_ports(port).select(*key).union(T.return_ports(port).select(*key))
    want = walked.unionByName(inner).distinct().join(ends, key, "left_anti")
    held = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "-1")
        got = T.parents(port, attrs, links)
        rows = sorted(tuple(r) for r in got.collect())
        assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) > 100
        plan = _plan(T.parents(port, attrs, links))
        assert "LeftAnti" not in plan and plan.count("Exchange hashpartitioning") < _plan(want).count("Exchange hashpartitioning") - 5
    finally:
        spark.conf.set(LIMIT, held)


def test_ties_are_made_once_for_both_ways(spark):
    ports = [(1, i, t, None, f, "INPUT", e) for i, t in [("E", "Expression"), ("L", "Lookup Procedure"), ("F", "Filter")] for f, e in [("A", "A + B"), ("B", None), ("C", None)]]
    port = spark.createDataFrame(ports, "mapping_id long, instance string, type string, template string, field string, porttype string, expression string")
    attr = spark.createDataFrame([(1, "L", "Lookup Procedure", "Lookup condition", "A = C"), (1, "F", "Filter", "Filter Condition", "B > C")], "mapping_id long, instance string, type string, name string, value string")
    held = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "-1")
        found = typed_edges.co_references(attr, port)
        one = {(f"{i}.A", f"{i}.B") for i in "ELF"} | {("L.A", "L.C"), ("F.B", "F.C")}
        assert {(r["node"], r["parent"]) for r in found.collect()} == one | {(b, a) for a, b in one}
        assert _plan(typed_edges.co_references(attr, port)).count("Generate inline") == 1  # after the ties, which aren't made again for the other way
    finally:
        spark.conf.set(LIMIT, held)
    edges = spark.createDataFrame([(1, "a", "b")] * 3, "k int, src string, dst string")
    seeds = spark.createDataFrame([(1, "a")] * 2, "k int, node string")
    assert [sorted(map(tuple, graph.spread(seeds, edges, ["k"], bound=b).collect())) for b in (100, 0)] == [[(1, "a"), (1, "b")]] * 2


def test_chains_take_a_round_for_a_mapping_not_for_a_step(spark):
    """Also where a chain comes back to its mapping by another entrance, and on a cycle of mappings."""
    rows = [(f"{m}|I{i}.F", f"{m}|I{i + 1}.F") for m in range(4) for i in range(30)] + [(f"{m}|I30.F", f"{(m + 1) % 4}|I10.F") for m in range(3)]
    rows += [("3|I30.F", "0|I5.F"), ("2|I12.F", "2|I11.F"), ("9|X.F", "9|X.F"), ("9|X.F", "8|GONE.F")] + [("0|I0.F", "0|I1.F")]
    starts = [(f"{m}|I0.F",) for m in range(4)] + [("3|I25.F",), ("9|X.F",), ("7|LONE.F",), ("9|X.F",)]
    edges, begin = spark.createDataFrame(rows, "node string, parent string"), spark.createDataFrame(starts, "start string")
    want = set()
    for (start,) in starts:
        stack = [start]
        while stack:
            node = stack.pop()
            if (start, node) not in want:
                want.add((start, node))
                stack += [p for n, p in rows if n == node]
    spark.sparkContext.setJobGroup("chain-across", "")
    got = [tuple(r) for r in chains.chain(begin, edges).collect()]
    assert sorted(got) == sorted(want)
    across = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain-across"))
    spark.sparkContext.setJobGroup("chain-rounds", "")
    graph.closure(begin, edges.toDF("src", "dst"), []).collect()
    assert 2 * across < len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain-rounds"))


def test_targets_of_a_folder_are_not_dealt_to_every_chain(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(chain_order, "cut", lambda df, name: made.setdefault(name, df))
    inst = spark.createDataFrame([(m, 1, f"T{m}", f"TAB{m}", "Target Definition") for m in range(4)], "mapping_id int, subject_id int, instance string, definition string, type string")
    lines = spark.createDataFrame([(f"{m}|T{m}.A", 1, f"T{m}.A") for m in range(4)], "start string, pos int, line string")
    starts = spark.createDataFrame([(f"{m}|T{m}.A", 1) for m in range(4)], "start string, subject_id int")
    chain_order.primary_sources(lines, starts, inst)
    held = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "-1")
        plan = _plan(made["chain-targets"])
    finally:
        spark.conf.set(LIMIT, held)
    assert not re.search(r"SortMergeJoin \[subject_id#\d+\],", plan)  # a folder alone is no key


def test_edges_of_a_name_with_instances_of_two_kinds(spark):
    inst = spark.createDataFrame([(1, "R.A", "Router"), (1, "R.B", "Joiner"), (1, "N", "Normalizer"), (1, "S", None), (2, "R", "Router")], "mapping_id int, instance string, type string")
    conn = spark.createDataFrame([(1, "R.A", "G.f", "N", "H.g"), (1, "S", "G.f", "R", "K.h"), (2, "R", "G.f", "Q", "L.i")], "mapping_id int, from_inst string, from_field string, to_inst string, to_field string")
    got = sorted(tuple(r) for r in chains.normalised_edges(conn, inst).collect())
    assert got == [(1, "R", "G.f", "N", "g"), (1, "R", "f", "N", "g"), (1, "S", "G.f", "R", "K.h"), (2, "R", "f", "Q", "L.i")]


def test_mapplets_deal_out_only_what_touches_one(spark, monkeypatch):
    made = []
    monkeypatch.setattr(details, "cut", lambda df, name: made.append((name, cut(df, name))) or made[-1][1])
    conn = [(m, f"A{i}", "F", f"A{i + 1}", "F") for m in (1, 2) for i in range(20)] * 2 + [(1, "A20", "F", "M", "F"), (1, "M", "F", "M", "F"), (1, "M", "G", "T", "F"), (1, "M/E", "F", "T", "F"), (3, "M", "F", "T", "F"), (None, "M", "F", "T", "F")]
    edge = "from_inst string, from_field string, to_inst string, to_field string"
    inner = spark.createDataFrame([("D", "IN", "F", "E", "F"), ("D", "E", "F", "OUT", "F"), ("D", "IN", "F", "Q", "F"), ("E", "IN", "F", "X", "F"), ("E", "X", "F", "OUT", "F")], f"definition string, {edge}")
    inst = spark.createDataFrame([(1, "M", "D")], "mapping_id int, instance string, definition string")
    nested = spark.createDataFrame([("D", "E", "E")], "definition string, instance string, inner_definition string")
    got = sorted(map(str, details.expand_mapplets(spark.createDataFrame(conn, f"mapping_id int, {edge}"), inst, inner, nested).collect()))
    want = [(m, f"A{i}", "F", f"A{i + 1}", "F") for m in (1, 2) for i in range(20)] + [(3, "M", "F", "T", "F"), (None, "M", "F", "T", "F")]
    want += [(1, a, "F", b, "F") for a, b in [("A20", "M/E/X"), ("A20", "M/Q"), ("M/E/X", "M/E/X"), ("M/E/X", "M/Q"), ("M/E/X", "T")]]
    assert got == sorted(f"Row(mapping_id={m}, from_inst={a!r}, to_inst={c!r}, from_field={b!r}, to_field={d!r})" for m, a, b, c, d in want)
    assert max(df.count() for name, df in made if name == "expanded") < 10


def test_a_trace_reads_the_parents_that_are_written(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lineage, "parent_edges", lambda *x, own=lineage.parent_edges: made.append(x) or own(*x))
    plans_lineage._trace(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def _size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


CODEC, DICTIONARY = "spark.sql.parquet.compression.codec", "parquet.dictionary.page.size"


def test_links_of_a_table_are_written_without_what_they_share(spark, tmp_path):
    rows = [("T", "F", m, m % 2 + 1) for m in range(6_000)] + [("A\nB", "C\n", m, m % 2 + 1) for m in range(7)] + [("A\nB", "C\n", None, 1), (None, "F", 1, 1), (None, "F", 2, 2)]
    try:
        plans_lineage.f47(spark, "/root/testdata/sf0.001")  # it sets what the session's writers do
        found = lineage.cross_session_links(spark.createDataFrame(rows, "table_name string, field_name string, mapping_id long, widget_type int"))
        found.write.parquet(str(tmp_path / "links"))
    finally:
        spark.conf.unset(CODEC)
        spark.conf.unset(DICTIONARY)
    read = {(r["table_name"], r["reader"]): r for r in spark.read.parquet(str(tmp_path / "links")).collect()}
    assert len(read) == 2_999 + 3 and read["A\nB", 4]["links"] == "m_1.A\nB.C\n\nm_3.A\nB.C\n" and read["A\nB", 6]["n_links"] == 3
    assert all(r["links"] == "\n".join(f"m_{w}.T.F" for w in range(1, at, 2)) for (table, at), r in read.items() if table == "T")
    assert _size(tmp_path / "links") * 50 < sum(len(r["links"]) for r in read.values())


def test_written_tables_replace_the_shuffle_files_of_their_job(spark):
    files = lambda: sum(f.endswith(".data") for at, _, fs in os.walk(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for f in fs)
    before = files()
    path = written(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "shuffled")
    assert files() <= before and any(".zstd." in f for f in os.listdir(path)) and shared_folder(spark) in path


def test_a_long_text_of_many_instances_is_written_once(spark, tmp_path, monkeypatch):
    tables = {}
    inst = spark.range(400).select(F.concat(F.lit("S"), "id").alias("session_name"), F.concat(F.lit("M"), "id").alias("mapping_name"), F.lit("Big").alias("name"))
    rows = spark.range(250_000).select(F.lit(None).cast("string").alias("session_name"), F.lit(None).cast("string").alias("mapping_name"), F.lit("big").alias("name"), F.md5(F.col("id").cast("string")).substr(1, 8).alias("text"))
    try:
        extras.f44(spark, "/root/testdata/sf0.001")  # it sets what the session's writers do
        monkeypatch.setattr(details, "cut", lambda df, name: tables.setdefault(name, cut(df, name)))
        details.detail_match(inst, rows).write.parquet(str(tmp_path / "details"))
    finally:
        spark.conf.unset(CODEC)
        spark.conf.unset(DICTIONARY)
    got = spark.read.parquet(str(tmp_path / "details")).agg(F.count("*").alias("n"), F.countDistinct("details").alias("texts"), F.sum(F.length("details")).alias("chars")).first()
    assert got["n"] == 400 and got["texts"] == 1 and got["chars"] > 800_000_000
    assert _size(tmp_path / "details") < 40_000_000  # a text or two for each task, not one for each instance
    assert tables["detail-names"].first()["pieces"] <= details.PIECES * 8
    spark.conf.set(CODEC, "gzip")
    try:
        keeps_texts_once(spark)
        assert spark.conf.get(CODEC) == "gzip"
    finally:
        spark.conf.unset(CODEC)
        spark.conf.unset(DICTIONARY)
