"""Completeness by name, and path counts, on hand-made graphs."""

import random

from metaloom.operators import graph, lineage
from metaloom.operators import records as R
from metaloom.operators import typed_edges as T

PORT = "mapping_id long, instance string, type string, template string, field string, porttype string, expression string"
ROWS = [
    (1, "SRC", "Source Definition", None, "A", "OUTPUT", None), (1, "SRC", "Source Definition", None, "B", "OUTPUT", None),
    (1, "EXP", "Expression", None, "A", "INPUT/OUTPUT", None), (1, "EXP", "Expression", None, "OUT", "OUTPUT", "IIF(A > 0, A, 0)"),
    (1, "TGT", "Target Definition", None, "X", "INPUT", None), (1, "TGT", "Target Definition", None, "Y", "INPUT", None), (1, "TGT", "Target Definition", None, "Z", "INPUT", None),
]
CONN = [(1, "SRC", "A", "EXP", "A"), (1, "EXP", "OUT", "TGT", "X"), (1, "SRC", "B", "TGT", "Y")]


def test_records_and_completeness(spark):
    port = spark.createDataFrame(ROWS, PORT)
    conn = spark.createDataFrame(CONN, "mapping_id long, from_inst string, from_field string, to_inst string, to_field string")
    inst = port.select("mapping_id", "instance", "type").distinct().selectExpr("mapping_id", "7L AS subject_id", "instance", "instance AS base", "concat('D_', instance) AS definition", "type", "CAST(NULL AS string) AS template", "1L AS ord")
    attr = spark.createDataFrame([], "mapping_id long, instance string, type string, name string, value string")
    expected = port.where("type = 'Target Definition'").select("mapping_id", "instance", "field")
    parent = T.parents(port, attr, conn)
    trace = T.traced(T.target_starts(port, conn), parent)
    records = R.lineage_records(trace, parent, inst, port, attr)
    x = records.where("target_field = 'X'").first()
    assert x["sources"] == ["SRC.A"] and [tuple(p) for p in x["path"]] == [(0, "TGT", "X"), (1, "EXP", "OUT"), (2, "EXP", "A"), (3, "SRC", "A")]
    assert x["primary_rule"] == "IIF(A > 0, A, 0)" and x["plain_rule"] == "If A > 0 then A, otherwise 0" and x["unresolved"] == [] and x["lookups"] == []
    assert [tuple(t) for t in x["touched"]] == [("EXP", "A", "Expression", None), ("EXP", "OUT", "Expression", "IIF(A > 0, A, 0)")]
    reached = R.reachable(port, conn)
    report = R.completeness_report(expected, records, reached, trace).first()
    # Z has no feeder; all that connectors reach is visited
    assert not report["is_complete"] and report["missing"] == ["TGT.Z"] and report["unvisited"] == [] and (report["expected_fields"], report["records"]) == (3, 2)
    fine = R.completeness_report(expected.where("field != 'Z'"), records, reached, trace).first()
    assert fine["is_complete"] and fine["missing"] == []
    # a walk that is cut before SRC.B
    short = trace.where("node != 'SRC.B'")
    cut = R.completeness_report(expected.where("field != 'Z'"), records, reached, short).first()
    assert not cut["is_complete"] and cut["unvisited"] == ["SRC.B"]
    rows = {tuple(r)[1:] for r in R.diagnostic_rows(expected, records, conn, R.unvisited(reached, short), T.unknown_pairs(attr, port)).collect()}
    assert rows == {("missing_connector", "TGT", "Z", "Target field has no inbound connector"), ("missing_connector", "SRC", "B", "Connectors reach the port, no trace visits it")}
    assert R.completeness_report(expected, records.limit(0), reached.limit(0), trace.limit(0)).first()["missing"] == ["TGT.X", "TGT.Y", "TGT.Z"]

    whole = {r["start"]: r for r in records.collect()}
    for want, more in (("lookups",), []), (("unresolved",), []), (("touched", "stop_expressions"), ["primary_rule", "plain_rule"]):
        part = R.lineage_records(trace, parent, inst, port, attr, want)
        assert part.columns == ["mapping_id", "start", "target_instance", "target_field", *want, *more]
        assert {r["start"]: r for r in part.collect()} == {k: tuple(r[c] for c in part.columns) for k, r in whole.items()}


def test_path_counts_know_an_explosion(spark):
    links = [("S", "a0"), ("S", "b0")] + [(f"{x}{i}", f"{y}{i + 1}") for i in range(12) for x in "ab" for y in "ab"] + [("a12", "T"), ("b12", "T"), ("S", "U"), ("p", "q"), ("q", "p"), ("S", "p"), ("p", "V"), ("T", "W")]
    edges = spark.createDataFrame([(1, a, b) for a, b in links], "g int, src string, dst string")
    name = lambda *n: spark.createDataFrame([(1, x) for x in n], "g int, node string")
    got = {r["target"]: (r["n_paths"], r["longest"], r["looped"]) for r in graph.path_counts(edges, name("S"), name("T", "U", "V", "W"), ["g"]).collect()}
    assert got == {"T": (2.0**13, 15, False), "U": (1.0, 2, False), "V": (None, None, True)}  # W lies behind T, which ends its paths


def test_backward_paths_equal_forward_paths(spark):
    links = [("S", "a"), ("S", "b"), ("a", "c"), ("b", "c"), ("c", "T"), ("c", "d"), ("d", "c"), ("a", "T"), ("b", "dead"), ("R", "c")]
    edges = spark.createDataFrame([(1, a, b) for a, b in links], "g int, src string, dst string")
    name = lambda *n: spark.createDataFrame([(1, x) for x in n], "g int, node string")
    listed = lambda df: sorted(tuple(r["path"]) for r in df.collect())
    back = listed(graph.backward_paths(edges, name("S", "R"), name("T"), name("T"), ["g"]))
    assert back == listed(graph.forward_paths(edges, name("S", "R"), name("T"), ["g"])) and len(back) == 4


def test_paths_by_target_are_all_paths(spark):
    rows = [(1, "S", "a"), (1, "S", "b"), (1, "a", "T"), (1, "b", "T"), (1, "a", "U")]
    edge = spark.createDataFrame(rows, "mapping_id int, src string, dst string")
    port = spark.createDataFrame([(1, "S", 1), (1, "a", 5), (1, "b", 5), (1, "T", 2), (1, "U", 2)], "mapping_id int, node string, widget_type int")
    listed = lambda df: sorted(tuple(r["path"]) for r in df.collect())
    assert listed(lineage.paths_by_target(edge, port, 1)) == listed(lineage.paths(edge, port)) == [("S", "a", "T"), ("S", "a", "U"), ("S", "b", "T")]


def test_paths_are_counted_and_listed_by_tasks_as_in_rounds(spark):
    rng = random.Random(5)
    rows = [(g, a, b) for g in range(6) for a in "abcdefgh" for b in rng.sample("bcdefghi", 2) if g == 5 or a < b] + [(6, "x", "x"), (6, "x", "y"), (None, "a", "i")]
    edges = spark.createDataFrame(rows + rows[:3], "g int, src string, dst string")
    name = lambda *x: spark.createDataFrame([(g, n) for g in range(7) for n in x], "g int, node string")
    starts, ends = name("a", "b", "x"), name("i", "f", "y")
    listed = lambda df: sorted(map(str, df.collect()))
    ways = {"counts": lambda b: graph.path_counts(edges, starts, ends, ["g"], bound=b), "forward": lambda b: graph.forward_paths(edges, starts, ends, ["g"], bound=b), "backward": lambda b: graph.backward_paths(edges, starts, name("i", "y"), ends, ["g"], bound=b)}
    for what, made in ways.items():
        jobs, rows = [], []
        for bound in (100, 0, 15):  # by tasks, in rounds, both
            spark.sparkContext.setJobGroup(f"{what}-{bound}", "")
            rows.append(listed(made(bound)))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{what}-{bound}")))
        assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 5 and jobs[0] < jobs[1], (what, jobs)
