"""Partitioned sinks read back, and a database read in parts."""

from pathlib import Path

from metaloom.sources import sinks

SCHEMA = "kind string, ord long, text string"


def test_write_ordered(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(k, i, f"t{i}") for k in ("A", "B") for i in range(50)]
    made = sinks.write_ordered(spark.createDataFrame(rows[::-1], SCHEMA), path, ["kind"], ["ord"])
    assert {(r["kind"], r["rows"]) for r in made.collect()} == {("A", 50), ("B", 50)}
    # B is replaced, A stays, C comes new
    sinks.write_ordered(spark.createDataFrame([("B", 2, "new"), ("B", 1, None), ("C", 1, "c")], SCHEMA), path, ["kind"], ["ord"])
    back = sinks.read_ordered(spark, path, SCHEMA)
    assert sorted(tuple(r) for r in back.where("kind <> 'A'").select("kind", "ord", "text").collect()) == [("B", 1, None), ("B", 2, "new"), ("C", 1, "c")]
    assert back.where("kind = 'A'").count() == 50
    check = {r["kind"]: (r["rows"], r["found"], r["whole"]) for r in sinks.checked(back, path, ["kind"]).collect()}
    assert check == {"B": (2, 2, True), "C": (1, 1, True)}
    names = sorted(Path(path, "kind=A").glob("*.json"))
    lines = [line for n in names for line in n.read_text().splitlines()]
    assert [int(line.split('"ord":')[1].split(",")[0]) for line in lines] == list(range(50))


def test_nothing_to_write(spark, tmp_path):
    path = tmp_path / "none"
    assert sinks.write_ordered(spark.createDataFrame([], SCHEMA), str(path), ["kind"], ["ord"]).count() == 0 and not path.exists()


def test_database_in_parts(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/repo;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(-5, 95).selectExpr("id AS MAPPING_ID", "concat('m_', id) AS MAPPING_NAME")
    for name, df in (("REP_ALL", rows), ("REP_NONE", rows.limit(0)), ("REP_ONE", rows.limit(1))):
        df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).save()
    got = sinks.database_repository(spark, url, {"REP_ALL": "MAPPING_ID", "REP_NONE": "MAPPING_ID", "REP_ONE": None}, "APP.", 30, options)
    assert got["REP_ALL"].rdd.getNumPartitions() == 4
    assert sorted(r["MAPPING_ID"] for r in got["REP_ALL"].collect()) == list(range(-5, 95))
    assert got["REP_NONE"].count() == 0 and got["REP_ONE"].count() == 1
