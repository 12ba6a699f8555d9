"""Edges of the backward tracer by kind, over the tables of an export (family F).

Tables: inst(mapping_id, instance, base, definition, type, template, ord), port(mapping_id, instance, type, template, field,
porttype, expression), attr(mapping_id, instance, type, name, value), conn(mapping_id, from_inst, from_field, to_inst, to_field).
An edge is (mapping_id, node, parent); a node is 'instance.field'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

NAME = "[A-Za-z_][A-Za-z0-9_$#]*"
KEY = ["mapping_id"]
OPAQUE = "JAVA|SQL|CUSTOM|EXTERNAL"
#: What the name of an attribute that holds a condition or a query contains (fixed values).
CONDITION_WORDS = "condition|filter|sql|query|override|join|where|having"


def node(instance: str = "instance", field: str = "field") -> Column:
    return F.concat(F.col(instance), F.lit("."), F.col(field))


def is_type(pattern: str) -> Column:
    return F.upper("type").rlike(pattern)


def is_union() -> Column:
    return is_type("UNION") | (is_type("CUSTOM") & F.upper(F.coalesce("template", F.lit(""))).contains("UNION"))


def transforms() -> Column:
    return ~F.col("type").isin("Source Definition", "Target Definition")


def passes() -> Column:
    text = F.trim(F.coalesce("expression", F.lit("")))
    return (text == "") | text.rlike(f"^{NAME}$") | (F.upper(text) == F.upper("field"))


def last_names(text: Column) -> Column:
    """Names of a text; of a dotted one the last part."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_$#.]*)"), 1), lambda x: F.element_at(F.split(x, r"\."), -1))


def _with_ports(rows: DataFrame, port: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the port of the same instance that a column names, whatever its case; __u is its name in capitals."""
    own = port.select("mapping_id", "instance", F.col("field").alias(name), F.upper("field").alias("__u"))
    return rows.withColumn("__u", F.upper(of)).join(own, ["mapping_id", "instance", "__u"])


def _to_ports(rows: DataFrame, port: DataFrame, of: str, name: str) -> DataFrame:
    return _with_ports(rows, port, of, name).drop("__u")


def resolved_ports(conn: DataFrame, port: DataFrame) -> DataFrame:
    """ends of connectors whose field is a port only when case is ignored, with the port's own spelling."""
    ends = conn.select("mapping_id", F.col("from_inst").alias("instance"), F.col("from_field").alias("given")).union(conn.select("mapping_id", "to_inst", "to_field")).distinct()
    return _to_ports(ends, port, "given", "field").where("given != field")


def opaque_edges(port: DataFrame) -> DataFrame:
    """output = input of opaque types."""
    form = rf"^\s*({NAME})\s*=\s*({NAME})\s*$"
    rows = port.where(is_type(OPAQUE) & F.col("expression").rlike(form) & (F.upper(F.regexp_extract("expression", form, 1)) == F.upper("field")))
    rows = rows.select("mapping_id", "instance", "field", F.regexp_extract("expression", form, 2).alias("named"))
    return _to_ports(rows, port, "named", "input").select("mapping_id", node().alias("node"), node("instance", "input").alias("parent"))


def generated_ports(port: DataFrame) -> DataFrame:
    """ports that a type makes by itself; they end a walk."""
    made = ((F.col("field") == "RANKINDEX") & is_type("RANK")) | ((F.col("field") == "TCONTROL") & is_type("TRANSACTION CONTROL")) | (F.col("field").startswith("DD_") & is_type("UPDATE STRATEGY")) | (F.col("field").rlike("^(GK_|GCID_)") & is_type("NORMALIZER"))
    return port.where(made & transforms()).select("mapping_id", node().alias("node"), F.concat(F.lit("[GENERATED: "), "type", F.lit("]")).alias("expression"))


def return_ports(port: DataFrame) -> DataFrame:
    """return ports of lookups; they end a walk."""
    return port.where((F.upper("porttype") == "RETURN") & is_type("LOOKUP")).select("mapping_id", node().alias("node"), F.lit("[RETURN: lookup result]").alias("expression"))


def lookup_pairs(attr: DataFrame) -> DataFrame:
    """name pairs of each lookup condition: the last name on either side of an equals sign, each pair once."""
    rows = attr.where(is_type("LOOKUP") & (F.lower("name") == "lookup condition"))
    rows = rows.select("mapping_id", "instance", F.explode(F.split("value", r"(?i)\bAND\b|\bOR\b")).alias("part")).where("part like '%=%'")
    sides = [last_names(F.regexp_extract("part", r"^\s*(.+?)\s*=\s*(.+)$", i)) for i in (1, 2)]
    rows = rows.select("mapping_id", "instance", *[F.try_element_at(x, F.lit(-1)).alias(n) for x, n in zip(sides, ("left", "right"), strict=True)])
    return rows.where("left is not null and right is not null").groupBy("mapping_id", "instance", F.upper("left").alias("u"), F.upper("right").alias("v")).agg(F.min("left").alias("left"), F.min("right").alias("right")).drop("u", "v")


def paired_ports(attr: DataFrame, port: DataFrame) -> DataFrame:
    """Lookup pairs whose two names are ports of the lookup."""
    return _to_ports(_to_ports(lookup_pairs(attr), port, "left", "a"), port, "right", "b").select("mapping_id", "instance", "a", "b")


def lookup_edges(attr: DataFrame, port: DataFrame) -> DataFrame:
    """F16: both directions of each lookup pair."""
    pairs = paired_ports(attr, port).where("a != b")
    one, two = node("instance", "a"), node("instance", "b")
    return pairs.select("mapping_id", one.alias("node"), two.alias("parent")).union(pairs.select("mapping_id", two, one)).distinct()


def unconnected_lookups(port: DataFrame) -> DataFrame:
    """lookups that an expression calls, with the port that it gives them."""
    call = r"(?i)LKP\s*:\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)"
    found = F.arrays_zip(F.regexp_extract_all("expression", F.lit(call), 1).alias("lookup"), F.regexp_extract_all("expression", F.lit(call), 2).alias("given"))
    return port.where(F.col("expression").rlike(call)).select("mapping_id", "instance", "field", F.explode(found).alias("x")).select("mapping_id", "instance", "field", "x.lookup", "x.given").distinct()


def bind_edges(attr: DataFrame, port: DataFrame) -> DataFrame:
    """from every port of an SQL transformation to the ports that its query binds."""
    bound = attr.where(is_type("SQL") & (F.col("name") == "Sql Query")).select("mapping_id", "instance", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r":([A-Za-z_][A-Za-z0-9_]*)"), 1), F.upper))).alias("bound"))
    inputs = _to_ports(bound, port, "bound", "input")
    return port.select("mapping_id", "instance", "field").join(inputs, ["mapping_id", "instance"]).where("field != input").select("mapping_id", node().alias("node"), node("instance", "input").alias("parent"))


def base_instances(inst: DataFrame) -> DataFrame:
    """routers and joiners with a group suffix, and the instance that connectors name."""
    return inst.where(is_type("ROUTER|JOINER") & F.col("instance").contains(".")).select("mapping_id", "instance", F.substring_index("instance", ".", 1).alias("base"))


def _canonical(edges: DataFrame, port: DataFrame) -> DataFrame:
    """Parents (from_inst, from_field) as nodes, in the spelling of the port where there is one."""
    own = port.select("mapping_id", F.col("instance").alias("from_inst"), F.upper("field").alias("__u"), F.col("field").alias("__f"))
    rows = edges.withColumn("__u", F.upper("from_field")).join(own, ["mapping_id", "from_inst", "__u"], "left")
    return rows.select("mapping_id", "node", F.concat("from_inst", F.lit("."), F.coalesce("__f", "from_field")).alias("parent"))


def _union_feeds(port: DataFrame, conn: DataFrame) -> DataFrame:
    feeds = conn.select("mapping_id", F.substring_index("to_inst", ".", 1).alias("instance"), F.upper("to_field").alias("u"), "from_inst", "from_field")
    rows = port.where(is_union()).select("mapping_id", "instance", F.upper("field").alias("u"), node().alias("node"))
    return rows.join(feeds, ["mapping_id", "instance", "u"]).select("mapping_id", "node", "from_inst", "from_field")


def union_edges(port: DataFrame, conn: DataFrame) -> DataFrame:
    """a union's port is fed by the equally named ports of all its groups.

    An equi-join on the field and on the instance before its group suffix.
    """
    return _canonical(_union_feeds(port, conn), port).distinct()


def _feeds(port: DataFrame, conn: DataFrame) -> DataFrame:
    """(mapping_id, node, from_inst, from_field): connectors into the given ports, by the base instance for suffixed routers and joiners, over all groups for unions."""
    to = F.when(is_type("ROUTER|JOINER"), F.substring_index("instance", ".", 1)).otherwise(F.col("instance"))
    rows = port.where(~is_union()).select("mapping_id", to.alias("to_inst"), F.col("field").alias("to_field"), node().alias("node"))
    return rows.join(conn, ["mapping_id", "to_inst", "to_field"]).select("mapping_id", "node", "from_inst", "from_field").unionByName(_union_feeds(port, conn))


def connector_edges(port: DataFrame, conn: DataFrame) -> DataFrame:
    """Connectors into all ports: by the base instance for suffixed routers and joiners, over all groups for unions."""
    return _canonical(_feeds(port, conn), port).distinct()


def dependencies(port: DataFrame) -> DataFrame:
    """ports of the same transformation that an expression names, itself aside; whatever they are called.

    Repeats are dropped by the keys of the join, so that its rows aren't dealt out again; a name without dots makes the same rows distinct as the nodes would.
    """
    named = port.where(transforms() & F.col("expression").isNotNull()).select("mapping_id", "instance", "field", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("expression", F.lit(f"({NAME})"), 1), F.upper))).alias("token"))
    met = _with_ports(named, port, "token", "dep").where("dep != field").select("mapping_id", "instance", "__u", "field", "dep").distinct()
    return met.select("mapping_id", node().alias("node"), node("instance", "dep").alias("parent"))


def _stopped() -> Column:
    return transforms() & ~passes() & ~is_type(OPAQUE)


def stops(port: DataFrame) -> DataFrame:
    """ports whose rule ends the walk over connectors."""
    return port.where(_stopped()).select("mapping_id", node().alias("node"))


def parents(port: DataFrame, attr: DataFrame, conn: DataFrame) -> DataFrame:
    """all edges of the backward walk: connectors unless stopped, and the edges inside transformations; ends have none.

    Edges and the ports that stop or end them are dealt out together, once; connectors into a port that stops them aren't made.
    """
    made = lambda rows, kind: rows.select("mapping_id", "node", (F.col("parent") if "parent" in rows.columns else F.lit(None).cast("string")).alias("parent"), F.lit(kind).alias("kind"))
    walked = _canonical(_feeds(port.where(~F.coalesce(_stopped(), F.lit(False))), conn), port)
    inner = dependencies(port).unionByName(lookup_edges(attr, port)).unionByName(bind_edges(attr, port)).unionByName(opaque_edges(port))
    ends = generated_ports(port).select("mapping_id", "node").union(return_ports(port).select("mapping_id", "node"))
    rows = made(walked, 0).union(made(inner, 1)).union(made(stops(port).dropna(), 2)).union(made(ends.dropna(), 3))
    of = Window.partitionBy("mapping_id", "node")
    rows = rows.withColumns({"ends": F.max(F.col("kind") == 3).over(of), "stops": F.max(F.col("kind") == 2).over(of)})
    return rows.where("kind < 2 and not ends and (kind = 1 or not stops)").select("mapping_id", "node", "parent").distinct()


def target_starts(port: DataFrame, conn: DataFrame) -> DataFrame:
    """Connected ports of targets."""
    fed = conn.select("mapping_id", F.concat("to_inst", F.lit("."), "to_field").alias("start")).distinct()
    return port.where("type = 'Target Definition'").select("mapping_id", node().alias("start")).join(fed, ["mapping_id", "start"], "left_semi")


def traced(starts: DataFrame, parent: DataFrame) -> DataFrame:
    """(mapping_id, start, node, depth) of all that the starts come from."""
    return graph.closure(starts, parent.select("mapping_id", F.col("node").alias("src"), F.col("parent").alias("dst")), KEY)


def facts(port: DataFrame) -> DataFrame:
    return port.select("mapping_id", node().alias("node"), "instance", "field", "type", "porttype", "expression")


def sources_of(trace: DataFrame, parent: DataFrame, port: DataFrame) -> DataFrame:
    """Each start with its source ports (source definitions and qualifiers that nothing feeds), as a list."""
    leaf = facts(port).where(F.col("type").isin("Source Definition", "Source Qualifier")).select("mapping_id", "node").join(parent.select("mapping_id", "node").distinct(), ["mapping_id", "node"], "left_anti").withColumn("source", F.col("node"))
    rows = trace.join(leaf, ["mapping_id", "node"], "left")
    return rows.groupBy("mapping_id", "start").agg(F.count("*").alias("n_visited"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


def lookups_used(trace: DataFrame, port: DataFrame, attr: DataFrame) -> DataFrame:
    """lookups on each trace with their table, condition, override and source filter."""
    met = trace.join(facts(port).where(is_type("LOOKUP")), ["mapping_id", "node"]).select("mapping_id", "start", "instance").distinct()
    pick = lambda n: F.max(F.when(F.lower("name") == n, F.col("value")))
    of = attr.where(is_type("LOOKUP")).groupBy("mapping_id", "instance").agg(pick("lookup table name").alias("lookup_table"), pick("lookup condition").alias("lookup_condition"), pick("lookup sql override").alias("lookup_sql_override"), pick("lookup source filter").alias("lookup_source_filter"))
    return met.join(of, ["mapping_id", "instance"], "left")


def conditions_used(trace: DataFrame, port: DataFrame, attr: DataFrame) -> DataFrame:
    """conditions of the filters and routers on each trace."""
    met = trace.join(facts(port).where(is_type("FILTER|ROUTER")), ["mapping_id", "node"]).select("mapping_id", "start", "instance").distinct()
    return met.join(attr.where(F.lower("name").contains("condition")).select("mapping_id", "instance", F.col("name").alias("condition_name"), F.col("value").alias("condition_value")), ["mapping_id", "instance"])


def unresolved(trace: DataFrame, parent: DataFrame, port: DataFrame, inst: DataFrame) -> DataFrame:
    """where a trace ends without a source: the instance unknown, the port not in it, or no connector into it."""
    seen = trace.select("mapping_id", "node").distinct()
    known = seen.join(facts(port), ["mapping_id", "node"], "left")
    place = F.length("node") - F.length(F.substring_index("node", ".", -1)) - 1
    names = inst.select("mapping_id", F.col("instance").alias("of"), F.lit(True).alias("here")).distinct()
    lost = known.where("field is null").withColumn("of", F.substring("node", F.lit(1), place)).join(names, ["mapping_id", "of"], "left")
    lost = lost.select("mapping_id", "node", F.when(F.col("here"), "port_not_in_transformation").otherwise("unknown_instance").alias("reason"))
    ends = generated_ports(port).select("mapping_id", "node").union(return_ports(port).select("mapping_id", "node")).unionByName(stops(port))
    idle = known.where(F.col("field").isNotNull() & transforms() & (F.col("type") != "Source Qualifier")).join(parent.select("mapping_id", "node").distinct(), ["mapping_id", "node"], "left_anti").join(ends, ["mapping_id", "node"], "left_anti")
    return lost.unionByName(idle.select("mapping_id", "node", F.lit("no_incoming_connector").alias("reason")))


def unknown_pairs(attr: DataFrame, port: DataFrame) -> DataFrame:
    """Lookup pairs that name no port of their lookup."""
    return lookup_pairs(attr).join(_to_ports(_to_ports(lookup_pairs(attr), port, "left", "a"), port, "right", "b").select("mapping_id", "instance", "left", "right"), ["mapping_id", "instance", "left", "right"], "left_anti")


def diagnostics(open_ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """diagnostics by category and mapping with their number."""
    category = F.when(F.col("reason") == "no_incoming_connector", "missing_connector").otherwise("unresolved_port")
    rows = open_ports.select("mapping_id", category.alias("category")).union(pairs.select("mapping_id", F.lit("unresolved_expression")))
    return rows.groupBy("mapping_id", "category").agg(F.count("*").alias("n"))


def final_targets(inst: DataFrame) -> DataFrame:
    """target definitions of a folder that are no sources of it."""
    name = F.upper("definition").alias("definition")
    return inst.where("type = 'Target Definition'").select("subject_id", name).distinct().join(inst.where("type = 'Source Definition'").select("subject_id", name).distinct(), ["subject_id", "definition"], "left_anti")


def select_targets(inst: DataFrame, conn: DataFrame, order: DataFrame, every: bool = False, named: DataFrame | None = None) -> DataFrame:
    """target instances of each mapping by the best rule that gives any: 1 all, 2 named, 3 final, 4 highest load order, 5 connected, 6 any."""
    targets = inst.where("type = 'Target Definition'").select("mapping_id", "subject_id", "instance", F.upper("definition").alias("definition"))
    if every:
        return targets.select("mapping_id", "instance", F.lit(1).alias("rule"))
    if named is not None:
        return targets.join(named.select(F.upper(F.trim("definition")).alias("definition")).distinct(), "definition", "left_semi").select("mapping_id", "instance", F.lit(2).alias("rule"))
    final = targets.join(final_targets(inst), ["subject_id", "definition"], "left_semi").withColumn("rule", F.lit(3))
    loads = order.select("mapping_id", F.col("target_instance").alias("instance"), F.coalesce(F.col("ord").try_cast("int"), F.lit(-1)).alias("at"))
    top = loads.groupBy("mapping_id").agg(F.max("at").alias("at"))
    loaded = targets.join(loads.join(top, ["mapping_id", "at"]), ["mapping_id", "instance"], "left_semi").withColumn("rule", F.lit(4))
    fed = targets.join(conn.select("mapping_id", F.col("to_inst").alias("instance")).distinct(), ["mapping_id", "instance"], "left_semi").withColumn("rule", F.lit(5))
    rows = final.unionByName(loaded).unionByName(fed).unionByName(targets.withColumn("rule", F.lit(6))).groupBy("mapping_id", "instance").agg(F.min("rule").alias("rule"))
    return rows.join(rows.groupBy("mapping_id").agg(F.min("rule").alias("rule")), ["mapping_id", "rule"]).select("mapping_id", "instance", "rule")


def target_fields(inst: DataFrame, fields: DataFrame, conn: DataFrame) -> DataFrame:
    """fields of each target from its definition, else those that connectors feed."""
    targets = inst.where("type = 'Target Definition'").select("mapping_id", "instance", "definition")
    defined = targets.join(fields, "definition").select("mapping_id", "instance", "field", F.lit("definition").alias("known_by"))
    fed = conn.select("mapping_id", F.col("to_inst").alias("instance"), F.col("to_field").alias("field")).distinct()
    rest = targets.join(fields.select("definition").distinct(), "definition", "left_anti").join(fed, ["mapping_id", "instance"]).select("mapping_id", "instance", "field", F.lit("connector").alias("known_by"))
    return defined.unionByName(rest)


def missing_fields(expected: DataFrame, traced_starts: DataFrame) -> DataFrame:
    """F32: expected target fields without a trace."""
    return expected.withColumn("start", node()).join(traced_starts.select("mapping_id", "start").distinct(), ["mapping_id", "start"], "left_anti").drop("start")


def lookup_derivations(attr: DataFrame, port: DataFrame) -> DataFrame:
    """of each lookup pair, the field of the lookup and the one that drives it, told by their port types (left first where both or neither are)."""
    kinds = port.select("mapping_id", "instance", "field", F.upper("porttype").contains("LOOKUP").alias("is_lookup"))
    rows = paired_ports(attr, port)
    for side in ("a", "b"):
        rows = rows.join(kinds.withColumnsRenamed({"field": side, "is_lookup": f"{side}_lookup"}), ["mapping_id", "instance", side])
    swap = F.col("b_lookup") & ~F.col("a_lookup")
    traced_ = F.col("a_lookup") != F.col("b_lookup")
    return rows.select("mapping_id", "instance", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lookup_field"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("driving_field"), traced_.alias("is_traced"))


def condition_fields(attr: DataFrame, port: DataFrame) -> DataFrame:
    """ports that a condition or query attribute of their transformation names."""
    rows = attr.where(transforms() & F.lower("name").rlike(CONDITION_WORDS)).select("mapping_id", "instance", "name", F.explode(F.array_distinct(F.transform(last_names(F.col("value")), F.upper))).alias("token"))
    return _to_ports(rows, port, "token", "field").select("mapping_id", "instance", "name", "field").distinct()


def co_references(attr: DataFrame, port: DataFrame) -> DataFrame:
    """edges inside transformations, both ways: expressions, lookup pairs, and fields that one attribute names.

    The fields of one attribute are tied to the first of them, which connects them all without all their pairs. A tie of two kinds is given twice: what walks them drops repeats.
    """
    fields = condition_fields(attr, port)
    star = fields.join(fields.groupBy("mapping_id", "instance", "name").agg(F.min("field").alias("hub")), ["mapping_id", "instance", "name"]).where("field != hub")
    ties = dependencies(port).unionByName(lookup_edges(attr, port)).unionByName(star.select("mapping_id", node().alias("node"), node("instance", "hub").alias("parent")))
    ways = F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.col("node").alias("parent")))  # both of one row: ties are made once
    return ties.select("mapping_id", F.inline(ways))


def expression_fields(port: DataFrame) -> DataFrame:
    """ports that the rule of a port names, in the same transformation, with the rule."""
    rows = port.where(transforms() & ~passes()).select("mapping_id", "instance", F.col("field").alias("rule_field"), "expression", F.explode(F.array_distinct(F.transform(last_names(F.col("expression")), F.upper))).alias("token"))
    return _to_ports(rows, port, "token", "field").select("mapping_id", "instance", "rule_field", "expression", "field")
