"""Chains that cross session boundaries, and what describes their steps (family G).

Tables as in typed_edges. Over all mappings a node is 'mapping|instance.field'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import sqltext
from metaloom.sources.store import cut

from . import graph

#: Types with several input or output groups, whose group names stand before a field in connectors (fixed values).
MULTI_INPUT = ("Normalizer", "XML Source Qualifier")
MULTI_OUTPUT = ("Router", "XML Source Qualifier")
#: Types that are steps on the way, never sources (fixed values).
INTERMEDIATE = (
    "Source Qualifier", "Expression", "Filter", "Lookup Procedure", "Joiner", "Aggregator", "Sorter", "Router", "Normalizer", "Rank", "Update Strategy", "Java", "Union", "Sequence", "XML Source Qualifier", "XML Generator", "XML Parser", "XML Target Definition",
    "Stored Procedure", "External Procedure", "Custom Transformation", "Mapplet", "SQL Transformation", "Transaction Control", "Data Masking", "Hierarchy Parser", "Hierarchy Builder", "CDC Consumer", "CDC Control", "Web Services Consumer", "Web Services Provider",
    "MQSeries Consumer", "MQSeries Producer", "SAP BW Source", "SAP BW Target", "SAP BAPI", "SAP IDoc", "SAP ERP Source Qualifier", "Salesforce Source Qualifier", "Salesforce Lookup", "PowerExchange Source Qualifier", "PowerExchange CDC", "Target Definition",
)
#: How the names of transformation instances begin (fixed values).
PREFIXES = r"^(SQ|EXP|EXPTRANS|FILTRANS|FIL|NRM|NORM|SEQ|RTR|ROUTER|JNR|JOINER|AGG|SRT|SORTER|RANK|LKP|LOOKUP|UPD|UPDATE|JAVA|UNION|XML|SP|SPROC|PROC|EXTPROC|MPT|MAPLET|TRANS|CUSTOM|CUST|SQL|TXN|TC|MASK|DM|HP|HIER|CDC|WS|WSC|WSP|MQ|MQC|MQP|SAP|BAPI|IDOC|SFDC|SF|PWX)[A-Z0-9_]*$"
#: What the name of a transformation instance may begin with, whatever follows (fixed values).
BEGINNINGS = (
    "SQ_", "EXP_", "EXPTRANS", "LKP_", "LOOKUP_", "FIL_", "FILTRANS", "FILTER_", "NRM_", "NORM_", "SEQ_", "RTR_", "ROUTER_", "JNR_", "JOINER_", "AGG_", "AGGREGATOR_", "SRT_", "SORTER_", "RANK_", "MPT_", "MAPLET_", "TRANS_", "CUSTOM_", "CUST_", "SQL_", "UPD_", "UPDATE_", "UNION_", "JAVA_", "XML_",
    "SP_", "SPROC_", "PROC_", "EXTPROC_", "TXN_", "TC_", "MASK_", "DM_", "HP_", "HIER_", "CDC_", "WS_", "WSC_", "WSP_", "MQ_", "MQC_", "MQP_", "SAP_", "BAPI_", "IDOC_", "SFDC_", "SF_", "PWX_",
)
#: Types whose expressions annotate a step (fixed values).
ANNOTATED = ("Expression", "Aggregator", "Filter", "Router", "Rank", "Normalizer", "Update Strategy", "Java", "SQL Transformation", "Custom Transformation", "External Procedure", "Data Masking", "Transaction Control")
#: (prefix, label) of a step's role, the first that fits (fixed values).
ROLES = [
    ("SQ_", "Source Qualifier"), ("JNR", "Joiner"), ("JOINER_", "Joiner"), ("EXP_", "Expression"), ("EXPTRANS", "Expression"), ("FIL_", "Filter"), ("FILTRANS", "Filter"), ("FILTER_", "Filter"), ("LKP_", "Lookup"), ("LOOKUP_", "Lookup"), ("RTR_", "Router"), ("ROUTER_", "Router"), ("AGG_", "Aggregator"), ("AGGREGATOR_", "Aggregator"), ("SRT_", "Sorter"), ("SORTER_", "Sorter"), ("RANK_", "Rank"), ("NRM_", "Normalizer"), ("NORM_", "Normalizer"), ("SEQ_", "Sequence Generator"),
    ("UPD_", "Update Strategy"), ("UPDATE_", "Update Strategy"), ("UNION_", "Union"), ("JAVA_", "Java"), ("MPT_", "Mapplet"), ("MAPLET_", "Mapplet"), ("XML_", "XML"), ("SP_", "Stored Procedure"), ("SPROC_", "Stored Procedure"), ("PROC_", "Stored Procedure"), ("EXTPROC_", "External Procedure"), ("SQL_", "SQL Transformation"), ("TXN_", "Transaction Control"), ("TC_", "Transaction Control"), ("MASK_", "Data Masking"), ("DM_", "Data Masking"), ("HP_", "Hierarchy"), ("HIER_", "Hierarchy"), ("CDC_", "CDC"),
    ("WS_", "Web Services"), ("WSC_", "Web Services"), ("WSP_", "Web Services"), ("MQ_", "MQSeries"), ("MQC_", "MQSeries"), ("MQP_", "MQSeries"), ("SAP_", "SAP"), ("BAPI_", "SAP"), ("IDOC_", "SAP"), ("SFDC_", "Salesforce"), ("SF_", "Salesforce"), ("PWX_", "PowerExchange"),
]
#: (types, attribute names in order, bucket, label, words before the value): where further types keep a condition (fixed values).
RULES = [
    (("Stored Procedure",), ("Procedure Name", "SP Name", "Stored Procedure Name"), "additional", "StoredProc", ""),
    (("External Procedure",), ("Procedure Name", "External Procedure Name", "DLL Name"), "additional", "ExternalProc", ""),
    (("Java",), ("Class Name", "Java Class Name"), "additional", "Java", "class: "),
    (("SQL Transformation", "SQL"), ("SQL Query", "Sql Query", "SQL"), "additional", "SQLTrans", ""),
    (("Transaction Control",), ("Transaction Control Condition", "Condition"), "filter", "TransactionControl", ""),
    (("Data Masking",), ("Masking Policy", "Policy"), "additional", "DataMasking", "policy: "),
    (("XML Generator",), ("XML Definition", "Schema", "XML Schema"), "additional", "XMLGenerator", "schema: "),
    (("XML Parser",), ("XML Definition", "Schema", "XML Schema"), "additional", "XMLParser", "schema: "),
    (("Hierarchy Parser",), ("Hierarchy Definition", "Schema", "Hierarchy Schema"), "additional", "HierarchyParser", "schema: "),
    (("Hierarchy Builder",), ("Hierarchy Definition", "Schema", "Hierarchy Schema"), "additional", "HierarchyBuilder", "schema: "),
    (("CDC Consumer",), ("Source", "CDC Source", "Registration"), "additional", "CDCConsumer", ""),
    (("CDC Control",), ("Source", "CDC Source", "Registration"), "additional", "CDCControl", ""),
    (("Web Services Consumer",), ("Service URL", "WSDL URL", "Service Name"), "additional", "WSConsumer", ""),
    (("Web Services Provider",), ("Service URL", "WSDL URL", "Service Name"), "additional", "WSProvider", ""),
    (("MQSeries Consumer",), ("Queue Name", "MQ Queue", "Queue Manager"), "additional", "MQConsumer", "queue: "),
    (("MQSeries Producer",), ("Queue Name", "MQ Queue", "Queue Manager"), "additional", "MQProducer", "queue: "),
    (("SAP BW Source",), ("InfoObject", "InfoSource", "DataSource", "InfoCube"), "additional", "SAPBWSource", ""),
    (("SAP BW Target",), ("InfoObject", "InfoSource", "DataSource", "InfoCube"), "additional", "SAPBWTarget", ""),
    (("SAP BAPI",), ("BAPI Name", "Function Module", "RFC Name"), "additional", "SAPBAPI", ""),
    (("SAP IDoc",), ("IDoc Type", "Message Type", "IDoc Name"), "additional", "SAPIDoc", ""),
    (("SAP ERP Source Qualifier",), ("Sql Query", "SQL Query"), "filter", "SAPERPSourceQual WHERE", ""),
    (("Salesforce Source Qualifier",), ("SOQL Query", "Sql Query", "Filter Condition"), "filter", "SalesforceSourceQual", ""),
    (("Salesforce Lookup",), ("Lookup condition", "SOQL Query", "Filter Condition"), "additional", "SalesforceLookup", ""),
    (("PowerExchange Source Qualifier",), ("Sql Query", "SQL Query"), "filter", "PWXSourceQual WHERE", ""),
    (("PowerExchange CDC",), ("Source", "CDC Source", "Map Name"), "additional", "PWXCDC", ""),
]
IN_MAPPING = ["mapping_id", "instance"]


def bare(name: str) -> Column:
    """An instance's name before its group."""
    return F.regexp_replace(name, "[.:].*$", "")


def _field(name: str) -> Column:
    return F.when(F.col(name).rlike("^[^.:]+[.:].+$"), F.regexp_replace(name, "^[^.:]+[.:]", "")).otherwise(F.col(name))


def normalised_edges(conn: DataFrame, inst: DataFrame) -> DataFrame:
    """Connectors between bare instances; group names go from fields of types with several groups only. With ord, each at its first place."""
    rows = conn.where("from_inst <> '' and from_field <> '' and to_inst <> '' and to_field <> ''").withColumns({"from_inst": bare("from_inst"), "to_inst": bare("to_inst")})
    for side, many in (("from", MULTI_OUTPUT), ("to", MULTI_INPUT)):
        grouped = F.coalesce(F.col("type").isin(*many), F.lit(False))
        own = inst.groupBy("mapping_id", bare("instance").alias(f"{side}_inst")).agg(F.bool_or(grouped).alias("__g"), F.bool_or(~grouped).alias("__p")).where("__g").drop("__g")
        field = F.col(f"{side}_field")
        both = F.when(F.col("__p"), F.array(_field(f"{side}_field"), field)).when(~F.col("__p"), F.array(_field(f"{side}_field"))).otherwise(F.array(field))  # a bare name may have instances of both kinds
        rows = rows.join(own, ["mapping_id", f"{side}_inst"], "left").withColumn(f"{side}_field", F.explode(both)).drop("__p")
    return _once(rows, "mapping_id", "from_inst", "from_field", "to_inst", "to_field")


def _once(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of the columns, at the first place of each where rows have one."""
    return rows.groupBy(*columns).agg(F.min("ord").alias("ord")) if "ord" in rows.columns else rows.select(*columns).distinct()


def union_bridge(port: DataFrame, edges: DataFrame) -> DataFrame:
    """Feeders of a union's output at place N: those of the input at place N of each group."""
    rows = port.where((F.col("type") == "Union") | ((F.col("type") == "Custom Transformation") & F.lower(F.coalesce("template", F.lit(""))).contains("union")))
    rows = rows.select("mapping_id", bare("instance").alias("instance"), "field", "ord", F.upper("porttype").alias("kind"), F.trim(F.coalesce("grp", F.lit(""))).alias("grp"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*IN_MAPPING, *by).orderBy("ord"))
    outputs = rows.where("kind = 'OUTPUT' or (grp = '' and kind <> 'INPUT')").withColumn("place", place())
    inputs = rows.where("kind = 'INPUT' and grp <> ''").withColumn("place", place("grp")).select(*IN_MAPPING, "place", F.col("field").alias("to_field"))
    fed = outputs.drop("ord").join(inputs, [*IN_MAPPING, "place"]).join(edges.withColumnRenamed("to_inst", "instance"), [*IN_MAPPING, "to_field"])
    return _once(fed, "mapping_id", "instance", "field", "from_inst", "from_field")


def upstream(port: DataFrame, edges: DataFrame) -> DataFrame:
    """Feeders within a mapping: the union bridge where it gives any, else connectors."""
    bridge = union_bridge(port, edges)
    plain = edges.withColumnsRenamed({"to_inst": "instance", "to_field": "field"}).select(*bridge.columns)
    return plain.join(bridge.select("mapping_id", "instance", "field").distinct(), [*IN_MAPPING, "field"], "left_anti").unionByName(bridge)


def resolved_types(inst: DataFrame, definitions: DataFrame) -> DataFrame:
    """An instance's type: the definition of its own name, the type it states, its element's type, the definition it points to.

    inst(mapping_id, instance, definition, trans_type, raw_type), definitions(mapping_id, name, type).
    """
    own = definitions.select("mapping_id", F.col("name").alias("instance"), F.col("type").alias("by_name"))
    other = definitions.select("mapping_id", F.col("name").alias("definition"), F.col("type").alias("by_definition"))
    rows = inst.join(own, IN_MAPPING, "left").join(other, ["mapping_id", "definition"], "left")
    return rows.select(*IN_MAPPING, F.coalesce("by_name", F.nullif("trans_type", F.lit("")), F.nullif("raw_type", F.lit("")), "by_definition").alias("type"))


def physical_tables(inst: DataFrame, known: DataFrame) -> DataFrame:
    """The table of an instance: its definition or itself if a table of the folder bears that name, else the definition, else itself.

    inst(mapping_id, subject_id, instance, definition), known(subject_id, table_name).
    """
    tables = known.select("subject_id", F.col("table_name").alias("definition"), F.lit(True).alias("__d")).distinct()
    named = known.select("subject_id", F.col("table_name").alias("instance"), F.lit(True).alias("__i")).distinct()
    rows = inst.join(tables, ["subject_id", "definition"], "left").join(named, ["subject_id", "instance"], "left")
    own = F.nullif("definition", F.lit(""))
    return rows.select("mapping_id", "instance", F.when(F.col("__d"), own).when(F.col("__i"), F.col("instance")).otherwise(F.coalesce(own, "instance")).alias("table_name"))


def mappings_for_targets(inst: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, mapping_id, instance) of every target, by its table and by its own name."""
    rows = inst.where(F.upper("type").contains("TARGET")).select("mapping_id", "instance")
    return rows.join(tables, IN_MAPPING).select("table_name", "mapping_id", "instance").union(rows.select(F.col("instance").alias("table_name"), "mapping_id", "instance")).distinct()


def crossing_edges(inst: DataFrame, upstream_of: DataFrame, tables: DataFrame) -> DataFrame:
    """Instances whose table an upstream mapping writes, with the target instance there (the first by name).

    upstream_of(reader, table_name, upstream): the writer of a table that a mapping reads.
    """
    writes = inst.where("type = 'Target Definition'").join(tables, IN_MAPPING).groupBy(F.col("mapping_id").alias("upstream"), "table_name").agg(F.min("instance").alias("target"))
    reads = inst.where("type = 'Source Definition'").join(tables, IN_MAPPING).select(F.col("mapping_id").alias("reader"), F.col("instance").alias("reading"), "table_name")
    return reads.join(upstream_of.select("reader", "table_name", "upstream"), ["reader", "table_name"]).join(writes, ["upstream", "table_name"]).select(F.col("reader").alias("mapping_id"), F.col("reading").alias("instance"), "upstream", "target")


def node(mapping: str, instance: str, field: str) -> Column:
    return F.concat(F.col(mapping).cast("string"), F.lit("|"), F.col(instance), F.lit("."), F.col(field))


def chain_edges(port: DataFrame, feeds: DataFrame, crossings: DataFrame) -> DataFrame:
    """(node, parent, kind) over all mappings: connector; else other_mapping that feeds an equal port (the first); else session; else expression."""
    connected = feeds.select(node("mapping_id", "instance", "field").alias("node"), node("mapping_id", "from_inst", "from_field").alias("parent"), F.lit("connector").alias("kind"))
    own = port.select("mapping_id", bare("instance").alias("instance"), "field", "type", "expression")
    idle = cut(own.join(feeds, [*IN_MAPPING, "field"], "left_anti"), "idle-ports")
    first = feeds.groupBy("instance", "field").agg(F.min("mapping_id").alias("other"))
    of_other = feeds.select(F.col("mapping_id").alias("other"), "instance", "field", "from_inst", "from_field")
    elsewhere = idle.join(first, ["instance", "field"]).join(of_other, ["other", "instance", "field"]).select(node("mapping_id", "instance", "field").alias("node"), node("other", "from_inst", "from_field").alias("parent"), F.lit("other_mapping").alias("kind"))
    idle = idle.join(first, ["instance", "field"], "left_anti")
    crossed = idle.join(crossings, IN_MAPPING).select(node("mapping_id", "instance", "field").alias("node"), node("upstream", "target", "field").alias("parent"), F.lit("session").alias("kind"))
    rest = idle.join(crossings.select(*IN_MAPPING).distinct(), IN_MAPPING, "left_anti").where("expression is not null")
    refs = rest.select("mapping_id", "instance", "field", F.explode(sqltext.field_tokens(F.col("expression"))).alias("token"))
    named = own.select("mapping_id", "instance", F.upper("field").alias("token"), F.col("field").alias("ref"))
    expanded = refs.join(named, [*IN_MAPPING, "token"]).where("ref != field").select(node("mapping_id", "instance", "field").alias("node"), node("mapping_id", "instance", "ref").alias("parent"), F.lit("expression").alias("kind"))
    return connected.unionByName(elsewhere.unionByName(crossed).unionByName(expanded).distinct())  # feeders are distinct


def chain(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): all steps behind each start, across sessions. Mappings are walked by themselves, rounds go from mapping to mapping."""
    return graph.closure_across(starts, edges.select(F.col("node").alias("src"), F.col("parent").alias("dst")), lambda n: F.substring_index(n, "|", 1))


def branch_markers(feeds: DataFrame) -> DataFrame:
    """Feeders of merge points, numbered in name order."""
    w = Window.partitionBy(*IN_MAPPING, "field")
    rows = feeds.select(*IN_MAPPING, "field", "from_inst", "from_field").distinct().withColumn("n", F.count("*").over(w)).where("n > 1")
    return rows.withColumn("branch", F.row_number().over(w.orderBy("from_inst", "from_field"))).drop("n")


def expression_annotation(port: DataFrame) -> DataFrame:
    """The text that annotates a step whose port has an expression of its own."""
    text = F.trim("expression")
    rows = port.where(F.col("type").isin(*ANNOTATED) & (text != "") & (text != F.col("field")))
    return rows.select(*IN_MAPPING, "field", F.concat(F.lit("EXPR:"), "instance", F.lit("."), "field", F.lit(" = "), text).alias("annotation"))


def named_as_step(name: str) -> Column:
    """Names of transformation instances: by their beginning, else as a whole."""
    upper = F.upper(F.coalesce(F.col(name), F.lit("")))
    return upper.rlike("^(" + "|".join(BEGINNINGS) + ")") | upper.rlike(PREFIXES)


def is_intermediate(name: str = "instance", type_: str = "type", is_source: str = "is_source_table") -> Column:
    """Source tables never; else by the type where one is known; else by the name."""
    return F.when(F.col(is_source) | (F.coalesce(F.col(name), F.lit("")) == ""), False).when(F.coalesce(F.col(type_), F.lit("")) != "", F.col(type_).isin(*INTERMEDIATE)).otherwise(named_as_step(name))


def step_facts(port: DataFrame) -> DataFrame:
    """Every port as a step: its node, by the bare instance, and what it is."""
    return port.select("mapping_id", "instance", "field", "type").withColumn("node", F.concat(F.col("mapping_id").cast("string"), F.lit("|"), bare("instance"), F.lit("."), "field"))


def primary_sources(steps: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Steps where a chain ends that are neither targets nor on the way; G15: a sequence on the chain overrides them.

    One row for each start: its sources as a list, whether a sequence drives it.
    """
    rows = steps.join(facts, "node").join(edges.select("node").distinct().withColumn("goes_on", F.lit(True)), "node", "left")
    source = F.when(F.col("goes_on").isNull() & ~F.col("type").isin(*INTERMEDIATE), F.concat_ws(".", "instance", "field"))
    sequence = F.when(F.col("type") == "Sequence", F.concat_ws(".", "instance", "field"))
    out = rows.groupBy("start").agg(F.array_sort(F.collect_set(source)).alias("found"), F.array_sort(F.collect_set(sequence)).alias("sequences"))
    return out.select("start", (F.size("sequences") > 0).alias("by_sequence"), F.array_join(F.when(F.size("sequences") > 0, F.col("sequences")).otherwise(F.col("found")), ", ").alias("primary_sources"))


def intermediates(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Instances between a start and its sources: no source or target tables."""
    return steps.join(facts, "node").where(F.col("type").isin(*INTERMEDIATE) & (F.col("type") != "Target Definition")).select("start", "mapping_id", "instance").distinct()


def chain_mappings(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Mappings on each chain, with their number of steps."""
    return steps.join(facts, "node").groupBy("start", "mapping_id").agg(F.count("*").alias("n_steps"))


def port_conditions(port: DataFrame, attr: DataFrame) -> DataFrame:
    """Group-by ports of Aggregators, keys of Sorters with their direction, top and keys of Ranks, parts of Sequences."""
    kind = F.upper("porttype")
    listed = lambda df, item, label: df.groupBy(*IN_MAPPING).agg(F.concat(F.lit(label), F.expr(f"listagg({item}, ', ') WITHIN GROUP (ORDER BY ord)")).alias("text"))
    groups = listed(port.where((F.col("type") == "Aggregator") & kind.contains("GROUP")), "field", "[Aggregator GROUP BY] ")
    keys = listed(port.where((F.col("type") == "Sorter") & kind.contains("KEY")), "concat(field, ' ', coalesce(nullif(sort_order, ''), 'ASC'))", "[Sorter] Sort by: ")
    top = attr.where((F.col("type") == "Rank") & F.col("name").isin("Top Rows", "Toprows")).groupBy(*IN_MAPPING).agg(F.concat(F.lit("Top "), F.max("value"), F.lit(" rows")).alias("top"))
    ranked = listed(port.where((F.col("type") == "Rank") & kind.contains("KEY")), "field", "Rank by: ")
    rank = top.join(ranked, IN_MAPPING, "full_outer").select(*IN_MAPPING, F.concat(F.lit("[Rank] "), F.concat_ws(" | ", "top", "text")).alias("text"))
    parts = ["Start Value", "Increment By", "End Value", "Cycle"]
    at = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("name"))
    values = attr.where((F.col("type") == "Sequence") & F.col("name").isin(*parts)).withColumn("ord", at)
    sequence = listed(values, "concat(name, '=', value)", "[Sequence] ")
    return groups.unionByName(keys).unionByName(rank).unionByName(sequence)


def attribute_conditions(attr: DataFrame) -> DataFrame:
    """Conditions that further types keep in an attribute, by the first of its names that has a value."""
    out = None
    for types, names, bucket, label, words in RULES:
        rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
        rows = attr.where(F.col("type").isin(*types) & F.col("name").isin(*names) & (F.trim("value") != ""))
        rows = rows.groupBy(*IN_MAPPING).agg(F.min_by("value", rank).alias("value"))
        text = sqltext.where_clause(F.col("value")) if label.endswith("WHERE") else F.col("value")
        rows = rows.select(*IN_MAPPING, F.lit(bucket).alias("bucket"), F.concat(F.lit(f"[{label}] {words}"), sqltext.compact(text)).alias("text")).where("text is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def field_specs(targets: DataFrame, sources: DataFrame, mappings: DataFrame, conditions: DataFrame) -> DataFrame:
    """A record for every target field, found or not: sources, mappings on its chain, conditions of those."""
    of_mapping = conditions.groupBy("mapping_id").agg(F.count("*").alias("n"))
    met = mappings.join(of_mapping, "mapping_id", "left").groupBy("start").agg(F.count("*").alias("n_mappings"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_conditions"))
    out = targets.join(sources, "start", "left").join(met, "start", "left")
    status = F.when(F.coalesce("primary_sources", F.lit("")) == "", "error: no source").otherwise("ok")
    return out.select("start", F.coalesce("primary_sources", F.lit("")).alias("primary_sources"), F.coalesce("by_sequence", F.lit(False)).alias("by_sequence"), F.coalesce("n_mappings", F.lit(0)).cast("long").alias("n_mappings"), F.coalesce("n_conditions", F.lit(0)).cast("long").alias("n_conditions"), status.alias("status"))


def step_role(name: str = "instance") -> Column:
    """A step's role by how its instance's name begins."""
    upper, out = F.upper(name), None
    for prefix, label in ROLES:
        out = F.when(upper.startswith(prefix), label) if out is None else out.when(upper.startswith(prefix), label)
    return out.when(named_as_step(name), "Intermediate").otherwise("Intermediate Table")
