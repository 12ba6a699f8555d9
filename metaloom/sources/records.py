"""Semi-structured rows: canonical JSON, sheets of records, JSON lines (family A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut


def load_repository(spark: SparkSession, names: list[str], schema_prefix: str = "", folder: str | None = None, jdbc: dict[str, str] | None = None, partition: dict[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """Repository tables from Parquet files or a database; partition gives a table's column, bounds and number of partitions."""
    if folder:
        return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    out = {}
    for n in names:
        reader = spark.read.format("jdbc").options(**(jdbc or {})).option("dbtable", f"{schema_prefix}{n}")
        if partition and n in partition:
            column, low, high, parts = partition[n]
            reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        out[n] = reader.load()
    return out


def canonical_nodes(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, path, depth, tag, attributes, text, tail) of JSON trees: the root is `root`, else the document itself.

    path is the list of places among siblings from the root, so that it sorts in document order. All documents go
    down a level in the same round; rounds follow the deepest tree. A text that is no JSON, or has no tag: no rows.
    """
    value = F.try_parse_json(text)
    top = texts.select(F.col(doc).alias("doc"), F.coalesce(F.try_variant_get(value, "$.root", "variant"), value).alias("v"), F.array().cast("array<int>").alias("path"))
    pick = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    level, out, depth = cut(top.where(pick("tag", "string").isNotNull()), "nodes"), None, 0
    while out is None or not level.isEmpty():
        row = level.select("doc", "path", F.lit(depth).alias("depth"), *[pick(n, k).alias(n) for n, k in (("tag", "string"), ("attributes", "map<string,string>"), ("text", "string"), ("tail", "string"))])
        out = row if out is None else out.unionByName(row)
        below = level.select("doc", "path", F.posexplode(pick("children", "array<variant>")).alias("pos", "v"))
        level, depth = cut(below.select("doc", "v", F.concat("path", F.array("pos")).alias("path")), "nodes"), depth + 1
    return out


def drop_blank_rows(df: DataFrame, columns: list[str], trim: bool) -> DataFrame:
    """Without rows whose columns are all null, or (trim) all blank."""
    if not trim:
        return df.na.drop("all", subset=columns)
    return df.where(F.exists(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), lambda x: x != ""))


def align_rows(row: Column, width: int) -> Column:
    """A row's cells padded with nulls or cut to the header's width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(None).cast("string"), width)), 1, width)


def json_safe(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, decimals as text; other columns as they are."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date" or kind.startswith("decimal"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def json_records(df: DataFrame, omit_nulls: bool = True) -> Column:
    """Each row as a JSON object, without its null members or with them."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(omit_nulls).lower()})


def write_jsonl(df: DataFrame, sheet: Column, path: str) -> None:
    """One line {"sheet", "record"} for each row."""
    df.select(sheet.alias("sheet"), F.struct(*df.columns).alias("record")).write.mode("overwrite").json(path)


def resolve_inputs(inputs: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Paths with one of the extensions, each at its first place: inputs(pos, path)."""
    kept = inputs.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions))
    first = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    return kept.withColumn("__n", first).where("__n = 1").select("pos", "path")
