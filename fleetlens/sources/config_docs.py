"""JSON configuration trees to and from long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.operators.config import SCHEMA_VERSION, config_doc_json

_TREE = ("schema string, metadata map<string,string>, global map<string,string>, "
         "components map<string,map<string,string>>, _broken string")


# everything up to and with the next bracket; brackets inside strings do not count, nor does an escaped quote end one
_PIECE = r'[^{}\[\]"]*+(?:"(?:[^"\\]|\\.)*+"[^{}\[\]"]*+)*+[{}\[\]]|[^{}\[\]"]++|"'


def split_values(texts: DataFrame) -> DataFrame:
    """The top-level JSON values of each text: the columns of ``texts`` with ``part`` (from 1) and a ``value`` per part.

    All columns but ``value`` together name a text. It is cut into pieces that end in a bracket; the
    running depth over the pieces tells where a value ends. What follows the last whole value is a
    part of its own, unless it is blank.
    """
    names = [c for c in texts.columns if c != "value"]
    pieces = texts.select(*names, F.posexplode(F.regexp_extract_all("value", F.lit(_PIECE), 0)).alias("_at", "_piece"))
    last = F.substring("_piece", -1, 1)
    upto = W.partitionBy(*names).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*names).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    step = F.when(last.isin("{", "["), 1).when(last.isin("}", "]"), -1).otherwise(0)
    deep = pieces.withColumn("_step", step).withColumn("_depth", F.sum("_step").over(upto))
    ends = ((F.col("_step") == -1) & (F.col("_depth") <= 0)).cast("int")
    numbered = deep.withColumn("_end", ends).withColumn("part", F.coalesce(F.sum("_end").over(before), F.lit(0)) + 1)
    whole = numbered.groupBy(*names, "part").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), "").alias("value"))  # one value of a file
    return whole.filter(F.col("value").rlike(r"\S"))


def parse_trees(values: DataFrame) -> DataFrame:
    """One row per tree of the values (file, doc, part, value); an array is several trees.

    The first tree of a file has the name ``doc``, later ones have ``#`` and their number behind it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    one = F.array(F.from_json("value", _TREE, options))
    broken = F.array(F.from_json(F.lit("{"), _TREE, options))
    many = F.coalesce(F.from_json("value", f"array<struct<{_TREE}>>"), broken)
    listed = F.col("value").rlike(r"^\s*\[")
    trees = values.select("file", "doc", "part", F.posexplode(F.when(listed, many).otherwise(one)).alias("at", "t"))
    n = F.row_number().over(W.partitionBy("file").orderBy("part", "at"))
    return trees.select("t.*", F.when(n == 1, F.col("doc")).otherwise(F.concat("doc", F.lit("#"), n.cast("string"))).alias("doc"))


def read_config_trees(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per tree of files that hold one or several; unknown fields are ignored, ill-formed trees have ``_broken``.

    An empty file gives no tree. A file is read whole; for very large ones use lines.
    """
    path = F.col("_metadata.file_path")
    texts = spark.read.text(paths, wholetext=True).select(
        path.alias("file"), F.regexp_extract(path, r"([^/]+?)(\.json)?$", 1).alias("doc"), "value")
    return parse_trees(split_values(texts))


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per text row ``value``, a tree that names its document in a field ``doc``."""
    tree = F.from_json("value", f"doc string, {_TREE}", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.filter(F.trim("value") != "").select(tree.alias("t")).select("t.*")


def read_config_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Trees of text files with one tree in each line, as ``write_config_docs`` leaves them."""
    return parse_lines(spark.read.text(paths))


def config_entries(trees: DataFrame) -> DataFrame:
    """Long rows of the readable trees.

    A component without keys keeps one row with a null key, so that it still exists.
    """
    none = F.lit(None).cast("string")

    def flat(section: str):
        return F.transform(F.map_entries(F.coalesce(section, F.create_map().cast("map<string,string>"))), lambda e: F.struct(
            F.lit(section).alias("section"), none.alias("component"), e["key"].alias("key"), e["value"].alias("value")))

    def row(component, key, value):
        return F.struct(F.lit("component").alias("section"), component.alias("component"), key.alias("key"), value.alias("value"))

    comps = F.flatten(F.transform(
        F.map_entries(F.coalesce("components", F.create_map().cast("map<string,map<string,string>>"))),
        lambda c: F.when(F.coalesce(F.size(c["value"]), F.lit(0)) == 0, F.array(row(c["key"], none, none))).otherwise(
            F.transform(F.map_entries(c["value"]), lambda e: row(c["key"], e["key"], e["value"])))))
    readable = trees.filter(F.col("_broken").isNull() & F.col("schema").eqNullSafe(F.lit(SCHEMA_VERSION)))
    return readable.select("doc", F.inline(F.concat(flat("metadata"), flat("global"), comps)))


def read_config_docs(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Entries of documents, those of a file named after it, or with ``lines`` one per line."""
    return config_entries(read_config_lines(spark, paths) if lines else read_config_trees(spark, paths))


def rejected_docs(trees: DataFrame) -> DataFrame:
    """Documents that cannot be used and why; the others are not affected."""
    why = (F.when(F.col("_broken").isNotNull(), "not JSON").when(F.col("schema").isNull(), "version undefined")
           .when(F.col("schema") != SCHEMA_VERSION, "unsupported version"))
    return trees.select("doc", why.alias("reason")).filter(F.col("reason").isNotNull())


def write_config_docs(entries: DataFrame, folder: str) -> None:
    """JSON lines that name their document; ``read_config_docs(..., lines=True)`` reads them."""
    config_doc_json(entries).select(F.col("json").alias("value")).write.mode("overwrite").text(folder)
