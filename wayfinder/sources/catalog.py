"""Layer catalogues: capability documents to records, categories, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories in their order, each with the words that put a layer into it; the first that fits stands.
CATEGORIES = {
    "buildings": "bygning building", "parking": "parkering parking", "infrastructure": "bro cykel vej letbane mobilitet fortov adgangsvej", "green_areas": "have graes trae parker facade torv", "water_sewage": "vand afloeb brandhane",
    "electricity": "el belysning", "telecom": "tele", "gas": "gas", "thermal": "termisk", "construction": "byggefelt byggeplads", "ler_ledninger": "ler_ ledning", "ler2_ledninger": "ler2_", "lerext_ledninger": "lerext_", "llyn": "llyn_",
}
LAYER = "struct<Name:string,Title:string,Abstract:string,CRS:array<string>,SRS:array<string>,LatLonBoundingBox:struct<_minx:string,_miny:string,_maxx:string,_maxy:string>,BoundingBox:array<struct<_minx:string,_miny:string,_maxx:string,_maxy:string>>>"


def from_capabilities(documents: DataFrame, workspace: str | None = None) -> DataFrame:
    """(full_name, name, title, abstract, workspace, bbox, crs) of the named layers in documents(xml) of any version.

    Namespace prefixes are dropped. With a workspace, only its layers count. The box is null where a layer gives none."""
    bare = F.regexp_replace("xml", r"<(/?)[A-Za-z0-9_]+:", "<$1")
    layers = F.regexp_extract_all(bare, F.lit(r"(?s)<Layer(?=[\s>])[^>]*>((?:(?!<Layer[\s>]).)*?)</Layer>"), F.lit(1))
    x = documents.select(F.explode(layers).alias("body")).select(F.from_xml(F.concat(F.lit("<Layer>"), "body", F.lit("</Layer>")), F.lit(LAYER)).alias("l")).select("l.*").where("Name IS NOT NULL")
    box = F.coalesce(F.col("LatLonBoundingBox"), F.get("BoundingBox", F.lit(0)))
    named = x.select(
        F.col("Name").alias("full_name"), F.element_at(F.split("Name", ":"), -1).alias("name"), F.coalesce("Title", F.lit("")).alias("title"), F.coalesce("Abstract", F.lit("")).alias("abstract"),
        F.when(F.contains("Name", F.lit(":")), F.split_part("Name", F.lit(":"), F.lit(1))).alias("workspace"), F.struct(box["_minx"].alias("minx"), box["_miny"].alias("miny"), box["_maxx"].alias("maxx"), box["_maxy"].alias("maxy")).alias("bbox"), F.coalesce("CRS", "SRS").alias("crs"),
    ).withColumn("bbox", F.when(F.col("bbox.minx").isNotNull(), F.col("bbox")))
    return named.where(F.col("workspace") == workspace) if workspace else named


def of_workspace(layers: DataFrame, workspace: str) -> DataFrame:
    """The workspace's layers, with name without its prefix."""
    return layers.where(F.startswith("full_name", F.lit(f"{workspace}:"))).withColumn("name", F.element_at(F.split("full_name", ":"), -1))


def category() -> Column:
    """Of name, title and full_name."""
    fits = lambda words: F.lower(F.concat_ws("\n", "name", "title", "full_name")).rlike(words.replace(" ", "|"))
    out = F.lit("other")
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(fits(words), name).otherwise(out)
    return out


def categorized(layers: DataFrame) -> DataFrame:
    return layers.withColumn("category", category())


def category_counts(layers: DataFrame) -> DataFrame:
    return categorized(layers).groupBy("category").agg(F.count("*").alias("layers"))


def simplified(layers: DataFrame) -> DataFrame:
    return layers.select("name", "full_name", "title").orderBy("name", "full_name")
