"""Assets of documents: what enrichments said of elements, where pictures stand, references as addresses, shared contents.

Elements are rows of ``structure.elements``. Texts are matched by the digest of their normalised form, so that only
digests are compared; enrichments and assets are aggregated to one row a key before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

#: How references to assets begin in Markdown.
PREFIX = "asset://"


def marker_key(text: Column) -> Column:
    return F.sha2(T.collapse(text), 256)


def with_provenance(elements: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Elements whose text is, but for white space, the marker of an enrichment of their version get its source,
    confidence (null too), kind and figure, these where it has them.

    elements: (version_id, unit_no, place, element); enrichments: (version_id, number, marker, source, confidence, kind,
    figure_id). Of enrichments with the same marker the last one counts. Null texts and markers match nothing.
    """
    own = enrichments.filter("marker is not null").groupBy("version_id", marker_key(F.col("marker")).alias("key"))
    last = own.agg(F.max_by(F.struct("source", "confidence", "kind", "figure_id"), "number").alias("said"))
    e, said = F.col("element"), F.col("said")
    new = e.withField("source", said["source"]).withField("confidence", said["confidence"].cast("double"))
    new = new.withField("kind", F.coalesce(said["kind"], e["kind"])).withField("figureId", F.coalesce(said["figure_id"], e["figureId"]))
    rows = elements.withColumn("key", marker_key(e["text"])).join(last, ["version_id", "key"], "left")
    return rows.select("version_id", "unit_no", "place", F.when(said.isNotNull(), new).otherwise(e).alias("element"))


def with_anchors(assets: DataFrame, elements: DataFrame) -> DataFrame:
    """Assets with anchor (type, heading, sectionPath) or null: the section in which the last element with that asset's
    filename stands; elements on pages, slides or sheets give none. assets: (version_id, filename, …)."""
    e = F.col("element")
    shown = elements.filter(e["assetFilename"].isNotNull()).groupBy("version_id", e["assetFilename"].alias("filename"))
    last = shown.agg(F.max_by(F.struct(e["location"].alias("at"), e["sectionPath"].alias("path")), F.struct("unit_no", "place")).alias("figure"))
    at, path = F.col("figure.at"), F.col("figure.path")
    heading = F.coalesce(at["heading"], F.try_element_at(path, F.lit(-1)))
    anchor = F.when(at["type"] == "section", F.struct(F.lit("heading").alias("type"), heading.alias("heading"), path.alias("sectionPath")))
    return assets.join(last, ["version_id", "filename"], "left").withColumn("anchor", anchor).drop("figure")


def reference(filename: Column, prefix: str = PREFIX) -> Column:
    """The reference to an asset: its name as a component of an address (UTF-8; letters, digits and -_.!~*'() stay)."""
    out = F.replace(F.url_encode(filename), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return F.concat(F.lit(prefix), out)


def resolved(versions: DataFrame, assets: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """versions with their column markdown's references replaced by the addresses of the assets; unknown ones stay.

    versions: (version_id, markdown, …); assets: (version_id, ordinal, filename, address). Of assets with one name the last
    one counts. A version has as many assets as a file may have pictures, so its addresses are one map in its row.
    """
    one = assets.filter("filename is not null and address is not null").groupBy("version_id", reference(F.col("filename"), prefix).alias("name")).agg(F.max_by("address", "ordinal").alias("address"))
    known = one.groupBy("version_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "address"))).alias("known"))
    pattern = prefix + r"[^)\s]+"
    found = F.regexp_extract_all("markdown", F.lit(f"({pattern})"), F.lit(1))
    new = F.transform(found, lambda x: F.coalesce(F.try_element_at(F.col("known"), x), x))
    whole = F.array_join(F.zip_with(F.split("markdown", pattern, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return versions.join(known, "version_id", "left").withColumn("markdown", F.when(F.col("known").isNull(), F.col("markdown")).otherwise(whole)).drop("known")


def by_content(assets: DataFrame) -> DataFrame:
    """One row for each content: (sha256, bytes, n_assets, n_versions, version_id, ordinal): what is stored once, and its
    first place."""
    first = F.min(F.struct("version_id", "ordinal"))
    own = assets.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n_assets"), F.count_distinct("version_id").alias("n_versions"), first.alias("first"))
    return own.select("sha256", "bytes", "n_assets", "n_versions", "first.version_id", "first.ordinal")
