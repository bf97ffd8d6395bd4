"""Tables, page folders, geometry files and map files.

Every reader goes through Spark, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import year_of, keyword_values

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def optional_table(spark: SparkSession, path: str, schema: T.StructType | str, required: str | None = None) -> DataFrame:
    """The table at ``path``, or an empty one if it is missing or lacks the column ``required``."""
    if exists(spark, path):
        df = spark.read.parquet(path)
        if required is None or required in df.columns:
            return df
    return spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Write beside ``path`` and then swap, so a table may be replaced by what is read from it.

    The former table is set aside first and deleted last: after a crash one of both is whole, at
    ``path`` or beside it under ``.old``, and the next call puts it back before it writes.
    """
    spark = df.sparkSession
    at = path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fresh, old, place = (hadoop.Path(p) for p in (f"{at}.new", f"{at}.old", at))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(place):
        fs.rename(old, place)
    (df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(f"{at}.new")
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"{at} could not be set aside")
    if not fs.rename(fresh, place):
        raise OSError(f"{at}.new could not be put in its place")
    fs.delete(old, True)


def page_folder(spark: SparkSession, path: str) -> DataFrame:
    """guid, html: one row for each file ``<guid>.html``."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html$", 1).alias("guid"), F.col("value").alias("html"))


def missing_pages(articles: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles with their page by guid, and how many have none."""
    joined = articles.join(pages, "guid", "left")
    return joined.where("html IS NOT NULL"), joined.agg(F.count_if(F.col("html").isNull()).alias("missing"))


def _rings(kind: Column, coordinates: Column) -> Column:
    """Rings or paths of any polygon or line geometry."""
    pair = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    one = F.from_json(coordinates, "array<array<double>>")
    two = F.from_json(coordinates, "array<array<array<double>>>")
    three = F.from_json(coordinates, "array<array<array<array<double>>>>")
    path = lambda r: F.transform(r, pair)
    return (
        F.when(kind == "LineString", F.array(path(one)))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(two, path))
        .when(kind == "MultiPolygon", F.flatten(F.transform(three, lambda p: F.transform(p, path))))
    )


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Properties (a schema, as DDL), kind and rings of the features of a GeoJSON file, in file order."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    feature = rows.select(F.posexplode("features").alias("pos", "f"))
    return feature.select("pos", "f.properties.*", F.col("f.geometry.type").alias("kind"), _rings(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("rings"))


def kml_areas(spark: SparkSession, path: str) -> DataFrame:
    """name, rings of the placemarks that are areas; altitudes are dropped, dividers and notes left out."""
    ring = "struct<LinearRing:struct<coordinates:string>>"
    polygon = f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    schema = f"name string, Polygon {polygon}, MultiGeometry struct<Polygon:array<{polygon}>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    all_ = F.coalesce(F.col("MultiGeometry.Polygon"), F.when(F.col("Polygon").isNotNull(), F.array("Polygon")))

    def points(text: Column) -> Column:
        corner = lambda c: F.struct(F.try_element_at(F.split(c, ","), F.lit(1)).cast("double").alias("x"), F.try_element_at(F.split(c, ","), F.lit(2)).cast("double").alias("y"))
        return F.transform(F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda s: s != ""), corner)

    def rings(p: Column) -> Column:
        outer = F.array(points(p["outerBoundaryIs"]["LinearRing"]["coordinates"]))
        holes = F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")), lambda h: points(h["LinearRing"]["coordinates"]))
        return F.concat(outer, holes)

    return rows.select("name", F.flatten(F.transform(all_, rings)).alias("rings")).where("size(rings) > 0")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that what is derived from it several times is not computed as often.

    The table is in the shared folder that ``spark.checkpoint.dir`` names; without it, in one of a local
    master's own, or beside the warehouse.  Executors that are lost lose nothing of it.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        root = "file://" + tempfile.mkdtemp(prefix="storyatlas-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_settled"
    path = f"{root.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def json_lines(df: DataFrame, column: str, path: str) -> None:
    """One compact JSON text per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, path: str, feature: str = "feature", order: list[str] | None = None) -> int:
    """A feature collection as one compact JSON file at ``path``; how many features it has.

    A map file is what one browser loads, so it has one writer; features reach it one at a time, in ``order``.
    """
    spark = features.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    rows = features.orderBy(*order) if order else features
    written = 0
    try:
        out.write(bytearray(b'{"type":"FeatureCollection","features":['))
        for row in rows.select(F.to_json(feature, {"ignoreNullFields": "false"})).toLocalIterator():
            out.write(bytearray((("," if written else "") + row[0]).encode()))
            written += 1
        out.write(bytearray(b"]}"))
    finally:
        out.close()
    return written


def review_csv(df: DataFrame, path: str, geometry: str = "rings") -> None:
    df.drop(geometry).write.mode("overwrite").option("header", True).csv(path)


def articles(docs: DataFrame, column: str) -> DataFrame:
    """Derived columns and classification of fetched article documents, all their own fields kept.

    ``column`` is the name of the regular feature whose entries are wanted.  Nested fields become JSON text.
    """
    column = column.lower()
    nested = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    main, kicker = F.coalesce("headline.main", F.lit("")), F.lower(F.trim(F.coalesce("headline.kicker", F.lit(""))))
    # fixed values: headlines about the feature rather than of it, and kinds of corrections
    about = [f"best of {column}", "vote for", "how to submit", f"years of {column}", f"{column} fans"]
    corrections = ["correction", "editors' note"]
    tag, phrase = kicker == column, F.lower(main).contains(column)
    meta = reduce(or_, (F.lower(main).contains(a) for a in about))
    correction = F.lower(F.trim(F.coalesce("type_of_material", F.lit("")))).isin(corrections)
    foreign = (kicker != "") & ~tag
    url = lambda c: F.coalesce(F.get_json_object(F.to_json(F.col(c)), "$.url"), F.lit(None).cast("string"))
    derived = {
        "headline_main": main,
        "headline_kicker": F.col("headline.kicker"),
        "headline_print": F.col("headline.print_headline"),
        "byline_original": F.col("byline.original"),
        **{name: keyword_values("keywords", kind) for name, kind in (("locations", "Location"), ("subjects", "Subject"), ("persons", "Person"), ("organizations", "Organization"))},
        "image_url": url("multimedia.default"),
        "image_thumbnail_url": url("multimedia.thumbnail"),
        "image_caption": F.col("multimedia.caption"),
        "image_credit": F.col("multimedia.credit"),
        "pub_year": year_of("pub_date"),
        "has_kicker_tag": tag,
        "title_has_phrase": phrase,
        "foreign_kicker": foreign,
        "is_meta_article": meta,
        "is_correction": correction,
        "is_entry": (tag | phrase) & ~meta & ~correction & ~foreign,
    }
    rows = docs.select("*", *[c.alias(n) for n, c in derived.items()])
    return rows.withColumns({c: F.to_json(c) for c in nested})
