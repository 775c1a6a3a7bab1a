"""Catalogues of open books, landed as JSON strings, to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.text import normalise_license, normalise_url, pick_url

# Fixed values.
ENGLISH = ["en", "English", ""]
HANDLES = "https://library.oapen.org/handle/"
TEXTBOOKS = "https://open.umn.edu/opentextbooks/textbooks/"
OPEN_BOOK = "uuid string, handle string, metadata array<struct<key: string, value: string>>"
TEXTBOOK = (
    "id long, title string, description string, license string, copyright_year int, url string, formats array<struct<type: string, url: string>>, "
    "publishers array<struct<name: string>>, subjects array<struct<name: string>>"
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def meta(metadata: Column, *keys: str) -> Column:
    """The last value that is not blank of the first of the keys that has one, else ''."""

    def named(key: str):
        return lambda m: (m["key"] == key) & (strip(m["value"]) != "")

    found = [F.try_element_at(F.filter(metadata, named(k)), F.lit(-1))["value"] for k in keys]
    return F.coalesce(*map(strip, found), F.lit(""))


def license_name(rights: Column, url: Column) -> Column:
    low = F.lower(rights)
    by = F.contains(url, F.lit("creativecommons.org/licenses/by/4.0")) | F.contains(low, F.lit("by/4.0"))
    nc = F.contains(F.lower(url), F.lit("by-nc")) | F.contains(low, F.lit("by-nc"))
    named = F.when(by, "CC BY 4.0").when(nc, "CC BY-NC").when(F.contains(F.lower(url), F.lit("by-sa")), "CC BY-SA 4.0")
    return named.when(F.contains(low, F.lit("open access")), "Open Access").otherwise(rights)


def response_items(responses: DataFrame, key: str | None = None, payload: str = "payload") -> DataFrame:
    """responses exploded to (place, payload), a row for each object of a response: of a JSON list, or, with
    key, of the list under that key of an object. Other responses give no row."""
    items = F.from_json(payload, "array<string>")
    if key is not None:
        under = F.from_json(F.get_json_object(payload, f"$.{key}"), "array<string>")
        items = F.when(F.trim(payload).startswith("{"), under).otherwise(items)
    rows = responses.withColumn("_items", F.when(F.trim(payload).startswith("[") | F.lit(key is not None), items))
    rest = [c for c in responses.columns if c != payload]
    return rows.select(*rest, F.posexplode("_items").alias("place", payload)).filter(F.col(payload).startswith("{"))


def _line(label: str, value: Column) -> Column:
    """A line of the content, null where there is no value."""
    return F.when(value != "", F.concat(F.lit(f"**{label}:** "), value))


def open_book_rows(payloads: DataFrame, order: str, payload: str = "payload", least: int = 200) -> DataFrame:
    """(topic, id, url, title, license, content) of payloads (topic, order, payload): English books
    with a title, an abstract of `least` characters and an address; of rows with one id the first."""
    b = payloads.withColumn("b", F.from_json(payload, OPEN_BOOK)).filter("b is not null")
    m = F.col("b.metadata")
    b = b.withColumns({
        "title": meta(m, "dc.title"), "abstract": meta(m, "dc.description.abstract"), "language": meta(m, "dc.language"), "rights": meta(m, "dc.rights"), "rights_url": meta(m, "dc.rights.uri"),
        "authors": meta(m, "dc.contributor.author", "dc.contributor.editor"), "publisher": meta(m, "dc.publisher", "oapen.publisher"), "subjects": meta(m, "dc.subject", "oapen.subject"),
    })
    address = F.coalesce(F.nullif(meta(m, "dc.identifier"), F.lit("")), F.col("b.handle"))
    b = b.withColumn("url", normalise_url(address, HANDLES)).withColumn("license", license_name(F.col("rights"), F.col("rights_url")))
    b = b.withColumn("id", F.concat(F.lit("doab_"), F.coalesce("b.uuid", F.substring(F.replace("title", F.lit(" "), F.lit("_")), 1, 40))))
    good = b.filter(F.col("language").isin(ENGLISH) & (F.col("title") != "") & (F.length("abstract") >= least) & F.col("url").isNotNull())
    lines = [F.concat(F.lit("# "), "title"), F.lit(""), _line("Authors", F.col("authors")), _line("Publisher", F.col("publisher")), _line("License", F.col("license")), F.lit(""), F.lit("## Abstract"), F.col("abstract")]
    lines += [F.when(F.col("subjects") != "", F.lit("")), _line("Subjects", F.col("subjects"))]
    rows = good.withColumn("content", F.concat_ws("\n", *lines)).withColumn("n", F.row_number().over(Window.partitionBy("topic", "id").orderBy(order)))
    return rows.filter("n = 1").select("topic", "id", "url", "title", "license", "content")


def textbook_rows(payloads: DataFrame, order: str, most: int, payload: str = "payload", least: int = 150) -> DataFrame:
    """(topic, id, url, title, license, content) of the first `most` valid books of each topic, of
    payloads (topic, order, payload): those with a title, an id and a description of `least` characters."""
    b = payloads.withColumn("b", F.from_json(payload, TEXTBOOK)).select("topic", order, "b.*").filter("id is not null and id <> 0")
    b = b.withColumn("title", strip(F.coalesce("title", F.lit("")))).withColumn("description", strip(F.coalesce("description", F.lit(""))))
    b = b.filter((F.col("title") != "") & (F.length("description") >= least))
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(order))).filter(F.col("n") <= most)
    publisher = F.coalesce(F.get("publishers", F.lit(0))["name"], F.lit(""))
    subjects = F.array_join(F.transform(F.filter("subjects", lambda s: F.coalesce(s["name"], F.lit("")) != ""), lambda s: s["name"]), ", ")
    name = normalise_license(F.coalesce("license", F.lit("")))
    url = F.coalesce(F.nullif("url", F.lit("")), F.nullif(pick_url(F.col("formats")), F.lit("")), F.concat(F.lit(TEXTBOOKS), "id"))
    year = F.when(F.col("copyright_year") != 0, F.col("copyright_year").cast("string"))
    lines = [F.concat(F.lit("# "), "title"), F.lit(""), _line("Publisher", publisher), _line("Year", year), _line("License", name), _line("Subjects", F.coalesce(subjects, F.lit(""))), F.lit(""), F.lit("## Overview"), F.col("description")]
    return b.select("topic", F.concat(F.lit("otl_"), "id").alias("id"), url.alias("url"), "title", name.alias("license"), F.concat_ws("\n", *lines).alias("content"))
