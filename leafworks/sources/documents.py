"""Readers: JSON documents of several layouts, web replies, and bundle corpora, as page and passage tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json(spark: SparkSession, paths: list[str], single: bool = False) -> DataFrame:
    """(path, name, ordinal, json): whole files, each one JSON value; only the first path if ``single``.

    ``ordinal`` is the place of the file's path among ``paths``, by the whole
    path, so equal names in several folders are several files; a path asked
    for twice gives its file twice. Names may hold any character. A path that
    doesn't exist raises.
    """
    paths = paths[:1] if single else paths
    settings = spark.sparkContext._jsc.hadoopConfiguration()

    def whole(p: str) -> str:
        place = spark._jvm.org.apache.hadoop.fs.Path(p)
        return place.getFileSystem(settings).makeQualified(place).toString()

    full = [whole(p) for p in paths]
    order = spark.createDataFrame(list(zip(full, range(len(full)), strict=True)), "path string, ordinal int")
    # What a pattern could mean in a path is no pattern here.
    asked = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in dict.fromkeys(full)]
    files = spark.read.format("binaryFile").load(asked).select("path", F.decode("content", "UTF-8").alias("json"))
    return files.join(order, "path").select("path", F.substring_index("path", "/", -1).alias("name"), "ordinal", "json")


def _variant(json: Column) -> Column:
    return F.try_parse_json(json)


def page_keys(json: Column) -> Column:
    """Whether every key of an object looks like a page: digits, or beginning with p."""
    return F.forall(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), lambda k: k.rlike("^[0-9]+$") | k.startswith("p"))


def sniff(json: Column) -> Column:
    """The layout: docai, dict, array; single values and unknown objects are dict."""
    kind = F.schema_of_variant(_variant(json))
    outputs = F.schema_of_variant(F.try_variant_get(_variant(json), "$.outputs", "variant"))
    return F.when(kind.startswith("OBJECT") & F.coalesce(outputs.startswith("ARRAY"), F.lit(False)), "docai").when(kind.startswith("ARRAY"), "array").otherwise("dict")


_KIND = "path string, format string, filename string, idx int, page int, content string"


def pages_of(docs: DataFrame) -> DataFrame:
    """(path, format, filename, idx, page, content) of (path, json), for every layout."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.(?!json$)[^.]*$", "")
    d = docs.withColumn("format", sniff(F.col("json"))).withColumn("filename", name).withColumn("v", _variant(F.col("json")))
    shape = F.schema_of_variant("v")

    # Objects keep the order of their keys as a map of texts; falsy contents are empty.
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    dicts = d.where((F.col("format") == "dict") & shape.startswith("OBJECT") & page_keys(F.col("json")))
    dicts = dicts.select("path", "format", "filename", F.posexplode(entries).alias("pos", "e"))
    order = Window.partitionBy("path").orderBy(F.coalesce(F.when(F.col("e.key").rlike("^[0-9]+$"), F.col("e.key").try_cast("int")), F.lit(0)), "pos")
    dicts = dicts.withColumn("idx", F.row_number().over(order))
    content = F.when(F.col("e.value").isin("0", "false", "[]", "{}", "null"), F.lit("")).otherwise(F.coalesce("e.value", F.lit("")))
    dicts = dicts.select("path", "format", "filename", "idx", F.coalesce(F.when(F.col("e.key").rlike("^[0-9]+$"), F.col("e.key").try_cast("int")), F.col("idx")).alias("page"), content.alias("content"))

    other = d.where((F.col("format") == "dict") & ~(shape.startswith("OBJECT") & page_keys(F.col("json"))))
    other = other.select("path", "format", "filename", F.lit(1).alias("idx"), F.lit(1).alias("page"), F.when(shape.startswith("OBJECT"), F.col("json")).otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.col("json"))).alias("content"))

    # from_json leaves the texts of items as they stand.
    arrays = d.where("format = 'array'").select("path", "format", "filename", F.posexplode(F.from_json("json", "array<string>")).alias("pos", "item"))
    iv = _variant(F.col("item"))
    is_object = F.coalesce(F.schema_of_variant(iv).startswith("OBJECT"), F.lit(False))
    text = lambda p: F.try_variant_get(iv, p, "string")
    found = F.coalesce(text("$.content"), text("$.text"), F.lit(""))
    arrays = arrays.select("path", "format", "filename", (F.col("pos") + 1).alias("idx"), F.coalesce(F.when(is_object, F.try_variant_get(iv, "$.page", "int")), F.col("pos") + 1).alias("page"), F.when(is_object, F.when(found == "", F.col("item")).otherwise(found)).otherwise(F.col("item")).alias("content"))

    docai = d.where("format = 'docai'").withColumn("o", F.get_json_object("json", "$.outputs[0]"))
    parsed = F.coalesce(F.get_json_object("o", "$.html_parsed"), F.get_json_object("o", "$.list_parsed"))
    inner = docai.select("path", "format", F.coalesce(F.get_json_object("o", "$.file_name"), F.col("filename")).alias("filename"), F.explode_outer(F.map_entries(F.from_json(parsed, "map<string,string>"))).alias("e"))
    numbered = inner.withColumn("key", F.when(F.col("e.key").rlike("^[0-9]+$"), F.col("e.key").try_cast("int")))
    # At least one page, empty if none is numbered.
    numbered = numbered.withColumn("some", F.max("key").over(Window.partitionBy("path"))).withColumn("first", F.row_number().over(Window.partitionBy("path").orderBy(F.col("key").asc_nulls_last()))).where("key is not null or (some is null and first = 1)")
    lines = F.filter(F.from_json("e.value", "array<string>"), lambda x: F.coalesce(x, F.lit("")) != "")
    body = F.when(F.col("e.value").startswith("["), F.array_join(lines, "\n\n")).otherwise(F.coalesce("e.value", F.lit("")))
    idx = F.row_number().over(Window.partitionBy("path").orderBy(F.col("key").asc_nulls_last()))
    docai = numbered.select("path", "format", "filename", idx.alias("idx"), F.coalesce("key", F.lit(1)).alias("page"), F.when(F.col("key").isNotNull(), body).otherwise(F.lit("")).alias("content"))
    return dicts.unionByName(other).unionByName(arrays).unionByName(docai)


def visual_elements(docs: DataFrame) -> DataFrame:
    """(path, page, caption, description, category) of (path, json): results by page, without those that say nothing."""
    by_page = F.from_json(F.get_json_object("json", "$.outputs[0].images"), "map<string,string>")
    e = docs.select("path", F.explode(F.map_entries(by_page)).alias("e")).where(F.col("e.key").rlike("^[0-9]+$"))
    results = F.when(F.col("e.value").startswith("["), F.col("e.value")).otherwise(F.get_json_object("e.value", "$.results"))
    item = "struct<caption:string,description:string,Category:string>"
    rows = e.select("path", F.col("e.key").cast("int").alias("page"), F.posexplode(F.from_json(results, f"array<{item}>")).alias("pos", "x"))
    out = rows.select("path", "page", "pos", F.coalesce("x.caption", F.lit("")).alias("caption"), F.coalesce("x.description", F.lit("")).alias("description"), F.lower(F.coalesce("x.Category", F.lit("figure"))).alias("category"))
    return out.where("caption <> '' or description <> ''")


def web_passages(items: DataFrame, most: int = 35000) -> DataFrame:
    """(…, idx, site_name, snippet, url) of rows with pos and item struct(site, content, link)."""
    return items.withColumns({"idx": F.col("pos") + 1, "site_name": F.coalesce("item.site", F.lit("Unknown")), "snippet": F.left(F.coalesce("item.content", F.lit("")), F.lit(most)), "url": F.coalesce("item.link", F.concat(F.lit("web-result-"), (F.col("pos") + 1).cast("string")))}).drop("item")


def fallback_passages(replies: DataFrame) -> DataFrame:
    """(id, idx, site_name, snippet, url) of (id, json): ``result`` is an object with results or a list of such."""
    result = F.get_json_object("json", "$.result")
    groups = F.when(result.startswith("["), F.from_json(result, "array<string>")).otherwise(F.array(result))
    g = replies.select("id", F.posexplode(groups).alias("g", "group"))
    item = "array<struct<site_name:string,snippet:string,url:string>>"
    rows = g.select("id", "g", F.posexplode(F.from_json(F.get_json_object("group", "$.results"), item)).alias("pos", "x"))
    idx = F.row_number().over(Window.partitionBy("id").orderBy("g", "pos"))
    return rows.select("id", idx.alias("idx"), F.coalesce("x.site_name", F.lit("Unknown")).alias("site_name"), F.coalesce("x.snippet", F.lit("")).alias("snippet"), F.coalesce("x.url", F.lit("")).alias("url"))


def split_articles(rows: DataFrame, col: str, mark: str = "|||||", least: int = 2, most: int = 5) -> DataFrame:
    """One row per article of texts with ``least`` to ``most`` marks, trimmed, without empty ones."""
    n = (F.char_length(col) - F.char_length(F.replace(F.col(col), F.lit(mark), F.lit("")))) / len(mark)
    parts = F.filter(F.transform(F.split(col, r"\|\|\|\|\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.where(n.between(least, most)).select(*[c for c in rows.columns if c != col], F.posexplode(parts).alias("p", "article")).withColumn("pos", F.col("p") + 1).drop("p")


def supporting_paragraphs(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(question_id, title, text): paragraphs (question_id, title, pos, sentence) whose title is a supporting one, sentences joined by spaces."""
    kept = questions.join(facts.select("question_id", "title").distinct(), ["question_id", "title"], "left_semi")
    return kept.groupBy("question_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def top_per_topic(rows: DataFrame, topic: str, order: list[Column], n: int = 3) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("rn") <= n)


def report_sections(rows: DataFrame, col: str) -> DataFrame:
    """Items 7 and 7A of an annual report, each cut to its length; rows lacking one are left out."""
    discussion = F.left(F.regexp_extract(col, r"(?is)item\s*7\.(.*?)item\s*7a\.", 1), F.lit(15000))
    risk = F.left(F.regexp_extract(col, r"(?is)item\s*7a\.(.*?)item\s*8\.", 1), F.lit(5000))
    return rows.withColumn("discussion", discussion).withColumn("risk", risk).where("discussion <> '' and risk <> ''")


def sample_rows(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash of their ids: the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)
