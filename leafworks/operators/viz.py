"""Chart and mind-map text as tables: nodes, edges, series, and their citations.

Every step is a window or join inside one document, so documents spread over
the cluster; a document's lines are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import spans


def lines_of(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def carry(value: Column, key: str, order: str = "pos") -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def clean_mindmap(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, pos, line): a mind map's lines from its first heading on; bullets without amounts, too short ones dropped, uncited ones with the last citation before them."""
    plain = F.regexp_replace(T.strip(F.col(text_col)), r"(?i)\[Page\s*(\d+)\]", "[$1]")
    rows = lines_of(docs.select(key, plain.alias("t")), key, "t").withColumn("line", T.rstrip("line"))
    rows = rows.withColumn("open", F.max(F.col("line").startswith("## ")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("open")
    cites = F.regexp_extract_all("line", F.lit(r"(\[\d+\])"), F.lit(1))
    rows = rows.withColumn("cite", carry(F.when(F.size(cites) > 0, F.element_at(cites, -1)), key))
    bullet = F.col("line").rlike(r"^  *- ")
    rows = rows.withColumn("clean", F.when(bullet, T.scrub_bullet("line")).otherwise(F.col("line")))
    rest = T.strip(F.regexp_replace(F.regexp_replace("clean", r"^  *- ", ""), r"\[\d+\]", ""))
    rows = rows.where(~bullet | (F.char_length(rest) >= 3))
    cited = F.when(bullet & ~F.col("clean").rlike(r"\[\d+\]") & F.col("cite").isNotNull(), F.concat("clean", F.lit(" "), "cite")).otherwise(F.col("clean"))
    return rows.select(key, "pos", cited.alias("line"))


def mindmap_nodes(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, pos, id, parent, type, label, page) of markdown mind maps: ``## theme``, ``- topic``, indented ``- leaf``.

    The section that holds relationships is left out. Numbers inside a group
    are running counts (themes in a document, topics in a theme, leaves in a
    topic).
    """
    rows = lines_of(docs, key, text_col).withColumn("line", T.rstrip("line"))
    kind = F.when(F.col("line").rlike(r"^##\s+\S"), "theme").when(F.col("line").rlike(r"^  +- \S"), "leaf").when(F.col("line").rlike(r"^- \S"), "topic").when(F.col("line").contains("→"), "relation")
    rows = rows.withColumn("type", kind).where("type is not null")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum((F.col("type") == "theme").cast("int")).over(so_far))
    rows = rows.withColumn("related", F.max((F.col("type") == "relation").cast("int")).over(Window.partitionBy(key, "section"))).where("section > 0 and related = 0")
    # Themes number on without the section left out.
    rows = rows.withColumn("theme", F.dense_rank().over(Window.partitionBy(key).orderBy("section")) - 1)
    in_theme = Window.partitionBy(key, "theme").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("topic", F.sum((F.col("type") == "topic").cast("int")).over(in_theme) - 1).where("type <> 'leaf' or topic >= 0")
    rows = rows.withColumn("leaf", F.sum((F.col("type") == "leaf").cast("int")).over(Window.partitionBy(key, "theme", "topic").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    theme = F.concat(F.lit("theme_"), F.col("theme").cast("string"))
    topic = F.concat(theme, F.lit("_topic_"), F.col("topic").cast("string"))
    leaf = F.concat(topic, F.lit("_leaf_"), F.col("leaf").cast("string"))
    raw = T.strip(F.regexp_replace("line", r"^(##\s+|\s*- )", ""))
    label = F.coalesce(F.nullif(T.clean_label(raw), F.lit("")), raw)
    visual = raw.rlike(T.VISUAL_REF)
    out = rows.select(key, "pos", F.when(F.col("type") == "theme", theme).when(F.col("type") == "topic", topic).otherwise(leaf).alias("id"), F.when(F.col("type") == "theme", F.lit("root")).when(F.col("type") == "topic", theme).otherwise(topic).alias("parent"),
                      F.when((F.col("type") == "leaf") & visual, F.lit("visual")).otherwise(F.col("type")).alias("type"), label.alias("label"), F.when(F.col("type") != "theme", T.page_ref(raw)).alias("page"))
    return out


def inherit_pages(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with a page: a topic without one takes its first child's; then children without one take their topic's."""
    first = nodes.where("page is not null and type in ('leaf', 'visual')").groupBy(key, F.col("parent").alias("id_")).agg(F.min_by("page", "pos").alias("from_child"))
    up = nodes.join(first.withColumnRenamed(key, "k_"), (F.col(key) == F.col("k_")) & (F.col("id") == F.col("id_")), "left").withColumn("page", F.coalesce("page", F.when(F.col("type") == "topic", F.col("from_child")))).drop("k_", "id_", "from_child")
    topics = up.where("type = 'topic'").select(F.col(key).alias("k_"), F.col("id").alias("id_"), F.col("page").alias("from_parent"))
    return up.join(topics, (F.col(key) == F.col("k_")) & (F.col("parent") == F.col("id_")), "left").withColumn("page", F.coalesce("page", "from_parent")).drop("k_", "id_", "from_parent")


def relations(docs: DataFrame, nodes: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, source, target, relationship): lines ``"A" → causes → "B"`` with their labels resolved to topics.

    A label is found as it stands, else as part of a topic's label or the
    other way round, the first of these in the order of nodes; unknown
    relationships are related_to, and a node's link to itself is dropped.
    """
    pattern = r'["“]([^"”]+)["”]\s*→\s*(\w+)\s*→\s*["“]([^"”]+)["”]'
    r = lines_of(docs, key, text_col).where(F.col("line").rlike(pattern)).select(key, "pos", *[F.regexp_extract("line", pattern, i).alias(n) for i, n in ((1, "a"), (2, "rel"), (3, "b"))])
    topics = nodes.where("type in ('topic', 'visual')").select(F.col(key).alias("k_"), "id", F.col("pos").alias("at"), F.lower("label").alias("low"))

    def resolve(rows: DataFrame, side: str, out: str) -> DataFrame:
        low = F.lower(F.trim(side))
        met = rows.join(topics, (F.col(key) == F.col("k_")) & (low.contains(F.col("low")) | F.col("low").contains(low)))
        # Exact labels first (the last of equals, as a lookup table has it), then the first that contains.
        exact = F.col("low") == low
        place = F.row_number().over(Window.partitionBy(key, "pos").orderBy(F.desc(exact), F.when(exact, -F.col("at")).otherwise(F.col("at"))))
        return met.withColumn("rn", place).where("rn = 1").withColumn(out, F.col("id")).drop("k_", "id", "at", "low", "rn")

    both = resolve(resolve(r, "a", "source"), "b", "target").where("source <> target")
    return both.select(key, "source", "target", F.when(F.col("rel").isin(*T.RELATIONS), F.col("rel")).otherwise("related_to").alias("relationship"))


def known_edges(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = lambda c: nodes.select(F.col(key), F.col("id").alias(c))
    return edges.join(ids("source"), [key, "source"], "left_semi").join(ids("target"), [key, "target"], "left_semi")


def cited_pages(citations: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Citations (key, idx) with their page's filename and number; for an index that several pages have, the last document counts."""
    last = pages.groupBy(key, "idx").agg(F.max_by(F.struct("filename", "page"), "doc_no").alias("p"))
    return citations.join(last, [key, "idx"], "left").select(*citations.columns, "p.filename", "p.page")


def attach_visuals(topics: DataFrame, visuals: DataFrame, key: str) -> DataFrame:
    """(key, id, page, caption): visual elements under the first topic that cites their page; captions fall back on descriptions."""
    first = topics.where("page is not null").groupBy(key, "page").agg(F.min_by("id", "pos").alias("id"))
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.left("description", F.lit(40)))
    return first.join(visuals, [key, "page"]).withColumn("caption", caption).where(F.char_length("caption") >= 3).select(key, "id", "page", "caption")


def attach_snippets(nodes: DataFrame, pages: DataFrame, key: str, most: int = 200) -> DataFrame:
    """Nodes whose empty description is their page's beginning."""
    last = pages.groupBy(key, "page").agg(F.max_by(F.left("content", F.lit(most)), "doc_no").alias("snippet"))
    return nodes.join(last, [key, "page"], "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "snippet", F.lit(""))).drop("snippet")


def assemble(themes: DataFrame, extractions: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(id, parent, type, label) from themes (theme_id, label), extractions (theme_id, ord, topics) and enrichments (theme_id, label).

    Of several extractions of a theme the last counts.
    """
    last = extractions.groupBy("theme_id").agg(F.max_by("topics", "ord").alias("topics"))
    met = themes.join(last, "theme_id", "left")
    top = met.select(F.col("theme_id").alias("id"), F.lit("root").alias("parent"), F.lit("theme").alias("type"), "label")
    topics = met.select("theme_id", F.posexplode("topics").alias("j", "t"))
    tid = F.concat("theme_id", F.lit("_topic_"), F.col("j").cast("string"))
    mid = topics.select(tid.alias("id"), F.col("theme_id").alias("parent"), F.lit("topic").alias("type"), F.col("t.label").alias("label"))
    low = topics.select(tid.alias("parent"), F.posexplode("t.leaves").alias("k", "label")).select(F.concat("parent", F.lit("_leaf_"), F.col("k").cast("string")).alias("id"), "parent", F.lit("leaf").alias("type"), "label")
    more = themes.select("theme_id").join(enrichments, "theme_id").select(F.concat("theme_id", F.lit("_enrich_"), (F.row_number().over(Window.partitionBy("theme_id").orderBy("label")) - 1).cast("string")).alias("id"), F.col("theme_id").alias("parent"), F.lit("enrichment").alias("type"), "label")
    return top.unionByName(mid).unionByName(low).unionByName(more)


def layout(n_nodes: Column, n_visuals: Column) -> Column:
    """struct(layout, depth) of a mind map by its size."""
    return F.when(n_nodes > 60, F.struct(F.lit("radial").alias("layout"), F.lit(2).alias("depth"))).when((n_visuals > 0) | (n_nodes > 30), F.struct(F.lit("tree_lr").alias("layout"), F.lit(3).alias("depth"))).otherwise(F.struct(F.lit("radial").alias("layout"), F.lit(4).alias("depth")))


def chart_lines(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, panel, pos, chart_type, section, line): a chart text's lines, by panel (parts between ``---``) and the section they stand in."""
    rows = lines_of(docs, key, text_col).withColumn("line", T.strip("line"))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("panel", F.sum((F.col("line") == "---").cast("int")).over(so_far)).where("line not in ('---', '')")
    in_panel = Window.partitionBy(key, "panel")
    rows = rows.withColumn("chart_type", F.coalesce(F.max(F.nullif(F.regexp_extract("line", r"^(?:chart|type):\s*(\S+)", 1), F.lit(""))).over(in_panel), F.lit("bar")))
    head = F.nullif(F.regexp_extract("line", r"^(\w+):\s*$", 1), F.lit(""))
    return rows.withColumn("section", F.last(head, ignorenulls=True).over(in_panel.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def chart_fields(lines: DataFrame, key: str) -> DataFrame:
    """(key, panel, chart_type, title, x): what stands before the series."""
    field = lambda n: F.max(F.when(F.col("line").startswith(f"{n}:"), F.trim(F.expr(f"substr(line, {len(n) + 2})"))))
    return lines.groupBy(key, "panel", "chart_type").agg(field("title").alias("title"), field("x").alias("x_text")).withColumn("x", T.array_literal("x_text")).drop("x_text")


def chart_series(lines: DataFrame, key: str) -> DataFrame:
    """(key, panel, name, i, value): points of the series ``- name: [..]`` under ``series:``."""
    s = lines.where("section = 'series'").select(key, "panel", F.regexp_extract("line", r"^-?\s*([^:\[]+):\s*\[", 1).alias("name"), T.array_literal("line").alias("items")).where("name <> ''")
    return s.select(key, "panel", F.trim("name").alias("name"), F.posexplode("items").alias("i", "item")).select(key, "panel", "name", "i", T.number("item").alias("value"))


def waterfall(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Where each bar starts: the sum of those before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("base", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def normalized(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells with an intensity from 0 to 1 (0.5 if all are equal) and the alpha drawn."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    i = F.when(hi == lo, 0.5).otherwise((F.col(value) - lo) / (hi - lo))
    return cells.withColumn("intensity", i).withColumn("alpha", F.lit(0.2) + 0.8 * F.col("intensity"))


def chart_config(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, config): a chart's JSON from (keys, chart_type, title, name, i, label, value)."""
    data = series.groupBy(*keys, "chart_type", "title", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("data"), F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]).alias("labels"))
    sets = F.transform(F.array_sort(F.collect_list(F.struct("name", "data"))), lambda x: F.struct(x["name"].alias("label"), x["data"].alias("data")))
    whole = data.groupBy(*keys, "chart_type", "title").agg(sets.alias("datasets"), F.max("labels").alias("labels"))
    kind = F.when(F.col("chart_type").isin("grouped-bar", "stacked-bar", "waterfall", "funnel", "combo"), "bar").when(F.col("chart_type") == "area", "line").when(F.col("chart_type") == "donut", "doughnut").otherwise(F.col("chart_type"))
    options = F.struct(F.struct(F.struct(F.col("title").alias("text")).alias("title")).alias("plugins"), (F.col("chart_type") == "stacked-bar").alias("stacked"), F.col("chart_type").isin("funnel").alias("horizontal"))
    return whole.select(*keys, F.to_json(F.struct(kind.alias("type"), F.struct("labels", "datasets").alias("data"), options.alias("options"))).alias("config"))


def chart_page(config: Column, title: Column) -> Column:
    """A page that draws a chart from its JSON."""
    return F.concat(F.lit("<!doctype html><html><head><title>"), T.escape_html(title), F.lit('</title></head><body><canvas id="chart"></canvas><script type="application/json" id="config">'), F.replace(config, F.lit("</"), F.lit("<\\/")), F.lit("</script></body></html>"))


def evidence(elements: DataFrame, chunks: DataFrame, key: str, first: bool = False) -> DataFrame:
    """(key, element, chunk, start, stop): all places of the elements' labels in the chunks of their document, case aside; the ``first`` place in each chunk alone, if asked."""
    labels = elements.select(key, F.col("element").cast("string").alias("node"), F.array(F.lower("label")).alias("words"))
    found = spans.spans(chunks.select(key, F.col("chunk").alias("idx"), F.lower("content").alias("low")), labels, key, first=first, named=False)
    return found.select(key, F.col("node").cast(elements.schema["element"].dataType).alias("element"), F.col("idx").alias("chunk"), "start", "stop")


def attribute(elements: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, element, chunk, span): the first chunk of a document that holds an element's label, and where."""
    return evidence(elements, chunks, key, True).groupBy(key, "element").agg(F.min(F.struct("chunk", "start")).alias("m")).select(key, "element", "m.chunk", "m.start")
