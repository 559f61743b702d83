"""One query per kind of chart, over a text made for every document: with comments, stray lines, numbers that are none, ties, negative and missing values, texts without series and texts without a head."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from .base import query, table

LISTS = "concat('series:\n  one: [', a, ', ', b, ', n/a]\n  a stray line\n  two: [', c, ']\n  three: ', a, '\n')"
BODIES = {
    "combo": "concat('y-right: \"right\" 1 --> 9\nbar one: [', a, ', ', b, ']\nline y-right two: [', c, ']\n')",
    "funnel": "concat('stages:\n  one: ', a, '\n  two: ', c, '\n  three: ', a, '\n  four: none\n')",
    "heatmap": "concat('y: [u, v]\ndata:\n  [', a, ', ', b, ']\n  stray\n  [', c, ']\n')",
    "waterfall": "concat('series:\n  one: [', a, ']\n  two: [', b, ']\n  three: ', c, '\n')",
}


def charts_of(spark, sf_dir, kind: str):
    numbers = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 7 a", "doc_id % 5 - 2 b", "doc_id % 3 c")
    body = BODIES.get(kind, LISTS)
    return numbers.selectExpr("doc_id", f"concat(if(doc_id % 13 = 0, 'chart', 'chart:{kind}'), '\n%% a note\ntitle: \"T ', doc_id, '\"\nx: [p, \"q\", r]\n', if(doc_id % 11 = 0, '', {body})) as text")


_SHAPE = "struct<type:string,data:struct<labels:array<string>,datasets:array<struct<label:string,data:array<double>,backgroundColor:string>>>>"


def described(spark, sf_dir, kind: str, look: str):
    """(doc_id, kind, title, labels, sets, look): a configuration's parts; ``look`` is a path in its JSON."""
    s = C.specs(charts_of(spark, sf_dir, kind), "doc_id", "text").withColumn("config", C.config(F.col("spec"), kinds=(kind,)))
    c = s.withColumn("j", F.from_json("config", _SHAPE))
    number = lambda v: F.coalesce(v.cast("bigint").cast("string"), F.lit("-"))
    sets = F.array_join(F.transform("j.data.datasets", lambda d: F.concat_ws("|", F.coalesce(d["label"], F.lit("")), F.array_join(F.transform(d["data"], number), ","), d["backgroundColor"])), ";")
    return c.select("doc_id", F.col("j.type").alias("kind"), F.get_json_object("config", "$.options.plugins.title.text").alias("title"), F.coalesce(F.array_join("j.data.labels", "|"), F.lit("")).alias("labels"), F.coalesce(sets, F.lit("")).alias("sets"), F.get_json_object("config", look).alias("look"))


_D = "(select doc_id, doc_id % 7 as a, doc_id % 5 - 2 as b, doc_id % 3 as c, doc_id % 11 = 0 as bare from documents where doc_id % 13 > 0)"


def oracle(kind: str, sets: str, look: str, labels: str = "'p|q|r'") -> str:
    return f"select doc_id, '{kind}' as kind, 'T ' || doc_id as title, {labels} as labels, {sets} as sets, {look} as look from {_D}"


def lists(suffix: str) -> str:
    one, two, three = (c + suffix for c in C.COLORS[:3])
    return f"case when bare then '' else 'one|' || a || ',' || b || ',-|{one};two|' || c || '|{two};three|' || a || '|{three}' end"


def _register(kind: str, sql: str, look: str) -> None:
    def run(spark, sf_dir):
        return described(spark, sf_dir, kind, look)

    run.__doc__ = f"Configurations of charts of the kind {kind}."
    query(sql, name=f"chart_config_{kind.replace('-', '_')}")(run)


_register("bar", oracle("bar", lists("CC"), "'false'"), "$.options.scales.y.stacked")
_register("stacked-bar", oracle("bar", lists("CC"), "'true'"), "$.options.scales.y.stacked")
_register("line", oracle("line", lists("33"), "case when not bare then '0.3' end"), "$.data.datasets[0].tension")
_register("area", oracle("line", lists("55"), "(not bare)::varchar"), "$.options.scales.y.stacked")
_register("radar", oracle("radar", lists("33"), "'#333'"), "$.options.scales.r.pointLabels.color")
_register("scatter", oracle("scatter", lists("AA"), "'#E2E8F0'", "''"), "$.options.scales.x.grid.color")
_one = f"'one|' || a || ',' || b || '|{C.COLORS[0]}CC;two|' || c || '|{C.COLORS[1]}33'"
_register("combo", oracle("bar", f"case when bare then '' else {_one} end", "case when bare then '' else 'right' end"), "$.options.scales.yRight.title.text")
_colors = ",".join(f'"{c}"' for c in C.COLORS[:3])
for _kind in ("pie", "donut"):
    _register(_kind, oracle("pie", f"case when bare then '||[]' else '|' || a || ',' || c || ',' || a || '|[{_colors}]' end", "'0'" if _kind == "pie" else "'50%'", "case when bare then '' else 'one|two|three' end"), "$.options.cutout")
_cc = ",".join(f'"{c}CC"' for c in C.COLORS[:3])
_register("funnel", oracle("bar", f"case when bare then '||[]' else '|' || case when c > a then c || ',' || a || ',' || a else a || ',' || a || ',' || c end || '|[{_cc}]' end", "'y'", "case when bare then '' when c > a then 'two|one|three' when c = a then 'one|two|three' else 'one|three|two' end"), "$.options.indexAxis")
_up, _down = f'"{C.COLORS[0]}CC"', f'"{C.COLORS[5]}CC"'
_register("waterfall", oracle("bar", f"case when bare then 'Base||transparent;Value||[]' else 'Base|0,' || a || ',' || (a + b) || '|transparent;Value|' || a || ',' || b || ',' || c || '|[{_up},' || case when b >= 0 then '{_up}' else '{_down}' end || ',{_up}]' end", "'true'", "case when bare then '' else 'one|two|three' end"), "$.options.scales.x.stacked")


@query(f"""select doc_id, row_labels, string_agg(x || ':' || y || ':' || v || ':' || round(case when hi > lo then (v - lo) / (hi - lo) else 0.5 end, 6), ';' order by y, x) as points from (
  select *, greatest(a, b, c)::double as hi, least(a, b, c)::double as lo, unnest([0, 1, 0]) as x, unnest([0, 0, 1]) as y, unnest([a, b, c])::double as v, 'u|v' as row_labels from {_D}) where not bare group by doc_id, row_labels
  union all select doc_id, '', '' from {_D} where bare""")
def chart_config_heatmap(spark, sf_dir):
    """Cells with their intensity between the least and the greatest value, 0.5 if all are equal."""
    s = C.specs(charts_of(spark, sf_dir, "heatmap"), "doc_id", "text").withColumn("config", C.config(F.col("spec"), kinds=("heatmap",)))
    m = F.from_json(F.get_json_object("config", "$._heatmapMeta"), "struct<points:array<struct<x:int,y:int,v:double,intensity:double>>,yLabels:array<string>>")
    points = F.array_join(F.transform("m.points", lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"), p["v"].cast("string"), F.round(p["intensity"], 6).cast("string"))), ";")
    return s.withColumn("m", m).select("doc_id", F.coalesce(F.array_join("m.yLabels", "|"), F.lit("")).alias("row_labels"), F.coalesce(points, F.lit("")).alias("points"))


@query("""select doc_id, 3::bigint as n_canvases, 3::bigint as n_charts, true as grid, doc_id % 2 = 0 as escaped from documents""")
def subplot_pages(spark, sf_dir):
    """Grids of three panels, one of a type that there is none and so not drawn; titles that would end the script don't."""
    title = F.when(F.col("doc_id") % 2 == 0, F.lit("a </script> b")).otherwise(F.lit("plain"))
    text = F.concat(F.lit("chart:subplot 2x2\ntype: line\ntitle: "), title, F.lit("\nseries:\n  s: [1, 2]\n---\ntype: pie\nseries:\n  a: 1\n---\nseries:\n  b: [3]\n---\ntype: none\nseries:\n  b: [3]\n---\n"))
    s = C.specs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text").withColumn("config", C.config(F.col("spec")))
    page = F.col("page")
    return C.subplot_page(s, "doc_id").select("doc_id", F.regexp_count(page, F.lit("<canvas id=\"chart-\\d+\">")).cast("long").alias("n_canvases"), F.regexp_count(page, F.lit("new Chart\\(")).cast("long").alias("n_charts"), page.contains("repeat(2,1fr)").alias("grid"), page.contains("a <\\/script> b").alias("escaped"))


@query("""select doc_id, 'Mindmap' as title, case when lang = 'en' then 'dark' else 'corporate' end as theme, true as safe from documents""")
def mindmap_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    data = F.to_json(F.struct(F.lit("</script><!--").alias("label")))
    page = C.mindmap_page(F.lit(""), F.col("source"), F.when(F.col("lang") == "en", "dark").otherwise(F.col("lang")), data)
    d = d.select("doc_id", page.alias("page"))
    return d.select("doc_id", F.regexp_extract("page", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("page", '<body class="(.*?)">', 1).alias("theme"), (F.regexp_count("page", F.lit("</script>")) == 1).alias("safe"))


_LOOKS = ", ".join(f"('{t}', '{c.split(' ')[0]}', '{c.split(' ')[5]}', '{back}', '{text}', '{grid}')" for t, (c, back, text, grid, _) in C.THEMES.items())


@query(f"""with t(theme, first, sixth, background, text_color, grid) as (values {_LOOKS}),
  d as (select doc_id, coalesce(nullif(regexp_extract(text, '[a-z]+', 0), ''), 'none') as word, lang, n_chars, case doc_id % 6 when 0 then 'modern' when 1 then 'warm' when 2 then 'dark' when 3 then 'minimal' when 4 then 'other' else 'corporate' end as asked from documents where text is not null)
  select doc_id, asked as theme, case doc_id % 3 when 0 then 'pie' when 1 then 'bubble' else 'bar' end as kind, word || ' of ' || lang as title, case doc_id % 3 when 0 then first || ',' || background when 1 then first || '33,' || first || 'ff' else 'transparent,' || first || 'CC' || sixth || 'CC' end as colors,
    case when doc_id % 3 = 0 then null else grid end as grid, case when doc_id % 3 = 1 then n_chars::bigint when doc_id % 3 = 0 then n_chars::bigint else 0 end as value, background || text_color as page_colors, doc_id % 3 = 1 as named_cells, true as whole
  from d join t on t.theme = case when asked = 'other' then 'corporate' else asked end""")
def chart_themes(spark, sf_dir):
    """Pies, heat maps and waterfalls of words and sizes of the documents, in the theme that each row asks for, on pages of their own."""
    d = table(spark, sf_dir, "documents").where("text is not null").selectExpr(
        "doc_id", "lang", "cast(n_chars as long) n_chars", "coalesce(nullif(regexp_extract(text, '[a-z]+', 0), ''), 'none') word", "case doc_id % 6 when 0 then 'modern' when 1 then 'warm' when 2 then 'dark' when 3 then 'minimal' when 4 then 'other' else 'corporate' end theme",
        "case doc_id % 3 when 0 then 'pie' when 1 then 'heatmap' else 'waterfall' end kind",
    )
    body = F.expr("if(kind = 'heatmap', concat('x: [', lang, ', ', word, ']\ny: [size]\ndata:\n  [0, ', n_chars, ']\n'), concat('series:\n  ', word, ': [', n_chars, ']\n  less: [-1]\n'))")
    text = F.concat(F.lit("chart:"), F.col("kind"), F.lit("\ntitle: "), F.col("word"), F.lit(" of "), F.col("lang"), F.lit("\n"), body)
    s = C.specs(d.select("doc_id", text.alias("text")), "doc_id", "text").join(d.select("doc_id", "theme"), "doc_id").withColumn("look", C.looks(F.col("theme")))
    s = s.withColumn("config", C.config(F.col("spec"), F.col("look"), ("pie", "heatmap", "waterfall"))).withColumn("page", C.chart_page(F.col("config"), F.col("look")))
    at = lambda path: F.get_json_object("config", path)
    colors = F.when(F.col("spec.type") == "pie", F.concat_ws(",", at("$.data.datasets[0].backgroundColor[0]"), at("$.data.datasets[0].borderColor"))).when(F.col("spec.type") == "heatmap", F.concat_ws(",", at("$.data.datasets[0].backgroundColor[0]"), at("$.data.datasets[0].backgroundColor[1]")))
    colors = F.coalesce(colors, F.concat(at("$.data.datasets[0].backgroundColor"), F.lit(","), at("$.data.datasets[1].backgroundColor[0]"), at("$.data.datasets[1].backgroundColor[1]")))
    value = F.coalesce(F.when(F.col("spec.type") == "heatmap", at("$._heatmapMeta.points[1].v")).otherwise(at("$.data.datasets[0].data[0]")).cast("double").cast("long"), F.lit(0))
    page_colors = F.concat(F.regexp_extract("page", "background:([^;]+);", 1), F.regexp_extract("page", r"Chart\.defaults\.color = '([^']+)'", 1))
    return s.select("doc_id", "theme", at("$.type").alias("kind"), at("$.options.plugins.title.text").alias("title"), colors.alias("colors"), at("$.options.scales.y.grid.color").alias("grid"), value.alias("value"), page_colors.alias("page_colors"), F.col("page").contains("const cells = {").alias("named_cells"), (F.col("page").contains("new Chart(") & F.col("page").endswith("</html>")).alias("whole"))
