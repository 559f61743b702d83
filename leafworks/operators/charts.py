"""Chart text to chart configurations and pages, a row at a time with SQL functions: nothing is shuffled.

A text is ``chart:<type>``, fields, and sections (``series:``, ``data:``,
``stages:``); ``chart:subplot RxC`` holds several panels between ``---``.
Lines that fit nowhere are passed over, as are ``%%`` comments; numbers that
are none become null. A text without such a head has no panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The looks; colours of series, background, text, grid lines, fonts after the two that all begin with.
THEMES = {
    "corporate": ("#4A90D9 #7EC8E3 #48BB78 #ED8936 #9F7AEA #FC8181 #76E4F7 #F6E05E", "#FFFFFF", "#2C3E50", "#E2E8F0", '"Noto Sans KR", "Segoe UI", sans-serif'),
    "modern": ("#6C5CE7 #00CEC9 #FD79A8 #FDCB6E #55EFC4 #E17055 #74B9FF #A29BFE", "#FFFFFF", "#2D3436", "#DDD6FE", '"Inter", "Segoe UI", sans-serif'),
    "warm": ("#E8725C #F0A868 #6BBF7B #5B9BD5 #C77DBA #F7DC6F #85C1E9 #EB984E", "#FFFFFF", "#3D2B1F", "#F0D0B0", '"Noto Sans KR", "Georgia", serif'),
    "dark": ("#6C5CE7 #00CEC9 #FD79A8 #FDCB6E #55EFC4 #E17055 #74B9FF #A29BFE", "#1A202C", "#E2E8F0", "#4A5568", '"Inter", "Segoe UI", sans-serif'),
    "minimal": ("#718096 #A0AEC0 #CBD5E0 #E2E8F0 #4A5568 #2D3748 #1A202C #F7FAFC", "#FFFFFF", "#2D3748", "#E2E8F0", '"Helvetica Neue", "Arial", sans-serif'),
}
FONTS, STANDARD, POINT_LABELS = '"Noto Sans CJK KR", "Pretendard"', "corporate", "#333"

#: Colours of a series in the standard look.
COLORS = tuple(THEMES[STANDARD][0].split(" "))

#: What is drawn by which kind of chart, and the looks of mind maps: background, text, lines.
KINDS = {"bar": "bar", "grouped-bar": "bar", "stacked-bar": "bar", "line": "line", "area": "line", "radar": "radar", "combo": "bar", "pie": "pie", "donut": "pie", "doughnut": "pie", "scatter": "scatter", "funnel": "bar", "heatmap": "bubble", "waterfall": "bar"}
MINDMAP_THEMES = ("corporate", "academic", "creative", "dark", "minimal", "nature")

#: The lines of the chart language.

_SERIES_LINE = r"^(bar|line)\s+(?:y-(left|right)\s+)?(.+?):\s*\[(.+)\]"
_AXIS = r'^y-(left|right):\s*"?([^"]*)"?\s*(\d+)?\s*(?:-->)?\s*(\d+)?'
_LIST, _SCALAR, _STAGE, _ROW = r"^(.+?):\s*\[(.+)\]", r"^(.+?):\s*([-+0-9.eE_,]+)\s*$", r"^(.+?):\s*(\d+)", r"^\[(.+)\]"
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def _number(x: Column) -> Column:
    x = F.trim(x)
    return F.when(x == "", F.lit(0.0)).when(x.rlike(_NUMBER), x.try_cast("double"))


def _numbers(inside: Column) -> Column:
    return F.transform(F.split(inside, ","), _number)


def _items(line: Column) -> Column:
    inside = F.regexp_extract(line, r"\[(.+)\]", 1)
    items = F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(items)


def specs(charts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, panel, rows, cols, spec): the parsed panels of chart texts, panel from 0."""
    text = F.trim(F.col(text_col))
    head = F.regexp_extract(text, r"(?i)^chart:(\S+)", 1)
    options = F.regexp_extract(text, r"(?i)^chart:\S+[^\S\n]*([^\n]*)", 1)
    body = F.regexp_replace(text, r"^[^\n]*\n?", "")
    subplot = F.lower(head) == "subplot"
    parts = F.when(subplot, F.filter(F.split(body, r"(?m)^\s*---\s*$"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(""))) != "")).otherwise(F.array(F.concat(F.lit("type: "), F.lower(head), F.lit("\n"), body)))
    side = lambda i, n: F.when(F.regexp_extract(options, r"(\d+)x(\d+)", i) != "", F.regexp_extract(options, r"(\d+)x(\d+)", i).try_cast("int")).otherwise(F.lit(n))
    panels = charts.where(head != "").select(key, side(1, 1).alias("rows"), side(2, 2).alias("cols"), F.posexplode(parts).alias("panel", "part"))
    lines = F.filter(F.transform(F.split("part", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("%%"))
    # Each line with the section that it stands in.
    start = F.struct(F.lit("").alias("mode"), F.array().cast("array<struct<mode:string,line:string>>").alias("out"))
    tagged = F.aggregate("lines", start, lambda s, x: F.struct(F.when(x.isin("series:", "data:", "stages:"), F.regexp_replace(x, ":", "")).otherwise(s["mode"]).alias("mode"), F.concat(s["out"], F.array(F.struct(s["mode"].alias("mode"), x.alias("line")))).alias("out")))["out"]
    panels = panels.withColumn("lines", lines).withColumn("lines", tagged)
    types = F.filter("lines", lambda x: x["line"].startswith("type:"))
    panels = panels.withColumn("type", F.coalesce(F.trim(F.substring(F.try_element_at(types, F.lit(1))["line"], 6, 1 << 20)), F.lit("bar")))

    entry = "struct<name:string,values:array<double>,type:string,axis:string>"

    def made(name: Column, values: Column, type_: Column | None = None, axis: Column | None = None) -> Column:
        return F.struct(name.alias("name"), values.alias("values"), (F.lit(None) if type_ is None else type_).cast("string").alias("type"), (F.lit(None) if axis is None else axis).cast("string").alias("axis"))

    def series(x: Column) -> Column:
        line, mode = x["line"], x["mode"]
        part = lambda p, i: F.trim(F.regexp_extract(line, p, i))
        field = line.rlike(r"^(title:|x:|y:|y-(left|right):|colorScale:|type:)") | line.isin("series:", "data:", "stages:")
        plain_y = line.startswith("y:") & (F.col("type") != "heatmap") & (F.size(_items(line)) > 0)
        scalar = F.translate(part(_SCALAR, 2), "_,", "")
        return (
            F.when(plain_y, made(F.lit("data"), F.transform(_items(line), _number), None, F.lit("left")))
            .when(field, F.lit(None).cast(entry))
            .when(line.rlike(_SERIES_LINE), made(part(_SERIES_LINE, 3), _numbers(F.regexp_extract(line, _SERIES_LINE, 4)), part(_SERIES_LINE, 1), F.coalesce(F.nullif(part(_SERIES_LINE, 2), F.lit("")), F.lit("left"))))
            .when((mode == "series") & line.rlike(_LIST), made(part(_LIST, 1), _numbers(F.regexp_extract(line, _LIST, 2))))
            .when((mode == "series") & line.rlike(_SCALAR) & scalar.rlike(_NUMBER), made(part(_SCALAR, 1), F.array(scalar.try_cast("double"))))
            .when((mode == "stages") & line.rlike(_STAGE), made(part(_STAGE, 1), F.array(part(_STAGE, 2).try_cast("double"))))
        )

    def last(prefix: str) -> Column:
        return F.try_element_at(F.filter("lines", lambda x: x["line"].startswith(prefix)), F.lit(-1))["line"]

    def axis(which: str) -> Column:
        line = F.try_element_at(F.filter("lines", lambda x: x["line"].startswith(f"y-{which}:")), F.lit(-1))["line"]
        return F.when(line.isNotNull(), F.struct(F.trim(F.regexp_extract(line, _AXIS, 2)).alias("label"), F.regexp_extract(line, _AXIS, 3).try_cast("double").alias("min"), F.regexp_extract(line, _AXIS, 4).try_cast("double").alias("max")))

    data = F.transform(F.filter("lines", lambda x: (x["mode"] == "data") & x["line"].rlike(_ROW)), lambda x: _numbers(F.regexp_extract(x["line"], _ROW, 1)))
    found = panels.withColumn("series", F.filter(F.transform("lines", series), lambda x: x.isNotNull()))
    spec = F.struct(
        "type", F.regexp_replace(F.trim(F.substring(F.coalesce(last("title:"), F.lit("")), 7, 1 << 20)), r"^[\"']|[\"']$", "").alias("title"), F.coalesce(_items(last("x:")), F.array().cast("array<string>")).alias("x"),
        "series", axis("left").alias("y_left"), axis("right").alias("y_right"), data.alias("data"), F.when(F.col("type") == "heatmap", _items(last("y:"))).alias("y_categories"), F.trim(F.substring(last("colorScale:"), 12, 1 << 20)).alias("color_scale"),
    )
    return found.select(key, "panel", "rows", "cols", spec.alias("spec"))


class Look:
    """A theme's fields as columns: of one theme, or of each row's own."""

    def __init__(self, theme: str | Column):
        if isinstance(theme, str):
            colors, *rest = THEMES.get(theme, THEMES[STANDARD])
            self.colors = F.array(*[F.lit(c) for c in colors.split(" ")])
            self.background, self.text, self.grid, fonts = (F.lit(x) for x in rest)
            self.fonts = F.concat(F.lit(f"{FONTS}, "), fonts)
        else:
            self.colors, self.background, self.text, self.grid, self.fonts = (theme[x] for x in ("colors", "background", "text", "grid", "fonts"))

    def color(self, i: Column, suffix: str = "") -> Column:
        return F.concat(F.element_at(self.colors, (i % F.size(self.colors) + 1).cast("int")), F.lit(suffix))

    def lines(self) -> Column:
        return F.struct(self.grid.alias("color"))


def looks(name: Column) -> Column:
    """The fields of each row's theme, for ``Look``; unknown and null names have the standard look. Best made a column of its own first."""
    one = lambda t: F.struct(Look(t).colors.alias("colors"), Look(t).background.alias("background"), Look(t).text.alias("text"), Look(t).grid.alias("grid"), Look(t).fonts.alias("fonts"))
    known = F.create_map(*[x for t in THEMES for x in (F.lit(t), one(t))])
    return F.coalesce(F.try_element_at(known, F.coalesce(name, F.lit(STANDARD))), one(STANDARD))


def _title(spec: Column) -> Column:
    return F.struct((spec["title"] != "").alias("display"), spec["title"].alias("text"), F.struct(F.lit(16).alias("size"), F.lit("bold").alias("weight")).alias("font"))


def _plugins(spec: Column, legend: str | None) -> Column:
    return F.struct(_title(spec).alias("title"), (F.struct(F.lit(legend).alias("position")) if legend else F.struct(F.lit(False).alias("display"))).alias("legend"))


def _first(s: Column) -> Column:
    return F.try_element_at(s["values"], F.lit(1))


def config(spec: Column, theme: str | Column = STANDARD, kinds: tuple[str, ...] = tuple(KINDS)) -> Column:
    """A panel's configuration as JSON in a theme (a name, or a column of ``looks``); null for types that aren't among ``kinds``, which alone are built."""
    look = Look(theme)
    _color, _grid = look.color, look.lines
    series, names = spec["series"], F.transform(spec["series"], lambda s: s["name"])
    firsts = F.transform(series, _first)

    def lined(suffix: str, fill: bool | None, radius: int, width: int | None = None) -> Column:
        more = [] if fill is None else [F.lit(0.3).alias("tension"), F.lit(fill).alias("fill")]
        more += [] if width is None else [F.lit(width).alias("borderWidth")]
        return F.transform(series, lambda s, i: F.struct(s["name"].alias("label"), s["values"].alias("data"), _color(i).alias("borderColor"), _color(i, suffix).alias("backgroundColor"), F.lit(radius).alias("pointRadius"), *more))

    def whole(kind: str, data: Column, scales: Column | None, legend: str | None = "top", *more: Column) -> Column:
        options = F.struct(F.lit(True).alias("responsive"), _plugins(spec, legend).alias("plugins"), *([scales.alias("scales")] if scales is not None else []), *[m for m in more if m is not None])
        return F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"), options.alias("options")))

    def labelled(sets: Column, labels: Column | None = None) -> Column:
        return F.struct((spec["x"] if labels is None else labels).alias("labels"), sets.alias("datasets"))

    def axes(*y: Column) -> Column:
        return F.struct(F.struct(_grid().alias("grid")).alias("x"), F.struct(F.lit(True).alias("beginAtZero"), *y, _grid().alias("grid")).alias("y"))

    stacked = (spec["type"] == "stacked-bar").alias("stacked")
    bars = F.transform(series, lambda s, i: F.struct(s["name"].alias("label"), s["values"].alias("data"), _color(i, "CC").alias("backgroundColor"), _color(i).alias("borderColor"), F.lit(1).alias("borderWidth")))
    def bar() -> Column:
        return whole("bar", labelled(bars), F.struct(F.struct(stacked, _grid().alias("grid")).alias("x"), F.struct(stacked, F.lit(True).alias("beginAtZero"), _grid().alias("grid")).alias("y")))
    def line() -> Column:
        return whole("line", labelled(lined("33", False, 4)), axes())
    def area() -> Column:
        return whole("line", labelled(lined("55", True, 3)), axes((F.size(series) > 1).alias("stacked")))
    def radar() -> Column:
        return whole("radar", labelled(lined("33", None, 4, 2)), F.struct(F.struct(F.lit(True).alias("beginAtZero"), _grid().alias("grid"), F.struct(F.lit(POINT_LABELS).alias("color")).alias("pointLabels")).alias("r")))

    def mixed(s: Column, i: Column) -> Column:
        is_line = F.coalesce(s["type"] == "line", F.lit(False))
        pick = lambda a, b: F.when(is_line, F.lit(a)).otherwise(F.lit(b))
        return F.struct(
            s["name"].alias("label"), s["values"].alias("data"), pick("line", "bar").alias("type"), F.when(s["axis"] == "right", "yRight").otherwise("yLeft").alias("yAxisID"), _color(i).alias("borderColor"), F.when(is_line, _color(i, "33")).otherwise(_color(i, "CC")).alias("backgroundColor"),
            F.when(is_line, 0.3).alias("tension"), F.lit(False).alias("fill"), F.when(is_line, 4).alias("pointRadius"), pick(2, 1).alias("borderWidth"), pick(0, 1).alias("order"),
        )

    def scale(which: str, grid: Column) -> Column:
        y = spec[f"y_{which}"]
        label = F.coalesce(y["label"], F.lit(""))
        return F.struct(F.lit("linear").alias("type"), F.lit(which).alias("position"), F.lit(True).alias("beginAtZero"), F.struct((label != "").alias("display"), label.alias("text")).alias("title"), grid.alias("grid"), y["min"].alias("min"), y["max"].alias("max"))

    def combo() -> Column:
        return whole("bar", labelled(F.transform(series, mixed)), F.struct(F.struct(_grid().alias("grid")).alias("x"), scale("left", _grid()).alias("yLeft"), scale("right", F.struct(F.lit(False).alias("drawOnChartArea"))).alias("yRight")))
    slices = F.array(F.struct(firsts.alias("data"), F.slice(look.colors, F.lit(1), F.least(F.size(series), F.size(look.colors))).alias("backgroundColor"), F.lit(2).alias("borderWidth"), look.background.alias("borderColor")))
    def pie() -> Column:
        return whole("pie", labelled(slices, names), None, "right", F.when(spec["type"] == "pie", F.lit(0).cast("variant")).otherwise(F.lit("50%").cast("variant")).alias("cutout"))
    dots = F.transform(series, lambda s, i: F.struct(s["name"].alias("label"), s["values"].alias("data"), _color(i, "AA").alias("backgroundColor"), _color(i).alias("borderColor"), F.lit(6).alias("pointRadius")))
    untitled = F.struct(F.struct(F.lit(False).alias("display"), F.lit("").alias("text")).alias("title"), _grid().alias("grid"))
    def scatter() -> Column:
        return whole("scatter", F.struct(dots.alias("datasets")), F.struct(untitled.alias("x"), untitled.alias("y")))
    # Largest first, equals in their order.
    order = F.array_sort(F.transform(series, lambda s, i: F.struct((-F.coalesce(_first(s), F.lit(float("-inf")))).alias("down"), i.alias("at"), s["name"].alias("name"), _first(s).alias("value"))))
    stages = F.array(F.struct(F.transform(order, lambda s: s["value"]).alias("data"), F.transform(order, lambda s, i: _color(i, "CC")).alias("backgroundColor"), F.lit(0).alias("borderWidth"), F.lit(0.9).alias("barPercentage")))
    def funnel() -> Column:
        return whole("bar", labelled(stages, F.transform(order, lambda s: s["name"])), F.struct(F.struct(F.lit(True).alias("beginAtZero"), _grid().alias("grid")).alias("x"), F.struct(F.struct(F.lit(False).alias("display")).alias("grid")).alias("y")), None, F.lit("y").alias("indexAxis"))
    values = F.flatten(spec["data"])
    low, high = F.array_min(values), F.array_max(values)
    points = F.flatten(F.transform(spec["data"], lambda row, y: F.transform(row, lambda v, x: F.struct(x.alias("x"), y.alias("y"), v.alias("v"), F.lit(20).alias("r"), F.when(high > low, (v - low) / (high - low)).otherwise(0.5).alias("intensity")))))
    cells = F.array(F.struct(F.transform(points, lambda p: F.struct("p.x", "p.y", "p.r") if isinstance(p, str) else F.struct(p["x"].alias("x"), p["y"].alias("y"), p["r"].alias("r"))).alias("data"), F.transform(points, lambda p: F.concat(_color(F.lit(0)), T.alpha_hex(F.lit(0.2) + p["intensity"] * 0.8))).alias("backgroundColor")))
    rows = F.coalesce(spec["y_categories"], F.transform(spec["data"], lambda _, i: F.concat(F.lit("Row "), (i + 1).cast("string"))))
    def heatmap() -> Column:
        return F.to_json(F.struct(
        F.lit("bubble").alias("type"), F.struct(points.alias("points"), spec["x"].alias("xLabels"), rows.alias("yLabels")).alias("_heatmapMeta"), F.struct(cells.alias("datasets")).alias("data"),
        F.struct(F.lit(True).alias("responsive"), _plugins(spec, None).alias("plugins"), F.struct(F.struct(F.lit("linear").alias("type"), _grid().alias("grid")).alias("x"), F.struct(F.lit("linear").alias("type"), _grid().alias("grid"), F.lit(True).alias("reverse")).alias("y")).alias("scales")).alias("options"),
    ))
    bases = F.transform(firsts, lambda _, i: F.aggregate(F.slice(firsts, F.lit(1), i), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    # One colour and a list of colours in the same place: objects of their own.
    fall = F.array(
        F.to_variant_object(F.struct(F.lit("Base").alias("label"), bases.alias("data"), F.lit("transparent").alias("backgroundColor"), F.lit(0).alias("borderWidth"))),
        F.to_variant_object(F.struct(F.lit("Value").alias("label"), firsts.alias("data"), F.transform(firsts, lambda v: F.when(v >= 0, _color(F.lit(0), "CC")).otherwise(_color(F.lit(5), "CC"))).alias("backgroundColor"), F.lit(0).alias("borderWidth"))),
    )
    both = F.struct(F.lit(True).alias("stacked"), _grid().alias("grid"))
    def waterfall() -> Column:
        return whole("bar", labelled(fall, names), F.struct(both.alias("x"), both.alias("y")), None)
    made = {"bar": bar, "grouped-bar": bar, "stacked-bar": bar, "line": line, "area": area, "radar": radar, "combo": combo, "pie": pie, "donut": pie, "doughnut": pie, "scatter": scatter, "funnel": funnel, "heatmap": heatmap, "waterfall": waterfall}
    out, done = F.lit(None).cast("string"), {}
    for name in kinds:
        if name in made:
            if made[name] not in done:
                done[made[name]] = made[name]()
            out = F.when(spec["type"] == name, done[made[name]]).otherwise(out)
    return out


def _embedded(json: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(json, r"(?i)</script>", r"<\\/script>"), "<!--", r"<\\!--")


def _script(config: Column, canvas: Column) -> Column:
    """What draws a configuration: a heat map's tooltips and ticks need its cells and names beside it."""
    cells = F.get_json_object(config, "$._heatmapMeta")
    plain = F.to_json(F.map_filter(F.from_json(config, "map<string,variant>"), lambda k, _: k != "_heatmapMeta"))
    named = F.concat(
        F.lit("{ const cells = "), _embedded(cells), F.lit(", config = "), _embedded(plain), F.lit(";\n"),
        F.lit("const name = (axis, at) => cells[axis + 'Labels'][at] || at, ticks = axis => ({stepSize: 1, callback: at => name(axis, at)});\n"),
        F.lit("config.options.plugins.tooltip = {callbacks: {label: item => { const p = cells.points[item.dataIndex]; return name('y', p.y) + ' × ' + name('x', p.x) + ': ' + p.v; }}};\n"),
        F.lit("for (const axis of ['x', 'y']) config.options.scales[axis].ticks = ticks(axis);\n"),
        F.lit("new Chart(document.getElementById('"), canvas, F.lit("'), config); }"),
    )
    return F.when(cells.isNull(), F.concat(F.lit("new Chart(document.getElementById('"), canvas, F.lit("'), "), _embedded(config), F.lit(");"))).otherwise(named)


def _page(look: Look, style: Column, body: Column, scripts: Column, library: str) -> Column:
    """A page of its own: the theme's looks, the drawing library's text, and scripts."""
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><style>*{margin:0;padding:0;box-sizing:border-box}body{padding:24px;background:'), look.background, F.lit(";color:"), look.text, F.lit(";font-family:"), look.fonts, F.lit("}"), style,
        F.lit("</style></head>\n<body>\n"), body, F.lit("\n<script>"), F.lit(library), F.lit("\nChart.defaults.color = '"), look.text, F.lit("';\nChart.defaults.font.family = "), F.concat(F.lit('"'), F.replace(look.fonts, F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(";\n"), scripts, F.lit("\n</script>\n</body>\n</html>"),
    )


def chart_page(config: Column, theme: str | Column = STANDARD, width: int = 900, library: str = "") -> Column:
    """A page that draws one configuration; ``library`` is the text of the drawing library, which pages hold themselves."""
    style = F.lit(f"body{{display:flex;justify-content:center;align-items:center;min-height:100vh}}.chart{{position:relative;width:{width}px;max-width:95vw}}")
    return _page(Look(theme), style, F.lit('<div class="chart"><canvas id="chart"></canvas></div>'), _script(config, F.lit("chart")), library)


def subplot_page(panels: DataFrame, key: str, width: int = 900, height: int = 500, theme: str = STANDARD, library: str = "") -> DataFrame:
    """(key, page) of (key, panel, rows, cols, config): a grid of charts; panels of one text are few."""
    cells = F.array_sort(F.collect_list(F.struct("panel", "config")))
    whole = panels.where("config is not null").groupBy(key).agg(cells.alias("cells"), F.first("rows").alias("rows"), F.first("cols").alias("cols"))
    name = lambda c: F.concat(F.lit("chart-"), c["panel"].cast("string"))
    grid = F.array_join(F.transform("cells", lambda c: F.concat(F.lit('<div class="cell"><canvas id="'), name(c), F.lit('"></canvas></div>'))), "\n")
    scripts = F.array_join(F.transform("cells", lambda c: _script(c["config"], name(c))), "\n")
    side = lambda c: F.greatest(F.col(c), F.lit(1))
    style = F.concat(
        F.lit(".grid{display:grid;gap:16px;max-width:95vw;margin:0 auto;grid-template-columns:repeat("), F.col("cols").cast("string"), F.lit(",1fr);grid-template-rows:repeat("), F.col("rows").cast("string"),
        F.lit(",1fr)}.cell{position:relative;min-width:"), F.floor(F.lit(width) / side("cols")).cast("string"), F.lit("px;min-height:"), F.floor(F.lit(height) / side("rows")).cast("string"), F.lit("px}"),
    )
    return whole.select(key, _page(Look(theme), style, F.concat(F.lit('<div class="grid">\n'), grid, F.lit("\n</div>")), scripts, library).alias("page"))


#: Draws {nodes: [{id, parent, type, label, page}]}: children right of their parents, leaves one below the other, lines between them; what has no known parent hangs from the title.
_DRAW = """
const ns = "http://www.w3.org/2000/svg", svg = document.getElementById("map"), nodes = data.nodes || [], ids = new Set(nodes.map(n => n.id)), below = {};
for (const n of nodes) (below[ids.has(n.parent) && n.parent !== n.id ? n.parent : ""] ||= []).push(n);
const make = (tag, attrs, text) => { const e = document.createElementNS(ns, tag); for (const k in attrs) e.setAttribute(k, attrs[k]); if (text) e.textContent = text; svg.appendChild(e); return e; };
let row = 0, widest = 0; const seen = new Set();
function place(id, depth) { const at = (below[id] || []).filter(n => !seen.has(n.id) && seen.add(n.id)).map(n => ({n, ...place(n.id, depth + 1)})); widest = Math.max(widest, depth); const y = at.length ? at.reduce((s, c) => s + c.y, 0) / at.length : 34 * ++row; const x = 20 + 240 * depth; for (const c of at) { make("path", {class: "link", d: `M${x + 200} ${y} C${x + 220} ${y} ${c.x - 20} ${c.y} ${c.x} ${c.y}`}); make("text", {class: c.n.type || "topic", x: c.x + 4, y: c.y + 4}, c.n.label + (c.n.page == null ? "" : ` [${c.n.page}]`)); } return {x, y}; }
const root = place("", 0);
make("text", {class: "root", x: root.x, y: root.y + 4}, document.title);
svg.setAttribute("viewBox", `0 0 ${240 * (widest + 1) + 40} ${34 * (row + 1)}`);
"""

#: Background, text and line colours of mind maps, in the order of their names.
_MAP_LOOKS = ("#ffffff #2c3e50 #4a90d9", "#fdfaf3 #2f2a24 #8b5e3c", "#fff7fb #3b1f4a #d6409f", "#1a202c #e2e8f0 #6c5ce7", "#ffffff #2d3748 #a0aec0", "#f3faf3 #22402a #48bb78")


def mindmap_page(title: Column, subtitle: Column, theme: Column, data: Column) -> Column:
    """A page that draws a mind map from its JSON, {"nodes": [{id, parent, type, label, page}]}; unknown looks become the first one."""
    look = F.when(theme.isin(*MINDMAP_THEMES), theme).otherwise(F.lit(MINDMAP_THEMES[0]))
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Mindmap"))
    css = "".join("body.{0}{{background:{1};color:{2}}}.{0} text{{fill:{2}}}.{0} .link{{stroke:{3}}}".format(n, *x.split(" ")) for n, x in zip(MINDMAP_THEMES, _MAP_LOOKS, strict=True))
    style = f"<style>body{{margin:24px;font-family:sans-serif}}svg{{width:100%}}text{{font-size:13px}}.theme,.root{{font-weight:bold}}.visual{{font-style:italic}}.link{{fill:none;stroke-width:1.5}}{css}</style>"
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"><title>'), T.escape_html(name), F.lit(f'</title>{style}</head>\n<body class="'), look, F.lit('">\n<h1>'), T.escape_html(name), F.lit("</h1>\n<h2>"), T.escape_html(F.coalesce(subtitle, F.lit(""))),
        F.lit('</h2>\n<svg id="map" xmlns="http://www.w3.org/2000/svg"></svg>\n<script>const data = '), _embedded(data), F.lit(f";{_DRAW}</script>\n</body>\n</html>"),
    )
