"""Configurations against JSON written by hand, and pages."""

import json

import pytest
from pyspark.sql import functions as F

from leafworks.operators import charts as C

GRID = {"color": "#4A5568"}
TITLE = {"display": True, "text": "T", "font": {"size": 16, "weight": "bold"}}

#: In the dark look.
WANTED = {
    "chart:pie\ntitle: T\nseries:\n  a: 1\n  b: [2]": {"type": "pie", "data": {"labels": ["a", "b"], "datasets": [{"data": [1, 2], "backgroundColor": ["#6C5CE7", "#00CEC9"], "borderWidth": 2, "borderColor": "#1A202C"}]}, "options": {"responsive": True, "cutout": 0, "plugins": {"title": TITLE, "legend": {"position": "right"}}}},
    "chart:donut\ntitle: T\nseries:\n  a: 1": {"type": "pie", "data": {"labels": ["a"], "datasets": [{"data": [1], "backgroundColor": ["#6C5CE7"], "borderWidth": 2, "borderColor": "#1A202C"}]}, "options": {"responsive": True, "cutout": "50%", "plugins": {"title": TITLE, "legend": {"position": "right"}}}},
    "chart:waterfall\ntitle: T\nseries:\n  a: 3\n  b: -1\n  c: 2": {"type": "bar", "data": {"labels": ["a", "b", "c"], "datasets": [{"label": "Base", "data": [0, 3, 2], "backgroundColor": "transparent", "borderWidth": 0}, {"label": "Value", "data": [3, -1, 2], "backgroundColor": ["#6C5CE7CC", "#E17055CC", "#6C5CE7CC"], "borderWidth": 0}]},
        "options": {"responsive": True, "plugins": {"title": TITLE, "legend": {"display": False}}, "scales": {"x": {"stacked": True, "grid": GRID}, "y": {"stacked": True, "grid": GRID}}}},
    "chart:heatmap\ntitle: T\nx: [p, q]\ny: [u]\ndata:\n  [1, 3]": {"type": "bubble", "_heatmapMeta": {"points": [{"x": 0, "y": 0, "v": 1, "r": 20, "intensity": 0}, {"x": 1, "y": 0, "v": 3, "r": 20, "intensity": 1}], "xLabels": ["p", "q"], "yLabels": ["u"]},
        "data": {"datasets": [{"data": [{"x": 0, "y": 0, "r": 20}, {"x": 1, "y": 0, "r": 20}], "backgroundColor": ["#6C5CE733", "#6C5CE7ff"]}]}, "options": {"responsive": True, "plugins": {"title": TITLE, "legend": {"display": False}}, "scales": {"x": {"type": "linear", "grid": GRID}, "y": {"type": "linear", "grid": GRID, "reverse": True}}}},
    "chart:stacked-bar\ntitle: T\nx: [p]\nseries:\n  a: [1]": {"type": "bar", "data": {"labels": ["p"], "datasets": [{"label": "a", "data": [1], "backgroundColor": "#6C5CE7CC", "borderColor": "#6C5CE7", "borderWidth": 1}]}, "options": {"responsive": True, "plugins": {"title": TITLE, "legend": {"position": "top"}}, "scales": {"x": {"stacked": True, "grid": GRID}, "y": {"stacked": True, "beginAtZero": True, "grid": GRID}}}},
    "chart:radar\ntitle: T\nx: [p]\nseries:\n  a: [1]": {"type": "radar", "data": {"labels": ["p"], "datasets": [{"label": "a", "data": [1], "borderColor": "#6C5CE7", "backgroundColor": "#6C5CE733", "pointRadius": 4, "borderWidth": 2}]}, "options": {"responsive": True, "plugins": {"title": TITLE, "legend": {"position": "top"}}, "scales": {"r": {"beginAtZero": True, "grid": GRID, "pointLabels": {"color": "#333"}}}}},
}


def made(spark, texts, themes):
    df = spark.createDataFrame([(i, t, themes[i % len(themes)]) for i, t in enumerate(texts)], "i int, text string, theme string")
    return C.specs(df, "i", "text").join(df.select("i", "theme"), "i").withColumn("look", C.looks(F.col("theme")))


@pytest.mark.parametrize("by_row", [False, True])
def test_whole_configurations(spark, by_row):
    df = made(spark, list(WANTED), ["dark"])
    got = df.withColumn("c", C.config(F.col("spec"), F.col("look") if by_row else "dark")).orderBy("i").select("c").collect()
    assert [json.loads(r["c"]) for r in got] == list(WANTED.values())


def test_themes(spark):
    names = [*C.THEMES, "none", None]
    got = made(spark, ["chart:pie\nseries:\n  a: 1"] * len(names), names).withColumn("c", C.config(F.col("spec"), F.col("look"))).orderBy("i").collect()
    for r in got:
        colors, background, *_ = C.THEMES.get(r["theme"], C.THEMES["corporate"])
        (data,) = json.loads(r["c"])["data"]["datasets"]
        assert (data["backgroundColor"], data["borderColor"]) == (colors.split(" ")[:1], background)


def test_only_kinds_asked_for(spark):
    df = made(spark, ["chart:pie\nseries:\n  a: 1", "chart:bar\nseries:\n  a: [1]"], ["dark"])
    got = df.select("i", C.config(F.col("spec"), "dark", ("bar", "none")).alias("c")).orderBy("i").collect()
    assert got[0]["c"] is None and json.loads(got[1]["c"])["type"] == "bar"


def test_heatmap_page(spark):
    df = made(spark, ["chart:heatmap\ntitle: </script>\nx: [p]\ny: [u]\ndata:\n  [1]", "chart:pie\nseries:\n  a: 1"], ["warm"])
    heat, pie = (r["page"] for r in df.withColumn("c", C.config(F.col("spec"), "warm")).select("i", C.chart_page(F.col("c"), "warm", 640, "/*lib*/").alias("page")).orderBy("i").collect())
    assert '"xLabels":["p"]' in heat and "_heatmapMeta" not in heat and "tooltip" in heat and "reverse" in heat and heat.count("</script>") == 1
    assert "_heatmapMeta" not in pie and "tooltip" not in pie and "new Chart(document.getElementById('chart'), {" in pie
    for page in (heat, pie):
        assert "background:#FFFFFF;color:#3D2B1F" in page and "width:640px" in page and "/*lib*/" in page and 'Chart.defaults.font.family = "\\"Noto Sans CJK KR\\", ' in page


def test_grid_page(spark):
    df = made(spark, ["chart:subplot 2x3\ntype: heatmap\ndata:\n  [1]\n---\ntype: bar\nseries:\n  a: [1]"], ["dark"]).withColumn("config", C.config(F.col("spec"), "dark"))
    page = C.subplot_page(df, "i", 900, 500, "dark").first()["page"]
    assert "gap:16px" in page and "min-height:250px" in page and "repeat(3,1fr)" in page and "background:#1A202C" in page and "'chart-0'), config" in page and "'chart-1'), {" in page


def test_mindmap_page(spark):
    data = F.lit('{"nodes":[{"id":"a","label":"</script>"}]}')
    page = spark.range(1).select(C.mindmap_page(F.lit("A & B"), F.lit(None), F.lit("nature"), data).alias("x")).first()["x"]
    assert '<body class="nature">' in page and "A &amp; B" in page and page.count("</script>") == 1 and 'id="map"' in page and "data.nodes" in page
