"""Literal cases of page tables, sources and budgets."""

import pytest
from pyspark.sql import functions as F

from leafworks.functions import text as T
from leafworks.operators import pages as P
from leafworks.operators import retrieval as R
from leafworks.sources import documents as D
from leafworks.sources import sinks


def pages_of(spark, json):
    rows = D.pages_of(spark.createDataFrame([("/x/a.json", json)], "path string, json string")).orderBy("idx").collect()
    return [(r.format, r.filename, r.idx, r.page, r.content) for r in rows]


@pytest.mark.parametrize(
    "json, want",
    [
        ('{"10": "c", "2": "b", "1": ""}', [("dict", "a.json", 1, 1, ""), ("dict", "a.json", 2, 2, "b"), ("dict", "a.json", 3, 10, "c")]),
        ('{"price": "x"}', [("dict", "a.json", 1, 1, "x")]),
        ('{"title": 1}', [("dict", "a.json", 1, 1, '{"title": 1}')]),
        ("{}", []),
        ('"just text"', [("dict", "a.json", 1, 1, "just text")]),
        ('[{"page": 4, "content": "x"}, {"text": "t"}, "plain"]', [("array", "a.json", 1, 4, "x"), ("array", "a.json", 2, 2, "t"), ("array", "a.json", 3, 3, "plain")]),
        ('{"outputs": [{"file_name": "in.pdf", "html_parsed": {"10": ["z"], "2": ["a", "", "b"], "x": ["no"]}}]}', [("docai", "in.pdf", 1, 2, "a\n\nb"), ("docai", "in.pdf", 2, 10, "z")]),
        ('{"outputs": [{"file_name": "in.pdf", "html_parsed": {}}]}', [("docai", "in.pdf", 1, 1, "")]),
    ],
)
def test_layouts(spark, json, want):
    assert pages_of(spark, json) == want


def test_read_json(spark, tmp_path):
    for n in ("b.json", "a.json"):
        (tmp_path / n).write_text('{"1": "%s"}' % n)
    got = D.read_json(spark, [f"{tmp_path}/b.json", f"{tmp_path}/a.json"]).orderBy("ordinal").collect()
    assert [r.json for r in got] == ['{"1": "b.json"}', '{"1": "a.json"}']
    assert D.read_json(spark, [f"{tmp_path}/b.json", f"{tmp_path}/a.json"], single=True).count() == 1
    with pytest.raises(Exception):
        D.read_json(spark, [f"{tmp_path}/none.json"]).collect()


def truncated(spark, docs, most):
    rows = [("k", d + 1, i + 1, i + 1, c) for d, pages in enumerate(docs) for i, c in enumerate(pages)]
    df = spark.createDataFrame(rows, "key string, doc_no int, idx int, page int, content string")
    got = P.truncate(df, "key", most).collect()
    return got[0].body if got else ""


def test_truncate(spark):
    assert truncated(spark, [["Hello world"]], 10000) == "[Doc1 Page1] Hello world"
    clipped = truncated(spark, [["A" * 200, "B" * 200]], 350)
    assert clipped.endswith("...") and "B" in clipped
    dropped = truncated(spark, [["X" * 200, "Y" * 200]], 230)
    assert "Y" not in dropped and not dropped.endswith("...")
    assert truncated(spark, [], 100) == ""
    # Documents 2 and 3 are both clipped, as the clipped piece costs nothing.
    three = truncated(spark, [["a" * 100], ["b" * 400], ["c" * 400]], 300)
    assert three.count("...") == 2 and "[Doc3 Page1]" in three


def model_truncate(docs, most, least=100):
    used, parts = 0, []
    for d, pages in enumerate(docs, 1):
        for p, content in enumerate(pages, 1):
            chunk = f"[Doc{d} Page{p}] {content}"
            if used + len(chunk) > most:
                if most - used > least:
                    parts.append(chunk[: most - used] + "...")
                break
            parts.append(chunk)
            used += len(chunk)
    return "\n\n".join(parts)


def test_truncate_random(spark):
    import random

    rng = random.Random(5)
    for _ in range(6):
        docs = [["x" * rng.randint(0, 260) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 5))]
        most = rng.randint(50, 900)
        assert truncated(spark, docs, most) == model_truncate(docs, most)


def test_top_k(spark):
    rows = [("q", i, s) for i, s in enumerate(["0.9", "0.85", "bad", "0.9", None])]
    df = spark.createDataFrame(rows, "q string, pos int, score string")
    assert [(r.pos, r["rank"]) for r in R.top_k(df, ["q"], [F.col("pos")], 3).orderBy("rank").collect()] == [(0, 1), (3, 2), (1, 3)]
    assert R.top_k(df, ["q"], [F.col("pos")], 9, least=0.6).count() == 3


def test_keep_first(spark):
    rows = [("a", 1, "first", 0), ("a", 1, "again", 1), ("a", 2, "x", 2), (None, None, "w", 3), (None, None, "w", 4)]
    got = R.keep_first(spark.createDataFrame(rows, "filename string, page int, content string, o int"), ["filename", "page"], [F.col("o")]).orderBy("idx").collect()
    assert [(r.idx, r.content) for r in got] == [(1, "first"), (2, "x"), (3, "w"), (4, "w")]


def test_context_items(spark):
    cases = {"": [""], "Hello world": ["Hello world"], '["a","b","c"]': ["a", "b", "c"], '{"key":"val"}': ['{"key":"val"}'], '"key": ["a","b"]': ["a", "b"]}
    for text, want in cases.items():
        assert spark.range(1).select(T.context_items(F.lit(text)).alias("x")).first().x == want


def test_visual_elements(spark):
    json = '{"outputs": [{"images": {"2": {"results": [{"caption": "c", "Category": "Chart"}, {"caption": ""}]}, "1": [{"description": "d"}], "x": []}}]}'
    got = D.visual_elements(spark.createDataFrame([("p", json)], "path string, json string")).orderBy("page").collect()
    assert [(r.page, r.caption, r.description, r.category) for r in got] == [(1, "", "d", "figure"), (2, "c", "", "chart")]


def test_fallback_passages(spark):
    rows = [(1, '{"result": {"results": [{"site_name": "s", "snippet": "a", "url": "u"}]}}'), (2, '{"result": [{"results": [{"snippet": "b"}]}, {"results": [{"snippet": "c"}]}]}')]
    got = D.fallback_passages(spark.createDataFrame(rows, "id int, json string")).orderBy("id", "idx").collect()
    assert [(r.id, r.idx, r.site_name, r.snippet, r.url) for r in got] == [(1, 1, "s", "a", "u"), (2, 1, "Unknown", "b", ""), (2, 2, "Unknown", "c", "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", "안녕", None), ("s1", "b", 2)], "session_id string, text string, n int")
    sinks.write_jsonl(df, f"{tmp_path}/j")
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert sinks.read_jsonl(spark, f"{tmp_path}/j", "session_id string, text string, n int").count() == 4
    assert [r.samples for r in sinks.append_sessions(df, f"{tmp_path}/s").collect()] == [2]
    assert [r.samples for r in sinks.append_sessions(df, f"{tmp_path}/s").collect()] == [4]
    logs = spark.sql("select map('user', 'x', 'API_KEY', 'y') payload, timestamp '2026-03-05 00:00:00' logged_at")
    sinks.log_requests(logs, f"{tmp_path}/l")
    back = spark.read.json(f"{tmp_path}/l").first()
    assert back.payload.asDict() == {"user": "x"} and str(back.yymm) == "2603"
    assert sinks.recent_logs(logs, F.lit("2026-03-20").cast("timestamp")).count() == 0
    kept = sinks.rewrite_logs(spark, f"{tmp_path}/l", f"{tmp_path}/l2", F.lit("2026-03-05").cast("timestamp"), 365)
    assert spark.read.json(f"{tmp_path}/l2").count() == kept.count() > 0
    sinks.export_trace(df.limit(1), f"{tmp_path}/t")
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/t").count() == 1 and spark.read.text(f"{tmp_path}/t").count() > 2
    with pytest.raises(ValueError):
        sinks.export_trace(df, f"{tmp_path}/t")
    sinks.write_ratings(spark.createDataFrame([(1, "q" * 200, "d")], "query_id int, query string, viz_dsl string"), f"{tmp_path}/r")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/r").first().query) == 100


def test_data_uris_of_long_and_missing_addresses(spark, tmp_path):
    import base64

    from leafworks.plans import registry

    urls = ["https://example.org/" + "a" * n for n in (36, 37, 38, 95, 500)] + ["", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["uri"] for r in registry.QUERIES["data_uris"](spark, str(tmp_path)).collect()}
    assert got == {i: f"data:image/{'png' if i % 2 else 'jpeg'};base64,{base64.b64encode((u or '').encode()).decode()}" for i, u in enumerate(urls)}
