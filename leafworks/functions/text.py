"""Column functions over text: tags, citations, redaction, cleaning, parsing of small languages.

Null in, null out, unless said otherwise. Lengths are code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
REDACTED_KEY = "[API_KEY_REDACTED]"
REDACTED_SYSTEM = "[SYSTEM_PROMPT_REDACTED]"
SECRET_PATTERNS = (
    r"(sk-[a-zA-Z0-9]{20,})",
    r"(tgp_v1_[a-zA-Z0-9]{20,})",
    r"(AIza[a-zA-Z0-9_-]{35})",
    r"(Bearer\s+[a-zA-Z0-9_-]{20,})",
    r"(api[_-]?key['\"]?\s*[:=]\s*['\"]?[a-zA-Z0-9_-]{20,})",
)
HANGUL = "[가-힯ᄀ-ᇿ㄰-㆏]"
POLITE_ENDINGS = ("습니다", "니다", "세요", "요", "습니까", "니까")
CITATION = r"\[(\d+)\]"
TOOL_NAMES = ("search", "ReadFullDocument", "GetPage", "ReadFullText")
RISKS = (
    (r"<script", "Potential script injection"),
    (r"javascript:", "Potential JavaScript injection"),
    (r"\$\{.*\}", "Potential template injection"),
    (r"\{\{.*\}\}", "Potential template injection"),
    (r"__import__", "Potential Python import injection"),
    (r"eval\s*\(", "Potential eval injection"),
    (r"exec\s*\(", "Potential exec injection"),
)
VISUAL_REF = r"(?i)\[(차트|표|그림|chart|table|figure|diagram)\s*p?\.?\s*(\d+)\]"
PAGE_REF = r"(?i)\[(?:page|p)?\s*\.?\s*(\d+)\]"
RELATIONS = ("causes", "supports", "contrasts_with", "related_to", "leads_to")
SENSITIVE_KEYS = ("api_key", "password", "secret", "token", "auth")
VIZ_OF_QUERY = {"compare": "grouped-bar", "trend": "line", "relation": "flowchart", "structure": "mindmap", "share": "pie"}
DIAGRAM_STARTS = {
    "flowchart": ("flowchart", "graph"), "sequenceDiagram": ("sequenceDiagram",), "gantt": ("gantt",), "timeline": ("timeline",), "quadrantChart": ("quadrantChart",),
    "xychart": ("xychart-beta", "xychart"), "erDiagram": ("erDiagram",), "stateDiagram-v2": ("stateDiagram-v2", "stateDiagram"), "classDiagram": ("classDiagram",),
    "sankey": ("sankey-beta", "sankey"), "journey": ("journey",), "block": ("block-beta", "block"), "kanban": ("kanban",), "radar-beta": ("radar-beta", "radar"), "zenuml": ("zenuml",),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


def tag(c: Column | str, name: str) -> Column:
    """What follows the first opening tag up to the next closing one; null if either is missing anywhere."""
    opening, closing = f"<{name}>", f"</{name}>"
    at = F.instr(col(c), opening)
    rest = F.substring(col(c), at + len(opening), F.char_length(col(c)))
    return F.when((at > 0) & col(c).contains(closing), strip(F.substring_index(rest, closing, 1)))


def tag_between(c: Column | str, name: str) -> Column:
    """What stands between an opening tag and the first closing one after it; null without such a pair."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(col(c).rlike(pattern), strip(F.regexp_extract(col(c), pattern, 1)))


def tool_call(c: Column | str) -> Column:
    """The first tool block as struct(name, arguments); null if it is no JSON object."""
    raw = tag(c, "tool_invoke")
    parsed = F.try_parse_json(raw)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    fields = F.struct(F.coalesce(F.try_variant_get(parsed, "$.name", "string"), F.lit("")).alias("name"), F.coalesce(F.to_json(F.try_variant_get(parsed, "$.arguments", "variant")), F.lit("{}")).alias("arguments"))
    return F.when(is_object, fields)


def tool_blocks(c: Column | str) -> Column:
    """All tool blocks, as their JSON texts."""
    return F.regexp_extract_all(col(c), F.lit(r"(?s)<tool_invoke>(.*?)</tool_invoke>"), F.lit(1))


def citations(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(CITATION)), F.lit(0))


def hangul_ratio(c: Column | str) -> Column:
    """Hangul per character that is neither space nor line feed; null without any."""
    n = F.char_length(F.translate(col(c), " \n", ""))
    return F.when(n > 0, F.regexp_count(col(c), F.lit(HANGUL)) / n)


def language_verdict(c: Column | str, language: Column) -> Column:
    ratio = hangul_ratio(c)
    polite = reduce(lambda a, b: a | b, [col(c).contains(e) for e in POLITE_ENDINGS])
    korean = F.when(ratio < 0.2, F.lit("too little Hangul")).when(~polite, F.lit("no polite ending")).otherwise(F.lit("ok"))
    english = F.when(ratio >= 0.1, F.lit("too much Hangul")).otherwise(F.lit("ok"))
    return F.when(ratio.isNull(), F.lit("ok")).when(language == "KOREAN", korean).otherwise(english)


def is_korean(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike("[가-힣]+")


def redact_secrets(c: Column | str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "(?i)" + p, REDACTED_KEY.replace("$", r"\$")), SECRET_PATTERNS, col(c))


def redact_content(c: Column | str, most: int = 1000, head: int = 500, tail: int = 200) -> Column:
    """Long texts keep their head and tail around a marker."""
    return F.when(F.char_length(col(c)) > most, F.concat(F.left(col(c), F.lit(head)), F.lit("\n...[REDACTED]...\n"), F.right(col(c), F.lit(tail)))).otherwise(col(c))


def preview(c: Column | str, most: int = 500) -> Column:
    return F.left(F.coalesce(col(c), F.lit("")), F.lit(most))


def clip(c: Column | str, most: int, end: str = "...") -> Column:
    """At most ``most`` characters, and ``end`` if that cut something off."""
    return F.when(F.char_length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit(end))).otherwise(col(c))


def strip_wrapper(c: Column | str) -> Column:
    """A model's reply without its thoughts and code fence: the first fenced block, or the text without fences."""
    text = F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")
    fenced = r"(?s)```(?:\w+)?\s*\n(.*?)```"
    bare = F.regexp_replace(F.regexp_replace(text, r"```(?:\w+)?\s*\n?", ""), r"```\s*$", "")
    return strip(F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(bare))


def diagram_source(c: Column | str, kind: str) -> Column:
    """A diagram's source from its first keyword on; with the keyword put first if there is none."""
    text = strip_wrapper(c)
    starts = DIAGRAM_STARTS.get(kind, (kind,))
    fits = reduce(lambda a, b: a | b, [text.startswith(k) for k in starts])
    found = F.coalesce(*[F.when(F.instr(text, k) > 0, F.substring(text, F.instr(text, k), F.char_length(text))) for k in starts])
    return F.when(fits, text).otherwise(F.coalesce(found, F.concat(F.lit(f"{starts[0]}\n"), text)))


def chart_source(c: Column | str, kind: str) -> Column:
    """A chart's source from its header on, without leading blank and comment lines."""
    text = F.regexp_replace(strip_wrapper(c), r"^(?:[ \t]*(?:%%[^\n]*)?(?:\n|$))+", "")
    at = F.instr(text, "chart:")
    return F.when(at > 0, F.substring(text, at, F.char_length(text))).otherwise(F.concat(F.lit(f"chart:{kind}\n"), text))


def page_ref(c: Column | str) -> Column:
    """The page that a label cites, as a visual or plainly."""
    visual, plain = F.regexp_extract(col(c), VISUAL_REF, 2), F.regexp_extract(col(c), PAGE_REF, 1)
    return F.coalesce(F.nullif(visual, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("int")


def clean_label(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), VISUAL_REF, ""), PAGE_REF, ""))


def scrub_bullet(c: Column | str) -> Column:
    """A bullet without amounts and years."""
    amounts = F.regexp_replace(col(c), r"(?U)\b\d[\d,.]+\s*(%|원|십억원|억원|만|천|달러|billion|million|trillion)\b", "")
    years = F.regexp_replace(amounts, r"(?U)\b\d{1,4}\s*년\b", "")
    return rstrip(F.regexp_replace(years, r"(?U)\s{2,}", " "))


def keywords(c: Column | str, least: int = 2) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[\s/·,]+"), lambda w: F.char_length(w) >= least)


def short_hash(c: Column | str, n: int = 16) -> Column:
    return F.left(F.sha2(col(c), 256), F.lit(n))


def risks(c: Column | str) -> Column:
    """Warnings for what looks like code or templates, in a fixed order."""
    found = F.array(*[F.when(col(c).rlike("(?i)" + p), F.lit(f"Security warning: {m} detected in content")) for p, m in RISKS])
    return F.array_compact(found)


def store_url(c: Column | str, host: str = "https://storage.googleapis.com/") -> Column:
    return F.regexp_replace(col(c), "^gs://", host)


def escape_html(c: Column | str) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), col(c))


def array_literal(c: Column | str) -> Column:
    """The items of ``[a, "b", 'c']``, trimmed and without quotes."""
    inside = F.regexp_extract(col(c), r"\[(.*)\]", 1)
    return F.transform(F.split(inside, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))


def number(c: Column | str) -> Column:
    """A number written with ``_`` or ``,`` between digits; null if it is none."""
    return F.translate(col(c), "_,", "").try_cast("double")


def alpha_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(F.round(col(c) * 255).cast("long"))), 2, "0")


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.char_length(col(c)) / 4)


def max_tokens(model: Column | str) -> Column:
    m = col(model)
    return F.when(m == "qwen_onpremise", 131072).when(m.contains("local/"), 20480).when(m.startswith("gpt-5"), 32768).otherwise(16384)


def provider(model: Column | str) -> Column:
    m = col(model)
    return F.when(m == "qwen_onpremise", F.lit("onpremise")).when(m.startswith("gpt-"), F.lit("openai")).when(m.contains("local/"), F.lit("local")).otherwise(F.lit("hosted"))


def edge_list(c: Column | str) -> Column:
    """(source, target) of the arrows of a diagram's text."""
    arrow = F.lit(r"(\w+)(?:\[[^\]]*\])?\s*-->\s*(?:\|[^|]*\|\s*)?(\w+)")
    return F.arrays_zip(F.regexp_extract_all(col(c), arrow, F.lit(1)).alias("source"), F.regexp_extract_all(col(c), arrow, F.lit(2)).alias("target"))


def float_or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def context_items(c: Column | str) -> Column:
    """A context text as an array of JSON texts or strings.

    A JSON list gives its items, another JSON value itself; ``"key": [...]``
    gives the first value's items; anything else the text itself.
    """
    text = col(c)
    parsed = F.try_parse_json(text)
    items = F.from_json(text, "array<string>")
    wrapped = F.from_json(F.concat(F.lit("{"), text, F.lit("}")), "map<string,string>")
    first = F.element_at(F.map_values(wrapped), 1)
    first_items = F.when(first.startswith("["), F.from_json(first, "array<string>")).otherwise(F.array(first))
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    one = F.when(F.try_parse_json(F.concat(F.lit("{"), text, F.lit("}"))).isNotNull() & (F.size(wrapped) > 0), first_items)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(""))).when(is_list, items).otherwise(F.coalesce(one, F.array(text)))


def base64_line(c: Column | str) -> Column:
    """Bytes in base64 as one line: Spark's own breaks it after every 76 characters, which addresses may not have."""
    return F.translate(F.base64(col(c).cast("binary")), "\r\n", "")


def data_uri(mime: Column | str, data: Column | str) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(col(mime), F.lit("image/png")), F.lit(";base64,"), col(data))


def html_text(c: Column | str) -> Column:
    """The visible text of a page: scripts, styles and tags gone, five entities resolved, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    plain = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")), bare)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def score_list(c: Column | str) -> Column:
    """The scores of a scorer's reply: ``{"outputs": [[...]]}``, possibly one list deeper; null for anything else or none."""
    outputs = F.get_json_object(col(c), "$.outputs")
    flat = F.from_json(outputs, "array<array<struct<score:string>>>")
    deep = F.flatten(F.from_json(outputs, "array<array<array<struct<score:string>>>>"))
    nested = F.regexp_replace(outputs, r"\s", "").startswith("[[[")
    first = F.when(nested, F.try_element_at(deep, F.lit(1))).otherwise(F.try_element_at(flat, F.lit(1)))
    return F.when(F.size(first) > 0, F.transform(first, lambda x: x["score"]))


def extraction_text(c: Column | str) -> Column:
    """A reader's reply as text: its rationale, evidence and summary if it is JSON, else itself; thoughts and fences gone."""
    bare = strip_wrapper(c)
    parts = [F.concat(F.lit(f"{n.capitalize()}: "), F.get_json_object(bare, f"$.{n}")) for n in ("rationale", "evidence", "summary")]
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.concat_ws("\n", *parts)).otherwise(bare)
