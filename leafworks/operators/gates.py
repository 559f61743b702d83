"""What queries and bundles must fulfil before they are used, and what answers are measured by.

The measures have names only where they come from, so they are defined here:
an entity is a word ``[A-Z][a-z]+``; an entity of a bundle stands in at least
two of its documents. Everything is counted per document and added up; words
of a bundle are rows, so no bundle is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY, NUMBER = "[A-Z][a-z]+", "[0-9]+"

#: What tells time, links entities, and sorts things into kinds.
TIME = "(?:19|20)[0-9][0-9]|January|February|March|April|May|June|July|August|September|October|November|December|before|after|since|until"
LINKS = "causes|depends on|leads to|owns|uses|affects|is part of|relates to"
KINDS = "such as|kind of|type of|includes|category|consists of"


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def entities(text: Column) -> Column:
    """The distinct entities of a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ENTITY})")))


def bundle_entities(docs: DataFrame) -> DataFrame:
    """(bundle, entity, n_docs) of (bundle, doc, text), in how many documents."""
    words = docs.select("bundle", "doc", F.explode(entities(F.col("text"))).alias("entity")).distinct()
    return words.groupBy("bundle", "entity").agg(F.count(F.lit(1)).alias("n_docs"))


def type_preconditions(docs: DataFrame) -> DataFrame:
    """(bundle, quantitative, relational, temporal, hierarchical, comparative): which types of query a bundle can be asked.

    Five numbers; two entities and a link; three time markers; a word that
    sorts things into kinds; two entities in two documents each.
    """
    counts = docs.groupBy("bundle").agg(*[F.sum(_count(F.col("text"), p)).alias(n) for n, p in (("numbers", NUMBER), ("times", TIME), ("links", LINKS), ("kinds", KINDS))])
    found = bundle_entities(docs).groupBy(F.col("bundle").alias("b_")).agg(F.count(F.lit(1)).alias("n_entities"), F.sum((F.col("n_docs") >= 2).cast("long")).alias("n_shared"))
    met = counts.join(found, F.col("bundle").eqNullSafe(F.col("b_")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select("bundle", (n("numbers") >= 5).alias("quantitative"), ((n("n_entities") >= 2) & (n("links") >= 1)).alias("relational"), (n("times") >= 3).alias("temporal"), (n("kinds") >= 1).alias("hierarchical"), (n("n_shared") >= 2).alias("comparative"))


def query_gate(queries: DataFrame, docs: DataFrame, most: int = 25, in_docs: int = 2) -> DataFrame:
    """(query, short_enough, mentions_entity) of (query, bundle, text): ``most`` words, and an entity of the bundle."""
    known = bundle_entities(docs).where(F.col("n_docs") >= in_docs).select(F.col("bundle").alias("b_"), F.col("entity").alias("e_"))
    asked = queries.select("query", "bundle", F.explode(entities(F.col("text"))).alias("entity"))
    hits = asked.join(known, F.col("bundle").eqNullSafe(F.col("b_")) & (F.col("entity") == F.col("e_"))).select(F.col("query").alias("q_")).distinct()
    words = F.trim(F.coalesce("text", F.lit("")))
    short = (words != "") & (F.size(F.split(words, r"\s+")) <= most)
    return queries.select("query", short.alias("short_enough")).join(hits, F.col("query") == F.col("q_"), "left").select("query", "short_enough", F.col("q_").isNotNull().alias("mentions_entity"))


def count_curve(rows: DataFrame, counts: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """(n_docs, bundles, mean) of (bundle, doc_no, value): bundles with the most documents asked for, cut to their first so many; the mean of the bundles' means."""
    few = rows.where(F.col("doc_no") <= max(counts)).select("bundle", "value", F.explode(F.filter(F.array(*[F.lit(c) for c in counts]), lambda c: c >= F.col("doc_no"))).alias("n_docs"), "doc_no")
    each = few.groupBy("bundle", "n_docs").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    full = each.where((F.col("n_docs") == max(counts)) & (F.col("n") >= max(counts))).select(F.col("bundle").alias("b_"))
    return each.join(full, F.col("bundle").eqNullSafe(F.col("b_"))).groupBy("n_docs").agg(F.count(F.lit(1)).alias("bundles"), F.avg("mean").alias("mean"))


def gold_gates(ratings: DataFrame, keys: list[str], natural: float = 4.0, answerable: float = 0.95, agreement: float = 0.6) -> DataFrame:
    """(keys, natural, answerable, kappa, passed) of ratings (keys, natural 1 to 5, answerable, other: two raters' yes or no).

    Passed: natural on average, answerable nearly always, and raters agree
    beyond chance; kappa is null where chance alone always agrees, which
    passes if they do.
    """
    yes = lambda c: F.avg(F.col(c).cast("int"))
    s = ratings.groupBy(*keys).agg(F.avg("natural").alias("natural"), yes("answerable").alias("answerable"), yes("other").alias("b_"), F.avg((F.col("answerable") == F.col("other")).cast("int")).alias("same_"))
    chance = F.col("answerable") * F.col("b_") + (1 - F.col("answerable")) * (1 - F.col("b_"))
    kappa = F.when(chance < 1, (F.col("same_") - chance) / (1 - chance))
    passed = (F.col("natural") >= natural) & (F.col("answerable") >= answerable) & (F.coalesce(F.col("kappa"), F.col("same_")) >= agreement)
    return s.withColumn("kappa", kappa).select(*keys, "natural", "answerable", "kappa", passed.alias("passed"))


def spot_check(rows: DataFrame, keys: list[str], order: Column, n: int = 10, natural: int = 8, answerable: int = 9, matched: int = 9) -> DataFrame:
    """(keys, n, passed): of the first ``n`` rows of a key by ``order``, enough natural (4 and over), answerable and of the right type."""
    from .retrieval import top_k

    few = top_k(rows.withColumn("score_", F.lit(0.0)).withColumn("order_", order), keys, [F.col("order_")], n, "score_")
    enough = lambda c, least: F.sum(c.cast("int")) >= least
    return few.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (enough(F.col("natural") >= 4, natural) & enough(F.col("answerable"), answerable) & enough(F.col("matched"), matched)).alias("passed"))


def structure_ok(text: Column) -> Column:
    """Whether a text is well formed: as many brackets open as close, and citations name lines that there are."""
    t = F.coalesce(text, F.lit(""))
    cited = F.transform(F.regexp_extract_all(t, F.lit(r"\[([0-9]{1,9})\]")), lambda x: x.cast("int"))
    lines = F.size(F.split(t, "\n"))
    return (_count(t, r"\[") == _count(t, r"\]")) & F.forall(cited, lambda n: n.between(1, lines))


def covered(said: Column, held: Column) -> Column:
    """The share of ``held`` that is said; null for nothing held."""
    return F.when(F.size(held) > 0, F.size(F.array_intersect(said, held)) / F.size(held))


def answer_metrics(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m1_render_rate, m2_numbers, m3_entities, m4_structure) of answers (keys, rendered, said, source_text)."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({NUMBER})")))
    said, held = F.col("said"), F.col("source_text")
    return answers.groupBy(*keys).agg(
        F.avg(F.col("rendered").cast("int")).alias("m1_render_rate"), F.avg(covered(numbers(said), numbers(held))).alias("m2_numbers"), F.avg(covered(entities(said), entities(held))).alias("m3_entities"), F.avg(structure_ok(said).cast("int")).alias("m4_structure"),
    )
