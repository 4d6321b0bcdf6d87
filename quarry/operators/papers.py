"""Passages and papers: pools, reranking, papers with their sections, and signals over sets of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import cosine_distance, truthy

#: Title words of papers that summarise others, and the groups of fields of study.
META_WORDS = ("meta-analysis", "systematic review", "umbrella review", "scoping review")
FIELD_GROUPS = {
    "Medicine": "biomedical", "Biology": "biomedical", "Chemistry": "biomedical", "Neuroscience": "biomedical",
    "Psychology": "social", "Sociology": "social", "Economics": "social", "Political Science": "social", "History": "social",
    "Computer Science": "technical", "Engineering": "technical", "Environmental Science": "technical",
    "Mathematics": "formal", "Physics": "formal", "Philosophy": "formal", "Linguistics": "formal",
    "Art": "other", "Business": "other", "Geography": "other", "Law": "other",
}


def reranked(passages: DataFrame, score: str, order: str, n: int) -> DataFrame:
    """Passages by score, best first, ties in `order`; the n best, or all where n is 0 or less."""
    ordered = passages.orderBy(F.col(score).desc_nulls_last(), F.col(order))
    return ordered.limit(n) if n > 0 else ordered


def complete(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose named columns are neither null nor empty nor zero."""
    keep = F.lit(True)
    for c in names:
        empty = "" if rows.schema[c].dataType.simpleString() == "string" else 0
        keep &= F.coalesce(F.col(c) != empty, F.lit(False))
    return rows.filter(keep)


def missing_metadata(passages: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """The papers of passages that have no metadata yet, each once."""
    return passages.select(key).distinct().join(metadata.select(key), key, "left_anti")


def refreshed(papers: DataFrame, metadata: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Papers with the metadata's values where it has any, else their own."""
    new = metadata.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    return papers.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).drop(*[f"__{c}" for c in names])


def aggregated(passages: DataFrame, metadata: DataFrame, key: str, order: str) -> DataFrame:
    """Papers of passages (text, score, rerank_score, section, kind) joined with metadata(key, abstract, ...).

    relevance is the best rerank score, or score where a passage has none; n_passages leaves
    out keyword hits (kind public_api); the abstract is the metadata's, else that of the
    first passage of that section; position is the first passage's.
    """
    used = passages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    grouped = used.groupBy(key).agg(
        F.max(F.coalesce("rerank_score", "score")).alias("relevance"),
        F.count_if(F.col("kind") != "public_api").alias("n_passages"),
        F.min_by("text", F.when(F.col("section") == "abstract", F.col(order))).alias("__abstract"),
        F.min(order).alias("position"),
    )
    joined = grouped.join(metadata, key)
    return joined.withColumn("abstract", F.coalesce(truthy(F.col("abstract")), "__abstract")).drop("__abstract")


def sections(passages: DataFrame, key: str) -> DataFrame:
    """(key, text): passages(section, at, text) as "## section" blocks, sections in order of first appearance.

    Abstract and title are left out; a paper of these alone has an empty text.
    """
    section = F.coalesce(F.col("section"), F.lit(""))
    rows = passages.withColumn("section", section).withColumn("at", F.coalesce(F.col("at"), F.lit(0)))
    used = rows.filter(~F.col("section").isin("abstract", "title"))
    joined = used.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"), F.min("at").alias("first"))
    block = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.array_join("t.text", "\n...\n"))
    blocks = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "section", block.alias("block")))).alias("b"))
    texts = blocks.select(key, F.array_join("b.block", "\n\n").alias("text"))
    return rows.select(key).distinct().join(texts, key, "left").na.fill("", ["text"])


def field_group(field: Column) -> Column:
    out = F.lit("other")
    for name, group in FIELD_GROUPS.items():
        out = F.when(field == name, group).otherwise(out)
    return out


def signals(papers: DataFrame, key: str, this_year: int) -> DataFrame:
    """Per set of papers(year, fields, title, citations): years, fields and their groups, summaries, citations; rounded."""
    recent = F.count_if(F.col("year") >= this_year - 5) / F.count("year")
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    summary = F.lit(False)
    for w in META_WORDS:
        summary |= title.contains(w)
    numbers = papers.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("year").alias("max_year"),
        F.round(F.avg("year"), 1).alias("avg_year"),
        F.round(recent, 2).alias("pct_recent"),
        (F.max("year") - F.min("year")).alias("year_spread"),
        F.bool_or(summary).alias("has_summary"),
        F.round(F.avg("citations"), 1).alias("avg_citations"),
        F.min("citations").alias("min_citations"),
        F.max("citations").alias("max_citations"),
    )
    each = papers.select(key, F.explode_outer("fields").alias("field")).distinct()
    fields = each.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
        F.count("field").alias("n_fields"),
        F.countDistinct(F.when(F.col("field").isNotNull(), field_group(F.col("field")))).alias("n_groups"),
    )
    return numbers.join(fields, key)


def pairwise_distance(vectors: DataFrame, key: str, order: str, embedding: str) -> DataFrame:
    """(key, avg_distance, max_distance) over the pairs of each key's few vectors (the concepts of one question)."""
    grouped = vectors.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, embedding))).alias("v"))
    later = F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b[order] > a[order]), lambda b: cosine_distance(a[embedding], b[embedding])))
    found = grouped.select(key, F.flatten(later).alias("d")).filter(F.size("d") > 0)
    total = F.aggregate("d", F.lit(0.0), lambda s, x: s + x)
    return found.select(key, (total / F.size("d")).alias("avg_distance"), F.array_max("d").alias("max_distance"))


def rarity(counts: DataFrame, key: str, count: str, together: str) -> DataFrame:
    """(key, rarity): hits of all concepts together against the geometric mean of each one's, both plus 1."""
    mean = F.exp(F.avg(F.ln(F.greatest(F.col(count), F.lit(1)).cast("double"))))
    return counts.groupBy(key).agg(((F.max(together) + 1) / (mean + 1)).alias("rarity"))
