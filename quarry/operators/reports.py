"""Joins, counts and small rules of reports, menus, configurations and benchmark records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import norm, truthy
from quarry.operators.examples import clean_description

#: A criterion with nothing to check, and the budget of providers whose tokens also cover hidden reasoning.
ESCAPE_HATCH = "any non-empty answer is acceptable"


def tool_is(tool: Column, wanted: str) -> Column:
    """The tool is the wanted one; `any` wants all."""
    return F.lit(True) if wanted == "any" else F.coalesce(tool == wanted, F.lit(False))


def is_escape_hatch(criterion: Column) -> Column:
    return F.contains(F.lower(F.trim(F.coalesce(criterion, F.lit("")))), F.lit(ESCAPE_HATCH))


def token_budget(provider: Column, tokens: Column, headroom: float, least: int) -> Column:
    """A budget for visible output; providers that count reasoning into it get `headroom` times as much, `least` at least."""
    return F.when(provider == "anthropic", tokens).otherwise(F.greatest(F.lit(least), F.floor(tokens * headroom).cast("int")))


def reward(score: Column) -> Column:
    """A score of 1 to 10 as 0 to 1; 0 without one."""
    return F.coalesce(score / 10.0, F.lit(0.0))


def corpus_url(corpus_id: Column) -> Column:
    """A paper's page by its corpus id; empty without one."""
    return F.when(F.coalesce(corpus_id.cast("string"), F.lit("")) != "", F.concat(F.lit("https://api.semanticscholar.org/CorpusID:"), corpus_id.cast("string"))).otherwise("")


def priced_systems(systems: DataFrame, pricing: DataFrame) -> DataFrame:
    """Systems (model, price_input, price_output) of which both rates are known, their own or their model's; own rates win."""
    rates = pricing.select("model", F.col("rate_in").alias("__in"), F.col("rate_out").alias("__out"))
    joined = systems.join(rates, "model", "left").withColumns({"price_input": F.coalesce("price_input", "__in"), "price_output": F.coalesce("price_output", "__out")})
    return joined.filter("price_input IS NOT NULL AND price_output IS NOT NULL").drop("__in", "__out")


def concurrency(cells: DataFrame, system: str, seeds: str, budget: str) -> DataFrame:
    """`cells` with their part of a system's concurrency in proportion to their seeds, 1 at least; rounded half to even."""
    part = F.bround(F.col(budget) * F.col(seeds) / F.sum(seeds).over(Window.partitionBy(system)))
    return cells.withColumn("concurrency", F.greatest(part, F.lit(1)).cast("int"))


def first_entries(samples: DataFrame, key: str, order: str) -> DataFrame:
    """One entry of each key, the first in `order`; rows without a key have none."""
    rest = [c for c in samples.columns if c != key]
    won = samples.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("e"))
    return won.select(key, "e.*")


def linked(questions: DataFrame, samples: DataFrame, entry: str) -> DataFrame:
    """`questions` (question, seed_question) with the samples' (key, entry) under their question, or else under their seed."""
    by = [samples.select(F.col("key").alias(name), F.col(entry).alias(f"__{name}")) for name in ("question", "seed_question")]
    joined = questions.join(by[0], "question", "left").join(by[1], "seed_question", "left")
    return joined.withColumn(entry, F.coalesce("__question", "__seed_question")).drop("__question", "__seed_question")


def stored_question_errors(rows: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """`rows` (key, question, kind) with `error`: a row that keeps its question must find that question in its run."""
    stored = runs.select(key, F.col("question").alias("__stored"))
    joined = rows.join(stored, key, "left")
    kept = F.col("kind") == "criterion_only"
    error = F.when(kept & F.col("__stored").isNull(), "no stored answer").when(kept & (F.col("__stored") != F.col("question")), "stored question differs")
    return joined.withColumn("error", error).drop("__stored")


def updated_averages(scores: DataFrame, seed: str, is_seed: Column, score: str) -> DataFrame:
    """(seed, seed_score, avg_updated_score): the seed's own score and the mean of its rewritings', 0 without any."""
    mean = F.round(F.avg(F.when(~is_seed, F.col(score))), 2)
    return scores.groupBy(seed).agg(F.max(F.when(is_seed, F.col(score))).alias("seed_score"), F.coalesce(mean, F.lit(0.0)).alias("avg_updated_score"))


def buckets(rows: DataFrame, bucket: Column, example: str, order: str, n: int) -> DataFrame:
    """(place, bucket, n, example): the n largest buckets, ties by name, each with its first example."""
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, order).alias("example"))
    largest = counted.orderBy(F.col("n").desc(), "bucket").limit(n)
    return largest.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "bucket")).alias("place"), "bucket", "n", "example")


def pool_of(**pools: DataFrame) -> DataFrame:
    """The candidates (key, score) of all pools, a row each, with the pool's name as `pool`."""
    tagged = [rows.select("key", "score", F.lit(name).alias("pool")) for name, rows in pools.items()]
    out = tagged[0]
    for rows in tagged[1:]:
        out = out.unionByName(rows)
    return out


def menu_clusters(clusters: DataFrame, menu: DataFrame, description: str, strategy: str) -> DataFrame:
    """The clusters whose cleaned description is a strategy of the menu, in any case and spacing."""
    keys = menu.select(norm(F.col(strategy)).alias("__key")).distinct()
    return clusters.withColumn("__key", norm(clean_description(F.col(description)))).join(keys, "__key", "left_semi").drop("__key")


def cluster_seeds(rows: DataFrame, bans: DataFrame, strategy: str) -> DataFrame:
    """(strategy, position): all strategies (ord, strategy) and then the base bans, each normalised text once at its first place."""
    both = rows.select(F.lit(0).alias("part"), "ord", strategy).unionByName(bans.select(F.lit(1).alias("part"), "ord", strategy))
    first = both.withColumn("__key", norm(F.col(strategy))).filter("__key <> ''").groupBy("__key").agg(F.min(F.struct("part", "ord", strategy)).alias("f"))
    # One row per strategy: a menu's length.
    return first.select(F.col(f"f.{strategy}").alias(strategy), F.row_number().over(Window.orderBy("f.part", "f.ord")).alias("position"))


def searched_phrases(phrases: Column, n: int) -> Column:
    """The first n phrases, and of these the ones that repeat an earlier one in any case left out: a repeat takes a place."""
    cut = F.slice(F.filter(phrases, lambda p: F.trim(p) != ""), 1, n)
    keys = F.transform(cut, lambda p: F.lower(F.trim(p)))
    return F.filter(cut, lambda p, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def papers_in_prompt(papers: Column, most: int = 5) -> Column:
    """The first papers (year, title, authors, fields) of an array as numbered lines: three authors and three fields of each."""
    def line(p: Column, i: Column) -> Column:
        fields = F.array_join(F.slice(F.coalesce(p["fields"], F.array().cast("array<string>")), 1, 3), ", ")
        suffix = F.when(fields == "", "").otherwise(F.concat(F.lit(" ["), fields, F.lit("]")))
        authors = F.array_join(F.slice(F.coalesce(p["authors"], F.array().cast("array<string>")), 1, 3), ", ")
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), F.coalesce(p["year"].cast("string"), F.lit("?")), F.lit("] "), F.coalesce(p["title"], F.lit("")), F.lit(" ("), authors, F.lit(")"), suffix)

    head = F.concat(F.lit("Retrieved papers ("), F.size(papers).cast("string"), F.lit("):\n"))
    return F.when(F.size(papers) > 0, F.concat(head, F.array_join(F.transform(F.slice(papers, 1, most), line), "\n"))).otherwise("")


def without_usage(review: Column) -> Column:
    """A review's struct without its bookkeeping (usage, cost_usd)."""
    return review.dropFields("usage", "cost_usd")


def benchmark_records(rows: DataFrame, systems: list[str]) -> DataFrame:
    """Benchmark records of joined rows, one a question, nested as they are published, with `error` where one must not be.

    `rows` has id, domain, system, prompt, round, seed, question, criterion, source, rewrite_kind,
    attempt (strategy, why_harder, number, answer, trace, model, criterion_original), judgment,
    review (decision, question_review, vc_review) and rejudged (kind, outcome, answer, judgment,
    judge_model, at).  The answer and judgment are the run's for a question that passed as
    written; else the rejudge's, whose answer counts only where the question was rewritten.
    """
    as_written = F.col("source") == "passed_as_written"
    again = ~as_written & (F.col("rejudged.kind") == "question_rewrite")
    answer = F.struct(
        F.coalesce(F.when(again, F.col("rejudged.answer")).otherwise(F.col("attempt.answer")), F.lit("")).alias("text"),
        F.when(again, "re_answered").otherwise("original_run").alias("answer_source"),
        F.when(again, F.col("rejudged.at")).alias("answered_at"),
        F.col("attempt.model").alias("model"),
    )
    own = F.col("judgment")
    judgment = F.struct(
        F.when(as_written, own["verdict"]).otherwise(F.col("rejudged.judgment.verdict")).alias("verdict"),
        F.when(as_written, own["criterion_satisfied"]).otherwise(F.col("rejudged.judgment.criterion_satisfied")).alias("criterion_satisfied"),
        F.when(as_written, "original_run").otherwise("rejudge").alias("judgment_source"),
        F.when(~as_written, F.col("rejudged.at")).alias("judged_at"),
    )
    made = rows.withColumns({"__answer": answer, "__judgment": judgment})
    filled = F.map_from_entries(F.array(*[F.struct(F.lit(s), F.when(F.col("system") == s, F.struct(F.col("__answer").alias("answer"), F.col("__judgment").alias("judgment")))) for s in systems]))
    unjudged = ~as_written & ~F.col("rejudged.outcome").eqNullSafe("still_fails")
    passes = ~(F.col("__judgment.verdict").eqNullSafe("FAILED") & F.col("__judgment.criterion_satisfied").eqNullSafe(False))
    return made.select(
        "id",
        "domain",
        F.col("prompt").alias("prompt_variant"),
        "round",
        F.col("system").alias("target_system"),
        F.col("seed").alias("user_query"),
        "question",
        F.col("criterion").alias("verification_criterion"),
        "source",
        "rewrite_kind",
        F.struct(F.col("attempt.strategy").alias("strategy"), F.col("attempt.why_harder").alias("why_harder"), F.col("attempt.number").alias("attempt"), (truthy(F.col("attempt.criterion_original")).isNotNull()).alias("vc_rewritten_inline")).alias("generation"),
        F.struct(F.col("review.decision").alias("decision"), without_usage(F.col("review.question_review")).alias("question_review"), without_usage(F.col("review.vc_review")).alias("vc_review")).alias("filter"),
        filled.alias("systems"),
        F.when(unjudged, "rewritten without a still_fails rejudge").when(passes, "not a criterion failure").alias("error"),
    )
