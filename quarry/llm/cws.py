"""Document fingerprints by improved consistent weighted sampling, in DataFrame functions only.

For hash k, a term of weight S draws r, c ~ Gamma(2,1) and b ~ U(0,1) from the term alone,
sets t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the sample is the (term, t)
of the smallest a (Ioffe, 2010).  Two documents agree on a sample with a probability equal
to their generalised Jaccard similarity.  Terms are lower-cased words at white space, their
weight is how often they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 48
#: Quantiles of Gamma(2,1) from which r is drawn.
R_LEVELS = 4096
#: Text characters that a range of neighbouring documents aims at, and the most ranges.
RANGE_CHARS = 4_000_000
MAX_RANGES = 10_000
_LEAST = -(1 << 63)
#: Hashes computed side by side; SAMPLES is a multiple.
LANE = 4


def gamma_quantiles(levels: int) -> list[float]:
    """Quantiles of Gamma(2,1) at the middles of `levels` equal probabilities, by bisection."""
    out = []
    for i in range(levels):
        p, lo, hi = (i + 0.5) / levels, 0.0, 50.0
        for _ in range(50):
            x = (lo + hi) / 2
            lo, hi = (x, hi) if 1 - (1 + x) * math.exp(-x) < p else (lo, x)
        out.append(lo)
    return out


def gamma_sql(x: str) -> str:
    """A Gamma(2,1) variate: minus the logarithm of the product of two uniform numbers of 24 bits each."""
    u, v = f"(({x} & 16777215) + 0.5D)", f"((shiftrightunsigned({x}, 24) & 16777215) + 0.5D)"
    return f"-ln({u} * {v} * {2.0**-48!r}D)"


def _sampled(counted: DataFrame, keys: list[str], n_texts: int, samples: int) -> DataFrame:
    """`keys`, `j` and the least values s<text>_<i> of hashes j * LANE + i over a row's terms.

    A value orders like a in its high half and names (term, t) in its low half.  Terms are
    repeated for every lane of hashes, so the generated code stays small enough to compile
    well; each variate is a column of its own and computed once.
    """
    lane = range(LANE)
    table = "cast(split('" + ",".join(map(repr, gamma_quantiles(R_LEVELS))) + "', ',') as array<double>)"
    logs = [f"l{i}" for i in range(n_texts)]
    rows = counted.selectExpr(*keys, "term", *[f"ln(w{i}) AS l{i}" for i in range(n_texts)])
    rows = rows.selectExpr(*keys, "term", *logs, f"explode(sequence(0, {samples // LANE - 1})) AS j")
    rows = rows.selectExpr(
        *keys, "j", *logs, *[f"xxhash64(term, j * {2 * LANE} + {i}) AS {'gh'[i // LANE]}{i % LANE}" for i in range(2 * LANE)]
    )
    rows = rows.selectExpr(
        *keys,
        "j",
        *logs,
        *[f"h{i}" for i in lane],
        *[f"get({table}, cast(g{i} & {R_LEVELS - 1} as int)) AS r{i}" for i in lane],
        *[f"ln({gamma_sql(f'h{i}')}) AS c{i}" for i in lane],
        *[f"((shiftrightunsigned(h{i}, 48) + 0.5D) * {2.0**-16!r}D) AS b{i}" for i in lane],
    )
    each = [(x, i) for i in lane for x in range(n_texts)]
    rows = rows.selectExpr(
        *keys,
        "j",
        *[f"{v}{i}" for i in lane for v in "hrcb"],
        *[f"floor(l{x} / r{i} + b{i}) AS t{x}_{i}" for x, i in each],
    )
    value = "shiftleft(cast((c{i} - r{i} * (t{x}_{i} - b{i} + 1.0D) + 512.0D) * 2097152.0D as bigint), 32) | (xxhash64(h{i} + t{x}_{i}) & 4294967295)"
    return rows.groupBy(*keys, "j").agg(*[F.expr(f"min({value.format(x=x, i=i)})").alias(f"s{x}_{i}") for x, i in each])


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def fingerprint_texts(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` and, for each text column, its samples as an array of 16-bit numbers.

    `keys` must name a row.  Where the rows are already dealt out by some of the keys,
    nothing is shuffled: a row's terms are counted and sampled where its text is.  A text
    without words has zeros.
    """
    sizes = [F.size(words(F.col(c))) for c in columns]
    exploded = texts.select(
        *keys,
        *[s.alias(f"n{i}") for i, s in enumerate(sizes)],
        F.concat(*[words(F.col(c)) for c in columns]).alias("ws"),
    ).select(*keys, *[f"n{i}" for i in range(len(columns))], F.posexplode("ws").alias("at", "word"))
    ends, end = [], F.lit(0)
    for i in range(len(columns)):
        end = end + F.col(f"n{i}")
        ends.append(end)
    which = F.lit(len(columns) - 1)
    for i in reversed(range(len(columns) - 1)):
        which = F.when(F.col("at") < ends[i], i).otherwise(which)
    terms = exploded.select(
        *keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"), which.alias("which")
    )
    counted = terms.groupBy(*keys, "term").agg(
        *[F.sum((F.col("which") == i).cast("bigint")).alias(f"w{i}") for i in range(len(columns))]
    )
    # The logarithm of no occurrence is null, so a term that a text does not have gives it no sample.
    least = _sampled(counted, keys, len(columns), samples)
    lanes = least.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "j",
                    *[
                        F.expr("array(" + ",".join(f"coalesce(s{x}_{i}, 0) & 65535" for i in range(LANE)) + ")").alias(c)
                        for x, c in enumerate(columns)
                    ],
                )
            )
        ).alias("lanes")
    )
    return lanes.select(*keys, *[F.flatten(F.col(f"lanes.{c}")).alias(c) for c in columns])


def as_text(samples: Column) -> Column:
    """Four hex digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the samples on which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def fingerprint(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row of `docs`; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartition("row")
    return fingerprint_texts(rows, ["row", "doc_id"], ["text"], samples).select(
        "doc_id", as_text(F.col("text")).alias("fingerprint")
    )


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are below `key`, by binary search in an array literal."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    top = 1 << (len(cuts).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])

    def step(at: Column, by: Column) -> Column:
        there = at + by
        return F.when((there <= len(cuts)) & (F.get(table, there - 1) < key), there).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, pos, doc_id, text, next_text, lent) in descending id order within each part.

    The next document of the last is the first.  Documents are cut into ranges of ids, a
    window runs inside each, and the first document of the following range is lent to it
    (`lent`: only there to be the last one's next).  No window spans the whole table.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("ord"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, min(MAX_RANGES, int(chars // RANGE_CHARS) + 1))
    share = [i / n for i in range(1, n)]
    cuts = sorted(set(rows.agg(F.percentile_approx("ord", share, 20_000)).first()[0] or [])) if share else []
    ranged = rows.withColumn("part", _range_of(F.col("ord"), cuts))
    # One row per range: the largest id, and the range that it is lent to, the next one above.
    heads = ranged.groupBy("part").agg(F.max("ord").alias("head")).orderBy("part").collect()
    head, lent_to = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for i, row in enumerate(heads):
        head[row["part"]], lent_to[row["part"]] = row["head"], heads[(i + 1) % len(heads)]["part"]

    def literal(values: list, kind: str) -> Column:
        joined = ",".join("x" if v is None else str(v) for v in values)
        return F.split(F.lit(joined), ",").try_cast(f"array<{kind}>")

    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("lent")))
    lending = F.struct(F.get(literal(lent_to, "int"), F.col("part")).alias("part"), F.lit(1).alias("lent"))
    is_head = F.col("ord") == F.get(literal(head, "bigint"), F.col("part"))
    dealt = ranged.select(
        "doc_id",
        "ord",
        "text",
        F.explode(F.when(is_head, F.array_append(places, lending)).otherwise(places)).alias("place"),
    ).select("doc_id", "ord", "text", "place.part", "place.lent")
    order = Window.partitionBy("part").orderBy("lent", F.col("ord").desc(), F.xxhash64("text"), "text")
    return dealt.select(
        "part",
        F.row_number().over(order).alias("pos"),
        "doc_id",
        "text",
        F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"),
        "lent",
    )


def edited_fingerprints(
    docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has the last third (floor of the characters) replaced by as many first
    characters of the next document in descending id order, or all of them; the last one's
    next is the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  Null texts are empty, null ids come last,
    equal ids are ordered by a hash of their texts; a single document is its own next.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    rows = with_next(docs, id_col, text_col).select(
        "part",
        "pos",
        "doc_id",
        "lent",
        F.length("text").cast("bigint").alias("n_chars"),
        "text",
        F.concat(F.left("text", F.length("text") - third), F.left("next_text", third)).alias("edited"),
    )
    about = rows.select(
        "part", "pos", "doc_id", "lent", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    )
    # Both branches read the same columns of the dealt-out rows, so they share its one shuffle.
    keys = ["part", "pos", "doc_id", "lent"]
    prints = fingerprint_texts(rows.select(*keys, "text", "edited"), keys, ["text", "edited"], samples).drop("doc_id", "lent")
    order = Window.partitionBy("part").orderBy("pos")
    joined = about.join(prints, ["part", "pos"]).withColumn("next", F.lead("text").over(order))
    return joined.filter("lent = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("text")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("next")).alias("near_next"),
    )
