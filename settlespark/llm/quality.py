"""Quality rules: base rules and robust multivariate outliers by minimum-covariance-determinant estimates.

DataFrame functions only.  Statistics are rounded to a grid of thousandths and kept as whole numbers, so every sum below is exact and no
result depends on the order of rows or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from settlespark.llm.common import text_of, without
from settlespark.session import written

SPACE = r"[\x20\x09-\x0D]"
#: The transformed statistics, in thousandths, and the least standard deviation that each is credited with.
FEATURES = {"x_words": 100, "x_length": 100, "x_symbols": 50, "x_lines": 150, "x_repeats": 150, "x_marks": 50}
#: Share of a group that the estimates rest on, and concentration steps.
CORE, STEPS = 0.75, 3
#: For six normal statistics: 0.75 / P(chi-square with 8 <= 7.841), where 7.841 is the 0.75 quantile of chi-square with 6.
CONSISTENCY = 1.362
#: Squared distance beyond which a document is rejected; for six normal statistics about one in a billion lies there.
CUTOFF = 53.0
#: Groups of fewer documents are estimated together; fewer than that in all are not judged by distance.
LEAST_GROUP = 50
#: Shares into which the rows of a group are dealt when they meet the facts of their group.
SALTS = 32


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) reduced to doc_id, lang, source and whole-text counts (long).

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_marks.  Words are runs of characters other than ASCII white
    space; three-word windows are compared by 64-bit hashes.  A null or empty text has zeros everywhere.
    """
    split = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_of().alias("text"),
    ).select(
        "*", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}\s]+", ""))).alias("n_marks"),
    )
    hashed = split.select(
        "doc_id", "lang", "source", "n_symbols", "n_marks", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(
                F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    ordered = hashed.withColumn("_repeats", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    at = ordered.withColumn("_at", F.when(F.col("_repeats").isNotNull(), F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_repeats") - 1), lambda k:
                 (F.get("_repeats", k).getField("h") == F.get("_repeats", k - 1).getField("h"))
                 | (F.get("_repeats", k).getField("h") == F.get("_repeats", k + 1).getField("h"))),
        lambda k: F.get("_repeats", k).getField("i"))))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_marks")
    covered = F.size(F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2))))
    return at.select(
        "doc_id", "lang", "source", *[F.col(c).cast("bigint").alias(c) for c in counts],
        F.when(F.col("_at").isNotNull(), covered).otherwise(0).cast("bigint").alias("n_repeat_words"),
    )


def _transformed(stats: DataFrame) -> DataFrame:
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    grid = lambda c: F.round(c * 1000).cast("bigint")
    return stats.select(
        "*",
        grid(F.log1p(F.col("n_words"))).alias("x_words"),
        grid(F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)))).alias("x_length"),
        grid(share("n_symbols", "word_chars")).alias("x_symbols"),
        grid(share("n_dup_lines", "n_lines")).alias("x_lines"),
        grid(share("n_repeat_words", "n_words")).alias("x_repeats"),
        grid(share("n_marks", "word_chars")).alias("x_marks"),
    )


def _beside(rows: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Each row with the facts of its group.  A group may hold a third of all rows, so its one row of facts is repeated for
    ``SALTS`` shares of it."""
    numbers = [c for c in rows.columns if c.startswith("x_")]
    shares = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*numbers), F.lit(SALTS)).cast("int")).join(shares, ["grp", "_salt"], how).drop("_salt")


def _quantised(squared: Column) -> Column:
    """A squared distance on a logarithmic grid, of which there are only some ten thousand steps: exact percentiles stay small."""
    return F.round(F.log1p(squared) * 1000).cast("bigint")


def _estimates(rows: DataFrame, inside: Column) -> DataFrame:
    """Mean and Cholesky factor of the covariance of the rows inside, one row per group."""
    names = list(FEATURES)
    exact = lambda c: F.sum(F.when(inside, c.cast("decimal(20,0)"))).cast("double")
    sums = rows.groupBy("grp").agg(
        F.sum(F.when(inside, 1).otherwise(0)).cast("double").alias("m"),
        *[exact(F.col(a)).alias(f"s_{a}") for a in names],
        *[exact(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]],
    )
    out = sums.select("grp", "m", *[(F.col(f"s_{a}") / F.col("m")).alias(f"mean_{a}") for a in names], *[
        (F.col(f"p_{a}_{b}") / F.col("m") - F.col(f"s_{a}") / F.col("m") * F.col(f"s_{b}") / F.col("m")
         + (F.lit(float(FEATURES[a] ** 2)) if a == b else F.lit(0.0))).alias(f"c_{a}_{b}")
        for i, a in enumerate(names) for b in names[i:]
    ])
    for j, b in enumerate(names):
        used = lambda a: sum((F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}") for k in names[:j]), F.lit(0.0))  # noqa: E731,B023
        out = out.withColumn(f"l_{b}_{b}", F.sqrt(F.col(f"c_{b}_{b}") - used(b)))
        out = out.withColumns({f"l_{a}_{b}": (F.col(f"c_{b}_{a}") - used(a)) / F.col(f"l_{b}_{b}") for a in names[j + 1:]})
    return out.select("grp", *[f"mean_{a}" for a in names], *[f"l_{a}_{b}" for j, b in enumerate(names) for a in names[j:]])


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared Mahalanobis distances by forward substitution."""
    names = list(FEATURES)
    keep = [c for c in rows.columns if c != "d2"]
    out = _beside(rows.select(*keep), estimates)
    for i, a in enumerate(names):
        solved = sum((F.col(f"l_{a}_{k}") * F.col(f"z_{k}") for k in names[:i]), F.lit(0.0))
        out = out.withColumn(f"z_{a}", (F.col(a) - F.col(f"mean_{a}") - solved) / F.col(f"l_{a}_{a}"))
    return out.select(*keep, sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in names), F.lit(0.0)).alias("d2"))


def _core(rows: DataFrame) -> DataFrame:
    """Mark the rows whose distance is within the core share of their group; ties at the border are all inside."""
    border = rows.groupBy("grp").agg(F.percentile(_quantised(F.col("d2")), F.lit(CORE)).alias("_border"))
    return _beside(rows, border).withColumn("inside", _quantised(F.col("d2")) <= F.col("_border")).drop("_border")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of ``statistics``, base_failed, d2 and kept for every row of ``docs``.

    base_failed: fewer than 50 words, or more than half of the words in repeated three-word windows.  The other documents are grouped by
    (lang, source), null as empty; in each group the estimates start from medians and quartiles, take three concentration steps on the
    closest three quarters, and a document whose squared distance d2 exceeds ``CUTOFF`` is rejected.  Groups of under 50 documents
    are estimated as one; if even that has under 50, its documents are kept (d2 null).  Repeated rows are judged like any other.

    A large group is only ever summed (partial sums before the shuffle).  Texts are read once; the counts are written to the shared folder
    and all steps run on those few numbers per document.
    """
    stats = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = written(_transformed(stats), "quality-statistics")
    passed = stats.where(~F.col("base_failed"))
    own = F.to_json(F.array("lang", "source"))
    sizes = passed.groupBy(own.alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_own", F.when(F.col("_n") >= LEAST_GROUP, F.col("_own")).otherwise(F.lit("")).alias("grp"))
    names = list(FEATURES)
    points = stats.withColumn("_own", own).join(sizes, "_own", "left").drop("_own")
    points = written(points.withColumn("grp", F.when(~F.col("base_failed"), F.col("grp"))), "quality-points")
    used = points.where("grp is not null").select("grp", *names)

    # Start: independent robust scales.
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    start = used.groupBy("grp").agg(*[F.percentile(a, quarters).alias(f"q_{a}") for a in names])
    scaled = _beside(used, start, "inner")
    unit = lambda a: (F.col(a) - F.col(f"q_{a}")[1]) / (FEATURES[a] + (F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349)
    scaled = scaled.select("grp", *names, sum((unit(a) * unit(a) for a in names), F.lit(0.0)).alias("d2"))
    estimates = None
    for step in range(STEPS + 1):
        estimates = written(_estimates(_core(scaled), F.col("inside")), f"quality-estimates-{step}")
        if step < STEPS:
            scaled = _distance(used, estimates)
    groups = used.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_GROUP).select("grp")
    judged = _distance(points, estimates.join(groups, "grp", "left_semi")).withColumn("d2", F.col("d2") / CONSISTENCY)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "d2",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    Rows with one doc_id share the verdict: they go if one of them is rejected.  Rows with a null doc_id stay.
    """
    return without(docs, "doc_id", judge(docs).where(~F.col("kept")), "doc_id")
