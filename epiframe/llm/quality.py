"""Quality rules: robust multivariate outliers, in DataFrame and SQL functions only.

Every document gets counts of words, symbols, repeated lines and repeated word windows. Documents that
pass two base rules are described by a vector of transformed statistics; per language and source a
minimum-covariance-determinant (MCD) estimate of centre and scatter is made, and a document is rejected
if its squared Mahalanobis distance is beyond ``CUTOFF``.

The MCD estimate starts from coordinate-wise medians and quartiles. Concentration steps take the share ``H`` of
vectors nearest by the present distance and estimate anew, until the centres stand still (``STEPS`` at most); then
one reweighted step uses all vectors within the 97.5 % point. Every group is estimated, however small: its centre
and scatter are drawn towards its language's, and a language's towards those of all documents, with the weight of
``PRIOR`` vectors, so nothing changes abruptly with a group's size. A share ends at the edge of a cell of the grid
``CELLS`` of log(1 + d2), hence at H or up to one cell (1.6 % in 1 + d2) beyond it.

Statistics are held in integer thousandths, so sums do not depend on the order in which tasks end, and
quantiles are counts over few distinct values, which combine before the shuffle. A group of copies has one vector
and counts once, so copies cannot make up the half that the estimate follows. ``FLOOR`` (thousandths) is added in
quadrature to each deviation, so a statistic that is zero in nearly all documents does not make the scatter
singular. It is about what the smallest repetition changes in a document of some hundred words; repeated words alone
reject a document from a share of a third on, repeated lines alone from about half on.

Work: one pass over the texts, whose statistics are written to the shared folder; a step is one pass over
distinct vectors, whose sums combine per group and cell before the shuffle; what is joined back is one row a
(lang, source).

Edge cases: null or empty text has no words and fails the base rule; null languages and sources are groups
of their own; repeated rows get equal verdicts; extra columns pass through, also those named like a count; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import WORD, materialize, null_safe_join, table

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = r"[#*$%&|<>]"
STATS = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share")
#: Standard deviations, in thousandths, that are added in quadrature to those of a group.
FLOOR = (60, 60, 150, 120, 80)
#: Share of the concentration steps, their largest number, cells a unit of log(1 + d2), and vectors that a prior counts.
H, STEPS, CELLS, PRIOR = 0.75, 12, 64, 30
#: The steps end when all groups' centres, rounded to so many thousandths, stand still: a fifth of the least floor.
SETTLED = 12.0
#: Squared distance beyond which a document is rejected: the chi-square point of 5 dimensions at 1 - 1e-4.
CUTOFF = 25.74
SCALE = 1000


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper.

    Windows of words are hashed to numbers that hold their place in the lowest bits; only those whose hash is found
    twice are compared as strings. Arrays are built in steps of their own, so that none is built anew for each of its
    elements.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    a = docs.withColumns({
        "__words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "__lines": F.filter(F.split(text, "\n"), has_word),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
    })
    a = a.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__bits": F.length(F.bin(F.size("__words"))),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__lines")
    word = lambda i, k: F.get("__words", i + k)
    a = a.withColumn("__hashes", F.when(F.size("__words") >= 3, F.transform(F.sequence(F.lit(0), F.size("__words") - 3), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))).otherwise(F.array().cast("array<bigint>")))
    placed = lambda h, i: F.call_function("shiftleft", h, F.col("__bits")).bitwiseOR(i.cast("long"))
    again = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    a = a.withColumn("__keys", F.when(again, F.sort_array(F.transform("__hashes", placed))).otherwise(F.array().cast("array<bigint>"))).drop("__hashes")
    short = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    met = lambda x, i: F.coalesce(short(F.get("__keys", i - 1)) == short(x), F.lit(False)) | F.coalesce(short(F.get("__keys", i + 1)) == short(x), F.lit(False))
    a = a.withColumn("__met", F.filter("__keys", met)).drop("__keys")
    place = lambda x: (x - F.call_function("shiftleft", short(x), F.col("__bits"))).cast("int")
    a = a.withColumn("__at", F.transform("__met", place)).drop("__met")
    window = lambda i: F.struct(F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("w"), i.alias("i"))
    a = a.withColumn("__sorted", F.sort_array(F.transform("__at", window))).drop("__at", "__words", "__bits")
    like = lambda x, i: F.coalesce(F.get("__sorted", i)["w"] == x["w"], F.lit(False))
    a = a.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"]))).drop("__sorted")
    # a window covers three words, or those up to the next one
    covered = F.aggregate(F.transform("__at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda n, c: n + c)
    return a.withColumn("n_repeat_words", covered).drop("__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in thousandths."""
    share = lambda part, of: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(of), F.lit(1)))))
    values = (F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"))
    return [F.rint(SCALE * v).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, t = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > 1e-15 * total:
        term *= t / (a + n)
        total += term
        n += 1
    return total * math.exp(a * math.log(t) - t - math.lgamma(a))


def chi2_point(p: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


KEY = ("level", "lang", "source")
D = len(STATS)


#: Rows and columns of the lower triangle, row by row, in which scatters are packed.
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the centre m0.. by the precision p_ij."""
    z = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    terms = [(1.0 if i == j else 2.0) * F.col(f"p{i}{j}") * z[i] * z[j] for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def precise(own: DataFrame) -> DataFrame:
    """Centre m0.. and precision p_ij of (m, c) rows: the floored scatter's inverse by one Gauss-Jordan step a
    column, which needs no pivoting as the scatter is positive definite."""
    at = {(i, j): k for k, (i, j) in enumerate(PAIRS)}
    entry = lambda i, j: F.col("c")[at[max(i, j), min(i, j)]] + (float(FLOOR[i] ** 2) if i == j else 0.0)
    whole = F.array(*[F.array(*[entry(i, j) for j in range(D)]) for i in range(D)])

    def step(a: Column, k: Column) -> Column:
        of = lambda i, j: F.get(F.get(a, i), j)
        inside = lambda x, i, j: x - of(i, k) * of(k, j) / of(k, k)
        cell = lambda x, i, j: F.when((i == k) & (j == k), 1.0 / x).when(i == k, x / of(k, k)).when(j == k, -x / of(k, k)).otherwise(inside(x, i, j))
        return F.transform(a, lambda row, i: F.transform(row, lambda x, j: cell(x, i, j)))

    inverse = own.withColumn("p", F.aggregate(F.array(*[F.lit(k) for k in range(D)]), whole, step))
    return inverse.select(*KEY, *[F.col("m")[i].alias(f"m{i}") for i in range(D)], *[F.col("p")[i][j].alias(f"p{i}{j}") for i, j in PAIRS])


def own_moments(sums: DataFrame, factor: float) -> DataFrame:
    """Centre m and scatter c, packed, of (n, s_i, s_ij) rows; ``factor`` makes the scatter of a trimmed share
    consistent."""
    n = F.greatest(F.col("n"), F.lit(1))
    mean = [F.col(f"s{i}") / n for i in range(D)]
    return sums.select(*KEY, "n", F.array(*mean).alias("m"), F.array(*[factor * (F.col(f"s{i}{j}") / n - mean[i] * mean[j]) for i, j in PAIRS]).alias("c"))


def drawn(own: DataFrame) -> DataFrame:
    """Every group's moments mixed with those of the group above it: all documents, then languages, then sources."""
    above = own.where("level = 0").select(*KEY, "m", "c")
    levels, pair = [above], F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in PAIRS])
    for level, keys in ((1, []), (2, ["lang"])):
        up = above.select(*keys, F.col("m").alias("um"), F.col("c").alias("uc"))
        g = own.where(F.col("level") == level)
        g = null_safe_join(g, up, keys, "inner") if keys else g.join(F.broadcast(up))  # one row
        w = F.col("n") / (F.col("n") + F.lit(float(PRIOR)))
        g = g.select(*KEY, "m", "c", "um", "uc", w.alias("w"), F.zip_with("m", "um", lambda x, u: x - u).alias("off"))
        both = F.zip_with(F.zip_with("c", "uc", lambda x, u: F.col("w") * x + (1 - F.col("w")) * u), pair, lambda x, ij: x + F.col("w") * (1 - F.col("w")) * F.get("off", ij[0]) * F.get("off", ij[1]))
        above = g.select(*KEY, F.zip_with("um", "off", lambda u, o: u + F.col("w") * o).alias("m"), both.alias("c"))
        levels.append(above)
    return levels[0].union(levels[1]).union(levels[2])


def near_sums(v: DataFrame, params: DataFrame, share: float | None) -> DataFrame:
    """n, s_i and s_ij of each group's nearest ``share`` of vectors, or without one of those in cells up to the 97.5 %
    point's."""
    d = null_safe_join(v, params, list(KEY), "inner").select(*KEY, *[f"x{i}" for i in range(D)], distance().alias("d2"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    names = ["n", *[f"s{i}" for i in range(D)], *[f"s{i}{j}" for i, j in PAIRS]]
    cells = d.withColumn("cell", F.rint(CELLS * F.log1p("d2")).cast("long")).groupBy(*KEY, "cell").agg(F.count(F.lit(1)).alias("n"), *sums)
    group = Window.partitionBy(*KEY)
    before = F.coalesce(F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("cell") <= round(CELLS * math.log1p(chi2_point(0.975, D))) if share is None else F.col("__before") < share * F.col("__all")
    marked = cells.withColumns({"__all": F.sum("n").over(group), "__before": before}).withColumn("__in", inside & (F.col("__all") > 0))
    # a group without a vector that is near enough stays, with none of its own
    return marked.groupBy(*KEY).agg(*[F.coalesce(F.sum(F.when(F.col("__in"), F.col(c))), F.lit(0).cast("long")).alias(c) for c in names])


def estimates(stats: DataFrame) -> DataFrame:
    """Centre and precision of every (lang, source) that has a document which the base rules pass."""
    passed = stats.where(~F.col("base_failed")).select("lang", "source", *vector()).distinct()
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(level(0, none, none), level(1, F.col("lang"), none), level(2, F.col("lang"), F.col("source")))
    xs = [f"x{i}" for i in range(D)]
    v = materialize(passed.select(F.explode(levels).alias("k"), *xs).select("k.*", *xs).distinct(), "quality-vectors")
    # the start: medians, and spreads from the middle half
    start = v.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{x[1:]}") for x in xs])
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2.0)) if i == j else F.lit(0.0) for i, j in PAIRS]
    own = materialize(start.select(*KEY, "n", F.array(*[F.col(f"q{i}")[1] for i in range(D)]).alias("m"), F.array(*spread).alias("c")), "quality-start")
    trimmed = H / chi2_cdf(chi2_point(H, D), D + 2)
    settled = None
    for _ in range(STEPS):
        own = materialize(own_moments(near_sums(v, precise(drawn(own)), H), trimmed), "quality-mcd")
        centres = own.agg(F.bit_xor(F.xxhash64(*KEY, F.transform("m", lambda x: F.rint(x / SETTLED))))).first()[0]
        if centres == settled:
            break
        settled = centres
    inner = 0.975 / chi2_cdf(chi2_point(0.975, D), D + 2)
    own = materialize(own_moments(near_sums(v, precise(drawn(own)), None), inner), "quality-mcd")
    return precise(drawn(own)).where("level = 2").drop("level")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _judge(docs: DataFrame, own: list[str]) -> DataFrame:
    """The columns in ``own``, each with ``__own_`` before its name, the counts and the verdict."""
    counts = list(COUNTS)
    src = docs.select(*[F.col(c).alias(f"__own_{c}") for c in own], F.col("text"))
    stats = base_counts(src).select(*[F.col(f"__own_{c}").alias(f"__own_{c}") for c in own], *counts, base_failed().alias("base_failed"))
    stats = materialize(stats.withColumns({"lang": F.col("__own_lang").cast("string"), "source": F.col("__own_source").cast("string")}), "quality-stats")
    params = materialize(estimates(stats), "quality-params")  # written, so that its size is known to the join
    xs = vector()
    out = null_safe_join(stats.withColumns({f"x{i}": x for i, x in enumerate(xs)}), params, ["lang", "source"])
    d2 = F.when(~F.col("base_failed"), distance())
    out = out.withColumn("d2", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))
    return out.select(*[f"__own_{c}" for c in own], *counts, "base_failed", "d2", "kept")


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Documents with their counts, base_failed, d2 (null if the base rule decides) and kept; of the
    documents' own columns those in ``keep``, lang and source remain."""
    own = list(dict.fromkeys([*keep, "lang", "source"]))
    return _judge(docs, own).select(*[F.col(f"__own_{c}").alias(c) for c in own], *COUNTS, "base_failed", "d2", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they had."""
    own = list(dict.fromkeys([*docs.columns, "lang", "source"]))
    return _judge(docs, own).where("kept").select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
