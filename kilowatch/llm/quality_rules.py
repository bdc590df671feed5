"""Quality rules in SQL functions: counts with fixed limits, and robust multivariate outliers.

Base counts of a text are its words, their characters, symbols, lines equal to an earlier one and words within repeated
windows of three words. A document fails the base rule with fewer than `LEAST_WORDS` words or more than half of them
repeated.

Of those that pass, a vector of transformed statistics (logarithms of the mean word length and the number of words, square
roots of shares) is judged against its language and source. Location and scatter of each group are minimum-covariance-
determinant estimates: from two starts, medians with absolute deviations and plain moments, concentration steps take the
moments of the documents nearest so far, at least `COVERED` of the group, and the start that ends with the smaller
determinant counts. A document is rejected if its squared Mahalanobis distance is over `CUTOFF`, the chi-square quantile
that one in a million normal vectors exceeds. Each statistic has a least scale, so that groups that are all alike, or a
statistic that is zero in most documents, reject nobody for a trifle.

Vectors are whole numbers (in units of 1/SCALE), medians are exact and moments are integer sums, so the result depends on
neither order nor partitions; 64-bit sums hold 2^35 documents a group. The documents nearest are found by counts of distance
classes of 4 %, in one pre-aggregated pass a step: no document is sorted or gathered, however large its group is. A group
of fewer than `LEAST_GROUP` documents is judged with the other small ones of its language; if these are too few as well,
nobody in it is rejected.

Null and empty texts have no words and fail. Null languages and sources are groups of their own. Repeated rows are judged
each. Words and windows are compared by 64-bit hashes within a text. An empty table gives no rows.
"""

import math

from pyspark.sql import Window, functions as F

from kilowatch.llm.common import bound, written

LEAST_WORDS = 50
WHITE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

SCALE = 256
#: Statistics of a vector, and the least standard deviation each is taken to have.
LEAST_SCALE = {"word_length": 0.1, "symbols": 0.04, "repeated_lines": 0.12, "repeated_words": 0.12, "capitals": 0.05, "size": 1.0}
DIMENSIONS = len(LEAST_SCALE)
COVERED = 0.75
STEPS = 4
LEAST_GROUP = 50
CLASSES = 16  # of distances, for each doubling
POOL = ["pool_lang", "pool_source"]
FEW = 20_000  # rows of some 250 bytes


def _chi_square(x, degrees):
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(share, degrees):
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, degrees) < share else (low, middle)
    return low


#: What the scatter of the nearest documents is multiplied by to be that of all, were they normal.
CONSISTENCY = COVERED / _chi_square(chi_square_quantile(COVERED, DIMENSIONS), DIMENSIONS + 2)
CUTOFF = chi_square_quantile(1 - 1e-6, DIMENSIONS)


# ---- counts of a text -----------------------------------------------------------------------------------------------


def _repeated_words(words):
    """Words within windows of three that occur twice or more in the array: equal windows are neighbours once sorted."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    part = lambda all_, first: F.slice(all_, first, F.greatest(F.size(all_) - 2, F.lit(0)))
    two = lambda a, b: F.xxhash64(a, b)
    windows = bound(hashes, lambda all_: F.zip_with(part(all_, 1), F.zip_with(part(all_, 2), part(all_, 3), two), two))
    placed = F.transform(windows, lambda w, k: F.struct(w.alias("window"), k.alias("at")))
    equal = lambda a, b: F.when(a["window"] == b["window"], F.array(a["at"], b["at"]))
    neighbours = lambda all_: F.zip_with(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0))), F.slice(all_, 2, F.size(all_)), equal)
    repeated = F.flatten(F.filter(bound(F.sort_array(placed), neighbours), lambda pair: pair.isNotNull()))
    return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda k: F.array(k, k + 1, k + 2)))))


def counted(docs, id_col="doc_id", text_col="text", lang_col="lang", source_col="source"):
    """(doc_id, lang, source, counts) of every document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", WHITE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = bound(lines, lambda all_: F.struct(F.size(all_).alias("n"), F.size(F.array_distinct(all_)).alias("different")))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"),
        line_counts.alias("lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    whole = lambda column, name: F.col(column).cast("bigint").alias(name)
    return rows.select(
        *("doc_id", "lang", "source"),
        *(whole(c, c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_capitals")),
        whole("lines.n", "n_lines"),
        (F.col("lines.n") - F.col("lines.different")).cast("bigint").alias("n_dup_lines"),
    )


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector():
    """The statistics, as whole numbers; of documents with words."""
    share = lambda part, of: F.sqrt(F.col(part) / F.col(of))
    values = {
        "word_length": F.log2(F.col("word_chars") / F.col("n_words")),
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "size": F.log2("n_words"),
    }
    return [F.when(~F.col("base_failed"), F.round(values[name] * SCALE).cast("bigint")).alias(name) for name in LEAST_SCALE]


def _beside(table):
    """A written table with a row a group: handed to all tasks if it is known to have few rows, else joined as Spark sees fit,
    which splits large groups."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


# ---- groups and their estimates -------------------------------------------------------------------------------------


def _with_pools(rows):
    """Add the group a document is judged with, null where there are too few or it has failed the base rule."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    keyed = rows.withColumns({"_lang": named("lang"), "_source": named("source")})
    sizes = keyed.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < LEAST_GROUP).groupBy("_lang").agg(F.sum("n").alias("small_n"))
    enough, pooled = F.col("n") >= LEAST_GROUP, F.col("small_n") >= LEAST_GROUP
    pools = sizes.join(small, "_lang", "left").select(
        *("_lang", "_source"),
        F.when(enough | pooled, F.col("_lang")).alias("pool_lang"),
        F.when(enough, F.col("_source")).when(pooled, F.lit("*")).alias("pool_source"),
    )
    return keyed.join(_beside(written(pools, "pools")), ["_lang", "_source"], "left").drop("_lang", "_source")


def _pairs():
    return [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _shape(estimates):
    """Add the inverse of the lower triangle L of the scatter LL', row by row, and the determinant's logarithm."""
    for i in range(DIMENSIONS):
        row = {}
        for j in range(i):
            below = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            estimates = estimates.withColumn(f"l_{i}_{j}", (F.col(f"s_{i}_{j}") - below) / F.col(f"l_{j}_{j}"))
        left = F.col(f"s_{i}_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") for k in range(i)), F.lit(0.0))
        estimates = estimates.withColumn(f"l_{i}_{i}", F.sqrt(left))
        for j in range(i):
            through = sum((F.col(f"l_{i}_{k}") * F.col(f"m_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            row[f"m_{i}_{j}"] = -through / F.col(f"l_{i}_{i}")
        row[f"m_{i}_{i}"] = 1 / F.col(f"l_{i}_{i}")
        estimates = estimates.withColumns(row)
    spread = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(DIMENSIONS)), F.lit(0.0))
    kept = [*POOL, "start", "n", *(f"c_{i}" for i in range(DIMENSIONS)), *(f"m_{i}_{j}" for i, j in _pairs())]
    return estimates.select(*kept, spread.alias("spread"))


def _distance():
    """Squared distance of a document's vector from the estimate beside it."""
    z = [F.col(name) - F.col(f"c_{i}") for i, name in enumerate(LEAST_SCALE)]
    turned = [sum((F.col(f"m_{i}_{j}") * z[j] for j in range(1, i + 1)), F.col(f"m_{i}_0") * z[0]) for i in range(DIMENSIONS)]
    return sum((y * y for y in turned[1:]), turned[0] * turned[0])


def _first(vectors):
    """The two starts: (pool, start, n, centre, scatter)."""
    middle = vectors.groupBy(*POOL).agg(F.count("*").alias("n"), *(F.percentile(name, F.lit(0.5)).alias(f"c_{i}") for i, name in enumerate(LEAST_SCALE)))
    middle = written(middle, "medians")
    apart = [F.percentile(F.abs(F.col(name) - F.col(f"c_{i}")), F.lit(0.5)).alias(f"apart_{i}") for i, name in enumerate(LEAST_SCALE)]
    centres = [F.first(f"c_{i}").alias(f"c_{i}") for i in range(DIMENSIONS)]
    robust = vectors.join(_beside(middle), POOL).groupBy(*POOL).agg(F.first("n").alias("n"), *centres, *apart)
    # An absolute deviation times 1.4826 is the standard deviation of normal values.
    scatter = [F.pow(1.4826 * F.col(f"apart_{i}"), F.lit(2.0)) + _ridge(i) if i == j else F.lit(0.0) for i, j in _pairs()]
    robust = robust.select(*POOL, F.lit(0).alias("start"), "n", *(f"c_{i}" for i in range(DIMENSIONS)), *(s.alias(f"s_{i}_{j}") for s, (i, j) in zip(scatter, _pairs(), strict=True)))
    plain = _estimated(vectors.groupBy(*POOL).agg(F.count("*").alias("n"), *_moments()).withColumn("start", F.lit(1)), F.col("n"))
    return robust.unionByName(plain)


def _ridge(i):
    return F.lit((list(LEAST_SCALE.values())[i] * SCALE) ** 2)


def _moments():
    names = list(LEAST_SCALE)
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in _pairs()]
    return [F.count("*").alias("held"), *(F.sum(name).alias(f"t_{i}") for i, name in enumerate(names)), *products]


def _estimated(sums, n):
    """Centre and scatter from integer sums; the numerators of the scatter are exact."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    held = F.col("held").cast("double")
    scatter = [((wide("held") * wide(f"p_{i}_{j}") - wide(f"t_{i}") * wide(f"t_{j}")).cast("double") / held / held) + (_ridge(i) if i == j else F.lit(0.0)) for i, j in _pairs()]
    centre = [(F.col(f"t_{i}").cast("double") / held).alias(f"c_{i}") for i in range(DIMENSIONS)]
    return sums.select(*POOL, "start", n.alias("n"), *centre, *(s.alias(f"s_{i}_{j}") for s, (i, j) in zip(scatter, _pairs(), strict=True)))


def _concentrated(vectors, estimates):
    """Estimates from the documents nearest to the estimates before: at least the covered share of each group."""
    far = F.floor(CLASSES * F.log2(1 + _distance())).alias("class")
    held = vectors.join(_beside(estimates), POOL).select(*POOL, "start", "n", far, *LEAST_SCALE)
    classes = held.groupBy(*POOL, "start", "class").agg(F.first("n").alias("n"), *_moments())
    nearer = F.sum("held").over(Window.partitionBy(*POOL, "start").orderBy("class")) - F.col("held")
    near = classes.withColumn("nearer", nearer).filter(F.col("nearer") < F.ceil(COVERED * F.col("n")))
    sums = ["held", *(f"t_{i}" for i in range(DIMENSIONS)), *(f"p_{i}_{j}" for i, j in _pairs())]
    whole = near.groupBy(*POOL, "start").agg(F.first("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
    return _estimated(whole, F.col("n"))


def estimates(vectors):
    """One row per group: centre and inverse triangle of the scatter (`spread` is half its determinant's logarithm)."""
    now = written(_shape(_first(vectors)), "estimates")
    for _ in range(STEPS):
        now = written(_shape(_concentrated(vectors, now)), "estimates")
    names = [name for name in now.columns if name not in (*POOL, "spread", "start")]
    best = now.groupBy(*POOL).agg(F.min_by(F.struct(*names), F.struct("spread", "start")).alias("best"))
    return best.select(*POOL, "best.*")


def judged(docs, **columns):
    """One row per document: doc_id, counts, base_failed, kept, distance (squared, null where nothing was estimated)."""
    rows = counted(docs, **columns)
    rows = rows.withColumn("base_failed", _base_failed())
    rows = rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *_vector())
    rows = written(rows, "statistics")
    rows = written(_with_pools(rows), "statistics")
    vectors = rows.filter("NOT base_failed AND pool_lang IS NOT NULL").select(*POOL, *LEAST_SCALE)
    against = written(estimates(vectors), "estimates")
    found = rows.join(_beside(against), POOL, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / CONSISTENCY))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
