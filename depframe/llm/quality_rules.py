"""Quality rules: word and line statistics, then robust multivariate outliers by language and source.

Only DataFrame functions are used. A text's statistics come from one pass over the text and are
written down as a narrow table; everything after reads that table alone.

The outlier test is a minimum-covariance-determinant estimate (concentration steps of FAST-MCD) for
each (lang, source): from two starts, coordinate-wise medians with fixed scales and the mean and covariance of all rows, again and
again keep the share ``SUPPORT`` of rows nearest in Mahalanobis distance and re-estimate centre and covariance from them, until no
determinant falls any more; of all estimates of a group the one of least determinant counts. Quantiles come from counts per distance bin and
moments from sums, so a source with a third of all rows is pre-aggregated in every task like any other. Coordinates are integers
(``GRID`` per unit), which makes the sums exact and the verdict the same on every run.

Every group has an estimate of its own, whatever its size. By one formula it is weighed against the estimate over all rows: with n rows its moments
count n / (n + ``PRIOR_ROWS``). So a group of a few rows leans on the whole and a large one on itself, without a switch between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depframe.session import discard, materialise

#: Fixed values. Text classes of the base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
#: Share of a group's rows that an estimate rests on; consistency factor of a covariance of that share in four dimensions.
SUPPORT, CONSISTENCY = 0.75, 1.49
#: 1 - 1e-6 quantile of chi-squared with four degrees of freedom.
CUTOFF = 33.4
GRID = 1024
BINS_PER_UNIT = 16
#: A determinant that falls by less than this (as a logarithm) has settled; steps after which it is an error that one has not.
SETTLED, STEPS = 1e-3, 1000
#: Rows that the estimate over all rows counts as.
PRIOR_ROWS = 100
#: Estimates up to this number are broadcast (under 1 KB each); more are joined by their key.
BROADCAST_GROUPS = 10_000
#: Coordinates, each with the least standard deviation it is taken to have.
FLOORS = {"x_length": 0.12, "x_symbols": 0.08, "x_lines": 0.15, "x_repeats": 0.15}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INNER = "__quality"


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one struct column ``__quality`` of the base statistics of each whole text.

    Null and empty texts have zeros. A word is a run of characters other than blanks and tabs to carriage returns.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__w", words).withColumn("__l", lines)
    df = df.withColumn("__n", F.size("__w"))
    w = F.col("__w")
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    df = df.withColumn("__h", F.when(F.col("__n") >= WINDOW, windows))
    # Few texts repeat a window; only those pay for sorting windows with their places.
    df = df.withColumn("__again", F.size(F.array_distinct("__h")) < F.size("__h"))
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.col("__again"), placed))
    p = F.col("__p")
    like = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
    at = F.transform(F.filter(p, lambda x, i: like(x, i - 1) | like(x, i + 1)), lambda x: x["i"])
    df = df.withColumn("__at", F.sort_array(at))
    gaps = F.zip_with("__at", F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.when(F.col("__again"), F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long"))
    stats = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    return df.withColumn(INNER, stats).drop("__w", "__l", "__n", "__h", "__again", "__p", "__at")


def base_failed(s: Column) -> Column:
    """Under 10 words, or over a fifth of the words in windows that repeat."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def _coordinates(s: Column) -> dict[str, Column]:
    """Transformed statistics on the integer grid, shrunk towards usual values where a text is short."""
    words = s["n_words"] + 20
    x = {
        "x_length": F.log((s["word_chars"] + 110) / words),
        "x_symbols": F.sqrt(s["n_symbols"] / words),
        "x_lines": F.sqrt(s["n_dup_lines"] / (s["n_lines"] + 5)),
        "x_repeats": F.sqrt(s["n_repeat_words"] / words),
    }
    return {k: F.round(v * GRID).cast("long") for k, v in x.items()}


def _distance(x: list[Column], mean: list[Column], inverse: list[list[Column]]) -> Column:
    d = [a - b for a, b in zip(x, mean, strict=True)]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * inverse[i][j] for i in range(len(d)) for j in range(len(d))))


def _medians(rows: DataFrame, names: list[str]) -> DataFrame:
    """Median of each coordinate for each group: the first grid value with half of the rows at or below it."""
    long = rows.select("__g", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names))).alias("x"))
    counts = long.groupBy("__g", "x.name", "x.v").count()
    run = Window.partitionBy("__g", "name").orderBy("v")
    whole = Window.partitionBy("__g", "name")
    below = counts.withColumn("run", F.sum("count").over(run)).withColumn("all", F.sum("count").over(whole))
    mid = below.where(2 * F.col("run") >= F.col("all")).groupBy("__g", "name").agg(F.min("v").alias("v"))
    return mid.groupBy("__g").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).cast("double").alias(f"m_{n}") for n in names))


def _inverted(moments: DataFrame, names: list[str]) -> DataFrame:
    """Adds i_a_b, the inverse of the symmetric c_a_b, and __ld, the logarithm of its determinant, by Cholesky factors; one projection for each entry."""
    df, d = moments, range(len(names))
    for j in d:
        for i in d[j:]:
            s = F.col(f"c_{names[i]}_{names[j]}") - reduce(lambda a, b: a + b, (F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(s) if i == j else s / F.col(f"l_{j}_{j}"))
    for j in d:  # the factor's inverse
        for i in d[j:]:
            s = F.lit(1.0) if i == j else -reduce(lambda a, b: a + b, (F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)))
            df = df.withColumn(f"v_{i}_{j}", s / F.col(f"l_{i}_{i}"))
    for i in d:
        for j in d:
            s = reduce(lambda a, b: a + b, (F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}") for k in d if k >= max(i, j)))
            df = df.withColumn(f"i_{names[i]}_{names[j]}", s)
    df = df.withColumn("__ld", 2 * reduce(lambda a, b: a + b, (F.log(f"l_{i}_{i}") for i in d)))
    return df.drop(*(f"{k}_{i}_{j}" for k in "lv" for i in d for j in d))


def _few(estimate: DataFrame, n: int) -> DataFrame:
    return F.broadcast(estimate) if n <= BROADCAST_GROUPS else estimate


def _nearest(rows: DataFrame, by: list[str], names: list[str], n: int) -> DataFrame:
    """The share SUPPORT of each group's rows with the least __d2; ties at the last bin all count."""
    binned = rows.withColumn("__bin", F.floor(F.log1p("__d2") * BINS_PER_UNIT))
    counts = binned.groupBy(*by, "__bin").count()
    run, whole = Window.partitionBy(*by).orderBy("__bin"), Window.partitionBy(*by)
    counts = counts.withColumn("run", F.sum("count").over(run)).withColumn("all", F.sum("count").over(whole))
    last = counts.where(F.col("run") >= SUPPORT * F.col("all")).groupBy(*by).agg(F.min("__bin").alias("__last"))
    return binned.join(_few(last, n), by).where("__bin <= __last").select(*by, *names)


def _moments(rows: DataFrame, by: list[str], floors: dict[str, float], grid: int, factor: float) -> DataFrame:
    """Centre m_a, covariance c_a_b (times ``factor``, floors added), inverse and determinant of the rows of each group."""
    names = list(floors)
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = [exact(F.col(a)).alias(f"s_{a}") for a in names]
    sums += [exact(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    moments = rows.groupBy(*by).agg(F.count("*").alias("__k"), *sums)
    moments = moments.withColumns({f"m_{a}": F.col(f"s_{a}") / F.col("__k") for a in names})
    spread = {}
    for i, a in enumerate(names):
        for b in names[: i + 1]:
            c = factor * (F.col(f"s_{a}_{b}") / F.col("__k") - F.col(f"m_{a}") * F.col(f"m_{b}"))
            spread[f"c_{a}_{b}"] = F.greatest(c, F.lit(0.0)) + (floors[a] * grid) ** 2 if a == b else c
    moments = _inverted(moments.withColumns(spread), names)
    return moments.select(*by, *_columns(names))


def _columns(names: list[str]) -> list[str]:
    return [f"m_{a}" for a in names] + [f"c_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]] + [f"i_{a}_{b}" for a in names for b in names] + ["__ld"]


def mcd_estimates(rows: DataFrame, floors: dict[str, float], grid: int = GRID, steps: int = STEPS) -> DataFrame:
    """Centre (m_a), covariance (c_a_b), its inverse (i_a_b) and log-determinant (__ld) of the integer coordinates of ``rows`` for each ``__g``.

    Repeated rows count as often as they occur; an empty table gives an empty table. The floors keep the
    covariance of a group whose rows are all alike from being singular. Groups go on together, each from two starts, until all have settled.
    """
    names, by = list(floors), ["__g", "__start"]
    spread = {f"c_{a}_{b}": F.lit((3 * floors[a] * grid) ** 2 if a == b else 0.0) for i, a in enumerate(names) for b in names[: i + 1]}
    medians = _inverted(_medians(rows, names).withColumns(spread), names).select("__g", F.lit(0).alias("__start"), *_columns(names))
    means = _moments(rows, ["__g"], floors, grid, 1.0).select("__g", F.lit(1).alias("__start"), *_columns(names))
    now = materialise(medians.unionByName(means), "mcd-start")
    n, best = now.count(), None
    for _ in range(steps):
        near = _nearest(_distances(rows, now, names, n), by, names, n)
        new = materialise(_moments(near, by, floors, grid, CONSISTENCY), "mcd")
        if best is None:  # the starts are no estimates yet
            best, fell = new, 1
        else:
            both = new.select(*by, F.col("__ld").alias("__new")).join(best.select(*by, "__ld"), by)
            fell = both.where(F.col("__new") < F.col("__ld") - SETTLED).count()
            all_columns = F.struct(*(F.col(c) for c in new.columns))
            last = best
            least = best.unionByName(new).groupBy(*by).agg(F.min_by(all_columns, F.struct("__ld", *(f"m_{a}" for a in names))).alias("x"))
            best = materialise(least.select("x.*"), "mcd-best")
            discard(last)
        if now is not best:
            discard(now)
        now = new
        if not fell:
            break
    else:
        raise RuntimeError(f"the estimates did not settle in {steps} steps")
    columns = F.struct(*(F.col(c) for c in now.columns))
    out = materialise(best.groupBy("__g").agg(F.min_by(columns, F.struct("__ld", "__start")).alias("x")).select("x.*").drop("__start"), "mcd")
    discard(best, now)
    return out


def _weighed(estimate: DataFrame, sizes: DataFrame, whole: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Each group's estimate weighed against that over all rows: its own counts n / (n + PRIOR_ROWS)."""
    names = list(floors)
    moments = [c for c in _columns(names) if c[:2] in ("m_", "c_")]
    pooled = whole.select(*(F.col(c).alias(f"w_{c}") for c in moments))
    share = F.col("__n") / (F.col("__n") + PRIOR_ROWS)
    mixed = estimate.join(sizes, "__g").join(F.broadcast(pooled))  # of one row
    return _inverted(mixed.select("__g", *((share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in moments)), names)


def _distances(rows: DataFrame, estimate: DataFrame, names: list[str], n: int) -> DataFrame:
    """``rows`` with ``__d2``, the squared Mahalanobis distance from the row's group, once for each of its estimates; null where there is none."""
    joined = rows.join(_few(estimate, n), "__g", "left")
    inverse = [[F.col(f"i_{a}_{b}") for b in names] for a in names]
    d2 = _distance([F.col(a) for a in names], [F.col(f"m_{a}") for a in names], inverse)
    kept = [*rows.columns, *(c for c in ("__start",) if c in estimate.columns)]
    return joined.withColumn("__d2", F.greatest(d2, F.lit(0.0))).select(*kept, "__d2")


def _grouped(df: DataFrame) -> DataFrame:
    """``df`` with ``__g``, the pair of lang and source as one text; null counts as empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.withColumn("__g", F.to_json(F.struct(part("lang"), part("source"))))


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``lang`` and ``source`` name the groups (null counts as empty). A document is kept unless it fails the base
    rules or lies beyond the 1 - 1e-6 quantile of its group's robust distance. Null and empty texts fail the base rules.
    Every row of ``df``, repeated ones too, gives one row with all its columns, whatever their names; a column ``quality`` is replaced.
    """
    # The caller's columns travel as one struct, so none of them can clash with those worked on here.
    own = [c for c in df.columns if c not in ("quality", INNER)]
    held = df.select(F.col(text).alias("text"), F.col("lang"), F.col("source"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"))
    read = materialise(with_statistics(held, "text").drop("text"), "quality")
    names = list(FLOORS)
    narrow = _grouped(read.select("lang", "source", INNER)).where(~base_failed(F.col(INNER)))
    shared = materialise(narrow.select("__g", *(c.alias(n) for n, c in _coordinates(F.col(INNER)).items())), "coordinates")
    whole = mcd_estimates(shared.withColumn("__g", F.lit("")), FLOORS)
    own_estimates = mcd_estimates(shared, FLOORS)
    sizes = shared.groupBy("__g").agg(F.count("*").alias("__n"))
    estimate = materialise(_weighed(own_estimates, sizes, whole, FLOORS), "estimates")
    discard(shared, whole, own_estimates)
    rows = _grouped(read).withColumns(_coordinates(F.col(INNER))).drop("lang", "source")
    judged = _distances(rows, estimate, names, estimate.count())
    failed = base_failed(F.col(INNER))
    kept = ~failed & (F.coalesce("__d2", F.lit(0.0)) <= CUTOFF)
    out = F.struct(*(F.col(INNER)[c].alias(c) for c in STATS), failed.alias("base_failed"), kept.alias("kept"))
    return judged.select("__row.*", out.alias("quality"))
