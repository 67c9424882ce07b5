"""Quality rules by robust multivariate outliers, with DataFrame and SQL functions only.

Rows that pass the base rules give a vector of transformed statistics.  For each language and source the minimum covariance
determinant is sought by concentration steps: each takes the share ``SUBSET`` of rows nearest by Mahalanobis distance and
estimates mean and covariance anew.  Three deterministic starts (all rows, and the shares ``SUBSET`` and a half of them nearest to
the medians in units of median deviations) make two steps each; the one of the least determinant goes on until its determinant
falls no more, ``MOST_STEPS`` times at most.  A last step weighs in all rows within the 97.5 % quantile.  Rows beyond ``CUTOFF`` are rejected.
Sources of few rows are judged by the estimate of their language, languages of few rows by that of all rows.

Distances are binned, and a step is one aggregation by group and bin that carries the bin's moments; the nearest rows are then
the first bins.  So no step sorts rows, and however many rows a source has, it gives at most ``BINS`` of them to the next one.
Statistics are whole multiples of 1/``GRID``, so sums are exact and the result doesn't depend on the order of rows.

The steps are SQL texts that Spark and other engines run alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinloom.llm.scratch import Scratch

BLANK = r"[\x20\x09-\x0D]"
GRID = 256
BINS = 1024
#: Bins in one unit of squared distance.
FINE = 16
SUBSET = 0.75
#: Steps of each start, and most steps of the one that goes on.
FIRST_STEPS, MOST_STEPS = 2, 8
#: Shares of rows that the starts are made of.
STARTS = (1.0, SUBSET, 0.5)
#: Groups with fewer rows are judged by the estimate of a larger one.
LEAST_ROWS = 30
DIMS = 5
#: 0.99999 quantile of chi squared with 5 degrees of freedom.
CUTOFF = 30.86
#: 0.975 quantile; and for covariances of the nearest 75 % and 97.5 % of normal rows, what makes them unbiased.
NEAR, WIDEN_SUBSET, WIDEN_NEAR = 12.83, 1.412, 1.0556
#: Their squares are added to variances, so that covariances of statistics that hardly vary are regular: differences that don't matter,
#: of log words, log mean word length, log symbol rate, share of repeated lines and words.
FLOORS = (0.5, 0.12, 0.4, 0.1, 0.06)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each text."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.filter(F.split(text, BLANK + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        "doc_id", "lang", "source", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, F.expr("transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))")).alias("windows"),
    )
    # windows of equal hash side by side, with their places; only for texts that repeat one
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = counted.withColumn("placed", F.when(twice, F.sort_array(F.expr("transform(windows, (h, i) -> struct(h, i))"))))
    starts = F.expr("""sort_array(filter(transform(placed, (x, k) ->
        if(k > 0 and placed[k - 1].h = x.h or k + 1 < size(placed) and placed[k + 1].h = x.h, x.i, null)), i -> i is not null))""")
    found = placed.drop("windows").withColumn("starts", starts).drop("placed")
    covered = F.expr("aggregate(zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (n, x) -> n + x)")
    return found.withColumn("n_repeat_words", F.coalesce(F.when(F.size("starts") > 0, covered), F.lit(0)).cast("long")).drop("starts")


def _listed(make, items, sep: str = ", ") -> str:
    return sep.join(make(*(x if isinstance(x, tuple) else (x,))) for x in items)


def vectors_sql(stats: str) -> str:
    """Rows that pass the base rules, with their transformed statistics as whole numbers."""
    x = ("ln(1 + n_words)", "ln(CAST(word_chars AS DOUBLE) / n_words)", "ln(1 + 100 * CAST(n_symbols AS DOUBLE) / word_chars)",
         "CAST(n_dup_lines AS DOUBLE) / n_lines", "CAST(n_repeat_words AS DOUBLE) / n_words")
    cols = _listed(lambda j, e: f"CAST(floor({GRID} * ({e}) + 0.5) AS BIGINT) AS x{j}", list(enumerate(x)))
    return f"SELECT doc_id, lang, source, {cols} FROM {stats} WHERE n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words"


def pools_sql() -> list[tuple[str, str]]:
    """What each language and source is judged by, and the points of each such pool: those of the source, the language, or all."""
    xs = _listed(lambda j: f"v.x{j}", range(DIMS))
    own = "concat('s', CAST(length(s.lang) AS STRING), ':', s.lang, s.source)"
    sizes = "SELECT lang, source, count(*) AS n FROM vectors GROUP BY lang, source"
    langs = f"SELECT lang, n, small, max(CASE WHEN n < {LEAST_ROWS} THEN 1 ELSE 0 END) OVER () AS rare FROM (SELECT lang, CAST(sum(n) AS BIGINT) AS n, max(CASE WHEN n < {LEAST_ROWS} THEN 1 ELSE 0 END) AS small FROM sizes GROUP BY lang) g"
    pools = f"SELECT s.lang, s.source, CASE WHEN s.n >= {LEAST_ROWS} THEN {own} WHEN l.n >= {LEAST_ROWS} THEN concat('l', s.lang) ELSE 'a' END AS pool FROM sizes s JOIN langs l ON s.lang = l.lang"
    points = f"""SELECT p.pool, {xs} FROM vectors v JOIN pools p ON v.lang = p.lang AND v.source = p.source WHERE p.pool LIKE 's%'
        UNION ALL SELECT concat('l', v.lang) AS pool, {xs} FROM vectors v JOIN langs l ON v.lang = l.lang WHERE l.small = 1 AND l.n >= {LEAST_ROWS}
        UNION ALL SELECT 'a' AS pool, {xs} FROM vectors v JOIN langs l ON v.lang = l.lang WHERE l.rare = 1"""
    return [("sizes", sizes), ("langs", langs), ("pools", pools), ("points", points)]


def medians_sql() -> list[tuple[str, str]]:
    """Medians and median deviations of each statistic by pool, as mean and covariance."""
    hist = " UNION ALL ".join(f"SELECT pool, {j} AS j, x{j} AS v, count(*) AS c FROM points GROUP BY pool, x{j}" for j in range(DIMS))
    half = lambda t: f"SELECT pool, j, min(v) AS v, max(total) AS total FROM (SELECT pool, j, v, sum(c) OVER (PARTITION BY pool, j ORDER BY v) AS below, sum(c) OVER (PARTITION BY pool, j) AS total FROM {t}) q WHERE 2 * below >= total GROUP BY pool, j"
    away = "SELECT h.pool, h.j, abs(h.v - m.v) AS v, sum(h.c) AS c FROM hist h JOIN med m ON h.pool = m.pool AND h.j = m.j GROUP BY h.pool, h.j, abs(h.v - m.v)"
    mean = _listed(lambda j: f"CAST(max(CASE WHEN m.j = {j} THEN m.v END) AS DOUBLE) AS m{j}", range(DIMS))
    cov = _listed(lambda i, j: f"max(CASE WHEN m.j = {i} THEN 1.4826 * a.v * 1.4826 * a.v END) + {(FLOORS[i] * GRID) ** 2!r} AS c{i}{i}" if i == j else f"CAST(0 AS DOUBLE) AS c{i}{j}", PAIRS)
    medians = f"SELECT m.pool, 0 AS start, max(m.total) AS n, {mean}, {cov} FROM med m JOIN mad a ON m.pool = a.pool AND m.j = a.j GROUP BY m.pool"
    return [("hist", hist), ("med", half("hist")), ("away", away), ("mad", half("away")), ("medians", medians)]


def factor_sql(params: str) -> str:
    """Adds the Cholesky factor of the covariance, an entry after the other, and the logarithm of half its determinant."""
    out = f"SELECT * FROM {params}"
    for i, j in PAIRS:
        less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        value = f"sqrt(c{i}{i}{less})" if i == j else f"(c{i}{j}{less}) / l{j}{j}"
        out = f"SELECT *, {value} AS l{i}{j} FROM ({out}) f{i}{j}"
    return f"SELECT *, {_listed(lambda j: f'ln(l{j}{j})', range(DIMS), ' + ')} AS det FROM ({out}) f"


def distance_sql(points: str, factors: str, kept: str = "v.pool, p.start, p.n") -> str:
    """The ``kept`` columns, statistics and squared Mahalanobis distance of each row of ``points`` for each start of its pool."""
    xs = _listed(lambda j: f"v.x{j}", range(DIMS))
    out = f"SELECT {kept}, {xs}, {_listed(lambda j: f'p.m{j}', range(DIMS))}, {_listed(lambda i, j: f'p.l{i}{j}', PAIRS)} FROM {points} v JOIN {factors} p ON v.pool = p.pool"
    for i in range(DIMS):
        less = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        out = f"SELECT *, (x{i} - m{i}{less}) / l{i}{i} AS z{i} FROM ({out}) d{i}"
    names = ", ".join(c.split(".")[1] for c in kept.split(", "))
    return f"SELECT {names}, {_listed(lambda j: f'x{j}', range(DIMS))}, {_listed(lambda j: f'z{j} * z{j}', range(DIMS), ' + ')} AS d2 FROM ({out}) d"


def moments_sql(distances: str) -> str:
    """Rows, sums and sums of products by pool, start and bin of distance."""
    sums = _listed(lambda j: f"sum(x{j}) AS s{j}", range(DIMS)) + ", " + _listed(lambda i, j: f"sum(x{i} * x{j}) AS q{i}{j}", PAIRS)
    return f"SELECT pool, start, n, b, count(*) AS k, {sums} FROM (SELECT *, CAST(floor(least(d2 * {FINE}, {BINS - 1})) AS BIGINT) AS b FROM ({distances}) w) r GROUP BY pool, start, n, b"


def estimate_sql(moments: str, share: float = SUBSET, start: str = "start", last: bool = False) -> str:
    """Mean and covariance of the nearest rows: the first bins that hold the share, and at last all those within the quantile."""
    widen = WIDEN_NEAR if last else WIDEN_SUBSET
    taken = f"b < {int(NEAR * FINE)} OR before < {share} * n" if last else f"before < {share} * n"
    summed = "sum(k) AS k, " + _listed(lambda j: f"CAST(sum(s{j}) AS DOUBLE) AS s{j}", range(DIMS)) + ", " + _listed(lambda i, j: f"CAST(sum(q{i}{j}) AS DOUBLE) AS q{i}{j}", PAIRS)
    first = f"SELECT pool, start, n, {summed} FROM (SELECT *, sum(k) OVER (PARTITION BY pool, start ORDER BY b) - k AS before FROM {moments}) w WHERE {taken} GROUP BY pool, start, n"
    mean = _listed(lambda j: f"s{j} / k AS m{j}", range(DIMS))
    cov = _listed(lambda i, j: f"(q{i}{j} / k - (s{i} / k) * (s{j} / k)) * {widen!r}" + (f" + {(FLOORS[i] * GRID) ** 2!r}" if i == j else "") + f" AS c{i}{j}", PAIRS)
    return f"SELECT pool, {start} AS start, n, {mean}, {cov} FROM ({first}) e"


def better_sql(old: str, new: str) -> str:
    """Of each pool the new estimate if its determinant is less, or else the old one; ``start`` counts the steps taken."""
    own = "pool, start, n, " + ", ".join([*(f"m{j}" for j in range(DIMS)), *(f"c{i}{j}" for i, j in PAIRS), *(f"l{i}{j}" for i, j in PAIRS), "det"])
    both = f"SELECT {own}, 0 AS old FROM {new} UNION ALL SELECT {own}, 1 AS old FROM {old}"
    return f"SELECT {own} FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY det, old DESC) AS place FROM ({both}) b) r WHERE place = 1"


def steps_sql() -> list[tuple[str, str]]:
    """All steps as (name, query), from ``stats`` on; the last one gives doc_id and d2 of rows that are judged."""
    steps = [("vectors", vectors_sql("stats")), *pools_sql(), *medians_sql(), ("f0", factor_sql("medians")), ("b0", moments_sql(distance_sql("points", "f0")))]
    steps.append(("starts", " UNION ALL ".join(estimate_sql("b0", share, str(k)) for k, share in enumerate(STARTS))))
    steps.append(("f1", factor_sql("starts")))
    for k in range(1, FIRST_STEPS + 1):
        steps += [(f"b{k}", moments_sql(distance_sql("points", f"f{k}"))), (f"f{k + 1}", factor_sql(f"({estimate_sql(f'b{k}')}) e"))]
    own = "pool, 0 AS start, n, " + ", ".join([*(f"m{j}" for j in range(DIMS)), *(f"c{i}{j}" for i, j in PAIRS), *(f"l{i}{j}" for i, j in PAIRS), "det"])
    steps.append(("g0", f"SELECT {own} FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY det, start) AS place FROM f{FIRST_STEPS + 1}) r WHERE place = 1"))
    for k in range(MOST_STEPS):
        steps += [(f"c{k}", moments_sql(distance_sql("points", f"g{k}"))), (f"h{k}", factor_sql(f"({estimate_sql(f'c{k}', start='start + 1')}) e")), (f"g{k + 1}", better_sql(f"g{k}", f"h{k}"))]
    steps += last_sql(f"g{MOST_STEPS}")
    return steps


def last_sql(found: str) -> list[tuple[str, str]]:
    near = [("near", moments_sql(distance_sql("points", found))), ("final", factor_sql(f"({estimate_sql('near', last=True)}) e"))]
    named = f"SELECT v.doc_id, p.pool, {_listed(lambda j: f'v.x{j}', range(DIMS))} FROM vectors v JOIN pools p ON v.lang = p.lang AND v.source = p.source"
    judged = f"SELECT doc_id, d2 FROM ({distance_sql(f'({named})', 'final', 'v.doc_id, p.n')}) j WHERE n >= {LEAST_ROWS}"
    return [*near, ("judged", judged)]


#: What is written to the shared folder, so that later steps read it and no step's work is done twice.
_KEPT = {"vectors", "langs", "pools", "hist", "medians", "near", "final", "starts", *(f"{x}{k}" for x in "bcfg" for k in range(MOST_STEPS + 2))}


def quality_rules(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Judges each text of ``docs`` (doc_id, text, lang, source).

    A row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 10 words, or over a
    fifth of them in repeated 5-word windows), kept (passes the base rules, and is no outlier of its language and source).  A null
    text has no words; a null language or source counts as an empty one.  Where under ``LEAST_ROWS`` rows of a source pass the base
    rules, its language judges them, and where those of the language are too few, all rows do; a table with fewer has no outliers.  Distances depend on the statistics alone, so equal rows share a verdict.  An empty table gives an
    empty one.  Other columns are not read.
    """
    scratch = Scratch(spark, "rules")
    # the row number is written once, so later reads agree on it
    stats = scratch.save(statistics(docs).withColumn("row", F.monotonically_increasing_id()), "stats")
    frames = {"stats": stats.withColumn("doc_id", F.col("row"))}

    def step(name: str, query: str) -> None:
        own = {k: v for k, v in frames.items() if re.search(rf"\b(FROM|JOIN) {k}\b", query)}
        for k in own:
            query = re.sub(rf"\b(FROM|JOIN) {k}\b", rf"\1 {{{k}}}", query)
        df = spark.sql(query, **own)
        frames[name] = scratch.save(df, name) if name in _KEPT else df

    steps, found = dict(steps_sql()), f"g{MOST_STEPS}"
    for name, query in steps.items():
        if name == "near":
            break
        step(name, query)
        # once no determinant falls, further steps would change nothing
        if name[0] == "g" and name != "g0" and frames[name].filter(F.col("start") == int(name[1:])).isEmpty():
            found = name
            break
    for name, query in last_sql(found):
        step(name, query)
    judged = frames["judged"].select(F.col("doc_id").alias("row"), "d2")
    joined = stats.join(judged, "row", "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("d2").isNull() | (F.col("d2") <= cutoff))).alias("kept"))
