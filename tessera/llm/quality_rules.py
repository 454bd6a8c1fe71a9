"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Everything here is column expressions; no Python runs on executors.

Statistics are quantised to whole steps of 1/256, so that the sums behind means and covariances
are sums of integers: they are exact and do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import packed, unpacked
from tessera.session import cut, fenced

#: ASCII white space, as a regex class body and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Steps per unit of a transformed statistic.
STEPS = 256
FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
#: Least standard deviation of each feature, in units. A robust scatter of features that are mostly
#: zero is singular; its diagonal gets these squares added.
FLOORS = (0.5, 0.08, 0.45, 0.6, 1.0)
#: Rows that a language's estimate counts as in its groups' estimates, and that of all rows in a language's.
WEIGHT = 200
#: Share of rows that the determinant is minimised over, and the concentration steps from each start.
SUPPORT = 0.5
ROUNDS = 4
#: What the scatter of the nearest half lacks: the share over the chance that chi-square with 7 degrees of
#: freedom is under the median of that with 5.
CONSISTENCY = 1.9122
#: A median absolute deviation of a normal variable is a standard deviation over this.
MAD = 1.4826
#: A squared distance over this rejects: the 0.9999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 25.745
#: Squared distances are ranked in buckets of 1/BUCKETS of a natural logarithm.
BUCKETS = 64


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def _repeat_words(windows: Column, words: Column) -> tuple[Column, Column]:
    """Words covered by windows that occur twice or more; equal hashes are checked word by word."""
    at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return (y["h"] == x["h"]) & (F.slice(words, x["i"] + 1, WINDOW) == F.slice(words, y["i"] + 1, WINDOW))

    twice = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_at") - 1), lambda k: F.struct(k.alias("k"), F.get("_at", k)["i"].alias("i"))),
        lambda s: F.coalesce(same(F.get("_at", s["k"]), F.get("_at", s["k"] - 1)), F.lit(False)) | F.coalesce(same(F.get("_at", s["k"]), F.get("_at", s["k"] + 1)), F.lit(False)),
    )
    starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return at, covered


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text counts as none. Documents of under 9 words have no window twice.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "*",
        words_of(text).alias("_words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(F.size("_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))),
        }
    )
    # Hashes of 1, 2, 4, then 8 words in a row, each from two of the last: one short hash a step and word.
    for step in (1, 2, 4):
        n = F.size("_windows") - step
        df = df.withColumn("_windows", F.zip_with(F.slice("_windows", 1, n), F.slice("_windows", 1 + step, n), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_any", F.size("_windows") > F.size(F.array_distinct("_windows")))
    at, covered = _repeat_words(F.col("_windows"), F.col("_words"))
    df = df.withColumn("_at", F.when(F.col("_any"), at))
    df = df.withColumn("n_repeat_words", F.when(F.col("_any"), covered).otherwise(0).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.drop("_words", "_lines", "_windows", "_any", "_at")


def feature_columns() -> dict[str, str]:
    """The transformed statistics in whole steps, as SQL text that Spark and other engines share."""
    n, chars = "greatest(n_words, 1)", "greatest(word_chars, 1)"
    of = lambda x: f"CAST(floor({STEPS} * ln({x}) + 0.5) AS BIGINT)"
    share = lambda x, y: f"1.0E0 + 100.0E0 * {x} / {y}"
    return {
        "f_length": of(f"1.0E0 * {n}"),
        "f_word": of(f"1.0E0 * {chars} / {n}"),
        "f_symbol": of(share("n_symbols", chars)),
        "f_line": of(share("n_dup_lines", n)),
        "f_repeat": of(share("n_repeat_words", n)),
    }


def moment_aggregates() -> dict[str, str]:
    """Count, sums and sums of products of the features over a set of rows (all integers)."""
    p = range(len(FEATURES))
    return {"n": "count(*)"} | {f"s{i}": f"sum({FEATURES[i]})" for i in p} | {f"q{i}{j}": f"sum({FEATURES[i]} * {FEATURES[j]})" for i in p for j in p if j <= i}


P = range(len(FEATURES))
PAIRS = [(i, j) for i in P for j in range(i + 1)]


def scatter_columns() -> list[tuple[str, str]]:
    """From moments to mean m<i> and covariance c<i><j>."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return [(f"m{i}", f"{d(f's{i}')} / n") for i in P] + [(f"c{i}{j}", f"{d(f'q{i}{j}')} / n - ({d(f's{i}')} / n) * ({d(f's{j}')} / n)") for i, j in PAIRS]


def factor_columns() -> list[tuple[str, str]]:
    """The Cholesky factor l<i><j> of the floored covariance, one after another, and the logarithm of its determinant."""
    out = []
    for i, j in PAIRS:
        cov = f"(c{i}{j}" + (f" + {(FLOORS[i] * STEPS) ** 2!r}E0" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
        out.append((f"l{i}{j}", f"sqrt(greatest({cov}, 1.0E0))" if i == j else f"{cov} / l{j}{j}"))
    return [*out, ("det", " + ".join(f"2 * ln(l{i}{i})" for i in P))]


SCATTER = [k for k, _ in scatter_columns()]
FACTOR = [k for k, _ in factor_columns()]


def distance_columns() -> list[tuple[str, str]]:
    """Forward substitution: z<i>, then the squared distance d2."""
    out = []
    for i in P:
        out.append((f"z{i}", f"({FEATURES[i]} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"))
    return [*out, ("d2", " + ".join(f"z{i} * z{i}" for i in P))]


BUCKET = f"CAST(floor({BUCKETS} * ln(d2 + 1.0E-3)) AS INT)"


def _with(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """df with columns of which later ones name earlier ones."""
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in columns])


def _estimates(rows: DataFrame) -> DataFrame:
    """Mean, covariance and factor per (start, key) over all rows given."""
    sums = rows.groupBy("start", "key").agg(*[F.expr(v).alias(k) for k, v in moment_aggregates().items()])
    return _with(_with(sums, scatter_columns()), factor_columns()).select("start", "key", "n", *SCATTER, *FACTOR)


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast only if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


#: Rows of a table that is broadcast at most.
FEW = 100_000


def _distances(rows: DataFrame, estimates: DataFrame, on: list[str]) -> DataFrame:
    """rows with d2; estimates have one row a key, so the join is as small as the number of keys."""
    return _with(rows.join(_small(estimates.drop("n", "det", *SCATTER[len(FEATURES) :])), on), distance_columns()).drop(*[f"z{i}" for i in P], *SCATTER, *FACTOR)


def _starts(rows: DataFrame) -> DataFrame:
    """Two estimates to start from, per key: the plain one (0), and medians with the median absolute deviations (1)."""
    plain = _estimates(rows.withColumn("start", F.lit(0)))
    middle = rows.groupBy("key").agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {f})").alias(f"_m{i}") for i, f in enumerate(FEATURES)])
    far = rows.join(_small(middle), "key").groupBy("key", *[f"_m{i}" for i in P]).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({f} - _m{i}))").alias(f"_d{i}") for i, f in enumerate(FEATURES)])
    columns = [(f"m{i}", f"CAST(_m{i} AS DOUBLE)") for i in P] + [(f"c{i}{j}", f"({MAD}E0 * _d{i}) * ({MAD}E0 * _d{i})" if i == j else "0.0E0") for i, j in PAIRS]
    robust = _with(_with(far, columns), factor_columns()).select(F.lit(1).alias("start"), "key", "n", *SCATTER, *FACTOR)
    return plain.unionByName(robust)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant per key (rows have key and FEATURES): concentration steps from both starts, then the lesser determinant.

    A step keeps, per key, the SUPPORT share of rows that are nearest (whole buckets of the distance, so
    ties stay together), and estimates again. Each step is two combinable aggregates; the counts by
    bucket are merged before they are summed up by key, so a key has as many rows there as distinct buckets.
    """
    estimates = _starts(rows)
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(ROUNDS):
        near = _distances(both, estimates, ["start", "key"]).withColumn("bucket", F.expr(BUCKET))
        counts = cut(near.groupBy("start", "key", "bucket").agg(F.count("*").alias("c")))
        counts = counts.selectExpr("*", "sum(c) OVER (PARTITION BY start, key ORDER BY bucket) AS below", "sum(c) OVER (PARTITION BY start, key) AS total")
        limit = counts.where(f"below >= {SUPPORT} * total").groupBy("start", "key").agg(F.min("bucket").alias("most"))
        estimates = _estimates(near.join(_small(limit), ["start", "key"]).where("bucket <= most"))
    best = estimates.groupBy("key").agg(F.min_by(F.struct(*SCATTER), F.struct("det", "start")).alias("e"))
    return cut(best.select("key", "e.*"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Base statistics with features and group keys; rows that fail the base rules have null features."""
    stats = base_statistics(docs)
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    stats = stats.withColumns({"_lang": mark("lang"), "_source": mark("source")}).drop("lang", "source")
    return stats.selectExpr("*", *[f"CASE WHEN NOT base_failed THEN {v} END AS {k}" for k, v in feature_columns().items()])


def _judged(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """stats (of _keyed) with distance2 and kept, by the estimate of each group."""
    extra = [*FACTOR, *SCATTER, *[f"z{i}" for i in P], "d2", *FEATURES, "_source", "_lang"]
    out = _with(stats.join(_small(estimates), ["_lang", "_source"], "left"), distance_columns()).withColumn("distance2", F.col("d2"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= CUTOFF)).drop(*extra)


def blended(weight: str, own: str, wider: str) -> list[tuple[str, str]]:
    """Means and covariances of an estimate of `weight` rows, with those of a wider one as WEIGHT rows more."""
    at = lambda t, k: f"{t}.{k}"
    return [(k, f"({weight} * coalesce({at(own, k)}, 0.0E0) + {WEIGHT} * {at(wider, k)}) / ({weight} + {WEIGHT})") for k in SCATTER]


def _chosen(rows: DataFrame) -> DataFrame:
    """The estimate of each group: its own, with its language's, with that of all rows, smoothly by their sizes (nulls without any rows)."""
    good = rows.where("NOT base_failed")
    # Groups, languages and all rows go through the same rounds; the first field keeps their keys apart.
    level = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source"))
    none, lang, source = F.lit(""), F.col("_lang"), F.col("_source")
    keys = F.array(level(0, none, none), level(1, lang, none), level(2, lang, source))
    found = robust_estimates(good.select(F.explode(keys).alias("key"), *FEATURES))
    sized = rows.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("c"))
    langs = sized.groupBy("_lang").agg(F.sum("c").alias("cl"))
    part = lambda n, *names: found.where(f"key.level = {n}").selectExpr(*names, f"struct({', '.join(SCATTER)}) AS e{n}")
    wide = langs.join(part(1, "key.lang AS _lang"), "_lang", "left").crossJoin(F.broadcast(part(0)))  # one row
    wide = wide.select("_lang", F.expr("struct(" + ", ".join(f"{v} AS {k}" for k, v in blended("cl", "e1", "e0")) + ")").alias("w"))
    own = sized.join(part(2, "key.lang AS _lang", "key.source AS _source"), ["_lang", "_source"], "left").join(wide, "_lang", "left")
    out = own.selectExpr("_lang", "_source", *[f"{CONSISTENCY if k[0] == 'c' else 1.0!r}E0 * ({v}) AS {k}" for k, v in blended("c", "e2", "w")])
    return _with(out, factor_columns()).drop("det")


#: Columns that the operator reads.
_READ = ("lang", "source", "text")
#: Columns that the operator adds; columns of the input with these names are replaced.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept")


def quality_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its columns but text, with ADDED.

    kept is false for base_failed rows, and for rows whose squared robust distance is over CUTOFF.
    Groups are (lang, source), nulls being a group of their own. A group's estimate takes in its
    language's as WEIGHT rows more, and that the estimate of all rows, so small groups lean on wider ones.
    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike; an empty
    table gives no rows. Columns of docs named as in ADDED are replaced, others may have any name. Texts
    are read once; only numbers and the other columns are stored.
    """
    names = [c for c in docs.columns if c != "text" and c not in ADDED]
    stats = cut(_keyed(packed(docs, *_READ, without=("text", *ADDED))).drop("text"))
    return unpacked(_judged(stats, _chosen(stats)), names, *ADDED)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Cases as in quality_scores().

    The statistics are worked out twice, once for the estimates and once beside the texts, so that
    texts are neither stored nor shuffled.
    """
    stats = cut(_keyed(docs.select(*_READ)).select("_lang", "_source", "base_failed", *FEATURES))
    kept = _judged(fenced(_keyed(packed(docs, *_READ))), _chosen(stats)).where("kept AND _fence >= 0")
    return unpacked(kept, docs.columns)


def oracle_sql() -> str:
    """The same, as DuckDB text over the table documents."""
    rx = r"[\x20\x09-\x0D]+"
    ctes: list[tuple[str, str]] = [
        ("t0", "SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents"),
        ("t1", f"SELECT *, list_filter(regexp_split_to_array(text, '{rx}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t0"),
        (
            "t2",
            "SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '" + rx + "', '', 'g')) AS BIGINT) AS word_chars, "
            "CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, "
            "CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM t1",
        ),
        ("win", f"SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t2 WHERE len(w) > {WINDOW})"),
        ("twice", "SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1"),
        ("rep", f"SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id"),
        ("t3", "SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words FROM t2 LEFT JOIN rep USING (doc_id)"),
        ("t4", "SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce('=' || lang, 'null') AS _lang, coalesce('=' || source, 'null') AS _source FROM t3"),
        ("t5", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in feature_columns().items()) + " FROM t4"),
    ]

    def steps(name: str, start: str, columns: list[tuple[str, str]]) -> str:
        """A chain of tables, a column each, as later ones name earlier ones."""
        for i, (k, v) in enumerate(columns):
            ctes.append((f"{name}_{i}", f"SELECT *, {v} AS {k} FROM {start}"))
            start = f"{name}_{i}"
        return start

    names = ", ".join([*SCATTER, *FACTOR])
    ctes.append(("good", "SELECT * FROM t5 WHERE NOT base_failed"))
    ctes.append(("keyed", f"SELECT {', '.join(FEATURES)}, unnest([{{'level': 0, 'lang': '', 'source': ''}}, {{'level': 1, 'lang': _lang, 'source': ''}}, {{'level': 2, 'lang': _lang, 'source': _source}}]) AS key FROM good"))
    ctes.append(("med", "SELECT key, " + ", ".join(f"quantile_disc({f}, 0.5) AS _m{i}" for i, f in enumerate(FEATURES)) + " FROM keyed GROUP BY key"))
    ctes.append(("dev", "SELECT key, " + ", ".join(f"any_value(_m{i}) AS _m{i}, quantile_disc(abs({f} - _m{i}), 0.5) AS _d{i}" for i, f in enumerate(FEATURES)) + " FROM keyed JOIN med USING (key) GROUP BY key"))
    robust = [(f"m{i}", f"CAST(_m{i} AS DOUBLE)") for i in P] + [(f"c{i}{j}", f"({MAD}E0 * _d{i}) * ({MAD}E0 * _d{i})" if i == j else "0.0E0") for i, j in PAIRS]
    done = steps("start1", "dev", robust + factor_columns())
    ctes.append(("started", "SELECT *, unnest([0, 1]) AS start FROM keyed"))
    moments = ", ".join(f"{v} AS {k}" for k, v in moment_aggregates().items())
    ctes.append(("start0_s", f"SELECT key, {moments} FROM keyed GROUP BY key"))
    plain = steps("start0", "start0_s", scatter_columns() + factor_columns())
    ctes.append(("e0_e", f"SELECT 0 AS start, key, {names} FROM {plain} UNION ALL SELECT 1, key, {names} FROM {done}"))
    for r in range(ROUNDS):
        far = steps(f"d{r}", f"(SELECT started.*, {names} FROM started JOIN e{r}_e USING (start, key)) AS j", distance_columns())
        ctes.append((f"n{r}_b", f"SELECT start, key, {', '.join(FEATURES)}, {BUCKET} AS bucket FROM {far}"))
        ctes.append((f"n{r}_c", f"SELECT start, key, bucket, sum(count(*)) OVER (PARTITION BY start, key ORDER BY bucket) AS below, sum(count(*)) OVER (PARTITION BY start, key) AS total FROM n{r}_b GROUP BY start, key, bucket"))
        ctes.append((f"n{r}_l", f"SELECT start, key, min(bucket) AS most FROM n{r}_c WHERE below >= {SUPPORT} * total GROUP BY start, key"))
        ctes.append((f"e{r + 1}_s", f"SELECT start, key, {moments} FROM n{r}_b JOIN n{r}_l USING (start, key) WHERE bucket <= most GROUP BY start, key"))
        done = steps(f"e{r + 1}", f"e{r + 1}_s", scatter_columns() + factor_columns())
        ctes.append((f"e{r + 1}_e", f"SELECT start, key, {names} FROM {done}"))
    ctes.append(("best", f"SELECT DISTINCT ON (key) key, {', '.join(SCATTER)} FROM e{ROUNDS}_e ORDER BY key, det, start"))
    ctes.append(("sized", "SELECT _lang, _source, count(*) FILTER (NOT base_failed) AS c FROM t5 GROUP BY _lang, _source"))
    ctes.append(("langs", "SELECT _lang, sum(c) AS cl FROM sized GROUP BY _lang"))
    ctes.append(("wide", "SELECT _lang, " + ", ".join(f"{v} AS {k}" for k, v in blended("cl", "e1", "e0")) + " FROM langs LEFT JOIN best AS e1 ON e1.key.level = 1 AND e1.key.lang = _lang CROSS JOIN (SELECT * FROM best WHERE key.level = 0) AS e0"))
    ctes.append(("own", "SELECT sized._lang, sized._source, " + ", ".join(f"{CONSISTENCY if k[0] == 'c' else 1.0!r}E0 * ({v}) AS {k}" for k, v in blended("c", "e2", "w")) + " FROM sized LEFT JOIN best AS e2 ON e2.key.level = 2 AND e2.key.lang = sized._lang AND e2.key.source = sized._source LEFT JOIN wide AS w ON w._lang = sized._lang"))
    done = steps("pick", "own", factor_columns())
    end = steps("f", f"(SELECT t5.*, {names.replace(', det', '')} FROM t5 LEFT JOIN {done} USING (_lang, _source)) AS j", distance_columns())
    body = ", ".join(f"{k} AS MATERIALIZED ({v})" if k in ("t3", "keyed", "started", "best") or k.endswith(("_e", "_b")) else f"{k} AS ({v})" for k, v in ctes)
    return (
        f"WITH {body} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
        f"NOT base_failed AND coalesce(d2, 0) <= {CUTOFF} AS kept FROM {end}"
    )
