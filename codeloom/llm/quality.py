"""Quality rules: text statistics and robust multivariate outliers.

Statistics of a text come from array functions within its row, without a shuffle. Their
transformed vectors are judged per language and source against a minimum-covariance-determinant
estimate: from two fixed starts (medians, and the covariance of vectors drawn in towards them),
concentration steps keep the H share of the vectors that are nearest to the centre and take
mean and covariance anew, until no determinant falls any more; the start that ends with the
smaller one counts. A last step reweights: every vector within the chi-square bound takes part.

Groups of any size have an estimate: their means of values and products are drawn towards
those of their language, and these towards those of all texts, as if PRIOR vectors of the
wider group were among their own. Everything is sums, exact percentiles over whole numbers with
a bounded number of values, and columns; a group with a third of all rows is summed in the map
tasks first, and only numbers of groups that still move reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import let
from codeloom.llm.tables import SPACE, same, stored, text_of

#: Base rules: least words, and greatest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: Words of this many characters at most are short.
SHORT = 3
#: Share of vectors that a concentration step keeps.
H = 0.75
#: A determinant falls if its logarithm does so by more than this.
LEAST_FALL = 0.01
#: Vectors are whole numbers, this many to one.
UNIT = 1000
#: Vectors of the wider group that count along with a group's own.
PRIOR = 100
#: Least standard deviation of a statistic: for groups without any spread, far below that of
#: texts (0.05 and more).
FLOOR = 0.004
#: Chi-square distribution of five statistics: its median, the 97.5 % quantile within which
#: vectors are reweighted, what makes their covariance whole again, and the greatest squared
#: distance that is kept. Of normal vectors one in 10^12 is beyond it, none of a corpus of
#: 100 TB; no label has a part in it.
CHI_MEDIAN, CHI_NEAR, CONSISTENCY, LIMIT = 4.3515, 12.8325, 1.05553, 65.2386
#: Groups of both starts whose numbers are sent to the texts; with more of them, texts are
#: shuffled to their groups.
FEW_GROUPS = 10_000
_NAMES = ("x1", "x2", "x3", "x4", "x5")
_ZONE = ("level", "g1", "g2")
_GROUP = (*_ZONE, "start")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _pairs_hash(hashes: Column, distance: int) -> Column:
    """Hash of each element with the one ``distance`` behind it, as far as there are two."""
    length = F.size(hashes) - distance
    return F.when(length > 0, F.zip_with(
        F.slice(hashes, F.lit(1), length), F.slice(hashes, F.lit(distance + 1), length),
        lambda a, b: F.xxhash64(a, b),
    )).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks
    (characters that are neither letters, digits nor blanks), n_short (words of up to SHORT
    characters) and n_distinct (different words), all long.

    Null text has no words. A window of words is known by 64 bits of its words' hashes.
    """
    text = text_of(text_col)
    split = docs.select(
        *keep, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    return split.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long")
        .alias("n_symbols"),
        let(F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda own: (F.size(own) - F.size(F.array_distinct(own))).cast("long"))
        .alias("n_dup_lines"),
        _repeated(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_marks"),
        F.size(F.filter("_words", lambda w: F.length(w) <= SHORT)).cast("long").alias("n_short"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"))


def _repeated(words: Column) -> Column:
    """Words in windows that occur again: hashes of one, two, four and eight words, each
    bound once."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return let(one, lambda h1: let(_pairs_hash(h1, 1), lambda h2: let(
        _pairs_hash(h2, 2), lambda h4: let(_pairs_hash(h4, 4), _covered))))


def _covered(windows: Column) -> Column:
    # most texts repeat no window: they need no positions
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def spots(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: (
            _or_zero((F.get(s, i + 1)["h"] == x["h"]).cast("int"))
            + _or_zero((F.get(s, i - 1)["h"] == x["h"]).cast("int"))) > 0)
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    return F.when(F.size(windows) > F.size(F.array_distinct(windows)),
                  let(placed, lambda s: let(spots(s), length))).otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics as whole numbers. Shares are smoothed log-odds, so that texts
    without any marks or short words differ by their length instead of being all alike."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")

    def odds(part: str, of: Column) -> Column:
        return F.log((F.col(part) + 0.5) / (F.greatest(of - F.col(part), F.lit(0.0)) + 0.5))

    # texts without a word have no vector; they must not stop the others
    raw = (F.log(words), F.log(F.try_divide(chars, words)), odds("n_marks", chars), odds("n_short", words),
           F.log(F.col("n_distinct").cast("double")))
    return [F.round(x * UNIT).cast("long").alias(n) for x, n in zip(raw, _NAMES)]


def _levels(rows: DataFrame) -> DataFrame:
    """Every vector three times: for its language and source, its language, and all."""
    none = F.lit(None).cast("string")

    def zone(level: int, g1: Column, g2: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), g1.alias("g1"), g2.alias("g2"))

    return rows.select(F.explode(F.array(
        zone(2, F.col("lang"), F.col("source")), zone(1, F.col("lang"), none),
        zone(0, none, none))).alias("g"), *_NAMES).select("g.*", *_NAMES)


def _with(rows: DataFrame, params: DataFrame, on: tuple[str, ...]) -> DataFrame:
    p = params.select(*[F.col(c).alias(f"p_{c}" if c in on else c) for c in params.columns])
    equal = reduce(lambda a, b: a & b, (same(F.col(c), F.col(f"p_{c}")) for c in on))
    return rows.join(p, equal).drop(*[f"p_{c}" for c in on])


def _sent(params: DataFrame, few: bool) -> DataFrame:
    """What groups have, for the rows of texts: sent to them, so that no row is shuffled to its
    group, if groups are few."""
    return F.broadcast(params) if few else params


def _few(params: DataFrame) -> bool:
    """Whether the stored rows of groups are few enough to be sent to all tasks."""
    return params.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _deviations() -> list[Column]:
    return [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(_NAMES)]


def _distance() -> Column:
    """Squared Mahalanobis distance: each row k_ij of the inverse Cholesky factor gives one
    independent deviation; a whole number, a hundred to one, so that percentiles stay exact
    and bounded."""
    off = _deviations()
    own = [_sum([F.col(f"k_{i}_{j}") * off[j] for j in range(i + 1)]) for i in range(len(off))]
    return F.round(F.least(_sum([F.pow(y, F.lit(2)) for y in own]), F.lit(10000.0)) * 100
                   ).cast("long")


def _shrunk(groups: DataFrame) -> DataFrame:
    """Means of groups (level, g1, g2, start, n, ...) drawn towards those of the wider group,
    with weight n against PRIOR at any size. ``groups`` must be stored: it is read three times."""
    means = [c for c in groups.columns if c not in (*_GROUP, "n")]

    def towards(own: DataFrame, wider: DataFrame, on: tuple[str, ...]) -> DataFrame:
        far = wider.select(*on, *[F.col(c).alias(f"w_{c}") for c in means])
        return _with(own, far, on).select(*_GROUP, "n", *[
            ((F.col("n") * F.col(c) + PRIOR * F.col(f"w_{c}")) / (F.col("n") + PRIOR)).alias(c)
            for c in means])

    level = lambda k: groups.where(F.col("level") == k)
    by_lang = towards(level(1), level(0), ("start",))
    return level(0).unionByName(by_lang).unionByName(towards(level(2), by_lang, ("g1", "start")))


def _factors(means: DataFrame, scale: float = 1.0) -> DataFrame:
    """Centre m_i, inverse Cholesky factor k_ij and log of the determinant of the covariance.
    Groups are few; their rows carry the work, so that rows of texts need not."""
    p = len(_NAMES)
    out = means.withColumns({f"m_{i}": F.col(f"s_{i}") for i in range(p)})
    for i in range(p):
        for j in range(i + 1):
            part = (F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale
            if i == j:
                part = F.greatest(part, F.lit(0.0)) + F.lit((FLOOR * UNIT) ** 2)
            rest = [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]
            part = part - _sum(rest) if rest else part
            out = out.withColumn(
                f"l_{i}_{j}", F.sqrt(F.greatest(part, F.lit(1.0))) if i == j
                else part / F.col(f"l_{j}_{j}"))
    for i in range(p):
        before = {f"k_{i}_{j}": -_sum([
            F.col(f"l_{i}_{m}") * F.col(f"k_{m}_{j}") for m in range(j, i)
        ]) / F.col(f"l_{i}_{i}") for j in range(i)}
        out = out.withColumns(before | {f"k_{i}_{i}": 1 / F.col(f"l_{i}_{i}")})
    return out.select(
        *_GROUP, *[f"m_{i}" for i in range(p)],
        *[f"k_{i}_{j}" for i in range(p) for j in range(i + 1)],
        (2 * _sum([F.log(f"l_{i}_{i}") for i in range(p)])).alias("logdet"))


def _moments(rows: DataFrame) -> DataFrame:
    """Means of the statistics and of their products per group."""
    p = len(_NAMES)
    return rows.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(_NAMES[i]).alias(f"s_{i}") for i in range(p)],
        *[F.avg(F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"s_{i}_{j}")
          for i in range(p) for j in range(i + 1)])


def _fitted(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    return _factors(_shrunk(stored(_moments(rows), "mcd-means")), scale)


def _starts(rows: DataFrame) -> DataFrame:
    """Start 0: medians and median deviations. Start 1: mean and covariance of the vectors
    drawn in towards the medians, which sees how statistics go together."""
    p = len(_NAMES)
    first = F.lit(0).alias("start")
    medians = stored(rows.groupBy(*_ZONE).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.percentile(x, 0.5).alias(f"m_{i}") for i, x in enumerate(_NAMES)]
    ).select("*", first), "mcd-medians")
    middle = stored(_shrunk(medians), "mcd-middle")
    few = _few(middle)
    spread = stored(_with(rows, _sent(middle, few), _ZONE).groupBy(*_GROUP).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.percentile(F.round(F.abs(off)).cast("long"), 0.5).alias(f"d_{i}")
          for i, off in enumerate(_deviations())]), "mcd-spread")
    centre = stored(_with(
        middle.drop("n"), _shrunk(spread).drop("n"), _GROUP
    ).withColumns({f"d_{i}": F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FLOOR * UNIT))
                   for i in range(p)}), "mcd-centre")
    plain = centre.select(
        *_GROUP, *[f"m_{i}" for i in range(p)],
        *[(1 / F.col(f"d_{i}") if i == j else F.lit(0.0)).alias(f"k_{i}_{j}")
          for i in range(p) for j in range(i + 1)],
        F.lit(float("inf")).alias("logdet"))
    drawn = _with(rows, _sent(centre, few), _ZONE).select(*_ZONE, F.lit(1).alias("start"), *[
        (F.col(f"m_{i}") + F.col(f"d_{i}") * F.tanh(off / F.col(f"d_{i}"))).alias(x)
        for i, (x, off) in enumerate(zip(_NAMES, _deviations()))])
    return plain.unionByName(_fitted(drawn).withColumn("logdet", F.lit(float("inf"))))


def _nearest(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The H share of each group's vectors that is nearest to its centre."""
    few = _few(params)
    far = _measured(rows, params, few)
    cut = far.groupBy(*_GROUP).agg(F.percentile("d2", H).alias("cut"))
    return _with(far.select(*_GROUP, *_NAMES, "d2"), _sent(cut, few), _GROUP).where(
        F.col("d2") <= F.col("cut"))


def _concentrated(rows: DataFrame) -> DataFrame:
    """Estimates of all groups from both starts, when no determinant falls any more. Each step
    lowers one of them by LEAST_FALL at least and floors bound them, so that it ends."""
    step, params = 0, stored(_starts(rows).withColumn("step", F.lit(0)), "mcd-start")
    body = [c for c in params.columns if c not in _GROUP]
    while True:
        step += 1
        fresh = _fitted(_nearest(rows, params)).withColumn("step", F.lit(step))
        chosen = stored(params.select(*_GROUP, *body).unionByName(fresh).groupBy(*_GROUP).agg(
            F.min_by(F.struct(*body), F.struct("logdet", "step")).alias("best"),
            (F.max("logdet") - F.min("logdet")).alias("fall"),
        ).select(*_GROUP, "best.*", "fall"), "mcd-step")
        if chosen.where((F.col("step") == step) & (F.col("fall") > LEAST_FALL)).isEmpty():
            return chosen.select(*_GROUP, *body)
        params = chosen


def _scaled(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``params`` with ``middle``: the median distance of a group's vectors."""
    middle = stored(_measured(rows, params, _few(params)).groupBy(*_GROUP).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.percentile("d2", 0.5).alias("middle")),
        "mcd-distances")
    return stored(_with(params, _shrunk(middle).drop("n"), _GROUP), "mcd-scaled")


def _measured(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    return _with(rows, _sent(params, few), _ZONE).withColumn("d2", _distance())


def _normal_distance() -> Column:
    """Squared distance on the scale whose median the normal distribution has."""
    return _distance() / F.greatest("middle", F.lit(1.0)) * CHI_MEDIAN


def estimates(vectors: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate per group of vectors (lang, source,
    x1 to x5): level, g1, g2, start, centre, inverse factors, logdet, and the median distance
    of its vectors."""
    rows = stored(_levels(vectors), "mcd-vectors")
    found = _concentrated(rows)
    body = [c for c in found.columns if c not in _ZONE]
    raw = _scaled(rows, found.groupBy(*_ZONE).agg(
        F.min_by(F.struct(*body), F.struct("logdet", "start")).alias("best")
    ).select(*_ZONE, "best.*").withColumn("start", F.lit(0)))
    near = _with(rows, _sent(raw, _few(raw)), _ZONE).where(_normal_distance() <= CHI_NEAR)
    return _scaled(rows, stored(_fitted(near, CONSISTENCY), "mcd-weighted"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, kept, distance (null where
    base_failed).

    ``kept`` is false if base_failed, else whether the squared distance, scaled so that its
    median in the group is what the normal distribution has, is at most LIMIT. Null languages
    and sources are groups of their own. An empty table gives no rows, and a group of equal
    vectors keeps them all.
    """
    keys = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    stats = stored(statistics(keys, "id", "lang", "source").withColumn(
        "base_failed", base_failed()), "quality")
    vectors = stats.where(~F.col("base_failed")).select("lang", "source", *_vector())
    own = estimates(vectors).where(F.col("level") == 2).select(
        F.col("g1").alias("p_lang"), F.col("g2").alias("p_source"),
        F.struct("middle", *[f"m_{i}" for i in range(len(_NAMES))], *[
            f"k_{i}_{j}" for i in range(len(_NAMES)) for j in range(i + 1)]).alias("e"))
    of_group = same(F.col("lang"), F.col("p_lang")) & same(F.col("source"), F.col("p_source"))
    measured = stats.join(_sent(own, _few(own)), of_group, "left").select(*stats.columns, "e.*", *_vector())
    distance = F.when(~F.col("base_failed"), _normal_distance())
    return measured.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (distance <= LIMIT)).alias("kept"),
        F.round(distance, 3).alias("distance"), "n_marks", "n_short", "n_distinct")
