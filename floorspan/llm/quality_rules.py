"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each text gets counts (``metrics``) and, from them, the rules' values, each the larger the worse.  A rule
rejects a text of a stratum (its language) whose value is over the stratum's cutoff.  Cutoffs come from a
labelled holdout of good texts: for each rule, stratum and cutoff of the rule's fixed grid, the n good texts
and the k of them that the cutoff would reject give the exact binomial probability P(X <= k), X ~ B(n, alpha).
A cutoff passes where that is at most delta divided by the number of tests (Bonferroni over all rules,
strata and cutoffs), so that with probability 1 - delta every passing cutoff rejects fewer than alpha of the
good texts of its stratum; the strictest passing one is used.  A stratum with too few good texts to show this
for a rule has no cutoff for it, and the rule rejects nothing there: with the values below, a stratum needs about 2,050 good
texts (of which none is rejected), so that small tables get no cutoff at all.

Repeated 8-word windows are found inside each row: word hashes are paired to hashes of 2, 4 and 8 words, and
only rows with a repeated hash sort theirs.  Nothing but the narrow counts leaves a row, and those are cut
off by a checkpoint, so that texts are read once.

Defined cases: null and empty texts have counts 0 and fail; a null language is a stratum of its own; labels
of repeated or unknown ids, null or other than 1 count once or not at all; ids labelled both good and bad
aren't good; ties (a value equal to the cutoff) pass; repeated rows each get their verdict; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.llm._common import SPACE, cut, table

ALPHA, DELTA = 0.004, 0.05
WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"
#: For each rule: its value from the counts, and the grid of cutoffs.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(1, word_chars)", (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)),
    "dup_lines": ("n_dup_lines / greatest(1, n_lines)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeats": ("n_repeat_words / greatest(1, n_words)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)),
    "long_words": ("word_chars / greatest(1, n_words)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
    "short_words": ("-word_chars / greatest(1, n_words)", (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.5)),
}


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    d = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("null")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("raw")
    )
    d = d.withColumn("t", F.btrim("raw", blank)).withColumn("lines", F.filter(F.split("raw", "\n"), lambda x: F.btrim(x, blank) != ""))
    d = d.select(
        "id",
        "stratum",
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("t") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("t", SPACE), lambda w: F.xxhash64(w))).alias("h"),
    )
    kept = ["id", "stratum", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    d = d.select(*kept, F.size("h").alias("n"), "h")
    for gap in (1, 2, 4):  # hashes of 2, 4 and 8 words
        m = F.greatest(F.size("h") - gap, F.lit(0))
        d = d.select(*kept, "n", F.zip_with(F.slice("h", 1, m), F.slice("h", F.lit(gap + 1), m), lambda a, b: F.xxhash64(a, b)).alias("h"))
    d = d.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    pairs = F.sort_array(F.zip_with("h", F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1))), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    d = d.select(*kept, "n", F.when(F.col("again"), pairs).alias("s"))
    like = lambda x, i: F.coalesce(x["h"] == F.get(F.col("s"), i)["h"], F.lit(False))
    same = F.filter("s", lambda x, i: like(x, i - 1) | like(x, i + 1))
    d = d.select(*kept, "n", F.sort_array(F.transform(same, lambda x: x["p"])).alias("p"))
    # the words that the windows cover: each window adds those before the next window begins
    covered = F.aggregate(F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda acc, x: acc + x)
    return d.select("id", "stratum", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(F.when(F.col("p").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back to x >= 1; right to about 1e-13."""
    y = x + F.lit(8.0)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    i2 = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - i2 * (F.lit(1 / 360) - i2 * (F.lit(1 / 1260) - i2 * F.lit(1 / 1680)))) / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ B(n, p): the term at k times the sum of the ratios of the terms below it; 1 where k >= n * p."""
    kd, nd = k.cast("double"), n.cast("double")
    term = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    # terms fall at least geometrically below k < n * p; those left out are under 1e-30 of the sum
    steps = F.least(k, F.ceil(F.sqrt(nd * p * (1 - p)) * 12 + 60).cast("long"))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        i = kd - j + 1
        t = acc["t"] * i * (1 - p) / ((nd - i + 1) * p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), one, add)["s"]).otherwise(1.0)
    return F.when(kd >= nd * p, 1.0).otherwise(F.exp(term) * total)


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """(stratum, one column of each rule's cutoff, null where none passes) from counts and labels (i, y)."""
    good = labels.filter("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = 1 and z = 1").select(F.col("i").alias("id"))
    known = counts.filter("n_words > 0").join(good, "id")
    def of(rule: str, value: str, grid: tuple[float, ...]) -> Column:
        cuts = F.array(*map(F.lit, grid))
        return F.struct(F.lit(rule).alias("rule"), F.size(F.filter(cuts, lambda c: c < F.expr(value))).alias("over"), cuts.alias("grid"))

    each = known.select("stratum", F.explode(F.array(*[of(r, v, grid) for r, (v, grid) in rules.items()])).alias("x"))
    # texts by the number of cutoffs that they exceed: a few rows for each rule and stratum
    sums = each.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.over").alias("over")).agg(F.count("*").alias("m"), F.first("x.grid").alias("grid"))
    tests = sums.select("stratum", "rule", "over", "m", F.posexplode("grid").alias("at", "cutoff"))
    tests = tests.groupBy("stratum", "rule", "at", "cutoff").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("over") > F.col("at"), F.col("m")).otherwise(0)).alias("k"))
    strata = max(1, sums.agg(F.count_distinct("stratum")).first()[0])
    most = delta / (strata * sum(len(g) for _, g in rules.values()))
    passing = tests.filter(binomial_at_most(F.col("k"), F.col("n"), alpha) <= most)
    return passing.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])


def judge(counts: DataFrame, found: DataFrame, rules: dict = RULES) -> DataFrame:
    """The counts with base_failed, kept and the names of the rules that reject the row."""
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    hit = F.array_compact(F.array(*[F.when(F.expr(v) > F.col(f"cut_{r}"), F.lit(r)) for r, (v, _) in rules.items()]))
    d = counts.join(found, "stratum", "left").withColumn("base_failed", base).withColumn("rules_hit", hit)
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("rules_hit") == 0))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    counts = cut(metrics(docs, id_col, text_col, stratum_col))
    return judge(counts, cutoffs(counts, labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules_hit", ",").alias("rules_hit"))
