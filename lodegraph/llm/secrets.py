"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Patterns give the base spans.  Other runs of key-like characters are candidates; each is
tested in the alphabet of its inferred encoding: chi-squared uniformity of its symbols,
runs about the middle of the alphabet, and serial correlation of neighbouring symbols.

Two laws of the chi-squared statistic of n symbols in an alphabet of k are compared.  Drawn
evenly, it has k - 1 degrees of freedom.  Written text repeats its letters: with a sum of
squared shares of TEXT_SQUARES the statistic is noncentral by n (k TEXT_SQUARES - 1), so
text parts from random strings the more clearly, the longer the string and the larger the
alphabet.  The probability that text is as even as a candidate is its p-value;
Benjamini-Hochberg within each length class bounds the share of false discoveries by
FALSE_DISCOVERIES.  The three tests of randomness, combined by Fisher's sum, must not
reject.  Accepted candidates that touch no base span are added with kind "random".  No
figure depends on which or how many other words a table holds, but for the number of tests.

Defined results: null text counts as empty; texts without spans have counts 0 and empty
spans; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import stored

# The base patterns, and the key-like characters of candidates.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
FALSE_DISCOVERIES = 0.01
REJECT = 0.001
# Sums of squared symbol shares: of letters in written text (0.065 in English, more in most
# other languages), and of digits in numbers written with hexadecimal symbols.
TEXT_SQUARES, NUMBER_SQUARES = 0.06, 0.1
LOG_BINS = 400

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    ("upper_hex", "^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567="),
    ("upper36", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("lower36", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64url", "^[A-Za-z0-9_=-]+$", _DIGITS + _UPPER + _LOWER + "-_="),
    ("base64", ".", _DIGITS + _UPPER + _LOWER + "+/-_="),
)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<start, end, value>: leftmost non-overlapping matches in code points.

    value is the given group.  Starts are sums over the pieces between matches; texts
    without a match skip them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(whole))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("len"), value.alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc, part):
        start = acc["at"] + part["gap"]
        end = start + part["len"]
        span = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _spans(found: Column, kind: str) -> Column:
    """array<start, order, end> so that sorting gives the order of the report."""
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end")),
    )


def report(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["end"])), ","
    )


def encoding(value: Column) -> Column:
    """The first encoding of ENCODINGS whose alphabet holds all of value, as name and alphabet."""
    chosen = None
    for name, pattern, alphabet in ENCODINGS:
        pair = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))
        chosen = F.when(value.rlike(pattern), pair) if chosen is None else chosen.when(value.rlike(pattern), pair)
    return chosen


def _normal_cdf(z: Column) -> Column:
    """Normal distribution function, by a polynomial with an error below 1e-7.

    z is bound as the one element of an array, so that plans name it once.
    """
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def value(z):
        sums = F.transform(
            F.array(1 / (1 + 0.2316419 * F.abs(z))), lambda t: sum(c * F.pow(t, F.lit(i + 1)) for i, c in enumerate(terms))
        )
        return F.transform(
            F.array(F.exp(-z * z / 2) / 2.5066282746310002 * sums[0]), lambda tail: F.when(z >= 0, 1 - tail).otherwise(tail)
        )[0]

    return F.transform(F.array(z), value)[0]


def _chi_squared_cdf(x: Column, df: Column) -> Column:
    """Chi-squared distribution function, by the cube-root transformation of Wilson and Hilferty."""
    spread = 2 / (9 * df)
    return _normal_cdf((F.cbrt(x / df) - 1 + spread) / F.sqrt(spread))


def _both_tails(z: Column) -> Column:
    return F.greatest(2 * (1 - _normal_cdf(F.abs(z))), F.lit(1e-12))


def tested(candidates: DataFrame) -> DataFrame:
    """candidates (value, ...) with encoding, n, chi_squared and the p-values of each value.

    p_even, p_runs, p_serial: of the three tests, when symbols are drawn at random; fisher:
    Fisher's sum of their logarithms; p_text: probability that written text of this length
    is as even.  Stored: filters on the result must not be pushed into the tests.
    """
    rows = candidates.withColumn("_e", encoding(F.col("value")))
    rows = rows.select(
        *candidates.columns,
        F.col("_e.name").alias("encoding"),
        F.length("value").cast("double").alias("n"),
        F.length("_e.alphabet").cast("double").alias("k"),
        F.split("value", "").alias("chars"),
        F.col("_e.alphabet").alias("alphabet"),
    )
    rows = rows.withColumn(
        "squares",
        F.expr(
            "aggregate(array_distinct(chars), 0D, (s, c) -> "
            "s + power(length(value) - length(replace(value, c, '')), 2))"
        ),
    ).withColumn("at", F.expr("transform(chars, c -> cast(instr(alphabet, c) as double))"))
    rows = rows.withColumn("mean", F.expr("aggregate(at, 0D, (s, x) -> s + x) / n"))
    rows = rows.withColumn("high", F.expr("transform(at, x -> if(x > k / 2, 1, 0))"))
    rows = rows.selectExpr(
        *candidates.columns,
        "encoding",
        "n",
        "k",
        "k * squares / n - n as chi_squared",
        "aggregate(at, 0D, (s, x) -> s + power(x - mean, 2)) as variance",
        "aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at)), "
        "(a, b) -> (a - mean) * (b - mean)), 0D, (s, x) -> s + x) as lagged",
        "cast(aggregate(high, 0, (s, x) -> s + x) as double) as ones",
        "1D + aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high)), "
        "(a, b) -> if(a <> b, 1, 0)), 0, (s, x) -> s + x) as runs",
    )
    rows = rows.withColumn("_m", F.expr("2 * ones * (n - ones) / n"))
    runs_sd = F.expr("sqrt(greatest(_m * (_m - 1) / (n - 1) * 1D, 1e-9))")
    mixed = (F.col("ones") > 0) & (F.col("ones") < F.col("n"))
    df, x = F.col("k") - 1, F.col("chi_squared")
    squares = F.when(F.col("encoding").isin("hex", "upper_hex"), F.lit(NUMBER_SQUARES)).otherwise(F.lit(TEXT_SQUARES))
    # A noncentral law with offset o is near a chi-squared law stretched by its variance over its mean.
    offset = F.greatest(F.col("n") * (F.col("k") * squares - 1), F.lit(0.0))
    stretch = (df + 2 * offset) / (df + offset)
    rows = rows.select(
        *candidates.columns,
        "encoding",
        "n",
        "chi_squared",
        F.greatest(1 - _chi_squared_cdf(x, df), F.lit(1e-12)).alias("p_even"),
        F.when(mixed, _both_tails((F.col("runs") - F.col("_m") - 1) / runs_sd)).otherwise(F.lit(1e-12)).alias("p_runs"),
        F.when(F.col("variance") > 0, _both_tails(F.col("lagged") / F.col("variance") * F.sqrt("n")))
        .otherwise(F.lit(1e-12))
        .alias("p_serial"),
        F.greatest(_chi_squared_cdf(x / stretch, (df + offset) / stretch), F.lit(1e-39)).alias("p_text"),
    )
    return stored(
        rows.withColumn("fisher", -2 * (F.log("p_even") + F.log("p_runs") + F.log("p_serial"))), "tests"
    )


def accepted(tests: DataFrame) -> DataFrame:
    """Rows of tests that pass the false-discovery control of their length class and look random."""
    rows = tests.withColumn("class", F.least(F.floor(F.log2(F.col("n")) * 2), F.lit(30)).cast("int"))
    rows = rows.withColumn("bin", F.least(F.floor(-F.log10("p_text") * 10), F.lit(LOG_BINS)).cast("int"))
    sizes = rows.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("c"))  # at most 31 x 401 rows
    down = Window.partitionBy("class").orderBy(F.desc("bin"))
    every = Window.partitionBy("class")
    cut = (
        sizes.select(
            "class", "bin", F.sum("c").over(down).alias("rank"), F.sum("c").over(every).alias("all")
        )
        .filter(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= FALSE_DISCOVERIES * F.col("rank"))
        .groupBy("class")
        .agg(F.min("bin").alias("least_bin"))
    )
    # Fisher's sum of three p-values exceeds x with probability exp(-x / 2) (1 + x / 2 + x^2 / 8).
    total = F.col("fisher")
    consistent = F.exp(-total / 2) * (1 + total / 2 + total * total / 8) > REJECT
    return rows.join(F.broadcast(cut), "class").filter((F.col("bin") >= F.col("least_bin")) & consistent)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, n_random for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        _spans(assign, "assign").alias("assign"),
        _spans(matches(text, ACCESS), "access").alias("access"),
        _spans(matches(text, HEX), "hex").alias("hex"),
        matches(text, CANDIDATE).alias("candidates"),
    )
    found = stored(found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))), "spans")
    free = F.filter(
        F.col("candidates"),
        lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    candidates = found.filter(F.size("candidates") > 0).select("row", F.explode(free).alias("c")).select("row", "c.*")
    extra = (
        accepted(tested(candidates))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("order"), "end")).alias("extra"))
    )
    rows = found.join(extra, "row", "left")
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")
    every = F.array_sort(F.concat("base", F.coalesce("extra", none)))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        report(F.col("base")).alias("base"),
        report(every).alias("spans"),
        F.size(F.coalesce("extra", none)).cast("long").alias("n_random"),
    )
