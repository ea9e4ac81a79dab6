"""Secret scans by patterns and a randomness test battery (numbered operator 7), in DataFrame functions alone.

Patterns give the base spans. Beside them, every long run of key characters is a candidate: its encoding is inferred from the
characters that it has, and three tests ask whether it could be uniform random in that alphabet (chi-squared uniformity, runs
about the median, serial correlation). Fisher's method combines their p-values into one.

Random strings seldom fail these tests, and short words may pass them too. So each candidate also has a likelihood ratio of the
uniform alphabet to ordinary words, in which characters keep their class (lower case, capitals, digits, signs). For a word its
mean is one at most, which makes it an e-value against "this is a word"; it counts as 0 if the battery rejects randomness. Within each band
of lengths the Benjamini-Hochberg rule for e-values then takes the k candidates of the m in the band whose e-values are m / (k rate)
or more, for the greatest such k. Of these an expected share of `rate` at most are words, however the candidates depend on each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Fixed patterns of the contract. Hex and access runs need their least length from the start: a run that is too short holds
#: no other match, so leaving it out changes nothing. A short assignment does take up its text, and is dropped later.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Length bands of candidates, by their least length.
BANDS = (20, 32, 64, 128)
#: Cells of e-values: tenths of their decimal logarithm, and the last for all greater ones.
CELLS = 400
#: Alphabets that an encoding is inferred from (a case each): the ratio is that of their mixture, so it is divided by them.
ALPHABETS = 9


def _matches(text: Column, kind: str, pattern: str, group: int) -> list[Column]:
    """Per match: characters between the last match's end and its start, its own characters, and what is kept of it."""
    none = F.array().cast("array<int>")
    found = F.regexp_like(text, F.lit(pattern))
    gaps = F.when(found, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))).otherwise(none)
    long = F.when(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))).otherwise(none)
    if kind == "random":
        kept = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    else:
        kept = F.when(found, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))).otherwise(none)
    return [gaps.alias(f"{kind}_gaps"), long.alias(f"{kind}_long"), kept.alias(f"{kind}_kept")]


def _spans(rows: DataFrame, kind: str) -> DataFrame:
    """row, kind (its place in KINDS), start, end, kept: the spans of a kind, from the lengths between and of matches."""
    gaps, long, kept = (f"{kind}_{x}" for x in ("gaps", "long", "kept"))
    one = rows.where(F.size(long) > 0).select("row", F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(long)).alias("gap"), F.col(long).alias("long"), F.col(kept).alias("kept"))).alias("pos", "m"))
    before = W.partitionBy("row").orderBy("pos")
    one = one.select("row", (F.sum(F.col("m.gap") + F.col("m.long")).over(before)).alias("end"), F.col("m.long").alias("long"), F.col("m.kept").alias("kept"))
    return one.select("row", F.lit(KINDS.index(kind)).alias("kind"), (F.col("end") - F.col("long")).alias("start"), "end", "kept")


def battery(candidates: DataFrame, token: str = "kept") -> DataFrame:
    """Adds to each candidate: encoding, n, the three tests' z values, p_random (their p-values combined), and word_bound (-log10
    of the chance of a word)."""
    c, out = F.col, candidates.withColumn("_body", F.regexp_replace(token, "=+$", ""))
    out = out.withColumn("encoding", F.when(c("_body").rlike("^[0-9]+$"), "decimal").when(c("_body").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(c("_body").rlike("^([a-z]+|[A-Z]+)$"), "letters").when(c("_body").rlike("^[A-Z2-7]+$"), "base32").when(c("_body").rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36").otherwise("base64"))
    sizes = {"decimal": 10, "hex": 16, "letters": 26, "base32": 32, "base36": 36, "base64": 64}
    out = out.withColumn("_k", F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[c("encoding")].cast("double"))
    out = out.withColumn("_x", F.transform(F.filter(F.split("_body", ""), lambda x: x != ""), lambda x: F.ascii(x)))
    out = out.withColumn("n", F.size("_x")).where("n >= 8")

    def kind(x: Column) -> Column:
        return F.when(x.between(97, 122), 0).when(x.between(65, 90), 1).when(x.between(48, 57), 2).otherwise(3)

    def place(x: Column) -> Column:  # digits, lower case, capitals, signs
        return F.when(x.between(48, 57), x - 48).when(x.between(97, 122), x - 87).when(x.between(65, 90), x - 29).otherwise(62 + (x % 2))

    def total(array: Column | str, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))

    out = out.withColumn("_p", F.transform("_x", lambda x: place(x).cast("double")))
    out = out.withColumn("_squares", total(F.array_distinct("_x"), lambda d: F.pow(F.size(F.filter("_x", lambda x: x == d)).cast("double"), F.lit(2.0))))
    chi, df = c("_squares") * c("_k") / c("n") - c("n"), c("_k") - 1
    out = out.withColumn("z_uniform", (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    out = out.withColumn("_mid", F.element_at(F.sort_array("_p"), ((c("n") + 1) / 2).cast("int"))).withColumn("_mean", total("_p", lambda x: x) / c("n"))
    out = out.withColumn("_high", F.transform("_p", lambda x: (x > c("_mid")).cast("int")))
    ahead, behind = (lambda a: F.slice(a, 2, c("n") - 1)), (lambda a: F.slice(a, 1, c("n") - 1))
    out = out.withColumn("_n1", total("_high", lambda x: x)).withColumn("_runs", 1 + total(F.zip_with(behind("_high"), ahead("_high"), lambda a, b: (a != b).cast("int")), lambda x: x))
    mean = 2 * c("_n1") * (c("n") - c("_n1")) / c("n") + 1
    out = out.withColumn("_mean_runs", mean).withColumn("_var_runs", (c("_mean_runs") - 1) * (c("_mean_runs") - 2) / (c("n") - 1))
    out = out.withColumn("z_runs", F.when(c("_var_runs") > 0, (c("_runs") - c("_mean_runs")) / F.sqrt("_var_runs")).otherwise(F.lit(99.0)))
    out = out.withColumn("_spread", total("_p", lambda x: (x - c("_mean")) * (x - c("_mean"))))
    out = out.withColumn("z_serial", F.when(c("_spread") > 0, total(F.zip_with(behind("_p"), ahead("_p"), lambda a, b: (a - c("_mean")) * (b - c("_mean"))), lambda x: x) / c("_spread") * F.sqrt(c("n").cast("double"))).otherwise(F.lit(99.0)))
    # In a word a character is of its neighbour's class with chance 0.95, and any of that class.
    width = lambda x: F.when(x < 2, 26.0).when(x == 2, 10.0).otherwise(4.0)
    out = out.withColumn("_kinds", F.transform("_x", kind))
    word = total(F.zip_with(behind("_kinds"), ahead("_kinds"), lambda a, b: F.log(F.when(a == b, 0.95).otherwise(0.05 / 3) / width(b))), lambda x: x)
    out = out.withColumn("word_bound", F.greatest(F.lit(0.0), (-(c("n") - 1) * F.log("_k") - word) / math.log(10)))
    out = out.withColumn("p_random", combined(*[two_sided(c(z)) for z in ("z_uniform", "z_runs", "z_serial")]))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def two_sided(z: Column) -> Column:
    """The chance of a normal deviate of |z| or more, by a logistic approximation that is right to 0.0003."""
    a = F.least(F.abs(z), F.lit(30.0))
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def combined(*p: Column) -> Column:
    """Fisher's method for three p-values: the chance of a chi-squared of 6 degrees of freedom of -2 sum(log p) or more."""
    half = -sum((F.log(F.greatest(x, F.lit(1e-300))) for x in p), F.lit(0.0))
    return F.exp(-half) * (1 + half + half * half / 2)


def threshold(counts: dict[int, int], m: int, rate: float) -> int | None:
    """From counts of e-values by cell (tenths of log10, rounded down) and the number m of all candidates: the least cell of those
    that are taken, or None. So many are taken, k, that each has an e-value of m / (k rate) or more."""
    above, least = 0, None
    for x in sorted(counts, reverse=True):
        above += counts[x]
        if x / 10 >= math.log10(m / (above * rate)):
            least = x
    return least


def discovered(candidates: DataFrame, rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """Candidates (with `battery`'s columns) that are taken for random, at a false-discovery rate of `rate` within each length band.
    None is that the battery rejects at `level`; but all count in their band."""
    band = F.element_at(F.filter(F.array(*map(F.lit, BANDS)), lambda b: b <= F.greatest("n", F.lit(BANDS[0]))), -1)
    weight = F.when(F.col("p_random") >= level, F.col("word_bound") - math.log10(ALPHABETS)).otherwise(F.lit(-1.0))
    cell = F.greatest(F.least(F.floor(weight * 10), F.lit(CELLS)), F.lit(-1)).cast("int")
    tested = candidates.withColumn("_band", band).withColumn("_cell", cell)
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("_band", "_cell").count().collect():  # bands times cells at most
        counts.setdefault(r["_band"], {})[r["_cell"]] = r["count"]
    passes = F.lit(False)
    for b, own in counts.items():
        least = threshold({x: n for x, n in own.items() if x >= 0}, sum(own.values()), rate)
        if least is not None:
            passes = passes | ((F.col("_band") == b) & (F.col("_cell") >= least))
    return tested.where(passes).drop("_band", "_cell")


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    base_sha256 is the SHA-256 of the base spans as `kind:start:end`, by start and then kind, joined by commas; spans holds
    all, with the kind `random` for those that the randomness tests add. Places are code points, ends exclusive. Null and
    empty texts have no spans (and the digest of an empty string). Repeated rows and null doc_ids each keep their row.
    """
    text = F.coalesce("text", F.lit(""))
    wanted = [(k, p, g) for k, p, g in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("random", CANDIDATE, 0))]
    columns = [x for k, p, g in wanted for x in _matches(text, k, p, g)]
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *columns), "matches")
    base = _spans(rows, "assign").where("kept >= 12").unionByName(_spans(rows, "access")).unionByName(_spans(rows, "hex")).select("row", "kind", "start", "end")
    tested = materialise(battery(_spans(rows, "random")), "candidates")
    every = base.unionByName(discovered(tested, rate).select("row", "kind", "start", "end"))
    listed = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))

    def joined(base_only: bool) -> Column:
        some = F.filter("s", lambda x: x["kind"] < 3) if base_only else F.col("s")
        name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
        return F.concat_ws(",", F.transform(F.coalesce(some, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: int) -> Column:
        return F.coalesce(F.size(F.filter("s", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")

    out = rows.select("row", "doc_id").join(listed, "row", "left")
    return out.select("doc_id", *[F.greatest(count(i), F.lit(0)).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))
