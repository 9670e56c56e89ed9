"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

Everything here is DataFrame expressions; no Python runs on the executors. Positions follow from the lengths of what
split() leaves between matches and of what regexp_extract_all() returns, both leftmost and non-overlapping.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shielded, table

#: The kinds in order, their patterns, the group whose length counts and that length's minimum.
#: The runs of access and hex are maximal, so matching only long ones finds the same.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A cheap test that a text may hold a match of the rule.
HINTS = {"assign": r"(?i)(?:word|wd|secret|token|key)[\x22']?\x20*[:=]", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
#: Runs of these characters, of at least this length, are scored by the models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Ordinary samples, from all documents; those long enough to be secrets count only without a digit.
ORDINARY, LONG = r"[A-Za-z0-9_-]{4,}", 16
#: Random strings of each form made for the other model.
SAMPLE_RANDOM = 4096
#: Natural-log ratio from which a run counts as random, in all and for each character.
RATIO, RATIO_EACH = 12.0, 0.6
#: Characters of the models: digits, letters, and the five others of CANDIDATE.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
_CHUNK = 128


def _running(values: Column) -> Column:
    """0, v1, v1+v2, ... of a short array."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def running(values: Column) -> Column:
    """Sums of all values before each one (one entry more than values), by chunks: near-linear in their number."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)))
    bases = _running(F.transform(chunks, total))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(chunks, bases, lambda c, b: F.when(c.isNotNull(), F.transform(F.slice(_running(c), 1, F.greatest(F.size(c), F.lit(1))), lambda v: v + b)).otherwise(F.array().cast("array<int>")))))


def spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Array of (start, end, kind) of the pattern's matches that satisfy keep(match); code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # gap and match lengths alternate: the running sum before a match is its start
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own"), m.alias("m")))
    starts = running(F.transform(steps, lambda s: s["gap"] + s["own"]))
    placed = F.zip_with(steps, starts, lambda s, b: F.struct((b + s["gap"]).alias("start"), (b + s["gap"] + s["own"]).alias("end"), s["m"].alias("m")))
    good = F.filter(placed, lambda p: p["m"].isNotNull() & keep(p["m"]))
    return F.transform(good, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind")))


_NONE = "array<struct<start:int,end:int,kind:string>>"


def _none() -> Column:
    return F.array().cast(_NONE)


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind, pattern, group, least in RULES:
        keep = (lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n) if group else (lambda m, n=least: F.length(m) >= n)
        out[kind] = F.when(F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(HINTS[kind]), spans(text, kind, pattern, keep)).otherwise(_none())
    return out


def _codes(text: Column) -> Column:
    """Places of the characters in ALPHABET, from 0; text holds no other characters."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def training_samples(docs: DataFrame, text_col: str = "text", made: int = SAMPLE_RANDOM) -> DataFrame:
    """Labelled samples: sample, random (boolean), n (how often it occurs).

    Ordinary: runs of 4 or more letters, digits, _ and - in all documents, but for those of 16 or more that hold a digit,
    which may be secrets themselves. Random: `made` each of hexadecimal, base64 and upper-case base32-like strings
    derived from SHA-256. Null and empty texts give none.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ORDINARY), F.lit(0))).alias("sample"))
    ordinary = runs.groupBy("sample").agg(F.count("*").alias("n"))
    ordinary = ordinary.where((F.length("sample") < LONG) | ~F.col("sample").rlike("[0-9]")).select("sample", F.lit(False).alias("random"), "n")
    digest = F.sha2(F.col("id").cast("string"), 256)
    forms = F.array(F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(F.upper(F.translate(digest, "0123456789", "GHJKLMNPQR")), 1, 20), F.upper(F.translate(F.substring(digest, 9, 20), "01abc", "XYZ89")))
    random = docs.sparkSession.range(made).select(F.explode(forms).alias("sample"), F.lit(True).alias("random"), F.lit(1).cast("long").alias("n"))
    return ordinary.union(random)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, random against ordinary, by place in ALPHABET; add-one smoothed.

    samples: sample, random, n (its weight).
    What reaches the driver is one row for each pair of characters and label: a fixed number.
    """
    k = len(ALPHABET)
    codes = _codes(F.col("sample"))
    pair = F.zip_with(F.slice(F.col("c"), 1, F.size("c") - 1), F.slice(F.col("c"), 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * k + b)
    counted = samples.where(F.length("sample") > 1).select(codes.alias("c"), "random", "n").select("random", "n", F.explode(pair).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = {True: [0] * (k * k), False: [0] * (k * k)}
    for row in counted.collect():
        counts[row["random"]][row["pair"]] = row["n"]
    logs = {}
    for label, c in counts.items():
        row_sums = [sum(c[a * k : (a + 1) * k]) for a in range(k)]
        logs[label] = [math.log((c[i] + 1) / (row_sums[i // k] + k)) for i in range(k * k)]
    return [round(r - o, 6) for r, o in zip(logs[True], logs[False], strict=True)]


def log_ratio(run: Column, model: list[float]) -> Column:
    """Sum of the model's ratios over the characters' pairs."""
    k = len(ALPHABET)
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    step = F.aggregate(
        _codes(run), F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("at"), F.when(acc["at"] < 0, acc["sum"]).otherwise(acc["sum"] + F.element_at(ratios, acc["at"] * k + c + 1)).alias("sum")),
    )
    return step["sum"]


def scan(docs: DataFrame, model: list[float], text_col: str = "text", ratio: float = RATIO, ratio_each: float = RATIO_EACH) -> DataFrame:
    """docs with _base and _spans: arrays of (start, end, kind), ordered by start, then kind as listed.

    _base has what the rules find, _spans also the runs that the models hold random (kind "markov"). Base spans are cut
    out of the runs first; what is left of one, before, between or behind them, is a run of its own. A null text is empty and has no spans. One map over the scan: no shuffle, no Python. Columns of docs named
    _base or _spans give way, others stay as they are.
    """
    return shielded(docs, [text_col], lambda d: _scanned(d, model, text_col, ratio, ratio_each))


def _masked(text: Column, cut: Column) -> Column:
    """text with blanks in place of the spans, which are ordered by start and may overlap; places stay the same."""
    state = F.aggregate(
        cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))).alias("out"),
        ),
    )
    return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))


def _scanned(docs: DataFrame, model: list[float], text_col: str, ratio: float, ratio_each: float) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordinal = {kind: i for i, kind in enumerate([r[0] for r in RULES] + ["markov"])}
    found = docs.withColumn("_kinds", F.struct(*[c.alias(k) for k, c in base_spans(text).items()]))
    order = lambda s: F.struct(s["start"].alias("start"), F.element_at(F.create_map(*[F.lit(x) for p in ordinal.items() for x in p]), s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))
    sort = lambda a: F.transform(F.array_sort(F.transform(a, order)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.withColumn("_base", F.concat("_kinds.assign", "_kinds.access", "_kinds.hex"))
    found = found.withColumn("_base", F.when(F.size("_base") > 1, sort(F.col("_base"))).otherwise(F.col("_base"))).drop("_kinds")
    random = lambda m: (log_ratio(m, model) >= ratio) & (log_ratio(m, model) >= ratio_each * F.length(m))
    found = found.withColumn("_masked", F.when(F.size("_base") > 0, _masked(text, F.col("_base"))).otherwise(text))
    found = found.withColumn("_random", F.filter(F.regexp_extract_all("_masked", F.lit(CANDIDATE), F.lit(0)), random))
    more = spans(F.col("_masked"), "markov", CANDIDATE, random)
    found = found.withColumn("_more", F.when(F.size("_random") > 0, more).otherwise(_none())).drop("_random", "_masked")
    return found.withColumn("_spans", F.when(F.size("_more") > 0, sort(F.concat("_base", "_more"))).otherwise(F.col("_base"))).drop("_more")


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan() replaced by `mark`; overlapping spans are replaced once. A null text stays null.

    Other columns, whatever their names, stay as they are.
    """
    return shielded(docs, [text_col], lambda d: _redacted(d, model, text_col, mark))


def _redacted(docs: DataFrame, model: list[float], text_col: str, mark: str) -> DataFrame:
    found = scan(docs, model, text_col)
    t = F.col(text_col)
    # outermost ends so far, to cut what overlaps
    state = F.aggregate(
        F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    rest = F.concat(F.col("_state.out"), F.substring(t, F.col("_state.at") + 1, F.length(t)))
    out = found.withColumn("_state", F.when(F.size("_spans") > 0, state)).withColumn(text_col, F.when(F.col("_state").isNotNull(), rest).otherwise(t))
    return out.select(*docs.columns)


def _joined(spans_col: str) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(training_samples(docs)))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("_base"), 256).alias("base_sha256"), _joined("_spans").alias("spans"))
