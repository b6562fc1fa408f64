"""Document quality rules with host-level verdicts, in DataFrame functions only.

Words are maximal runs of anything but the six ASCII white-space characters. Each
document is measured once; rule failures are summed by host (partial sums before
the shuffle, so a hot host is a handful of rows), and host rates are shrunk towards
an empirical beta prior fitted over all hosts. A host is rejected if its failure
rate is, with a probability of ``confidence``, above the prior's mean; it then loses
those of its documents that fail a soft rule. Elsewhere such documents stay.

The prior's mean is the rate over all documents. Its variance is that of the hosts'
rates less what their sizes alone explain; the prior weighs as many documents as
that variance says, at least one and at most MAX_PRIOR_DOCS, so that a large host
is judged by its own record even where hosts hardly differ.

Defined cases: null text has no words, lines or symbols and fails the base rules;
a null host gets no host verdict; rows are judged one by one, repeated or not; texts
of any length are measured whole; measures and verdicts replace input columns of
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.staging import stage

WHITE = " \t\n\x0b\x0c\r"
_WHITE_RUN = r"[ \t\n\x0B\f\r]+"
#: Words of a repeated window.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Soft rules: symbols a word, duplicated lines a word, mean word length. A table whose cells are words has a bar between
#: any two of them, so that half of its words are symbols; only more than that is noise.
MAX_SYMBOLS_A_WORD = 0.5
MAX_DUP_LINES_A_WORD = 0.1
WORD_LENGTHS = (2.0, 12.0)
#: Probability that a rejected host's rate is above the mean, and the normal deviate that stands for it.
CONFIDENCE = 0.8
MAX_PRIOR_DOCS = 100
#: Up to so many rejected hosts are broadcast; more are joined with salted keys.
MAX_BROADCAST_HOSTS = 200_000
SALTS = 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_column(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(bare) > 0, F.split(bare, _WHITE_RUN, -1)).otherwise(F.array().cast("array<string>"))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with MEASURES and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = "__words", "__hashes", "__sorted", "__starts"
    words, hashes, ordered, starts = map(F.col, at)
    window = lambda i: F.slice(words, i + 1, WINDOW)
    same = lambda a, b: (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    longs = F.array().cast("array<bigint>")
    out = df.withColumn(at[0], words_column(text))
    out = out.withColumn(at[1], F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))).otherwise(longs))
    out = out.withColumn(at[2], F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn(at[3], F.when(ordered.isNotNull(), F.array_sort(F.transform(F.filter(
        F.transform(ordered, lambda x, k: F.struct(
            x["i"].alias("i"),
            (((k > 0) & same(x, F.get(ordered, k - 1))) | ((k < F.size(ordered) - 1) & same(x, F.get(ordered, k + 1)))).alias("again"))),
        lambda x: x["again"]), lambda x: x["i"]))))
    covered = F.when(F.size(starts) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("long"),
        lambda n, k: n + F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, k) - F.get(starts, k - 1))))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("n_repeat_words", covered)
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__lines": lines,
    })
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*at, "__lines")


def soft_failed() -> Column:
    """Whether a measured document fails a soft rule."""
    n = F.col("n_words")
    length = F.col("word_chars") / F.when(n > 0, n)
    return F.coalesce((F.col("n_symbols") > MAX_SYMBOLS_A_WORD * n) | (F.col("n_dup_lines") > MAX_DUP_LINES_A_WORD * n)
                      | (length < WORD_LENGTHS[0]) | (length > WORD_LENGTHS[1]), F.lit(False))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight, in documents, of the beta prior over the rates of (n_docs, n_failed) hosts."""
    rate = F.col("n_failed") / F.col("n_docs")
    failed, docs, mean_rate, square, inverse = hosts.agg(F.sum("n_failed"), F.sum("n_docs"), F.avg(rate), F.avg(rate * rate), F.avg(1 / F.col("n_docs"))).first()
    mean = failed / docs if docs else 0.0
    spread = mean * (1 - mean)
    variance = square - 2 * mean * mean_rate + mean * mean - spread * inverse if docs else 0.0
    weight = spread / variance - 1 if variance > 0 else MAX_PRIOR_DOCS
    return mean, min(max(weight, 1.0), float(MAX_PRIOR_DOCS))


def host_rates(measured: DataFrame, host_col: str, confidence: float = CONFIDENCE) -> DataFrame:
    """Documents, failures, shrunken failure rate and verdict of each host that is not null."""
    failed = (F.col("base_failed") | soft_failed()).cast("long")
    hosts = stage(measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("__host"))
                  .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed")), "hosts")
    mean, weight = prior(hosts)
    rated = hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n_docs") + F.lit(weight + 1)))
    return rated.withColumn("rejected", F.col("host_rate") - F.lit(NormalDist().inv_cdf(confidence)) * deviation > F.lit(mean))


def judge(measured: DataFrame, host_col: str = "source", confidence: float = CONFIDENCE,
          max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """A measured table (staged, as it is read twice) with ``kept``."""
    bad = host_rates(measured, host_col, confidence).where("rejected").select("__host", F.lit(True).alias("__bad"))
    if bad.limit(max_broadcast + 1).count() <= max_broadcast:
        joined = measured.join(F.broadcast(bad), measured[host_col] == bad["__host"], "left")
    else:
        salted = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = measured.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (dealt[host_col] == salted["__host"]) & (F.col("__deal") == F.col("__salt")), "left").drop("__deal", "__salt")
    lost = F.col("base_failed") | (F.coalesce("__bad", F.lit(False)) & soft_failed())
    return joined.withColumn("kept", ~lost).drop("__host", "__bad")


def apply_rules(df: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None,
                confidence: float = CONFIDENCE) -> DataFrame:
    """Measures and verdict of every row, with the columns ``carry`` (all by default)."""
    keep = [c for c in (df.columns if carry is None else carry) if c not in (*MEASURES, "base_failed", "kept")]
    host = "__of" if host_col not in keep else host_col
    measured = measure(df.withColumn(host, F.col(host_col)) if host == "__of" else df, text_col)
    staged = stage(measured.select(*keep, *([host] if host not in keep else []), *MEASURES, "base_failed"), "measures")
    return judge(staged, host, confidence).select(*keep, *MEASURES, "base_failed", "kept")
