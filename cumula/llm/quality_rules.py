"""Rule metrics of a text and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumula.llm.common import durable

#: Buckets of the n-gram hash: the size of the only table that is broadcast.
BUCKETS = 1 << 16
#: Share of the raw multinomial in the trusted one: an n-gram never seen in trusted text has the ratio ln(FLOOR_SHARE).
FLOOR_SHARE = 0.1
#: A text goes if its mean log ratio lies so many standard errors, and so much more, below the mean of trusted text.
ERRORS, MARGIN = 4.0, 0.05
SPACES, SYMBOLS, WINDOW = " \t\n\u000b\f\r", r"[#*$%&|<>]", 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def words_of(text: Column) -> Column:
    """Words as runs of anything but ASCII white space; null gives no word."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _pairs(h: Column) -> Column:
    """A hash of every two neighbouring word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def _bucket(x: Column) -> Column:
    return F.pmod(x, F.lit(BUCKETS)).cast("int")


def ratio_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row (one, log_ratios, expected, spread) of the n-gram buckets.

    ``docs`` is (doc_id, text), ``trusted`` a table of distinct doc_id. The raw
    multinomial counts every document, the trusted one those named, and
    log_ratios[b] is ln((1 - FLOOR_SHARE) * p_trusted(b) / p_raw(b) + FLOOR_SHARE).
    ``expected`` and ``spread`` are the mean and the deviation of the ratio over
    the n-grams of each half of the trusted documents, by the table of the other
    half: what trusted text that the table has not seen scores. So the verdict
    does not hang on how much trusted text there is. Without any, all are 0.
    """
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    marked = docs.join(trusted.withColumn("_t", half).hint("merge"), "doc_id", "left")  # labels grow with the documents
    hashed = marked.select("_t", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select("_t", F.explode(F.concat("h", _pairs(F.col("h")))).alias("x")).select("_t", _bucket(F.col("x")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.col("_t") == 0).alias("t0"), F.count_if(F.col("_t") == 1).alias("t1"))
    spread = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "t0", "t1"])
    one = spread.agg(F.sum("raw").alias("raws"), F.sum("t0").alias("n0"), F.sum("t1").alias("n1"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "t0", "t1"))).alias("b"))

    def ratio(x: Column, count: Column, total: Column) -> Column:
        share = (x["raw"] + 1.0) / (F.col("raws") + BUCKETS)
        return F.when(total > 0, F.ln((1 - FLOOR_SHARE) * count / total / share + FLOOR_SHARE)).otherwise(0.0)

    n, both = F.col("n0") + F.col("n1"), (F.col("n0") > 0) & (F.col("n1") > 0)
    each = F.transform(
        "b",
        lambda x: F.struct(
            ratio(x, x["t0"] + x["t1"], n).alias("all"),
            F.when(both, ratio(x, x["t0"], F.col("n0"))).otherwise(ratio(x, x["t0"] + x["t1"], n)).alias("r0"),
            F.when(both, ratio(x, x["t1"], F.col("n1"))).otherwise(ratio(x, x["t0"] + x["t1"], n)).alias("r1"),
            x["t0"].alias("t0"),
            x["t1"].alias("t1"),
        ),
    )
    moment = lambda k: F.aggregate("e", F.lit(0.0), lambda a, x: a + x["t0"] * F.pow(x["r1"], k) + x["t1"] * F.pow(x["r0"], k)) / F.greatest(n, F.lit(1))
    seen = one.select("*", each.alias("e")).select(F.transform("e", lambda x: x["all"]).alias("log_ratios"), moment(1).alias("expected"), moment(2).alias("square"))
    return durable(seen.select(F.lit(1).alias("one"), "log_ratios", "expected", F.sqrt(F.greatest(F.col("square") - F.pow("expected", 2), F.lit(0.0))).alias("spread")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the rows labelled of high quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def base_metrics(docs: DataFrame) -> DataFrame:
    """(row, h, p, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) from (row, text).

    A window of five words that occurs twice or more marks all its words, the
    first occurrence included. Windows are compared by 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = docs.select("row", "text", words_of(F.col("text")).alias("words"))
    a = split.select(
        "row",
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(F.contains(text, F.lit("\n")), lines).alias("lines"),
    )
    h, p, n = F.col("h"), F.col("p"), F.size("h")
    dup_lines = F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines")
    b = a.select("row", "h", "word_chars", "n_symbols", dup_lines, _pairs(h).alias("p"))
    win = F.transform(F.slice(p, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(p, i + 2), F.get(h, i + 4)))
    b = b.select("*", win.alias("win"))
    repeated = F.size(F.array_distinct("win")) < F.size("win")
    c = b.select("*", F.when(repeated, F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s")).drop("win")
    s = F.col("s")
    twin = lambda k, x: F.coalesce(F.get(s, k)["x"] == x["x"], F.lit(False))
    d = c.select("*", F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(twin(k - 1, x) | twin(k + 1, x), x["i"])), lambda i: i.isNotNull())).alias("at")).drop("s")
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda x, y: x + y)
    e = d.select("*", F.size("h").cast("long").alias("n_words"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("at")
    return e.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def judge(docs: DataFrame, trusted: DataFrame, errors: float = ERRORS, margin: float = MARGIN) -> DataFrame:
    """``row`` (the whole row of ``docs`` as a struct), metrics, mean_log_ratio and kept."""
    view = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    table = ratio_table(view.select("doc_id", "text"), known)
    scored = base_metrics(view).withColumn("one", F.lit(1)).join(F.broadcast(table), "one")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(F.col("log_ratios"), _bucket(x)))
    n = F.size("h") + F.size("p")
    out = scored.select("*", F.when(n > 0, (total("h") + total("p")) / n).otherwise(0.0).alias("mean_log_ratio"), n.alias("n"))
    least = F.col("expected") - errors * F.col("spread") / F.sqrt(F.greatest("n", F.lit(1))) - margin
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("mean_log_ratio") >= least)).drop("h", "p", "n", "one", "log_ratios", "expected", "spread")


def quality_rules(docs: DataFrame, trusted: DataFrame, errors: float = ERRORS, margin: float = MARGIN) -> DataFrame:
    """doc_id, metrics, verdict and mean log ratio for every row of ``docs`` (doc_id, text).

    ``trusted`` has a column doc_id; nulls and repeats in it do not count.
    ``mean_log_ratio`` divides the sum over a text's n-grams by their number, a
    text without words has 0. ``kept`` is false where base_failed, else whether
    the mean is no more than ``errors`` standard errors (the spread over the root
    of the text's n-grams) and ``margin`` below what trusted text scores. Null and empty texts fail the base rules;
    repeated rows and rows without an id are judged alike; an empty table gives
    an empty result. The ratio table is one row of BUCKETS numbers, joined on a
    constant key, so texts are not shuffled for scoring.
    """
    judged = judge(docs.select("doc_id", "text"), trusted, errors, margin)
    return judged.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_log_ratio")
