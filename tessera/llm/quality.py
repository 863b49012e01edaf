"""Quality rules (operator 5, native): a table of thresholds compiled into one Spark projection.

Every measure is a DataFrame expression over a whole text; nothing is shuffled and no Python runs on
the executors. `RULES` is the threshold table: measure, lower and upper bound (None: open). The verdict
of a document is the conjunction of all rules whose measure is defined for it.

Rules for odd rows: null texts have no words and no lines; such and empty texts fail the base rule. Rows
are judged one by one, so ties, repeats and null ids change nothing. `measures` adds columns whose names
may clash with extra columns; `quality` returns only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for with as his on be at by this had not are but from or have an they which one you were "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les et des en un une du dans qui par pour au sur pas plus ne se ce il sont avec son que de "
    "el los las y del una con para se por no su al lo como más o pero sus"
).split()

#: (measure, least, most). Ratios are to words, except the line ratio, which is to lines with a word.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.25),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.6),
    ("repeat_ratio", None, 0.5),
]


def measures(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_stop."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", F.filter(F.split(t, SPACES), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # 3-word windows by hash and position; equal neighbours after sorting occur twice or more
    gram = F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> struct(xxhash64(w, get(_w, i + 1), get(_w, i + 2)) as h, i as i))")
    df = df.withColumn("_g", F.sort_array(gram))
    df = df.withColumn(
        "_p",
        F.expr("sort_array(filter(transform(_g, (x, j) -> if(coalesce(x.h = get(_g, j - 1).h, false) or coalesce(x.h = get(_g, j + 1).h, false), x.i, -1)), x -> x >= 0))"),
    )
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            # starts x in order cover min(3, next start - x) words each
            "n_repeat_words": F.expr("aggregate(transform(_p, (x, j) -> least(3, get(_p, j + 1) - x)), 0L, (s, x) -> s + x)"),
            "n_lines": F.size("_l").cast("long"),
            "n_stop": F.size(F.filter("_w", lambda w: F.lower(w).isin(list(stop_words)))).cast("long"),
        }
    ).drop("_w", "_l", "_g", "_p")


def ratios() -> dict[str, Column]:
    c = F.col
    words = F.when(c("n_words") > 0, c("n_words"))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": c("word_chars") / words,
        "symbol_ratio": c("n_symbols") / words,
        "stop_ratio": c("n_stop") / words,
        "dup_line_ratio": c("n_dup_lines") / F.when(c("n_lines") > 0, c("n_lines")),
        "repeat_ratio": c("n_repeat_words") / words,
    }


def verdict(rules=None) -> Column:
    """The threshold table as one boolean expression."""
    known, ok = ratios(), F.lit(True)
    for name, least, most in RULES if rules is None else rules:
        for bound, test in ((least, lambda m, b: m >= b), (most, lambda m, b: m <= b)):
            if bound is not None:
                ok = ok & F.coalesce(test(known[name], F.lit(bound)), F.lit(True))
    return ok


def quality(docs: DataFrame, rules=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    df = measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*base, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
