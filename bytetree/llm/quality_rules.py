"""Quality rules with adaptive thresholds, in built-in functions only.

Each rule's measure is an integer, so counts of its values are a mergeable quantile sketch. Values of up to DIGITS digits are bins
of their own; larger ones, which only mean words of 100 characters and more have, share a bin with those of the same first DIGITS
digits, an error of a thousandth at most. Nothing is clipped: limits are compared with the measure itself. Counts for each
language and source add up to those for a language and to those for everything. Limits are read from the sketches and joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .words import SPACES, bind, words

DIGITS = 4  #: of a measure that a bin of its sketch keeps
# rule -> (least spread in units of the measure): limits lie REACH spreads beyond a quartile
RULES = {"symbol_share": 20, "dup_line_share": 100, "repeat_share": 60, "word_length": 100}
REACH = 3
LEAST_ROWS = 50  #: a source of fewer rows takes the limits of its language, a language of fewer those of everything
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # fixed values of the base rule


def repeated_words(w: Column) -> Column:
    """How many words lie in some 3-word window that occurs twice or more in the array w."""
    spots = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(spots, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twin = lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])
            at = F.array_compact(F.transform(s, twin))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(pairs, marked))

    return bind(hashes, covered)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), all counts long."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    lines = bind(own, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    found = bind(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    whole = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), found.alias("w"), lines.alias("l"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"), (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
    )
    counts = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.dup", "n_lines": "l.n", "n_repeat_words": "w.rep"}
    return whole.select("id", "lang", "source", *(F.col(c).cast("long").alias(k) for k, c in counts.items()))


def _share(part: str, whole: str, unit: int) -> Column:
    """unit * part div whole; 0 of nothing."""
    return F.coalesce(F.expr(f"{unit} * {part} div nullif({whole}, 0)"), F.lit(0)).cast("long")


def _bin(measure: Column) -> Column:
    """The least value that begins with the same DIGITS digits."""
    step = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(measure.cast("string")) - DIGITS)).cast("long")
    return measure - measure % step


def _quantile(cum: Column, total: Column, q: float) -> Column:
    return F.min(F.when(cum >= F.ceil(total * q), F.col("bin")))


def limits(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, hi, lo) from the histogram sketches of the rows."""
    stacked = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bin(F.col(r)).alias("bin")) for r in RULES))).alias("m")).select("lang", "source", "m.*")
    fine = stacked.groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("n"))
    wide = fine.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    every = wide.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    spread = F.element_at(F.create_map(*(F.lit(x) for r in RULES.items() for x in r)), F.col("rule"))

    def edges(sketch: DataFrame, keys: list[str]) -> DataFrame:
        part = Window.partitionBy(*keys, "rule")
        cum = sketch.withColumn("cum", F.sum("n").over(part.orderBy("bin"))).withColumn("total", F.sum("n").over(part))
        q = cum.groupBy(*keys, "rule").agg(_quantile(F.col("cum"), F.col("total"), 0.25).alias("q1"), _quantile(F.col("cum"), F.col("total"), 0.75).alias("q3"), F.max("total").alias("rows"))
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), spread)
        return q.select(*keys, "rule", "rows", (F.col("q3") + reach).alias("hi"), (F.col("q1") - reach).alias("lo"))

    own, lang, all_ = edges(fine, ["lang", "source"]), edges(wide, ["lang"]), edges(every, [])
    lang = lang.withColumnsRenamed({k: f"l_{k}" for k in lang.columns})
    all_ = all_.withColumnsRenamed({k: f"a_{k}" for k in all_.columns})
    met = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(all_, F.col("rule") == F.col("a_rule"))
    pick = lambda k: F.when(F.col("rows") >= LEAST_ROWS, F.col(k)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{k}")).otherwise(F.col(f"a_{k}")).alias(k)
    return met.select("lang", "source", "rule", pick("hi"), pick("lo"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The measures of each row, base_failed and kept: one row for each input row.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT % of the words in repeated 3-word windows. kept: not
    base_failed and within every limit of its language and source. Sketches are made of the rows that pass the base rule.
    Null texts have no words; null languages and sources are groups of their own; repeated rows each come back; an empty table
    gives no rows; other columns are ignored. Texts stay where they are read: only counts are kept and joined.
    """
    rows = measures(df, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select(
        "*", failed.alias("base_failed"), _share("n_symbols", "word_chars", 1000).alias("symbol_share"), _share("n_dup_lines", "n_lines", 1000).alias("dup_line_share"),
        _share("n_repeat_words", "n_words", 1000).alias("repeat_share"), _share("word_chars", "n_words", 100).alias("word_length"),
    )
    rows = cut(rows)
    found = limits(rows.filter(~F.col("base_failed")))
    wide = found.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, F.col(e))).alias(f"{e}_{r}") for r in RULES for e in ("hi", "lo")))
    wide = wide.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = rows.join(wide, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for r in RULES:
        inside = inside & (F.col(r) <= F.col(f"hi_{r}"))
    inside = inside & (F.col("word_length") >= F.col("lo_word_length"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
