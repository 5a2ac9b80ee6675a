"""Quality rules, lines first: rules drop lines, and a document that loses too
much of its text is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantgauge.llm.common import keeps_names, whole_text

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
# Fixed values of the line rules.
SENTENCE_MARKS = [".", "!", "?", ":", ";", "\u2026", "\u3002", '"', "'", ")", "]", "\u201d", "\u00bb"]
MENU_SIGNS = ["|", "\u00bb", "\u203a", "\u2022", "\u00b7"]
MENU_MARKS = f"[{''.join(MENU_SIGNS)}]"
BOILERPLATE = [
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "read more",
    "sign up", "log in", "subscribe", "javascript", "lorem ipsum", "skip to content", "skip to main content", "copyright",
]

# a line without a closing mark needs so many words to count as prose
PROSE_WORDS = 8
# a line with so many menu separators is navigation
MENU_COUNT = 3
# a boilerplate phrase condemns a line of at most so many characters
NOTICE_CHARS = 160
# share of a line's characters that may be symbols
SYMBOL_SHARE = 0.1
# share of a document's words that must survive
KEPT_SHARE = 0.5


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether the text holds one of the phrases."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def loose_line(line: Column) -> Column:
    """The punctuation rule: a line without a closing mark and with few words."""
    closed = F.substring(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(SENTENCE_MARKS)
    return ~closed & (F.regexp_count(line, F.lit(WORD)) < PROSE_WORDS)


def marked_line(line: Column) -> Column:
    """The navigation, boilerplate and symbol rules."""
    menu = F.regexp_count(line, F.lit(MENU_MARKS)) >= MENU_COUNT
    notice = (F.length(line) <= NOTICE_CHARS) & any_of(F.lower(line), BOILERPLATE)
    symbols = F.regexp_count(line, F.lit(SYMBOL)) > F.length(line) * SYMBOL_SHARE
    return menu | notice | symbols


def repeated_words(grams: Column, n_grams: Column) -> Column:
    """Words covered by windows of five that stand twice or more in ``grams``
    (window hashes in text order); 0 where no window repeats."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < n_grams, placed)


@keeps_names("_q_")
def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the figures of each whole text, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    kept_words (long, words of lines that pass), base_failed, kept (boolean) and
    clean_text (string, the passing lines in order). A null text counts as empty:
    no words, base_failed, not kept. Repeated rows get equal results. Columns of
    these names are replaced.

    Windows are compared by 64-bit hashes within one document.
    """
    own = "n_words word_chars n_symbols n_dup_lines n_repeat_words kept_words base_failed kept clean_text".split()
    base = df.drop(*own).withColumn("_q_text", whole_text(text))
    base = base.withColumn("_q_w", words(F.col("_q_text"))).withColumn("n_symbols", F.regexp_count("_q_text", F.lit(SYMBOL)).cast("long"))
    base = base.withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.select(
        "*",
        F.size("_q_w").cast("long").alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_q_w", lambda w: F.xxhash64(w)).alias("_q_h"),
        F.lower("_q_text").alias("_q_low"),
    ).drop("_q_w", "_q_text")
    # only a document that holds a marked thing at all has its lines searched for it
    marked = (F.col("n_symbols") > 0) | any_of(F.col("_q_low"), BOILERPLATE + MENU_SIGNS)
    fails = lambda pick: F.when(
        marked, F.filter("_q_lines", lambda x: pick(loose_line(x) | marked_line(x)))
    ).otherwise(F.filter("_q_lines", lambda x: pick(loose_line(x))))
    base = base.withColumn("_q_fail", fails(lambda c: c))
    lost = F.regexp_count(F.array_join("_q_fail", "\n"), F.lit(WORD))
    base = base.withColumn("kept_words", (F.col("n_words") - lost).cast("long"))
    again = F.when(F.size("_q_fail") == 0, F.col("_q_lines")).otherwise(fails(lambda c: ~c))
    base = base.withColumn("clean_text", F.array_join(again, "\n")).drop("_q_lines", "_q_fail", "_q_low")
    windows = F.transform("_q_h", lambda h, i: F.xxhash64(h, *[F.get("_q_h", i + k) for k in range(1, 5)]))
    grams = F.slice(windows, 1, F.col("n_words").cast("int") - 4)
    base = base.withColumn("_q_g", F.when(F.col("n_words") >= 5, grams)).drop("_q_h")
    base = base.withColumn("_q_s", repeated_words(F.col("_q_g"), F.size("_q_g"))).drop("_q_g")
    same = lambda x, k: F.coalesce(F.get("_q_s", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_q_s", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
    base = base.withColumn("_q_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_q_s")
    covered = F.aggregate(
        F.transform("_q_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_q_p", k + 1) - p, F.lit(5)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    base = base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_p")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    return base.withColumn("kept", ~failed & (F.col("kept_words") >= F.col("n_words") * KEPT_SHARE))
