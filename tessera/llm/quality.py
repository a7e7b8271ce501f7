"""Quality rules, line first: clean a text line by line, then judge what is left of the document.

Each line with a word is tested by three rules, and goes if it fails one:
- punctuation: symbols `SYMBOLS` make up more than `max_symbol_share` of its characters, or its words end in
  repeated marks (`!!`, `??`) more often than `max_marks` times in a hundred words;
- navigation: it holds `min_separators` menu separators or more and more than `max_separators` in a hundred
  words, or consists of menu words alone; quotations in « » or ‹ › and values in bars (|x|) are no separators;
- boilerplate: it holds one of the phrases `BOILERPLATE`, and no more than `max_boilerplate_words` words.
Lines without a word stay. A document is rejected if its whole text fails the base rules (too few words, too
many words in repeated 5-word windows) or if the lines that went held more than `max_lost_share` of its
characters. All of it is column expressions on one row: no shuffle, no Python, whatever the text's length.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged alike; an empty
table gives an empty result. Columns beyond the text stay; names that begin with `__quality_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD

SYMBOLS = r"[#*$%&|<>{}\\^~=_]"
SEPARATORS = r"[|»«›‹•·]|>(?<![^\x20\x09-\x0D]>)(?![^\x20\x09-\x0D])"
#: Pairs of marks that stand in prose, without another mark between them.
PAIRED = r"«[^|»«›‹•·]*»|»[^|»«›‹•·]*«|‹[^|»«›‹•·]*›|›[^|»«›‹•·]*‹|(?<![^\x20\x09-\x0D(])\|[^|\x20\x09-\x0D]+\|(?=[\x20\x09-\x0D.,;:!?)]|$)"
MENU_WORDS = r"home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|share|print|contact|about|help|back|top|skip to content|site ?map|follow us|tweet|faq"
#: Letters of all scripts are words. Possessive, so Java loops over the words and does not call itself for each;
#: no menu word begins another, so nothing is lost by that.
MENU_LINE = rf"(?i)^[^\p{{L}}\p{{N}}_]*+(?:(?:{MENU_WORDS})[^\p{{L}}\p{{N}}_]*+)++$"
BOILERPLATE = r"(?i)all rights reserved|(?:privacy|cookie) policy|terms (?:of (?:use|service)|and conditions)|(?:we|site) uses? cookies|accept (?:all )?cookies|javascript|lorem ipsum|click here|subscribe to|copyright ©|powered by"
MARKS = r"[!?]{2,}(?=[\x20\x09-\x0D]|$)"


def bad_line(line: Column, max_symbol_share: float = 0.08, max_marks: float = 20.0, min_separators: int = 2, max_boilerplate_words: int = 20, max_separators: float = 5.0) -> Column:
    """Whether a line goes."""
    words = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    separators = F.regexp_count(F.regexp_replace(line, PAIRED, ""), F.lit(SEPARATORS))
    return ((symbols > F.length(line) * max_symbol_share)
            | (line.rlike(MARKS) & (F.regexp_count(line, F.lit(MARKS)) * 100 > words * max_marks))  # few lines are counted
            | ((F.regexp_count(line, F.lit(SEPARATORS)) >= min_separators) & (separators >= min_separators) & (separators * 100 > words * max_separators))
            | line.rlike(MENU_LINE)
            | (line.rlike(BOILERPLATE) & (words <= max_boilerplate_words)))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Number of words in n-word windows found twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Most texts have none twice, which a hash set
    tells; else the windows are sorted by hash and place, and the places of those equal to a neighbour cover
    n words each, less what the next one covers."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))), lambda i: F.xxhash64(*[F.element_at(h, (i + k).cast("int")) for k in range(n)])))

    def covered(g):
        ranked = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda r: F.array_sort(F.transform(F.filter(r, lambda y, j: F.coalesce(F.get(r, j - 1)["x"] == y["x"], F.lit(False)) | F.coalesce(F.get(r, j + 1)["x"] == y["x"], F.lit(False))), lambda y: y["i"]))
        length = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])
        return let(ranked, lambda r: let(twice(r), length))

    return let(hashed, lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))


def let(value: Column, use) -> Column:
    """`use(value)`, with `value` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def judge(df: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_lost_share: float = 0.4, **line_rules) -> DataFrame:
    """`df` with the base counts, `__quality_clean` (the text without the lines that went),
    `__quality_lost` (their share of the characters), `__quality_base_failed` and `__quality_kept`."""
    q = "__quality_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn(q + "words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn(q + "lines", F.split(text, "\n", -1))
    out = out.withColumn(q + "good", F.filter(q + "lines", lambda x: ~bad_line(x, **line_rules) | ~x.rlike(WORD)))
    full = F.filter(q + "lines", lambda x: x.rlike(WORD))
    out = (out.withColumn(q + "n_words", F.size(q + "words").cast("long"))
           .withColumn(q + "word_chars", F.length(F.array_join(q + "words", "")).cast("long"))
           .withColumn(q + "n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
           .withColumn(q + "n_dup_lines", let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
           .withColumn(q + "n_repeat_words", repeat_words(F.col(q + "words")).cast("long"))
           .withColumn(q + "clean", F.array_join(q + "good", "\n")))
    lost = 1 - (F.length(q + "clean") / F.greatest(F.length(text), F.lit(1)))
    base = (F.col(q + "n_words") < min_words) | (100 * F.col(q + "n_repeat_words") > max_repeat_percent * F.col(q + "n_words"))
    return (out.withColumn(q + "lost", lost).withColumn(q + "base_failed", base)
            .withColumn(q + "kept", ~base & (F.col(q + "lost") <= max_lost_share)).drop(q + "words", q + "lines", q + "good"))


def clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **rules) -> DataFrame:
    """The documents that stay, with their texts cleaned; `chars_col`, if there is one, follows the text."""
    # the row number keeps the filter above the projection, which would be computed twice otherwise
    out = judge(df, text_col, **rules).withColumn("__quality_row", F.monotonically_increasing_id()).filter("__quality_kept and __quality_row >= 0")
    new = {text_col: F.col("__quality_clean")}
    if chars_col and chars_col in df.columns:
        new[chars_col] = F.length("__quality_clean").cast(df.schema[chars_col].dataType)
    return out.withColumns(new).select(*df.columns)
