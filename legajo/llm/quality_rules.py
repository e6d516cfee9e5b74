"""Quality rules with DataFrame functions only: base counts and distribution divergence.

A document's histograms of character classes and of its language's most
frequent words are compared with those of all documents of that language by
Jensen-Shannon distance (base 2, 0 to 1).  A document far from either is not
kept; texts under the minimum lengths aren't judged, as their histograms say
little.

References: class counts and word counts are summed over all documents of a
language (partial aggregation; one row per language and word meets, whatever
the skew of languages).  They join by size: one row per language.

Defined results: a null or blank text has no words, fails the base rules and is
not kept; a null lang is a language of its own; rows are judged one by one, so
repeated rows, doc_ids and further columns change nothing.
"""

from __future__ import annotations

from string import ascii_letters

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import cut, tune

COMMON = 20  # most frequent words of a language that are compared
MIN_WORDS, MIN_CHARS = 80, 400  # shorter texts aren't judged by divergence
MAX_CLASS, MAX_COMMON = 0.30, 0.45
_GAP = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are computed once per row, however often lambdas read them."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes of each row."""
    text = F.coalesce("text", F.lit("")).alias("text")
    df = docs.select("doc_id", "lang", text)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _once(df, words=_words(F.col("text")), rest=F.regexp_replace("text", r"\p{L}+", ""), lines=lines)
    df = df.withColumn("n_words", F.size("words").cast("long"))
    triple = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)),
    )
    df = _once(df, triples=triple)
    # texts with equal 3-word windows alone are sorted by hash: equal ones become neighbours
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    paired = F.sort_array(F.transform("triples", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = _once(df, windows=F.when(some, paired).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("windows", lambda x, i: (x["h"] == F.get("windows", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("windows", F.greatest(i - 1, F.lit(0)))["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    repeat = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    total, rest = F.length("text"), F.length("rest")
    word_chars = F.length(F.array_join("words", ""))
    symbols = rest - F.length(F.regexp_replace("rest", r"[#*$%&|<>]+", ""))
    digits = rest - F.length(F.regexp_replace("rest", r"\p{Nd}+", ""))
    upper = total - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    spaces = total - word_chars
    classes = F.array(total - rest - upper, upper, digits, spaces, symbols, rest - digits - spaces - symbols)
    return df.select(
        "doc_id",
        "lang",
        "words",
        "n_words",
        word_chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        classes.cast("array<long>").alias("classes"),
    )


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, common): the most frequent words of each language, most frequent first."""
    each = docs.where("text is not null").select("lang", F.explode(_words(F.col("text"))).alias("word"))
    each = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    each = each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("common"))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _entropy(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def jensen_shannon(p: str, q: str) -> Column:
    """Distance of two arrays of shares; 0 to 1."""
    middle = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), _entropy(middle) - (_entropy(F.col(p)) + _entropy(F.col(q))) / 2))


def judge(docs: DataFrame, most: int = COMMON, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, the base counts, base_failed, class_js, common_js and kept of each row."""
    if not 0 < most <= len(ascii_letters):
        raise ValueError(f"most must be 1 to {len(ascii_letters)}")
    tune(docs.sparkSession)
    words = cut(common_words(docs, most).withColumnRenamed("lang", "_lang"))
    df = counts(docs).join(words, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    # each word becomes one letter, that of its place among the common ones: counting letters is cheap
    place = lambda x: F.coalesce(F.array_position("common", x), F.lit(0)).cast("int")
    letters = F.transform("words", lambda x: F.substr(F.lit(" " + ascii_letters), place(x) + 1, F.lit(1)))
    df = _once(df, letters=F.array_join(letters, ""))
    each = [F.length("letters") - F.length(F.replace("letters", F.lit(c), F.lit(""))) for c in ascii_letters[:most]]
    df = _once(df, hits=F.array(*each).cast("array<long>"))
    found = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("hits", F.concat("hits", F.array(F.col("n_words") - found))).drop("words", "letters", "common")
    df = cut(df)
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(6)] + [F.sum(F.get("hits", F.lit(k))).alias(f"h{k}") for k in range(most + 1)]
    refs = df.groupBy("lang").agg(*sums)
    refs = refs.select(F.col("lang").alias("_lang"), F.array(*[f"c{k}" for k in range(6)]).alias("_classes"), F.array(*[f"h{k}" for k in range(most + 1)]).alias("_hits"))
    refs = cut(refs.select("_lang", _shares("_classes").alias("q_class"), _shares("_hits").alias("q_common")))
    df = df.withColumn("p_class", _shares("classes")).withColumn("p_common", _shares("hits"))
    df = df.join(refs, F.col("lang").eqNullSafe(F.col("_lang")))
    df = df.withColumn("class_js", jensen_shannon("p_class", "q_class")).withColumn("common_js", jensen_shannon("p_common", "q_common"))
    df = df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    judged = (F.col("n_words") >= min_words) & (chars >= min_chars)
    far = (F.col("class_js") > max_class) | (F.col("common_js") > max_common)
    kept = ~F.col("base_failed") & ~(judged & far)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select("doc_id", *names, kept.alias("kept"), "class_js", "common_js")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    out = judge(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("class_js", "common_js")})
