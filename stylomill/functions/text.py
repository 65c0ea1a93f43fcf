"""Text features as native column expressions: no UDFs, one projection.

White space and word characters are Unicode classes written out, as Java's \\s and \\w are ASCII only. Null text counts as
empty, denominators are at least 1, and counts are long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
TOKEN, WORD = f"[^{WS}]+", r"[\p{L}\p{N}_]+"

#: The word list and limits of the vocabulary rule, and the clips.
COMMON_WORDS = ("the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but", "his")
MAX_SENTENCE, MAX_PUNCT = 100.0, 0.3

#: Fixed values of a small word list of our own: word, polarity, subjectivity.
SMALL_LEXICON = (("the", 0.1, 0.2), ("of", -0.2, 0.1), ("de", 0.3, 0.5), ("that", -0.4, 0.6), ("was", 0.05, 0.9))

BASIC = ("text_length", "word_count", "ttr", "sentence_count", "avg_sentence_length", "punct_ratio", "sentiment_polarity", "sentiment_subjectivity")
TUNED = (*BASIC, "digit_ratio", "upper_ratio", "bangs", "questions")
RULES = ("ends_with_letter", "has_5gram_repetition", "max_uncommon_binary")
FULL = (*TUNED, *RULES)


def let(value: Column, f) -> Column:
    """f(value) with value computed once. A plain column used within a lambda would be computed anew for each element, as projections merge."""
    return F.transform(F.array(value), f)[0]


def unused_name(name: str, columns: list[str]) -> str:
    """A column name that none of columns bears, whatever its case."""
    taken, out = {c.lower() for c in columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(whole(text), F.lit(pattern)).cast("long")


def text_length(text: Column) -> Column:
    return F.char_length(whole(text)).cast("long")


def per_char(n: Column, text: Column) -> Column:
    return n / F.greatest(text_length(text), F.lit(1))


def word_count(text: Column) -> Column:
    return count(text, TOKEN)


def sentence_count(text: Column) -> Column:
    return F.greatest(count(text, "[.!?]+"), F.lit(1))


def punct_count(text: Column) -> Column:
    return count(text, rf"[^\p{{L}}\p{{N}}_{WS}]")


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(whole(text), F.lit(f"({pattern})"), F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.greatest(b, F.lit(1)))


def ttr(tk: Column) -> Column:
    """Distinct tokens over tokens."""
    return ratio(F.size(F.array_distinct(tk)), F.size(tk))


def ends_with_letter(text: Column) -> Column:
    return whole(text).rlike(rf"[A-Za-z][{WS}]*\z").cast("long")


def shifted(a: Column, k: int, n: int) -> Column:
    """The elements of a from place k (from 0) that have n - 1 - k others after them."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - (n - 1), F.lit(0)))


def repeats_ngram(tk: Column, n: int = 5, least: int = 10) -> Column:
    """1 if an n-gram of the tokens occurs twice; texts of fewer tokens than least have 0. Hashes of n-grams tell which texts need their n-grams compared."""
    def repeated(a: Column, made) -> Column:
        """If two of the windows of n elements make the same; one pass, whatever n."""
        return let(F.transform(F.sequence(F.lit(n - 1), F.size(a) - 1), lambda i: made(*(a[i - k] for k in reversed(range(n))))), lambda g: F.size(F.array_distinct(g)) < F.size(g))

    def hashed(t: Column) -> Column:
        return let(F.transform(t, lambda x: F.xxhash64(x)), lambda h: repeated(h, F.xxhash64))

    def exact(t: Column) -> Column:
        return repeated(t, lambda *words: F.concat_ws(" ", *words)).cast("long")

    return let(tk, lambda t: F.when(F.size(t) < max(least, n), F.lit(0).cast("long")).when(hashed(t), exact(t)).otherwise(F.lit(0).cast("long")))


def repeats_uncommon(words: Column, times: int = 3, least: int = 5) -> Column:
    """1 if one of at least `least` uncommon words occurs `times` times."""
    def repeated(s: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(s) - times), lambda i: s[i] == s[i + (times - 1)]).cast("long")

    return let(F.sort_array(F.filter(words, lambda w: ~w.isin(*COMMON_WORDS))), lambda s: F.when(F.size(s) < least, F.lit(0).cast("long")).otherwise(repeated(s)))


def clean_text(text: Column) -> Column:
    """Carriage returns become line feeds; other control characters go."""
    return F.regexp_replace(F.replace(whole(text), F.lit("\r"), F.lit("\n")), r"[\x00-\x09\x0B-\x1F]", "")


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """df with tk (tokens), ltk (in lower case) and lw (words in lower case), made once for all features."""
    c = F.col(text)
    return df.withColumns({"tk": tokens(c), "ltk": tokens(F.lower(whole(c))), "lw": tokens(F.lower(whole(c)), WORD)})


def with_features(df: DataFrame, text: str = "text", words: str | None = None) -> DataFrame:
    """df with the 15 features, and the counts that they come from. Sentiment is 0.0, as without its library. words, if named, becomes a column of the words in lower case."""
    c = F.col(text)
    df = with_tokens(df, text).withColumns({
        "text_length": text_length(c), "word_count": F.size("tk").cast("long"), "sentence_count": sentence_count(c), "punct_count": punct_count(c),
        "ttr": ttr(F.col("ltk")), "bangs": count(c, "!"), "questions": count(c, r"\?"),
        "digit_ratio": per_char(count(c, r"\p{Nd}"), c), "upper_ratio": per_char(count(c, "[A-Z]"), c),
        "ends_with_letter": ends_with_letter(c), "has_5gram_repetition": repeats_ngram(F.col("tk")), "max_uncommon_binary": repeats_uncommon(F.col("lw")),
        "sentiment_polarity": F.lit(0.0), "sentiment_subjectivity": F.lit(0.0),
    })
    return df.withColumns({
        "avg_sentence_length": F.least(F.col("word_count") / F.col("sentence_count"), F.lit(MAX_SENTENCE)),
        "punct_ratio": F.least(F.col("punct_count") / F.greatest("text_length", F.lit(1)), F.lit(MAX_PUNCT)),
    }).withColumns({words: F.col("lw")} if words else {}).drop("tk", "ltk", "lw")


def eda_features(text: Column) -> dict[str, Column]:
    """Shares of characters for a first look at a corpus."""
    return {
        "n_chars": text_length(text), "n_words": word_count(text),
        "pct_punct": per_char(count(text, "[.,;:!?]"), text), "pct_digits": per_char(count(text, r"\p{Nd}"), text), "pct_upper": per_char(count(text, "[A-Z]"), text),
    }


def ari(text: Column) -> Column:
    """Automated readability index: characters that aren't white space, words and sentences; 0 without words."""
    chars, words = count(text, f"[^{WS}]"), word_count(text)
    return F.when(words == 0, 0.0).otherwise(4.71 * chars / F.greatest(words, F.lit(1)) + 0.5 * words / sentence_count(text) - 21.43)


def syllables(text: Column) -> Column:
    """Groups of vowels; an approximation that the other readability scores share."""
    return count(F.lower(whole(text)), "[aeiouy]+")


def flesch(text: Column) -> Column:
    words = word_count(text)
    return F.when(words == 0, 0.0).otherwise(206.835 - 1.015 * words / sentence_count(text) - 84.6 * syllables(text) / F.greatest(words, F.lit(1)))


def complex_words(text: Column) -> Column:
    """Words with at least three groups of vowels."""
    return F.size(F.filter(tokens(F.lower(whole(text))), lambda w: F.regexp_count(w, F.lit("[aeiouy]+")) >= 3)).cast("long")


def gunning(text: Column) -> Column:
    words = word_count(text)
    return F.when(words == 0, 0.0).otherwise(0.4 * (words / sentence_count(text) + 100.0 * complex_words(text) / F.greatest(words, F.lit(1))))


def smog(text: Column) -> Column:
    return F.when(word_count(text) == 0, 0.0).otherwise(1.043 * F.sqrt(complex_words(text) * 30.0 / sentence_count(text)) + 3.1291)


def ngrams(tk: Column, n: int, sep: str) -> Column:
    """The n-grams of an array that has been bound."""
    return reduce(lambda g, k: F.zip_with(g, shifted(tk, k, n), lambda a, b: F.concat(a, F.lit(sep), b)), range(1, n), shifted(tk, 0, n))


def word_ngrams(tk: Column, lo: int, hi: int, sep: str = " ") -> Column:
    """All n-grams of lo to hi tokens, repeats included."""
    def longer(t: Column, g: Column, n: int) -> Column:
        """g, the n-grams of t, if they are wanted, and all longer ones."""
        if n == hi:
            return g
        rest = let(F.zip_with(shifted(g, 0, 2), shifted(t, n, n + 1), lambda a, b: F.concat(a, F.lit(sep), b) if sep else F.concat(a, b)), lambda x: longer(t, x, n + 1))
        return F.concat(g, rest) if n >= lo else rest

    return let(tk, lambda t: longer(t, t, 1))


def char_ngrams(text: Column, lo: int, hi: int) -> Column:
    """All substrings of lo to hi characters, repeats included. Characters are taken apart once, so the work is linear in the text."""
    return word_ngrams(F.filter(F.split(whole(text), ""), lambda c: c != ""), lo, hi, "")


def char_ids(text: Column, alphabet: str, length: int = 1024) -> Column:
    """Places of the first characters in the alphabet from 1, 0 for others and as padding."""
    cs = F.split(F.substring(whole(text), 1, length), "")
    ids = F.transform(F.filter(cs, lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)).cast("int")))
