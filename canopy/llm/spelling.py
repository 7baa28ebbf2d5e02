"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' powers, so that anagrams share it, and taking a letter away takes the letter's
power from the key.  Words that differ by one added or removed letter have the shorter one's key in common with the
longer one's key less a letter; words that differ by one exchanged letter have a key less a letter in common.  Each
word gives its own key and its key less each of its letters, and equal keys are joined.

One edit leaves the words' first or last halves equal.  Keys are therefore given twice, once with the first half and
less the letters after it, once with the last half and less the letters before it, and only words of one such half are
joined: anagrams of other order, of which there may be very many, don't meet.  The order of letters is verified on each pair, once.

A word's form is its most frequent near word, where that is ``factor`` times as frequent at least; forms are followed to
the last one by pointer jumping, which ends as they grow more frequent.  Frequent words are summed before they are
shuffled; a word has at most as many near words as it has places and the alphabet letters.

Rows: null and empty texts have no words; texts and words are taken whole, whatever their length; a null id counts as an
empty one in the hash that deletes a letter; rows that repeat an id or a text count each by itself; ties go to the smaller
word in code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.store import drop, save

MIN_CHARS, MIN_COUNT, FACTOR, DELETE_ONE_IN = 6, 5, 5, 199

#: Words of more letters are compared by their first difference, as ``levenshtein`` takes the square of their length.
LONG = 500
#: Powers are summed modulo this number, so that the sum of a word of any length fits.
_MODULUS = 1 << 61
_HIGH = "[À-ÖØ-Þ]"


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, delete_one_in: int = DELETE_ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case; one in so many loses a letter, by a hash of its id and itself."""
    least = max(1, min_chars)  # shorter runs make no word of that length
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    run = F.when(F.col("raw").rlike(_HIGH), F.translate("raw", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower("raw"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % delete_one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("raw")).select("id", run.alias("run")).select("run", h.alias("h")).select(word.alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= min_chars) & (F.col("n") >= min_count))


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return F.pmod(code * code * code * code * code, F.lit(_MODULUS))


def _keys(words: DataFrame) -> DataFrame:
    """(key, half, head, first, whole, word, n): every word's own key and its key less a letter, by either half.

    head: letters in the first half; first: whether that half is meant; whole: no letter is taken away.
    """
    size = F.length("word")
    total = F.aggregate("letters", F.lit(0).cast("long"), lambda acc, x: F.pmod(acc + _power(x), F.lit(_MODULUS)))
    rows = words.withColumn("letters", F.split("word", "")).withColumn("total", total)

    def given(head: Column, first: bool, begin: Column, length: Column, less: Column | None) -> Column:
        half = F.xxhash64(F.lit(first), head, F.substring("word", begin, length))
        key = lambda x: F.col("total") if less is None else F.pmod(F.col("total") - _power(x), F.lit(_MODULUS))
        letters = F.array(F.lit("")) if less is None else F.array_distinct(less)
        return F.transform(letters, lambda x: F.struct(key(x).alias("key"), half.alias("half"), head.alias("head"), F.lit(first).alias("first"), F.lit(less is None).alias("whole")))

    own, less_one = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    every = F.concat(
        given(own, True, F.lit(1), own, None),
        given(own, False, own + 1, size, None),
        given(less_one, True, F.lit(1), less_one, F.slice("letters", less_one + 1, size)),
        given(less_one, False, less_one + 2, size, F.slice("letters", F.lit(1), less_one + 1)),
    )
    return rows.select("word", "n", F.inline(every))


def _one_letter_apart(a: Column, b: Column) -> Column:
    """Whether two different words are equal behind the first letter in which they differ, by one replaced, missing or added there."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False)).cast("int")
    rest = lambda word, k: F.substring(word, at + k, F.length(word))
    more = F.length(b) - F.length(a)
    return F.when(more == 0, rest(a, 1) == rest(b, 1)).when(more == 1, rest(a, 0) == rest(b, 1)).when(more == -1, rest(a, 1) == rest(b, 0)).otherwise(F.lit(False))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): all pairs, either way, of the words (word, n; distinct) that differ by exactly one letter."""
    keys = _keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    same_head = F.substring("a.word", F.lit(1), F.col("a.head")) == F.substring("b.word", F.lit(1), F.col("a.head"))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.head") == F.col("b.head"))
    # of the two halves the one that finds the pair is the first, if it is equal, so a pair is found once
    once = (F.col("a.word") < F.col("b.word")) & ~(F.col("a.whole") & F.col("b.whole")) & (F.col("a.first") == F.col("b.first")) & (same_head == F.col("a.first"))
    long = F.length("a.word") > LONG
    pairs = a.join(b, met & once & (long | (F.levenshtein("a.word", "b.word", 1) == 1)))
    pairs = pairs.filter(~long | _one_letter_apart(F.col("a.word"), F.col("b.word")))
    way = lambda x, y: F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("other_n"))
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends; a saved table."""
    roots = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = save(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(roots)
        roots = longer
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")


def spelling_variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, delete_one_in: int = DELETE_ONE_IN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that is frequent and long enough."""
    words = save(word_counts(docs, min_chars, min_count, delete_one_in, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    often = -F.col("best.rank") >= factor * F.col("n")
    known = save(
        words.join(near, "word", "left").select(
            "word", F.when(often, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("best.rank")).alias("form_n")
        ),
        "spelling",
    )
    drop(words)
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
