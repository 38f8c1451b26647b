"""Text expressions: tokens, stop words, character and word n-grams, cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Russian stop words.
RUSSIAN_STOP_WORDS = """
и в не на что он с как а то все она так его но да ты к у же вы за по только её мне было вот от меня ещё нет о из ему
теперь когда уже вам ни был это чтобы сначала им их кем чем ли до поэтому без также этих для при или того бы весь свой
там тут об со
""".split()

#: Words that say little about a field, the default for term extraction besides a stop list of the caller's.
SCIENTIFIC_WORDS = """
abstract appendix author chapter claim conclusion contribution discussion effort experiment figure finding future goal
idea importance insight introduction journal literature novelty overview page paragraph preliminary purpose reader
reference remark review section statement summary survey table today topic volume year
""".split()

# The default English stop set of Apache Lucene. A longer list is a parameter of those who have one.
FUNCTION_WORDS = """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was
will with
""".split()

# Names shown for method ids.
METHOD_NAMES = {
    "sbert": "SBERT (baseline)",
    "sbert_tfidf": "SBERT + TF-IDF",
    "sbert_zscore": "SBERT + Z-score",
    "wordnet_lin": "RuWordNet (Lin)",
    "wordnet_wup": "RuWordNet (Wu-Palmer)",
    "wordnet_lin_en": "English WordNet (Lin)",
    "wordnet_wup_en": "English WordNet (Wu-Palmer)",
    "hybrid": "Hybrid (SBERT + RuWordNet)",
    "bertopic": "BERTopic",
    "doc2vec": "Doc2Vec",
    "lda": "LDA",
}


def bound(x: Column, f) -> Column:
    """f(x) for an f that makes an array, with x computed once however often f uses it, lambdas included."""
    return F.flatten(F.transform(F.array(x), f))


def tokens(text: Column) -> Column:
    """Words of the lower-cased text: letters, marks, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def words_array(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in sorted(set(words))))


def without_stop_words(words: Column, stop: Iterable[str] = RUSSIAN_STOP_WORDS) -> Column:
    listed = words_array(stop)
    return F.filter(words, lambda w: ~F.array_contains(listed, F.lower(w)))


def preprocessed(text: Column, stop: Iterable[str] = RUSSIAN_STOP_WORDS, lemma=F.lower) -> Column:
    """Tokens without stop words, each through `lemma` (lower case unless a lemmatizer is given), joined by spaces."""
    return F.array_join(F.transform(without_stop_words(tokens(text), stop), lemma), " ")


def char_ngrams(text: Column, low: int = 2, high: int = 3) -> Column:
    """All character n-grams of `low` to `high` characters, with repeats; spaces count, nothing is padded."""

    def of(t: Column, n: int) -> Column:
        return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return bound(text, lambda t: F.concat(*(of(t, n) for n in range(low, high + 1))))


def char_ngram_set(text: Column, low: int = 2, high: int = 3) -> Column:
    return F.array_distinct(char_ngrams(text, low, high))


def character_jaccard(a: Column, b: Column) -> Column:
    """Shared characters of two lower-cased strings over all of theirs; 0 if neither has any."""
    x, y = F.array_distinct(F.split(F.lower(a), "")), F.array_distinct(F.split(F.lower(b), ""))
    x, y = (F.filter(v, lambda c: c != "") for v in (x, y))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def cleaned(text: Column) -> Column:
    """English letters only, in lower case: without links, e-mail addresses, other characters and repeated blanks."""
    out = F.regexp_replace(text, r"http\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"\S+@\S+", "")
    out = F.regexp_replace(out, r"[^a-zA-Z\s]", " ")
    return F.trim(F.lower(F.regexp_replace(out, r"\s+", " ")))


def latin_words(text: Column, stop: Iterable[str] = FUNCTION_WORDS) -> Column:
    """Words of two English letters or more, without stop words."""
    listed = words_array(stop)
    return F.filter(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z][a-zA-Z]+\b"), F.lit(0)), lambda w: ~F.array_contains(listed, w))


def word_ngrams(words: Column, low: int = 1, high: int = 3) -> Column:
    def of(w: Column, n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words, lambda w: F.concat(*(of(w, n) for n in range(low, high + 1))))


def content_words(words: Column, stop: Iterable[str] = (*FUNCTION_WORDS, *SCIENTIFIC_WORDS)) -> Column:
    """Words not in the list, longer than two characters, with a letter."""
    listed = words_array(stop)
    return F.filter(words, lambda w: ~F.array_contains(listed, F.lower(w)) & (F.length(w) > 2) & w.rlike("[a-zA-Z]"))


def document_tokens(term: Column) -> Column:
    """Tokens of a term for document vectors: parts between blanks, hyphens and dots; the term itself if none is left."""
    parts = F.filter(F.split(F.translate(F.lower(term), "-.", "  "), r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lower(term)))


def topic_tokens(term: Column) -> Column:
    """Tokens of a term for topic models: its words, or the characters of a single word."""
    parts = F.filter(F.split(F.lower(term), r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) == 1, F.filter(F.split(parts[0], ""), lambda c: c != "")).otherwise(parts)


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[а-яА-Я]")


def is_cyrillic(terms: Column, first: int = 5) -> Column:
    """Whether one of the first terms of an array has a Cyrillic letter; false for none."""
    return F.coalesce(F.exists(F.slice(terms, 1, first), has_cyrillic), F.lit(False))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_name(synset: Column) -> Column:
    return F.split_part(synset, F.lit("."), F.lit(1))


def display_name(method: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in METHOD_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, method), method)
