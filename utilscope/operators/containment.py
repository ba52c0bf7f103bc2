"""Which of very many terms a text contains: an index of each term's rarest q-gram.

A text that contains a term contains all of its q-grams, so it is enough to meet the term at one of
them. A term of at most q characters is its own q-gram; a longer one is indexed by the q-gram that the
fewest texts hold. Texts meet terms by an equi-join on q-grams, and only such pairs are compared. The
work follows the texts and their matches, not texts x terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q_grams(text: Column, size: Column) -> Column:
    """The distinct substrings of `size` characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, size))))


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on `gram` by a shuffle: Spark's size estimate doesn't see that exploding multiplied the rows."""
    return left.hint("merge").join(right.hint("merge"), "gram", how)


def contained_terms(texts: DataFrame, text: str, terms: DataFrame, term: str, q: int = 8) -> DataFrame:
    """(`text`, `term`) for each distinct text and each distinct term that it contains.

    NULL and empty terms are in no text. A term of at most `q` characters is its own q-gram, so it meets
    only texts that hold it. Fewer characters make less of the text's q-grams, but more false meetings.
    """
    texts = texts.select(F.col(text).alias("_text")).where("_text != ''").distinct()
    terms = terms.select(F.col(term).alias("_term")).where("_term != ''").distinct()
    length = F.least(F.length("_term"), F.lit(q + 1)).alias("length")
    lengths = sorted(r[0] for r in terms.select(length).distinct().collect())  # at most q + 1 numbers
    if not lengths:
        return texts.select(F.col("_text").alias(text), F.lit(None).cast("string").alias(term)).limit(0)

    def postings(sizes: list[int]) -> DataFrame:
        held = [F.coalesce(q_grams(F.col("_text"), F.lit(n)), F.array().cast("array<string>")) for n in sizes]
        return texts.select("_text", F.explode(F.concat(*held)).alias("gram"))

    index = terms.where(F.length("_term") <= q).select("_term", F.col("_term").alias("gram"))
    if lengths[-1] > q:
        longer = terms.where(F.length("_term") > q).select("_term", F.explode(q_grams(F.col("_term"), F.lit(q))).alias("gram"))
        rated = _joined(longer, postings([q]).groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "left")
        rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest")
        index = index.unionAll(rated.groupBy("_term").agg(rarest).select("_term", F.col("rarest.gram").alias("gram")))
    met = _joined(postings(sorted({min(n, q) for n in lengths})), index).where(F.contains("_text", "_term"))
    return met.select(F.col("_text").alias(text), F.col("_term").alias(term))
