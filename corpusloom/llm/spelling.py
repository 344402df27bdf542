"""Spelling variant grouping by pairless wildcard groups.

Two words are near if one inserted, deleted or replaced code point makes one of the other.
A word's form is its most frequent near word, if that is at least ``FACTOR`` times as
frequent, and its root is where a chain of forms ends.

Replacements: every word joins a group for each of its places, named by what stands before
and after the place. The others of a group differ from a word in just that place, and two
words share one group at most, so a word's replacements number the sizes of its groups less
one each, and its best one is the first of a group, or the second where it is itself the
first. That is all that a group gives to a member: no pairs are made. A group holds a word
for each letter at most, so it is small whatever the corpus.

Insertions and deletions: what a word becomes without one of its code points is looked up
in the vocabulary, as many lookups as it has code points. Each hit counts for both ends,
and counts and best words are combined in each task before they are shuffled.

Roots follow forms by doubling: as frequency at least doubles with every step, chains are
short, and a few rounds are enough.

Null texts have no words and a null id is an empty text in the choice of altered runs. An
empty table, or one in which no word is frequent enough, gives no rows; a repeated row
counts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a code point if this divides its hash.
ALTERED = 97
SHORTEST, FEWEST, FACTOR = 5, 3, 2
#: Stands for the open place of a group; no word holds it.
OPEN = "\u0000"


def without(word: Column, at: Column, instead: str = "") -> Column:
    """``word`` with ``instead`` in place of its code point number ``at``, from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.lit(instead), F.substring(word, at + 1, F.length(word)))


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", altered: int = ALTERED, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): runs of letters, lower-cased, some of them short of a code point, that are long and frequent enough."""
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= shortest).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run") + 1).cast("int")
    word = F.when(F.col("h") % altered == 0, without(F.col("run"), at)).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _best(n: Column, word: Column) -> Column:
    """Ordered so that the least is the most frequent word, ties by code points."""
    return F.struct((-n).alias("n"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, near, best): for each group of a word the number of its others, and the best of them."""
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    groups = places.select(without(F.col("word"), F.col("at"), OPEN).alias("open"), _best(F.col("n"), F.col("word")).alias("own"))
    groups = groups.groupBy("open").agg(F.sort_array(F.collect_list("own")).alias("all")).where(F.size("all") > 1)
    top = groups.select(F.size("all").alias("size"), F.get("all", F.lit(0)).alias("first"), F.get("all", F.lit(1)).alias("second"), F.explode("all").alias("own"))
    best = F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return top.select(F.col("own.word").alias("word"), (F.col("size") - 1).cast("long").alias("near"), best.alias("best"))


def shortened(words: DataFrame) -> DataFrame:
    """(word, near, best): both ends of every word that is another without one of its code points."""
    shorter = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: without(F.col("word"), i)))
    cut = words.select(F.col("word").alias("long"), F.col("n").alias("n_long"), F.explode(shorter).alias("word"))
    hits = cut.join(words, "word")
    ends = F.array(F.struct(F.col("word"), _best(F.col("n_long"), F.col("long")).alias("best")), F.struct(F.col("long").alias("word"), _best(F.col("n"), F.col("word")).alias("best")))
    return hits.select(F.explode(ends).alias("end")).select("end.word", F.lit(1).cast("long").alias("near"), "end.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the form's form, and so on, by doubling."""
    step = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not step.where("moved").isEmpty():
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        step = stored(step.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "forms")
    return step.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts; it is read several times, so give a written table."""
    near = replaced(words).unionByName(shortened(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))
    follows = F.col("best_n") >= factor * F.col("n")
    near = stored(near.select("word", F.when(follows, F.col("best")).alias("form"), "n", "n_near", F.when(follows, F.col("best_n")).alias("form_n")), "near")
    ends = roots(near.where("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants among the words of all documents."""
    return variants(stored(counted_words(docs, doc_id, text), "words"))
