"""Sentence features (rows D1-D8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import text as t


def split_sentences(sections: DataFrame, key: str = "doc_id", body: str = "body", least: int = 3, one_section: bool = False) -> DataFrame:
    """Rows of ``sections`` (key, section_ord, ..., body) as sentences of at least ``least`` characters; ``sent_id`` runs from 0
    through all sections of a document.

    With ``one_section`` (each key has one row) sentences are numbered where they are cut, without a shuffle. Else a window
    over the sections' counts tells where each one begins, and only those counts are sorted.
    """
    rest = [c for c in sections.columns if c != body]
    pieces = F.filter(F.transform(t.sentences(F.col(body)), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    if one_section:
        return sections.select(*rest, F.posexplode(pieces).alias("sent_id", "text")).select(*rest, "text", "sent_id")
    cut = sections.select(*rest, F.explode(F.array(pieces)).alias("_pieces"))
    before = W.partitionBy(key).orderBy("section_ord").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("_before", F.coalesce(F.sum(F.size("_pieces")).over(before), F.lit(0)))
    rows = cut.select(*rest, "_before", F.posexplode("_pieces").alias("_pos", "text"))
    return rows.withColumn("sent_id", (F.col("_before") + F.col("_pos")).cast("int")).drop("_before", "_pos")


def first_sentences(sections: DataFrame, keys: DataFrame, key: str = "doc_id", one_section: bool = False) -> DataFrame:
    """The first kept sentence of each document of ``keys``, so that nothing is computed for the others."""
    some = sections.join(keys.select(key).distinct(), key, "left_semi")
    return split_sentences(some, key, one_section=one_section).where("sent_id = 0")


def sentence_array(sections: Column, least: int = 3) -> Column:
    """array<struct<sent_id, section, text>> out of a document's sections (array<struct<section, body, ...>>): the same sentences and numbers as
    those of ``split_sentences``, inside the row."""
    cut = lambda s: F.filter(F.transform(t.sentences(F.coalesce(s["body"], F.lit(""))), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    flat = F.flatten(F.transform(sections, lambda s: F.transform(cut(s), lambda x: F.struct(s["section"].alias("section"), x.alias("text")))))
    return F.transform(flat, lambda x, i: F.struct(i.alias("sent_id"), x["section"].alias("section"), x["text"].alias("text")))


@dataclass(frozen=True)
class Features:
    """What the features of a sentence depend on. ``lemma`` turns an array of forms into one of lemmas."""

    stop: list[str] = field(default_factory=lambda: list(d.STOP_WORDS))
    negation: list[str] = field(default_factory=lambda: list(d.NEGATIONS))
    hedges: list[str] = field(default_factory=lambda: list(d.HEDGES))
    pattern: str = t.TOKEN
    lemma: Callable[[Column], Column] | None = None

    def of(self, text: Column) -> Column:
        """struct<words, lemma, terms, has_negation, has_hedge>; words and lemma are as long as each other."""
        return t.let(self.words_of(F.lower(text)), lambda w: self.flags_of(w))

    def words_of(self, low: Column) -> Column:
        """The tokens of a text in lower case."""
        return F.regexp_extract_all(low, F.lit(self.pattern), F.lit(0))

    def flags_of(self, words: Column, listed: list[str] | None = None) -> Column:
        """``of`` out of the words. With ``listed`` terms are only those that are in that list; without a dictionary the words then are searched
        once for everything."""
        def struct(w: Column, lemma: Column | None, seen: Column) -> Column:
            return F.struct(
                w.alias("words"), (w if lemma is None else lemma).alias("lemma"), t.terms(seen, lemma, self.stop).alias("terms"),
                t.has_negation(seen, self.negation).alias("has_negation"), t.has_hedge(seen, lemma, self.hedges).alias("has_hedge"),
            )

        if self.lemma is not None:
            return t.let(self.lemma(words), lambda x: struct(words, x, words))
        if listed is None:
            return struct(words, None, words)
        known = t.only(words, list(dict.fromkeys([*listed, *self.negation, *self.hedges])))
        return t.let(known, lambda seen: struct(words, None, seen))


def add_features(sentences: DataFrame, features: Features | None = None, nouns=None, entities=None) -> DataFrame:
    """The columns of ``Features.of``, text_masked and noun_phrases (empty unless ``nouns``, a Column -> Column, gives them;
    ``entities`` may mask names before the rules do)."""
    features = features or Features()
    masked = t.mask_entities(entities(F.col("text")) if entities else F.col("text"))
    # unfolding an array of one keeps the optimiser from cutting the words anew for every use
    if features.lemma is None:
        df = sentences.select("*", F.inline(F.array(features.of(F.col("text")))))
    else:  # a dictionary may be a Python function, which no lambda takes
        df = sentences.withColumn("words", t.forms(F.col("text"), features.pattern))
        df = df.withColumn("lemma", features.lemma(F.col("words")))
        w, lemma = F.col("words"), F.col("lemma")
        df = df.withColumns({
            "terms": t.terms(w, lemma, features.stop), "has_negation": t.has_negation(w, features.negation), "has_hedge": t.has_hedge(w, lemma, features.hedges),
        })
    return df.withColumns({
        "text_masked": masked,
        "noun_phrases": F.filter(nouns(F.col("text")), lambda p: F.length(p).between(2, 49)) if nouns else F.array().cast("array<string>"),
    })


def min_tokens(sentences: DataFrame, k: int) -> DataFrame:
    return sentences.where(F.size("words") >= k)


def preprocess_stats(sentences: DataFrame, key: str = "doc_id", version: str = "1") -> DataFrame:
    """Counts of each document and the map of its sentences by section. Two steps of partial aggregates, no list of sentences."""
    per = sentences.groupBy(key, "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("tok"), F.count_if("has_negation").alias("neg"), F.count_if("has_hedge").alias("hed")
    )
    return per.groupBy(key).agg(
        F.sum("n").alias("n_sentences"), F.sum("tok").alias("n_tokens"), F.sum("neg").alias("n_negated"), F.sum("hed").alias("n_hedged"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "n")))).alias("sentences_by_section"),
    ).withColumn("version", F.lit(version))


def stats_of(sentences: Column, features: Features | None = None, version: str = "1") -> Column:
    """struct of what ``preprocess_stats`` gives, out of a document's ``sentence_array``, inside the row."""
    features = features or Features()
    seen = F.transform(sentences, lambda x: t.let(features.of(x["text"]), lambda f: F.struct(
        x["section"].alias("section"), F.size(f["words"]).cast("long").alias("n"), f["has_negation"].alias("neg"), f["has_hedge"].alias("hed")
    )))

    def counts(rows: Column) -> Column:
        by = t.counted(F.sort_array(F.transform(rows, lambda x: x["section"])))
        return F.struct(
            F.size(rows).cast("long").alias("n_sentences"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
            F.size(F.filter(rows, lambda x: x["neg"])).cast("long").alias("n_negated"), F.size(F.filter(rows, lambda x: x["hed"])).cast("long").alias("n_hedged"),
            F.map_from_entries(by).alias("sentences_by_section"), F.lit(version).alias("version"),
        )

    return t.let(seen, counts)
