"""Columns out of Python models, dictionaries and phrase automata: whole Arrow batches, one load a worker process."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What this worker process has loaded; one entry a model, for all tasks that it runs.
_loaded: dict[str, Any] = {}
#: Most rows of a dictionary, and most characters of a phrase list, that are sent to every worker.
MAX_FORMS = 1_000_000
MAX_PHRASE_CHARACTERS = 32 << 20


def _model(key: str, load: Callable[[], Any]) -> Any:
    """A function of the module, since one that is made at run time would travel with a copy of ``_loaded``."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def model_column(load: Callable[[], Callable[[pa.Array], pa.Array]], returns: str) -> Callable[[Column], Column]:
    """A Column -> Column function (for ``nouns``, ``entities``, ``lemma``, vectors) out of a model that runs in Python.

    ``load`` gives the model, a function of an Arrow array to one as long; it runs once in each worker process and serves
    all batches of all its tasks. Nulls reach the model as nulls.
    """
    key = uuid.uuid4().hex

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(key, load)
        for batch in batches:
            yield model(batch)

    return F.arrow_udf(apply, returns)


def lemma_column(table: DataFrame, max_forms: int = MAX_FORMS) -> Callable[[Column], Column] | None:
    """Arrays of forms to arrays of lemmas by a table (form, lemma); forms that it lacks stay. None if it has over ``max_forms`` rows: then
    ``lemmas_by_join`` does the same. Of several lemmas of a form the least is taken. A batch's different forms are looked up once."""
    rows = table.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma")).limit(max_forms + 1).collect()
    if len(rows) > max_forms:
        return None
    sent = table.sparkSession.sparkContext.broadcast({r.form: r.lemma for r in rows})

    def load() -> Callable[[pa.Array], pa.Array]:
        known = sent.value

        def look_up(forms: pa.Array) -> pa.Array:
            coded = pc.dictionary_encode(forms.flatten())
            lemma = pa.array([known.get(w, w) for w in coded.dictionary.to_pylist()], pa.string())
            sizes = pc.fill_null(pc.list_value_length(forms), 0)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
            return pa.ListArray.from_arrays(ends, lemma.take(coded.indices))

        return look_up

    return model_column(load, "array<string>")


def known_forms(df: DataFrame, table: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, known): of each row that has any, the map of those of its ``words`` that the table has to their lemmas. What travels are a row's
    different words, once, and what was found; ``keys`` tell rows apart."""
    least = table.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    each = df.select(*keys, F.explode(F.array_distinct(words)).alias("form")).join(least, "form")
    return each.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("form", "lemma"))).alias("known"))


def by_known(words: Column, known: Column) -> Column:
    """The lemmas of words by a map of ``known_forms`` (null: none is known); others stay."""
    return F.when(known.isNull(), words).otherwise(F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w)))


def lemmas_by_join(df: DataFrame, table: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, lemma): each row's lemmas in the order of its ``words``, by a join, for tables of any size. ``keys`` tell rows apart; rows
    without words have none."""
    rows = df.select(*keys, words).where(F.size(words) > 0).join(known_forms(df, table, keys, words), keys, "left")
    return rows.select(*keys, by_known(F.col(words), F.col("known")).alias("lemma"))


def phrase_column(phrases: list[str], max_characters: int = MAX_PHRASE_CHARACTERS) -> Callable[[Column], Column]:
    """Lower-cased texts to those of the phrases that they contain anywhere, each once, sorted: what ``text.phrase_hits`` gives, by an Aho-Corasick
    automaton that reads a text once however many phrases there are. Phrases of more than ``max_characters`` make several automata."""
    parts: list[list[str]] = [[]]
    size = 0
    for p in dict.fromkeys(p for p in phrases if p):
        if size + len(p) > max_characters and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append(p)
        size += len(p)

    def loader(own: list[str]) -> Callable[[], Callable[[pa.Array], pa.Array]]:
        def load() -> Callable[[pa.Array], pa.Array]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in own:
                automaton.add_word(p, p)
            automaton.make_automaton()

            def find(texts: pa.Array) -> pa.Array:
                found = ([] if x is None else sorted({p for _, p in automaton.iter(x)}) for x in texts.to_pylist())
                return pa.array(found, pa.list_(pa.string()))

            return find

        return load

    found = [model_column(loader(own), "array<string>") for own in parts if own]
    if not found:
        return lambda text: F.array().cast("array<string>")
    if len(found) == 1:
        return found[0]
    return lambda text: F.sort_array(F.flatten(F.array(*[f(text) for f in found])))
