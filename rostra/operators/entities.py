"""Entities and noun chunks: annotation, clean-up, types, counts, and rows for each speaker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra import constants as K
from rostra.functions import text as X

#: What an annotator gives for a text: entities (surface, label, tagged words) and noun chunks (text, lemma).
ANNOTATION = "entities array<struct<surface:string,label:string,words:array<struct<text:string,tag:string>>>>, chunks array<struct<text:string,lemma:string>>"
_RUN = re.compile(r"\b[A-Z][\w.'’-]*(?:\s+(?:of\s+|the\s+)?[A-Z][\w.'’-]*)*")
_STOP = frozenset("a an and are as at be but by for from had has have he her his in is it its of on or our she that the their there they this to was we were will with you i not no so if all".split())
_TAGS = {**dict.fromkeys(K.DETERMINERS, "DT"), **dict.fromkeys("of in on at by for from with to".split(), "IN"), **dict.fromkeys("and or but".split(), "CC"), "'s": "POS"}
#: Bytes of texts whose annotations a task holds at a time.
_SLICE_BYTES = 1 << 20
_PRONOUN = frozenset("i you he she it we they me him us them my your his her its our their".split())


def _tagged(surface: str) -> list[tuple[str, str]]:
    """The words of an entity with their tags; a possessive ending is a word of its own."""
    return [(w, _TAGS.get(w.lower(), "NNP")) for w in re.sub(r"['’]s\b", " 's", surface).split()]


def rule_annotator(text: str) -> tuple[list[tuple[str, str, list[tuple[str, str]]]], list[tuple[str, str]]]:
    """A deterministic stand-in for a trained annotator: runs of capitalised words, and words between stop words."""
    entities = []
    for m in _RUN.finditer(text):
        surface = m[0].rstrip(".'’-")
        first = surface.split()[0].rstrip(".")
        label = "PERSON" if first in {"Mr", "Mrs", "Ms", "Dr"} else "ORG" if surface.isupper() or "of" in surface.split() else "GPE" if " " not in surface else "PERSON"
        if surface.lower() not in _STOP:
            entities.append((surface, label, _tagged(surface)))
    chunks, held = [], []
    for w in [*re.findall(r"[\w'’-]+|[.,;:!?]", text), "."]:
        if w.lower() in _STOP or not w[0].isalnum():
            if held:
                chunks.append((" ".join(held), " ".join("-PRON-" if x.lower() in _PRONOUN else x.lower() for x in held)))
            held = []
        else:
            held.append(w)
    return entities, chunks


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices that end where their texts have reached ``_SLICE_BYTES``."""
    sizes, start, size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0, 0
    for end, n in enumerate(sizes, 1):
        size += n
        if size >= _SLICE_BYTES or end == len(sizes):
            yield batch.slice(start, end - start)
            start, size = end, 0


def annotate(docs: DataFrame, annotator: Callable = rule_annotator, key: str = "crec_id", content: str = "content") -> DataFrame:
    """(key, entities, chunks) of each document in one pass; a model-backed annotator has the same shape.

    A batch is annotated in slices, as annotations are many times larger than their texts.
    """

    def annotated(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [annotator(t or "") for t in batch.column(1).to_pylist()]
        word = pa.struct([("text", pa.string()), ("tag", pa.string())])
        entities = pa.array([[{"surface": s, "label": n, "words": [{"text": t, "tag": g} for t, g in w]} for s, n, w in e] for e, _ in got], pa.list_(pa.struct([("surface", pa.string()), ("label", pa.string()), ("words", pa.list_(word))])))
        chunks = pa.array([[{"text": t, "lemma": n} for t, n in c] for _, c in got], pa.list_(pa.struct([("text", pa.string()), ("lemma", pa.string())])))
        return pa.RecordBatch.from_arrays([batch.column(0), entities, chunks], names=[key, "entities", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(annotated, _slices(batch))

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInArrow(run, f"{key} {kind}, {ANNOTATION}")


def trimmed(words: Column) -> Column:
    """The text of an entity's tagged words without a leading determiner and without trailing tags; null if nothing is left."""
    first = F.coalesce(F.try_element_at(words, F.lit(1))["tag"], F.lit(""))
    w = F.slice(words, F.when(first == "DT", 2).otherwise(1), F.greatest(F.lit(1), F.size(words)))
    return F.array_join(F.transform(X.without_trailing_tags(w), lambda x: x["text"]), " ")


def entity_rows(annotated: DataFrame, key: str = "crec_id") -> DataFrame:
    """(key, pos, entity, label) of the entities that are kept, trimmed and cleaned."""
    rows = annotated.select(key, F.posexplode("entities").alias("pos", "e")).select(key, "pos", trimmed(F.col("e.words")).alias("surface"), F.col("e.label").alias("label"))
    rows = rows.where(X.entity_kept("surface", "label"))
    return rows.select(key, "pos", X.clean_entity("surface").alias("entity"), "label").where("entity IS NOT NULL")


def entity_types(rows: DataFrame, key: str = "crec_id", entity: str = "entity", label: str = "label", pos: str = "pos") -> DataFrame:
    """(key, entity, type): the most frequent label, of equals the first seen; '' if none has one."""
    counted = rows.groupBy(key, entity, label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    named = F.when(F.coalesce(label, F.lit("")) != "", F.struct(F.col("n"), -F.col("first")))
    return counted.groupBy(key, entity).agg(F.coalesce(F.max_by(label, named), F.lit("")).alias("type"))


def entity_counts(rows: DataFrame, key: str = "crec_id") -> DataFrame:
    """(key, type, entity, n, pos); people's names lose capitals, and of names that thus meet the last seen counts."""
    # one aggregation by label gives both the counts and the most frequent label
    counted = rows.groupBy(key, "entity", "label").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("first"))
    named_label = F.when(F.coalesce("label", F.lit("")) != "", F.struct(F.col("m"), -F.col("first")))
    typed = counted.groupBy(key, "entity").agg(F.sum("m").alias("n"), F.min("first").alias("pos"), F.coalesce(F.max_by("label", named_label), F.lit("")).alias("type"))
    named = typed.withColumn("entity", F.when(F.col("type") == "PERSON", X.camel_case("entity")).otherwise(F.col("entity")))
    return named.groupBy(key, "type", "entity").agg(F.max_by(F.struct("n", "pos"), "pos").alias("r")).select(key, "type", "entity", "r.n", "r.pos")


def entity_maps(rows: DataFrame, key: str = "crec_id") -> DataFrame:
    """(key, named_entity_counts): type → entity → count."""
    inner = entity_counts(rows, key).groupBy(key, "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "n")))).alias("m"))
    return inner.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.to_json("m").alias("j"))))).alias("j")).select(key, F.transform_values("j", lambda _, v: F.from_json(v, "map<string,bigint>")).alias("named_entity_counts"))


def chunk_counts(annotated: DataFrame, entities: DataFrame, key: str = "crec_id", mode: str = "compat") -> DataFrame:
    """(key, chunk, n): noun chunks that are no entity, in lower case; the determiner goes before the blacklist is asked.

    Compat counts every chunk once, intent all its occurrences.
    """
    rows = annotated.select(key, F.explode("chunks").alias("c")).select(key, X.without_determiner("c.text").alias("text"), F.col("c.lemma").alias("lemma"))
    rows = rows.where(X.chunk_kept("text", "lemma")).select(key, F.lower(X.clean_chunk("text")).alias("chunk"))
    named = entities.select(key, F.lower("entity").alias("chunk")).distinct()
    left = rows.join(named, [key, "chunk"], "left_anti")
    n = F.lit(1) if mode == "compat" else F.count(F.lit(1))
    return left.groupBy(key, "chunk").agg(n.cast("long").alias("n"))


def speaker_word_counts(docs: DataFrame, entity_map: DataFrame, chunk_rows: DataFrame, key: str = "crec_id", mode: str = "compat") -> DataFrame:
    """A document's counts, as JSON, for each of its speakers.

    Compat keeps one row a person, that of the last document by day and id; intent one a
    person and document. Documents without speakers give none.
    """
    chunks = chunk_rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk", "n")))).alias("c"))
    spoken = docs.where(F.size("speaker_ids") > 0).select(key, "date_issued", F.explode(F.array_distinct(F.map_values("speaker_ids"))).alias("bioguide_id"))
    rows = spoken.join(entity_map, key, "left").join(chunks, key, "left")
    out = rows.select(
        "bioguide_id",
        key,
        F.col("date_issued").alias("date"),
        F.coalesce(F.to_json("named_entity_counts"), F.lit("{}")).alias("named_entities"),
        F.coalesce(F.to_json("c"), F.lit("{}")).alias("noun_chunks"),
    )
    if mode == "intent":
        return out
    w = Window.partitionBy("bioguide_id").orderBy(F.col("date").desc(), F.col(key).desc())
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
