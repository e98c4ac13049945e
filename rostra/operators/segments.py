"""Speaker segmentation: sentences, headings, islands of one speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostra.constants import FUZZY_SCORE, generic_speakers
from rostra.functions import text as X
from rostra.operators.fuzzy import fuzzy_match, fuzzy_options, open_pairs, weighted_ratio, with_best

__all__ = ["candidates", "document_segments", "first_contained", "fuzzy_match", "islands", "segments", "sentence_array", "sentences", "weighted_ratio"]

#: What ends no sentence where nothing has been learned from the collection.
TITLES = r"(?<![\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|Jr|Sr|St|No|[A-Z])\.\s"


def sentence_array(content: Column, no_end: str = TITLES) -> Column:
    """The sentences of a text; titles and initials, or the pattern of a collection's own abbreviations, end none."""
    marked = F.regexp_replace(content, no_end, "$1\u0001 ")
    cut = F.transform(F.split(marked, r"(?<=[.!?])\s+"), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))
    return F.filter(cut, lambda s: s != "")


def sentences(docs: DataFrame, key: str = "crec_id", content: str = "content", no_end: str = TITLES) -> DataFrame:
    """(key, pos, sentence) of every document."""
    return docs.select(key, F.posexplode(sentence_array(F.col(content), no_end)).alias("pos", "sentence"))


def first_contained(sentence: Column, candidates: Column) -> Column:
    """The first candidate that the sentence contains, or null; no shuffle."""
    return F.try_element_at(F.filter(candidates, lambda c: F.contains(sentence, c)), F.lit(1))


def candidates(own: Column, mode: str = "compat") -> Column:
    """A document's own speakers, then the presiding ones."""
    return F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(*[F.lit(s) for s in generic_speakers(mode)]))


def segments(rows: DataFrame, key: str = "crec_id", pos: str = "pos", sentence: str = "sentence", hit: str = "hit") -> DataFrame:
    """(key, number, speaker, text): islands of sentences of one speaker.

    ``hit`` is the speaker recognised in a sentence or null; the last one recognised goes
    on speaking. Numbers start at 1; the first island may have no speaker.
    """
    w = Window.partitionBy(key).orderBy(pos)
    carried = rows.withColumn("speaker", F.last(hit, ignorenulls=True).over(w))
    changed = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))) | (F.row_number().over(w) == 1)
    islands = carried.withColumn("number", F.sum(changed.cast("int")).over(w))
    return islands.groupBy(key, "number").agg(
        F.first("speaker").alias("speaker"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(pos, sentence))), lambda x: x[sentence])).alias("text"),
    )


def islands(sentences_: Column, hits: Column) -> Column:
    """Runs of sentences of one speaker, as (speaker, text) in order, from the speaker recognised in each sentence or null.

    A run begins where a speaker is recognised who is not the one before; sentences before
    the first have none. Linear in the text: every sentence goes into one slice.
    """
    found = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: F.get(hits, i).isNotNull())
    changed = X.let(found, lambda f: F.filter(f, lambda i, k: (k == 0) | (F.get(hits, i) != F.get(hits, F.get(f, k - 1)))))
    starts = X.let(changed, lambda c: F.when(F.coalesce(F.get(c, F.lit(0)), F.lit(-1)) == 0, c).otherwise(F.concat(F.array(F.lit(0)), c)))

    def run(all_: Column) -> Column:
        return F.transform(all_, lambda i, k: F.struct(F.get(hits, i).alias("speaker"), F.array_join(F.slice(sentences_, i + 1, F.coalesce(F.get(all_, k + 1), F.size(hits)) - i), " ").alias("text")))

    return F.when(F.size(hits) > 0, X.let(starts, run))


def document_segments(docs: DataFrame, key: str = "crec_id", content: str = "content", speaker_ids: str = "speaker_ids", mode: str = "compat", fuzzy: bool = True, least: int = FUZZY_SCORE, no_end: str = TITLES) -> DataFrame:
    """``docs`` with ``segments``: id, speaker, text and person id of each island, in order; null for a null or empty text.

    Every document is cut in its own row, so nothing is shuffled. With ``fuzzy`` a sentence without a speaker
    is compared with those that it could be like; only these pairs reach Python.
    """
    names = candidates(F.map_keys(speaker_ids), mode)
    cut = F.coalesce(sentence_array(F.col(content), no_end), F.array().cast("array<string>"))
    if fuzzy:
        unlike = X.let(fuzzy_options(names), lambda o: X.let(cut, lambda s: F.filter(F.transform(s, lambda x, i: F.when(first_contained(x, names).isNull(), open_pairs(x, i, o, least))), lambda p: F.size(p["names"]) > 0)))
        docs = with_best(docs, unlike, "_near", least)
        near = F.map_from_entries("_near")
    else:
        near = None

    def whole(s: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            exact = first_contained(x, names)
            return exact if near is None else F.coalesce(exact, F.try_element_at(near, i))

        def named(runs: Column) -> Column:
            def one(r: Column, k: Column) -> Column:
                person = F.try_element_at(F.col(speaker_ids), F.coalesce(r["speaker"], F.lit("")))
                return F.struct(F.concat_ws("-", F.col(key), k + 1).alias("id"), r["speaker"].alias("speaker"), r["text"].alias("text"), person.alias("bioguide_id"))

            return F.transform(runs, one)

        return X.let(F.transform(s, hit), lambda h: named(islands(s, h)))

    return docs.drop("segments").withColumn("segments", X.let(cut, whole)).drop("_near")
