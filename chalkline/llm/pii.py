"""Surrogate generation: every detected entity gets one keyed, type-consistent replacement over the whole corpus.

The distinct entities are a table; each draws a surrogate by a keyed hash. Where two entities of a type draw the same, or one draws an entity that
occurs in the corpus, all but the first draw again, in rounds over the colliding ones alone, until none collide: replacements are distinct
exactly where entities are. Late rounds draw longer surrogates, so a form with few values (one-digit secrets) does not run out. The mapping is joined to the documents' mentions, so all mentions of an entity, in whatever format, get the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import free_name, rows_of, small_side, stage, text_of
from chalkline.llm.entities import Finder, rendered, surrogate

ROUNDS = 60


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kind, value) of each row's distinct entities; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = [(row, *e) for row, text in rows_of([batch], "row", "body") for e in sorted({(m.kind, m.value) for m in finder.find(text)})]
            rows, kinds, values = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["row", "kind", "value"])

    source = docs.select(_row(id_col, text_col).alias("row"), text_of(text_col).alias("body"))
    return source.mapInArrow(run, "row long, kind string, value string")


def _drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, kind, value, attempt) for kind, value in rows_of([batch], "kind", "value")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

    return entities.select("kind", "value").mapInArrow(run, "kind string, value string, surrogate string")


def mapping(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate): distinct surrogates within a kind (given names of all genders and surnames are one kind here), none of which is
    an entity of the corpus. `entities` are distinct (kind, value) rows."""
    family = F.when(F.col("kind").startswith("given_"), "given").otherwise(F.col("kind"))
    real = stage(entities.select(family.alias("family"), F.col("value").alias("surrogate")).distinct(), "entities")
    open_rows, done = entities, None
    for attempt in range(ROUNDS):
        drawn = stage(_drawn(open_rows, key, attempt).withColumn("family", family), "drawn")
        taken = real if done is None else real.unionByName(done.select("family", "surrogate"))
        free = drawn.join(taken, ["family", "surrogate"], "left_anti")
        first = free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("e"))
        won = first.select("family", "surrogate", "e.kind", "e.value")
        won = stage(won, "mapping")
        done = won if done is None else done.unionByName(won)
        open_rows = stage(drawn.select("kind", "value").join(done.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        if open_rows.isEmpty():
            return done.select("kind", "value", "surrogate")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`docs` with surrogates in the texts, the mapping). Texts without entities, null texts and all other columns stay as they are.

    The key must be kept secret and makes the result repeatable; the mapping tells the originals and is for the owner of the data only.
    """
    row_name, map_name = free_name(docs, "pii_row"), free_name(docs, "pii_map")
    found = stage(mentions(docs, id_col, text_col), "mentions")
    table = stage(mapping(found.select("kind", "value").distinct(), key), "surrogates")
    per_row = found.distinct().join(table, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(map_name))
    per_row = small_side(stage(per_row.withColumnRenamed("row", row_name), "per-row"), F.sum(3 * F.size(map_name) + 2))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = []
            for text, entries in rows_of([batch], text_col, map_name):
                if text is not None and entries:
                    known = {(e["kind"], e["value"]): e["surrogate"] for e in entries}
                    out, done = [], 0
                    for m in finder.find(text):
                        out += [text[done:m.start], rendered(m.kind, text[m.start:m.end], m.value, known[m.kind, m.value])]
                        done = m.end
                    text = "".join(out) + text[done:]
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.withColumn(row_name, _row(id_col, text_col)).join(per_row, row_name, "left").select(*[F.col(f"`{c}`") for c in names], map_name)
    return joined.mapInArrow(run, docs.schema), table
