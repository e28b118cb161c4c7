"""Personal items of whole document tables: listed, replaced by placeholders, or exchanged for surrogates.

The model of names is fitted on the table of known people, of which at most ``SAMPLE`` rows (lowest id first) are used; it is the only thing that goes to
the workers. Each text is searched where it is read. Surrogates are given to the distinct items of the whole corpus (:func:`assigned`), so that one item has one
surrogate everywhere, two items have two, and none is an item of any text; what is shuffled for that is the list of items.

Defined results: null text has no items and stays null; empty and blank text have none and stay as they are; an empty table of people leaves
the kinds that need no model and the names in places where only a person can stand; repeated rows of one document list an item once.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.names import SAMPLE
from seqloom.llm.pii import detector
from seqloom.llm.surrogates import TWEAKS, Surrogates, hints_of
from seqloom.operators.lookup import skew_safe_lookup
from seqloom.plans.scratch import Scratch

SETTING = "spark.seqloom.surrogate.key"
_RANDOM: dict[str, str] = {}

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "address": "[ADDRESS]", "name": "[NAME]"}


def key_of(spark: SparkSession) -> str:
    """The secret of the session's surrogates: the setting ``spark.seqloom.surrogate.key``, or where it is unset a random one that nobody knows."""
    return spark.conf.get(SETTING, "") or _RANDOM.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def known_people(contributors: DataFrame, sample: int = SAMPLE) -> tuple[str, ...]:
    """Full names to fit the model on: a bounded sample, by id."""
    rows = contributors.select("contributor_id", "full_name").where(F.col("full_name").isNotNull()).orderBy("contributor_id", "full_name").limit(sample)
    return tuple(r[1] for r in rows.collect())


_MADE: dict[tuple, Surrogates] = {}


def _surrogates(people: tuple[str, ...], key: str) -> Surrogates:
    if (people, key) not in _MADE:
        _MADE[people, key] = Surrogates(key, detector(people).names)
    return _MADE[people, key]


def _spans(people: tuple[str, ...]):
    """Items where they stand: (doc_id, a, b, start, end, kind, value, hint); ``a`` and ``b`` are two hashes of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("hint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = detector(people).spans
        for batch in batches:
            rows = []
            for doc, a, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if text and (spans := find(text)):
                    items = [(kind, text[x:y]) for x, y, kind in spans]
                    hints = hints_of(list(dict.fromkeys(items)))
                    rows += [(doc, a, b, x, y, kind, value, hints.get(value, "") if kind == "name" else "") for (x, y, _), (kind, value) in zip(spans, items, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return run


SPANS = "doc_id bigint, a bigint, b bigint, start int, end int, kind string, value string, hint string"
ITEM = "item struct<kind:string,value:string,hint:string>"


def _candidates(people: tuple[str, ...], key: str, tweak: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _surrogates(people, key)
        of = (lambda x: make.candidate(x["kind"], x["value"], x["hint"], tweak)) if tweak < TWEAKS else (lambda x: make.sealed(x["kind"], x["value"], x["hint"]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x) for x in batch.column(0).to_pylist()], pa.string())], ["item", "surrogate"])

    return run


def assigned(items: DataFrame, people: tuple[str, ...], key: str, scratch: Scratch) -> DataFrame:
    """(item, surrogate) of distinct items (item): no surrogate is the value of an item, and no two items share one.

    In each round the open items get their candidates under the next key; of the items with one candidate the least takes it. What is open after ``TWEAKS`` rounds, which
    takes items of a form with hardly any members, is sealed. A round moves the open items only.
    """
    values = scratch.keep(items.select(F.col("item.value").alias("surrogate")).distinct(), "values")
    done: DataFrame | None = None
    left = items
    for tweak in range(TWEAKS):
        made = left.mapInArrow(_candidates(people, key, tweak), f"{ITEM}, surrogate string").where("surrogate is not null").join(values, "surrogate", "left_anti")
        if done is not None:
            made = made.join(done.select("surrogate"), "surrogate", "left_anti")
        taken = scratch.keep(made.groupBy("surrogate").agg(F.min("item").alias("item")).select("item", "surrogate"), "taken")
        done = taken if done is None else done.unionByName(taken)
        left = scratch.keep(left.join(taken.select("item"), "item", "left_anti"), "left")
        if left.isEmpty():
            return done
    return done.unionByName(left.mapInArrow(_candidates(people, key, TWEAKS), f"{ITEM}, surrogate string"))


def _with_surrogates(spans: DataFrame, people: tuple[str, ...], key: str, scratch: Scratch) -> DataFrame:
    """``spans`` with ``item`` and its ``surrogate``. An item may stand in any part of all texts."""
    spans = spans.withColumn("item", F.struct("kind", "value", "hint"))
    items = scratch.keep(spans.select("item").distinct(), "items")
    return skew_safe_lookup(spans, scratch.keep(assigned(items, people, key, scratch), "assigned"), "item")


def _redact(people: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = detector(people).spans
        for batch in batches:
            out = [_replaced(text, [(a, b, PLACEHOLDER[kind]) for a, b, kind in find(text)]) if text else text for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_replaced(text, sorted((x["start"], x["end"], x["surrogate"]) for x in spans)) if spans else text for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, new in spans:
        parts += [text[at:a], new]
        at = b
    return "".join(parts) + text[at:]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]


def personal_items(documents: DataFrame, contributors: DataFrame, key: str) -> DataFrame:
    """(doc_id, kind, value, surrogate): each distinct item once per document and kind."""
    scratch, people = Scratch(documents.sparkSession, "privacy"), known_people(contributors)
    zero = F.lit(0).cast("bigint")
    found = _texts(documents).where("text is not null").select("doc_id", zero.alias("a"), zero.alias("b"), "text").mapInArrow(_spans(people), SPANS)
    found = scratch.keep(found.groupBy("doc_id", "kind", "value").agg(F.max("hint").alias("hint")), "found")
    return _with_surrogates(found, people, key, scratch).select("doc_id", "kind", "value", "surrogate")


def redacted(documents: DataFrame, contributors: DataFrame) -> DataFrame:
    """(doc_id, text): every item replaced by the placeholder of its kind, the rest unchanged."""
    return _texts(documents).mapInArrow(_redact(known_people(contributors)), "doc_id bigint, text string")


def disguised(documents: DataFrame, contributors: DataFrame, key: str) -> DataFrame:
    """(doc_id, text): every item exchanged for its surrogate, the rest unchanged.

    Texts meet the places of their items by two hashes of the text, so that repeated texts and repeated or null ids make no difference.
    """
    scratch, people = Scratch(documents.sparkSession, "privacy"), known_people(contributors)
    texts = _texts(documents)
    found = texts.where("text is not null").select("doc_id", *_hashes(), "text").mapInArrow(_spans(people), SPANS).drop("doc_id")
    found = scratch.keep(found.distinct(), "found")
    new = _with_surrogates(found, people, key, scratch)
    places = new.groupBy("a", "b").agg(F.collect_list(F.struct("start", "end", "surrogate")).alias("spans")).select(F.struct("a", "b").alias("of"), "spans")
    keyed = texts.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.struct(*_hashes())).alias("of"))
    return skew_safe_lookup(keyed, scratch.keep(places, "places"), "of", "left").select("doc_id", "text", "spans").mapInArrow(_rewrite, "doc_id bigint, text string")
