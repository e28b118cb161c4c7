"""Schemas that drift between versions of one topic.

Tagged-union inference: every input split fuses the schemas of its payloads into one union per topic and version, which keeps, per
path, each alternative type with its count and a description of its values (sketches of the set, the forms and the words of texts, range and sample of
numbers, the share of true, the kinds of array elements). Unions are themselves fused path by path, in rounds, into one per topic and version; fusing is
associative and commutative, so the result doesn't depend on how payloads are split. A union leaves a split as one row for each path, so objects that use
ids for names make many short rows and no wide union; only paths that are fields of their version go on. Comparing the unions of neighbouring versions
reports the alternatives that appear and disappear; fields that go and come with like descriptions are renames. Reading back, a path
with conflicting alternatives becomes typed branches plus its value converted to the canonical type.

A path is a top-level name, or ``outer.inner`` one level down in an object.

Defined results: unreadable payloads (no JSON object, broken base64, null, empty) are counted but describe nothing; a null value
leaves its field absent; redeliveries and repeated rows count once; rows with null topic or version belong to no schema; empty tables give
empty results. Columns not named here are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.lookup import skew_safe_lookup
from seqloom.plans.scratch import Scratch
from seqloom.sources.tables import first_rows

SHARE = 0.25
"""Part of a version's readable payloads that must hold a field."""

SET, FORMS = 64, 256
"""Members of the sketch of a set of values, and of one of forms or keys: those of least hash, with exact counts. Sketches fuse without loss, and a set
of no more members is whole. Two are compared below the hash up to which both are complete, so that passing the number changes no rule."""

ALIKE = 0.6
"""Least likeness of two descriptions that makes a rename."""

TRIM = 0.05
"""Part of a sample of numbers left out at either end for its range, so that a few outliers don't make it."""

FAN = 512
"""Splits whose unions of one path are fused together in the first round."""

HELD = 50_000
"""Paths held by a task that describes payloads; then what it has is handed on and it starts anew."""

PLANS = 32 << 20
"""Most bytes of the plans of all topics together that are sent to the workers; where they are longer, rows and plans meet by a join."""

Union = dict


def readable(payload: str | None, content_type: str | None) -> dict | None:
    """The payload as a JSON object, base64 undone for binary content; None if it is none."""
    if not payload:
        return None
    try:
        if content_type == "application/octet-stream":
            payload = base64.b64decode("".join(payload.split()), validate=True).decode()
        found = json.loads(payload, parse_constant=_refuse)
    except (ValueError, binascii.Error, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _refuse(name: str) -> None:
    raise ValueError(name)


KINDS = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}


_NOT_MARKS, _MARKS = re.compile(r"[^\W_]+"), re.compile(r"[\W_]+")
_HEX = re.compile("[0-9a-f]{8,}")
_DIGITS = b"0123456789"
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())


def _taken_apart(text: str) -> tuple[str, str]:
    """Marks of a text in order, and the classes of its letters and digits."""
    if text.isascii():
        raw = text.encode()
        marks, body = raw.translate(None, _ALNUM).decode(), raw.translate(None, _OTHER)
        digit, upper, lower = len(body.translate(None, _DIGITS)) < len(body), body != body.lower(), body != body.upper()
        body = body.decode()
    else:
        marks, body = _NOT_MARKS.sub("", text), _MARKS.sub("", text)
        digit, upper, lower = any(map(str.isdigit, body)), any(map(str.isupper, body)), any(map(str.islower, body))
    if _HEX.fullmatch(body):
        return marks, "h"
    return marks, "9" * digit + "A" * upper + "a" * lower


def form_of(text: str) -> str:
    """Form of a text: its marks in order (by their hash where they are many), the classes of its letters and digits, and its length (by powers of two from 17 on)."""
    return _form(text, *_taken_apart(text))


def _form(text: str, marks: str, classes: str) -> str:
    return f"{marks if len(marks) <= 16 else _hash.__wrapped__(marks)}|{classes}|{len(text) if len(text) <= 16 else 16 + (len(text) - 1).bit_length()}"


@lru_cache(1 << 16)
def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@lru_cache(1 << 16)
def _forms(text: str) -> tuple[str, str]:
    """Form of a text, and its rough form: whether it has white space, whether it has other marks, and the classes of its letters and digits."""
    marks, classes = _taken_apart(text)
    solid = "".join(marks.split())
    return _form(text, marks, classes), f"{'s' * (len(solid) < len(marks))}{'m' * bool(solid)}|{classes}"


def _describe(value: object, kind: str, into: dict) -> None:
    into["n"] = into.get("n", 0) + 1
    if kind == "string":
        long = len(value) >= 200  # not worth a place in the caches
        form, rough = (_forms.__wrapped__ if long else _forms)(value)
        _count(into, "set", value, SET)
        _count(into, "forms", form, FORMS)
        counts = into.setdefault("rough", {})
        counts[rough] = counts.get(rough, 0) + 1
        if "s" in rough.partition("|")[0]:
            for word in re.findall(r"\w+", value):
                _count(into, "words", word, FORMS)
    elif kind == "number":
        into["lo"], into["hi"] = min(into.get("lo", value), value), max(into.get("hi", value), value)
        into["whole"] = into.get("whole", 0) + (isinstance(value, int) or value.is_integer())
        sample, key = _sketch(into, "sample"), f"{crc32(repr(value).encode()):08x}"
        if key not in sample:
            _put(sample, key, value, FORMS)
    elif kind == "boolean":
        into["true"] = into.get("true", 0) + value
    elif kind == "array":
        for x in value:
            of = KINDS.get(type(x))
            if of:
                _describe(x, of, into.setdefault("of", {}).setdefault(of, {}))
    elif kind == "object":
        for k in value:
            _count(into, "keys", k, FORMS)


class Sketch(dict):
    """Counts of the members of least hash, which remembers the greatest hash of a full one."""

    top = ""


def _sketch(into: dict, name: str) -> Sketch:
    found = into.get(name)
    if not isinstance(found, Sketch):
        found = into[name] = Sketch(found or {})
        found.top = max(found, default="")
    return found


def _put(counts: Sketch, key: str, value: object, most: int) -> None:
    """A member that isn't there yet, if it is among the ``most`` of least hash."""
    if len(counts) < most:
        counts[key] = value
        if key > counts.top:
            counts.top = key
    elif key < counts.top:
        del counts[counts.top]
        counts[key] = value
        counts.top = max(counts)


def _count(into: dict, name: str, value: str, most: int) -> None:
    counts = _sketch(into, name)
    key = _hash(value) if len(value) < 200 else _hash.__wrapped__(value)  # long texts are not kept
    if key in counts:
        counts[key] += 1
    else:
        _put(counts, key, 1, most)


def observe(union: Union, found: dict | None, content_type: str | None) -> None:
    """Fuse one payload into a union."""
    union["rows"] = union.get("rows", 0) + 1
    types = union.setdefault("types", {})
    types[content_type or ""] = types.get(content_type or "", 0) + 1
    if found is None:
        return
    union["n"] = union.get("n", 0) + 1
    paths = union.setdefault("paths", {})
    for name, value in found.items():
        kind = KINDS.get(type(value))
        if kind is None:
            continue
        _describe(value, kind, paths.setdefault(name, {}).setdefault(kind, {}))
        if kind == "object":
            for inner, x in value.items():
                of = KINDS.get(type(x))
                if of is not None:
                    _describe(x, of, paths.setdefault(f"{name}.{inner}", {}).setdefault(of, {}))


LIMITS = {"set": SET, "forms": FORMS, "keys": FORMS, "words": FORMS}


def fuse(a: Union, b: Union) -> Union:
    """Union of two unions (``a`` is used up). Counts add up, ranges widen, sketches keep the members of least hash."""
    for k, y in b.items():
        if k not in a:
            a[k] = y
            continue
        x = a[k]
        if k in LIMITS:
            for v, n in y.items():
                x[v] = x.get(v, 0) + n
            for v in sorted(x)[LIMITS[k] :]:
                del x[v]
        elif k == "sample":
            x |= y
            for v in sorted(x)[FORMS:]:
                del x[v]
        elif k == "lo":
            a[k] = min(x, y)
        elif k == "hi":
            a[k] = max(x, y)
        elif isinstance(x, dict):
            fuse(x, y)
        else:
            a[k] = x + y
    return a


PART = "topic string, version bigint, path string, lane int, n bigint, union string"
SCHEMA = pa.schema([("topic", pa.string()), ("version", pa.int64()), ("path", pa.string()), ("lane", pa.int32()), ("n", pa.int64()), ("union", pa.string())])


def _parts(unions: dict[tuple, Union], lane: int) -> Iterator[pa.RecordBatch]:
    """Unions as one row for each path, and one with null path for what counts for all: rows, readable ones and content types."""
    rows = []
    for (topic, version), union in unions.items():
        place = {"topic": topic, "version": version, "lane": lane}
        rows.append({**place, "path": None, "n": union.get("n", 0), "union": json.dumps({k: v for k, v in union.items() if k != "paths"})})
        rows += [{**place, "path": p, "n": sum(d["n"] for d in kinds.values()), "union": json.dumps(kinds)} for p, kinds in union.get("paths", {}).items()]
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_pylist(rows[i : i + 4096], SCHEMA)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    lane = TaskContext.get().partitionId() // FAN
    unions: dict[tuple, Union] = {}
    for batch in batches:
        for topic, version, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            observe(unions.setdefault((topic, version), {}), readable(payload, kind), kind)
        if sum(len(u.get("paths", ())) for u in unions.values()) > HELD:
            yield from _parts(unions, lane)
            unions = {}
    yield from _parts(unions, lane)


def _fused(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The unions of each path (and of one lane where ``lane`` is among the keys) fused into one. A task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, whole = None, 0, {}
        done = lambda: dict(zip(keys, at, strict=True)) | {"n": n, "union": json.dumps(whole)}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if here != at:
                    rows += [{"lane": 0} | done()] if at is not None else []
                    at, n, whole = here, 0, {}
                n, whole = n + row["n"], fuse(whole, json.loads(row["union"]))
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"lane": 0} | done()], SCHEMA)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, PART)


def payload_rows(log: DataFrame) -> DataFrame:
    """First rows as (sequence, topic, version, content_type, payload)."""
    rows = first_rows(log, topic=F.col("topic"), version=F.col("version").cast("bigint"), content_type=F.col("content_type"), payload=F.col("payload"))
    return rows.where(F.col("topic").isNotNull() & F.col("version").isNotNull()).drop("event")


def unions(rows: DataFrame) -> DataFrame:
    """(topic, version, path, n, union as JSON text): a union per topic and version, one row for each field and one with null path for the whole."""
    scratch = Scratch(rows.sparkSession, "drift")
    place = ["topic", "version"]
    parts = rows.select(*place, "content_type", "payload").mapInArrow(_infer, PART)
    whole = scratch.keep(_fused(_fused(parts, [*place, "path", "lane"]), [*place, "path"]).drop("lane"), "unions")
    total = whole.where("path is null").select(*place, F.col("n").alias("total"))
    return whole.join(total, place).where(F.col("path").isNull() | (F.col("n") >= SHARE * F.col("total"))).drop("total")


def _assembled(part: pd.DataFrame) -> list[tuple[int, Union]]:
    """(version, union) of one topic, in order of version."""
    out: dict[int, Union] = {}
    for version, path, text in zip(part.version, part.path, part["union"], strict=True):
        union = out.setdefault(int(version), {})
        if isinstance(path, str):
            union.setdefault("paths", {})[path] = json.loads(text)
        else:
            union |= json.loads(text)
    return sorted(out.items())


# ---- comparison of two versions ----


def fields(union: Union) -> dict[str, tuple[str, dict]]:
    """Fields that the version has: path -> (type of most values, description)."""
    out = {}
    for path, kinds in union.get("paths", {}).items():
        if sum(d["n"] for d in kinds.values()) >= SHARE * union.get("n", 0):
            kind = max(sorted(kinds), key=lambda k: kinds[k]["n"])
            out[path] = (kind, kinds[kind])
    return out


def _overlap(a: dict, b: dict) -> float:
    n, m = sum(a.values()), sum(b.values())
    return sum(min(a[k] / n, b[k] / m) for k in a.keys() & b.keys()) if n and m else 0.0


def _complete(a: dict, b: dict, name: str) -> tuple[dict, dict]:
    """Two sketches up to the hash below which both have every member."""
    full = [max(x[name]) for x in (a, b) if len(x[name]) >= LIMITS[name]]
    return tuple({k: n for k, n in x[name].items() if not full or k <= min(full)} for x in (a, b))


def _forms_alike(a: dict, b: dict) -> float:
    """Overlap of the forms; texts whose form was seen once and in one of the two only count by their rough form and, if of several words, by their words, since most forms of free text are new."""
    x, y = _complete(a, b, "forms")
    new = min((sum(n for k, n in of.items() if n == 1 and k not in other) / max(1, sum(of.values()))) for of, other in ((x, y), (y, x)))
    free = _overlap(a["rough"], b["rough"])
    if a.get("words") and b.get("words"):
        free = min(free, _overlap(*_complete(a, b, "words")))
    return _overlap(x, y) + new * free


def _ranges_alike(a: tuple, b: tuple) -> float:
    both, either = min(a[1], b[1]) - max(a[0], b[0]), max(a[1], b[1]) - min(a[0], b[0])
    return 1.0 if not either else max(0.0, both / either)


def _middle(sample: dict) -> tuple:
    """Range of a sample of numbers without its ends."""
    values = sorted(sample.values())
    cut = int(len(values) * TRIM)
    return values[cut], values[-1 - cut]


def likeness(kind: str, a: dict, b: dict) -> float:
    """How alike two descriptions of values of one type are: 1 for the same set, form or range. The rule is the same for any number of values."""
    if kind == "string":
        x, y = _complete(a, b, "set")
        return max(_overlap(x, y), len(x.keys() & y.keys()) / max(1, min(len(x), len(y))), _forms_alike(a, b))
    if kind == "number":
        if (a["whole"] >= 0.9 * a["n"]) != (b["whole"] >= 0.9 * b["n"]):
            return 0.0
        return max(_ranges_alike((a["lo"], a["hi"]), (b["lo"], b["hi"])), _ranges_alike(_middle(a["sample"]), _middle(b["sample"])))
    if kind == "boolean":
        return 1.0 - abs(a["true"] / a["n"] - b["true"] / b["n"])
    if kind == "object":
        x, y = _complete(a, b, "keys") if a.get("keys") and b.get("keys") else ({}, {})
        return len(x.keys() & y.keys()) / max(1, len(x.keys() | y.keys()))
    of_a, of_b = a.get("of", {}), b.get("of", {})
    if not of_a or not of_b:
        return 1.0 if not of_a and not of_b else 0.0
    x, y = (max(sorted(o), key=lambda k: o[k]["n"]) for o in (of_a, of_b))
    return likeness(x, of_a[x], of_b[y]) if x == y else 0.0


def _named_alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a.rpartition(".")[2].lower(), b.rpartition(".")[2].lower()).ratio()


def changes(old: Union, new: Union) -> list[tuple[str, str, str]]:
    """(change, field, new_field) between two versions' unions."""
    was, now = fields(old), fields(new)
    out = []
    first, then = (max(sorted(k), key=k.get, default="") for k in (old.get("types", {}), new.get("types", {})))
    if first != then:
        out.append(("recoded", "content_type", ""))
    retyped = {f for f in was.keys() & now.keys() if was[f][0] != now[f][0]}
    gone, come = was.keys() - now.keys(), now.keys() - was.keys()
    outer = lambda f: f.partition(".")[0] if "." in f else None

    # objects first: what lies inside one that itself goes or comes follows it
    pairs: dict[str, str] = {}

    def match(left: set[str], right: set[str]) -> None:
        scored = []
        for f in left:
            for g in right:
                if was[f][0] == now[g][0]:
                    alike = likeness(was[f][0], was[f][1], now[g][1])
                    if was[f][0] == "boolean" and f.rpartition(".")[2] == g.rpartition(".")[2]:
                        alike = 1.0  # moved under its own name; two values tell little
                    if alike >= ALIKE:
                        scored.append((round(alike, 1) + 0.5 * _named_alike(f, g), f, g))
        for _, f, g in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
            if f not in pairs and g not in pairs.values():
                pairs[f] = g

    moved = gone | retyped, come | retyped
    free_gone = {f for f in gone if outer(f) not in moved[0]}
    free_come = {f for f in come if outer(f) not in moved[1]}
    match(free_gone, free_come)
    out += [("retyped", f, "") for f in retyped if outer(f) not in retyped]
    out += [("renamed", f, g) for f, g in pairs.items()]
    out += [("removed", f, "") for f in free_gone - pairs.keys()]
    out += [("added", g, "") for g in free_come - set(pairs.values())]
    return sorted(out)


CHANGES = "topic string, version bigint, change string, field string, new_field string"


def _compare(part: pd.DataFrame) -> pd.DataFrame:
    seen = _assembled(part)
    rows = [(part.topic.iloc[0], v, *change) for (_, old), (v, new) in zip(seen, seen[1:], strict=False) for change in changes(old, new)]
    return pd.DataFrame(rows, columns=["topic", "version", "change", "field", "new_field"])


def schema_changes(log: DataFrame) -> DataFrame:
    """(topic, version, change, field, new_field): changes against the next lower version that the topic has.

    A topic's unions, one per version, are compared in one task; they hold fields only, so their size follows from the schema, not from the rows.
    """
    return unions(payload_rows(log)).groupBy("topic").applyInPandas(_compare, CHANGES)


# ---- one consistent table ----

VALUE = "struct<tag:string,text:string,number:double,truth:boolean,json:string,canonical:string>"
TABLE = f"sequence bigint, topic string, version bigint, content_type string, fields map<string,{VALUE}>"


def _plan(part: pd.DataFrame) -> pd.DataFrame:
    """For each version the latest name of each field, and for each latest name the canonical type. An old name that lagging writers still use in later versions is renamed there too, unless it is a field of that version."""
    seen = _assembled(part)
    names: dict[int, dict[str, str]] = {}
    later: dict[str, str] = {}
    renames: list[tuple[int, dict[str, str]]] = []
    for (v, _), above in zip(reversed(seen), [None, *reversed(seen)], strict=False):
        if above is not None:
            here = {f: later.get(g, g) for c, f, g in changes(dict(seen)[v], above[1]) if c == "renamed"}
            later = {**later, **here}
            renames.append((above[0], here))
        names[v] = dict(later)
    before: dict[str, str] = {}
    for v, union in seen:
        before |= next((here for w, here in renames if w == v), {})
        held = fields(union)
        names[v] |= {f: g for f, g in before.items() if f not in held and f != g}
    types: dict[str, str] = {}
    for v, union in seen:
        for f, (kind, _) in fields(union).items():
            types[names[v].get(f, f)] = kind
    return pd.DataFrame({"topic": part.topic.iloc[:1], "plan": [json.dumps({"names": names, "types": types})]})


def convert(value: object, kind: str) -> str | None:
    """``value`` as text of the canonical type; None where it can't be one."""
    if kind == "number":
        try:
            return repr(float(value)) if not isinstance(value, dict | list) else None
        except (TypeError, ValueError):
            return None
    if kind == "boolean":
        return {True: "true", False: "false", "true": "true", "false": "false", 1: "true", 0: "false"}.get(value) if isinstance(value, bool | str | int) else None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return json.dumps(value, ensure_ascii=False) if KINDS.get(type(value)) == kind else None


def _branches(value: object, kind: str, canonical: str) -> dict:
    out = dict.fromkeys(("text", "number", "truth", "json"))
    out["tag"] = kind
    out[{"string": "text", "number": "number", "boolean": "truth"}.get(kind, "json")] = json.dumps(value, ensure_ascii=False) if kind in ("object", "array") else float(value) if kind == "number" else value
    out["canonical"] = convert(value, canonical)
    return out


def _reader(known: object | None):
    """Function that reads payloads back; ``known`` is a broadcast of topic -> plan, without it the plan comes with each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read(batches, known.value if known is not None else None)

    return run


def _read(batches: Iterator[pa.RecordBatch], known: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
    value = pa.struct([("tag", pa.string()), ("text", pa.string()), ("number", pa.float64()), ("truth", pa.bool_()), ("json", pa.string()), ("canonical", pa.string())])
    schema = pa.schema([("sequence", pa.int64()), ("topic", pa.string()), ("version", pa.int64()), ("content_type", pa.string()), ("fields", pa.map_(pa.string(), value))])
    plans: dict[str, dict] = {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = readable(r["payload"], r["content_type"])
            if found is None:
                continue
            if r["topic"] not in plans:
                plans[r["topic"]] = json.loads(known[r["topic"]] if known is not None else r["plan"])
            plan = plans[r["topic"]]
            names = plan["names"].get(str(r["version"]), {})
            flat: dict[str, object] = {}
            for name, x in found.items():
                if isinstance(x, dict):
                    flat.update({f"{name}.{inner}": y for inner, y in x.items()})
                flat[name] = x
            typed = {}
            for path, x in sorted(flat.items(), key=lambda p: p[0] in names):  # the latest name's own value first; on a clash the other keeps its name
                kind = KINDS.get(type(x))
                if kind is not None:
                    latest = names.get(path, path)
                    latest = path if latest in typed else latest
                    typed.setdefault(latest, _branches(x, kind, plan["types"].get(latest, kind)))
            rows.append({"sequence": r["sequence"], "topic": r["topic"], "version": r["version"], "content_type": r["content_type"], "fields": list(typed.items())})
        yield pa.RecordBatch.from_pylist(rows, schema)


def consistent_table(log: DataFrame) -> DataFrame:
    """(sequence, topic, version, content_type, fields) of every readable payload.

    ``fields`` maps a field's latest name to its tag (the type it had), the typed branch that holds it and its value converted to the field's
    latest type (null where that fails).
    """
    spark = log.sparkSession
    scratch = Scratch(spark, "drift")
    rows = scratch.keep(payload_rows(log), "payloads")
    plans = scratch.keep(unions(rows).groupBy("topic").applyInPandas(_plan, "topic string, plan string"), "plans")
    columns = ["sequence", "topic", "version", "content_type", "payload"]
    if (plans.agg(F.sum(F.octet_length("topic") + F.octet_length("plan"))).head()[0] or 0) <= PLANS:
        known = spark.sparkContext.broadcast({r["topic"]: r["plan"] for r in plans.collect()})
        return rows.select(*columns).mapInArrow(_reader(known), TABLE)
    return skew_safe_lookup(rows, plans, "topic").select(*columns, "plan").mapInArrow(_reader(None), TABLE)
