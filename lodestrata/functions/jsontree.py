"""JSON bodies as path-value maps and as Dewey-labelled nodes.

Two Arrow-batched table functions. Spark's own JSON functions need a schema
in advance; here the shape of each record is the data. Both walk a record
with an explicit stack, so depth is bounded by the parser alone, and both
treat a body that is null, empty, cut off or no JSON as unreadable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.functions.shipping import ship

ship(__name__)

LEAF_MAP = "map<string,struct<kind:string,raw:string>>"


def parse(body: str | None):
    """The value of a JSON text, or None where it can't be read."""
    if not body:
        return None
    try:
        return json.loads(body)
    except (ValueError, RecursionError):
        return None


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    if isinstance(v, str):
        return "string"
    return "list" if isinstance(v, list) else "object"


def raw_of(v) -> str | None:
    """The value as text; lists and objects as JSON. Unpaired surrogates become ``?``."""
    if v is None:
        return None
    text = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode("utf-8")


def leaves(value, root: str) -> list[tuple[str, str, str | None]]:
    """(path, kind, raw) of every leaf below an object; a list is one leaf, an empty object none."""
    found, stack = [], [(root, value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", x) for k, x in reversed(v.items()))
        else:
            found.append((raw_of(path), kind_of(v), raw_of(v)))
    return found


def with_leaf_map(df: DataFrame, body: str, root: str, out: str = "leaves") -> DataFrame:
    """Append the path-value map of the object at top-level key ``root``.

    The map is null where the body is unreadable or has no object there, and
    empty where that object is empty. The body column is dropped, and so is a
    column already named ``out``.
    """
    keep = [c for c in df.columns if c not in (body, out)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, paths, kinds, raws, missing = [0], [], [], [], []
            for text in batch.column(batch.schema.names.index(body)).to_pylist():
                value = parse(text)
                value = value.get(root) if isinstance(value, dict) else None
                missing.append(not isinstance(value, dict))
                if isinstance(value, dict):
                    for p, k, r in dict((x[0], x) for x in leaves(value, root)).values():
                        paths.append(p), kinds.append(k), raws.append(r)
                offsets.append(len(paths))
            marks = pa.array([None if m else o for m, o in zip(missing, offsets)] + [offsets[-1]], pa.int32())
            items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(raws, pa.string())], ["kind", "raw"])
            maps = pa.MapArray.from_arrays(marks, pa.array(paths, pa.string()), items)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), maps], [*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return df.mapInArrow(walk, f"{fields}, `{out}` {LEAF_MAP}")


def nodes_of(value, roots: tuple[str, ...], decode: tuple[str, ...]) -> Iterator[tuple[list[int], list[str], str, str | None]]:
    """(label, keys, kind, raw) of every node in document order.

    ``label`` holds the ordinal of each step from the top, ``keys`` the name
    of each step (``[]`` for an item of a list). Only top-level keys in
    ``roots`` are entered (all if empty). A text under a top-level key in
    ``decode`` that is itself a JSON object or list is entered in its place.
    """
    if not isinstance(value, dict):
        return
    stack = [([i], [k], v) for i, (k, v) in enumerate(value.items()) if not roots or k in roots][::-1]
    while stack:
        label, keys, v = stack.pop()
        if len(keys) == 1 and keys[0] in decode and isinstance(v, str):
            inner = parse(v.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip())
            v = inner if isinstance(inner, (dict, list)) else v
        kind = kind_of(v)
        yield label, keys, kind, None if kind in ("object", "list") else raw_of(v)
        if kind == "object":
            stack.extend([(label + [i], keys + [k], x) for i, (k, x) in enumerate(v.items())][::-1])
        elif kind == "list":
            stack.extend([(label + [i], keys + ["[]"], x) for i, x in enumerate(v)][::-1])


NODE_NAMES = ("label", "keys", "kind", "raw", "parent", "schema_path", "name")
NODE_COLUMNS = "label array<int>, keys array<string>, kind string, raw string"


def explode_nodes(df: DataFrame, body: str, roots: tuple[str, ...] = (), decode: tuple[str, ...] = ()) -> DataFrame:
    """One row for each node of each readable record, beside the other columns of ``df``.

    Columns of ``df`` that bear the name of a node column are left out.
    """
    keep = [c for c in df.columns if c not in (body, *NODE_NAMES)]
    step = 20_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, keys, kinds, raws = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                made = [pa.array(labels, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.string())), pa.array(kinds, pa.string()), pa.array(raws, pa.string())]
                return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).take(at) for c in keep), *made], [*keep, "label", "keys", "kind", "raw"])

            for i, text in enumerate(batch.column(batch.schema.names.index(body)).to_pylist()):
                for label, path, kind, raw in nodes_of(parse(text), roots, decode):
                    rows.append(i), labels.append(label), keys.append([raw_of(n) for n in path]), kinds.append(kind), raws.append(raw)
                    if len(rows) >= step:
                        yield flush()
                        for x in (rows, labels, keys, kinds, raws):
                            x.clear()
            yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return df.mapInArrow(walk, f"{fields}, {NODE_COLUMNS}")
