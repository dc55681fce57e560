"""Deeply nested records as related flat tables.

Every node of a record gets a Dewey label, the ordinals of the steps that lead
to it. A parent's label is the label without its last step, so links need no
search; label order is reading order; and the objects of one schema path form
one table, a row for each object, linked to the row of the object above it.

Defined results: an unreadable, empty or null body has no nodes; repeated
records yield repeated nodes, which the tables merge (of rows that share a key
and differ, the greatest value of a field); an empty text is a value, a null
is a field without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.jsontree import explode_nodes
from lodestrata.functions.scalars import address_of

ITEM = "[]"


def above(steps: Column) -> Column:
    """A label or list of keys without its last step; null at the top."""
    return F.when(F.size(steps) > 1, F.slice(steps, F.lit(1), F.size(steps) - 1))


def path_of(keys: Column) -> Column:
    """The schema path of a list of keys, ``message.content[].text``."""
    return F.replace(F.array_join(keys, "."), F.lit(".[]"), F.lit("[]"))


def nodes(df: DataFrame, body: str, decode: tuple[str, ...] = ()) -> DataFrame:
    """All nodes with ``label``, ``parent`` (null at the top), ``keys``, ``schema_path``, ``name``, ``kind``, ``raw``."""
    n = explode_nodes(df, body, (), decode)
    return n.select("*", above(F.col("label")).alias("parent"), path_of(F.col("keys")).alias("schema_path"), F.element_at("keys", -1).alias("name"))


def dewey(label: Column) -> Column:
    """A label as text, ``3.0.12``."""
    return F.array_join(label.cast("array<string>"), ".")


def tables(n: DataFrame, key: str) -> DataFrame:
    """The flat tables of all schema paths in one: key, schema_path, keys, label, parent, fields.

    A row is an object below the top; ``schema_path`` says which table it
    belongs to, ``parent`` is the label of the nearest object above (lists
    between are steps of the label), ``fields`` holds its scalar and null
    children as name to (kind, raw, place).
    """
    own = n.filter((F.col("name") != ITEM) & ~F.col("kind").isin("object", "list") & (F.size("label") > 1))
    rows = own.groupBy(F.col(key), F.col("parent").alias("label")).agg(F.any_value(above(F.col("keys"))).alias("keys"), F.array_sort(F.collect_set(_cell())).alias("cells"))
    return _linked(rows, key, 1).select(key, path_of(F.col("keys")).alias("schema_path"), "keys", "label", "parent", "fields")


def whole_tables(n: DataFrame, key: str) -> DataFrame:
    """``tables`` with all that a record holds, so that it can be built again from its rows.

    The record itself is a row of table ``$`` with an empty label, the parent
    of the objects at the top; an object without scalars is a row, with empty
    fields if it has no lists either; a list is a field of its object, without
    a value; an item that is no object is a row with one field, ``[]``.
    """
    at, path, inside = F.col("label"), F.col("keys"), (F.col("kind") != "object") & (F.col("name") != ITEM)
    none = F.lit(None).cast(_CELL)
    up = lambda steps: F.slice(steps, F.lit(1), F.size(steps) - 1)
    row = lambda label, keys, cell: F.struct(label.alias("label"), keys.alias("keys"), cell.alias("cell"))
    self = row(at, path, F.when(F.col("kind") != "object", _cell()).otherwise(none))
    own = F.when(inside, F.array(row(up(at), up(path), _cell()))).when(F.size(at) == 1, F.array(self, row(up(at), up(path), none))).otherwise(F.array(self))
    rows = n.select(key, F.inline(own)).groupBy(key, "label").agg(F.any_value("keys").alias("keys"), F.array_sort(F.collect_set("cell")).alias("cells"))
    schema_path = F.when(F.size("keys") == 0, "$").otherwise(path_of(F.col("keys")))
    return _linked(rows, key, 0).select(key, schema_path.alias("schema_path"), "keys", "label", "parent", "fields")


_CELL = "struct<k:string,v:struct<kind:string,raw:string,at:int>>"


def _cell() -> Column:
    """A node as a field: its name, and what is known of it."""
    return F.struct(F.col("name").alias("k"), F.struct("kind", "raw", F.element_at("label", -1).alias("at")).alias("v"))


def _linked(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Cells as a map, and the label of the nearest object above, of at least so many steps."""
    single = F.filter("cells", lambda x, i: F.coalesce(F.get("cells", i + 1)["k"] != x["k"], F.lit(True)))
    # The nearest object above: drop this step, and those of lists before it.
    steps = F.size("label") - 1 - F.aggregate(F.reverse("keys"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, k: F.struct((a["n"] + F.when(a["on"] & (k == ITEM), 1).otherwise(0)).alias("n"), (a["on"] & (k == ITEM)).alias("on")))["n"]
    return rows.select(key, "keys", "label", F.when(steps >= least, F.slice("label", F.lit(1), steps)).alias("parent"), F.map_from_entries(single).alias("fields"))


def table_of(t: DataFrame, key: str, schema_path: str) -> DataFrame:
    """One flat table of ``tables``: key, label, parent, fields as a map of name to raw value."""
    return t.filter(F.col("schema_path") == schema_path).select(key, dewey(F.col("label")).alias("label"), dewey(F.col("parent")).alias("parent"), F.transform_values("fields", lambda _, v: v["raw"]).alias("fields"))


def text_blocks(t: DataFrame, key: str, content: tuple[str, ...] = ("message", "content")) -> DataFrame:
    """Texts in reading order: key, label, parent, item (from 0), text.

    A block is an object of type ``text`` whose text is not null, in a list at
    any depth below ``content``; a bare string at ``content``, or at a
    ``content`` key of a block in it, is one text, its place that of the string.
    """
    top, last = ".".join(content), content[-1]
    field = lambda name: F.try_element_at("fields", F.lit(name))
    under = F.slice("keys", 1, len(content)) == F.array(*[F.lit(x) for x in content])
    kind = field("type")
    blocks = t.filter(under & (F.size("keys") > len(content)) & (kind["kind"] == "string") & (kind["raw"] == "text") & field("text")["raw"].isNotNull())
    holders = (F.col("schema_path") == ".".join(content[:-1])) | F.col("schema_path").rlike(rf"^{top}\[\](\.{last}\[\])*$")
    bare = t.filter(holders & (field(last)["kind"] == "string"))
    texts = blocks.select(key, "label", "parent", field("text")["raw"].alias("text")).unionAll(bare.select(key, F.concat("label", F.array(field(last)["at"])), "label", field(last)["raw"]))
    return texts.withColumn("item", F.row_number().over(W.partitionBy(key).orderBy("label")) - 1)


def keyed_costs(t: DataFrame, key: str, root: str = "modelUsage", value: str = "costUSD", label: str = "model") -> DataFrame:
    """Costs by model: key, label, parent, item, cost. The model is the key of the object, or its ``model`` where a list stands."""
    field = lambda name: F.try_element_at("fields", F.lit(name))["raw"]
    rows = t.filter((F.get("keys", F.lit(0)) == root) & (F.size("keys") == 2) & field(value).isNotNull())
    by = F.get("keys", F.lit(1))
    item = F.when(by == ITEM, field(label)).otherwise(by)
    return rows.select(key, "label", "parent", item.alias("item"), field(value).try_cast("decimal(18,6)").alias("cost")).filter(F.col("item").isNotNull())


def addresses(t: DataFrame, key: str, root: str = "structured_output", name: str = "addr") -> DataFrame:
    """Readable addresses below a root: key, label (of the object), parent, item (eight hex digits in capitals)."""
    c = F.try_element_at("fields", F.lit(name))
    own = t.filter((F.get("keys", F.lit(0)) == root) & c["kind"].isin("string", "integer", "number"))
    number = c["raw"].try_cast("decimal(38,0)").try_cast("bigint")
    whole = c["raw"].try_cast("decimal(38,6)") == c["raw"].try_cast("decimal(38,0)")
    value = F.when(c["kind"] == "string", address_of(c["raw"])).when(whole, number.bitwiseAND(F.lit(0xFFFFFFFF)))
    return own.select(key, "label", "parent", value.alias("__v")).filter(F.col("__v").isNotNull()).select(key, "label", "parent", F.format_string("%08X", "__v").alias("item"))
