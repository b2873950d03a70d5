"""The node table: the tree below a box as rows, which cursor operations become filters and joins of."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..decode.box import Box
from ..errors import PathError

NODE_SCHEMA = T.StructType([
    T.StructField(n, t)
    for n, t in (
        ("node_id", T.LongType()), ("parent_id", T.LongType()), ("depth", T.IntegerType()), ("ordinal", T.LongType()), ("dpath", T.StringType()), ("name", T.StringType()),
        ("filter", T.StringType()), ("key_int", T.LongType()), ("key_bin", T.BinaryType()), ("twin", T.IntegerType()), ("space_id", T.IntegerType()), ("offset", T.LongType()), ("size", T.LongType()),
        ("n_items", T.LongType()), ("v_int", T.LongType()), ("v_bin", T.BinaryType()), ("status", T.StringType()), ("message", T.StringType()),
    )
])


def format_key(key, twin: int = 0) -> str:
    """A subscript as it is written: an ordinal, or a quoted key with its rank among equals."""
    if isinstance(key, int):
        return str(key)
    text = key.decode("latin-1")
    quoted = f"'{text}'" if '"' in text and "'" not in text else '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return quoted + (f"{{{twin}}}" if twin else "")


def node_rows(top: Box, deepest: int | None = None) -> Iterator[tuple]:
    """Rows of NODE_SCHEMA for top and what lies below it, down to depth `deepest` or all, in preorder. Unreadable nodes carry their status."""
    deepest = float("inf") if deepest is None else deepest
    spaces: dict[int, int] = {}
    held: list = []  # sources stay alive, so their identity stays theirs
    count = 0
    todo: list[tuple] = [(top, None, 0, 0, "", None, None, 0)]
    while todo:
        box, parent, depth, ordinal, path, name, key, twin = todo.pop()
        me, count = count, count + 1
        status = message = offset = size = n = v = None
        space, children = None, []
        try:
            src = box.output()[0] if box.stage.kind in ("base64", "deflate", "snappy") else box.src
            if id(src) not in spaces:
                spaces[id(src)] = len(spaces)
                held.append(src)
            space = spaces[id(src)]
            offset, size = box.location()
            k = box.stage.kind
            if k in ("struct", "union"):
                n = box.length()
                if depth < deepest:
                    for i, f in enumerate(box.fields()):
                        b = box.field(f)
                        if f.name is not None or b.stage.kind in ("struct", "union"):
                            children.append((b, me, depth + 1, i, f"{path}.{f.name}".lstrip(".") if f.name else path, f.name, None, 0))
            elif k == "slice" or k == "array" and not box.rt.is_bytes(box.stage):
                seen: dict = {}
                keyed = box.keyed()
                for i, b in enumerate(box.items()):
                    n = i + 1
                    key_, rank = None, 0
                    if keyed:
                        key_ = box.key_in(b)
                        rank = seen.get(key_, 0)
                        seen[key_] = rank + 1
                    if depth < deepest:
                        children.append((b, me, depth + 1, i, f"{path}[{format_key(key_ if keyed else i, rank)}]", None, key_, rank))
                n = n or 0
            else:
                v = box.value()
                n = len(v) if isinstance(v, bytes) else None
        except PathError as e:
            status, message = e.status, str(e)
        v_int = int(v) if isinstance(v, int) else None
        yield (
            me, parent, depth, ordinal, path, name, box.stage.kind, key if isinstance(key, int) else None, key if isinstance(key, bytes) else None,
            twin if key is not None else None, space, offset, size, n, v_int, v if isinstance(v, bytes) else None, status, message,
        )
        todo += reversed(children)


# Cursor operations over node tables. `keys` are the columns that tell sources apart.
def children(nodes: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """Items of the given nodes: an equi-join on source and parent."""
    up = of.select(*keys, F.col("node_id").alias("parent_id"))
    return nodes.join(up, [*keys, "parent_id"], "left_semi")


def parents(nodes: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    up = of.select(*keys, F.col("parent_id").alias("node_id"))
    return nodes.join(up, [*keys, "node_id"], "left_semi")


def nth(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.filter(F.col("ordinal") == n)


def named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def by_key(nodes: DataFrame, key: bytes | int, twin: int | None = 0) -> DataFrame:
    """Items with the key; twin None gives all that share it."""
    out = nodes.filter(F.col("key_int") == key if isinstance(key, int) else F.col("key_bin") == F.lit(bytearray(key)))
    return out if twin is None else out.filter(F.col("twin") == twin)


def twins(rows: DataFrame, keys: list[str], key: str, ordinal: str = "ordinal") -> DataFrame:
    """rows with `twin`, how many earlier rows of the same source share the key."""
    from pyspark.sql import Window

    return rows.withColumn("twin", F.row_number().over(Window.partitionBy(*keys, key).orderBy(ordinal)) - 1)


def at_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("dpath") == path)


def reverse(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.col("node_id").desc())


def next_item(nodes: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """The item after each of the given nodes, in the same array or structure; none after the last."""
    after = of.select(*keys, "parent_id", (F.col("ordinal") + 1).alias("ordinal"))
    return nodes.join(after, [*keys, "parent_id", "ordinal"], "left_semi")


def with_next_twin(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with `next_twin`, the ordinal of the next item with the same key in the same array; null after the last and without keys."""
    from pyspark.sql import Window

    same = Window.partitionBy(*keys, "parent_id", "key_int", "key_bin").orderBy("ordinal")
    keyed = F.col("key_int").isNotNull() | F.col("key_bin").isNotNull()
    return nodes.withColumn("next_twin", F.when(keyed, F.lead("ordinal").over(same)))


def next_with_key(nodes: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """The next item after each of the given nodes that has the node's own key: its twin of the next rank in the same array, so one
    equi-join. Nodes that have none of the keys in `of` may be left out of `nodes` beforehand."""
    key = F.struct("key_int", "key_bin").alias("__key")
    after = of.filter("twin is not null").select(*keys, "parent_id", key, (F.col("twin") + 1).alias("twin"))
    return nodes.select("*", key).join(after, [*keys, "parent_id", "__key", "twin"], "left_semi").select(*nodes.columns)


def positions(nodes: DataFrame, of: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n-th position in each of the given containers: (keys, node_id of the container, ordinal, offset, at_end).

    The position after the last item is one too, and stands at the container's end.
    """
    held = nodes.filter(F.col("ordinal") == n).select(*keys, F.col("parent_id").alias("node_id"), F.col("offset").alias("__at"))
    met = of.filter(F.col("n_items") >= n).join(held, [*keys, "node_id"], "left")
    end = F.col("n_items") == n
    return met.select(*keys, "node_id", F.lit(n).cast("long").alias("ordinal"), F.when(end, F.col("offset") + F.col("size")).otherwise(F.col("__at")).alias("offset"), end.alias("at_end"))


def goto_end(of: DataFrame, keys: list[str]) -> DataFrame:
    """The position after the last item of each container: (keys, node_id, ordinal, offset)."""
    return of.filter("n_items is not null").select(*keys, "node_id", F.col("n_items").alias("ordinal"), (F.col("offset") + F.col("size")).alias("offset"))


def enter_slice(nodes: DataFrame, of: DataFrame, start: int | None, stop: int | None, keys: list[str]) -> DataFrame:
    """Items start up to stop of each container, bounds clamped, negative ones counted from the end; ordinals count from the slice's start."""
    up = of.select(*keys, F.col("node_id").alias("parent_id"), F.col("n_items").alias("__n"))

    def bound(v: int | None, default) -> F.Column:
        at = default if v is None else F.lit(v).cast("long") if v >= 0 else F.col("__n") + v
        return F.least(F.greatest(at, F.lit(0).cast("long")), F.col("__n"))

    met = nodes.join(up, [*keys, "parent_id"]).withColumn("__a", bound(start, F.lit(0).cast("long"))).withColumn("__b", bound(stop, F.col("__n")))
    inside = met.filter((F.col("ordinal") >= F.col("__a")) & (F.col("ordinal") < F.col("__b")))
    return inside.withColumn("ordinal", F.col("ordinal") - F.col("__a")).select(*nodes.columns)


def iterate(nodes: DataFrame, of: DataFrame, keys: list[str], mode: str = "items") -> DataFrame:
    """What a cursor gives item by item, in five modes: keys, values, items (key and value), spots (offset and size) or paths."""
    below = children(nodes, of, keys)
    key = F.coalesce(F.col("name"), F.decode("key_bin", "ISO-8859-1"), F.col("key_int").cast("string"), F.col("ordinal").cast("string")).alias("key")
    value = F.coalesce(F.decode("v_bin", "ISO-8859-1"), F.col("v_int").cast("string")).alias("value")
    cols = {"keys": [key], "values": [value], "items": [key, value], "spots": ["offset", "size"], "paths": ["dpath"]}
    if mode not in cols:
        raise ValueError(f"no such mode: {mode}")
    return below.select(*keys, "parent_id", "ordinal", *cols[mode])
