"""Which marked nodes enclose a node: one sweep over each file's nodes in source order, with a stack of the open spans.

Nodes are numbered in source order, so a span is open from its node to its last_id, and what is open
at a node encloses it. The sweep replaces range joins of nodes with the spans of their file: rules join
its table by file and node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enclosing(nodes: DataFrame, marks: dict[str, Column], own_function: tuple[str, ...] = ()) -> DataFrame:
    """rel_path, node_id, and for each mark an array of the marked nodes that enclose the node or are it, outermost first.

    Nodes inside no marked node have no row. For the marks in own_function only nodes of the same function count.
    The nodes of a file are swept in one task, of which the stack and one Arrow batch are held.
    """
    names = list(marks)
    same = [k in own_function for k in names]
    bits = sum((F.when(m, 1 << i).otherwise(0) for i, m in enumerate(marks.values())), F.lit(0))
    rows = nodes.select("rel_path", "node_id", "last_id", "fn_id", bits.cast("int").alias("bits"))
    schema = pa.schema([("rel_path", pa.string()), ("node_id", pa.int32()), *[(n, pa.list_(pa.int32())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for b in batches:
            out = []
            for path, node, last, fn, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if path != file:
                    file, open_ = path, []
                while open_ and open_[-1][1] < node:
                    open_.pop()
                if own:
                    open_.append((node, last, fn, own))
                if open_:
                    out.append((path, node, *[[x[0] for x in open_ if x[3] >> i & 1 and (not s or x[2] == fn)] for i, s in enumerate(same)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    spread = rows.repartition("rel_path").sortWithinPartitions("rel_path", "node_id")
    return spread.mapInArrow(run, "rel_path string, node_id int, " + ", ".join(f"{n} array<int>" for n in names))
