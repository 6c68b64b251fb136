"""JSON documents as rows (X1, X3, X4): one small Arrow-batched helper."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of an Arrow batch that leaves a task.
OUT_ROWS = 50_000

_TYPES = [(bool, "boolean"), (int, "integer"), (float, "number"), (list, "array"), (dict, "object")]


_STABLE = json.JSONEncoder(sort_keys=True, ensure_ascii=True)


def value_type(value) -> str:
    """Type name of a decoded value; everything unknown is a string."""
    return next((name for kind, name in _TYPES if isinstance(value, kind)), "string")


def stable_json(value) -> str:
    """Sorted-key text that equal values share."""
    return _STABLE.encode(value)


def _leaves(root: str, value) -> Iterator[tuple[str, object]]:
    stack = [(root, value)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node))))
        elif (node.strip() if isinstance(node, str) else node):
            yield path, node


def _leaf_rows(root: str, text: str) -> list[tuple[str, str, str, str]]:
    try:
        decoded = json.loads(text) if text else None
    except ValueError:
        decoded = {"raw": text}
    return [(path, path.split(".")[-1].split("[")[0] or root, stable_json(node), value_type(node)) for path, node in _leaves(root, decoded)]


def flatten_json(df: DataFrame, json_column: str, keys: list[str], *, root: str = "") -> DataFrame:
    """Non-empty leaves as (keys..., path, leaf_label, value, value_type). Narrow: no shuffle.

    Equal texts of a batch are taken apart once; their leaves are copied to the rows as Arrow columns, about OUT_ROWS at a time.
    """
    key_sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [*keys, "path", "leaf_label", "value", "value_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).dictionary_encode()
            found = [_leaf_rows(root, text) for text in texts.dictionary.to_pylist()] + [[]]  # the last one for null
            leaves = [pa.array([leaf[i] for part in found for leaf in part], pa.string()) for i in range(4)]
            sizes = np.array([len(part) for part in found], np.int64)
            which = texts.indices.fill_null(len(found) - 1).to_numpy()
            ends, first = np.cumsum(sizes[which]), (np.cumsum(sizes) - sizes)[which]
            total = int(ends[-1]) if len(ends) else 0
            for at in range(0, total, OUT_ROWS):
                out = np.arange(at, min(at + OUT_ROWS, total))
                row = np.searchsorted(ends, out, side="right")
                leaf = out - (ends - sizes[which])[row] + first[row]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(row)) for k in range(len(keys))] + [x.take(pa.array(leaf)) for x in leaves], names=names)

    return df.select(*keys, json_column).mapInArrow(
        run, f"{key_sql}, path string, leaf_label string, value string, value_type string"
    )
