"""Newick trees as edge tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = "tree string, node int, parent int, length double, label string, is_tip boolean"
_PART = re.compile(r"\s*([(),;]|:\s*[-+0-9.eE]+|'(?:[^']|'')*'|[^(),:;\s]+)")


def parse_newick(text: str) -> list[tuple[int, int | None, float | None, str | None, bool]]:
    """(node, parent, length, label, is_tip); tips are 1 to n in order, then inner nodes from the root on."""
    nodes: list[dict] = [{"parent": None, "children": 0, "length": None, "label": None}]
    at = 0
    for part in _PART.findall(text):
        if part == "(":
            nodes.append({"parent": at, "children": 0, "length": None, "label": None})
            nodes[at]["children"] += 1
            at = len(nodes) - 1
        elif part == ",":
            above = nodes[at]["parent"]
            nodes.append({"parent": above, "children": 0, "length": None, "label": None})
            nodes[above]["children"] += 1
            at = len(nodes) - 1
        elif part == ")":
            at = nodes[at]["parent"]
        elif part.startswith(":"):
            nodes[at]["length"] = float(part[1:])
        elif part != ";":
            nodes[at]["label"] = part[1:-1].replace("''", "'") if part.startswith("'") else part
    tips = [k for k, x in enumerate(nodes) if not x["children"]]
    number = {k: n for n, k in enumerate([*tips, *(k for k, x in enumerate(nodes) if x["children"])], 1)}
    return [(number[k], number.get(x["parent"]) if x["parent"] is not None else None, x["length"], x["label"], not x["children"]) for k, x in enumerate(nodes)]


def newick_edges(trees: DataFrame) -> DataFrame:
    """(tree, node, parent, length, label, is_tip) of rows (tree, newick); trees are parsed where they are."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(t, *row) for t, text in zip(pdf["tree"], pdf["newick"], strict=True) if text for row in parse_newick(text)]
            out = pd.DataFrame(rows, columns=["tree", "node", "parent", "length", "label", "is_tip"])
            yield out.astype({"parent": "Int32", "node": "int32", "length": "float64"})

    return trees.select("tree", "newick").mapInPandas(run, EDGES)


def normalise_tip_labels(edges: DataFrame) -> DataFrame:
    """Diagnosis words at the end of labels: Indeterminate and IBDU become CD, Healthy becomes HC."""
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace("label", "Indeterminate", "IBDU"), "IBDU", "CD"), "Healthy", "HC")
    return edges.withColumn("label", label)
