"""Trees in newick and nexus text, to and from node tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COLUMNS = ["tree", "node_id", "parent_id", "child_ord", "name", "branch_length", "is_terminal", "pre", "post", "depth"]
NODE = "tree string, node_id int, parent_id int, child_ord int, name string, branch_length double, is_terminal boolean, pre int, post int, depth int"
_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;']+")


@dataclass
class Clade:
    name: str | None = None
    branch_length: float | None = None
    children: list[Clade] = field(default_factory=list)


def parse(text: str) -> Clade:
    """The clade of one newick text; comments in brackets are ignored."""
    tokens = iter(_TOKEN.findall(re.sub(r"\[[^\]]*\]", "", text)))
    root = here = Clade()
    path: list[Clade] = []
    for t in tokens:
        if t == "(":
            path.append(here)
            here.children.append(Clade())
            here = here.children[-1]
        elif t == ",":
            path[-1].children.append(Clade())
            here = path[-1].children[-1]
        elif t == ")":
            here = path.pop()
        elif t == ":":
            here.branch_length = float(next(tokens))
        elif t == ";":
            break
        else:
            here.name = t[1:-1].replace("''", "'") if t[0] == "'" else t
    if path:
        raise ValueError("brackets are not closed")
    return root


def _quoted(name: str | None) -> str:
    if name is None:
        return ""
    return name if re.fullmatch(r"[^\s(),:;'\[\]]+", name) else "'" + name.replace("'", "''") + "'"


def write(clade: Clade) -> str:
    """One newick text. Works on trees of any depth."""
    out: list[str] = []
    todo: list = [clade]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
            continue
        end = _quoted(c.name) + ("" if c.branch_length is None else f":{c.branch_length:.5f}")
        if not c.children:
            out.append(end)
            continue
        out.append("(")
        todo.append(")" + end)
        for i, child in enumerate(reversed(c.children)):
            if i:
                todo.append(",")
            todo.append(child)
    return "".join(out) + ";"


def _listed(tree: str, root: Clade) -> list[list]:
    """The node rows of one tree, by pre-order."""
    rows: list[list] = []
    post = 0
    todo = [(root, None, 0, 0, None)]
    while todo:
        c, parent, order, depth, close = todo.pop()
        if close is not None:
            rows[close][8] = post
            post += 1
            continue
        at = len(rows)
        rows.append([tree, at, parent, order, c.name, c.branch_length, not c.children, at, 0, depth])
        todo.append((c, parent, order, depth, at))
        todo += [(x, at, i, depth + 1, None) for i, x in reversed(list(enumerate(c.children)))]
    return rows


def _frame(rows: list[list]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["parent_id"] = out["parent_id"].astype("Int32")
    return out


def node_rows(tree: str, root: Clade) -> pd.DataFrame:
    """The node table of one tree, by pre-order."""
    return _frame(_listed(tree, root))


def clade_of(ids: Iterable[int], parents: Iterable[float], names: Iterable[str | None], lengths: Iterable[float]) -> Clade:
    """The clade of one tree's nodes, by pre-order; the root has a null parent or one below 0."""
    by: dict[int, Clade] = {}
    root = Clade()
    for n, parent, name, length in zip(ids, parents, names, lengths):
        by[int(n)] = c = Clade(None if pd.isna(name) else name, None if pd.isna(length) else float(length))
        if pd.isna(parent) or parent < 0:
            root = c
        else:
            by[int(parent)].children.append(c)
    return root


def nexus_newick(text: str) -> str:
    """The first tree of a nexus text as newick, numbers replaced by the labels of its translate block."""
    block = re.search(r"\btranslate\b(.*?);", text, re.IGNORECASE | re.DOTALL)
    labels = dict(re.findall(r"(\S+)\s+('(?:[^']|'')*'|[^,\s]+)\s*(?:,|$)", block[1].strip())) if block else {}
    found = re.search(r"\btree\b[^=;]*=(.*?;)", text, re.IGNORECASE | re.DOTALL)
    if not found:
        raise ValueError("no tree in nexus text")
    clade = parse(found[1])
    todo = [clade]
    while todo:
        c = todo.pop()
        if not c.children and c.name in labels:
            label = labels[c.name]
            c.name = label[1:-1].replace("''", "'") if label[0] == "'" else label
        todo += c.children
    return write(clade)


def read_text(text: str) -> str:
    """A tree's newick, from newick or nexus text."""
    return nexus_newick(text) if text.lstrip()[:6].lower() == "#nexus" else text


#: Node rows that are sent on together, so many at least; small trees share a batch.
BATCH_ROWS = 10_000


def to_nodes(texts: DataFrame) -> DataFrame:
    """Node rows of texts (tree, text), newick or nexus; a null text is no tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[list] = []
        for batch in batches:
            for tree, text in zip(batch["tree"], batch["text"]):
                rows += _listed(tree, parse(read_text(text)))
                if len(rows) >= BATCH_ROWS:
                    yield _frame(rows)
                    rows = []
        if rows:
            yield _frame(rows)

    return texts.filter("text is not null").select("tree", "text").mapInPandas(run, NODE)


def to_newick(nodes: DataFrame) -> DataFrame:
    """tree and newick text of each tree of a node table."""
    row = F.struct("pre", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "name", "branch_length")
    listed = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(row)).alias("n"))
    columns = ("node_id", "parent_id", "name", "branch_length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [write(clade_of(*own)) for own in zip(*(batch[c] for c in columns))]
            yield pd.DataFrame({"tree": batch["tree"], "text": texts})

    return listed.select("tree", *[F.col(f"n.{c}").alias(c) for c in columns]).mapInPandas(run, "tree string, text string")


def read_trees(spark, path: str) -> DataFrame:
    """Node rows of every tree file under path; a tree is named by its file's stem."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("tree"), F.col("value").alias("text"))
    return to_nodes(texts)
