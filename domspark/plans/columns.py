"""Trees -> the columns of the node table, a batch of pages at a time.

Parsing leaves parents, kinds, tags, texts and attributes in document order. All else that a row holds - positions among siblings, ends of subtrees,
ancestors, places in the page's text - is computed here by array operations over all pages of the batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from domspark.functions.text import HTML_SPACE, class_set, fold

from .tree import COMMENT_NODE, DOCUMENT, ELEMENT, TEXT_NODE, Tree

_KINDS = (ELEMENT, TEXT_NODE, COMMENT_NODE, DOCUMENT)
_CODE = {k: i for i, k in enumerate(_KINDS)}
_ATTR = pa.struct([("name", pa.string()), ("value", pa.string()), ("has_value", pa.bool_())])


def lists(lengths: np.ndarray, values: pa.Array, none: np.ndarray | None = None) -> pa.ListArray:
    """values cut into lists of the given lengths; null where `none` holds."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    mask = None if none is None else pa.array(none, pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def attribute_lists(attrs: list, none: np.ndarray | None = None) -> pa.ListArray:
    """Lists of (name, value, has_value) as one array."""
    flat = [a for own in attrs if own for a in own]
    names, values, has = zip(*flat) if flat else ((), (), ())
    items = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(has, pa.bool_())], fields=list(_ATTR))
    return lists(np.fromiter((len(own) if own else 0 for own in attrs), dtype=np.int32, count=len(attrs)), items, none)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys, the place (from 0) of each within its run of equal ones, and the run's length."""
    if not len(keys):
        return keys, keys
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    return np.arange(len(keys)) - np.repeat(starts, sizes), np.repeat(sizes, sizes)


class NodeColumns:
    """Takes parsed pages until they make up a batch."""

    def __init__(self):
        self.pages: list = []
        self.sizes: list[int] = []
        self.kinds: list[int] = []
        self.parents: list[int] = []
        self.rules: list = []
        self.texts: list[str | None] = []
        self.attrs: list[list | None] = []
        self.spaces: dict[int, str] = {}

    def __len__(self) -> int:
        return len(self.kinds)

    def add(self, page, tree: Tree, root: int) -> None:
        """The nodes below root."""
        base, n = len(self.kinds), len(tree.kind)
        if tree.shuffled:
            order = tree.order(root)
            number = {node: i for i, node in enumerate(order, 1)}
            number[root] = 0
            self.kinds += [_CODE[tree.kind[i]] for i in order]
            self.parents += [number[tree.parent[i]] for i in order]
            self.rules += [tree.rule[i] for i in order]
            self.texts += [tree.text[i] for i in order]
            self.attrs += [tree.attrs.get(i) for i in order]
            self.spaces |= {base + number[i] - 1: ns for i, ns in tree.ns.items() if i in number and i != root}
            size = len(order)
        else:
            first = root + 1
            self.kinds += [_CODE[k] for k in tree.kind[first:]]
            self.parents += [p - root for p in tree.parent[first:]] if root else tree.parent[first:]
            self.rules += tree.rule[first:]
            self.texts += tree.text[first:]
            self.attrs += map(tree.attrs.get, range(first, n))
            self.spaces |= {base + i - first: ns for i, ns in tree.ns.items() if i >= first}
            size = n - first
        self.pages.append(page)
        self.sizes.append(size)

    def columns(self, in_order: bool = False) -> tuple[dict[str, pa.Array], np.ndarray]:
        """All columns and the number of rows of each page. A page's document row, which holds its whole text, comes first if in_order is set, and else
        after all nodes of the batch."""
        nodes, sizes, texts = self._nodes()
        pages, n = len(sizes), len(self.kinds)
        whole = {
            "node_id": np.zeros(pages, dtype=np.int32), "subtree_end": sizes.astype(np.int32), "depth": np.zeros(pages, dtype=np.int32), "text": texts, "text_start": np.zeros(pages, dtype=np.int32),
            "ancestors": [[]] * pages, "node_type": [DOCUMENT] * pages, "text_len": np.array([len(t) for t in texts], dtype=np.int32),
        }
        order = None
        if in_order:
            order = pa.array(np.insert(np.arange(n), np.cumsum(sizes) - sizes, n + np.arange(pages)))
        out = {}
        for name, column in nodes.items():
            both = pa.concat_arrays([column, pa.array(whole[name], column.type) if name in whole else pa.nulls(pages, column.type)])
            out[name] = both if order is None else both.take(order)
        page = np.concatenate([np.repeat(np.arange(pages), sizes), np.arange(pages)])
        ids = pa.array(self.pages, pa.int64()).take(pa.array(page))
        out["page_id"] = ids if order is None else ids.take(order)
        return out, sizes + 1

    def _nodes(self) -> tuple[dict[str, pa.Array], np.ndarray, list[str]]:
        n, sizes = len(self.kinds), np.array(self.sizes, dtype=np.int64)
        kind, up = np.array(self.kinds, dtype=np.int8), np.array(self.parents, dtype=np.int64)
        page_start = np.cumsum(sizes) - sizes
        page = np.repeat(np.arange(len(sizes)), sizes)
        start = page_start[page]
        number = np.arange(n) - start + 1
        parent = np.where(up > 0, start + up - 1, -1)  # places in the batch
        family = np.where(up > 0, parent, n + page)
        element = kind == 0
        # depth, ancestors and subtrees
        depth = np.ones(n, dtype=np.int64)
        at, cur = np.flatnonzero(parent >= 0), parent[parent >= 0]
        line = []
        while len(at):
            line.append((at, cur))
            depth[at] += 1
            cur = parent[cur]
            at, cur = at[cur >= 0], cur[cur >= 0]
        lengths = depth - 1
        first = np.cumsum(lengths) - lengths
        ancestors = np.zeros(int(lengths.sum()), dtype=np.int32)
        for k, (at, cur) in enumerate(line):
            ancestors[first[at] + k] = number[cur]
        last = np.arange(n)
        by_depth = np.argsort(depth, kind="stable")
        for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:0:-1]:
            owner = parent[level]
            final = np.append(owner[1:] != owner[:-1], True)  # siblings are next to each other, the last one counts
            last[owner[final]] = last[level[final]]
        # siblings
        low: dict[str, int] = {}
        codes = np.array([-1 if r is None else low.setdefault(r.low, len(low)) for r in self.rules], dtype=np.int64)
        own = np.flatnonzero(element)
        place, count, type_place, type_count = (np.zeros(n, dtype=np.int32) for _ in range(4))
        before, after = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        order = own[np.argsort(family[own], kind="stable")]
        k, m = _runs(family[order])
        place[order], count[order] = k + 1, m
        inner = k > 0
        if len(order):
            before[order[inner]] = number[order[np.flatnonzero(inner) - 1]]
            after[order[np.flatnonzero(inner) - 1]] = number[order[inner]]
        order = own[np.lexsort((codes[own], family[own]))]
        k, m = _runs(family[order] * (len(low) + 1) + codes[order])
        type_place[order], type_count[order] = k + 1, m
        # texts
        chars = np.zeros(n, dtype=np.int64)
        pieces: list[list[str]] = [[] for _ in self.sizes]
        own_text: list[str | None] = ["" if e else None for e in element.tolist()]
        children = np.bincount(parent[element & (parent >= 0)], minlength=n) if n else np.zeros(0, dtype=np.int64)
        empty = element & (children == 0)
        childless = empty.tolist()
        filled = []
        texts, at_text = self.texts, np.flatnonzero(kind == 1)
        for i, p, g in zip(at_text.tolist(), parent[at_text].tolist(), page[at_text].tolist(), strict=True):
            text = texts[i]
            chars[i] = len(text)
            pieces[g].append(text)
            if p >= 0:
                own_text[p] = own_text[p] + text if own_text[p] else text
                if childless[p] and text.strip(HTML_SPACE):
                    filled.append(p)
        empty[filled] = False
        upto = np.cumsum(chars)
        ahead = upto - chars
        text_start = ahead - (ahead[page_start[page]] if n else ahead)
        # attributes
        ids: list[str | None] = [None] * n
        classes: list[list[str]] = []
        classed = np.zeros(n, dtype=np.int32)
        for i, attrs in enumerate(self.attrs):
            if attrs:
                for name, value, _ in attrs:
                    name = name if name.islower() else fold(name)
                    if name == "id":
                        ids[i] = value
                    elif name == "class":
                        names = class_set(value)
                        classed[i] = len(names)
                        classes.append(names)
        other = ~element
        made: dict = {}
        rule_codes = pa.array(np.array([0 if r is None else made.setdefault(r, len(made)) for r in self.rules], dtype=np.int32), mask=other)
        spelled = list(made) or [None]
        spaces = np.zeros(n, dtype=np.int32)
        for i, ns in self.spaces.items():
            spaces[i] = 1 if ns == "svg" else 2
        whole = lambda values: pa.array(values.astype(np.int32))
        some = lambda values: pa.array(values.astype(np.int32), mask=other)
        return (
            {
                "node_id": whole(number),
                "parent_id": whole(up),
                "subtree_end": whole(number + last - np.arange(n)),
                "depth": whole(depth),
                "ancestors": lists(lengths, pa.array(ancestors)),
                "node_type": pa.array(_KINDS).take(pa.array(kind.astype(np.int32))),
                "tag": pa.array([r and r.tag for r in spelled], pa.string()).take(rule_codes),
                "tag_lc": pa.array([r and r.low for r in spelled], pa.string()).take(rule_codes),
                "ns": pa.array(["html", "svg", "mathml"]).take(pa.array(spaces, mask=other)),
                "attrs": attribute_lists(self.attrs, other),
                "id_attr": pa.array(ids, pa.string()),
                "classes": lists(classed, pa.array([c for own in classes for c in own], pa.string()), other),
                "text": pa.array(texts, pa.string()),
                "elem_pos": some(place),
                "elem_rpos": some(count - place + 1),
                "elem_cnt": some(count),
                "type_pos": some(type_place),
                "type_rpos": some(type_count - type_place + 1),
                "type_cnt": some(type_count),
                "prev_elem_id": pa.array(before, mask=before == 0),
                "next_elem_id": pa.array(after, mask=after == 0),
                "is_empty": pa.array(empty, mask=other),
                "text_start": whole(text_start),
                "text_len": whole(upto[last] - ahead) if n else whole(upto),
                "own_text": pa.array(own_text, pa.string()),
            },
            sizes,
            ["".join(p) for p in pieces],
        )


def node_rows(tree: Tree, root: int) -> tuple[list[tuple], str]:
    """The rows of one page, as tuples without page_id, and its text."""
    held = NodeColumns()
    held.add(0, tree, root)
    columns, _, texts = held._nodes()
    values = [c.to_pylist() for c in columns.values()]
    at = list(columns).index("attrs")
    values[at] = [None if own is None else [tuple(a.values()) for a in own] for own in values[at]]
    return list(zip(*values, strict=True)), texts[0]
