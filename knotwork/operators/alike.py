"""Alike texts of a graph: all its pairs, in tiles, of which each end keeps its best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a task of best_alike reads (rows sorted by the first four columns, then ord and node_id) and gives.
VOCABULARY, OWN, OTHER = range(3)
ENDS = "graph_id string, settled boolean, ord long, node_id string, other_ord long, other_id string, edge_type string, weight double"
TYPES = pa.array(["similar-to", "shares-entity"])
#: By how much a rough product may be off; what is nearer to a bound is computed exactly.
NEAR = 5e-5


class Block:
    """Some texts' postings (row, key, value), by row in by_row and by key elsewhere: those of keys[k] lie from ptr[k] to ptr[k + 1]."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, values: np.ndarray, first: int, after: int):
        self.first, self.m = first, after - first
        order, self.by_row = np.argsort(keys, kind="stable"), (np.searchsorted(rows, np.arange(first, after + 1)), keys, values)
        self.rows, self.values = (rows[order] - first).astype(np.int64), values[order]
        self.rough = self.values.astype(np.float32)
        self.keys, at, self.n = np.unique(keys[order], return_index=True, return_counts=True)
        self.ptr = np.append(at, len(keys))
        self.places = np.repeat(np.arange(len(self.keys)), self.n) * self.m + self.rows


def cut(rows: np.ndarray, keys: np.ndarray, values: np.ndarray, m: int, size: int) -> list[Block]:
    """Postings, sorted by row, as blocks of `size` rows."""
    starts = range(0, m, size)
    at = np.searchsorted(rows, [*starts, m])
    return [Block(rows[a:b], keys[a:b], values[a:b], s, min(s + size, m)) for s, a, b in zip(starts, at, at[1:])]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def every(x: Block, ix: np.ndarray, y: Block, iy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x's and y's postings that meet in the keys x.keys[ix], y.keys[iy]."""
    i, many = spread(x.ptr[ix], x.n[ix]), np.repeat(y.n[iy], x.n[ix])
    return np.repeat(i, many), spread(np.repeat(y.ptr[iy], x.n[ix]), many)


def dots(x: Block, y: Block, room: np.ndarray, dense: float = 0.004, few: int = 1000, chunk: int = 200_000) -> np.ndarray:
    """The products of all texts of x and y within NEAR, by place i * y.m + j, in room: very common keys by one matrix product, common ones key by key, the others posting by posting."""
    _, ix, iy = np.intersect1d(x.keys, y.keys, assume_unique=True, return_indices=True)
    n = x.n[ix] * y.n[iy]
    common, each = n > dense * x.m * y.m, n >= few
    out = room[: x.m * y.m]
    a, b = np.zeros((common.sum(), x.m), room.dtype), np.zeros((common.sum(), y.m), room.dtype)
    for m, block, at in ((a, x, ix[common]), (b, y, iy[common])):
        for k, (p, q) in enumerate(zip(block.ptr[at], block.ptr[at + 1])):
            m[k, block.rows[p:q]] = block.rough[p:q]
    np.matmul(a.T, b, out=out.reshape(x.m, y.m))
    at, left = x.rows * y.m, ~common & each
    for p, q, r, s in zip(x.ptr[ix[left]], x.ptr[ix[left] + 1], y.ptr[iy[left]], y.ptr[iy[left] + 1]):
        out[at[p:q, None] + y.rows[r:s]] += x.rough[p:q, None] * y.rough[r:s]
    rare = np.flatnonzero(~common & ~each)
    for some in np.split(rare, np.flatnonzero(np.diff(np.cumsum(n[rare]) // chunk)) + 1):
        i, j = every(x, ix[some], y, iy[some])
        np.add.at(out, at[i] + y.rows[j], x.rough[i] * y.rough[j])
    return out


def exact(x: Block, i: np.ndarray, y: Block, j: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """The products of texts i of x and j of y, rounded to six digits."""
    out = np.zeros(len(i))
    ptr, keys, values = x.by_row
    for a in range(0, len(i), chunk):
        p, q = i[a : a + chunk], j[a : a + chunk]
        n = ptr[p + 1] - ptr[p]
        at, pair = spread(ptr[p], n), np.repeat(np.arange(len(p)), n)
        k = np.minimum(np.searchsorted(y.keys, keys[at]), len(y.keys) - 1)
        held = y.keys[k] == keys[at]
        at, pair, place = at[held], pair[held], k[held] * y.m + q[pair[held]]
        to = np.minimum(np.searchsorted(y.places, place), len(y.places) - 1)
        both = y.places[to] == place
        out[a : a + chunk] = np.bincount(pair[both], values[at[both]] * y.values[to[both]], len(p))
    return np.floor(out * 1e6 + 0.5) / 1e6


def alike_in(x: Block, y: Block, x_names: Block, y_names: Block, x_sizes: np.ndarray, y_sizes: np.ndarray, room: np.ndarray, similar: float, shared: float, x_least: np.ndarray, y_least: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """(i, j, weight, kind) of the pairs of two blocks that are similar-to (0) or else shares-entity (1), but those that weigh less than the least that each end still needs.

    same: of one list of texts, of which a pair's first comes first.
    """
    rough = dots(x, y, room)
    _, ix, iy = np.intersect1d(x_names.keys, y_names.keys, assume_unique=True, return_indices=True)
    p, q = every(x_names, ix, y_names, iy)
    met, both = np.unique(x_names.rows[p] * y.m + y_names.rows[q], return_counts=True)
    all_names = x_sizes[x.first + met // y.m] + y_sizes[y.first + met % y.m] - both
    share = (both * 2_000_000 + all_names) // (2 * all_names) / 1e6
    at = np.flatnonzero(rough >= similar - NEAR)
    keep = (share >= shared) & (rough[met] > 0) & (rough[met] < similar + NEAR)
    met, share = met[keep], share[keep]
    if same and x.first + x.m > y.first:
        first = lambda a: a // y.m + x.first < a % y.m + y.first
        at, met, share = at[first(at)], met[first(met)], share[first(met)]
    least = lambda a: np.minimum(x_least[x.first + a // y.m], y_least[y.first + a % y.m])
    at = at[(rough[at] < similar + NEAR) | (rough[at] >= least(at) - NEAR)]
    keep = share >= least(met)
    met, share = met[keep], share[keep]
    weight = exact(x, at // y.m, y, at % y.m)
    low = at[weight < similar]
    keep = (rough[met] < similar - NEAR) | np.isin(met, low)
    at, weight = np.concatenate([at[weight >= similar], met[keep]]), np.concatenate([weight[weight >= similar], share[keep]])
    kind = np.repeat([0, 1], [len(at) - keep.sum(), keep.sum()])
    return at // y.m + x.first, at % y.m + y.first, weight, kind


def among_best(end: np.ndarray, other: np.ndarray, weight: np.ndarray, most: int, least: np.ndarray | None = None) -> np.ndarray:
    """Which rows are among the `most` best of their end, by weight, then by the other end. least, by end, is raised to the weight of the last of `most`."""
    order = np.lexsort((other, -weight, end))
    sorted_end = end[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_end, sorted_end)
    keep = np.zeros(len(end), dtype=bool)
    keep[order[place < most]] = True
    if least is not None:
        last = order[place == most - 1]
        least[end[last]] = np.maximum(least[end[last]], weight[last])
    return keep


class Task:
    """The texts of a slice of a graph, against each other and against those of other slices as they come."""

    def __init__(self, slices: int, most: int, similar: float, shared: float, high: int = 1024, wide: int = 2048):
        self.slices, self.most, self.bounds, self.high, self.wide = slices, most, (similar, shared), high, wide
        self.vocabulary: list[tuple] = []
        self.rows: list[pa.RecordBatch] = []
        self.own: list[Block] | None = None
        self.seen, self.size = 0, 0
        self.kept: list[tuple] = []
        self.room = np.empty(high * wide, np.float32)

    def postings(self, texts: pa.Table | pa.RecordBatch) -> tuple[tuple, tuple, np.ndarray]:
        """(row, term, unit weight) and (row, name, 1) of texts, by row, and the number of each text's names."""
        flat = lambda c: pc.list_flatten(c).to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else pc.list_flatten(c.combine_chunks()).to_numpy(zero_copy_only=False)
        count = lambda c: pc.list_value_length(c).to_numpy().astype(np.int64)
        m, v = texts.num_rows, len(self.known)
        row = np.repeat(np.arange(m), count(texts["terms"]))
        met, freq = np.unique(row * v + np.searchsorted(self.known, flat(texts["terms"])), return_counts=True)
        row, term = met // max(v, 1), met % max(v, 1)
        w = freq * self.idf[term]
        sizes = count(texts["names"])
        return (row, term, w / np.sqrt(np.bincount(row, w * w, m))[row]), (np.repeat(np.arange(m), sizes), flat(texts["names"]), np.ones(sizes.sum())), sizes

    def begin(self) -> Iterator[pa.RecordBatch]:
        """Takes what came so far as the slice's own texts and gives what is best among them."""
        known, idf = (np.concatenate([v[k] for v in self.vocabulary]) if self.vocabulary else np.zeros(0, t) for k, t in ((0, np.int64), (1, float)))
        order = np.argsort(known)
        self.known, self.idf, self.vocabulary = known[order], idf[order], []
        texts = pa.Table.from_batches(self.rows)
        self.keys, self.rows = texts.select(["ord", "node_id"]).combine_chunks(), []
        terms, names, self.sizes = self.postings(texts)
        m = texts.num_rows
        self.own, self.named = cut(*terms, m, self.high), cut(*names, m, self.high)
        found: list[tuple[np.ndarray, ...]] = []
        size, base, self.least = 0, 0, np.zeros(m)

        def best() -> tuple[np.ndarray, ...]:
            i, j, w, kind = (np.concatenate(c) for c in zip(*found))
            keep = among_best(np.concatenate([i, j]), np.concatenate([j, i]), np.tile(w, 2), self.most, self.least)
            keep = keep[: len(i)] | keep[len(i) :]
            return tuple(c[keep] for c in (i, j, w, kind))

        for y, y_names in zip(cut(*terms, m, self.wide), cut(*names, m, self.wide)):
            for x, x_names in zip(self.own, self.named):
                if x.first < y.first + y.m:
                    found.append(alike_in(x, y, x_names, y_names, self.sizes, self.sizes, self.room, *self.bounds, self.least, self.least, True))
                    size += len(found[-1][0])
                    if size > 2 * base + 200_000:
                        found[:] = [best()]
                        size = base = len(found[0][0])
        if found:
            i, j, w, kind = (np.concatenate(c) for c in zip(*found))
            end, other, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(i)), 2)
            keep = among_best(end, other, np.tile(w, 2), self.most, self.least)
            if self.slices == 1:  # no other slice has better ones
                pair = np.flatnonzero(np.bincount(pair[keep], minlength=len(i)) == 2)
                yield self.ends(self.keys.take(i[pair]), self.keys.take(j[pair]), w[pair], kind[pair])
            else:
                yield self.ends(self.keys.take(end[keep]), self.keys.take(other[keep]), w[pair[keep]], kind[pair[keep]])

    def meet(self, texts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Gives the best of the slice's own texts for each of these, which are of another slice; keeps the best of these for each of its own."""
        terms, names, sizes = self.postings(texts)
        keys, least = pa.Table.from_batches([texts.select(["ord", "node_id"])]), np.zeros(texts.num_rows)
        for y, y_names in zip(cut(*terms, texts.num_rows, self.wide), cut(*names, texts.num_rows, self.wide)):
            found: list[tuple[np.ndarray, ...]] = []
            size, base = 0, 0
            for x, x_names in zip(self.own, self.named):
                i, j, w, kind = alike_in(x, y, x_names, y_names, self.sizes, sizes, self.room, *self.bounds, self.least, least, False)
                found.append((i, j, w, kind, among_best(i, j, w, self.most, self.least)))
                size += len(i)
                if size > 2 * base + 50_000:
                    i, j, w, kind, up = (np.concatenate(c) for c in zip(*found))
                    keep = up | among_best(j, i, w, self.most, least)
                    found[:] = [tuple(c[keep] for c in (i, j, w, kind, up))]
                    size = base = int(keep.sum())
            if not found:
                continue
            i, j, w, kind, up = (np.concatenate(c) for c in zip(*found))
            down = among_best(j, i, w, self.most)
            yield self.ends(keys.take(j[down]), self.keys.take(i[down]), w[down], kind[down])
            self.kept.append((i[up], j[up] + self.seen, w[up], kind[up], keys.take(j[up])))
            self.size += int(up.sum())
            if self.size > max(1_000_000, 4 * self.most * len(self.sizes)):
                self.kept = [self.best_kept()]
                self.size = len(self.kept[0][0])
        self.seen += texts.num_rows

    def best_kept(self) -> tuple:
        i, j, w, kind = (np.concatenate(c) for c in list(zip(*self.kept))[:4])
        at = np.flatnonzero(among_best(i, j, w, self.most, self.least))
        return i[at], j[at], w[at], kind[at], pa.concat_tables([k[4] for k in self.kept]).take(at).combine_chunks()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            i, _, w, kind, keys = self.best_kept()
            yield self.ends(self.keys.take(i), keys, w, kind)

    def ends(self, one: pa.Table, other: pa.Table, weight: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        columns = [*(c.combine_chunks() for c in (*one.columns, *other.columns)), TYPES.take(pa.array(kind, pa.int64())), pa.array(weight, pa.float64())]
        n, columns = len(weight), [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([self.graph] * n, pa.string()), pa.array([self.slices == 1] * n, pa.bool_()), *columns], names=[c.split()[0] for c in ENDS.split(", ")])


def best_alike(most: int, similar: float, shared: float, **sizes):
    """The work of a task over sorted rows (graph_id, slice, kind, slices, ord, node_id, terms, names, idf): see graph.similarity_edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, None
        for batch in batches:
            graphs = batch["graph_id"].dictionary_encode()
            codes = np.stack([graphs.indices.to_numpy(), batch["slice"].to_numpy(), batch["kind"].to_numpy()])
            bounds = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                run, kind = batch.slice(a, b - a), int(codes[2, a])
                key = (batch["graph_id"][a].as_py(), int(codes[1, a]))
                if key != now:
                    if task:
                        yield from finish(task)
                    now, task = key, Task(batch["slices"][a].as_py(), most, similar, shared, **sizes)
                    task.graph = key[0]
                if kind == VOCABULARY:
                    task.vocabulary.append((pc.list_flatten(run["terms"]).to_numpy(), run["idf"].to_numpy()))
                elif kind == OWN:
                    task.rows.append(run)
                elif task.rows or task.own is not None:
                    if task.own is None:
                        yield from task.begin()
                    yield from task.meet(run)
        if task:
            yield from finish(task)

    def finish(task: Task) -> Iterator[pa.RecordBatch]:
        if task.own is None and task.rows:
            yield from task.begin()
        yield from task.end()

    return work
