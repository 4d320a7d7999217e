"""Numpy kernels that run inside Spark tasks on one Arrow batch or one bounded group.

The module is pickled by value, so workers need no installed copy of the package.
"""

from __future__ import annotations


import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_CHUNK = 1 << 21  # distance cells held at once


def matrix(column) -> np.ndarray:
    """List column -> (rows, dims) float matrix."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def chunks(rows: np.ndarray, width: int):
    """Row numbers in pieces whose distance matrix stays small."""
    step = max(1, QUERY_CHUNK // max(width, 1))
    return (rows[i : i + step] for i in range(0, len(rows), step))


def kth_at_most(dist: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of each row's k-th smallest value: k groups of columns have a value up to the k-th least of their minima."""
    wide = dist.shape[1] // 16
    if wide >= 8 * k:
        least = dist[:, :wide].copy()
        for i in range(1, 16):
            np.minimum(least, dist[:, i * wide : (i + 1) * wide], out=least)
        dist = least
    return np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] > k else np.full(len(dist), np.inf)


def top_k(q_id, q, c_id, c, k, exclude_self=True, decimals=9, limit=None):
    """Rows (query, neighbour, distance) of the k nearest candidates by (rounded distance, id).

    Shortlists come from the product form of the distance with a tolerance that covers its
    rounding error; the kept distances are recomputed exactly, so results do not depend on how
    the candidates were cut into blocks. `limit` holds an upper bound per query.
    """
    out_q, out_c, out_d, out_r = [], [], [], []
    m, dims = c.shape if len(c) else (0, 0)
    if m == 0 or len(q) == 0:
        return np.array([], "i8"), np.array([], "i8"), np.array([], "f8"), np.array([], "i4")
    c_norm = (c * c).sum(1)
    order = np.argsort(c_id, kind="stable")
    sorted_ids = c_id[order]
    step = max(1, QUERY_CHUNK // m)
    for start in range(0, len(q), step):
        qs, ids = q[start : start + step], q_id[start : start + step]
        q_norm = (qs * qs).sum(1)
        dist = q_norm[:, None] + c_norm[None, :] - 2.0 * (qs @ c.T)
        if exclude_self:
            at = np.minimum(np.searchsorted(sorted_ids, ids), m - 1)
            hit = np.nonzero(sorted_ids[at] == ids)[0]
            dist[hit, order[at[hit]]] = np.inf
        error = 1e-14 * (dims + 4) * (q_norm + c_norm.max())
        cut = kth_at_most(dist, k)
        if limit is not None:
            bound = limit[start : start + step]
            cut = np.minimum(cut, bound * bound)
        with np.errstate(invalid="ignore"):
            cut = cut + error + 4e-9 * (np.sqrt(np.maximum(cut, 0.0)) + 1e-3)
        rows, cols = np.nonzero((dist <= cut[:, None]) & np.isfinite(dist))
        gap = qs[rows] - c[cols]
        exact = np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), decimals)
        near = np.lexsort((c_id[cols], exact, rows))
        rows, cols, exact = rows[near], cols[near], exact[near]
        first = np.searchsorted(rows, rows, side="left")
        rank = np.arange(len(rows)) - first
        keep = rank < k
        out_q.append(ids[rows[keep]])
        out_c.append(c_id[cols[keep]])
        out_d.append(exact[keep])
        out_r.append((rank[keep] + 1).astype("i4"))
    return tuple(np.concatenate(x) for x in (out_q, out_c, out_d, out_r))


def mismatch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of one-hot codes (..., columns): 2 for each pair of different categories, 1 where only one side is unseen (below 0)."""
    return np.where(a == b, 0, 2 - (a < 0) - (b < 0)).sum(-1).astype(float)


def near_pairs(q_id, q, c_id, c, k, exclude_self=True, decimals=9, limit=None, q_codes=None, c_codes=None, prefix=0, count=None):
    """As `top_k`, for vectors with category codes beside them, and for wide vectors that are rotated so that their first `prefix` places hold most of their length.

    The distance of the prefixes and, by Cauchy-Schwarz, the difference of the norms of the rests bound a pair's distance from below;
    pairs whose bound passes the k-th best distance of a first guess are closed unseen. `count` collects (pairs, closed).
    """
    m = len(c)
    empty = np.array([], "i8"), np.array([], "i8"), np.array([], "f8"), np.array([], "i4")
    if m == 0 or len(q) == 0:
        return empty
    head = prefix or q.shape[1]
    rest = lambda x: np.sqrt((x[:, head:] ** 2).sum(1))
    c_rest, out = rest(c), [empty]
    scale = (c * c).sum(1).max(initial=0.0)
    for at in chunks(np.arange(len(q)), m):
        qs, ids = q[at], q_id[at]
        lower = squared_distances(qs[:, :head], c[:, :head])
        if prefix:
            lower += (rest(qs)[:, None] - c_rest) ** 2
        if q_codes is not None:
            for a, b in zip(q_codes[at].T, c_codes.T):  # column by column: no third dimension in memory
                weight = 2.0 if min(a.min(), b.min()) >= 0 else 2.0 - (a < 0)[:, None] - (b < 0)
                np.add(lower, weight, out=lower, where=a[:, None] != b)
        own = c_id[None, :] == ids[:, None] if exclude_self else np.zeros(lower.shape, bool)
        lower[own] = np.inf
        error = 1e-13 * (q.shape[1] + 4) * ((qs * qs).sum(1) + scale)[:, None]

        def exact(rows, cols):
            found = np.empty(len(rows))
            for part in chunks(np.arange(len(rows)), q.shape[1]):  # noqa: B023
                gap = qs[rows[part]] - c[cols[part]]  # noqa: B023
                found[part] = np.einsum("ij,ij->i", gap, gap)
                if q_codes is not None:
                    found[part] += mismatch(q_codes[at[rows[part]]], c_codes[cols[part]])  # noqa: B023
            return np.where(own[rows, cols], np.inf, found)  # noqa: B023

        if prefix:
            wide = min(k, m)
            guess = np.argpartition(lower, wide - 1, axis=1)[:, :wide]
            each = np.repeat(np.arange(len(at)), wide)
            cut = exact(each, guess.ravel()).reshape(-1, wide).max(1) if m >= k else np.full(len(at), np.inf)
        else:  # the bound is the distance itself, up to its rounding error
            cut = np.maximum(kth_at_most(lower, k) + error[:, 0], 0.0)
        if limit is not None:
            cut = np.minimum(cut, limit[at] ** 2)
        with np.errstate(invalid="ignore"):
            cut = cut + 4e-9 * (np.sqrt(cut) + 1e-3)
        open_ = (lower - error <= cut[:, None]) & ~own
        if count is not None:
            count += np.array([lower.size, lower.size - np.count_nonzero(open_)])
        if prefix and np.count_nonzero(open_) * 64 > open_.size:  # too many for one by one: the rests' product closes all but the nearest
            lower += 2.0 * (np.outer(rest(qs), c_rest) - qs[:, head:] @ c[:, head:].T)
            nearest = kth_at_most(lower, k) + error[:, 0]
            cut = np.minimum(cut, nearest + 4e-9 * (np.sqrt(np.maximum(nearest, 0.0)) + 1e-3))
            open_ &= lower - error <= cut[:, None]
        rows, cols = np.nonzero(open_)
        dist = np.round(np.sqrt(exact(rows, cols)), decimals)
        near = np.lexsort((c_id[cols], dist, rows))
        rows, cols, dist = rows[near], cols[near], dist[near]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = rank < k
        out.append((ids[rows[keep]], c_id[cols[keep]], dist[keep], (rank[keep] + 1).astype("i4")))
    return tuple(np.concatenate(x) for x in zip(*out))


def block_search(k: int, exclude_self: bool, decimals: int, prefix: int = 0):
    """Cogroup function: the queries of one block against the candidates of the block."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        limit = queries["reach"].to_numpy() if "reach" in queries.column_names else None
        given = (queries["id"].to_numpy(), matrix(queries["vec"]), candidates["id"].to_numpy(), matrix(candidates["vec"]), k, exclude_self, decimals, limit)
        if prefix or "codes" in queries.column_names:
            codes = [matrix(t["codes"]).astype(np.int64) if "codes" in t.column_names else None for t in (queries, candidates)]
            q, c, d, r = near_pairs(*given, *codes, prefix)
        else:
            q, c, d, r = top_k(*given)
        return pa.table({"query_id": pa.array(q, pa.int64()), "neighbor_id": pa.array(c, pa.int64()),
                         "distance": pa.array(d, pa.float64()), "rank": pa.array(r, pa.int32())})

    return run


class Boxes:
    """Cells made by halving cuts: node i sends a point to `left[i]` if its coordinate `dim[i]` is at most `cut[i]`, else to `right[i]`.

    Points are vectors with category codes beside them; `plain` coordinates are numbers, the rest codes. Leaves have no children
    (-1); a leaf's node number is its cell. `low` and `high` hold the box of all candidates below a node.
    """

    def __init__(self, sample: np.ndarray, leaf_rows: int, plain: int):
        self.plain = plain
        dim, cut, left, right, parts = [0], [0.0], [-1], [-1], [(0, sample)]
        while parts:
            node, x = parts.pop()
            found = _halves(x, leaf_rows, plain)
            if found is None:
                continue
            dim[node], cut[node] = found
            below = x[:, found[0]] <= found[1]
            left[node], right[node] = len(dim), len(dim) + 1
            for child in (x[below], x[~below]):
                parts.append((len(dim), child))
                dim.append(0), cut.append(0.0), left.append(-1), right.append(-1)
        self.dim, self.cut, self.left, self.right = np.array(dim), np.array(cut), np.array(left), np.array(right)
        self.low, self.high = np.full((len(dim), sample.shape[1]), np.inf), np.full((len(dim), sample.shape[1]), -np.inf)

    def fit(self, cells, low, high) -> None:
        """Set the boxes of the leaves, and with them those of all nodes."""
        self.low[cells], self.high[cells] = low, high
        for i in range(len(self.dim) - 1, -1, -1):  # children stand behind their parent
            if self.left[i] >= 0:
                pair = [self.left[i], self.right[i]]
                self.low[i], self.high[i] = self.low[pair].min(0), self.high[pair].max(0)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.left[0] >= 0 else np.array([], np.int64)
        while len(rows):
            node = at[rows]
            at[rows] = np.where(x[rows, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])
            rows = rows[self.left[at[rows]] >= 0]
        return at

    def bound(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least distance from each point to any candidate below its node."""
        low, high = self.low[node], self.high[node]
        p = self.plain
        gap = np.maximum(np.maximum(low[:, :p] - x[:, :p], x[:, :p] - high[:, :p]), 0.0)
        total = np.einsum("ij,ij->i", gap, gap)
        if x.shape[1] > p:
            codes, low, high = x[:, p:], low[:, p:], high[:, p:]
            total += np.where((codes < low) | (codes > high), 2.0 - (codes < 0) - (low < 0), 0.0).sum(1)
        return np.sqrt(total)


def _halves(x: np.ndarray, leaf_rows: int, plain: int):
    """(coordinate, cut) that divides the points in two of about the same number where that shortens distances most; None for a leaf.

    A cut of numbers takes three quarters of their variance; the cuts that single out a category share what that saves.
    """
    if len(x) <= leaf_rows:
        return None
    gains = 1.5 * x[:, :plain].var(0)
    for c in x[:, plain:].T:
        share = np.unique(c, return_counts=True)[1] / len(c)
        kinds = np.exp(-(share * np.log(share)).sum())
        gains = np.append(gains, 2.0 * (1.0 - 1.0 / kinds) / np.log2(kinds) if kinds > 1.001 else 0.0)
    least, best = max(1, leaf_rows // 2), None
    for d in np.argsort(-gains, kind="stable"):
        if gains[d] <= 0:
            break
        v = x[:, d]
        middle = np.partition(v, len(v) // 2)[len(v) // 2]
        for cut in (v[v < middle].max(initial=-np.inf), middle):
            side = np.count_nonzero(v <= cut)
            side = min(side, len(v) - side)
            if side >= least and (best is None or side > best[0]):
                best = (side, int(d), float(cut))
        if best and best[0] * 8 >= len(v):
            break
    return best and best[1:]


def _points(batch) -> np.ndarray:
    vec = matrix(batch.column("vec"))
    return np.concatenate([vec, matrix(batch.column("codes"))], axis=1) if "codes" in batch.schema.names else vec


def _strata(batch):
    """(stratum, row numbers) of the strata in a batch."""
    codes = batch.column("stratum").dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    return [(name, np.nonzero(at == i)[0]) for i, name in enumerate(codes.dictionary.to_pylist())]


def assign_cells(boxes: dict):
    """Map function: the leaf of the row's stratum that the row falls into; strata without boxes are one cell."""

    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                x = _points(batch)
                for name, at in _strata(batch):
                    if name in boxes:
                        cell[at] = boxes[name].leaf(x[at])
            names = ["stratum", "id", *[n for n in ("vec", "codes") if n in batch.schema.names]]
            yield pa.record_batch([*[batch.column(n) for n in names], pa.array(cell, pa.int64())], names=[*names, "cell"])

    return run


def route_queries(boxes: dict):
    """Map function: cells (other than the home cell) whose box may still hold a candidate within the query's reach."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, home = _points(batch), batch.column("cell").to_numpy()
            reach = batch.column("reach").to_numpy(zero_copy_only=False)
            names = [n for n in batch.schema.names if n != "cell"]
            for name, at in _strata(batch):
                tree, open_ = boxes[name], [(at, np.zeros(len(at), np.int64))]
                while open_:  # depth first, in pieces, so that queries without a reach stay within memory
                    row, node = open_.pop()
                    if len(row) > 100_000:
                        open_ += [(row[50_000:], node[50_000:]), (row[:50_000], node[:50_000])]
                        continue
                    bound = tree.bound(x[row], node)
                    near = bound - 1e-7 * (1.0 + bound) <= reach[row]
                    row, node = row[near], node[near]
                    inner = tree.left[node] >= 0
                    found = ~inner & (node != home[row])
                    if found.any():
                        part = batch.take(pa.array(row[found], pa.int64()))
                        yield pa.record_batch([*[part.column(n) for n in names], pa.array(node[found], pa.int64())], names=[*names, "cell"])
                    row, node = row[inner], node[inner]
                    if len(row):
                        open_.append((np.concatenate([row, row]), np.concatenate([tree.left[node], tree.right[node]])))

    return run


def nearest_children(first: int):
    """Cogroup function: the `first` nearest pivots of the row's cell, with the distance."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        ids, vec = rows["id"].to_numpy(), matrix(rows["vec"])
        order = np.argsort(pivots["child"].to_numpy(), kind="stable")
        children, at = pivots["child"].to_numpy()[order], matrix(pivots["pivot"])[order]
        wide, picks, gaps = min(first, len(children)), [], []
        for part in chunks(np.arange(len(ids)), len(children)):
            near = np.argsort(squared_distances(vec[part], at), axis=1, kind="stable")[:, :wide]
            gap = vec[part][:, None, :] - at[near]
            picks.append(children[near].ravel())
            gaps.append(np.sqrt((gap * gap).sum(-1)).ravel())
        return pa.table({"id": pa.array(np.repeat(ids, wide), pa.int64()), "cell": pa.array(np.concatenate([*picks, np.array([], "i8")]), pa.int64()), "gap": pa.array(np.concatenate([*gaps, np.array([])]), pa.float64())})

    return run


def open_children():
    """Cogroup function: children of the row's cell whose distance shell may hold something within the row's reach, with the lower bound."""

    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        ids, vec, reach = rows["id"].to_numpy(), matrix(rows["vec"]), rows["reach"].to_numpy()
        children, at = nodes["child"].to_numpy(), matrix(nodes["pivot"])
        low, high, out = nodes["low"].to_numpy(), nodes["high"].to_numpy(), []
        for part in chunks(np.arange(len(ids)), len(children)):
            d = np.sqrt(squared_distances(vec[part], at))
            bound = np.maximum(np.maximum(d - high, low - d), 0.0) - 1e-7 * (1.0 + d)
            i, j = np.nonzero(bound <= reach[part][:, None])
            out.append((ids[part][i], children[j], bound[i, j]))
        out.append((np.array([], "i8"), np.array([], "i8"), np.array([])))
        i, j, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"id": pa.array(i, pa.int64()), "cell": pa.array(j, pa.int64()), "bound": pa.array(b, pa.float64())})

    return run


def partial_gram(dims: int):
    """Map function: one row of the partial Gram matrix per dimension and partition."""

    def run(batches):
        total, seen = np.zeros((dims, dims)), False
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"))
                total += x.T @ x
                seen = True
        if seen:
            yield pa.record_batch(
                [pa.array(np.arange(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"]
            )

    return run


def project(components: np.ndarray, offset: np.ndarray):
    """Map function: (x - offset) @ components for an Arrow batch, appended as `reduced`."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = (matrix(batch.column("vec")) - offset) @ components
            else:
                x = np.zeros((0, components.shape[1]))
            offsets = pa.array(np.arange(len(x) + 1) * components.shape[1], pa.int32())
            reduced = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel()))
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "vec"]
            names = [n for n in batch.schema.names if n != "vec"]
            yield pa.record_batch([*columns, reduced], names=[*names, "reduced"])

    return run


