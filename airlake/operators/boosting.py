"""Second-order histogram boosting of regression trees.

Feature values become bins once, rows become blocks of bytes in a written table. A tree grows by levels: tasks sum gradients
and counts of their rows by (node, feature, bin), these sums are added up by (node, feature), and the best split of each node
is the one of largest gain under an L2 penalty. Nodes of at most ``LOCAL`` rows are not worth a job a level: their rows meet in
one task each, and that grows the whole subtree with the same sums. If all rows are that few, a task grows a stretch of trees.

Gradients are rounded to a fixed unit, so their sums are exact and no result depends on the order of rows, and rows are
sampled by a hash of their content and the tree's number, so it does not depend on partitions either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake import schema as S
from airlake.operators.trees import Ensemble
from airlake.session import materialize

#: Rows of a block; rows of a node that one task grows; trees of a stretch; trees after which predictions are written anew.
BLOCK, LOCAL, STRETCH, CUT = 8192, 50_000, 50, 8
#: Unit of gradients.
UNIT = 2.0**-20
_NODE = ("feature", "bin", "left", "right", "value", "cover", "gain")
_TREE = "trial int, tree int, " + ", ".join(f"{c} binary" for c in _NODE) + ", error double"


@dataclass(frozen=True)
class Params:
    rounds: int = 300
    depth: int = 8
    rate: float = 0.05
    #: Shares of rows and of features that a tree sees.
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    #: Least weight (rows, for squared error) of a leaf.
    least: float = 1.0
    #: Rounds without a better held-out error before fitting stops; 0 turns that off.
    patience: int = 10
    bins: int = 64
    seed: int = 42


# --- one node ---------------------------------------------------------------


def gains(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    """Gain of each split (node, feature, bin) after a bin, from sums by bin; minus infinity where a side is too light."""
    left_g, left_h = g.cumsum(-1), h.cumsum(-1)
    total_g, total_h = left_g[..., -1:], left_h[..., -1:]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g**2 / (left_h + p.l2) + right_g**2 / (right_h + p.l2) - total_g**2 / (total_h + p.l2)
    return np.where((left_h >= p.least) & (right_h >= p.least) & (left_h > 0) & (right_h > 0), gain / 2, -np.inf)


def sums(bins: np.ndarray, node: np.ndarray, g: np.ndarray, n_nodes: int, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and row sums by (node, feature, bin)."""
    width = bins.shape[1]
    cell = ((node[:, None] * width + np.arange(width)) * n_bins + bins).ravel()
    shape = n_nodes, width, n_bins
    total = n_nodes * width * n_bins
    return np.bincount(cell, np.repeat(g, width), total).reshape(shape), np.bincount(cell, minlength=total).reshape(shape).astype(np.float64)


def leaf_value(g: float | np.ndarray, h: float | np.ndarray, p: Params) -> float | np.ndarray:
    return -p.rate * g / (h + p.l2)


def grow(bins: np.ndarray, g: np.ndarray, columns: np.ndarray, p: Params, depth: int) -> dict[str, np.ndarray]:
    """The subtree of these rows as arrays, its root first; ``columns`` are the features it may split on."""
    out: dict[str, list] = {c: [] for c in _NODE}

    def leaf(total: float, weight: float) -> int:
        k = len(out["feature"])
        for c, v in zip(_NODE, (-1, 0, k, k, leaf_value(total, weight, p), weight, 0.0)):
            out[c].append(v)
        return k

    leaf(float(g.sum()), float(len(g)))
    frontier, node, seen = [0], np.zeros(len(g), np.int64), bins[:, columns].astype(np.int64)
    for _ in range(depth):
        if not frontier or not len(g):
            break
        sum_g, sum_h = sums(seen, node, g, len(frontier), p.bins)
        gain = gains(sum_g, sum_h, p).reshape(len(frontier), -1)
        best = gain.argmax(1)
        ways, follow = np.full((len(frontier), 2), -1), []
        cut_feature, cut_bin = best // p.bins, best % p.bins
        for k, parent in enumerate(frontier):
            if not gain[k, best[k]] > 1e-9:
                continue
            f, b = int(cut_feature[k]), int(cut_bin[k])
            left_g, left_h = float(sum_g[k, f, : b + 1].sum()), float(sum_h[k, f, : b + 1].sum())
            all_g, all_h = float(sum_g[k, f].sum()), float(sum_h[k, f].sum())
            children = leaf(left_g, left_h), leaf(all_g - left_g, all_h - left_h)
            for c, v in zip(("feature", "bin", "left", "right", "value", "gain"), (int(columns[f]), b, *children, 0.0, float(gain[k, best[k]]))):
                out[c][parent] = v
            ways[k] = len(follow), len(follow) + 1
            follow += children
        right = seen[np.arange(len(node)), cut_feature[node]] > cut_bin[node]
        node = ways[node, right.astype(np.int64)]
        stays = node >= 0
        node, g, seen, frontier = node[stays], g[stays], seen[stays], follow
    return {c: np.array(v, np.float64 if c in ("value", "cover", "gain") else np.int64) for c, v in out.items()}


def reached(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node of the tree where each row stops."""
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (inner := tree["feature"][node] >= 0).any():
        ahead = np.where(bins[row, np.maximum(tree["feature"][node], 0)] <= tree["bin"][node], tree["left"][node], tree["right"][node])
        node = np.where(inner, ahead, node)
    return node


def sampled(key: np.ndarray, tree: int, p: Params) -> np.ndarray:
    """Rows that a tree sees."""
    x = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + p.seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(p.rows, 1.0) * (2**64 - 1025))


def seen_columns(n: int, tree: int, p: Params) -> np.ndarray:
    """Features that a tree sees, in order."""
    keep = max(1, round(p.columns * n))
    return np.sort(np.random.default_rng((p.seed, tree)).choice(n, keep, replace=False))


def gradients(margin: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of squared error, in whole units; the second derivative of each row is 1."""
    return np.rint((margin - label) / UNIT) * UNIT


# --- binned blocks ----------------------------------------------------------


@dataclass(frozen=True)
class Binned:
    """Rows as blocks: (key, bins, label, held, margin) bytes of up to ``BLOCK`` rows each, in a written table."""

    blocks: DataFrame
    features: tuple[str, ...]
    cuts: list[np.ndarray]
    base: float
    rows: int


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last of each feature: quantiles of a mergeable sketch, without repeats."""
    at = [(k + 1) / bins for k in range(bins - 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10 * bins).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], np.float64)) for c in features]


def binned(df: DataFrame, features: Sequence[str], label: str, held_out: str | None, bins: int) -> Binned:
    """Bin ``df`` once; ``held_out`` names a flag column of rows that only decide when to stop."""
    flag = F.col(held_out).cast("boolean") if held_out else F.lit(False)
    cuts = bin_cuts(df.where(~flag), features, bins)
    base, n = df.agg(F.avg(F.when(~flag, F.col(label))), F.count(F.lit(1))).first()
    # The last bits of a mean depend on the order of rows.
    base = round((base or 0.0) / UNIT) * UNIT
    names = list(features)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                cells = np.column_stack([np.searchsorted(cuts[k], part[c].to_numpy(np.float64)) for k, c in enumerate(names)]).astype(np.uint8)
                label_bytes = part["_label"].to_numpy(np.float64).tobytes()
                yield pd.DataFrame({"key": [part["_key"].to_numpy(np.int64).tobytes()], "bins": [cells.tobytes()], "label": [label_bytes], "held": [part["_held"].to_numpy(bool).tobytes()], "margin": [np.full(len(part), base).tobytes()]})

    key = F.xxhash64(*[F.col(c).cast("double") for c in names], F.col(label).cast("double"))
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(label).cast("double").alias("_label"), flag.alias("_held"), key.alias("_key"))
    blocks = rows.mapInPandas(pack, "key binary, bins binary, label binary, held binary, margin binary")
    return Binned(materialize(blocks, "binned"), tuple(features), cuts, base, n)


def _arrays(row, width: int) -> tuple[np.ndarray, ...]:
    kinds = ("key", np.int64), ("bins", np.uint8), ("label", np.float64), ("held", bool), ("margin", np.float64)
    key, cells, label, held, margin = (np.frombuffer(row[c], kind) for c, kind in kinds)
    return key, cells.reshape(-1, width), label, held, margin


def _packed(trial: int, number: int, tree: dict[str, np.ndarray], error: float) -> dict:
    return {"trial": trial, "tree": number, **{c: tree[c].tobytes() for c in _NODE}, "error": error}


def _unpacked(row) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], np.float64 if c in ("value", "cover", "gain") else np.int64) for c in _NODE}


# --- few rows: stretches of trees in a task for each trial -------------------


def _stretch(data: Binned, trials: dict[int, Params], grown: dict[int, list], upto: dict[int, int]) -> DataFrame:
    """Trees of each trial from those it has up to the number wanted, or until its held-out error has not improved for long."""
    width = len(data.features)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        trial = int(block["trial"].iloc[0])
        p, have = trials[trial], grown[trial]
        key, cells, label, held, margin = (np.concatenate(x) for x in zip(*(_arrays(r, width) for _, r in block.iterrows())))
        order = np.argsort(key, kind="stable")
        key, cells, label, held, margin = key[order], cells[order], label[order], held[order], margin[order]
        errors = [e for _, e in have]
        for tree, _ in have:
            margin = margin + tree["value"][reached(tree, cells)]
        rows = []
        for number in range(len(have), upto[trial]):
            if stopped(errors, p):
                break
            mine = sampled(key, number, p) & ~held
            tree = grow(cells[mine], gradients(margin[mine], label[mine]), seen_columns(width, number, p), p, p.depth)
            margin = margin + tree["value"][reached(tree, cells)]
            errors.append(float(np.mean((margin[held] - label[held]) ** 2)) if held.any() else float("nan"))
            rows.append(_packed(trial, number, tree, errors[-1]))
        return pd.DataFrame(rows, columns=["trial", "tree", *_NODE, "error"])

    each = data.blocks.withColumn("trial", F.explode(F.array(*[F.lit(t) for t in sorted(trials)])))
    n = max(len(trials), 1)
    return each.repartition(n, "trial").groupBy("trial").applyInPandas(run, _TREE)


def stopped(errors: list[float], p: Params) -> bool:
    """Whether the last ``patience`` held-out errors are all no better than the best before them."""
    if not p.patience or len(errors) <= p.patience or np.isnan(errors[-1]):
        return False
    return min(errors[-p.patience :]) >= min(errors[: -p.patience])


# --- many rows: a job a level -------------------------------------------------


def _level(data: Binned, later: list, tree: dict[str, list], large: list[int], number: int, p: Params, columns: np.ndarray) -> DataFrame:
    """(node, feature, gain, bin, left_g, left_h, g, h): the best split of each large node by each feature, and as node -1 the
    sum of squared errors and the number of the held-out rows."""
    width, wanted = len(data.features), {n: k for k, n in enumerate(large)}
    partial = {c: np.array(v) for c, v in tree.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total_g = np.zeros((len(large), len(columns), p.bins))
        total_h, error, count = total_g.copy(), 0.0, 0.0
        lookup = np.full(len(partial["feature"]), -1)
        lookup[large] = np.arange(len(large))
        for batch in batches:
            for _, row in batch.iterrows():
                key, cells, label, held, margin = _arrays(row, width)
                for done in later:
                    margin = margin + done["value"][reached(done, cells)]
                error, count = error + float(((margin[held] - label[held]) ** 2).sum()), count + float(held.sum())
                node = lookup[reached(partial, cells)]
                mine = (node >= 0) & sampled(key, number, p) & ~held
                g, h = sums(cells[mine][:, columns].astype(np.int64), node[mine], gradients(margin[mine], label[mine]), len(large), p.bins)
                total_g, total_h = total_g + g, total_h + h
        cells = [(n, int(f), total_g[k, i].tobytes(), total_h[k, i].tobytes()) for n, k in wanted.items() for i, f in enumerate(columns)]
        cells.append((-1, -1, np.array([error]).tobytes(), np.array([count]).tobytes()))
        yield pd.DataFrame(cells, columns=["node", "feature", "g", "h"])

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        g, h = (np.sum([np.frombuffer(x) for x in rows[c]], 0) for c in ("g", "h"))
        node, feature = int(rows["node"].iloc[0]), int(rows["feature"].iloc[0])
        if node < 0:
            return pd.DataFrame([(node, feature, 0.0, 0, 0.0, 0.0, float(g[0]), float(h[0]))], columns=out)
        gain = gains(g, h, p)
        b = int(gain.argmax())
        return pd.DataFrame([(node, feature, float(gain[b]), b, float(g[: b + 1].sum()), float(h[: b + 1].sum()), float(g.sum()), float(h.sum()))], columns=out)

    out = ["node", "feature", "gain", "bin", "left_g", "left_h", "g", "h"]
    sums_of_tasks = data.blocks.mapInPandas(run, "node int, feature int, g binary, h binary")
    return sums_of_tasks.groupBy("node", "feature").applyInPandas(best, "node int, feature int, gain double, bin int, left_g double, left_h double, g double, h double")


def _subtrees(data: Binned, later: list, tree: dict[str, list], small: dict[int, int], number: int, p: Params, columns: np.ndarray) -> DataFrame:
    """The subtree of each small node (its number to its depth), grown where its rows meet."""
    width = len(data.features)
    partial = {c: np.array(v) for c, v in tree.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                key, cells, label, held, margin = _arrays(row, width)
                for done in later:
                    margin = margin + done["value"][reached(done, cells)]
                mine = sampled(key, number, p) & ~held
                node, own, g = reached(partial, cells)[mine], cells[mine], gradients(margin[mine], label[mine])
                found = [n for n in np.unique(node).tolist() if n in small]
                yield pd.DataFrame({"node": found, "bins": [own[node == n].tobytes() for n in found], "g": [g[node == n].tobytes() for n in found]})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = int(rows["node"].iloc[0])
        cells = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, width)
        found = grow(cells, np.frombuffer(b"".join(rows["g"]), np.float64), columns, p, p.depth - small[node])
        return pd.DataFrame([_packed(0, node, found, 0.0)], columns=["trial", "tree", *_NODE, "error"])

    return data.blocks.mapInPandas(deal, "node int, bins binary, g binary").groupBy("node").applyInPandas(run, _TREE)


def _tree_by_levels(data: Binned, later: list, number: int, p: Params, local: int) -> tuple[dict[str, np.ndarray], float]:
    """The next tree, and the held-out error of the trees before it."""
    columns = seen_columns(len(data.features), number, p)
    tree: dict[str, list] = {"feature": [-1], "bin": [0], "left": [0], "right": [0], "value": [0.0], "cover": [0.0], "gain": [0.0]}
    large, small, depth, error = [0], {}, 0, float("nan")

    def leaf(g: float, h: float) -> int:
        k = len(tree["feature"])
        for c, v in zip(_NODE, (-1, 0, k, k, leaf_value(g, h, p), h, 0.0)):
            tree[c].append(v)
        return k

    while large:
        found: dict[int, tuple] = {}
        for r in _level(data, later, tree, large, number, p, columns).collect():
            if r["node"] < 0:
                error = r["g"] / r["h"] if r["h"] else float("nan")
            elif r["node"] not in found or (-r["gain"], r["feature"]) < (-found[r["node"]]["gain"], found[r["node"]]["feature"]):
                found[r["node"]] = r
        follow = []
        for node, r in sorted(found.items()):
            if node == 0:
                tree["value"][0], tree["cover"][0] = leaf_value(r["g"], r["h"], p), r["h"]
            if not r["gain"] > 1e-9 or depth >= p.depth:
                continue
            children = leaf(r["left_g"], r["left_h"]), leaf(r["g"] - r["left_g"], r["h"] - r["left_h"])
            for c, v in zip(("feature", "bin", "left", "right", "value", "gain"), (r["feature"], r["bin"], *children, 0.0, r["gain"])):
                tree[c][node] = v
            for child in children:
                if depth + 1 < p.depth:
                    if tree["cover"][child] > local:
                        follow.append(child)
                    else:
                        small[child] = depth + 1
        large, depth = follow, depth + 1
    if small:
        for r in _subtrees(data, later, tree, small, number, p, columns).collect():
            sub, root, shift = _unpacked(r), r["tree"], len(tree["feature"]) - 1
            # The subtree's root takes the place of the node; its other nodes go to the end.
            place = lambda k, root=root, shift=shift: np.where(k == 0, root, k + shift)
            sub = {**sub, "left": place(sub["left"]), "right": place(sub["right"])}
            for c in _NODE:
                tree[c][root] = sub[c][0].item()
                tree[c] += sub[c][1:].tolist()
    kinds = {c: np.float64 if c in ("value", "cover", "gain") else np.int64 for c in _NODE}
    return {c: np.array(v, kinds[c]) for c, v in tree.items()}, error


def _with_margins(data: Binned, later: list) -> Binned:
    """The blocks with the predictions of further trees, written anew."""
    width = len(data.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            margins = []
            for _, row in batch.iterrows():
                _, cells, _, _, margin = _arrays(row, width)
                for done in later:
                    margin = margin + done["value"][reached(done, cells)]
                margins.append(margin.tobytes())
            yield batch.assign(margin=margins)

    return Binned(materialize(data.blocks.mapInPandas(run, data.blocks.schema), "binned"), data.features, data.cuts, data.base, data.rows)


def _held_error(data: Binned, later: list) -> float:
    """Mean squared error of the held-out rows, NaN without any."""
    width = len(data.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                _, cells, label, held, margin = _arrays(row, width)
                for done in later:
                    margin = margin + done["value"][reached(done, cells)]
                yield pd.DataFrame({"error": [float(((margin[held] - label[held]) ** 2).sum())], "n": [int(held.sum())]})

    error, n = data.blocks.mapInPandas(run, "error double, n long").agg(F.sum("error"), F.sum("n")).first()
    return error / n if n else float("nan")


# --- fitting ------------------------------------------------------------------


def advance(data: Binned, trials: dict[int, Params], grown: dict[int, list], upto: dict[int, int], local: int = LOCAL) -> None:
    """Grow each trial's trees to the number wanted; ``grown`` gets (tree, held-out error) pairs appended."""
    if data.rows <= local:
        while left := {t: p for t, p in trials.items() if len(grown[t]) < upto[t] and not stopped([e for _, e in grown[t]], p)}:
            until = {t: min(upto[t], len(grown[t]) + STRETCH) for t in left}
            for r in sorted(_stretch(data, left, {t: grown[t] for t in left}, until).collect(), key=lambda r: (r["trial"], r["tree"])):
                grown[r["trial"]].append((_unpacked(r), float("nan") if r["error"] is None else r["error"]))
        return
    for t, p in trials.items():
        state = _with_margins(data, [x for x, _ in grown[t]]) if grown[t] else data
        later: list = []
        while len(grown[t]) < upto[t] and not stopped([e for _, e in grown[t]], p):
            tree, before = _tree_by_levels(state, later, len(grown[t]), p, local)
            if grown[t]:
                grown[t][-1] = grown[t][-1][0], before
            later.append(tree)
            # The error of a tree comes with the next one's first level.
            known = [e for _, e in grown[t]]
            if stopped(known, p):
                break
            grown[t].append((tree, float("nan")))
            if len(later) == CUT:
                state, later = _with_margins(state, later), []
        if grown[t] and np.isnan(grown[t][-1][1]):
            grown[t][-1] = grown[t][-1][0], _held_error(state, later)


def ensemble(data: Binned, grown: list) -> Ensemble:
    """The trees up to the best held-out error, with thresholds instead of bins."""
    errors = np.array([e for _, e in grown])
    keep = int(np.nanargmin(errors)) + 1 if len(errors) and not np.isnan(errors).all() else len(grown)
    parts = []
    for k, (tree, _) in enumerate(grown[:keep]):
        inner = tree["feature"] >= 0
        threshold = np.full(len(inner), np.inf)
        # A split after the last cut can't be: the last bin has nothing to its right.
        threshold[inner] = [data.cuts[f][b] if b < len(data.cuts[f]) else np.inf for f, b in zip(tree["feature"][inner], tree["bin"][inner])]
        columns = {"tree": k, "node": np.arange(len(inner)), "threshold": threshold}
        parts.append(pd.DataFrame({**columns, **{c: tree[c] for c in _NODE if c != "bin"}}))
    nodes = pd.concat(parts) if parts else pd.DataFrame(columns=["tree", "node", "threshold", *[c for c in _NODE if c != "bin"]])
    return Ensemble.of(data.features, data.base, nodes)


def fit(df: DataFrame, features: Sequence[str] = S.FEATURES, label: str = S.LABEL, held_out: str | None = None, params: Params = Params(), local: int = LOCAL) -> Ensemble:
    """Boosted trees on ``df``; with ``held_out`` they stop at the best error of the flagged rows."""
    data = binned(df, features, label, held_out, params.bins)
    grown: dict[int, list] = {0: []}
    advance(data, {0: params}, grown, {0: params.rounds}, local)
    return ensemble(data, grown[0])
