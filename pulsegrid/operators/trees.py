"""Regression trees: one per zone in a shared level-by-level job, or one for all.

The grouped tree grows every zone's tree together. Each level is one
aggregation to (zone, node, feature, value) counts and label sums; the split
search then works on those histograms, whose size depends on the number of
distinct feature values and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scores import SUMS, score_columns, sums_from_powers
from pulsegrid.operators.evaluate import score_with_total
from pulsegrid.operators.features import assemble
from pulsegrid.operators.panels import Panel
from pulsegrid.workspace import materialize, scope

NODE_COLUMNS = ("node_id", "depth", "feature", "threshold", "n", "prediction")


def histogram(rows: DataFrame, keys: list[str], features: list[str], label: str = "demand") -> DataFrame:
    """``keys, node_id, f, value, c, s, s2``: rows and label sums per value of each feature, by its place in name order."""
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in sorted(features))
    return (
        rows.selectExpr(*keys, "node_id", f"{label} AS y", f"posexplode(array({values})) AS (f, value)")
        .groupBy(*keys, "node_id", "f", "value")
        .agg(F.expr("count(*) AS c"), F.expr("CAST(sum(y) AS DOUBLE) AS s"),
             F.expr("sum(CAST(y AS DOUBLE) * y) AS s2"))
    )


def value_bounds(histogram: DataFrame, most: int = 128) -> dict[int, list[float]]:
    """For every feature, values that cut its distinct values into blocks of like size, for ``search``.

    Features of few values stay in one block. A mergeable quantile sketch of the distinct values finds the cuts;
    only those, ``most`` a feature, come to the driver.
    """
    cuts = ", ".join(f"{i / most}D" for i in range(1, most))
    rows = histogram.select("f", "value").distinct().groupBy("f").agg(
        F.expr(f"IF(count(*) > {most * 8}, percentile_approx(value, array({cuts})), CAST(array() AS ARRAY<DOUBLE>)) AS cuts")
    )
    return {r.f: sorted(set(r.cuts)) for r in rows.collect()}


def search(histogram: DataFrame, keys: list[str], features: list[str],
           bounds: dict[int, list[float]] | None = None) -> DataFrame:
    """The best ``feature <= threshold`` split of each (group, node) of a ``histogram``.

    Thresholds are observed values. The share of the node's variance that a
    split removes decides, compared at 9 digits so that rounding noise makes
    no choice; ties go to the first feature name, then the lowest threshold.
    Nodes without a positive share come back with a NULL feature. ``gain`` is
    the removed variance itself.

    Sums below each value run within a feature of a node. With ``bounds`` they run in two
    levels, within blocks of values and over the totals of the blocks, so that
    no task holds all values of a feature.
    """
    node = [*keys, "node_id"]
    names = sorted(features)
    group = ", ".join(node)
    right = "(total - s_left) * (total - s_left) / nullif(n - n_left, 0)"
    gain = f"(s_left * s_left / n_left + {right} - total * total / n) / n"
    share = "round(gain / nullif((total2 - total * total / n) / n, 0), 9)"
    sums = ("c", "n"), ("s", "total"), ("s2", "total2")
    if bounds and any(bounds.values()):
        cases = " ".join(f"WHEN {f} THEN {_blocks(b)}" for f, b in sorted(bounds.items()) if b)
        blocked = materialize(histogram.selectExpr("*", f"CASE f {cases} ELSE 0 END AS block"), "histogram")
        totals = blocked.groupBy(*node, "f", "block").agg(*[F.sum(c).alias(c) for c, _ in sums])
        # at most one row a block from here on
        over = f"OVER (PARTITION BY {group}, f"
        totals = totals.selectExpr(
            *node, "f", "block", f"sum(c) {over} ORDER BY block) - c AS n_before", f"sum(s) {over} ORDER BY block) - s AS s_before",
            *[f"sum({c}) {over}) AS {name}" for c, name in sums],
        )
        below = f"OVER (PARTITION BY {group}, f, block ORDER BY value)"
        running = blocked.selectExpr(*node, "f", "block", "value", f"sum(c) {below} AS c", f"sum(s) {below} AS s")
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*node, "f", "block"]]
        found = running.alias("l").join(totals.alias("r"), same).selectExpr(
            *[f"l.{k}" for k in [*node, "f"]], "value", "n", "total", "total2", "n_before + c AS n_left", "s_before + s AS s_left"
        )
    else:
        whole = f"OVER (PARTITION BY {group}, f)"
        below = f"OVER (PARTITION BY {group}, f ORDER BY value)"
        # one shuffle for the running sums and for the choice among the features
        histogram = histogram.repartition(*node) if keys else histogram
        found = histogram.selectExpr(
            *node, "f", "value", *[f"sum({c}) {whole} AS {name}" for c, name in sums],
            f"sum(c) {below} AS n_left", f"sum(s) {below} AS s_left",
        )
    found = found.selectExpr("*", f"{gain} AS gain").selectExpr("*", f"greatest({share}, 0D) AS share")
    best = found.groupBy(*node).agg(*map(F.expr, (
        "max(n) AS n", "max(total) AS total",
        "min_by(struct(f, value, n_left, s_left, gain, share), struct(-share, f, value)) AS best",
    )))
    listed = ", ".join(f"'{name}'" for name in names)
    chosen = {
        "feature": f"array({listed})[best.f]", "threshold": "best.value",
        "n_left": "best.n_left", "s_left": "best.s_left", "gain": "best.gain",
    }
    return best.selectExpr(
        *node, "n", "total", *[f"IF(best.share > 0, {c}, NULL) AS {k}" for k, c in chosen.items()]
    )


def _blocks(bounds: list[float]) -> str:
    """SQL for the number of ``bounds`` below ``value``."""
    listed = ", ".join(f"{b!r}D" for b in bounds)
    return f"size(filter(array({listed}), b -> b < value))"


def best_splits(rows: DataFrame, keys: list[str], features: list[str],
                label: str = "demand") -> DataFrame:
    """The best split of each (group, node) of ``rows``, which carry ``node_id``, as ``search`` finds it."""
    return search(histogram(rows, keys, features, label), keys, features)


def grow(rows: DataFrame, keys: list[str], features: list[str], max_depth: int,
         label: str = "demand") -> DataFrame:
    """Trees of every group as a node table.

    ``rows`` is read once per level; pass a written table. Each level's splits
    (groups x nodes) are written before the next level starts, and rows find their node by
    one join with their group's splits. A single tree searches its splits in blocks of values.
    """
    rows = rows.select(*dict.fromkeys([*keys, *features, label]))
    bounds = None
    if not keys:
        bounds = value_bounds(histogram(rows.selectExpr("*", "1 AS node_id"), keys, features, label))
    return _grow(
        rows.sparkSession, keys, features, max_depth,
        lambda nodes, depth: histogram(leaf_of(rows, nodes, keys, features, depth, open_only=True), keys, features, label)
        if depth else histogram(rows.selectExpr("*", "1 AS node_id"), keys, features, label),
        bounds,
    )


def _grow(spark: SparkSession, keys: list[str], features: list[str], max_depth: int,
          level: Callable[[DataFrame | None, int], DataFrame], bounds: dict[int, list[float]] | None = None) -> DataFrame:
    """Node table of trees whose histograms ``level(nodes so far, depth)`` gives."""
    with scope(spark) as tables:
        nodes = None
        for depth in range(max_depth):
            found = search(level(nodes, depth), keys, features, bounds).withColumn("depth", F.lit(depth))
            found = materialize(found, "splits")
            nodes = found if nodes is None else nodes.unionByName(found)
        return tables.keep(materialize(_node_table(nodes, keys, max_depth), "nodes"))


def _node_table(nodes: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """Split nodes and leaves with their predictions."""
    mean = "total / n AS prediction"
    inner = nodes.selectExpr(*keys, "node_id", "depth", "feature", "threshold", "n", mean)
    # the deepest level holds no histogram of its own: its sums are what the
    # last splits leave on either side
    last = nodes.filter(f"depth = {max_depth - 1} AND feature IS NOT NULL")
    sides = (
        "inline(array(struct(node_id * 2 AS node_id, n_left AS n, s_left AS total),"
        " struct(node_id * 2 + 1 AS node_id, n - n_left AS n, total - s_left AS total)))"
    )
    leaves = last.selectExpr(*keys, sides).selectExpr(
        *keys, "node_id", f"{max_depth} AS depth", "CAST(NULL AS STRING) AS feature",
        "CAST(NULL AS DOUBLE) AS threshold", "n", mean,
    )
    return inner.unionByName(leaves)


def _packed(nodes: DataFrame, keys: list[str], features: list[str], max_depth: int) -> DataFrame:
    """``keys, tree``: the nodes of each group in one array of ``f, t, prediction, left``, in heap order.

    In that order the children of the j-th split (from 0) are entries 2j+1 and 2j+2; ``left`` is the first of them.
    A tree has at most ``2 ** (max_depth + 1)`` nodes, however many rows it was grown from.
    """
    names = ", ".join(f"'{f}'" for f in features)
    known = "prediction" if "prediction" in nodes.columns else "total / n"
    entry = (
        f"struct(node_id, CAST(array_position(array({names}), IF(depth < {max_depth}, feature, NULL)) AS INT) - 1"
        f" AS f, threshold AS t, {known} AS prediction)"
    )
    ordered = nodes.filter(F.col("depth") <= max_depth).groupBy(*keys).agg(F.expr(f"array_sort(collect_list({entry})) AS tree"))
    kind = "ARRAY<STRUCT<f: INT, t: DOUBLE, prediction: DOUBLE, left: INT>>"
    return ordered.selectExpr(
        *keys,
        f"aggregate(tree, struct(CAST(array() AS {kind}) AS done, 0 AS splits), (acc, e) -> struct("
        "concat(acc.done, array(struct(e.f, e.t, e.prediction, acc.splits * 2 + 1 AS left))) AS done,"
        " acc.splits + IF(e.f IS NULL, 0, 1) AS splits), acc -> acc.done) AS tree"
    )


def _walk(rows: DataFrame, nodes: DataFrame, keys: list[str], features: list[str], max_depth: int) -> DataFrame:
    """``rows`` with ``_tree`` and ``_place``, the position and heap number they reach in their group's tree.

    One join brings a group's tree to its rows; one tree for all is a scalar. Rows of a group without a tree stay at the root.
    """
    packed = _packed(nodes, keys, features, max_depth).withColumnRenamed("tree", "_tree")
    rows = rows.drop("node_id")
    with_tree = rows.join(packed, keys, "left") if keys else rows.withColumn("_tree", packed.scalar())
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    # a column of its own, so that the array is made once a row
    with_tree = with_tree.selectExpr("*", f"explode(array(array({values}))) AS _x")
    bit = "IF(_x[get(_tree, s.p).f] > get(_tree, s.p).t, 1, 0)"
    step = f"struct(get(_tree, s.p).left + {bit} AS p, s.node_id * 2 + {bit} AS node_id)"
    place = (
        f"aggregate(sequence(1, {max_depth}), struct(0 AS p, 1 AS node_id),"
        f" (s, i) -> IF(get(_tree, s.p).f IS NULL, s, {step}))"
    )
    return with_tree.selectExpr("*", f"{place} AS _place").drop("_x")


def leaf_of(rows: DataFrame, nodes: DataFrame, keys: list[str], features: list[str],
            max_depth: int, open_only: bool = False) -> DataFrame:
    """Rows with the node they end in after at most ``max_depth`` splits.

    ``open_only`` keeps the rows that made all ``max_depth`` steps.
    """
    routed = _walk(rows, nodes, keys, features, max_depth)
    if open_only:
        routed = routed.filter(f"_place.node_id >= {1 << max_depth}")
    return routed.selectExpr(*[c for c in rows.columns if c != "node_id"], "_place.node_id AS node_id")


def predict(rows: DataFrame, nodes: DataFrame, keys: list[str], features: list[str],
            max_depth: int) -> DataFrame:
    """Rows with the prediction of the leaf they fall into.

    A shallower ``max_depth`` than the trees were grown to prunes them. Rows of
    a group without a tree keep a NULL prediction.
    """
    routed = _walk(rows, nodes, keys, features, max_depth)
    return routed.selectExpr(
        *[c for c in rows.columns if c != "node_id"], "_place.node_id AS node_id", "get(_tree, _place.p).prediction AS prediction"
    )


def fit_and_score(train: DataFrame, test: DataFrame, keys: list[str], features: list[str],
                  max_depth: int = 3) -> DataFrame:
    """One tree per group, scored on its test rows and pooled."""
    nodes = grow(train, keys, features, max_depth)
    return score_with_total(predict(test, nodes, keys, features, max_depth), *keys)


def depth_sweep(train: DataFrame, test: DataFrame, keys: list[str], features: list[str],
                depths: list[int]) -> DataFrame:
    """Scores of the same trees cut at several depths.

    Trees grow once to the greatest depth; every shallower tree is a prefix.
    """
    deepest = max(depths)
    nodes = grow(train, keys, features, deepest)
    routed = leaf_of(test, nodes, keys, features, deepest)
    # rows that share a leaf share all their predictions
    leaf = routed.groupBy(*keys, "node_id").agg(*map(F.expr, (
        "count(*) AS n", "CAST(sum(demand) AS DOUBLE) AS sum_y",
        "sum(CAST(demand AS DOUBLE) * demand) AS sum_y2",
    )))
    return _score_leaves(leaf, nodes, keys, depths)


def _score_leaves(leaf: DataFrame, nodes: DataFrame, keys: list[str], depths: list[int]) -> DataFrame:
    """Scores at several depths, per group and pooled, from ``keys, node_id, n, sum_y, sum_y2`` of the test rows in each leaf."""
    # the ancestor at a given depth is the heap number with its last bits cut
    cut = "greatest(length(bin(node_id)) - 1 - max_depth, 0)"
    levels = ", ".join(map(str, depths))
    ancestors = leaf.selectExpr("*", f"explode(array({levels})) AS max_depth").selectExpr(
        "max_depth", *keys, "n", "sum_y", "sum_y2", f"shiftright(node_id, {cut}) AS node_id"
    )
    p = "prediction"
    tree = [k for k in keys if k in nodes.columns]
    sums = ancestors.join(nodes.select(*tree, "node_id", p), [*tree, "node_id"], "left")
    # groups without a tree keep their rows in n and nothing else
    known = f"{p} IS NOT NULL"
    per_group = sums.groupBy("max_depth", *keys).agg(*map(F.expr, (
        "sum(n) AS n", f"sum(IF({known}, n, 0)) AS scored",
        f"sum(n * {p} * {p} - 2 * {p} * sum_y + sum_y2) AS sse",
        f"sum(IF({known}, sum_y, NULL)) AS sum_y", f"sum(IF({known}, sum_y2, NULL)) AS sum_y2",
    ))).selectExpr("max_depth", *keys, "n AS rows", "scored", "sse", "sum_y", "sum_y2").selectExpr(
        "max_depth", *keys, "rows AS n", *sums_from_powers("scored", "sse", "sum_y", "sum_y2")[1:]
    )
    return _pooled(per_group, keys)


def _pooled(per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Scores per depth and group and pooled, from their sums."""
    pooled = per_group.groupBy("max_depth").agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS])
    both = per_group.unionByName(pooled, allowMissingColumns=True)
    return both.selectExpr("max_depth", *keys, "n", *score_columns())


# --- panels: all slots of all zones, without their rows -----------------------


def _zone_tree(y: np.ndarray, codes: np.ndarray, values: list[np.ndarray], max_depth: int) -> list[tuple]:
    """Nodes ``node_id, depth, f, threshold, n, total`` of one zone's tree, level by level.

    ``codes`` has the place of each slot's value among ``values``, feature by feature. The rules are those of ``search``.
    """
    out, level = [], [(1, np.arange(len(y)))]
    for depth in range(max_depth + 1):
        below = []
        for node, at in level:
            n, total, own = len(at), float(y[at].sum()), y[at]
            spread = (float((own * own).sum()) - total * total / n) / n
            best = None
            for f in range(len(values)) if depth < max_depth and spread > 0 else ():
                c = np.bincount(codes[f][at], minlength=len(values[f]))
                seen = np.flatnonzero(c)[:-1]
                if not len(seen):
                    continue
                left = np.cumsum(c)[seen]
                sums = np.cumsum(np.bincount(codes[f][at], own, len(values[f])))[seen]
                gain = (sums * sums / left + (total - sums) ** 2 / (n - left) - total * total / n) / n
                share = np.floor(gain / spread * 1e9 + 0.5) / 1e9
                k = int(share.argmax())
                if share[k] > 0 and (best is None or share[k] > best[0]):
                    best = share[k], f, seen[k]
            out.append((node, depth, *((best[1], float(values[best[1]][best[2]])) if best else (None, None)), n, total))
            if best:
                right = codes[best[1]][at] > best[2]
                below += [(2 * node, at[~right]), (2 * node + 1, at[right])]
        level = below
    return out


def _zone_leaves(nodes: list[tuple], grid: np.ndarray, max_depth: int) -> np.ndarray:
    """The node of each slot after at most ``max_depth`` splits."""
    place = np.ones(grid.shape[1], np.int64)
    for node, depth, f, t, *_ in nodes:
        if f is not None and depth < max_depth:
            here = place == node
            place[here] = 2 * node + (grid[f][here] > t)
    return place


def _per_zone(panel: Panel, names: list[str], max_depth: int, kind: str, rows: Callable) -> DataFrame:
    """``keys`` and what ``rows(train labels, test labels, tree)`` gives for every zone of a panel, columns ``kind``.

    A zone is one row with its demand as a list, at most one entry a slot; the calendar's arrays are the same for all.
    """
    grid = np.ascontiguousarray(panel.grid(names).T)
    split, count, zone = panel.n_slots("train"), panel.slots.count, list(panel.keys)
    held = [np.unique(f[:split], return_inverse=True) for f in grid]
    values, codes = [v for v, _ in held], np.array([c for _, c in held]).reshape(len(names), split)
    seen = panel.demand.filter(panel.slots.inside()).groupBy(*panel.keys).agg(
        F.expr("collect_list(slot_id) AS slots"), F.expr("collect_list(CAST(demand AS DOUBLE)) AS labels")
    )
    zones = seen if panel.zones is None else panel.zones.select(*panel.keys).join(seen, list(panel.keys), "left")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [], []
            for i in range(batch.num_rows):
                y = np.zeros(count)
                if batch["slots"][i].is_valid:
                    np.add.at(y, batch["slots"][i].values.to_numpy(), batch["labels"][i].values.to_numpy())
                tree = _zone_tree(y[:split], codes, values, max_depth) if split else []
                more = rows(y[:split], y[split:], grid[:, split:], tree)
                which += [i] * len(more)
                found += more
            keys = pa.Table.from_batches([batch]).select(zone).take(pa.array(which, pa.int64()))
            columns = list(zip(*found)) or [()] * len(fields)
            for part in pa.Table.from_arrays(
                [*keys.columns, *[pa.array(c, f.type) for c, f in zip(columns, fields)]], [*zone, *fields.names]
            ).combine_chunks().to_batches():
                yield part

    spark_kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = pa.schema([(c.split()[0], spark_kinds[c.split()[1]]) for c in kind.split(", ")])
    named = ", ".join(f"{k} {zones.schema[k].dataType.simpleString()}" for k in panel.keys)
    return zones.mapInArrow(grown, f"{named}, {kind}")


def _grow_zones(panel: Panel, features: list[str], max_depth: int) -> DataFrame:
    names = sorted(panel.calendar_names(features))

    def nodes(train, test, grid, tree):
        return [(node, depth, None if f is None else names[f], t, n, total / n) for node, depth, f, t, n, total in tree]

    return _per_zone(panel, names, max_depth, "node_id int, depth int, feature string, threshold double, n long, prediction double", nodes)


def _sweep_zones(panel: Panel, features: list[str], depths: list[int]) -> DataFrame:
    names = sorted(panel.calendar_names(features))

    def sums(train, test, grid, tree):
        means = {node: total / n for node, *_, n, total in tree}
        out = []
        for d in depths if len(test) else ():
            error = None
            if tree:
                places, which = np.unique(_zone_leaves(tree, grid, d), return_inverse=True)
                error = float(((np.array([means[p] for p in places.tolist()])[which] - test) ** 2).sum())
            out.append((d, len(test), len(test) if tree else 0, error, float(test.sum()), float((test * test).sum())))
        return out

    kind = "max_depth int, n long, scored long, sse double, y double, y2 double"
    found = _per_zone(panel, names, max(depths), kind, sums)
    known = "scored > 0"
    return found.selectExpr(
        "max_depth", *panel.keys, "n", *sums_from_powers("scored", "sse", f"IF({known}, y, NULL)", f"IF({known}, y2, NULL)")[1:]
    )


def grow_panel(panel: Panel, features: list[str], max_depth: int, grouped: bool = True) -> DataFrame:
    """Trees of a panel as a node table: one per zone, or with ``grouped=False`` one for all.

    A zone's own tree sees the calendar's arrays and the zone's labels, one number a slot, so all zones
    grow side by side in one pass over the rows with demand; features of the zone cannot split it.

    The one tree grows level by level. A node holds the slots that meet its conditions on calendar features, for the
    zones that meet those on zone features. So the rows with a value are slots counted in the calendar times zones
    counted in the zone table; only label sums are taken from rows, and only from those with demand.
    """
    if grouped:
        return _grow_zones(panel, features, max_depth)
    names = sorted(features)
    grid = panel.grid(names)
    bounds = value_bounds(_panel_histogram(panel, [], names, None, 0, grid))
    return _grow(panel.spark, [], names, max_depth, lambda nodes, depth: _panel_histogram(panel, [], names, nodes, depth, grid), bounds)


def _panel_histogram(panel: Panel, keys: list[str], names: list[str], nodes: DataFrame | None, depth: int, grid: np.ndarray) -> DataFrame:
    """The histogram of the nodes at ``depth`` below the splits of ``nodes``.

    Slot counts and label sums of a value meet in one aggregation.
    """
    rows = _panel_rows(panel, names, "train")
    columns = [*keys, "node_id", "f", "value"]
    if nodes is None:
        rows = rows.selectExpr("*", "1 AS node_id")
        groups = panel_zones(panel).select(*keys).distinct() if keys else panel.spark.range(1)
        paths = groups.selectExpr(*keys, "1 AS node_id", f"{_NO_PATH} AS path")
    else:
        rows = leaf_of(rows, nodes, keys, names, depth, open_only=True)
        paths = _paths(nodes, keys, names, depth).filter(f"node_id >= {1 << depth}")
    counts = _panel_counts(panel, paths, keys, names, grid)
    listed = ", ".join(f"CAST({n} AS DOUBLE)" for n in names)
    labels = rows.selectExpr(*keys, "node_id", "CAST(y AS DOUBLE) AS y", f"posexplode(array({listed})) AS (f, value)")
    both = counts.selectExpr(*columns, "c", "0D AS y").unionByName(labels.selectExpr(*columns, "0L AS c", "y"))
    return both.groupBy(*columns).agg(F.expr("sum(c) AS c"), F.expr("sum(y) AS s"), F.expr("sum(y * y) AS s2"))


def panel_splits(panel: Panel, features: list[str]) -> DataFrame:
    """The first split of every zone's tree."""
    keys, names = list(panel.keys), sorted(panel.calendar_names(features))
    return search(_panel_histogram(panel, keys, names, None, 0, panel.grid(names)), keys, names)


_NO_PATH = "CAST(array() AS ARRAY<STRUCT<f: INT, t: DOUBLE, up: INT>>)"


def panel_zones(panel: Panel) -> DataFrame:
    """The zones of a panel with their features."""
    if panel.zones is not None:
        return panel.zones
    return panel.demand.filter(panel.slots.inside()).select(*panel.keys).distinct()


def _panel_rows(panel: Panel, names: list[str], side: str) -> DataFrame:
    """Rows with demand of a part: keys, features and ``y``."""
    calendar, zone = panel.calendar_names(names), panel.zone_names(names)
    rows = panel.rows(side)
    if panel.zones is not None:
        rows = rows.join(panel.zones.select(*dict.fromkeys([*panel.keys, *zone])), list(panel.keys))
    kept = dict.fromkeys([*panel.keys, *zone])
    return rows.selectExpr(*kept, *[f"{v} AS {c}" for c, v in zip(calendar, panel.values(calendar))], "demand AS y")


def _paths(nodes: DataFrame, keys: list[str], names: list[str], max_depth: int) -> DataFrame:
    """``keys, node_id, path`` of the nodes that the splits of ``nodes`` lead to: conditions ``f, t, up`` from the root.

    ``up`` is 1 where values above ``t`` go on. Leaves of a lesser depth are among them.
    """
    listed = ", ".join(f"'{n}'" for n in names)
    entry = f"struct(node_id, CAST(array_position(array({listed}), feature) AS INT) - 1 AS f, threshold AS t)"
    split = nodes.filter(f"feature IS NOT NULL AND depth < {max_depth}").groupBy(*keys).agg(F.expr(f"collect_list({entry}) AS splits"))
    # children of every split, and the root
    sides = "flatten(transform(splits, e -> array(e.node_id * 2, e.node_id * 2 + 1)))"
    found = split.selectExpr(*keys, "map_from_entries(transform(splits, e -> struct(e.node_id, e))) AS by_id", f"{sides} AS ends")
    found = found.selectExpr(*keys, "by_id", "explode(filter(ends, n -> NOT map_contains_key(by_id, n))) AS node_id")
    steps = "length(bin(node_id)) - 1"
    above = "shiftright(node_id, d + 1)"
    path = (
        f"transform(reverse(sequence(0, {steps} - 1)), d -> struct("
        f"element_at(by_id, {above}).f AS f, element_at(by_id, {above}).t AS t, shiftright(node_id, d) % 2 AS up))"
    )
    return found.selectExpr(*keys, "node_id", f"{path} AS path")


def _side_of(path: str, places: list[int]) -> str:
    """SQL for the conditions of a path on the features at ``places``."""
    listed = ", ".join(map(str, places)) or "-1"
    return f"filter({path}, e -> e.f IN ({listed}))"


def _calendar_part(panel: Panel, paths: DataFrame, names: list[str], grid: np.ndarray, side: str, values: bool) -> DataFrame:
    """For each distinct ``cpath``: the slots of a part that meet it, by feature value (``f, value, c``) or in all (``c``).

    Every path is one look at the calendar's arrays.
    """
    first = panel.first_slot(side)
    part = np.ascontiguousarray(grid[first : first + panel.n_slots(side)].T)
    calendar = [i for i, n in enumerate(names) if n not in panel.zone_names(names)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch["cpath"].to_pylist()):
                met = np.ones(part.shape[1], bool)
                for e in path:
                    met &= (part[e["f"]] > e["t"]) == bool(e["up"])
                key = batch["cpath"].slice(i, 1)
                if not values:
                    if met.any():
                        yield pa.RecordBatch.from_arrays([key, pa.array([int(met.sum())], pa.int64())], ["cpath", "c"])
                    continue
                found = [(f, *np.unique(part[f][met], return_counts=True)) for f in calendar]
                f = np.concatenate([np.full(len(v), k, np.int32) for k, v, _ in found] or [np.zeros(0, np.int32)])
                if len(f):
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(np.zeros(len(f), np.int32))), pa.array(f), pa.array(np.concatenate([v for _, v, _ in found])),
                         pa.array(np.concatenate([c for _, _, c in found]).astype(np.int64))], ["cpath", "f", "value", "c"],
                    )

    kind = paths.schema["cpath"].dataType.simpleString()
    more = "f int, value double, " if values else ""
    return paths.select("cpath").distinct().mapInArrow(counted, f"cpath {kind}, {more}c long")


def _panel_counts(panel: Panel, paths: DataFrame, keys: list[str], names: list[str], grid: np.ndarray) -> DataFrame:
    """``keys, node_id, f, value, c`` of the training part for the nodes of ``paths``."""
    calendar = [i for i, n in enumerate(names) if n not in panel.zone_names(names)]
    zonal = [i for i in range(len(names)) if i not in calendar]
    paths = paths.selectExpr("*", f"{_side_of('path', calendar)} AS cpath", f"{_side_of('path', zonal)} AS zpath")
    by_value = _calendar_part(panel, paths, names, grid, "train", True)
    if not zonal:
        out = paths.join(by_value, "cpath").select(*keys, "node_id", "f", "value", "c")
        # a zone's own node holds one zone, a node of the one tree all of them
        return out if keys else out.withColumn("c", F.col("c") * panel_zones(panel).selectExpr("count(*)").scalar())
    # one tree: at most 2 ** depth nodes meet the zones as one array
    x = ", ".join(f"CAST({n} AS DOUBLE)" if i in zonal else "0D" for i, n in enumerate(names))
    listed = paths.selectExpr("collect_set(zpath)").scalar()
    met = "filter(zpaths, p -> forall(p, e -> IF(x[e.f] > e.t, 1, 0) = e.up))"
    zones = panel_zones(panel).selectExpr(f"explode(array(array({x}))) AS x").withColumn("zpaths", listed)
    zones = zones.selectExpr("x", f"explode({met}) AS zpath")
    n_zones = zones.groupBy("zpath").agg(F.expr("count(*) AS zones"))
    n_slots = _calendar_part(panel, paths, names, grid, "train", False).withColumnRenamed("c", "slots")
    places = ", ".join(map(str, zonal))
    by_zone = zones.selectExpr("zpath", "posexplode(x) AS (f, value)").filter(f"f IN ({places})")
    by_zone = by_zone.groupBy("zpath", "f", "value").agg(F.expr("count(*) AS c"))
    of_slots = paths.join(by_value, "cpath").join(n_zones, "zpath").selectExpr("node_id", "f", "value", "c * zones AS c")
    of_zones = paths.join(by_zone, "zpath").join(n_slots, "cpath").selectExpr("node_id", "f", "value", "c * slots AS c")
    return of_slots.unionByName(of_zones)


def panel_leaves(panel: Panel, nodes: DataFrame, features: list[str], max_depth: int) -> DataFrame:
    """``keys, node_id, n, sum_y, sum_y2`` of the test part, per zone and leaf of the one tree."""
    names = sorted(features)
    calendar = [i for i, n in enumerate(names) if n not in panel.zone_names(names)]
    zonal = [i for i in range(len(names)) if i not in calendar]
    leaves = _paths(nodes, [], names, max_depth)
    roots = nodes.filter("node_id = 1 AND feature IS NULL").selectExpr("node_id", f"{_NO_PATH} AS path")
    leaves = leaves.unionByName(roots).selectExpr(
        "*", f"{_side_of('path', calendar)} AS cpath", f"{_side_of('path', zonal)} AS zpath"
    )
    n_slots = _calendar_part(panel, leaves, names, panel.grid(names), "test", False)
    sized = leaves.join(n_slots, "cpath").selectExpr("node_id", "zpath", "c AS n")
    # at most 2 ** depth leaves meet the zones as one array
    x = ", ".join(f"CAST({n} AS DOUBLE)" if i in zonal else "0D" for i, n in enumerate(names))
    met = "filter(leaves, l -> forall(l.zpath, e -> IF(x[e.f] > e.t, 1, 0) = e.up))"
    zones = panel_zones(panel).selectExpr(*panel.keys, f"explode(array(array({x}))) AS x")
    zones = zones.withColumn("leaves", sized.selectExpr("collect_list(struct(node_id, n, zpath))").scalar())
    places = zones.selectExpr(*panel.keys, f"explode({met}) AS l").selectExpr(*panel.keys, "l.node_id AS node_id", "l.n AS n")
    labels = leaf_of(_panel_rows(panel, names, "test"), nodes, [], names, max_depth).groupBy(*panel.keys, "node_id").agg(*map(F.expr, (
        "CAST(sum(y) AS DOUBLE) AS sum_y", "sum(CAST(y AS DOUBLE) * y) AS sum_y2",
    )))
    joined = places.join(labels, [*panel.keys, "node_id"], "left")
    return joined.selectExpr(*panel.keys, "node_id", "n", "coalesce(sum_y, 0D) AS sum_y", "coalesce(sum_y2, 0D) AS sum_y2")


def panel_depth_sweep(panel: Panel, features: list[str], depths: list[int], grouped: bool = True) -> DataFrame:
    """Scores of a panel's trees cut at several depths, per zone and pooled."""
    if grouped:
        return _pooled(_sweep_zones(panel, features, depths), list(panel.keys))
    deepest = max(depths)
    nodes = grow_panel(panel, features, deepest, grouped)
    leaf = panel_leaves(panel, nodes, features, deepest)
    return _score_leaves(leaf, nodes, list(panel.keys), depths)


def score_panel(panel: Panel, features: list[str], max_depth: int = 3, grouped: bool = True) -> DataFrame:
    """One tree per zone of a panel, or one for all, scored on its test part per zone and pooled."""
    return panel_depth_sweep(panel, features, [max_depth], grouped).drop("max_depth")


# --- library trees -------------------------------------------------------------


def global_tree(train: DataFrame, layout, max_depth: int = 5, label: str = "demand"):
    """One binned tree for all zones (depth 5 is the library default)."""
    tree = DecisionTreeRegressor(labelCol=label, maxDepth=max_depth)
    return tree.fit(assemble(train, layout))


def global_forest(train: DataFrame, layout, seed: int, label: str = "demand"):
    return RandomForestRegressor(labelCol=label, seed=seed).fit(assemble(train, layout))


def score_model(model, test: DataFrame, layout, label: str = "demand") -> DataFrame:
    """Score a fitted model per zone and pooled."""
    return score_with_total(model.transform(assemble(test, layout)), "zone_id", label=label)


def tree_text(train: DataFrame, model) -> DataFrame:
    """The fitted tree's text dump, one row per line."""
    lines = list(enumerate(model.toDebugString.rstrip().split("\n")))
    return train.sparkSession.createDataFrame(lines, "line int, text string")
