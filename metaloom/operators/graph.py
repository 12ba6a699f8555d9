"""Graph loops over all mappings or workflows at once: small graphs are walked whole by a task, larger ones in semi-naive rounds of joins."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.sources.store import cut

from .groups import by_group, parted

#: Starts and edges of a graph that one task walks; its steps may be their product.
WALK_ROWS = 20_000


def closure(starts: DataFrame, edges: DataFrame, keys: list[str], most: int = 1000, bound: int = WALK_ROWS) -> DataFrame:
    """(keys, start, node, depth): nodes reached from each start over edges (keys, src, dst), start itself at depth 0.

    Graphs of up to `bound` starts and edges are walked whole, many to a task, after one shuffle; the walk drops repeats. For larger ones, and without keys, a round joins the new pairs only, drops those seen, and is written out; rounds follow the longest chain.
    """
    starts, edges = starts.select(*keys, "start"), edges.select(*keys, "src", "dst")
    if not keys:
        return _closure_rounds(starts, edges, keys, most)
    kind = starts.schema["start"].dataType
    begin = starts.select(*keys, F.lit(None).cast(kind).alias("src"), F.col("start").alias("dst"))
    rows = cut(begin.unionByName(edges.dropna(subset=[*keys, "src"])), "walk")
    small, large = parted(rows, keys, bound)
    found = cut(by_group(small, keys, ["src", "dst"], f"start {kind.simpleString()}, node {kind.simpleString()}, depth int", _reached), "closure")
    if large is None:
        return found
    return found.unionByName(_closure_rounds(large.where("src is null").select(*keys, F.col("dst").alias("start")), large.where("src is not null"), keys, most))


def _reached(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(start, node, depth) of each start, which is a row without src, by breadth."""
    after = _after(rows)
    for start in dict.fromkeys(dst for src, dst in rows if src is None):
        depth, queue = {start: 0}, deque([start])
        while queue:
            node = queue.popleft()
            yield start, node, depth[node]
            for n in after[node] if node in after else ():
                if n not in depth:
                    depth[n] = depth[node] + 1
                    queue.append(n)


def _after(rows: list[tuple]) -> dict:
    after = defaultdict(list)
    for *_, src, dst in rows:
        if src is not None:
            after[src].append(dst)
    return after


def closure_across(starts: DataFrame, edges: DataFrame, home: Callable[[str], Column], most: int = 1000, bound: int = WALK_ROWS) -> DataFrame:
    """(start, node): nodes reached from each start over edges (src, dst), start itself among them, where few edges leave the graph that `home` gives as a node's own.

    Every graph is walked by itself, from its starts and from the nodes at which edges of others come in; nodes of others end a walk. Rounds then join only these ways from graph to graph, so
    that they follow the number of graphs on a chain and hold no nodes in between. What each entrance reaches is joined to the starts at the end.
    """
    starts, edges = starts.select("start").distinct(), edges.select("src", "dst")
    entries = starts.unionByName(edges.where(home("src") != home("dst")).select(F.col("dst").alias("start")))
    within = closure(entries.withColumn("__home", home("start")), edges.withColumn("__home", home("src")), ["__home"], most, bound)
    away = home("node") != F.col("__home")
    hops = cut(within.where(away).select(F.col("start").alias("src"), F.col("node").alias("dst")), "hops")
    moving = starts.join(hops.select(F.col("src").alias("start")), "start", "left_semi")
    far = _closure_rounds(moving, hops, [], most).select("start", F.col("node").alias("entry"), F.lit(True).alias("moves"))
    still = starts.join(hops.select(F.col("src").alias("start")), "start", "left_anti").select("start", F.col("start").alias("entry"), F.lit(False).alias("moves"))
    reached = cut(within.where(~away).select(F.col("start").alias("entry"), "node").join(far.unionByName(still), "entry").select("start", "node", "moves"), "reached")
    return reached.where(~F.col("moves")).select("start", "node").unionByName(reached.where("moves").select("start", "node").distinct())


def _closure_rounds(starts: DataFrame, edges: DataFrame, keys: list[str], most: int) -> DataFrame:
    edges = cut(edges.distinct(), "edges")
    seen = cut(starts.distinct().withColumn("node", F.col("start")).withColumn("depth", F.lit(0)), "closure")
    frontier = seen
    for depth in range(1, most):
        step = frontier.drop("depth").join(edges, [*(frontier[k] == edges[k] for k in keys), frontier["node"] == edges["src"]])
        step = step.select(*(frontier[k] for k in keys), "start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, [*keys, "start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen, "closure")
    raise ValueError(f"no fixpoint after {most} rounds")


def spread(seeds: DataFrame, edges: DataFrame, keys: list[str], most: int = 1000, bound: int = WALK_ROWS) -> DataFrame:
    """(keys, node): seeds and all that they reach over edges, whose columns are the first of the keys, src and dst. Small graphs are walked whole, as by closure: the walk drops repeats, so that none are dealt out for it before."""
    own = [k for k in keys if k in edges.columns]
    seeds, edges = seeds.select(*keys, "node"), edges.select(*own, "src", "dst")
    if not own:
        return _spread_rounds(seeds, edges, keys, own, most)
    rest, kind = [k for k in keys if k not in own], seeds.schema["node"].dataType
    begin = seeds.select(*keys, F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"))
    ties = edges.dropna(subset=[*own, "src"]).select(*own, *[F.lit(None).cast(seeds.schema[k].dataType).alias(k) for k in rest], "src", "dst")
    rows = cut(begin.unionByName(ties), "walk")
    small, large = parted(rows, own, bound)
    out = ", ".join(f"{k} {seeds.schema[k].dataType.simpleString()}" for k in rest) + (", " if rest else "")
    found = cut(by_group(small, own, [*rest, "src", "dst"], f"{out}node {kind.simpleString()}", _spread_over).select(*keys, "node"), "spread")
    if large is None:
        return found
    return found.unionByName(_spread_rounds(large.where("src is null").select(*keys, F.col("dst").alias("node")), large.where("src is not null").select(*own, "src", "dst"), keys, own, most))


def _spread_over(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(rest of the keys, node) that the seeds of each reach."""
    after, seeds = _after(rows), defaultdict(list)
    for *rest, src, dst in rows:
        if src is None:
            seeds[tuple(rest)].append(dst)
    for rest, nodes in seeds.items():
        seen, stack = set(nodes), list(dict.fromkeys(nodes))
        while stack:
            node = stack.pop()
            yield *rest, node
            fresh = set(after[node] if node in after else ()) - seen
            seen |= fresh
            stack += fresh


def _spread_rounds(seeds: DataFrame, edges: DataFrame, keys: list[str], own: list[str], most: int) -> DataFrame:
    edges = cut(edges.distinct().withColumnRenamed("src", "node"), "ties")
    seen = frontier = cut(seeds.distinct(), "spread")
    for _ in range(most):
        step = frontier.join(edges, [*own, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, [*keys, "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError(f"no fixpoint after {most} rounds")


def layers(nodes: DataFrame, edges: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """(keys, node, layer): longest path from a node without predecessors; null on and behind cycles.

    A node enters the layer in which its last predecessor is done, for all graphs in the same round.
    """
    edges = cut(edges.select(*keys, "src", "dst").where("src != dst").distinct(), "edges")
    need = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    todo = cut(nodes.select(*keys, "node").distinct().join(need, [*keys, "node"], "left").fillna(0, ["need"]), "todo")
    done, frontier = None, cut(todo.where("need = 0").select(*keys, "node").withColumn("layer", F.lit(0)), "layer")
    todo = todo.where("need > 0")
    for layer in range(1, most):
        done = frontier if done is None else done.unionByName(frontier)
        fed = edges.join(frontier.select(*keys, F.col("node").alias("src")), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("got"))
        rest = cut(todo.join(fed, [*keys, "node"], "left").select(*keys, "node", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")), "todo")
        frontier = rest.where("need = 0").select(*keys, "node").withColumn("layer", F.lit(layer))
        todo = rest.where("need > 0")
        if frontier.isEmpty():
            return done.unionByName(todo.select(*keys, "node").withColumn("layer", F.lit(None).cast("int")))
    raise ValueError(f"more than {most} layers")


def _roles(keys: list[str], edges: DataFrame, *marked: DataFrame) -> DataFrame:
    """(keys, role, src, dst): edges with role 0, then the nodes of each table with its number as rows without src."""
    rows, kind = edges.select(*keys, F.lit(0).alias("role"), "src", "dst"), edges.schema["src"].dataType
    for i, nodes in enumerate(marked, 1):
        rows = rows.unionByName(nodes.select(*keys, F.lit(i).alias("role"), F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst")))
    return cut(rows.dropna(subset=[*keys, "dst"]), "walk")


def _split(rows: list[tuple], n: int) -> list[dict]:
    """What _roles put together: edges, then the nodes of each of n tables, each once."""
    out = [{} for _ in range(n + 1)]
    for role, src, dst in rows:
        out[role][(src, dst) if role == 0 else dst] = True
    return out


def _unpacked(rows: DataFrame, keys: list[str], n: int) -> list[DataFrame]:
    return [rows.where("role = 0").select(*keys, "src", "dst"), *(rows.where(f"role = {i}").select(*keys, F.col("dst").alias("node")) for i in range(1, n + 1))]


def _listed(after: dict, begin: str, meets: Callable[[str], bool], stops: bool) -> Iterator[list]:
    """Simple paths from a node, each when it comes to a node that meets the condition; they go on there unless it stops them."""
    path, on, ways = [begin], {begin}, [iter(after.get(begin, ()))]
    while ways:
        node = next(ways[-1], None)
        if node is None:
            ways.pop()
            on.discard(path.pop())
        elif node not in on:
            met = meets(node)
            if met:
                yield [*path, node]
            if not (met and stops):
                path.append(node)
                on.add(node)
                ways.append(iter(after.get(node, ())))


def _forward_walk(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
    edges, starts, ends = _split(rows, 2)
    after = _after(edges)
    for start in starts:
        for path in _listed(after, start, ends.__contains__, True):
            yield (path,)


def _backward_walk(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
    edges, starts, targets, ends = _split(rows, 3)
    before = _after([(dst, src) for src, dst in edges if src not in ends])
    for target in targets:
        for path in _listed(before, target, starts.__contains__, False):
            yield (path[::-1],)


def forward_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, keys: list[str], most: int = 1000, bound: int = 0) -> DataFrame:
    """(keys, path): simple paths of nodes from starts to the first end on them; ends stop a path. Graphs of up to `bound` edges, starts and ends are walked whole by a task: for those that are known to have few paths."""
    found = None
    if bound:
        rows = _roles(keys, edges, starts, ends)
        small, large = parted(rows, keys, bound)
        found = by_group(small, keys, ["role", "src", "dst"], f"path array<{edges.schema['src'].dataType.simpleString()}>", _forward_walk)
        if large is None:
            return found
        edges, starts, ends = _unpacked(large, keys, 2)
    rounds = _forward_rounds(edges, starts, ends, keys, most)
    return rounds if found is None else found.unionByName(rounds)


def _forward_rounds(edges: DataFrame, starts: DataFrame, ends: DataFrame, keys: list[str], most: int) -> DataFrame:
    edges = cut(edges.select(*keys, "src", "dst").distinct().join(ends.select(*keys, F.col("node").alias("dst")).distinct().withColumn("ends", F.lit(True)), [*keys, "dst"], "left"), "edges")
    open_ = starts.select(*keys, F.array("node").alias("path"), F.col("node").alias("src")).distinct()
    found = None
    for _ in range(most):
        step = open_.join(edges, [*keys, "src"]).where(~F.array_contains("path", F.col("dst")))
        step = cut(step.select(*keys, F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), "ends"), "paths")
        part = step.where("ends").select(*keys, "path")
        found = part if found is None else found.unionByName(part)
        open_ = step.where("ends is null").drop("ends")
        if open_.isEmpty():
            return found
    raise ValueError(f"paths longer than {most}")


def path_counts(edges: DataFrame, starts: DataFrame, ends: DataFrame, keys: list[str], most: int = 100_000, bound: int = WALK_ROWS) -> DataFrame:
    """(keys, target, n_paths, longest, looped): how many paths lead from starts to each end and how many nodes the longest has, without listing them.

    A node's number is the sum of its predecessors', added up layer by layer, a start counts for itself besides; ends stop a path. Numbers are doubles: exact up to 2^53. Ends that lie behind a cycle: nulls, looped.
    Graphs of up to `bound` edges, starts and ends are added up by one task each, many to a task, after one shuffle; larger ones in rounds for all.
    """
    rows = _roles(keys, edges, starts, ends)
    small, large = parted(rows, keys, bound)
    found = by_group(small, keys, ["role", "src", "dst"], f"target {edges.schema['src'].dataType.simpleString()}, n_paths double, longest int, looped boolean", _counted)
    return found if large is None else found.unionByName(_count_rounds(*_unpacked(large, keys, 2), keys, most))


def _counted(_: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(target, n_paths, longest, looped) of each end that edges from a start reach."""
    edges, starts, ends = _split(rows, 2)
    after = _after([e for e in edges if e[0] not in ends])
    reached, stack = set(starts), list(starts)
    while stack:
        fresh = set(after.get(stack.pop(), ())) - reached
        reached |= fresh
        stack += fresh
    need = defaultdict(int)
    for src in reached & after.keys():
        need[src] += 0
        for dst in after[src]:
            need[dst] += 1
    number, size = {n: float(n in starts) for n in need}, dict.fromkeys(need, 1)
    ready = [n for n in need if not need[n]]
    while ready:
        node = ready.pop()
        if node in ends:
            yield node, number[node], size[node], False
        for dst in after.get(node, ()):
            number[dst] += number[node]
            size[dst] = max(size[dst], size[node] + 1)
            need[dst] -= 1
            if not need[dst]:
                ready.append(dst)
    yield from ((n, None, None, True) for n in need if need[n] and n in ends)


def _count_rounds(edges: DataFrame, starts: DataFrame, ends: DataFrame, keys: list[str], most: int) -> DataFrame:
    ends = cut(ends.select(*keys, "node").distinct(), "ends")
    edges = edges.select(*keys, "src", "dst").distinct().join(ends.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti")
    starts = cut(starts.select(*keys, "node").distinct(), "starts")
    edges = cut(spread(starts, edges, keys).withColumnRenamed("node", "src").join(edges, [*keys, "src"]), "path-edges")
    nodes = edges.select(*keys, F.col("src").alias("node")).union(edges.select(*keys, "dst")).distinct()
    need = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    todo = nodes.join(need, [*keys, "node"], "left").join(starts.withColumn("own", F.lit(1.0)), [*keys, "node"], "left")
    todo = cut(todo.select(*keys, "node", F.coalesce("need", F.lit(0)).alias("need"), F.coalesce("own", F.lit(0.0)).alias("n"), F.lit(1).alias("size")), "counts")
    done = None
    for _ in range(most):
        ready = cut(todo.where("need = 0").select(*keys, "node", "n", "size"), "counted")
        if ready.isEmpty():
            break
        met = ready.join(ends, [*keys, "node"], "left_semi")
        done = met if done is None else done.unionByName(met)
        fed = edges.join(ready.withColumnRenamed("node", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.count("*").alias("got"), F.sum("n").alias("more"), (F.max("size") + 1).alias("long"))
        todo = todo.where("need > 0").join(fed, [*keys, "node"], "left")
        todo = cut(todo.select(*keys, "node", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), (F.col("n") + F.coalesce("more", F.lit(0.0))).alias("n"), F.greatest("size", F.coalesce("long", "size")).alias("size")), "counts")
    behind = todo.where("need > 0").join(ends, [*keys, "node"], "left_semi").select(*keys, F.col("node").alias("target"), F.lit(None).cast("double").alias("n_paths"), F.lit(None).cast("int").alias("longest"), F.lit(True).alias("looped"))
    if done is None:
        return behind
    return done.select(*keys, F.col("node").alias("target"), F.col("n").alias("n_paths"), F.col("size").alias("longest"), F.lit(False).alias("looped")).unionByName(behind)


def backward_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, ends: DataFrame, keys: list[str], most: int = 100_000, bound: int = 0) -> DataFrame:
    """(keys, path): the simple paths from starts to the given targets, found from the targets back, so that no list is held that doesn't lead to one; other ends stop a path. bound: as in forward_paths."""
    found = None
    if bound:
        rows = _roles(keys, edges, starts, targets, ends)
        small, large = parted(rows, keys, bound)
        found = by_group(small, keys, ["role", "src", "dst"], f"path array<{edges.schema['src'].dataType.simpleString()}>", _backward_walk)
        if large is None:
            return found
        edges, starts, targets, ends = _unpacked(large, keys, 3)
    rounds = _backward_rounds(edges, starts, targets, ends, keys, most)
    return rounds if found is None else found.unionByName(rounds)


def _backward_rounds(edges: DataFrame, starts: DataFrame, targets: DataFrame, ends: DataFrame, keys: list[str], most: int) -> DataFrame:
    stops = ends.select(*keys, F.col("node").alias("src")).distinct()
    edges = cut(edges.select(*keys, "src", "dst").distinct().join(stops, [*keys, "src"], "left_anti"), "edges")
    begin = starts.select(*keys, F.col("node").alias("src")).distinct().withColumn("begins", F.lit(True))
    edges = cut(edges.join(begin, [*keys, "src"], "left"), "edges")
    open_, found = targets.select(*keys, F.array("node").alias("path"), F.col("node").alias("dst")).distinct(), None
    for _ in range(most):
        step = open_.join(edges, [*keys, "dst"]).where(~F.array_contains("path", F.col("src")))
        step = cut(step.select(*keys, F.concat(F.array("src"), "path").alias("path"), F.col("src").alias("dst"), "begins"), "paths")
        part = step.where("begins").select(*keys, "path")
        found = part if found is None else found.unionByName(part)
        open_ = step.select(*keys, "path", "dst")
        if open_.isEmpty():
            return found
    raise ValueError(f"paths longer than {most}")


def topological_order(nodes: DataFrame, layered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, pos): by layer, then document order; nodes on cycles come last in document order."""
    w = Window.partitionBy(*keys).orderBy(F.col("layer").isNull(), "layer", "ord")
    return nodes.join(layered, [*keys, "node"]).withColumn("pos", F.row_number().over(w))
