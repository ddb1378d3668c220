"""One-to-one matching of predictions and targets.

Three different matchings exist and are not interchangeable: maximum cardinality in a fixed
traversal order, maximum weight among the maximum-cardinality matchings, and plain maximum weight.
Spark makes the candidate edges between distinct spans, settles every edge whose two ends are single
and have no other edge, and finds the connected components of the rest: of keys with few edges inside tasks, of others
by star steps. A component is what reaches the matching, streamed in sorted order through each partition. There copies are counts: a class of equal spans is one node with
its capacity, and the results say how many pairs an edge stands for and at which ranks of the two classes they
begin. Spark then gives the pairs their numbers, by ranks and equi joins. Each matching has one
algorithm, with copies or without.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .components import connected
from .ordered import global_rank, sliced_lag, sliced_running, time_slice

# a key with more edges is taken apart by star steps, one with fewer inside a task
KEY_EDGES = 100_000
# hashed cells of the count that looks for such keys
CELLS = 1 << 16
# one component: (p, t, similarity, copies of p, copies of t), the smallest p first
Edge = tuple[int, int, float, int, int]
# copies of a class that follow each other in the order of numbers
Runs = list[tuple[int, int]]
# an edge row, how many pairs it stands for, and the ranks of the first pair (p goes down, t goes up), if that matters
Chosen = tuple[int, int, int | None, int | None]
Solver = Callable[[list[Edge], Runs, Runs], list[Chosen]]


class _Holders:
    """Who holds the first members of a target class, in their order, as runs of falling member ranks."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []  # class, rank of the first member, length
        self.starts: list[int] = []
        self.held = 0

    def at(self, rank: int) -> tuple[int, int, int]:
        """Class, member rank and rest of the run that holds this member."""
        i = bisect_right(self.starts, rank) - 1
        own, high, length = self.runs[i]
        offset = rank - self.starts[i]
        return own, high - offset, length - offset

    def put(self, rank: int, steps: int, own: int, member: int) -> None:
        """The member takes this place; of the run behind it, ``steps - 1`` move back by one and one is pushed out."""
        if rank == self.held:
            self.held += 1
            i, pieces = len(self.runs), [(own, member, 1)]
        else:
            i = bisect_right(self.starts, rank) - 1
            old, high, length = self.runs[i]
            offset = rank - self.starts[i]
            pieces = [(old, high, offset), (own, member, 1), (old, high - offset, steps - 1), (old, high - offset - steps, length - offset - steps)]
        low, up = max(i - 1, 0), i + 2
        merged: list[tuple[int, int, int]] = []
        for piece in [*self.runs[low:i], *pieces, *self.runs[i + 1 : up]]:
            if not piece[2]:
                continue
            if merged and merged[-1][0] == piece[0] and merged[-1][1] - merged[-1][2] == piece[1]:
                merged[-1] = (piece[0], merged[-1][1], merged[-1][2] + piece[2])
            else:
                merged.append(piece)
        at = self.starts[low] if low < len(self.starts) else 0
        starts = []
        for piece in merged:
            starts.append(at)
            at += piece[2]
        self.runs[low:up], self.starts[low:up] = merged, starts


def traversal_matching(edges: list[Edge], p_runs: Runs = (), t_runs: Runs = ()) -> list[Chosen]:
    """Maximum cardinality by augmenting paths: predictions in order, each trying its targets by
    similarity, then by number; an owner that is asked for its target tries its own further ones.

    Gives the pairs of a walk over single rows, but walks over classes: members of a target class are
    asked in their order, so who holds them is a list of runs; a member that meets a run of its own class moves the
    whole run back by one; and a class for which a search has failed stays unmatchable. ``p_runs`` and
    ``t_runs`` tell how the copies lie among each other; without them every class is one row and its name is its number."""
    room, options, row_of = {}, {}, {}
    for row, (p, t, similarity, _, t_n) in enumerate(edges):
        room[t] = t_n
        options.setdefault(p, []).append((-similarity, t))
        row_of[p, t] = row
    groups: dict[int, list[list[int]]] = {}  # targets of equal similarity, the best first
    for p, listed in options.items():
        listed.sort()
        groups[p] = []
        for k, (similarity, t) in enumerate(listed):
            if not k or similarity != listed[k - 1][0]:
                groups[p].append([])
            groups[p][-1].append(t)
    places: dict[int, tuple[list[int], list[int]]] = {}  # of each target class: first ranks and places of its runs
    ranks: dict = {}
    for place, (t, n) in enumerate(t_runs):
        first, where = places.setdefault(t, ([], []))
        first.append(ranks.get(t, 0))
        where.append(place)
        ranks[t] = ranks.get(t, 0) + n

    def place_of(t: int, rank: int) -> int:
        return places[t][1][bisect_right(places[t][0], rank) - 1] if places else t

    def run_end(t: int, rank: int) -> int:
        first = places[t][0] if places else [0]
        i = bisect_right(first, rank)
        return first[i] if i < len(first) else room[t]

    holders = {t: _Holders() for t in room}

    def search(name: int, member: int) -> bool:
        asked: dict[int, int] = {}  # members of each target class tried in this search
        at: dict[int, int] = {}
        path: list[tuple[int, int, int, int, int]] = []
        frames = [(name, member)]
        while frames:
            own, member = frames[-1]
            mine, g, free = groups[own], at.get(own, 0), []
            while g < len(mine):
                free = [t for t in mine[g] if asked.get(t, 0) < room[t]]
                if free:
                    break
                g += 1
            at[own] = g
            if not free:
                frames.pop()
                if path:
                    path.pop()
                continue
            target = free[0] if len(free) == 1 else min(free, key=lambda t: place_of(t, asked.get(t, 0)))
            rank, held = asked.get(target, 0), holders[target]
            if rank == held.held:
                path.append((target, rank, 1, own, member))
                for t, place, steps, who, number in path:
                    holders[t].put(place, steps, who, number)
                return True
            other, number, rest = held.at(rank)
            steps = 1
            if other == own:
                steps = rest if len(free) == 1 else min(rest, run_end(target, rank) - rank)
                number -= steps - 1
            path.append((target, rank, steps, own, member))
            frames.append((other, number))
            asked[target] = rank + steps
        return False

    for name, n in p_runs or [(p, 1) for p in sorted(groups)]:
        if name not in groups:
            continue
        done = ranks.get(("p", name), 0)
        while n and done >= 0:
            n -= 1
            done = done + 1 if search(name, done + 1) else -1
        ranks["p", name] = done
    return [
        (row_of[own, t], length, high, start + 1)
        for t, held in holders.items() for (own, high, length), start in zip(held.runs, held.starts)
    ]


def _flow(edges: list[Edge], all_pairs: bool) -> list[Chosen]:
    """Maximum-weight flow between classes: cheapest augmenting paths, several units at once, found by a heap
    over costs that potentials keep from being negative.

    With ``all_pairs`` it goes on to the largest number of pairs, else it stops without gain."""
    if len(edges) == 1:
        return [(0, min(edges[0][3:]), None, None)] if all_pairs or edges[0][2] > 1e-12 else []
    p_at: dict[int, int] = {}
    t_at: dict[int, int] = {}
    room_p, room_t, out, into = [], [], [], []
    starts, stops, cost = [], [], []
    for row, (p, t, similarity, p_n, t_n) in enumerate(edges):
        i = p_at.setdefault(p, len(p_at))
        j = t_at.setdefault(t, len(t_at))
        if i == len(out):
            out.append([])
            room_p.append(p_n)
        if j == len(into):
            into.append([])
            room_t.append(t_n)
        out[i].append(row)
        into[j].append(row)
        starts.append(i)
        stops.append(j)
        cost.append(-similarity)
    units = [0] * len(edges)
    high_p = [0.0] * len(out)
    high_t = [min(cost[r] for r in rows) for rows in into]
    high_end = min(high_t)
    while True:
        dist_p = [-h if room else float("inf") for h, room in zip(high_p, room_p)]
        dist_t, via_t, via_p = [float("inf")] * len(into), [-1] * len(into), [-1] * len(out)
        heap = [(d, 0, i) for i, d in enumerate(dist_p) if d < float("inf")]
        heapq.heapify(heap)
        end, best = -1, float("inf")
        while heap and heap[0][0] < best:
            d, side, node = heapq.heappop(heap)
            if side:
                if d > dist_t[node]:
                    continue
                if room_t[node] and d + max(high_t[node] - high_end, 0.0) < best:
                    end, best = node, d + max(high_t[node] - high_end, 0.0)
                for r in into[node]:
                    i = starts[r]
                    if units[r] and (reach := d + max(high_t[node] - cost[r] - high_p[i], 0.0)) < dist_p[i]:
                        dist_p[i], via_p[i] = reach, r
                        heapq.heappush(heap, (reach, 0, i))
            else:
                if d > dist_p[node]:
                    continue
                for r in out[node]:
                    j = stops[r]
                    if (reach := d + max(cost[r] + high_p[node] - high_t[j], 0.0)) < dist_t[j]:
                        dist_t[j], via_t[j] = reach, r
                        heapq.heappush(heap, (reach, 1, j))
        if end < 0:
            break
        high_p = [h + min(d, best) for h, d in zip(high_p, dist_p)]
        high_t = [h + min(d, best) for h, d in zip(high_t, dist_t)]
        high_end += best
        path, node, amount = [], end, room_t[end]
        while True:
            row = via_t[node]
            path.append((row, 1))
            source = starts[row]
            if via_p[source] < 0:
                amount = min(amount, room_p[source])
                break
            back = via_p[source]
            path.append((back, -1))
            amount = min(amount, units[back])
            node = stops[back]
        # what the path costs, from its own edges, as potentials carry rounding
        if not all_pairs and sum(cost[r] * sign for r, sign in path) >= -1e-12:
            break
        room_p[source] -= amount
        room_t[end] -= amount
        for row, sign in path:
            units[row] += sign * amount
    return [(row, n, None, None) for row, n in enumerate(units) if n]


def weighted_cardinality_matching(edges: list[Edge], p_runs: Runs = (), t_runs: Runs = ()) -> list[Chosen]:
    """Maximum weight among the matchings of maximum cardinality."""
    return _flow(edges, True)


def weighted_matching(edges: list[Edge], p_runs: Runs = (), t_runs: Runs = ()) -> list[Chosen]:
    """Maximum total weight; an edge is left out when that helps."""
    return _flow(edges, False)


def _by_group(groups: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """mapInPandas function over rows sorted by ``groups``: ``work`` gets whole groups, and the number of the group of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # batches of a group that goes on are kept apart until it ends
        open_group: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
            if open_group and batch[groups].iloc[0].equals(open_group[-1][groups].iloc[-1]):
                end = int(np.searchsorted(codes, 0, side="right"))
                open_group.append(batch.iloc[:end])
                batch, codes = batch.iloc[end:], codes[end:]
                if not len(batch):
                    continue
            if open_group:
                whole = pd.concat(open_group, ignore_index=True)
                yield work(whole, np.zeros(len(whole), dtype=np.int64))
            cut = int(np.searchsorted(codes, codes[-1]))
            open_group = [batch.iloc[cut:]]
            if cut:
                yield work(batch.iloc[:cut], codes[:cut])
        if open_group:
            whole = pd.concat(open_group, ignore_index=True)
            yield work(whole, np.zeros(len(whole), dtype=np.int64))

    return run


def _with_roots(rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
    """``root`` of each edge of whole groups, the smallest prediction of its component, and the edges of its two ends."""
    p, t = (rows.groupby([codes, c], sort=True).ngroup().to_numpy() for c in ("p_no", "t_no"))
    root = np.arange(p.max() + 1)
    while True:
        least = np.full(t.max() + 1, len(root))
        np.minimum.at(least, t, root[p])
        lower = root.copy()
        np.minimum.at(lower, p, least[t])
        np.minimum.at(lower, root[p], least[t])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    number = np.empty(len(root), dtype=rows["p_no"].dtype)
    number[p] = rows["p_no"].to_numpy()
    return rows.assign(_dp=np.bincount(p)[p], _dt=np.bincount(t)[t], root=number[root[p]])


def _solve_rows(rows: pd.DataFrame, codes: np.ndarray, solver: Solver) -> pd.DataFrame:
    kinds = rows["_kind"].to_numpy()
    whole = lambda c: rows[c].astype("int64").tolist()
    p, t, p_n, t_n = map(whole, ("p_no", "t_no", "p_n", "t_n"))
    edges = list(zip(p, t, rows["similarity"].tolist(), p_n, t_n))
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (kinds[1:] != kinds[:-1])])
    parts = list(zip(kinds[starts].tolist(), codes[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)]))
    found: list[Chosen] = []
    for k, (kind, code, lo, hi) in enumerate(parts):
        if kind:
            continue
        runs: dict[int, Runs] = {1: [], 2: []}
        for other, same, a, b in parts[k + 1 : k + 3]:
            if other and same == code:
                runs[other] = list(zip((p, t)[other - 1][a:b], (p_n, t_n)[other - 1][a:b]))
        found += [(lo + row, *rest) for row, *rest in solver(edges[lo:hi], runs[1], runs[2])]
    found.sort(key=lambda x: x[0])
    chosen = rows.iloc[[x[0] for x in found]].drop(columns=["_kind", "_seq"])
    return chosen.assign(units=np.array([x[1] for x in found], dtype=np.int64), p_at=[x[2] for x in found], t_at=[x[3] for x in found])


def fold_copies(df: DataFrame, number: str, tag: str) -> DataFrame:
    """Equal rows (in all columns but ``number``) as one row with its first number and ``{tag}_n``.

    Copies are combined on the map side, so a group of copies neither multiplies edges nor makes a
    hot task."""
    same = [c for c in df.columns if c != number]
    return df.groupBy(*same).agg(F.min(number).alias(number), F.count(F.lit(1)).alias(f"{tag}_n"))


def _placed(edges: DataFrame, base: list[str]) -> DataFrame:
    """``root`` of the component of each edge, and how many edges its two ends have (``_dp``, ``_dt``).

    Keys with few edges go to tasks whole, where their edges are counted and taken apart; the edges of a key with more are counted by
    their ends and linked by star steps. One count over hashed cells tells whether there can be such keys at all."""
    count = F.count(F.lit(1))
    of_p, of_t = (Window.partitionBy(*base, c) for c in ("p_no", "t_no"))

    kinds = [*edges.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_dp", "_dt")], T.StructField("root", edges.schema["p_no"].dataType)]
    in_tasks = lambda rows: rows.repartition(*base).sortWithinPartitions(*base).mapInPandas(_by_group(base, _with_roots), T.StructType(kinds))
    cells = edges.groupBy(F.pmod(F.xxhash64(*base), F.lit(CELLS)).alias("_cell")).agg(count.alias("n"))
    if (cells.agg(F.max("n")).first()[0] or 0) <= KEY_EDGES:
        return in_tasks(edges)
    large = materialize(edges.groupBy(*base).agg(count.alias("n")).filter(F.col("n") > KEY_EDGES).select(*base), "large_keys")
    linked = edges.join(large, base, "left_semi").withColumn("_dp", count.over(of_p))
    linked = materialize(linked.withColumns({"_dt": count.over(of_t), "_first_p": F.min("p_no").over(of_t)}), "large_edges")
    # predictions that share a target are linked, so the components of predictions are those of the edges
    roots = connected(linked.select(*base, F.col("p_no").alias("a"), F.col("_first_p").alias("b")), base)
    rooted = linked.drop("_first_p").join(roots.withColumnRenamed("node", "p_no"), [*base, "p_no"], "left")
    return in_tasks(edges.join(large, base, "left_anti")).unionByName(rooted.withColumn("root", F.coalesce("root", "p_no")))


def match_edges(
    edges: DataFrame, keys: Sequence[str], solver: Solver, *, extra: Sequence[str] = (), predictions: DataFrame | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Chosen edges of a matching per (keys, extra), with ``units`` and, for the ordered matching, ``p_at`` and
    ``t_at``: pair i of an edge is member p_at - i of its prediction class and t_at + i of its target class.

    ``edges`` (best written already): keys, extra (for example a threshold),
    p_no, t_no, similarity, and p_n, t_n when their ends are folded copies. ``predictions`` and ``targets`` (the rows before
    folding) tell the ordered matching how copies of different classes lie among each other; how often the
    class changes along the numbers of a component is what a task holds of them.
    """
    keys, extra = list(keys), list(extra)
    base = [*keys, *extra]
    ordered = solver is traversal_matching
    one = F.lit(1).cast("bigint")
    edges = edges.withColumns({c: one for c in ("p_n", "t_n") if c not in edges.columns})
    # edges without a key or a number meet nothing
    edges = edges.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*base, "p_no", "t_no"]]))
    marked = materialize(_placed(edges, base), "edges")
    lone = (F.col("_dp") == 1) & (F.col("_dt") == 1)
    if ordered:
        lone = lone & (F.col("p_n") == 1) & (F.col("t_n") == 1)
    no_rank = F.lit(None).cast("bigint")
    settled = marked.filter(lone).select(*edges.columns, F.least("p_n", "t_n").alias("units"), no_rank.alias("p_at"), no_rank.alias("t_at"))
    placed = marked.filter(~lone).drop("_dp", "_dt").withColumns({"_kind": F.lit(0), "_seq": no_rank})
    copies = "p_n > 1 OR t_n > 1"
    if ordered and marked.filter(copies).take(1):
        folded = placed.filter(copies).select(*base, "root").distinct()
        inside = placed.join(folded, [*base, "root"], "left_semi")
        placed = placed.unionByName(_runs(inside, predictions, targets, base), allowMissingColumns=True)
        # a column of whole numbers with nulls would reach pandas as floating point
        placed = placed.na.fill(0, ["p_no", "t_no", "p_n", "t_n"])
    group = [*base, "root"]
    schema = T.StructType([*[T.StructField(c, placed.schema[c].dataType) for c in [*edges.columns]], T.StructField("root", placed.schema["root"].dataType), *[T.StructField(c, T.LongType()) for c in ("units", "p_at", "t_at")]])
    solved = (
        placed.select(*edges.columns, "root", "_kind", "_seq")
        .repartition(*group)
        .sortWithinPartitions(*group, "_kind", "_seq", "p_no", F.desc("similarity"), "t_no")
        .mapInPandas(_by_group(group, lambda rows, codes: _solve_rows(rows, codes, solver)), schema)
        .drop("root")
    )
    return settled.unionByName(solved)


def _with_class(rows: DataFrame, number: str) -> DataFrame:
    """``_class``: the first number of the copies of a row (equal in all other columns, nulls included), and their count ``_copies``."""
    same = F.struct(*[c for c in rows.columns if c != number]).alias("_same")
    folds = rows.select(same, number).groupBy("_same").agg(F.min(number).alias("_class"), F.count(F.lit(1)).alias("_copies"))
    return rows.select("*", same).join(folds, "_same").drop("_same")


def _runs(edges: DataFrame, predictions: DataFrame, targets: DataFrame, base: Sequence[str]) -> DataFrame:
    """Copies of the classes of each component that follow each other in the order of numbers (``_kind`` 1: predictions, 2: targets)."""
    group = [*base, "root", "_kind"]
    sides = []
    for kind, (number, rows) in enumerate((("p_no", predictions), ("t_no", targets)), 1):
        by = [c for c in base if c in rows.columns]
        nodes = edges.select(*base, "root", F.col(number).alias("_class"), F.lit(kind).alias("_kind")).distinct()
        asked = rows.join(edges.select(*by).distinct(), by, "left_semi")
        members = _with_class(asked, number).select(*by, "_class", F.col(number).alias("_number"))
        sides.append(members.join(nodes, [*by, "_class"]).select(*group, "_class", "_number"))
    # dense numbers over all components, so that slices of them are of one size whatever the numbers are
    ranked = global_rank(sides[0].unionByName(sides[1]), [*map(F.col, group), F.col("_number")], "_place")
    block = time_slice("_place", 10_000.0)
    ranked = sliced_lag(ranked, group, [F.col("_place")], block, {"_prior": F.col("_class")})
    change = F.when(F.col("_prior").eqNullSafe(F.col("_class")), 0).otherwise(1).cast("bigint")
    numbered = sliced_running(ranked, group, [F.col("_place")], block, sums={"_seq": change})
    runs = numbered.groupBy(*group, "_seq", "_class").agg(F.count(F.lit(1)).alias("_n"))
    mine = {f"{tag}{c}": F.when(F.col("_kind") == kind, F.col(x)) for kind, tag in ((1, "p"), (2, "t")) for c, x in (("_no", "_class"), ("_n", "_n"))}
    return runs.select(*group, "_seq", *[c.alias(n) for n, c in mine.items()])


def expand_pairs(pairs: DataFrame, predictions: DataFrame, targets: DataFrame, keys: Sequence[str], *, extra: Sequence[str] = ()) -> DataFrame:
    """Row-level pairs from folded ones: the members of both sides meet rank by rank, at the ranks that the matching
    gave or, where any will do, in order.

    ``pairs`` should be written already: it is looked at for folded rows, and read by two branches."""
    base = [*keys, *extra]
    single = (F.col("p_n") == 1) & (F.col("t_n") == 1)
    multi = pairs.filter(~single)
    out = [c for c in pairs.columns if c not in ("p_at", "t_at")]
    if not multi.take(1):
        return pairs.select(*out)
    before = lambda by, order: F.coalesce(
        F.sum("units").over(Window.partitionBy(*base, by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    unit = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("units")))
    ranked = (
        multi.withColumns({"_op": before("p_no", "t_no"), "_ot": before("t_no", "p_no")})
        .withColumn("_u", unit)
        .withColumns(
            {
                "_rp": F.coalesce(F.col("p_at") - F.col("_u") + 1, F.col("_op") + F.col("_u")),
                "_rt": F.coalesce(F.col("t_at") + F.col("_u") - 1, F.col("_ot") + F.col("_u")),
            }
        )
    )
    members = _member_ranks(multi, predictions, targets, base)
    for kind, df, number, rank in ((1, predictions, "p_no", "_rp"), (2, targets, "t_no", "_rt")):
        by = [c for c in base if c in df.columns]
        own = members.filter(F.col("_kind") == kind).select(*by, F.col("_class").alias(number), F.col("_rank").alias(rank), "_member")
        ranked = ranked.join(own, [*by, number, rank], "left").withColumn(number, F.coalesce("_member", number)).drop("_member")
    return pairs.filter(single).select(*out).unionByName(ranked.select(*out)).withColumn("units", F.lit(1).cast("bigint"))


def _member_ranks(pairs: DataFrame, predictions: DataFrame, targets: DataFrame, base: Sequence[str]) -> DataFrame:
    """Copies of the items of ``pairs``, with the class they belong to and their rank in it (``_kind`` 1: predictions, 2: targets).

    All copies are numbered once in the order of (class, number); a rank is the distance to the first of its class."""
    sides = []
    for kind, (number, rows) in enumerate((("p_no", predictions), ("t_no", targets)), 1):
        by = [c for c in base if c in rows.columns]
        asked = rows.join(pairs.select(*by).distinct(), by, "left_semi")
        missing = [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in base if c not in by]
        copies = _with_class(asked, number).filter("_copies > 1")
        sides.append(copies.select(*by, *missing, F.lit(kind).alias("_kind"), "_class", F.col(number).alias("_member")).select(*base, "_kind", "_class", "_member"))
    own = [*base, "_kind", "_class"]
    ranked = global_rank(sides[0].unionByName(sides[1]), [*map(F.col, own), F.col("_member")], "_place")
    fold = F.struct(*own).alias("_fold")
    first = ranked.select(fold, "_place").groupBy("_fold").agg(F.min("_place").alias("_from"))
    return ranked.select("*", fold).join(first, "_fold").withColumn("_rank", F.col("_place") - F.col("_from") + 1).select(*own, "_member", "_rank")


def at_thresholds(edges: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Edges made once at the lowest threshold, repeated for every threshold they reach."""
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("similarity") >= t)
    return edges.withColumn("threshold", F.explode(reached))


def duplicates(predictions: DataFrame, edges: DataFrame, pairs: DataFrame, keys: Sequence[str], *, extra: Sequence[str] = ()) -> DataFrame:
    """Unmatched predictions similar to a target that is already matched.

    After both stages every target next to an unmatched prediction is taken (a free one would have
    been matched to it), so an unmatched prediction with any edge is a duplicate. ``edges`` may be
    folded; ``predictions`` are the rows before folding, ``pairs`` row-level."""
    base = [*keys, *extra]
    near = edges.select(*base, F.col("p_no").alias("_class")).distinct()
    by = [c for c in base if c in predictions.columns]
    rows = _with_class(predictions, "p_no").drop("_copies").join(near, [*by, "_class"]).drop("_class")
    return rows.join(pairs.select(*base, "p_no"), [*base, "p_no"], "left_anti")


def members_of(rows: DataFrame, number: str, classes: DataFrame, base: Sequence[str]) -> DataFrame:
    """(base, _class, number) of the rows that are copies of each other in ``classes`` (base, _class)."""
    by = [c for c in base if c in rows.columns]
    asked = rows.join(classes.select(*by).distinct(), by, "left_semi")
    copies = _with_class(asked, number).filter("_copies > 1").select(*by, "_class", number)
    return copies.join(classes, [*by, "_class"]).select(*base, "_class", number)


def duplicate_numbers(predictions: DataFrame, edges: DataFrame, pairs: DataFrame, base: Sequence[str]) -> DataFrame:
    """(base, p_no) of the rows that :func:`duplicates` gives; rows that share a number all stay.

    ``edges`` are folded (p_n) and written already: a class of one is its number, and only those of more ask for their rows."""
    near = edges.select(*base, "p_no", "p_n").distinct()
    numbers = near.filter("p_n = 1 AND p_no IS NOT NULL").select(*base, "p_no")
    if edges.filter("p_n > 1").take(1):
        classes = near.filter("p_n > 1").select(*base, F.col("p_no").alias("_class"))
        numbers = numbers.unionByName(members_of(predictions, "p_no", classes, base).select(*base, "p_no"))
    return numbers.join(pairs.select(*base, "p_no"), [*base, "p_no"], "left_anti")


def unmatched(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    return rows.join(pairs.select(*keys, number), [*keys, number], "left_anti")
