"""Exact nearest neighbours through a metric index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Donors of a ledger that are one pivot; ledgers of no more donors need no index.
BLOCK = 2048
#: Donors that one task holds, and queries that meet them there.
PAGE = 8192
#: Clusters whose bounds one task looks at together.
TABLE = 8192
#: Donors that are multiplied together, and similarities or angles that are held at once.
STRIP, HELD = 512, 1 << 19
#: Similarities are rounded to six places, so bounds that miss by less than this are no bounds.
SLACK = 2e-6
#: Tables with a row for each ledger or page are broadcast up to so many.
FEW = 100_000


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _units(df: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows whose vectors are finite (others are near to nothing), and these at unit length."""
    unit = _unit(df["embedding"])
    good = np.isfinite(unit).all(axis=1)
    return (df, unit) if good.all() else (df[good], unit[good])


def _angles(unit: np.ndarray, pivots: np.ndarray, of_zero: float) -> np.ndarray:
    """Angles to the pivots; a vector of length zero has none, so ``of_zero`` stands for it."""
    angles = np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))
    angles[~unit.any(axis=1)] = of_zero
    return angles


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, HELD // max(1, width))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _bounds(unit: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each query, and what a similarity to any donor of a cluster can be at most."""
    angles = _angles(unit, pivots, 0.0)
    return angles.argmin(axis=1), np.cos(np.maximum(0.0, angles - radius))


def _clusters(unit: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots among donors in order of their ids, one for ``block`` of them; each donor's cluster; the clusters' radii."""
    some = np.random.default_rng(len(unit)).permutation(len(unit))[: -(-len(unit) // block)]
    pivots, nearest, least = unit[some], np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for part in _slices(len(unit), len(some)):
        angles = _angles(unit[part], pivots, np.pi)  # a donor of length zero keeps its cluster open to all
        nearest[part], least[part] = angles.argmin(axis=1), angles.min(axis=1)
    used, nearest = np.unique(nearest, return_inverse=True)
    radius = np.zeros(len(used))
    np.maximum.at(radius, nearest, least)
    return pivots[used], nearest, radius


def _first(sims: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each row, of equal ones the first."""
    keep = np.isfinite(sims)
    if sims.shape[1] <= k:
        return keep
    least = np.partition(sims, -k, axis=1)[:, -k, None]
    above, equal = sims > least, (sims == least) & keep
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))


class _Cell:
    """Queries against the donors of one page: the ``k`` best of each, ties to the smaller id, none below ``least``.

    The donors lie in clusters. What a query's own cluster holds gives a first bound; the clusters
    that it does not exclude are multiplied in strips of donors, and each strip may raise the bound.
    """

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, k: int, causal: bool):
        left, self.q = _units(left)
        right, self.d = _units(right.sort_values("id"))
        self.k, self.asking, self.names = k, left["id"].to_numpy(object), right["id"].to_numpy(object)
        self.own = [np.searchsorted(self.names, self.asking, side) for side in ("left", "right")]
        self.days = (left["day"].to_numpy(), right["day"].to_numpy()) if causal else None
        self.least = left["least"].to_numpy(np.float64).copy() if "least" in left else np.full(len(left), -2.0)
        self.sims, self.at = np.full((len(left), k), -np.inf), np.full((len(left), k), len(right))

    def _product(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Similarities, minus infinity where a query may not meet a donor; ``cols`` ascend."""
        sims = self.q[rows] @ self.d[cols].T
        lo, hi = (np.searchsorted(cols, at[rows]) for at in self.own)
        while (mine := np.flatnonzero(lo < hi)).size:
            sims[mine, lo[mine]] = -np.inf
            lo[mine] += 1
        if self.days:
            sims[self.days[1][None, cols] >= self.days[0][rows, None]] = -np.inf
        return sims

    def _meet(self, rows: np.ndarray, cols: np.ndarray) -> None:
        sims, k = self._product(rows, cols), self.k
        over = sims >= self.least[rows, None] - SLACK
        crowded = np.flatnonzero(np.count_nonzero(over, axis=1) > k)
        if len(crowded):
            over[crowded] = _first(np.round(sims[crowded], 6), k)
        row, col = np.nonzero(over)
        if not len(row):
            return
        some, start, count = np.unique(row, return_index=True, return_counts=True)
        into = np.repeat(np.arange(len(some)), count), k + np.arange(len(row)) - np.repeat(start, count)
        both, at = np.full((len(some), 2 * k), -np.inf), np.full((len(some), 2 * k), len(self.d))
        some = rows[some]
        both[:, :k], at[:, :k] = self.sims[some], self.at[some]
        both[into], at[into] = np.round(sims[row, col], 6), cols[col]
        best = np.lexsort((at, -both), axis=1)[:, :k]
        self.sims[some], self.at[some] = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
        self.least[some] = np.maximum(self.least[some], self.sims[some, -1])

    def run(self, block: int) -> int:
        """Finds the neighbours; how many pairs of query and cluster it visited."""
        if not len(self.q) or not len(self.d):
            return 0
        pivots, cluster, radius = _clusters(self.d, block)
        order = np.argsort(cluster, kind="stable")
        cluster, visited = cluster[order], 0
        starts = np.searchsorted(cluster, np.arange(len(radius) + 1))
        for part in _slices(len(self.q), max(STRIP, len(radius))):
            own, bounds = _bounds(self.q[part], pivots, radius)
            for c in np.unique(own) if len(radius) > 1 else ():
                rows, cols = part.start + np.flatnonzero(own == c), order[starts[c] : starts[c + 1]][:STRIP]
                if len(cols) >= self.k:
                    self.least[rows] = np.maximum(self.least[rows], np.partition(self._product(rows, cols), -self.k, axis=1)[:, -self.k])
            seen = np.zeros(bounds.shape, bool)
            for i in range(0, len(order), STRIP):
                touched = slice(cluster[i], cluster[min(i + STRIP, len(order)) - 1] + 1)
                need = bounds[:, touched] >= self.least[part, None] - SLACK
                seen[:, touched] |= need
                rows = part.start + np.flatnonzero(need.any(axis=1))
                if len(rows):
                    self._meet(rows, np.sort(order[i : i + STRIP]))
            visited += int(seen.sum())
        return visited


def _nearest(k: int, causal: bool, block: int, space: list[str]) -> Callable:
    """A block of queries against a page of donors: at most ``k`` rows a query, and one that counts the clusters visited."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*space, "query_id", "transaction_id", "similarity", "visited"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns})
        cell = _Cell(left, right, k, causal)
        visited = cell.run(block)
        row, n = np.nonzero(np.isfinite(cell.sims))
        found = [np.append(cell.asking[row], None), np.append(cell.names[cell.at[row, n]], None), np.append(cell.sims[row, n], np.nan), pd.array([*[None] * len(row), visited], "Int64")]
        return pd.DataFrame(dict(zip(columns[-4:], found))).assign(**{c: left[c].iloc[0] for c in space})[columns]

    return nearest


def _found(left: DataFrame, right: DataFrame, by: list[str], space: list[str], kinds: dict[str, str], *how) -> DataFrame:
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in space), "query_id string, transaction_id string, similarity double, visited long"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_nearest(*how, space), schema)


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("query_id is not null").select(F.col("ledger_id").cast("long"), "query_id", "transaction_id", "similarity")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ledger_id", "query_id").orderBy(F.col("similarity").desc(), "transaction_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _fresh(df: DataFrame, space: list[str], causal: bool) -> DataFrame:
    """The columns a search needs, under new names as queries and donors may come from one table; days as numbers."""
    fields = [F.col(c).alias(c) for c in [*space, "id", "embedding"]]
    if not causal:
        return df.select(*fields)
    kind = df.schema["day"].dataType.typeName()
    day = F.unix_date("day") if kind == "date" else F.unix_micros("day") if kind == "timestamp" else F.col("day")
    return df.select(*fields, day.alias("day")).where("day is not null")


def _spaces(queries: DataFrame, donors: DataFrame) -> list[str]:
    return ["ledger_id", *(["model_version"] if "model_version" in queries.columns and "model_version" in donors.columns else [])]


class Search:
    """Which parts of the donors each query must meet, and the neighbours found there.

    Donors of a ledger (and model) are dealt to the nearest of some pivots among them, one for
    ``page`` donors, and lie there in pages of about as many. Within a page they are dealt again, to
    one pivot for ``block`` donors, and each such cluster has a radius, the largest angle to a donor in it.
    No donor of a cluster is nearer to a query than the query's angle to the pivot less the radius.
    A query first meets one page of its own pivot; a page all of whose clusters the ``k``-th neighbour
    found there excludes is never visited, all else is, so nothing is lost. A page goes to
    a task once for each ``page`` queries that ask for it, so without clusters the search
    costs what a block product does, however small ``block`` is. ``keep`` stores tables that are read again.
    """

    def __init__(self, queries: DataFrame, donors: DataFrame, space: list[str], k: int, causal: bool, block: int, keep: Callable[[DataFrame], DataFrame], page: int, few: bool):
        self.space, self.k, self.causal, self.block, self.page = space, k, causal, block, page
        self.small = F.broadcast if few else lambda df: df
        self.fields = [c for c in queries.columns if c not in space]
        self.kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *donors.schema]}
        self.row = ", ".join(f"{c} {self.kind[c]}" for c in [*space, *self.fields])
        pivots = self._pivots(donors)
        placed = keep(self._placed(self._blocks(donors, self.small), pivots, "c int"))
        parts = placed.groupBy(*space, "c").agg(F.ceil(F.count("*") / page).alias("parts"))
        self.donors = self._paged(placed, parts, "inner")
        self.pages = keep(self._summed())
        self.queries = keep(self._paged(self._placed(self._blocks(queries), pivots, "c int, b int"), parts, "left"))

    def _blocks(self, df: DataFrame, small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Rows with a block of their ledger, of ``page`` rows in the mean."""
        sizes = df.groupBy(*self.space).agg(F.ceil(F.count("*") / self.page).alias("_n"))
        return df.join(small(sizes), self.space).select(*self.space, *self.fields, F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("b"))

    def _pivots(self, donors: DataFrame) -> DataFrame:
        """Pivots of each ledger: donors whose hash the page size divides, and the one of least hash."""
        h = F.xxhash64("id")
        some = F.collect_list(F.when(F.pmod(h, F.lit(self.page)) == 0, F.struct("id", "embedding")))
        listed = donors.groupBy(*self.space).agg(F.min_by(F.struct("id", "embedding"), F.struct(h, F.col("id"))).alias("least"), some.alias("some"))
        return listed.select(*self.space, F.transform(F.array_distinct(F.concat(F.array("least"), F.sort_array("some"))), lambda p: p["embedding"]).alias("pivots"))

    def _placed(self, blocks: DataFrame, pivots: DataFrame, more: str) -> DataFrame:
        """Rows of ledgers with donors, and the nearest of the ledger's pivots."""
        table = blocks.select(*self.space, "b").distinct().join(pivots, self.space)
        columns = [*self.space, *self.fields, *re.findall(r"(\w+) int", more)]

        def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return left.head(0).assign(c=pd.Series(dtype="int32"))[columns]
            unit, pivots = _unit(left["embedding"]), _unit(pd.Series(list(right["pivots"].iloc[0])))
            c = [_angles(unit[part], pivots, 0.0).argmin(axis=1) for part in _slices(len(unit), len(pivots))]
            return left.assign(c=np.concatenate(c).astype("int32"))[columns]

        by = [*self.space, "b"]
        return blocks.groupBy(*by).cogroup(table.select(*[F.col(c).alias(c) for c in table.columns]).groupBy(*by)).applyInPandas(place, f"{self.row}, {more}")

    def _paged(self, placed: DataFrame, parts: DataFrame, how: str) -> DataFrame:
        """Rows with a page ``p`` of their pivot, one of several where it has many donors."""
        p = F.shiftleft(F.col("c").cast("long"), 24) + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
        parts = parts.select(*[F.col(c).alias(c) for c in parts.columns])
        return placed.join(self.small(parts), [*self.space, "c"], how).select(*[c for c in placed.columns if c != "c"], p.alias("p"))

    def _summed(self) -> DataFrame:
        """Clusters of each page: their pivots in a row, and their radii."""
        by, block = [*self.space, "p"], self.block

        def summed(page: pd.DataFrame) -> pd.DataFrame:
            rows, unit = _units(page.sort_values("id"))
            pivots, _, radius = _clusters(unit, block) if len(rows) else (unit, None, np.zeros(0))
            return page.head(1)[by].assign(pivots=[pivots.ravel()], radius=[radius])

        return self.donors.groupBy(*by).applyInPandas(summed, f"{', '.join(f'{c} {self.kind[c]}' for c in self.space)}, p long, pivots array<double>, radius array<double>")

    def _asks(self, queries: DataFrame) -> DataFrame:
        """Queries with the pages, beside their first, that ``least`` does not exclude; clusters are looked at in tables."""
        sizes = self.small(self.pages.groupBy(*self.space).agg(F.ceil(F.sum(F.size("radius")) / TABLE).alias("_n")))
        left = queries.join(sizes, self.space).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n"), F.lit(1)) - 1))).drop("_n")
        tables = self.pages.join(sizes, self.space).select(*self.space, F.col("p").alias("page"), "pivots", "radius", F.pmod(F.xxhash64("p"), F.greatest(F.col("_n"), F.lit(1))).alias("t"))
        right = queries.select(*self.space, "b").distinct().join(tables, self.space)
        columns, by = [*self.space, *self.fields, "least", "asked"], [*self.space, "b", "t"]

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right[right["radius"].map(len) > 0]
            if left.empty or right.empty:
                return left.head(0).assign(asked=pd.Series(dtype=object))[columns]
            unit, radius, page = _unit(left["embedding"]), np.concatenate(right["radius"].to_list()), right["page"].to_numpy()
            pivots = np.concatenate(right["pivots"].to_list()).reshape(len(radius), -1)
            starts = np.cumsum([0, *right["radius"].map(len)])[:-1]
            need = np.zeros((len(left), len(page)), bool)
            for part in _slices(len(left), len(radius)):
                need[part] = np.maximum.reduceat(_bounds(unit[part], pivots, radius)[1], starts, axis=1) >= left["least"].to_numpy()[part, None] - SLACK
            need &= page[None, :] != left["p"].to_numpy()[:, None]
            return left.assign(asked=[page[n] for n in need])[columns][need.any(axis=1)]

        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(ask, f"{self.row}, least double, asked array<long>")

    def _met(self, asks: DataFrame) -> DataFrame:
        """What queries find in the pages they ask for; a page goes once to each block of them."""
        by = [*self.space, "p"]
        sizes = asks.groupBy(*by).agg(F.ceil(F.count("*") / self.page).alias("_n"))
        sizes = self.small(sizes.select(*[F.col(c).alias(c) for c in sizes.columns]))
        left = asks.join(sizes, by).withColumn("b", F.pmod(F.xxhash64("id", F.lit(2)), F.col("_n"))).drop("_n")
        right = self.donors.join(sizes, by).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        return _found(left, right, [*by, "b"], self.space, self.kind, self.k, self.causal, self.block)

    def run(self, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Neighbours, and by ledger (and model) the pairs of query and cluster there are and those visited."""
        home = keep(self._met(self.queries.where("p is not null").drop("b")))
        first = _ranked(_pairs(home), self.k).drop("rank")
        least = first.groupBy("ledger_id", F.col("query_id").alias("id")).agg(F.when(F.count("*") >= self.k, F.min("similarity")).otherwise(-2.0).alias("least"))
        asking = self.queries.join(least, ["ledger_id", "id"], "left").withColumns({"least": F.coalesce("least", F.lit(-2.0)), "p": F.coalesce("p", F.lit(-1).cast("long"))})
        asks = keep(self._asks(asking))
        rest = keep(self._met(asks.withColumn("p", F.explode("asked")).drop("asked")))
        count = self.queries.groupBy(*self.space).agg(F.count("*").alias("_q"))
        there = self.pages.groupBy(*self.space).agg(F.sum(F.size("radius")).alias("_c")).join(count, self.space).select(*self.space, (F.col("_q") * F.col("_c")).alias("pairs"))
        seen = home.unionByName(rest).groupBy(*self.space).agg(F.sum("visited").alias("visited"))
        visits = there.join(seen.select(*[F.col(c).alias(c) for c in seen.columns]), self.space, "left").select(*self.space, "pairs", F.coalesce("visited", F.lit(0)).alias("visited"))
        return _pairs(home).unionByName(_pairs(rest)), visits


def _product(queries: DataFrame, donors: DataFrame, space: list[str], k: int, causal: bool, block: int) -> DataFrame:
    """All blocks of queries against the one block of donors that each ledger has."""
    sizes = queries.groupBy(*space).agg(F.ceil(F.count("*") / block).alias("_n"))
    q = queries.join(sizes, space).withColumn("b", F.pmod(F.xxhash64("id"), F.col("_n"))).drop("_n")
    d = donors.join(sizes, space).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    kinds = {c: queries.schema[c].dataType.simpleString() for c in space}
    return _pairs(_found(q, d, [*space, "b"], space, kinds, k, causal, block))


def _sizes(donors: DataFrame, space: list[str]) -> tuple[int, int, int]:
    """The largest ledger, ledgers, and donors."""
    return tuple(n or 0 for n in donors.groupBy(*space).count().agg(F.max("count"), F.count("*"), F.sum("count")).first())


def search(queries: DataFrame, donors: DataFrame, k: int = 5, causal: bool = False, block: int = BLOCK, keep: Callable[[DataFrame], DataFrame] = lambda df: df, page: int = PAGE, sizes: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``knn`` through the index, and how many pairs of query and cluster (``pairs``) it ``visited`` by ledger."""
    space, page = _spaces(queries, donors), max(block, page)
    _, ledgers, rows = sizes or _sizes(donors, space)
    near, visits = Search(_fresh(queries, space, causal), _fresh(donors, space, causal), space, k, causal, block, keep, page, ledgers + 2 * rows // page <= FEW).run(keep)
    return _ranked(near, k), visits


def knn(queries: DataFrame, donors: DataFrame, k: int = 5, causal: bool = False, block: int = BLOCK, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The ``k`` nearest donors of each query in its ledger by cosine, not itself.

    Both have ledger_id, id and embedding, and where both have model_version, only
    vectors of one model meet. With ``causal`` both have a day, and only strictly earlier
    donors count. Similarities are rounded to six places before ranking, ties go to the
    smaller id. Vectors of length zero have similarity 0. Ids are unique within a ledger.

    Where no ledger has more than ``block`` donors, blocks of queries meet the ledger's
    donors; else the donors are searched through ``Search``. Three numbers decide and come to the
    driver: the size of the largest ledger, the ledgers and the donors.
    """
    space = _spaces(queries, donors)
    sizes = _sizes(donors, space)
    if sizes[0] > block:
        return search(queries, donors, k, causal, block, keep, sizes=sizes)[0]
    return _ranked(_product(_fresh(queries, space, causal), _fresh(donors, space, causal), space, k, causal, block), k)
