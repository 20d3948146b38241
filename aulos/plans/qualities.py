"""How many pairs of tracks have which quality of transition, counted without making the pairs.

All that a total depends on but the centroid has few values: tempos, keys, genres, outros and intros, drops at the ends. Spark evaluates the parts of the
score for every two values of each, by the same SQL as the pairs themselves. Given these parts a total only falls as two centroids move apart, so each
bound of a quality is a distance up to which it holds; it is found to the last bit. Equal tracks are one row with a count. Of a tempo and key on the
left, the rows on the right within 9 percent fall into a few hundred groups with the same parts; sorted by centroid, each gives its share
by binary search. Tempos are dealt over the cluster in spans, and large spans in parts, so memory and the longest task are bounded.
Missing and endless centroids count as in the SQL: their spectral score is 0, or not a number, which is above every bound.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the qualities; a rounded total reaches one if the total reaches half a step of its ninth digit below.
QUALITIES = {"Excellent": 0.7999999995, "Good": 0.5999999995, "Fair": 0.3999999995}
#: Tempos of a span, rows of its parts on the left and on the right, and distances looked up at once.
SPAN, LEFT, RIGHT, REACH = 32, 1 << 16, 1 << 20, 1 << 22
#: Kinds of centroid: finite, null, not a number, and the two endless ones. Their distances from each other, where they don't depend on values.
FINITE, NULL, NAN, UP, DOWN = range(5)
_END, _ANY = np.inf, -2.0  # a spectral score of 0, and one that is not a number
_APART = np.array([[0, _END, _ANY, _END, _END], [_END] * 5, [_ANY, _END, _ANY, _ANY, _ANY], [_END, _END, _ANY, _ANY, _END], [_END, _END, _ANY, _END, _ANY]])
_SUMS = ", ".join([f"at{k} long" for k in range(len(QUALITIES))] + ["every long"])


def farthest(h, e, d, g, b, least: float) -> np.ndarray:
    """The greatest distance of two centroids at which a total of these parts is ``least`` or more; -1 if none, inf if any."""

    def holds(apart):
        spectral = np.maximum(0.0, 1.0 - apart / 2e3)
        return (3e-1 * h + 2.5e-1 * e + 2e-1 * d + 1.5e-1 * spectral + 1e-1 * g) * (5e-1 + 5e-1 * b) >= least

    shape = np.broadcast(h, e, d, g, b).shape
    low, high = np.zeros(shape, np.int64), np.full(shape, np.float64(2e3).view(np.int64))
    while (high - low > 1).any():  # doubles of one sign are ordered as their bits
        middle = low + (high - low) // 2
        good = holds(middle.view(np.float64))
        low, high = np.where(good, middle, low), np.where(good, high, middle)
    return np.where(holds(np.inf), np.inf, np.where(holds(0.0), low.view(np.float64), -1.0))


def within(values: np.ndarray, centre: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from and to which the sorted values are within a distance of each centre, as differences of doubles say."""
    n = len(values)
    low, high = np.searchsorted(values, centre - apart, "left"), np.searchsorted(values, centre + apart, "right")
    at = lambda i: values[np.clip(i, 0, n - 1)]
    while (more := (low > 0) & (centre - at(low - 1) <= apart)).any():
        low = low - more
    while (less := (low < n) & (centre - at(low) > apart)).any():
        low = low + less
    while (more := (high < n) & (at(high) - centre <= apart)).any():
        high = high + more
    while (less := (high > 0) & (at(high - 1) - centre > apart)).any():
        high = high - less
    return low, np.maximum(low, high)


def _kinds(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    x = column.fill_null(0.0).to_numpy()
    kind = np.select([column.is_null().to_numpy(), np.isnan(x), np.isposinf(x), np.isneginf(x)], [NULL, NAN, UP, DOWN], FINITE)
    return x, kind


class Counter:
    """Counts of the pairs of a table of tracks on the left and one on the right; ``parts`` has the levels of each part of the score."""

    def __init__(self, tempo: np.ndarray, b: np.ndarray, key: np.ndarray, genre: np.ndarray, edge: np.ndarray, d: np.ndarray):
        self.tempo, self.n_b = tempo, len(b)  # level of each two tempos, -1 if too far
        (h, self.key), (g, self.genre), (e, self.edge) = (np.unique(m, return_inverse=True) for m in (key, genre, edge))
        self.key, self.genre, self.edge = (x.reshape(m.shape) for x, m in ((self.key, key), (self.genre, genre), (self.edge, edge)))
        self.shape = (self.n_b, len(h), len(e), 2, genre.shape[1])
        # axes: bound, tempo, key, edge, drops, genre
        axes = [v.reshape([-1 if i == k else 1 for i in range(5)]) for k, v in enumerate((b, h, e, d, g))]
        self.cuts = np.stack([farthest(axes[1], axes[2], axes[3], axes[4], axes[0], least) for least in QUALITIES.values()])

    def cut(self, genre: int, late: int) -> np.ndarray:
        """The bounds' distances in each group of a left track: bound, group."""
        drops = np.arange(2) + late
        return self.cuts[:, :, :, :, drops[:, None], self.genre[genre][None, :]].reshape(len(QUALITIES), -1)

    def __call__(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        total = np.zeros(len(QUALITIES) + 1, np.int64)
        if not left.num_rows or not right.num_rows:
            return total
        take = lambda t, *names: [t.column(c).to_numpy() for c in names]
        x, key, genre, outro, late, n = take(left, "tempo", "key", "genre", "outro", "late", "n")
        y, key_r, genre_r, intro, early, n_r = take(right, "tempo_r", "key_r", "genre_r", "intro_r", "early_r", "n_r")
        (centre, kind), (value, kind_r) = _kinds(left.column("centroid")), _kinds(right.column("centroid_r"))
        values, place = np.unique(np.where(kind_r == FINITE, value, value[kind_r == FINITE][0] if (kind_r == FINITE).any() else 0.0), return_inverse=True)
        sizes = (self.key.shape[1], self.edge.shape[1], 2, self.genre.shape[1])
        codes = np.ravel_multi_index((key_r, intro, early, genre_r), sizes)
        held = centre[kind == FINITE]
        span = max(held.max() - values[0], values[-1] - held.min()) if len(held) else 0.0
        cuts, known = {(g, d): self.cut(g, d) for g, d in set(zip(genre.tolist(), late.tolist(), strict=True))}, {}
        limits = np.unique(np.concatenate([c[(c >= 0) & (c < span)] for c in cuts.values()]))  # those that part the rows here
        order = np.lexsort((late, genre, outro, key, x, centre))
        firsts = np.flatnonzero(np.diff(centre[order], prepend=np.nan) != 0)
        step = max(1, REACH // max(1, len(limits)))
        for run in np.split(order, firsts[step::step]):
            centres, spot = np.unique(np.where(kind[run] == FINITE, centre[run], held[0] if len(held) else 0.0), return_inverse=True)
            low, high = within(values, centres[None, :], limits[:, None]) if len(limits) else (None, None)
            for tempo in np.unique(x[run]):
                level = self.tempo[tempo][y].astype(np.int64)
                met = np.flatnonzero(level >= 0)
                if not len(met):
                    continue
                level, code, spots, weight, sort = level[met], codes[met], place[met], n_r[met], kind_r[met]
                own = np.flatnonzero(x[run] == tempo)
                own = own[np.lexsort((kind[run[own]], late[run[own]], genre[run[own]], outro[run[own]], key[run[own]]))]
                rows = run[own]
                both = key[rows] * sizes[1] * self.edge.shape[0] + outro[rows]
                for mine in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(both)) + 1):
                    k, o = int(key[rows[mine[0]]]), int(outro[rows[mine[0]]])
                    if (k, o) not in known:
                        kk, i, d, g = np.unravel_index(np.arange(np.prod(sizes)), sizes)
                        known[k, o] = np.ravel_multi_index((np.zeros(len(kk), int), self.key[k][kk], self.edge[o][i], d, g), self.shape)
                    group = level * int(np.prod(self.shape[1:])) + known[k, o][code]
                    total += self._unit(rows[mine], spot[own[mine]], genre, late, kind, n, group, sort, spots, weight, cuts, span, limits, low, high, len(values))
        return total

    def _unit(self, rows, spot, genre, late, kind, n, group, sort, spots, weight, cuts, span, limits, low, high, size) -> np.ndarray:
        """Counts of the left rows of one tempo, key and outro."""
        total, groups = np.zeros(len(QUALITIES) + 1, np.int64), int(np.prod(self.shape))
        sums = np.rint(np.bincount(sort * groups + group, weight, 5 * groups)).astype(np.int64).reshape(5, groups)
        present = np.flatnonzero(sums.sum(1))
        same = (genre[rows] * 2 + late[rows]) * 5 + kind[rows]
        parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(same)) + 1)
        parted = np.zeros(groups, bool)
        for p in parts:
            r = rows[p[0]]
            if kind[r] == FINITE:
                c = cuts[genre[r], late[r]]
                parted |= ((c >= 0) & (c < span)).any(0)
        parted &= sums[FINITE] > 0
        if parted.any():
            some = np.flatnonzero(parted[group] & (sort == FINITE))
            line = group[some] * size + spots[some]
            order = np.argsort(line)
            line, upto = line[order], np.concatenate(([0], np.cumsum(weight[some][order])))
        for p in parts:
            r = rows[p[0]]
            c, many = cuts[genre[r], late[r]], int(n[rows[p]].sum())
            total[-1] += many * int(sums.sum())
            for other in present:
                apart = _APART[kind[r], other]
                if kind[r] == other == FINITE:
                    apart = span
                    bound, at = np.nonzero((c >= 0) & (c < span) & parted)
                    if len(at):
                        which = np.searchsorted(limits, c[bound, at])[:, None]
                        base = at[:, None] * size
                        found = upto[np.searchsorted(line, base + high[which, spot[p]])] - upto[np.searchsorted(line, base + low[which, spot[p]])]
                        total[:-1] += np.rint(np.bincount(bound, found @ n[rows[p]], len(QUALITIES))).astype(np.int64)
                total[:-1] += many * ((c >= apart) * sums[other]).sum(1)
        return total


def _values(tracks: DataFrame, *columns: str) -> list:
    return sorted((tuple(r) for r in tracks.select(*columns).distinct().collect()), key=lambda r: tuple((v is not None, v) for v in r))


def counted(run: Callable[[str], DataFrame], parts: dict[str, str], total: str) -> DataFrame:
    """quality, pairs; ``run`` plans SQL, ``parts`` has the SQL of the score's parts for tracks a and b, ``total`` that of the whole."""
    ends = f"{parts['late'].replace('a.', '')} as late, {parts['early'].replace('b.', '')} as early"
    tracks = run(f"select bpm, num, letter, genre, intro, outro, {ends}, centroid from {{tracks}} t where bpm is not null")
    spark = tracks.sparkSession
    dims = {"tempo": ["bpm"], "key": ["num", "letter"], "genre": ["genre"], "outro": ["outro"], "intro": ["intro"]}
    held = {name: _values(tracks, *columns) for name, columns in dims.items()}
    kinds = dict(tracks.dtypes)
    listed = {name: spark.createDataFrame([(*v, i) for i, v in enumerate(held[name])], ", ".join(f"{c} {kinds[c]}" for c in columns) + f", {name}_code int") for name, columns in dims.items()}

    def matrix(a: str, b: str, text: str, where: str = "true") -> np.ndarray:
        """The value of ``text`` for each two values of two dimensions, nan where they don't meet."""
        both = listed[a].withColumnRenamed(f"{a}_code", "i").alias("a").crossJoin(F.broadcast(listed[b].withColumnRenamed(f"{b}_code", "j").alias("b")))
        found = both.filter(F.expr(where)).select("i", "j", F.expr(text).cast("double").alias("v")).toArrow()
        out = np.full((len(held[a]), len(held[b])), np.nan)
        out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
        return out

    tempo = matrix("tempo", "tempo", parts["B"], parts["near"])
    b, level = np.unique(tempo[~np.isnan(tempo)], return_inverse=True)
    levels = np.full(tempo.shape, -1, np.int8)
    levels[~np.isnan(tempo)] = level
    count = Counter(levels, b, matrix("key", "key", parts["H"]), matrix("genre", "genre", parts["G"]), matrix("outro", "intro", parts["E"]), 1.0 - 3e-1 * np.arange(3))

    coded = tracks
    for name, columns in dims.items():
        other = listed[name].select(*[F.col(c).alias(f"_{c}") for c in columns], F.col(f"{name}_code"))
        coded = coded.join(F.broadcast(other), reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])).drop(*[f"_{c}" for c in columns])
    coded = coded.select(*[F.col(f"{name}_code").alias(name) for name in dims], "late", "early", "centroid").withColumn("span", F.floor(F.col("tempo") / SPAN).cast("int"))
    rows = {r["span"]: r["n"] for r in coded.groupBy("span").agg(F.count(F.lit(1)).alias("n")).collect()}
    meets = sorted({(int(i) // SPAN, int(j) // SPAN) for i, j in np.argwhere(levels >= 0)})
    against = {s: sum(rows[q] for p, q in meets if p == s) for s in rows}
    deal = {s: (-(-rows[s] // LEFT), -(-against[s] // RIGHT)) for s in rows if against[s]}
    ours = spark.createDataFrame([(s, *d) for s, d in deal.items()], "span int, lefts int, rights int")
    theirs = spark.createDataFrame([(q, p, *deal[p]) for p, q in meets], "span int, own int, lefts int, rights int")
    # each part of a span on the left meets each part of all that is within 9 percent of any of its tempos
    part = lambda names, n: F.pmod(F.xxhash64(*names), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a_names, b_names = ["tempo", "key", "genre", "outro", "late", "centroid"], ["tempo", "key", "genre", "intro", "early", "centroid"]
    a = coded.groupBy("span", *a_names).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ours), "span")
    a = a.select(F.col("span").alias("own"), part(a_names, "lefts").alias("l"), every("rights").alias("r"), *a_names, "n")
    c = coded.groupBy("span", *b_names).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(theirs), "span")
    c = c.select(F.col("own").alias("own_r"), part(b_names, "rights").alias("r_r"), every("lefts").alias("l_r"), *[F.col(x).alias(f"{x}_r") for x in (*b_names, "n")])
    names = [f"at{k}" for k in range(len(QUALITIES))] + ["every"]
    found = a.groupBy("own", "l", "r").cogroup(c.groupBy("own_r", "l_r", "r_r")).applyInArrow(lambda x, y: pa.table({name: [int(v)] for name, v in zip(names, count(x, y), strict=True)}), _SUMS)
    # a track is no pair with itself
    fields = "id, bpm, num, letter, genre, intro, outro, duration, drop_at, centroid"
    one = f"(select {fields}, count(*) as n from {{tracks}} t where bpm is not null group by {fields})"
    bounds = [f"sum(case when total >= {round(least, 9)!r}D then n else 0 end) as {name}" for name, least in zip(names, (0.8, 0.6, 0.4), strict=False)]
    itself = run(f"select {', '.join(bounds)}, sum(n) as every from (select {total} as total, a.n * b.n as n from {one} a join {one} b on a.id = b.id) u")
    left = found.unionByName(itself.select(*[(-F.col(c)).alias(c) for c in names])).agg(*[F.sum(c).alias(c) for c in names])
    pairs = [F.col(c) - (F.col(names[k - 1]) if k else 0) for k, c in enumerate(names)]
    listing = F.explode(F.array(*[F.struct(F.lit(q).alias("quality"), p.alias("pairs")) for q, p in zip([*QUALITIES, "Poor"], pairs, strict=True)]))
    return left.select(listing.alias("p")).select("p.quality", "p.pairs").filter("pairs > 0")
