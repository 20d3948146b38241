"""Plans that fill a length of time with tracks, phase by phase, each next track the best successor.

The choice of a track depends on all before it, so one plan is one task; its input is only the tracks
whose tempo (or half or double of it) lies in one of its phases, found by an equality join on whole BPM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phase, BPM from (base, offset), BPM to (base, offset), share of the time.
PHASES = [
    ("opening", ("low", -6), ("low", 4), 0.15),
    ("build", ("low", 0), ("high", -4), 0.30),
    ("peak", ("high", -6), ("high", 4), 0.40),
    ("closing", ("low", -4), ("high", -4), 0.15),
]
#: BPM range without a dominant tempo, and the distances from one.
DEFAULT_RANGE, AROUND = (122.0, 135.0), (-8.0, 6.0)
#: Weights of key, artist, rating, tempo and preferred key.
WEIGHTS = (0.35, 0.20, 0.15, 0.15, 0.15)
#: Score of 0, 1, 2, 3 or more steps on the wheel of keys, in the same and in the other mode.
SAME_MODE, OTHER_MODE = (0.7, 1.0, 0.5, 0.2), (0.95, 0.85, 0.4, 0.2)
#: Score of a BPM difference up to each bound; beyond.
BPM_BOUNDS, BPM_SCORES = (2.0, 4.0, 6.0), (1.0, 0.8, 0.5, 0.2)
TRACK = ("id", "bpm", "num", "letter", "artist", "rating", "duration")


def phase_ranges(dominant: float | None) -> list[tuple[str, float, float, float]]:
    """(phase, lowest BPM, highest BPM, share)."""
    low, high = DEFAULT_RANGE if dominant is None or np.isnan(dominant) else (int(dominant) + AROUND[0], int(dominant) + AROUND[1])
    base = {"low": low, "high": high}
    return [(name, base[a] + da, base[b] + db, share) for name, (a, da), (b, db), share in PHASES]


def key_score(num, letter, other_num, other_letter):
    """How well a key follows another: a neighbour is best, staying is fair."""
    apart = np.abs(num - other_num)
    steps = np.minimum(np.minimum(apart, 12 - apart), 3)
    return np.where(letter == other_letter, np.array(SAME_MODE)[steps], np.array(OTHER_MODE)[steps])


class _Pool:
    """The candidates of one plan as columns."""

    def __init__(self, tracks: pd.DataFrame):
        tracks = tracks.sort_values("id", ignore_index=True)
        for name in TRACK:
            setattr(self, name, tracks[name].to_numpy())
        self.liked = tracks["liked"].to_numpy(float)
        self.free = np.ones(len(tracks), bool)
        self.heard = np.zeros(len(tracks), bool)

    def in_range(self, low: float, high: float) -> np.ndarray:
        return (self.bpm > 0) & np.any([(self.bpm * x >= low) & (self.bpm * x <= high) for x in (1.0, 2.0, 0.5)], axis=0)

    def scores(self, last: int) -> np.ndarray:
        key = key_score(self.num[last], self.letter[last], self.num, self.letter)
        artist = np.where(self.artist == self.artist[last], 0.0, np.where(self.heard, 0.5, 1.0))
        rating = np.where(self.rating > 0, self.rating / 5.0, 0.5)
        tempo = np.array(BPM_SCORES)[np.searchsorted(BPM_BOUNDS, np.abs(self.bpm - self.bpm[last]))]
        return sum(w * part for w, part in zip(WEIGHTS, (key, artist, rating, tempo, self.liked)))

    def take(self, at: int) -> int:
        self.free[at] = False
        self.heard |= self.artist == self.artist[at]
        return at


def fill(tracks: pd.DataFrame, minutes: float, dominant: float | None, top_n: int = 1, seed: int = 0) -> list[tuple[int, str, float]]:
    """(row of the tracks by id, phase, start in seconds); ``top_n`` above 1 draws among the best by score."""
    pool, plan, clock, rng, total = _Pool(tracks), [], 0.0, np.random.default_rng(seed), minutes * 60
    last = None
    for phase, low, high, share in phase_ranges(dominant):
        fits, budget = pool.in_range(low, high), total * share
        while budget > 0 and (fits & pool.free).any():
            rest = np.flatnonzero(fits & pool.free)
            if last is None:
                pick = rest[np.argmax(pool.rating[rest])]
            else:
                score = pool.scores(last)[rest].round(9)
                best = np.argsort(-score, kind="stable")[:top_n]
                pick = rest[best[0] if len(best) == 1 else rng.choice(best, p=score[best] / score[best].sum())]
            last = pool.take(pick)
            budget -= pool.duration[pick]
            if clock < total:
                plan.append((int(pick), phase, clock))
                clock += float(pool.duration[pick])
    return plan


def generate_plans(requests: DataFrame, tracks: DataFrame, top_n: int = 1) -> DataFrame:
    """plan_id, position, phase, id, start_sec for requests (plan_id, minutes, dominant, liked map<string,double>).

    ``dominant`` may be null; ``liked`` maps keys like '8A' to 0..1, other keys count 0.5. Requests
    that no track fits give no rows. Ties go to the smallest id, so reruns agree.
    """
    low, high = (F.coalesce(F.col("dominant").cast("int") + AROUND[i], F.lit(DEFAULT_RANGE[i])) for i in (0, 1))
    wide = requests.select("plan_id", "minutes", F.col("dominant").cast("double").alias("dominant"), "liked", (low - 6).alias("low"), (high + 4).alias("high"))
    whole = F.array_distinct(F.flatten(F.array(*[F.sequence(F.floor(F.col("low") * x), F.floor(F.col("high") * x)) for x in (1.0, 0.5, 2.0)])))
    library = tracks.select(*TRACK).withColumn("at", F.floor("bpm"))
    key = F.concat(F.col("num").cast("string"), F.col("letter"))
    fitting = wide.withColumn("at", F.explode(whole)).join(library, "at").withColumn("liked", F.coalesce(F.col("liked")[key], F.lit(0.5)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        found = fill(rows, float(first["minutes"]), first["dominant"], top_n, int(first["plan_id"]))
        ids = rows["id"].sort_values().to_numpy()
        return pd.DataFrame({"plan_id": first["plan_id"], "position": range(1, len(found) + 1), "phase": [p for _, p, _ in found], "id": [ids[i] for i, _, _ in found], "start_sec": [s for _, _, s in found]})

    return fitting.groupBy("plan_id").applyInPandas(run, "plan_id long, position long, phase string, id long, start_sec double")
