"""Functions over one track's curve, in numpy: smoothing, events, tempo, beats, grids and structure.

Curves are float arrays in frame order; ``rate`` is frames a second. All functions take empty and very short curves.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-10


# ---- smoothing and shape ------------------------------------------------------------------------

def _mirrored(index: np.ndarray, n: int) -> np.ndarray:
    """Places outside 0..n-1 reflected about the edges, the edge value counted twice, as often as needed."""
    index = np.mod(index, 2 * n)
    return np.where(index < n, index, 2 * n - 1 - index)


def weighted(x: np.ndarray, weights: np.ndarray, left: int) -> np.ndarray:
    """sum of weights[k] * x[i - left + k], reflected at the edges."""
    n = len(x)
    if not n:
        return np.zeros(0)
    wide = x[_mirrored(np.arange(-left, n + len(weights) - left - 1), n)]
    return np.convolve(wide, weights[::-1], "valid")


def box(x: np.ndarray, size: int = 5) -> np.ndarray:
    return weighted(np.asarray(x, float), np.full(size, 1 / size), size // 2)


def gaussian(x: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return weighted(np.asarray(x, float), w / w.sum(), radius)


def savgol(x: np.ndarray, window: int = 11, order: int = 3) -> np.ndarray:
    """Least-squares polynomials over a sliding window; the half windows at the ends follow the end windows' polynomials."""
    x = np.asarray(x, float)
    window += 1 - window % 2
    if window <= order:
        window = order + 2 + (order + 2 + 1) % 2
    n, half = len(x), window // 2
    if n < window:
        return x.copy()
    t = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))  # coefficients from a window's values
    out = x.copy()
    out[half : n - half] = np.convolve(x, fit[0][::-1], "valid")
    ends = np.vander(t, order + 1, increasing=True) @ fit
    out[:half] = (ends @ x[:window])[:half]
    out[n - half :] = (ends @ x[-window:])[window - half :]
    return out


def delta(x: np.ndarray, width: int = 9) -> np.ndarray:
    """Regression slope against falling time (earlier minus later), edges held."""
    x, half = np.asarray(x, float), width // 2
    if not len(x):
        return x
    wide = np.pad(x, half, mode="edge")
    k = np.arange(-half, half + 1)
    return np.convolve(wide, k, "valid") / (k @ k) if half else np.zeros(len(x))


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Missing values by straight lines; edges held; zeros when all are missing."""
    x = np.asarray(x, float)
    known = np.flatnonzero(~np.isnan(x))
    return np.interp(np.arange(len(x)), known, x[known]) if len(known) else np.zeros(len(x))


def resample(x: np.ndarray, points: int) -> np.ndarray:
    """Straight-line values at ``points`` places, both ends kept."""
    x = np.asarray(x, float)
    return np.interp(np.linspace(0, max(len(x) - 1, 0), points), np.arange(len(x)), x) if len(x) else np.zeros(points)


def pad(x: np.ndarray, length: int) -> np.ndarray:
    return np.pad(np.asarray(x, float)[:length], (0, max(0, length - len(x))))


# ---- peaks and events ---------------------------------------------------------------------------

def maxima(x: np.ndarray) -> np.ndarray:
    """Middles of all runs of equal values that are higher than both neighbours."""
    if len(x) < 3:
        return np.zeros(0, int)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:] - 1, len(x) - 1)
    value = x[first]
    top = np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:])) + 1
    return (first[top] + last[top]) // 2


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height of each peak above the higher of the lowest points towards the next higher ground on either side."""
    out = np.zeros(len(at))
    for k, i in enumerate(at.tolist()):
        higher = np.flatnonzero(x > x[i])
        a = higher[higher < i]
        b = higher[higher > i]
        low, high = (a[-1] if len(a) else 0), (b[0] if len(b) else len(x) - 1)
        out[k] = x[i] - max(x[low : i + 1].min(), x[i : high + 1].min())
    return out


def peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None, percentile: float = 75) -> np.ndarray:
    """Peaks of at least ``height``, the taller ones first keeping others at bay for ``distance`` frames."""
    x = np.asarray(x, float)
    at = maxima(x)
    if not len(x):
        return at
    at = at[x[at] >= (np.percentile(x, percentile) if height is None else height)]
    distance = max(1, len(x) // 100) if distance is None else distance
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for j in np.argsort(x[at], kind="stable")[::-1].tolist():
            if keep[j]:
                near = np.abs(at - at[j]) < distance
                near[j] = False
                keep &= ~near
        at = at[keep]
    return at if prominence is None else at[prominences(x, at) >= prominence]


def valleys(x: np.ndarray, depth: float | None = None, distance: int | None = None, percentile: float = 25) -> np.ndarray:
    x = np.asarray(x, float)
    return peaks(-x, -(np.percentile(x, percentile) if depth is None and len(x) else depth or 0.0), distance)


def buildup(x: np.ndarray, window: int = 20, smooth: bool = True) -> np.ndarray:
    """Rising slope over the trailing window (its first value held before the start), as a share of the largest."""
    x = np.asarray(x, float)
    if len(x) < window:
        return np.zeros(len(x))
    t = np.arange(window) - (window - 1) / 2
    slope = np.convolve(np.pad(x, (window - 1, 0), mode="edge"), t[::-1], "valid") / (t @ t + EPS)
    rising = np.maximum(slope, 0)
    rising = box(rising, 5) if smooth else rising
    return rising / rising.max() if rising.max() > 0 else rising


def drops(x: np.ndarray, rate: float, window: int = 20, least: float = 0.3, sure: float = 0.5, recovery: int = 10) -> list[dict]:
    """Sudden sustained rises after a build-up, the surest of each two seconds."""
    x = np.asarray(x, float)
    n = len(x)
    if not n:
        return []
    smooth = box(x, 11)
    step = np.diff(smooth, prepend=smooth[0])
    high = np.percentile(step[step > 0], 90) if (step > 0).any() else 0.0
    at = np.flatnonzero(step > high)
    at = at[at >= window]
    if not len(at):
        return []
    build, size = buildup(x, window), step[at] / (x.mean() + EPS)
    # window means from inclusive sums, hence one frame later than their names say (kept on purpose)
    sums = np.cumsum(np.pad(x, 10, mode="edge"))
    mid = at + 10
    end = np.minimum(mid + 10, n + 19)
    before, after = (sums[mid] - sums[mid - 10]) / 10, (sums[end] - sums[mid]) / np.maximum(end - mid, 1)
    held = np.where(at + 10 < n, after > before * 1.1, True)
    trust = 0.4 * build[at] + 0.4 * np.minimum(size, 1) + 0.2 * held
    ok = (size >= least) & (trust >= sure)
    at, size, trust = at[ok], size[ok], trust[ok]
    gap, out = int(2.0 * rate), []
    for i, f in enumerate(at.tolist()):
        near = (np.abs(at - f) < gap) & (at != f)
        if (trust[near] > trust[i]).any():
            continue
        part = build[max(0, f - 2 * window) : f]
        above = part > (0.3 * part.max() if len(part) and part.max() > 0 else 0.0)
        length = len(part) - int(above.argmax()) if above.any() else window
        back = (x[f : f + recovery].max() - x[f]) / (recovery / rate) if f + recovery < n else 0.0
        out.append({"frame_idx": f, "time_sec": f / rate, "buildup_score": build[f], "magnitude": size[i], "confidence": trust[i], "buildup_duration": length / rate, "recovery_rate": back})
    return out


def drop_intensity(found: list[dict]) -> float:
    trust = sum(d["confidence"] for d in found)
    return min(1.0, sum(d["magnitude"] * d["confidence"] for d in found) / trust * (1 - np.exp(-len(found) / 3))) if trust else 0.0


def transitions(x: np.ndarray, factor: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(rises, falls) of the smoothed curve beyond ``factor`` deviations of its slope."""
    if not len(x):
        return np.zeros(0, int), np.zeros(0, int)
    smooth = box(x, 21)
    slope = box(np.diff(smooth, prepend=smooth[0]), 11)
    high = factor * slope.std()
    return peaks(slope, high), valleys(slope, -high)


def velocity(x: np.ndarray, rate: float) -> np.ndarray:
    return np.gradient(np.asarray(x, float)) * rate if len(x) > 1 else np.zeros(len(x))


def unit(x: np.ndarray) -> np.ndarray:
    return (x - x.min()) / (x.max() - x.min() + EPS) if len(x) else x


def filter_position(centroid: np.ndarray, rolloff: np.ndarray) -> np.ndarray:
    return 0.6 * unit(centroid) + 0.4 * unit(rolloff)


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask without its runs shorter than ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0]))))
    out = np.zeros(len(mask), bool)
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        out[a:b] = b - a >= least
    return out


def sweeps(speed: np.ndarray, rate: float, threshold: float = 500.0, seconds: float = 0.5) -> np.ndarray:
    return long_runs(np.abs(speed) > threshold, max(1, int(seconds * rate)))


# ---- tempo and beats ----------------------------------------------------------------------------

def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    n = len(x)
    size = 1 << max(1, (2 * n - 1).bit_length())
    power = np.abs(np.fft.rfft(x, size)) ** 2
    return np.fft.irfft(power, size)[: min(lags, n)] / max(n, 1)


def tempo(x: np.ndarray, rate: float, start: float = 120.0, spread: float = 1.0, weight: float = 1.0, seconds: float = 8.0, fastest: float = 200.0) -> tuple[float, float]:
    """(beats a minute, confidence): the best lag under a bell-shaped preference for ``start``."""
    ac = autocorrelation(np.asarray(x, float), int(seconds * rate))
    low, high = int(60 * rate / fastest), min(len(ac) - 1, int(60 * rate / 30))
    if high <= low:
        return start, 0.0
    bpm = 60 * rate / np.maximum(np.arange(low, high), EPS)
    liked = ac[low:high] * np.exp(-0.5 * ((bpm - start) / spread) ** 2) ** weight
    best = int(liked.argmax())
    return float(bpm[best]), min(2 * float(liked[best] / liked.sum()), 1.0) if liked[best] > 0 else 0.0


#: Start, spread and weight of the three preferences.
PREFERENCES = ((120, 50, 0.5), (128, 20, 1.0), (170, 30, 0.8))


def tempo_multi(x: np.ndarray, rate: float) -> tuple[float, float, float]:
    """(tempo, confidence, deviation) over three preferences, weighted by their confidences."""
    bpm, sure = np.array([tempo(x, rate, s, d, w) for s, d, w in PREFERENCES]).T
    spread = float(bpm.std())
    return float(bpm @ sure / (sure.sum() + EPS)), float(sure.max()) * (0.5 if spread > 10 else 1.0), spread


def beats(x: np.ndarray, rate: float, start: float = 120.0) -> np.ndarray:
    """Frames of the beats: peaks at least 0.7 periods apart, else an even grid."""
    period = 60 * rate / tempo(x, rate, start)[0]
    found = peaks(x, -np.inf, max(1, int(0.7 * period)))
    return found if len(found) else np.round(np.arange(int(len(x) / period)) * period).astype(int)


def downbeat(x: np.ndarray, at: np.ndarray, bar: int = 4) -> int:
    """The offset whose beats stand out most from all the others."""
    strength = np.asarray(x, float)[at[at < len(x)]]
    if len(strength) < 8:
        return 0
    own = np.arange(len(strength)) % bar
    contrast = [strength[own == o].mean() - strength[own != o].mean() if (own == o).sum() >= 2 else -np.inf for o in range(bar)]
    return int(np.argmax(contrast))


def beat_grid(x: np.ndarray, rate: float, bar: int = 4, phrase: int = 4) -> dict:
    """tempo, confidence, downbeat, beats (frame, time, places), bars and phrases (start, end); only full ones."""
    bpm, sure, _ = tempo_multi(x, rate)
    at = beats(x, rate, bpm)
    off, time = downbeat(x, at, bar), at / rate
    place = np.arange(len(at)) - off
    edges = np.append(time, time[-1] + 60 / bpm) if len(at) else time  # the end of the last beat
    first = off + bar * np.arange(max(0, (len(at) - off) // bar))
    bars = np.stack([edges[first], edges[first + bar]], 1) if len(first) else np.zeros((0, 2))
    whole = len(bars) // phrase * phrase
    phrases = np.stack([bars[:whole:phrase, 0], bars[phrase - 1 : whole : phrase, 1]], 1)
    return {"tempo": bpm, "confidence": sure, "downbeat": off, "frames": at, "times": time, "bar_position": place % bar + 1,
            "phrase_position": place % (bar * phrase) + 1, "bars": bars, "phrases": phrases}


def local_tempo(x: np.ndarray, rate: float, low: float = 60.0, high: float = 200.0, prior: float = 128.0, weight: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(tempo, strength) of each frame from eight-second windows that advance by a quarter."""
    n, window = len(x), int(8 * rate)
    half, step = window // 2, max(1, window // 4)
    bpm, sure = np.full(n, prior), np.zeros(n)
    if n < 10 or n <= 2 * half or not half:
        return bpm, sure
    for mid in range(half, n - half, step):
        found, trust = tempo(x[mid - half : mid + half], rate, prior, 30, weight)
        if low <= found <= high:
            a, b = max(0, mid - step // 2), min(n, mid + step // 2)
            bpm[a:b], sure[a:b] = found, trust
    for curve in (bpm, sure):
        curve[:half], curve[-half:] = curve[half], curve[-half - 1]
    return bpm, sure


def tempo_segments(bpm: np.ndarray, sure: np.ndarray, rate: float, least: float = 30.0, change: float = 5.0, seconds: float = 5.0) -> list[tuple]:
    """(start, end, mean, deviation, confidence) of stretches between tempo changes; short ones join the one before."""
    n = len(bpm)
    if n < 10:
        return [(0.0, (n - 1) / rate if n else 0.0, float(np.mean(bpm)) if n else 120.0, 0.0, 1.0)]
    width = max(1, int(seconds * rate))
    smooth = np.convolve(bpm, np.full(width, 1 / width), "same")[:n] if width > 1 else bpm
    jump = np.flatnonzero(np.abs(np.diff(smooth, prepend=smooth[0])) > change)
    jump = jump[jump > 0]
    jump = jump[np.diff(jump, prepend=0) >= max(1, int(least * rate))]
    cuts = np.unique(np.concatenate(([0], jump, [n - 1])))
    out: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = (a / rate, b / rate, float(smooth[a:b].mean()), float(smooth[a:b].std()), float(sure[a:b].mean()))
        if out and part[1] - part[0] < least:
            was = out[-1]
            part = (was[0], part[1], (was[2] + part[2]) / 2, max(was[3], part[3]), (was[4] + part[4]) / 2)
            out[-1] = part
        else:
            out.append(part)
    return out


def event_offsets(times: np.ndarray, period: float, first: float = 0.0) -> np.ndarray:
    """Signed distance of each event to the nearest multiple of the period."""
    away = np.asarray(times, float) - first
    return away - np.round(away / period) * period


def aligned_share(times: np.ndarray, edges: np.ndarray, tolerance: float) -> float:
    if not len(times):
        return 1.0
    return float((np.abs(np.asarray(times)[:, None] - edges).min(1) <= tolerance).mean()) if len(edges) else 0.0


def calibrate(times: np.ndarray, grid: dict, tolerance_beats: float = 2.0, least: int = 2) -> dict:
    """The shift that brings events onto phrase starts, with the share on them before and after and a confidence."""
    if len(times) < least:
        return {"shift": 0.0, "before": 0.0, "after": 0.0, "confidence": 0.0}
    beat, phrases = 60 / grid["tempo"], grid["phrases"]
    edges = np.append(phrases[:, 0], phrases[-1:, 1])
    off = event_offsets(times, 16 * beat, phrases[0, 0] if len(phrases) else 0.0)
    shift = -float(np.median(off))
    before, after = aligned_share(times, edges, tolerance_beats * beat), aligned_share(np.asarray(times) + shift, edges, tolerance_beats * beat)
    sure = 0.3 * min(1.0, len(times) / 5) + 0.4 * max(0.0, 1 - float(np.std(off)) / beat) + 0.3 * (after - before + 0.5)
    return {"shift": shift, "before": before, "after": after, "confidence": min(max(sure, 0.0), 1.0)}


# ---- structure ----------------------------------------------------------------------------------

def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), EPS)


def cosine_distance(rows: np.ndarray) -> np.ndarray:
    return 1 - unit_rows(rows) @ unit_rows(rows).T


def recurrence(rows: np.ndarray, width: int = 3, mode: str = "affinity") -> np.ndarray:
    """Likeness of every two frames further apart than ``width``; modes distance, connectivity, affinity."""
    d, n = cosine_distance(rows), len(rows)
    far = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) > width
    middle = float(np.median(d[far])) if far.any() else None
    if mode == "distance":
        out = d
    elif mode == "connectivity":
        out = (d < (np.inf if middle is None else middle)).astype(float)
    else:
        out = np.exp(-(d**2) / (2 * (1.0 if middle is None else middle + EPS) ** 2))
    out = np.where(far, out, 0.0)
    return (out + out.T) / 2


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    n = len(x)
    wide = x[_mirrored(np.arange(-(size // 2), n + size - size // 2 - 1), n)]
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, size), axis=-1)


def enhance_diagonals(r: np.ndarray, size: int = 7) -> np.ndarray:
    """A running median along each diagonal that is long enough."""
    out, n = np.zeros_like(r), len(r)
    for k in range(1 - n, n):
        line = np.diagonal(r, k)
        i = np.arange(len(line)) + max(0, -k)
        out[i, i + k] = running_median(line, size) if len(line) >= size else line
    return out


def combine(r: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Both matrices blended so that their degrees balance."""
    a, b = path.sum(1), r.sum(1)
    share = a @ (a + b) / (((a + b) ** 2).sum() + EPS)
    return share * r + (1 - share) * path


def laplacian_embedding(a: np.ndarray, k: int = 10, size: int = 9) -> np.ndarray:
    """The first ``k`` eigenvectors of the normalised Laplacian, smoothed over time and scaled row by row."""
    a = a - np.diag(np.diag(a))
    degree = a.sum(1)
    scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, EPS)), 0.0)
    lap = np.diag((degree > 0).astype(float)) - scale[:, None] * a * scale
    _, vectors = np.linalg.eigh(lap)
    return smooth_embedding(vectors[:, : max(1, min(k, len(a) - 2))], size)


def median_of(parts, total: int, few: int = 1 << 20) -> float:
    """The exact median of ``total`` doubles that each call of ``parts`` gives again in arrays, of which only ``few`` are ever held.

    Doubles are ordered as their bits, of which sixteen are counted at a time until ``few`` values share those of the middle rank.
    """

    def keys(x: np.ndarray) -> np.ndarray:
        bits = np.ascontiguousarray(x).view(np.int64)
        return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))

    def ranked(rank: int) -> tuple[np.ndarray, int]:
        """Sorted values that hold the rank, from 0, and the rank within them."""
        start, shift, left = -(1 << 15), 48, total
        while True:
            counts = np.zeros(1 << 16, np.int64)
            for x in parts():
                place = (keys(x) >> shift) - start
                counts += np.bincount(place[(place >= 0) & (place < 1 << 16)], minlength=1 << 16)
            upto = np.cumsum(counts)
            at = int(np.searchsorted(upto, rank, "right"))
            rank, left, found = rank - int(upto[at] - counts[at]), int(counts[at]), start + at
            if left <= few or shift == 0:
                break
            start, shift = found << 16, shift - 16
        if shift == 0 and left > few:  # all of them are one value
            return next(x[keys(x) == found][:1] for x in parts() if (keys(x) == found).any()).repeat(min(left, 2)), min(rank, 0 if left > rank + 1 else 1)
        return np.sort(np.concatenate([x[keys(x) >> shift == found] for x in parts()])), rank

    held, at = ranked((total - 1) // 2)
    if total % 2:
        return float(held[at])
    after = held[at + 1] if at + 1 < len(held) else (lambda h, k: h[k])(*ranked(total // 2))
    return float((held[at] + after) / 2)


def leading_vectors(product, n: int, k: int, width: int = 3) -> np.ndarray:
    """The eigenvectors (rows) of the ``k`` greatest eigenvalues of a symmetric matrix of ``n`` rows, of which only the product with some columns is needed.

    Lanczos steps of a block of columns, all fully reorthogonalised; a block sees a repeated value as often as it has columns, ``k`` at least.
    """
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((n, min(max(width, k), n))))[0]
    size, check = block.shape[1], 48
    basis, within = [block], np.zeros((size, size))

    def apart(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for q in basis:
                w = w - q @ (q.T @ w)
        return w

    while True:
        own = slice(size - block.shape[1], size)
        w = product(block)
        within[own, own] = block.T @ w
        rest, lengths, mixed = np.linalg.svd(apart(w), full_matrices=False)
        held = (lengths > 1e-12) & (np.arange(len(lengths)) < n - size)
        left = lengths[held, None] * mixed[held]
        if not held.any() or size >= check:
            check = size + max(2 * width, size // 8)
            values, mixes = np.linalg.eigh(within)
            values, mixes, most = values[::-1], mixes[:, ::-1], min(k, size)
            off = np.linalg.norm(left @ mixes[own, :most], axis=0)
            gaps = np.abs(values[:most, None] - values)
            near = np.where(gaps > 1e-10, gaps, np.inf).min(1)
            # a vector is off by what is left over its gap; below the rounding of the values nothing gets better
            if not held.any() or (off <= np.maximum(1e-8 * np.minimum(near, 1.0), 1e-15)).all():
                ends = np.cumsum([q.shape[1] for q in basis])
                return sum(q @ mixes[end - q.shape[1] : end, :most] for q, end in zip(basis, ends)).T
        # short columns lose their right angles when they are made longer
        block, turned = np.linalg.qr(rest[:, held] if lengths[held].min() > 1e-4 else apart(rest[:, held]))
        basis.append(block)
        within = np.pad(within, (0, block.shape[1]))
        within[size:, own] = turned @ left
        within[own, size:] = within[size:, own].T
        size = len(within)


def smooth_embedding(vectors: np.ndarray, size: int = 9) -> np.ndarray:
    """Eigenvectors (columns) smoothed over time and scaled row by row."""
    vectors = np.stack([running_median(v, size) for v in vectors.T], 1)
    return vectors / (np.sqrt((vectors**2).sum(1, keepdims=True)) + EPS)


def ssm_novelty(rows: np.ndarray, rate: float, seconds: float = 30.0, every: int = 4, most: int = 5000) -> np.ndarray:
    """Checkerboard novelty along the self-similarity's diagonal; only the band under the kernel is ever made."""
    n = len(rows)
    if n // every > most:
        every = max(every, n // most)
    part = rows[::every]
    m, out = len(part), np.zeros(n)
    if m < 20:
        return out
    unit_rows = part / (np.linalg.norm(part, axis=1, keepdims=True) + EPS)
    half = max(10, min(int(seconds * rate / every), m // 4)) // 2
    t = np.arange(-half, half)
    taper = np.exp(-(t**2) / (2 * (half / 2) ** 2)) * np.where(t < 0, 1.0, -1.0)
    found = np.zeros(m)
    # the signed, tapered kernel is an outer product, so a patch's sum is the squared norm of a weighted sum of rows
    for i in range(half, m - half + 1):
        if i < m:
            found[i] = np.sum((taper @ unit_rows[i - half : i + half]) ** 2)
    top = np.abs(found).max()
    return np.interp(np.arange(n), np.arange(m) * every, np.abs(found) / top if top > 0 else found)
