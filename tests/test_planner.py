"""Plans against a plain version that scores one track at a time."""

from aulos.operators import planner
from aulos.plans import catalog, planning
from tests.test_catalog import SF


def score(last, track, heard, liked):
    steps = abs(last.num - track.num)
    steps = min(steps, 12 - steps)
    if (last.num, last.letter) == (track.num, track.letter):
        key = 0.7
    elif steps == 0:
        key = 0.95
    elif steps == 1:
        key = 1.0 if last.letter == track.letter else 0.85
    elif steps == 2:
        key = 0.5 if last.letter == track.letter else 0.4
    else:
        key = 0.2
    artist = 0.0 if track.artist == last.artist else 0.5 if track.artist in heard else 1.0
    rating = track.rating / 5 if track.rating > 0 else 0.5
    gap = abs(track.bpm - last.bpm)
    tempo = 1.0 if gap <= 2 else 0.8 if gap <= 4 else 0.5 if gap <= 6 else 0.2
    return round(0.35 * key + 0.2 * artist + 0.15 * rating + 0.15 * tempo + 0.15 * liked.get(f"{track.num}{track.letter}", 0.5), 9)


def plain(tracks, request):
    tracks, plan, heard, used, last, clock = sorted(tracks, key=lambda t: t.id), [], set(), set(), None, 0
    for phase, low, high, share in planner.phase_ranges(request.dominant):
        left = request.minutes * 60 * share
        fits = [t for t in tracks if any(low <= t.bpm * x <= high for x in (1, 2, 0.5))]
        while left > 0 and [t for t in fits if t.id not in used]:
            rest = [t for t in fits if t.id not in used]
            track = max(rest, key=lambda t: (t.rating if last is None else score(last, t, heard, request.liked), -t.id))
            used.add(track.id), heard.add(track.artist)
            last, left = track, left - track.duration
            if clock < request.minutes * 60:
                plan.append((request.plan_id, len(plan) + 1, phase, track.id, float(clock)))
                clock += track.duration
    return plan


def test_plans_match_the_plain_version(spark):
    tracks = catalog.run_sql(spark, SF, "select * from {tracks} t").collect()
    requests = catalog.run_sql(spark, SF, planning.REQUESTS).collect()
    expected = sorted(row for r in requests for row in plain(tracks, r))
    assert len(expected) > 20
    assert sorted(tuple(r) for r in planning.generate_plan(spark, SF).collect()) == expected


def test_a_request_that_nothing_fits_gives_no_rows(spark):
    requests = spark.createDataFrame([(1, 60, 500.0, None)], "plan_id long, minutes int, dominant double, liked map<string,double>")
    assert planner.generate_plans(requests, catalog.run_sql(spark, SF, "select * from {tracks} t")).collect() == []
