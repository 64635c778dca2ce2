"""Exact segmentation, by one script a rule."""

import pytest

from wayloom.operators.trips import Segmenter

A = 41.9
SCRIPTS = {
    "first point": ([(0, 12.5, A, 0, 3), (60, 12.505, A, 1, 3), (120, 12.51, A, 1, 3), (180, 12.515, A, 2, 3)], [(0, [60, 120, 180], 1.2407)], [(0, "start", 0), (0, "stop", 180)]),
    "provisional kept": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (120, 12.51, A, 2, 3), (4000, 12.51, A, 0, 3), (4060, 12.515, A, 1, 3), (4120, 12.52, A, 1, 3)], [(0, [60, 120], 0.8271), (1, [3940, 4000, 4060, 4120], 0.8271)], [(0, "stop", 120), (0, "start", 4000)]),
    "gap of 1200 s": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (1260, 12.51, A, 1, 3), (1320, 12.515, A, 1, 3)], [(0, [60, 1260, 1320], 1.2407)], []),
    "provisional dropped": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (120, 12.51, A, 1, 3), (1400, 12.515, A, 1, 3), (2500, 12.52, A, 1, 3)], [(0, [60, 120], 0.8271), (1, [1400, 2500], 0.4136)], []),
    "jump": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (65, 12.6, A, 2, 3), (120, 12.51, A, 1, 3)], [(0, [60, 120], 0.8271)], [(0, "stop", 65)]),
    "low quality": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (120, 12.51, A, 2, 3), (130, 0, 0, 0, 1), (140, 0, 0, 1, 1), (200, 12.515, A, 1, 3)], [(0, [60, 120, 130, 200], 1.2407)], [(0, "stop", 120), (0, "start", 130)]),
    "stationary": ([(0, 12.5, A, 1, 3), (60, 12.505, A, 1, 3), (600, 12.5051, A, 1, 3), (1200, 12.5051, A, 1, 3), (1300, 12.5051, A, 1, 3), (1400, 12.51, A, 1, 3), (1500, 12.515, A, 1, 3)], [(0, [60, 600, 1200], 0.4218), (1, [1300, 1400, 1500], 0.8188)], []),
}


@pytest.mark.parametrize("name", sorted(SCRIPTS))
def test_script(name):
    points, trips, marks = SCRIPTS[name]
    got, events = Segmenter().run(iter(points))
    assert [(tid, [p[0] for p in own], round(km, 4)) for tid, own, km in got] == trips
    assert [e[:3] for e in events] == marks
