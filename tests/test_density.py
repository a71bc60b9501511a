"""Density clusters against plain pairs, with clumps whose distance is close to the radius."""

import random

from weftline.operators import clusters

EPS, LEAST = 0.1, 4


def plain(points):
    near = {i: [j for j, x, y in points if (x - a) ** 2 + (y - b) ** 2 <= EPS * EPS] for i, a, b in points}
    cores = {i for i in near if len(near[i]) >= LEAST}
    label = {i: i for i in cores}
    changed = True
    while changed:
        changed = False
        for i in cores:
            least = min(label[j] for j in near[i] if j in cores)
            if least < label[i]:
                label[i], changed = least, True
    return {i: (label.get(i) or min((label[j] for j in near[i] if j in cores), default=None), i in cores) for i in near}


def test_dense_clumps_equal_plain_pairs(spark):
    draw = random.Random(8)
    middles = [(0.0, 0.0), (0.12, 0.0), (0.31, 0.02), (0.5, 0.5), (0.62, 0.5), (0.9, 0.1)]
    points = [(f"p{k:03}", m[0] + draw.uniform(-0.02, 0.02), m[1] + draw.uniform(-0.02, 0.02)) for k, m in enumerate(middles * 40)]
    points += [(f"q{k}", draw.random(), draw.random()) for k in range(40)] + [("same1", 0.3, 0.8), ("same2", 0.3, 0.8), ("same3", 0.3, 0.8), ("same4", 0.3, 0.8)]
    found = clusters.density_clusters(spark.createDataFrame(points, "id string, x double, y double"), EPS, LEAST)
    assert {r.id: (r.cluster, r.is_core) for r in found.collect()} == plain(points)
