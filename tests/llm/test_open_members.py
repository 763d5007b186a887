"""Members of clusters whose leaders leave the answer open."""

import random

from siftworks.llm import jaccard_join as jj


def test_large_clusters_meet_by_lists_not_by_members(spark):
    draw = random.Random(5)
    size = {c: draw.randrange(50, 60) for c in range(40)}
    rows = []  # s, sig, n, pos, cluster, away
    for m in range(200):  # a large cluster: 12 lists of its own, three that it shares with the others
        rows += [(s, 1000 + m, 55, draw.randrange(0, 12), 0, 0 if m == 0 else draw.randrange(1, 6)) for s in range(15)]
    for c in range(1, 40):
        for m in range(3):
            rows += [(s, 5000 + 10 * c + m, size[c], draw.randrange(0, 12), c, 0 if m == 0 else draw.randrange(1, 6)) for s in (12 + c % 3, 100 + c)]
    unsure = [(0, c, draw.randrange(12, 30)) for c in range(1, 40)]
    of = spark.createDataFrame(rows, "s long, sig long, n int, pos int, cluster long, away long")
    pairs = spark.createDataFrame(unsure, "a long, b long, diff long")
    met = jj._meetings(of, pairs, 80)
    assert met.count() <= len(unsure)  # 39 * 3000 entries when every member met every open cluster
    got = {(r["a"], r["b"]) for r in jj._open_members(of, met, 80).collect()}

    want = set()
    for a, b, diff in unsure:
        for s, x, n, p, c, away in rows:
            for s2, y, n2, p2, c2, away2 in rows if c == a else ():
                if c2 == b and s == s2 and 100 * min(n, n2) >= 80 * max(n, n2) and 180 * min(n - p, n2 - p2) >= 80 * (n + n2):
                    if 180 * (diff - away - away2) <= 20 * (n + n2):
                        want.add((x, y))
    assert want and got == want
