import random
from collections import Counter, defaultdict

import pytest

from emberline.operators.chains import joined

SCHEMA = "u long, v long, key int, length double, highway array<string>, oneway boolean, maxspeed string, lanes string, width string, bridge string, tunnel string, junction string, osmid array<long>, geometry array<struct<x:double,y:double>>"


def rows_of(pairs):
    return [(u, v, 0, float(i + 1), ["ab"[i % 2]], False, None if i % 3 else f"{i} mph", None, None, None, None, "roundabout" if i == 1 else None, [i], [(float(u), 0.0), (u + 0.5, i + 1.0), (float(v), 0.0)]) for i, (u, v) in enumerate(pairs)]


def walked(pairs):
    """Lists of edge numbers, walked one by one from each edge that starts at a junction; rings edge by edge."""
    outs, ins = defaultdict(list), defaultdict(list)
    for i, (u, v) in enumerate(pairs):
        outs[u].append(i)
        ins[v].append(i)
    nodes = {n for p in pairs for n in p}
    passing = set()
    for n in nodes:
        to, of = [pairs[i][1] for i in outs[n]], [pairs[i][0] for i in ins[n]]
        if n not in to and len({*to, *of}) == 2 and len(to) == len(of) and max(Counter(to).values()) == max(Counter(of).values()) == 1:
            passing.add(n)
    out, seen = [], set()
    for i, (u, _) in enumerate(pairs):
        if u not in passing:
            chain = [i]
            while pairs[chain[-1]][1] in passing:
                at, before = pairs[chain[-1]][1], pairs[chain[-1]][0]
                chain.append(next(j for j in outs[at] if pairs[j][1] != before))
            out.append(chain)
            seen.update(chain)
    return out + [[i] for i in range(len(pairs)) if i not in seen]


def graphs():
    line = [(i, i + 1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    both_ways_ring = [p for i in range(5) for p in ((200 + i, 200 + (i + 1) % 5), (200 + (i + 1) % 5, 200 + i))]
    lasso = [(300, 301), (301, 302), (302, 303), (303, 301), (301, 300)]
    odd = [(400, 401), (400, 401), (401, 402), (402, 402), (402, 403), (403, 404), (404, 403), (404, 405)]
    rng = random.Random(5)
    grid = []
    for n in range(144):
        for m in ([n + 1] if n % 12 < 11 else []) + ([n + 12] if n < 132 else []):
            if rng.random() < 0.55:
                grid += [[(n, m), (m, n)], [(n, m)], [(m, n)], [(n, m), (m, n)]][rng.randrange(4)]
    return [line + ring + both_ways_ring + lasso + odd, grid]


@pytest.mark.parametrize("pairs", graphs())
def test_chains_equal_a_walk(spark, pairs):
    rows = rows_of(pairs)
    got = {tuple(r.osmid): r for r in joined(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = walked(pairs)
    assert sorted(got) == sorted(map(tuple, want)) and max(map(len, want)) > 3
    for chain in want:
        r, own = got[tuple(chain)], [rows[i] for i in chain]
        assert (r.u, r.v, r.n_parts) == (pairs[chain[0]][0], pairs[chain[-1]][1], len(chain))
        assert r.length == pytest.approx(sum(x[3] for x in own))
        line = [p for i, x in enumerate(own) for p in x[13][bool(i) :]]
        assert [tuple(p) for p in r.geometry] == line
        assert r.highway == list(dict.fromkeys(x[4][0] for x in own))
        assert r.maxspeed == (";".join(x[6] for x in own if x[6]) or None) and r.lanes is None
        assert r.junction == ("roundabout" if 1 in chain else None)
    assert all(Counter((r.u, r.v, r.key) for r in got.values()).values())
    assert len({(r.u, r.v, r.key) for r in got.values()}) == len(got)


def test_no_edges(spark):
    assert joined(spark.createDataFrame([], SCHEMA)).count() == 0
