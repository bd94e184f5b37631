import pytest

from wayweave.operators import mining, network, sketches as sk, stitching
from wayweave.plans import reports

EDGES = [(3, 1, 2), (4, 2, 3), (5, 3, 4), (6, 2, 2), (7, 2, 1)]
SEEN = {3: range(1, 9), 4: [*range(1, 7), 9], 5: [1, 2, 3, 4, 10], 6: range(1, 7), 7: [9, 10]}


@pytest.fixture(scope="module")
def m1(spark):
    edges = spark.createDataFrame(EDGES, "edge_id long, src long, dst long")
    seen = spark.createDataFrame([(e, o) for e, os in SEEN.items() for o in os], "edge_id long, obj_id long")
    regions = edges.selectExpr("edge_id", "10 as region_id")
    return edges, seen, regions


def _brute(edges, seen, n, t, levels):
    follow = {a[0]: [b[0] for b in edges if b[1] == a[2]] for a in edges}
    hot = {e: set(o) for e, o in seen.items() if len(set(o)) / n >= t}
    found, level = {}, {(e,): o for e, o in hot.items()}
    for i in range(1, levels + 1):
        found |= {p: len(o) for p, o in level.items()}
        level = {p + (s,): o & hot[s] for p, o in level.items() for s in follow[p[-1]] if s in hot and (s == p[-1] or s not in p) and len(o & hot[s]) / n >= t}
    return found


def test_mining_matches_hand_computed(m1):
    edges, seen, regions = m1
    conn = network.connections(edges)
    got = mining.mine(seen, regions, conn, 0.4, 3).paths
    rows = {tuple(r.path): r.support for r in got.collect()}
    assert rows == _brute(EDGES, SEEN, 10, 0.4, 3)
    assert {p: s for p, s in rows.items() if len(p) == 2} == {(3, 4): 6, (3, 6): 6, (4, 5): 4, (6, 4): 6, (6, 6): 6}
    assert {len(r.path) for r in mining.maximal(got).collect()} == {3}


def test_support_falls_with_length_and_subpaths_are_paths(m1):
    edges, seen, regions = m1
    rows = {tuple(r.path): r.support for r in mining.mine(seen, regions, network.connections(edges), 0.2, 4).paths.collect()}
    for p, s in rows.items():
        if len(p) > 1:
            assert rows[p[:-1]] >= s and rows[p[1:]] >= s


def test_connections_compat_leaves_out_first_edge(m1):
    edges, *_ = m1
    assert {(r.edge_id, r.succ_id) for r in network.connections(edges).collect()} == {(3, 4), (3, 6), (3, 7), (4, 5), (6, 4), (6, 6), (6, 7), (7, 3)}
    assert not network.connections(edges, True).where("succ_id = 3").collect()


def test_threshold_is_validated(m1):
    with pytest.raises(ValueError):
        mining.hot_edges(m1[1], m1[2], 0.01)


def test_empty_sightings(m1, spark):
    edges, seen, regions = m1
    assert mining.mine(seen.limit(0), regions, network.connections(edges), 0.4, 3).paths.count() == 0


def test_stitch_partial_span(spark):
    seen = {3: [1, 2, 3, 4, 5, 6], 8: [1, 2, 3, 4, 5, 11], 9: [1, 2, 11], 30: [7, 8, 9, 10], 80: [6, 7, 8]}
    region = {3: 11, 30: 11, 8: 21, 9: 21, 80: 21}
    s = spark.createDataFrame([(e, o) for e, os in seen.items() for o in os], "edge_id long, obj_id long")
    r = spark.createDataFrame(list(region.items()), "edge_id long, region_id int")
    border = spark.createDataFrame([(11, 21, 3, 8)], "region_a int, region_b int, edge_id long, succ_id long")
    paths = spark.createDataFrame([(11, 1, [3]), (21, 2, [8, 9])], "region_id int, level int, path array<long>")
    occ = spark.createDataFrame([(11, [3], o) for o in seen[3]], "region_id int, path array<long>, obj_id long")
    out = stitching.stitch(mining.Mined(paths, occ), s, r, border, 0.5)
    (span,) = out.spans.collect()
    assert (span.kind, span.path, span.n_objects, span.ratio) == ("span_partial", [3, 8], 5, 5 / 8)
    assert [x.path for x in out.remainders.collect()] == [[9]]
    assert [x.p2 for x in out.absorbed.collect()] == [[8, 9]]


def test_cohen_and_shared_values(spark):
    df = spark.createDataFrame([(1, [10, 20]), (1, [5, 40])], "g long, sig array<long>")
    assert sk.cohen(df, ["g"], 2, 100).first().estimate == 7
    df = spark.createDataFrame([(1, [3, 20]), (1, [5, 40])], "g long, sig array<long>")
    assert sk.cohen(df, ["g"], 2, 100).first().estimate == 7
    two = spark.createDataFrame([([7, 7, 9], [9, 7, 1])], "l array<long>, r array<long>")
    assert len(two.selectExpr(f"{sk.shared_values('l', 'r')} as s").first().s) == 3


def test_minhash_union_is_elementwise_minimum(spark, m1):
    _, seen, _ = m1
    sigs = {r.edge_id: r.sig for r in sk.minhash(seen, 8).collect()}
    both = sk.minhash(seen.where("edge_id in (3, 4)").selectExpr("1L as edge_id", "obj_id"), 8).first().sig
    assert both == [min(a, b) for a, b in zip(sigs[3], sigs[4])]


def test_search_permutations():
    ratios = {k: 100 / k for k in range(1, 101)}
    got = {t: k for t, k, _ in sk.search_permutations(ratios, [64, 32, 16, 2])}
    assert got[32] == 3 and got[16] == 6 and got[2] == 46
    assert got[64] is None  # 100 is too much, 50 too little


def test_signature_lengths_grow_until_the_least_target(spark):
    seen = spark.createDataFrame([(1, o) for o in range(1000, 1400)], "edge_id long, obj_id long")
    table = {r.k: r.ratio for r in sk.compression(seen, 200).collect()}
    assert table[16] > 8
    assert sk.signature_lengths(seen, [8.0, 4.0, 2.0], k_max=16) == sk.search_permutations(table, [8.0, 4.0, 2.0])
    assert all(k for _, k, _ in sk.signature_lengths(seen, [8.0, 4.0, 2.0], k_max=16))
    assert sk.signature_lengths(seen.limit(0), [2.0]) == [(2.0, None, None)]


def test_pair_report_and_replay(spark):
    top = spark.createDataFrame([(1, 0.3, 4, "a"), (2, 0.3, 4, "b"), (3, 0.6, 4, "c")], "line_no long, threshold double, k int, head string")
    pairs = spark.createDataFrame([(0.3, 4, "[3,41]"), (0.3, 4, "[1234,5]"), (0.6, 4, "[0]")], "threshold double, k int, pair string")
    got = {(r.threshold, r.head): r.codes for r in reports.pair_report(top, pairs).collect()}
    assert got == {(0.3, "b"): "[1234000005,003000041]", (0.6, "c"): ""}
    log = spark.createDataFrame([(1, -1, -1), (2, -1, -1), (3, 2, 64), (4, 2, 64), (5, 7, 16), (6, -1, -1), (7, 99, 8)], "line_no long, k int, compress int")
    assert {(r.compress, r.k) for r in reports.replayed_lengths(log).collect()} == {(64, 2), (16, 7)}


def test_signatures_of_any_ids_match_plain_python(spark):
    from wayweave.functions.hashing import P, coefficients
    from wayweave.operators import sketches as sk

    ids = [0, 1, 77, P - 1, P, 2**33, 2**40 + 5, 2**63 - 1, -1, -(2**40), -(2**63)]

    def mixed(o):
        r, high = o % P, (abs(o) // P * (1 if o >= 0 else -1)) % P
        return (((r * r % P) * r + 1013904223 * r + 12345) % P + 1664525 * high) % P

    rows = [(i % 3, o) for i, o in enumerate(ids)] + [(1, 5), (1, 5)]
    seen = spark.createDataFrame(rows, "edge_id long, obj_id long")
    for k in (7, 300):
        got = sk.minhash(seen, k)
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
        for r in got.collect():
            own = {o for e, o in rows if e == r.edge_id}
            assert r.n_raw == len(own) and r.sig == [min((a * mixed(o) + b) % P for o in own) for a, b in coefficients(k)]
