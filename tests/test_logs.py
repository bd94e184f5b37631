import pytest

from wayweave.functions.measures import cost_text
from wayweave.operators import mining, motions, network, regions as rg, sketches as sk
from wayweave.plans import replay, reports, sweep
from wayweave.sources import fixtures, text_io

SF = "/root/testdata/sf0.001"


def _text(spark, path, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(str(path))
    return str(path)


def _rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_regions_without_paths_have_a_line(spark, tmp_path):
    heads = spark.createDataFrame([(11, 15, 16), (21, 9, 4)], "region_id int, n_objects long, n_bytes long")
    paths = spark.createDataFrame([(11, [3, 4]), (11, [5])], "region_id int, path array<long>")
    lines = {r.region_id: r.line for r in reports.path_lines(paths, heads, 0.3, 100, 8, 16).collect()}
    assert lines == {11: "15,0.3,100,8,16,11,[3,4],[5]", 21: "9,0.3,100,8,16,21,[0]"}
    with_costs = reports.path_lines(paths, heads, 0.3, 100, with_costs=True)
    assert {r.line for r in with_costs.collect()} == {"16,0.0016,15,0.3,100,-1,-1,11,[3,4],[5]", "4,0.0004,9,0.3,100,-1,-1,21,[0]"}
    texts = spark.createDataFrame([(0,), (10000,), (125000,), (123456789,)], "n long").select(cost_text("n").alias("c")).collect()
    assert [r.c for r in texts] == ["0.0", "1.0", "12.5", "12345.6789"]
    rows = _rows(reports.path_rows(paths, heads, 0.3, 100, 8, 16))
    assert rows == sorted([(15, 0.3, 100, 8, 16, 11, [3, 4]), (15, 0.3, 100, 8, 16, 11, [5]), (9, 0.3, 100, 8, 16, 21, None)], key=repr)
    log = _text(spark, tmp_path / "log", lines.values())
    assert _rows(text_io.read_path_log(spark, log, keep_empty=True), "n_objects", "threshold", "edges", "k", "compress", "region_id", "path") == rows
    assert text_io.read_path_log(spark, log).count() == 2
    none = spark.createDataFrame([], heads.schema)
    assert reports.path_lines(paths, none, 0.3, 100).count() == 0 and reports.info_lines(none, 0.3, 0).count() == 0


def test_span_and_edge_lines(spark):
    paths = spark.createDataFrame([([3, 8],), ([3, 8],), ([12, 4],)], "path array<long>")
    assert reports.span_lines(paths, [15, 0.1], seed=7).first().line == "7;15,0.1,0,[12,4],[3,8]"
    assert reports.edge_lines(paths, [15, 0.1]).first().line == "15,0.1,0,[3,4,8,12]"
    assert reports.span_lines(paths.limit(0), [15, 0.1]).first().line == "15,0.1,0"
    assert reports.edge_lines(paths.limit(0), [15]).first().line == "15,0,[]"


def test_report_leaves_absorbed_paths_out(spark):
    rows = [(11, 21, [3, 8], "span_partial"), (11, 21, [9], "remainder"), (21, None, [8, 9], "absorbed"), (11, None, [5], "local"), (21, None, [6], "absorbed"), (21, None, [6], "local")]
    catalog = spark.createDataFrame(rows, "region_a int, region_b int, path array<long>, kind string")
    lines = [r.line for r in reports.result_report(catalog, 0.5).orderBy("line_no").collect()]
    assert lines[1:3] == ["Total number of Span-HoMoPaths: 1", "Total number of HoMoPaths : 5"]
    assert lines[6:] == ["11", "    11: [5],", "    21: [3, 8],", "21", "    21: [6],[9],"]
    assert reports.result_report(catalog.limit(0), 0.5).count() == 6


def test_pair_report_of_files(spark, tmp_path):
    pairs = text_io.read_pair_log(spark, _text(spark, tmp_path / "pairs", ["15,0.3,100,4,64,11,[3,41],[1234,5]", "15,0.6,100,4,64,11,[0]"]))
    top = text_io.read_top_log(spark, _text(spark, tmp_path / "top", ["1,2,3,0.3,100,4,64,0,[9]", '9,2,3,0.3,100,4,64,0,"[8,9]"', "", "1,2,3,0.6,100,4,64,0,[]"]))
    assert _rows(top) == [(1, 0.3, 4, "1,2,3,0.3,100,4,64,0"), (2, 0.3, 4, "9,2,3,0.3,100,4,64,0"), (3, 0.6, 4, "1,2,3,0.6,100,4,64,0")]
    got = {(r.threshold, r.head): r.codes for r in reports.pair_report(top, pairs).collect()}
    assert got == {(0.3, "9,2,3,0.3,100,4,64,0"): "[1234000005,003000041]", (0.6, "1,2,3,0.6,100,4,64,0"): ""}


def test_lines_keep_their_order_over_many_blocks(spark, tmp_path):
    path = _text(spark, tmp_path / "log", [f"{i},0.1,{i}" for i in range(5000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = text_io.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r.value == f"{r.line_no - 1},0.1,{r.line_no - 1}" for r in rows)


def test_regional_files(spark, tmp_path):
    edges, seen = fixtures.grid_edges(spark), fixtures.grid_sightings(spark, SF)
    parted = rg.partition(edges, 1)
    regions, links = rg.edge_region(parted), network.connections(edges)
    text_io.write_region_maps(parted, str(tmp_path / "map"))
    got = spark.read.schema("edge_id long, src long, dst long, x1 long, y1 long, x2 long, y2 long, region_id int").csv(str(tmp_path / "map"))
    assert _rows(got, *edges.columns, "region_id") == _rows(parted, *edges.columns, "region_id")
    text_io.write_ragged(links, str(tmp_path / "links"), "edge_id", "succ_id", regions=regions)
    assert (tmp_path / "links" / "region_id=11").exists()
    own = rg.regional(links, regions).where("region_id = 21")
    assert _rows(text_io.read_connections(spark, str(tmp_path / "links" / "region_id=21"))) == _rows(own, "edge_id", "succ_id")
    sketches = sk.minhash(seen, 4)
    text_io.write_sketches(sketches, str(tmp_path / "sk"), regions)
    assert _rows(text_io.read_sketches(spark, str(tmp_path / "sk"))) == _rows(sketches)
    border = rg.borders(links, regions)
    text_io.write_borders(border, str(tmp_path / "border"))
    assert _rows(text_io.read_borders(spark, str(tmp_path / "border"))) == _rows(border)
    text_io.write_ragged(seen, str(tmp_path / "seen"), "edge_id", "obj_id")
    assert _rows(text_io.read_sightings(spark, str(tmp_path / "seen"))) == _rows(seen)


def test_sweep_of_targets_equals_single_runs(spark):
    edges, seen = fixtures.grid_edges(spark), fixtures.grid_sightings(spark, SF)
    got = sweep.lengths_sweep(edges, seen, [0.3, 0.5], [(64.0, 2), (16.0, 6)], 1, 2)
    for target, k in ((64.0, 2), (16.0, 6)):
        for t in (0.3, 0.5):
            want = sweep.run(edges, seen, sweep.RunConfig(t, 1, 2, k)).paths.groupBy("region_id", "level").count()
            assert _rows(got.where(f"target = {target} and threshold = {t}"), "region_id", "level", "n_paths") == _rows(want)
    assert got.where("k = -1").count() == sweep.threshold_sweep(edges, seen, [0.3, 0.5], 1, 2).count()


def test_replay_of_a_folder(spark, tmp_path):
    folder = tmp_path / "100_edges_15_objects_30_percent_8_length_map16"
    edges, walks = fixtures.grid_edges(spark), fixtures.grid_motions(spark, SF)
    text_io.write_edges(edges.join(network.edge_weights(edges), "edge_id"), str(tmp_path / replay.EDGES))
    text_io.write_ragged(walks, str(tmp_path / replay.MOTIONS), "obj_id", "edge_id", "pos")
    _text(spark, tmp_path / replay.COSTS, ["16,0.0016,15,0.3,100,-1,-1,11,[0]", "16,0.0016,15,0.3,100,2,64,11,[3]", "16,0.0016,15,0.3,100,6,16,11,[0]", "1,0.1,15,0.3,100,-1,-1,11,[0]", "1,0.1,15,0.3,100,9,4,11,[0]"])
    names = [str(tmp_path / n) for n in (replay.EDGES, replay.MOTIONS, replay.COSTS, "nothing.txt")]
    assert replay.archive(spark, names, str(folder)) == [replay.EDGES, replay.MOTIONS, replay.COSTS]
    assert replay.settings(spark, str(folder)) == {"edges": 100, "objects": 15, "threshold": 30, "length": 8, "map": 16}
    got = replay.replay(spark, str(folder), depth=1, max_level=2)
    want = sweep.lengths_sweep(edges, motions.invert(walks), [0.3], [(16.0, 6), (64.0, 2)], 1, 2)
    assert _rows(got) == _rows(want) and {r.k for r in got.select("k").distinct().collect()} <= {-1, 2, 6}
    _text(spark, tmp_path / replay.EDGES, ["x"])
    with pytest.raises(FileExistsError):
        replay.archive(spark, names[:1], str(folder))
    with pytest.raises(ValueError):
        replay.replay(spark, str(tmp_path / "no_settings"))


def test_street_network_is_connected_in_place(spark):
    edges = {r.edge_id: r for r in fixtures.street_edges(spark, SF).collect()}
    assert len(edges) == 2 * 200 - 15 - 14  # 200 nodes, 15 a row, the last row with 5
    assert all(abs(e.x2 - e.x1) + abs(e.y2 - e.y1) == 100 for e in edges.values())
    at = {}
    for e in edges.values():
        assert at.setdefault(e.src, (e.x1, e.y1)) == (e.x1, e.y1) and at.setdefault(e.dst, (e.x2, e.y2)) == (e.x2, e.y2)
    assert mining.hot_edges(fixtures.street_sightings(spark, SF), rg.edge_region(rg.partition(fixtures.street_edges(spark, SF), 2)), 0.06).count() > 0
