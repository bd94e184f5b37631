from wayweave.functions.measures import cost, list_json_length
from wayweave.operators import motions, network, regions as rg
from wayweave.sources import fixtures, text_io
from wayweave.streaming import live


def test_side_rule(spark):
    rows = [(0, 100, 1), (300, 400, 2), (200, 300, 2), (300, 200, 2), (100, 300, 1), (300, 100, 2), (50, 250, 1)]
    df = spark.createDataFrame(rows, "x1 long, x2 long, want int").selectExpr("want", f"{rg.side('200')} as got")
    assert all(r.want == r.got for r in df.collect())


def test_regions_cover_edges_once(spark):
    edges = fixtures.grid_edges(spark)
    for depth, ids in ((0, {10}), (1, {11, 21}), (2, {112, 122, 212, 222})):
        rows = rg.partition(edges, depth).collect()
        assert len(rows) == 100 and len({r.edge_id for r in rows}) == 100 and {r.region_id for r in rows} <= ids
    assert rg.partition(edges, 1).where("region_id = 11").count() == 55


def test_numbering_passes_over_reserved(spark):
    edges = spark.range(230).selectExpr("id as src", "id + 1 as dst")
    ids = [r.edge_id for r in network.number_edges(edges, ["src"]).orderBy("src").collect()]
    assert ids[0] == 3 and not {1, 112, 122, 212, 222} & set(ids) and len(set(ids)) == 230 and ids == sorted(ids)


def test_measures(spark):
    r = spark.createDataFrame([([1, 2, 13], 16)], "a array<long>, b long").select(list_json_length("a").alias("n"), cost("b").alias("c")).first()
    assert (r.n, r.c) == (10, 0.0016)


def test_text_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(3, 4), (3, 6), (100, None)], "edge_id long, succ_id long")
    text_io.write_ragged(rows, str(tmp_path / "c"), "edge_id", "succ_id")
    assert {tuple(r) for r in text_io.read_connections(spark, str(tmp_path / "c")).collect()} == {(3, 4), (3, 6), (100, None)}
    m = spark.createDataFrame([(1, 1, 9), (1, 2, 7), (1, 3, 9)], "obj_id long, pos int, edge_id long")
    text_io.write_ragged(m, str(tmp_path / "m"), "obj_id", "edge_id", "pos")
    assert {tuple(r) for r in text_io.read_motions(spark, str(tmp_path / "m")).select("obj_id", "pos", "edge_id").collect()} == {(1, 1, 9), (1, 2, 7), (1, 3, 9)}
    s = spark.createDataFrame([(5, 2, [8, 9])], "edge_id long, n_raw long, sig array<long>")
    text_io.write_sketches(s, str(tmp_path / "s"))
    assert text_io.read_sketches(spark, str(tmp_path / "s")).collect() == s.collect()
    e = fixtures.grid_edges(spark).join(network.edge_weights(fixtures.grid_edges(spark)), "edge_id")
    text_io.write_edges(e, str(tmp_path / "e"))
    assert text_io.read_edges(spark, str(tmp_path / "e")).count() == 100
    (tmp_path / "log").write_text("150,0.1,100,-1,-1,11,[1,2],[3]\n150,0.1,100,-1,-1,21,[0]\n")
    got = text_io.read_path_log(spark, str(tmp_path / "log")).collect()
    assert [(r.region_id, r.path) for r in got] == [(11, [1, 2]), (11, [3])]


def test_simulated_walks(spark):
    edges = fixtures.grid_edges(spark)
    ends = {r.edge_id: (r.src, r.dst) for r in edges.collect()}
    walks = {}
    for r in motions.simulate(spark, edges, 40, 6, seed=5).orderBy("obj_id", "pos").collect():
        walks.setdefault(r.obj_id, []).append(r.edge_id)
    assert len(walks) == 40
    for w in walks.values():
        assert len(w) <= 6
        assert all(ends[a][1] == ends[b][0] and ends[b][1] != ends[a][0] for a, b in zip(w, w[1:]))
        nodes = [ends[w[0]][0], *(ends[e][1] for e in w)]
        assert len(set(nodes)) == len(nodes)


def test_stream_equals_batch(spark, tmp_path):
    events = fixtures.read(spark, "/root/testdata/sf0.001", "events").select("ts", "user_id", "props")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.windowed_sightings(live.passages(stream)).groupBy("window", "edge_id").count().selectExpr("window.start as start", "edge_id", "count as n_objects")
    run = q.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {tuple(r) for r in live.edge_counts(live.passages(events)).collect()}
    assert {tuple(r) for r in spark.table("live").collect()} == want
