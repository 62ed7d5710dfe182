import pytest
from pyspark.sql import functions as F

from isofold.functions.templating import TemplateError, listed, numbers, substitute
from isofold.operators import bivariate, columns, fields, incidence, meshing, sql, stats, tracking
from isofold.sources import catalogue, generators, meshes
from isofold.streaming import blocks


def test_templating():
    f = {"a": [1.0, 2.5, 3.0], "i": 1, "s": "x"}
    assert substitute("p {a} {a[1]} {a[{i}]} {s}", f) == "p 1,2.5,3 2.5 2.5 x"
    for bad in ("{b}", "{a[9]}", "{a", "a}"):
        with pytest.raises(TemplateError):
            substitute(bad, f)
    assert listed("a, b,") == ["a", "b"] and numbers("-1,2") == [-1.0, 2.0] and numbers("1,x") is None


def test_query(spark):
    a = spark.createDataFrame([(1, "it's"), (2, None)], "k int, t string")
    out = sql.query([a, a], "SELECT x.k FROM InputTable0 x JOIN InputTable1 y ON x.k = y.k WHERE x.k > {least} OR x.t = :t", {"least": [1]}, {"t": "it's"})
    assert sorted(r["k"] for r in out.collect()) == [1, 2]
    assert sql.query([a], "SELECT * FROM InputTable0 WHERE k > 9").count() == 0


def test_selectors_and_editors(spark):
    df = spark.createDataFrame([(0, 1.5, "a", 10), (1, 2.5, "b", 30), (2, 3.5, "c", 20)], "vid long, f double, s string, g int")
    assert columns.select_columns(df, regex="f|g", keep=["vid"]).columns == ["vid", "f", "g"]
    assert columns.select_columns(df, range_id=(2, 2), numeric_only=True, rename="h").columns == ["h"]
    with pytest.raises(ValueError):
        columns.select_columns(df, rename="x")
    added = columns.add_arrays(df, "p,-1,2,3\nq,x,y,z\n").orderBy("vid").collect()
    assert [r["p"] for r in added] == [-1.0, 2.0, 3.0] and [r["q"] for r in added] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        columns.add_arrays(df, "p,1,2")
    assert [r["f"] for r in columns.convert(df, "f", "int").orderBy("vid").collect()] == [1, 2, 3]
    assert [r["g"] for r in columns.convert(df, "g", "unsigned char", normalize=True).orderBy("vid").collect()] == [0, 255, 127]
    flat = columns.normalize(df.withColumn("g", F.lit(1.0)), "g")
    assert {r["g"] for r in flat.collect()} == {None}
    assert [r["n"] for r in columns.identify_by_scalar(df, "g", "vid", name="n").orderBy("vid").collect()] == [2, 0, 1]
    assert sorted(r["vid"] for r in columns.randomize_identifiers(df, "vid").collect()) == [0, 1, 2]


def test_extract_policies(spark):
    v = spark.createDataFrame([(0, i, i % 2) for i in range(4)], "ds long, vid long, k int")
    c = spark.createDataFrame([(0, 0, [0, 2]), (0, 1, [0, 1, 2]), (0, 2, [1, 3])], "ds long, cid long, verts array<bigint>")
    got = {p: sorted((r["cid"], r["verts"]) for r in columns.extract_geometry(v, c, "k", [0], p)[1].collect()) for p in ("all", "any", "sub")}
    assert got == {"all": [(0, [0, 2])], "any": [(0, [0, 2]), (1, [0, 1, 2])], "sub": [(0, [0, 2]), (1, [0, 2])]}


def test_uncertainty_and_distances(spark):
    f = spark.createDataFrame([(d, i, float(d * i)) for d in range(4) for i in range(3)], "ds long, vid long, value double")
    u = {r["vid"]: r for r in stats.uncertainty(f, 3).collect()}
    assert (u[2]["lower"], u[2]["upper"], u[2]["mean"]) == (0.0, 6.0, 3.0) and abs(sum(u[2][f"bin_{k}"] for k in range(3)) - 1) < 1e-12
    m = {(r["i"], r["j"]): r["dist"] for r in stats.distance_matrix(f, "inf").collect()}
    assert m[0, 3] == m[3, 0] == 6.0 and m[2, 2] == 0.0
    assert stats.wide_matrix(stats.distance_matrix(f, 1)).columns == ["i", "Dataset0", "Dataset1", "Dataset2", "Dataset3"]
    with pytest.raises(ValueError):
        stats.distance_matrix(f, 0)


def test_harmonic_ways_agree(spark):
    v = spark.createDataFrame([(0, i) for i in range(5)], "ds long, vid long")
    c = incidence.path_cells(v, "vid")
    fixed = spark.createDataFrame([(0, 0, 0.0), (0, 4, 8.0)], "ds long, vid long, value double")
    one, two = ({r["vid"]: r["value"] for r in fields.harmonic(v, fields.graph_laplacian(c), fixed, kernel_rows=k).collect()} for k in (10, 0))
    assert all(abs(one[i] - 2 * i) < 1e-3 and abs(one[i] - two[i]) < 1e-6 for i in range(5))


def test_harmonic_reaches_far_or_says_so(spark):
    n = 2501
    v = spark.range(n).selectExpr("0L AS ds", "id AS vid")
    lap = fields.graph_laplacian(incidence.path_cells(v, "vid"))
    fixed = spark.createDataFrame([(0, 0, 1.0), (0, n - 1, 6.0)], "ds long, vid long, value double")
    out = {r["vid"]: r["value"] for r in fields.harmonic(v, lap, fixed).collect()}
    assert all(abs(out[i] - (1 + 5 * i / (n - 1))) < 1e-3 for i in range(n))
    for rows in (10_000, 0):
        with pytest.raises(Exception, match="no convergence"):
            fields.harmonic(v, lap, fixed, rounds=2, kernel_rows=rows).collect()


def test_bivariate(spark):
    g = incidence.Grid(4, 4, 4)
    v = g.vertices(spark).withColumns({"u": F.col("x") + 0.01 * F.col("y"), "v": F.col("y") + 0.02 * F.col("z")})
    c = g.cells(spark)
    seg = bivariate.fiber(v, c, 1.5, 1.5).collect()
    assert seg and all(abs(p["x"] + 0.01 * p["y"] - 1.5) < 1e-9 and abs(p["v"] - 1.5) < 1e-9 for r in seg for p in (r["p"], r["q"]))
    poly = bivariate.range_polygon(spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.0), (2, 1.5, 2.0)], "id long, u double, v double"))
    assert poly.count() == 3
    s = bivariate.fiber_surface(v, c, poly).collect()
    edge0 = [p for r in s if r["edge"] == 0 for p in r["poly"]]
    assert edge0 and all(abs(y + 0.02 * z - 1.0) < 1e-9 and 1 - 1e-9 <= x + 0.01 * y <= 2 + 1e-9 for x, y, z in edge0)
    d = stats.continuous_scatter(v, c, "u", "v", (4, 4)).agg(F.sum("density")).first()[0]
    assert abs(d - 27) < 1e-6


def test_meshing(spark):
    v, c = generators.icosphere(spark, 2, 2.0, (1.0, 0.0, 0.0))
    assert (v.count(), c.count()) == (162, 320) and incidence.simplices(c, 1).count() == 480
    r = v.select(F.sqrt(F.expr("(x - 1) * (x - 1) + y * y + z * z")).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert abs(r[0] - 2) < 1e-9 and abs(r[1] - 2) < 1e-9
    b, bc = meshing.barycentric_subdivision(v, c)
    assert (b.count(), bc.count()) == (162 + 480 + 320, 6 * 320) and incidence.boundary(bc, 0).count() == 0
    p, q = meshing.subdivide(v, c)
    assert (p.count(), q.count()) == (962, 960)
    s, sc = generators.spheres_at(v.limit(2).select("vid", "x", "y", "z"), 6, 5)
    assert (s.count(), sc.count()) == (60, 2 * 6 * 4 * 2)


def test_overlap_tracking(spark):
    pts = [(0, t, float(x), 0.0, 0.0, l) for t, rows in enumerate([[(x, 1) for x in range(6)], [(x, 1) for x in range(4)] + [(x, 2) for x in (4, 5)]]) for x, l in rows]
    df = spark.createDataFrame(pts, "level long, t long, x double, y double, z double, label long")
    nodes, edges = tracking.track_overlap(df)
    b = {(r["t"], r["label"]): r["BranchId"] for r in nodes.collect()}
    assert b[0, 1] == b[1, 1] != b[1, 2] and {r["Overlap"] for r in edges.collect()} == {4, 2}
    assert tracking.nesting_edges(df.withColumn("level", F.col("t")).withColumn("t", F.lit(0).cast("long"))).count() == 2


def test_off_and_obj(spark, tmp_path):
    (tmp_path / "m.off").write_text("OFF\n4 2 0\n0 0 0 1.5\n1 0 0 2.5\n0 1 0 3.5\n0 0 1 4.5\n3 0 1 2 7\n4 0 1 2 3 8\n")
    v, c = meshes.read_off(spark, f"file://{tmp_path}/m.off")
    assert v.columns == ["ds", "vid", "x", "y", "z", "VertScalarField_0"] and [r["VertScalarField_0"] for r in v.orderBy("vid").collect()] == [1.5, 2.5, 3.5, 4.5]
    assert [(r["verts"], r["CellScalarField_0"]) for r in c.orderBy("cid").collect()] == [([0, 1, 2], 7.0), ([0, 1, 2, 3], 8.0)]
    meshes.write_off(v, c, f"file://{tmp_path}/out.off", ["VertScalarField_0"], ["CellScalarField_0"])
    v2, c2 = meshes.read_off(spark, f"file://{tmp_path}/out.off")
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect())) and c2.count() == 2
    meshes.write_obj(v, c, f"file://{tmp_path}/out.obj")
    meshes.write_vrml(v, c, f"file://{tmp_path}/out.wrl")
    assert spark.read.text(f"file://{tmp_path}/out.obj").where("value = 'f 1 2 3'").count() == 1
    (tmp_path / "bad.off").write_text("OFF\n1 1 0\n0 0 0\n5 0 0 0 0 0\n")
    with pytest.raises(ValueError):
        meshes.read_off(spark, f"file://{tmp_path}/bad.off")


def test_compression(spark, tmp_path):
    g = incidence.Grid(6, 6)
    v = g.vertices(spark).withColumn("value", F.sin(F.col("x")) * 10 + F.col("y"))
    meshes.write_compressed(v, g.cells(spark), f"file://{tmp_path}/c", 20.0, 5.0)
    out = meshes.read_compressed(spark, f"file://{tmp_path}/c").join(v, ["ds", "vid"])
    span = v.agg(F.max("value") - F.min("value")).first()[0]
    assert out.count() == 36 and out.agg(F.max(F.abs(F.col("Decompressed") - F.col("value")))).first()[0] <= span * 0.05 + 1e-9


def test_catalogue(spark, tmp_path):
    path = f"file://{tmp_path}/db.cdb"
    first = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.6), (2, "b", 1.5)], "k int, name string, v double")
    catalogue.write_products(first, path, ["k", "name"])
    catalogue.write_products(spark.createDataFrame([(2, "b", 9.0), (3, "c", 3.0)], "k int, name string, v double"), path, ["k", "name"])
    rows = catalogue.read_catalogue(spark, path)
    assert rows.count() == 3 and all(r["FILE"].startswith(path) for r in rows.collect())
    data = catalogue.read_products(rows.where("k > 1"))
    assert sorted((r["k"], r["v"]) for r in data.select("k", "v").collect()) == [(2, 9.0), (3, 3.0)]
    with pytest.raises(ValueError):
        catalogue.write_products(spark.createDataFrame([(1, 2)], "other int, v int"), path, ["other"])
    with pytest.raises(ValueError):
        catalogue.read_catalogue(spark, "x.csv")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for t in range(3):
        spark.createDataFrame([(0, t, float(x), 0.0, 0.0, 1 + (x > 2)) for x in range(5 - t)], "level long, t long, x double, y double, z double, label long").coalesce(1).write.mode("append").parquet(f"file://{src}")
    stream = lambda: spark.readStream.schema("level long, t long, x double, y double, z double, label long").parquet(f"file://{src}")
    blocks.collect_blocks(stream(), f"file://{tmp_path}/blocks", f"file://{tmp_path}/cp1").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/blocks").count() == 12
    q = blocks.track_stream(stream()).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("select level, t, t2, label, next_label, Overlap from tracked").collect()}
    want = {tuple(r) for r in tracking.overlap_edges(spark.read.parquet(f"file://{src}")).select("level", "t", "t2", "label", "next_label", "Overlap").collect()}
    assert got == want
    blocks.upsert_stream(stream().selectExpr("t as k", "label", "x as v"), f"file://{tmp_path}/s.cdb", ["k", "label"], f"file://{tmp_path}/cp3").awaitTermination()
    assert catalogue.read_catalogue(spark, f"file://{tmp_path}/s.cdb").count() == 5


def test_merge_points_and_cells(spark):
    from isofold.operators import graph

    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.05, 0.0, 0.0), (2, 0.12, 0.0, 0.0), (3, 5.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    m = {r["vid"]: r for r in graph.merge_points(pts, 0.1).collect()}
    assert [m[i]["merged_to"] for i in range(4)] == [0, 0, 0, 3] and m[0]["VertexMergeCount"] == 2 and m[3]["MinMergeDistance"] == -1.0
    cells = spark.createDataFrame([(0, [0, 3]), (1, [0, 1]), (2, [0, 1, 3])], "cid long, verts array<bigint>")
    assert [r["cid"] for r in graph.merged_cells(cells, graph.merge_points(pts, 0.1)).collect()] == [0]
