"""Scans, plateaus, declared methods, trees of features, node tables, quantiles, reliability and workbooks against plain
versions."""

import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.config import SomConfig
from trackloom.functions.quantiles import quantiles
from trackloom.operators import dendrogram, nodes, registry, scan, som
from trackloom.operators import projection as pr
from trackloom.sources import tables, workbook


# --- scans -----------------------------------------------------------------------------------------------------------


def test_plateau_is_the_band_and_its_components():
    value = {(1, 1): 0.90, (1, 2): 0.899, (1, 3): 0.5, (2, 1): 0.5, (2, 2): 0.895, (2, 3): 0.5, (3, 1): 0.5, (3, 2): 0.5, (3, 3): 0.897}
    cells = [{"a": a, "b": b, "score": v} for (a, b), v in value.items()]
    out = scan.judged(cells, ["a", "b"], "score", True, 0.02, suggested={"a": 2, "b": 2})
    assert [c["cell"] for c in out if c["near"]] == [0, 1, 4, 8]
    assert [out[i]["component"] for i in (0, 1, 4, 8)] == [0, 0, 0, 8]
    assert [c["cell"] for c in out if c["best"]] == [0] and [c["cell"] for c in out if c["chosen"]] == [4]


def test_plateau_without_scores_with_range_and_words():
    assert not any(c["near"] or c["best"] for c in scan.judged([{"a": 1, "s": None}, {"a": 2, "s": math.nan}], ["a"], "s", True))
    rows = [{"a": "p", "s": 10.0}, {"a": "q", "s": 10.1}, {"a": "r", "s": 20.0}]
    assert [c["near"] for c in scan.judged(rows, ["a"], "s", False)] == [True, True, False]  # 2 % of the range of 10
    assert [c["near"] for c in scan.judged(rows, ["a"], "s", False, 0.005, of_range=True)] == [True, False, False]
    assert [c["chosen"] for c in scan.judged(rows, ["a"], "s", False, suggested={"a": "q"})] == [False, True, False]
    flat = scan.judged([{"a": i, "s": 1.0} for i in range(3)], ["a"], "s", True, of_range=True)
    assert all(c["near"] and c["component"] == 0 for c in flat)


def blobs(n=90, d=6, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    return rng.normal(size=(n, d)) + 3 * np.eye(3, d)[y], y


def as_table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], f"g{g}") for i, (r, g) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, g string").repartition(3)


def test_maps_of_a_grid_are_those_of_plain_training(spark):
    x, y = blobs()
    base = SomConfig(epochs=12)
    grid = [{"width": 4, "height": 3}, {"width": 5, "height": 4}, {"width": 4, "height": 3, "init": "nonsense", "epochs": 5}, {"width": 0, "nothing": 1}]
    t = as_table(spark, x, y).unionByName(spark.createDataFrame([(-1, None, "g0"), (-2, [1.0, None, 0.0, 0.0, 0.0, 0.0], "g0")], "id long, v array<double>, g string"))
    cells = scan.maps(t, "v", grid, base)
    for g, c in zip(grid[:2], cells, strict=False):
        plain = som.batch(x, SomConfig(epochs=12, **g))
        assert np.allclose(c.map.codebook, plain.codebook, atol=1e-8)
        assert np.allclose([h["quantisation_error"] for h in c.map.history[:12]], [h["quantisation_error"] for h in plain.history])
        n1, d1, n2, _ = som.two_nearest(x, c.map.codebook)
        assert c.map.history[-1]["quantisation_error"] == pytest.approx(d1.mean())
        assert c.map.history[-1]["topographic_error"] == pytest.approx((~c.map.lattice.adjacent[n1, n2]).mean())
        assert [e for e, _ in c.snapshots] == list(range(13)) and len(c.map.history) == 13
    assert len(cells[2].map.history) == 6 and cells[3].error and cells[3].map is None
    placed = {(r["cell"], r["key"]): r["node"] for r in scan.placed(t, "id", "v", cells).collect()}
    assert len(placed) == 3 * len(x)
    assert [placed[1, i] for i in range(len(x))] == som.two_nearest(x, cells[1].map.codebook)[0].tolist()
    k = scan.kymograph(spark, cells[0])
    assert k.count() == 13 * 12 * 6 and k.where("epoch = 12 and node = 3 and feature = 2").first()["value"] == pytest.approx(cells[0].map.codebook[3, 2])


@pytest.mark.parametrize("init", ["sample", "random"])
def test_maps_start_alike_however_rows_are_dealt(spark, init):
    x, y = blobs(40)
    grid, base = [{"width": 4, "height": 3}], SomConfig(epochs=3, init=init)
    a = scan.maps(as_table(spark, x, y), "v", grid, base)[0]
    b = scan.maps(as_table(spark, x[::-1], y[::-1]).repartition(2), "v", grid, base)[0]
    assert np.allclose(a.map.codebook, b.map.codebook)


def test_map_scan_of_an_empty_table_has_rows_with_errors(spark):
    t, _ = scan.map_scan(as_table(spark, *blobs()).where("false"), "v", [{"width": 4, "height": 3}, {"width": 5, "height": 3}])
    assert [r["error"] for r in t.collect()] == ["no rows"] * 2


def test_layout_scan_keeps_every_layout_and_a_failed_cell(spark):
    x, y = blobs(40)

    def run(x, y, tilt):
        if tilt == 3:
            raise RuntimeError("no such tilt")
        return x[:, :2] @ np.array([[1.0, tilt], [0.0, 1.0]])

    registry.register(registry.Method("tilted", run, (registry.Parameter("tilt", 0, 0, 9, suggested=lambda n: 1, scanned=(0, 1, 2, 3)),)), replace=True)
    assert "tilted" in registry.known()
    t = as_table(spark, x, y)
    result, layouts = scan.layout_scan(t, "id", "v", "g", "tilted", nulls=3)
    rows = {r["tilt"]: r for r in result.collect()}
    assert "no such tilt" in rows[3]["error"] and rows[3]["rnx_auc"] is None and not rows[3]["near"]
    for tilt in (0, 1, 2):
        xy = run(x, y, tilt)
        assert rows[tilt]["rnx_auc"] == pytest.approx(pr.rank_quality(x, xy)["auc"])
        got = {r["key"]: (r["axis1"], r["axis2"]) for r in layouts.where(F.col("cell") == tilt).collect()}
        assert len(got) == 40 and np.allclose([got[i] for i in range(40)], xy)
    assert sum(r["best"] for r in rows.values()) == sum(r["chosen"] for r in rows.values()) == 1
    with pytest.raises(ValueError, match="at most"):
        scan.layouts(spark.range(pr.LIMIT + 1).select("id", F.array(F.col("id").cast("double")).alias("v")), "id", "v", None, "pca", [{}])


def test_declared_parameters():
    p = registry.get("tsne").parameters[0]
    assert p.values(90) == [5.0, 10.0, 15.0, 20.0, 89 / 3] and p.value(90) == 18.0 and p.value(90, 7) == 7
    assert [g["neighbours"] for g in registry.get("isomap").grid(12)] == [5, 10, 11]
    with pytest.raises(ValueError, match="caveat"):
        registry.Method("x", lambda x, y: x, supervised=True)
    with pytest.raises(ValueError, match="already"):
        registry.register(registry.Method("pca", lambda x, y: x))
    with pytest.raises(ValueError, match="nothing to scan"):
        registry.get("pca").grid(50)
    with pytest.raises(ValueError, match="has no"):
        registry.get("tsne").filled(50, {"perplexty": 3})
    assert registry.get("lda").unusable(50, 1) and not registry.get("lda").unusable(50, 2)


# --- trees -----------------------------------------------------------------------------------------------------------


def plain_tree(d):
    """All pairs of clusters compared at every step."""
    parts, out, n = {i: [i] for i in range(len(d))}, [], len(d)
    while len(parts) > 1:
        height, a, b = min((d[np.ix_(parts[a], parts[b])].mean(), a, b) for a, b in itertools.combinations(sorted(parts), 2))
        parts[n + len(out)] = parts.pop(a) + parts.pop(b)
        out.append((a, b, height, len(parts[n + len(out)])))
    return out


@pytest.mark.parametrize("n", [2, 3, 9, 25])
def test_chain_gives_the_plain_tree(n):
    rng = np.random.default_rng(n)
    d = rng.random((n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    got, want = dendrogram.merges(d), plain_tree(d)
    assert [(m.left, m.right, m.size) for m in got] == [(a, b, s) for a, b, _, s in want]
    assert np.allclose([m.height for m in got], [h for _, _, h, _ in want])
    order = dendrogram.leaf_order(got)
    assert sorted(order) == list(range(n))
    for m_, (a, b, _, _) in enumerate(want):  # every cluster stands together, and its left part before its right one

        def leaves(k):
            return [k] if k < n else leaves(want[k - n][0]) + leaves(want[k - n][1])

        places = [order.index(x) for x in leaves(n + m_)]
        assert places == list(range(places[0], places[0] + len(places)))


def test_cuts_and_ties():
    same = np.ones((5, 5)) - np.eye(5)
    tree = dendrogram.merges(same)
    assert [m.height for m in tree] == [1.0] * 4 and tree[-1].size == 5
    assert dendrogram.cut(tree, 0.5) == [0, 1, 2, 3, 4] and dendrogram.cut(tree, 1) == [0] * 5
    assert dendrogram.merges(np.zeros((1, 1))) == [] and dendrogram.leaf_order([]) == [0]
    with pytest.raises(ValueError):
        dendrogram.merges(np.array([[0, 1], [2, 0]]))


def test_tree_of_features(spark):
    x, _ = blobs(60, 3)
    x = np.c_[x, x[:, 0] * -2, np.ones(60)]
    t = spark.createDataFrame([tuple(float(v) for v in r) for r in x], "a double, b double, c double, d double, e double")
    steps, leaves = dendrogram.of_features(t, list("abcde"))
    first = steps.orderBy("step").first()
    assert (first["left_node"], first["right_node"]) == (0, 3) and first["height"] == pytest.approx(0, abs=1e-9) and steps.count() == 4
    k = {r["feature"]: r["cluster"] for r in leaves.collect()}
    assert k["a"] == k["d"] and len({k[c] for c in "abce"}) == 4


# --- nodes -----------------------------------------------------------------------------------------------------------


def test_local_gradients_follow_a_plane(spark):
    for topology in ("hex", "rect"):
        grid = som.Lattice.grid(4, 3, topology)
        v = np.c_[2 * grid.xy[:, 0] - grid.xy[:, 1], np.full(12, 7.0)]
        rows = {(r["node"], r["feature"]): r for r in nodes.local_gradients(nodes.codebook_table(spark, v, ["tilt", "flat"]), grid).collect()}
        assert len(rows) == 24
        for i, near in enumerate(grid.adjacent):
            at = np.flatnonzero(near)
            want = np.linalg.lstsq(np.c_[grid.xy[at] - grid.xy[i], np.ones(len(at))], v[at, 0] - v[i, 0], rcond=None)[0]
            r = rows[i, "tilt"]
            assert np.allclose([r["gx"], r["gy"]], want[:2]) and rows[i, "flat"]["magnitude"] == pytest.approx(0, abs=1e-12)
    alone = nodes.local_gradients(nodes.codebook_table(spark, np.array([[1.0], [2.0]])), som.Lattice.grid(2, 1, "rect")).collect()
    assert [(r["gx"], r["gy"]) for r in alone] == [(0, 0)] * 2


def test_composition_colours_and_positions(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 1, 2.0, "p"), (2, 0, 1.0, 1, 2.0, "q"), (3, 1, 3.0, 0, 4.0, "p")], "id long, bmu int, bmu_distance double, runner_up int, runner_up_distance double, g string")
    c = {(r["node"], r["g"]): (r["fraction"], r["load"]) for r in nodes.composition(a, "g", 2).collect()}
    assert c == {(0, "p"): (0.5, 1.0), (0, "q"): (0.5, 1.0), (1, "p"): (1.0, 0.0)}
    assert {r["node"]: r["load"] for r in nodes.composition(a, "g", 3).collect()} == {0: 1.0, 1: 0.5}  # the third node is empty
    k = {r["node"]: r for r in nodes.colours(a, "g", 2, {"p": 0.9, "q": 0.1}).collect()}
    assert min(k[0]["hue"], 1 - k[0]["hue"]) == pytest.approx(0, abs=1e-9) and k[1]["hue"] == pytest.approx(0.9)
    assert k[0]["saturation"] == pytest.approx(100 / 255) and k[1]["brightness"] == pytest.approx(70 / 255)
    grid = som.Lattice.grid(2, 1)
    p = {r["id"]: r for r in nodes.positions(a, "id", grid, (0.0, 2.0)).collect()}
    assert (p[1]["x"], p[1]["y"]) == (0, 0) and p[2]["fit"] == 0.5 and p[3]["fit"] == 1
    assert math.hypot(p[3]["x"] - 1, p[3]["y"]) == pytest.approx(0.866 / math.sqrt(3)) and abs(math.atan2(p[2]["y"], p[2]["x"])) <= 0.2
    same = a.withColumn("bmu_distance", F.lit(1.0))
    assert {r["fit"] for r in nodes.positions(same, "id", grid).collect()} == {0.0}


def test_visits(spark):
    t = spark.createDataFrame([(0.0, 0, "a"), (5.0, 0, "a"), (10.0, 1, "a"), (9.9, 0, "a"), (None, 0, "a"), (1.0, None, "a")], "t double, node int, g string")
    got = {(r["bin"], r["node"]): (r["n"], r["share"]) for r in nodes.visits(t, "node", "t", "g", 2).collect()}
    assert got == {(0, 0): (1, 1.0), (1, 0): (2, pytest.approx(2 / 3)), (1, 1): (1, pytest.approx(1 / 3))}
    assert [r["bin"] for r in nodes.visits(t.where("t = 5"), "node", "t", "g").collect()] == [0]
    assert nodes.visits(t.where("false"), "node", "t", "g").count() == 0


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "huge"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(4)
    v = {"normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(size=3000) * 30), "ties": rng.integers(0, 4, 3000) * 1.0, "huge": np.r_[-1.7e308, 1.7e308, rng.normal(size=50)]}[kind]
    t = spark.createDataFrame([(float(x),) for x in [*v, math.nan, math.inf]], "v double").unionByName(spark.createDataFrame([(None,)], "v double")).repartition(3)
    shares = [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]
    assert np.allclose(quantiles(t, ["v"], shares)["v"], np.quantile(v, shares), rtol=1e-12)
    assert quantiles(t.where("false"), ["v"], shares)["v"] == [None] * 7


def test_reliability_against_the_plain_definition():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y, m = x[:, :2] + rng.normal(size=(60, 2)) * 0.3, round(0.5 * 59)
    own, dubious = pr.reliability(x, y)
    d, e = (np.sqrt(((z[:, None] - z) ** 2).sum(2)) for z in (x, y))
    for i in range(60):
        others = [j for j in np.argsort(e[i], kind="stable") if j != i][:m]
        assert own[i] == pytest.approx(np.corrcoef(d[i, others], np.sort(np.delete(d[i], i))[:m])[0, 1])
    assert dubious.mean() < 0.3
    same, none = pr.reliability(x, x)
    assert np.allclose(same, 1) and not none.any()
    assert np.isnan(pr.reliability(x[:5], y[:5])[0]).all() and not pr.reliability(np.ones((9, 2)), y[:9])[1].any()
    scrambled = np.mean([pr.reliability(x, rng.permutation(x), seed=k)[1].mean() for k in range(5)])
    assert scrambled < 0.2  # about the alpha of one in twenty
    y[0] = 40.0  # far from all others, so its neighbours there are of no order
    assert pr.reliability(x, y)[0][0] < own[1:].mean()


# --- workbooks and columns -------------------------------------------------------------------------------------------


def book(path, sheets, shared=(), styles="", date1904=False):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return str(path)


def test_workbook_cells(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    one = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c></row><row r="4"><c r="B4"><v>2.5</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c></row><row r="5"><c r="A5" s="1"><v>45292</v></c><c r="B5" s="2"><v>45292.5</v></c><c r="C5" s="3"><v>3</v></c><c r="D5" t="inlineStr"><is><t>in</t></is></c></row>'
    path = book(tmp_path / "a.xlsx", {"first": one, "second &amp; last": "", "third": "<row><c><v>1</v></c></row>"}, ["<t> name </t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>"], styles)
    assert [(r["position"], r["sheet"]) for r in workbook.sheets(spark, path).orderBy("position").collect()] == [(0, "first"), (1, "second & last"), (2, "third")]
    t = workbook.read_sheet(spark, path)
    assert t.columns == ["name", "rich", "column_3", "name.1"]
    assert [tuple(r) for r in t.collect()] == [(None, "2.5", "true", None), ("2024-01-01", "2024-01-01 12:00:00", "3", "in")]
    assert workbook.read_sheet(spark, path, "second & last").columns == [] and workbook.read_sheet(spark, path, 2).count() == 0
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_sheet(spark, path, "fourth")
    early = book(tmp_path / "b.xlsx", {"s": '<row><c><v>1</v></c></row><row><c s="0"><v>1</v></c></row>'}, styles='<cellXfs><xf numFmtId="14"/></cellXfs>', date1904=True)
    assert [r[0] for r in workbook.read_sheet(spark, early).collect()] == ["1904-01-02"]


def test_workbook_as_spots(spark, tmp_path):
    head = ["TRACK_ID", "POSITION_X", "POSITION_Y", "FRAME", "LABEL"]
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    rows = [head, ["Track id", "X", "Y", "Frame", "Label"], *[[i // 5, i * 0.5, -i, i % 5, f"s{i}"] for i in range(9000)]]
    path = book(tmp_path / "spots_drug_rep2.xlsx", {"s": "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)})
    s = tables.read_spots(spark, [path])
    assert s.count() == 9000 and {tuple(r) for r in s.select("group", "replicate").distinct().collect()} == {("drug", "2")}
    assert s.agg(F.sum("x")).first()[0] == sum(i * 0.5 for i in range(9000))
    with pytest.raises(ValueError, match="xlsx"):
        tables.read_table(spark, str(tmp_path / "x.ods"))


def test_roles_and_numbers_of_columns(spark):
    r = tables.detected(["backtrack", "x_coord", "y_coord", "centroid_x", "t", "track_no"]).role
    assert (r["x"], r["y"], r["track"]) == ("x_coord", "y_coord", "track_no")
    assert tables.detected(["x", "x_coord", "Position X"]).role["x"] == "Position X"
    t = spark.range(1).selectExpr("id", "cast(1 as int) i", "cast(1 as decimal(9,2)) d", "cast(1 as float) f", "true b", "'x' s")
    assert tables.numeric_columns(t) == ["id", "i", "d", "f", "b"]


def test_command_line_scan(spark, tmp_path, capsys):
    from trackloom import cli

    x, y = blobs(30, 3)
    path, out = str(tmp_path / "t.parquet"), str(tmp_path / "out")
    spark.createDataFrame([(f"s{i}", f"g{g}", "1", int(r[0] * 100), float(r[1]), float(r[2]), "w") for i, (r, g) in enumerate(zip(x, y, strict=True))], "sample string, group string, replicate string, a int, b double, c double, word string").write.parquet(path)
    assert cli.main(["scan", path, "-o", out, "--method", "isomap", "--grid", "neighbours=5,9"]) == 0
    assert "word" in capsys.readouterr().out
    assert sorted(r["neighbours"] for r in spark.read.parquet(f"{out}/scan").collect()) == [5, 9] and spark.read.parquet(f"{out}/layouts").count() == 60
    assert cli.main(["scan", path, "-o", out, "--method", "som", "--grid", "width=4,5", "height=3", "epochs=4"]) == 0
    assert spark.read.parquet(f"{out}/scan").count() == 2 and spark.read.parquet(f"{out}/layouts").count() == 60
    cli.main(["methods"])
    assert "isomap" in capsys.readouterr().out
