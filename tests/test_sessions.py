"""Names, catalogue, binary files and descriptions of sessions; plan files; edits that are refused."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import tokens, transforms
from eventloom.operators import edits, joins, trains, waves
from eventloom.plans import script
from eventloom.sources import session


def test_tokens():
    """Vectors: token, family, kind, order."""
    rows = """stderiv stderiv - -|standard standard - -|stderiv_S3 stderiv S 3|stderiv_C4 stderiv C 4|stderiv_C12 stderiv C 12|sdiff_S2 sdiff S 2|stderiv_D34 stderiv - -
    |stderiv_C5_D34 stderiv C 5|stderivfoo stderivfoo - -|stderiv_C stderiv_C - -|stderiv_X3 stderiv_X3 - -|a_D3 a_D3 - -|a_S1_S2 a_S1_S2 - -"""
    for row in rows.split("|"):
        name, family, kind, order = row.split()
        t = session.token(name)
        assert (t.family, t.kind or "-", str(t.order or "-")) == (family, kind, order) and session.is_derivative(name) == (family == "stderiv")
    assert (session.token("stderiv_C5_D34").lag, session.token("stderiv_C5_D34").dims) == (3, 4)


def test_families_as_columns(spark):
    names = ["stderiv", "stderiv_S3", "stderiv_C12", "stderiv_D34", "stderiv_C5_D34", "stderivfoo", "stderiv_C", "stderiv_X3", "standard", "", "a_D34_C5", "a_S1_S2", "a_D04", "a_X1_S2"]
    got = spark.createDataFrame([(n,) for n in names], "v string").select("v", tokens.family(F.col("v")).alias("f"), tokens.spatial(F.col("v")).alias("k"), tokens.spatial_order(F.col("v")).alias("o"), tokens.lag(F.col("v")).alias("l"), tokens.dims(F.col("v")).alias("d")).collect()
    for r in got:
        t = session.token(r.v)
        assert (r.f, r.k, r.o, r.l or 0, r.d or 0) == (t.family, t.kind, t.order, t.lag, t.dims)


def files(spark, *names):
    return session.catalogue(spark.createDataFrame([(f"/d/s.{n}",) for n in names], "path string"), "/d/s")


def test_paths_and_catalogue(spark):
    assert session.session_path("/d/s", "clu", 5, "stderiv", "a.b") == "/d/s.clu.stderiv.5.a_b" and session.session_path("s", "res", 5) == "s.res.5"
    assert session.fibers_path("s", "stderiv", 5, "refine") == "s.fibers.stderiv.5.refine" and session.position_path("s", 5) == "s.cpos.5"
    got = {r.path: (r.type, r.variant, r.group, r.tag) for r in files(spark, "clu.stderiv.5.refine", "spk.5", "res.standard.12", "fil", "yaml").collect()}
    assert got == {"/d/s.clu.stderiv.5.refine": ("clu", "stderiv", 5, "refine"), "/d/s.spk.5": ("spk", "", 5, ""), "/d/s.res.standard.12": ("res", "standard", 12, "")}
    sib = session.siblings(files(spark, "clu.stderiv.5.refine", "clu.sdiff.5.refine", "clu.standard.5", "clu.stderiv_C4.5.refine"), "refine")
    assert sib.first().variants == ["sdiff", "stderiv", "stderiv_C4"] and session.siblings(files(spark, "clu.sdiff.5", "clu.stderiv_C4.5"), only_family="stderiv").first().variants == ["stderiv_C4"]


@pytest.mark.parametrize(("there", "order", "want"), [
    (["spk.stderiv.5", "spk.standard.5"], session.DERIVED, "spk.stderiv.5"), (["spk.standard.5", "spk.5"], session.DERIVED, "spk.standard.5"), (["spkD.5", "spk.standard.5"], session.DERIVED, "spkD.5"),
    (["spk.stderiv_C4.5", "spk.standard.5"], session.DERIVED, "spk.stderiv_C4.5"), (["spk.stderiv.5"], session.STANDARD, None), (["spk.5", "spk.stderiv.5"], session.CANONICAL, "spk.5"), (["spk.stderiv.4"], session.DERIVED, None), (["spk.stderiv.5.refine"], session.DERIVED, None),
])
def test_preferred_files(spark, there, order, want):
    got = session.preferred(files(spark, *there), order).where("type = 'spk' and group = 5").collect()
    assert [r.path for r in got] == ([f"/d/s.{want}"] if want else [])


def test_several_of_a_family_must_be_named(spark):
    with pytest.raises(Exception, match="several variants"):
        session.preferred(files(spark, "spk.stderiv_C4.5", "spk.stderiv_S3.5"), session.DERIVED).collect()
    assert session.preferred(files(spark, "spk.stderiv_C4.5", "spk.stderiv_S3.5"), ("stderiv_S3",)).first().path.endswith("S3.5")


@pytest.mark.parametrize(("there", "first", "want"), [
    ("res.standard.5", "", "res.standard.5"), ("res.stderiv.5", "standard", "res.stderiv.5"), ("res.standard.5,res.stderiv.5", "stderiv", "res.stderiv.5"), ("res.stderiv_C5.5", "", "res.stderiv_C5.5"), ("res.stderiv_C5.5,res.standard.5", "", "res.standard.5"),
    ("res.5", "", "res.5"), ("res.5,res.stderiv_C5.5", "", "res.stderiv_C5.5"), ("res.stderiv.5.refine", "", None), ("res.stderiv.4", "", None),
])
def test_shared_files(spark, there, first, want):
    got = session.shared(files(spark, *there.split(",")), first).where("group = 5").collect()
    assert [r.path for r in got] == ([f"/d/s.{want}"] if want else [])


def test_binary_round_trips(spark, tmp_path):
    base, n = str(tmp_path / "s"), 3000
    r = np.random.default_rng(0)
    t, c, f, w = np.sort(r.integers(0, 10**12, n)), r.integers(0, 9, n), r.integers(-9, 9, (n, 5)), r.integers(-32768, 32767, (n, 12))
    rows = spark.createDataFrame([(i, int(t[i]), int(c[i]), f[i].tolist(), w[i].tolist()) for i in range(n)], "spike_idx long, t long, label int, f array<long>, wave array<short>").repartition(7).cache()
    session.write_times(rows, base, 5, "standard")
    session.write_labels(rows, base, 5, "stderiv", "refine")
    session.write_labels(rows, base, 5)
    session.write_features(rows, base, 5, "stderiv_C4")
    session.write_waves(rows, base, 5, "standard")
    assert (np.fromfile(f"{base}.res.standard.5", "<i8") == t).all() and (np.fromfile(f"{base}.clu.5", "<i4") == [c.max() + 1, *c]).all() and (np.fromfile(f"{base}.spk.standard.5", "<i2") == w.ravel()).all()
    assert np.fromfile(f"{base}.fet.stderiv_C4.5", "<i4", 1)[0] == 5 and not [x for x in os.listdir(tmp_path) if ".parts-" in x]
    ordered = lambda df, k: [x[k] for x in df.orderBy("spike_idx").collect()]
    assert ordered(session.read_times(spark, base, 5), "t") == t.tolist() and ordered(session.read_labels(spark, base, 5), "label") == c.tolist() and ordered(session.read_labels_at(spark, base, 5, "stderiv", "refine", 10), "label") == c[:10].tolist()
    assert ordered(session.read_features(spark, base, 5), "f") == f.tolist() and ordered(session.read_waves(spark, base, 5, 4, 3), "wave") == w.tolist() and session.read_raw_waves(spark, base, 5, 4, 3).count() == n
    assert ordered(session.chosen_labels(spark, base, 5, path=f"{base}.clu.5", n=4), "label") == c[:4].tolist() and session.chosen_labels(spark, base, 5).count() == n
    both, whole = session.labelled_times(spark, base, 5, session.STANDARD)
    assert whole and both.count() == n and not session.labelled_times(spark, base, 6)[1]
    assert session.curated(spark, base, 5, 4, 3, "stderiv", "refine").where("label >= 0").count() == n
    with pytest.raises(FileNotFoundError, match=r"there are: .*stderiv.5.refine"):
        session.read_labels_at(spark, base, 5, "sdiff")
    session.write_labels(rows.where("spike_idx < 10"), base, 5, "short")
    with pytest.raises(Exception, match="differ in length"):
        session.curated(spark, base, 5, 4, 3, "short").where("label >= 0").collect()
    kept = session.kept_events(rows.select("spike_idx", "t"), rows.where("spike_idx % 3 = 1").select("spike_idx")).orderBy("spike_idx").collect()
    assert [k.t for k in kept] == t[1::3].tolist() and [k.spike_idx for k in kept] == list(range(1000))
    empty = rows.where("false")
    session.write_labels(empty, base, 9)
    assert open(f"{base}.clu.9", "rb").read() == struct.pack("<i", 0)


def test_stage_of_labels_atoms_and_parents(spark, tmp_path):
    base = str(tmp_path / "s")
    atoms = spark.createDataFrame([(0, 2), (1, 1), (2, 4), (3, 0)], "spike_idx long, atom int")
    out = session.write_stage(atoms, spark.createDataFrame([(1, 5), (2, 6)], "atom int, fiber int"), base, 3)
    read = lambda k: np.fromfile(out[k], "<i4")[1:].tolist()
    assert read("clu") == [6, 5, 0, 0] and read("clc") == [2, 1, 4, 0] and read("clp") == [5, 6, 0, 0]
    same = session.write_identity(atoms.withColumnRenamed("atom", "label"), base, 3, "stderiv", "flat")
    assert np.fromfile(same["clu"], "<i4")[1:].tolist() == [2, 1, 4, 0] and np.fromfile(same["clp"], "<i4")[1:].tolist() == [1, 2, 0, 4]


def test_bases(spark, tmp_path):
    r = np.random.default_rng(0)
    b = transforms.Basis(r.normal(size=(3, 20)), r.normal(size=(3, 2, 20)), 5, True, 7, 4)
    path = session.write_basis(str(tmp_path / "s.pca.stderiv_C4.5"), b)
    got = session.parse_basis(session.file_bytes(path))
    assert (got.means == b.means).all() and (got.directions == b.directions).all() and (got.start, got.centred, got.method, got.inputs) == (5, True, 7, 4)
    assert session.clustering_basis(spark, str(tmp_path / "s"), 5, "stderiv").start == 5 and session.clustering_basis(spark, str(tmp_path / "s"), 5) is None
    old = struct.pack("<7i", session.MAGIC, 1, 3, 20, 2, 5, 0) + b.means.tobytes() + b.directions.tobytes()
    assert session.parse_basis(old).method == 0
    for bad in (b"", struct.pack("<2i", 1, 2), struct.pack("<2i", session.MAGIC, 3), session.basis_bytes(b)[:-8]):
        with pytest.raises(ValueError):
            session.parse_basis(bad)


def test_positions_signals_and_probes(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(50)], "spike_idx long, x0 double, dist double")
    session.write_positions(rows, path := str(tmp_path / "s.cpos.5"))
    got = session.read_positions(spark, path).orderBy("spike_idx").collect()
    assert [r.x0 for r in got] == list(map(float, range(50))) and got[3].dist == 6 and np.isnan(got[3].y0)
    x = np.random.default_rng(0).integers(-9, 9, (1001, 3)).astype("<i2")
    (tmp_path / "s.fil").write_bytes(x.tobytes() + b"\1")
    signal = session.read_signal(spark, str(tmp_path / "s.fil"), 3, 100)
    assert signal.count() == 11 and [v for r in signal.orderBy("block").collect() for v in r.samples] == x.tolist()
    events = spark.createDataFrame([(0, 0), (1, 99), (2, 500), (3, 1000)], "spike_idx long, t long")
    cut = {r.spike_idx: r.wave for r in session.cut_waves(events, signal, 8, 3, [0, 2], 100).collect()}
    want = transforms.cut_from(x, [0, 99, 500, 1000], 8, 3, [0, 2])
    assert all(cut[k] == want[k].ravel().tolist() for k in range(4))
    sites = session.probe_sites(spark, ["# a\n0 0\n0, 20\n", "x\n10 5.5\n"], [1, 2]).orderBy("channel").collect()
    assert [(r.channel, r.x, r.y) for r in sites] == [(1, 0, 20), (2, 10, 5.5)]
    lfp = events.select(session.lfp_index(F.col("t"), 20_000, 1250, 2).alias("i")).collect()
    assert [r.i for r in lfp] == [int(np.rint(t / 16)) - 2 for t in (0, 99, 500, 1000)]


def test_tables_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1)], "neuron_name string, n int")
    session.write_manifest(rows, str(tmp_path / "m"))
    assert [r.neuron_name for r in session.read_manifest(spark, str(tmp_path / "m")).collect()] == ["a", "b"]
    session.write_report(rows, str(tmp_path / "r"))
    session.write_csv(rows, str(tmp_path / "c"))
    session.write_tracks(rows, str(tmp_path / "t"), ("neuron_name",))
    session.append_log(rows, str(tmp_path / "l"))
    session.append_log(rows, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 6 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 3 and session.read_manifest(spark, str(tmp_path / "r")).count() == 3
    page = session.report_html(rows.orderBy("n"), "x < y")
    assert page.count("<tr>") == 4 and "x &lt; y" in page
    with pytest.raises(ValueError):
        session.report_html(rows, "t", 2)
    (tmp_path / "p.tsv").write_text("# note\npre\tpost\nca3\tpyr\nec\tbasket\n")
    assert session.read_pathways(spark, str(tmp_path / "p.tsv"), "pyr").count() == 1
    spark.createDataFrame([(1, 2, 3, 4)], "transition int, atom_a int, atom_b int, more int").write.parquet(str(tmp_path / "a"))
    assert session.read_anchor_pairs(spark, str(tmp_path / "a")).columns == ["transition", "atom_a", "atom_b"]


def test_morphologies(spark, tmp_path):
    (tmp_path / "x.swc").write_text("# c\n1 1 0 0 0 5 -1\n2 3 0 1 0 1 1\n3 3 0 2 0 1 2\n4 3 0 3 0 1 3\n5 3 1 3 0 1 3\n6 3 3 3 0 1 5\n")
    points = session.read_points(spark, str(tmp_path / "x.swc"))
    assert points.count() == 6
    got = {r.section: (r.n, r.length) for r in session.sections(points).collect()}
    assert got == {1: (1, 0.0), 2: (2, 2.0), 4: (1, 1.0), 5: (2, pytest.approx(2**0.5 + 2))}


DESCRIPTION = """
acquisitionSystem: {nChannels: 64, samplingRate: 32552, nBits: 16}
fieldPotentials: {lfpSamplingRate: 1250}
probes: [{probeFile: b.prb, channelOffset: 8}, {probeFile: a.prb, channelOffset: 0}]
spikeDetection:
  refractoryMs: 0.5
  channelGroups:
    - {channels: [0, 1, 2], nSamples: 32, peakSampleIndex: 15, nFeatures: 3, sdiffPairs: '0-1,1-2', probe: own.prb}
    - {channels: [3], refractoryPeriod: 20}
    - {}
programs: [{name: kit, parameters: [{name: refine.iters, value: 3}, {name: link.gap, value: 2}, {}]}]
"""


def test_descriptions(tmp_path):
    (tmp_path / "s").mkdir()
    path = tmp_path / "s" / "s.yaml"
    path.write_text(DESCRIPTION)
    for name in (path, tmp_path / "s", f"{tmp_path}/s/s"):
        assert session.find_session(str(name)) == str(path)
    s = str(tmp_path / "s")
    cfg = session.load_session(s, 1)
    assert (cfg.ntotal, cfg.sr, cfg.nchan, cfg.nsamp, cfg["peak"], cfg.sdiff_pairs, cfg.nbits) == (64, 32552.0, 3, 32, 15, "0-1,1-2", 16) and [os.path.basename(p) for p in cfg.probe] == ["own.prb", "a.prb", "b.prb"]
    assert "base" in cfg and "other" not in cfg
    for wrong in (lambda: cfg["other"], lambda: session.session_parameters(s, 1, other=2)):
        with pytest.raises(KeyError):
            wrong()
    for group in (0, 3, 4):
        with pytest.raises(ValueError):
            session.load_session(s, group)
    assert session.spike_groups(s) == [1, 2, 3] and session.spike_groups("/none") == [] and session.rates(session.described(s))["lfp_rate"] == 1250
    assert session.refractory_samples(s, 2) == (20, "group") and session.refractory_samples(s, 1, 32552)[0] == 16 and session.refractory_samples(s, 1) == (16, "default") and session.refractory_samples("/none", 1)[0] == 16
    assert session.program_parameters(s, "kit") == {"refine.iters": 3, "link.gap": 2} and session.stage_parameters(s, "refine", "kit") == {"iters": 3} and session.program_parameters(s, "x") == {}
    assert session.session_parameters(s, 1, nsamp=40).nsamp == 40 and session.session_parameters("/none", 1, channels="3,4", ntotal=8).nchan == 2
    with pytest.raises(ValueError, match="ntotal"):
        session.session_parameters("/none", 1, channels="3,4")
    with pytest.raises(FileNotFoundError):
        session.described("/none")


# plans


STAGES = {"session": script.Stage(("in", "out")), "link": script.Stage(("in", "units", "out"), {"gap": int}), "cpos": script.Stage(("in", "cpos", "out"), {})}
PLAN = "pipeline:\n- {stage: session, out: a}\n- {stage: link, in: a, out: b, params: {gap: 2}}\n- {stage: cpos, in: b, out: b, args: [x], pos: [1, 2]}\n"


def test_plan_files():
    steps = script.load(PLAN, STAGES)
    assert script.edges(steps) == [(0, 1, "in"), (1, 2, "in")] and script.validate(steps) == [] and script.lint(steps, STAGES) == ([], [])
    assert script.load(script.dump(steps, STAGES), STAGES) == [script.PlanStep(s.stage, {k: v for k, v in {"in": s.tag("in"), "out": s.tag("out")}.items()}, s.params, s.args, s.place) for s in steps]
    assert script.commands(steps, 5)[1] == "run link 5 --in a --out b --gap 2"
    text = script.embedded("a: 1\n", steps, STAGES)
    assert script.embedded(text, steps[:1], STAGES).count("stage:") == 1 and script.embedded(text, steps, STAGES) == text and "a: 1" in text
    for bad in ("x: 1", "- 3", "- {stage: other}"):
        with pytest.raises(ValueError):
            script.load(bad, STAGES)
    wrong = [script.PlanStep("link", {"in": "z", "out": "b"}, {"gap": "x", "other": 1}), script.PlanStep("session", {"out": "b"}), script.PlanStep("session", {"out": "c"}, {"p": 1})]
    errors, warnings = script.lint(wrong, STAGES)
    assert len(errors) == 2 and len(warnings) == 3
    circle = [script.PlanStep("link", {"in": "b", "out": "a"}), script.PlanStep("link", {"in": "a", "out": "b"})]
    assert any("circle" in e for e in script.lint(circle, STAGES)[0])
    late = [script.PlanStep("link", {"in": "a", "out": "b"}), script.PlanStep("session", {"out": "a"})]
    assert [s.stage for s in script.ordered(late)] == ["session", "link"]


# edits that are refused


def test_refused_edits(spark):
    p = spark.createDataFrame([(1, 2), (2, 2), (3, 4)], "child long, parent long")
    a = spark.createDataFrame([(0, 1), (1, 3), (2, 9)], "event long, child long")
    with pytest.raises(KeyError):
        edits.move_child(p, 7, 2)
    with pytest.raises(ValueError):
        edits.split_parent(p, 2, [3])
    with pytest.raises(ValueError):
        edits.merge_children(a, p, 1, 3)
    with pytest.raises(ValueError):
        edits.run_script(a, p, ["other 1 2"])
    assert edits.fresh(p) == 5 and [r.child for r in edits.orphans(a, p).collect()] == [9] and edits.run_script(a, p, ["# nothing"])[2] == 0
    with pytest.raises(Exception, match="went to several"):
        edits.carried(a, p, spark.createDataFrame([(0, 2), (1, 2)], "event long, label long"), spark.createDataFrame([(0, 5), (1, 6)], "event long, label long")).collect()
    assert edits.fibers(a.where("false"), p)[0].count() == 0


# counts of pairs


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_pair_counts_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    r = np.random.default_rng(1)
    rows = [(int(u), int(t)) for u, t in zip(r.integers(0, 5, 400), np.r_[r.integers(0, 3000, 250), np.repeat(1000, 150)], strict=True)]
    e = spark.createDataFrame(rows, "unit long, t long")
    want = {}
    for u, t in rows:
        for v, s in rows:
            if u < v:
                for k, (lo, hi) in enumerate(((0, 7), (10, 40))):
                    if lo < abs(t - s) <= hi:
                        want.setdefault((u, v), [0, 0])[k] += 1
    got = {(x.a, x.b): [x.n0, x.n1] for x in joins.pair_counts(e, [(0, 7), (10, 40)]).collect() if x.n0 or x.n1}
    assert got == want and joins.pair_counts(e.where("false"), [(0, 7)]).count() == 0
    assert trains.refractory_gate(e.withColumn("event", F.lit(0)), 40, 10, 1e9).count() == 0


def test_wave_operators_are_the_kernels(spark):
    r = np.random.default_rng(2)
    x = r.integers(-99, 99, (40, 8, 3)).astype(float)
    w = spark.createDataFrame([(k, k % 2, x[k].ravel().tolist()) for k in range(40)], "event long, cluster int, w array<double>").repartition(3)
    got = {q.event: q.w for q in waves.derivative(w, 8, 3, sets=[[1], [2], [0, 1]]).collect()}
    assert all(got[k] == transforms.derivative(x, sets=[[1], [2], [0, 1]])[k].ravel().tolist() for k in range(40))
    b = waves.fitted_basis(w, 8, 3, 1, 6, 2)
    means, directions = transforms.fit_basis(transforms.window(x, 1, 6), 2)
    assert b.means == pytest.approx(means) and b.directions == pytest.approx(directions, abs=1e-9)
    f = {q.event: q.f for q in waves.projections(w, 8, 3, b).collect()}
    assert f[7] == pytest.approx(transforms.projected_waves(x, b)[7].tolist())
    moved = {q.event: q.w for q in waves.aligned(w, 8, 3).collect()}
    assert moved[3] == pytest.approx(transforms.aligned(x[1::2])[0][1].ravel().tolist())
    offsets = waves.template_offsets(w, 8, 3, 2, 5).collect()
    assert {q.event for q in offsets} == set(range(40)) and waves.dispersions(w, 8, 3).count() == 2 and waves.polynomials(w, 8, 3).first().f is not None


def test_probe_geometry(tmp_path):
    pytest.importorskip("yaml")
    for k in range(2):
        (tmp_path / f"p{k}.probe").write_text("probeFile:\n  sites:\n    geometry:\n" + "".join(f"      - [{k}, {20 * i}]\n" for i in range(3)))
    (tmp_path / "none.probe").write_text("probeFile: {}\n")
    both = [str(tmp_path / f"p{k}.probe") for k in range(2)]
    assert session.probe_geometry(both, [5, 0]).tolist() == [[1, 40], [0, 0]]
    for paths, channels in ((both[:1], [3]), ([str(tmp_path / "none.probe")], [0])):
        with pytest.raises(ValueError):
            session.probe_geometry(paths, channels)
