import gzip
import io
import os
import struct
import tracemalloc

import numpy as np
import pytest

from onsetlab.operators import patterns, workflows
from onsetlab.sources import frames, images, tables


def test_events_files(spark, tmp_path):
    (tmp_path / "sub-01").mkdir()
    (tmp_path / "sub-01" / "sub-01_task-x_run-01_events.tsv").write_text("onset\tduration\ttrial_type\n0.0\t2.0\tface\n6.0\tn/a\tplace\nbad\t1\t001\n")
    (tmp_path / "other.txt").write_text("no\n")
    rows = tables.read_events(spark, str(tmp_path)).collect()
    assert sorted((r.trial_type, r.onset, r.duration) for r in rows) == [("001", None, 1.0), ("face", 0.0, 2.0), ("place", 6.0, None)]
    assert all(r.eventfile.endswith("_events.tsv") for r in rows)


def test_event_columns_go_by_the_files_header(spark, tmp_path):
    (tmp_path / "sub-01_task-x_run-1_events.tsv").write_text("onset\tduration\tresponse_time\ttrial_type\n1.0\t2.0\t0.7\tface\n4.0\t2.0\tn/a\t001\n")
    (tmp_path / "sub-01_task-x_run-2_events.tsv").write_text('trial_type\tonset\tduration\r\n"a ""b"""\t3\t1\r\nNA\t5\n')
    (tmp_path / "sub-01_task-x_run-3_events.tsv").write_text("")
    rows = sorted(tables.read_events(spark, str(tmp_path)).collect(), key=lambda r: (r.eventfile, r.event_id))
    assert [(r.trial_type, r.onset, r.duration, r.extra) for r in rows] == [("face", 1.0, 2.0, {"response_time": "0.7"}), ("001", 4.0, 2.0, {"response_time": None}), ('a "b"', 3.0, 1.0, {}), (None, 5.0, None, {})]
    assert [r.event_id for r in rows] == [0, 1, 0, 1]


def test_cells_in_quotes(spark, tmp_path):
    lines = ["onset\tduration\ttrial_type\tnote", '1\t2\t"a\tb"\t', '\t2\t"say ""x""\ty"z\t5" tall', '3\t1d\tc', '4\t0x1p3\t"open\tq']
    (tmp_path / "sub-01_task-x_run-1_events.tsv").write_text("\n".join(lines) + "\n")
    rows = sorted(tables.read_events(spark, str(tmp_path)).collect(), key=lambda r: r.event_id)
    assert [(r.onset, r.duration, r.trial_type, r.extra["note"] if "note" in r.extra else None) for r in rows] == [(1.0, 2.0, "a\tb", None), (None, 2.0, 'say "x"\tyz', '5" tall'), (3.0, None, "c", None), (4.0, None, '"open', "q")]


def _decoded(raw, voxels=None, part=images.PART):
    got = list(images.frames_of(images.Stream(io.BytesIO(raw), part), voxels))
    return got[0][0], np.array([x for _, x in got])


def test_scaling_of_images():
    x = np.arange(12, dtype=np.float32).reshape(2, 6)
    for slope, shift, want in ((2.0, 1.0, 2 * x + 1), (0.0, 5.0, x), (float("nan"), 5.0, x), (float("inf"), 0.0, x), (1.0, float("nan"), x)):
        about, got = _decoded(images.encode(x, [2, 3, 1], 2.5, slope, shift))
        assert np.array_equal(got, want) and (about["grid"], about["sizes"], about["tr"], about["n_frames"]) == ([2, 3, 1], [1.0] * 3, 2.5, 2)


def test_streams_give_the_same_frames():
    x = np.random.default_rng(1).normal(size=(40, 60)).astype(np.float32)
    raw = images.encode(x, [3, 4, 5], 2.0)
    members = gzip.compress(raw[:1000]) + gzip.compress(raw[1000:])  # a file of two compressed members
    for data in (raw, gzip.compress(raw), members):
        for part in (7, 999, images.PART):
            assert np.array_equal(_decoded(data, part=part)[1], x)
            assert np.array_equal(_decoded(data, np.array([0, 5, 59]), part)[1], x[:, [0, 5, 59]])
    with pytest.raises(ValueError, match="ends within frame 39"):
        _decoded(raw[:-5])
    with pytest.raises(ValueError, match="grid has 60"):
        _decoded(raw, np.array([3, 60]))


def test_types_of_values():
    x = np.arange(6, dtype=np.float32)
    for code, kind in images.KINDS.items():
        for order in "<>":
            head = bytearray(images.encode(x[None], [2, 3, 1], 1.0)[:352])
            if order == ">":  # the same header with its bytes the other way round
                for fmt, at in (("i", 0), ("8h", 40), ("8f", 76), ("3f", 108)):
                    struct.pack_into(">" + fmt, head, at, *struct.unpack_from("<" + fmt, head, at))
            struct.pack_into(order + "h", head, 70, code)
            assert np.array_equal(_decoded(bytes(head) + x.astype(order + kind).tobytes())[1][0], x)
    for code, name in ((32, "complex"), (128, "colours"), (9999, "none of the format")):
        head = bytearray(images.encode(x[None], [2, 3, 1], 1.0))
        struct.pack_into("<h", head, 70, code)
        with pytest.raises(ValueError, match=f"data type {code} .*{name}"):
            _decoded(bytes(head))
    with pytest.raises(ValueError, match="no header"):
        _decoded(b"x" * 400)
    with pytest.raises(ValueError, match="too short"):
        _decoded(b"")


def test_memory_is_a_frames(tmp_path):
    """A compressed file of 400 frames, 51 MB inflated: what reading it holds is some frames at most."""
    x = np.zeros((400, 32000), np.float32)
    x[:, ::7] = 1.0
    (tmp_path / "a_bold.nii.gz").write_bytes(gzip.compress(images.encode(x, [32, 40, 25], 1.0), 1))
    voxels = np.arange(0, 32000, 50)
    tracemalloc.start()
    with images.open_file(str(tmp_path / "a_bold.nii.gz")) as f:
        n = sum(1 for _ in images.frames_of(images.Stream(f), voxels))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 and peak < 12 * 32000 * 4 + images.PART * 2


def test_images(spark, tmp_path):
    x = np.arange(2 * 3 * 1 * 50, dtype=np.float32).reshape(50, 6)
    (tmp_path / "a_bold.nii.gz").write_bytes(gzip.compress(images.encode(x, [2, 3, 1], 2.5)))
    p = images.read_patterns(spark, str(tmp_path))
    rows = p.orderBy("volume").collect()
    assert len(rows) == 50 and rows[7].features == x[7].tolist() and rows[0].grid == [2, 3, 1]
    r = images.recordings_of(p).first()
    assert (r.tr, r.n_frames) == (2.5, 50)


def test_headers_are_scanned_without_frames(spark, tmp_path):
    rng = np.random.default_rng(2)
    for k, name in enumerate(("a_bold.nii", "b_bold.nii.gz", "c_mask.nii")):
        raw = images.encode(rng.normal(size=(30, 4000)).astype(np.float32), [10, 20, 20], 2.0 + k)
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
    scan = images.scan_headers(spark, str(tmp_path))
    rows = {r.boldfile.rpartition("/")[2]: r for r in scan.collect()}
    assert {k: (r.tr, r.n_frames, r.grid) for k, r in rows.items()} == {"a_bold.nii": (2.0, 30, [10, 20, 20]), "b_bold.nii.gz": (3.0, 30, [10, 20, 20])}
    assert all(r.read_bytes <= 2 * images.FIRST for r in rows.values())
    assert "content" not in scan._jdf.queryExecution().executedPlan().toString()
    whole = {r.boldfile: r for r in images.recordings_of(images.read_patterns(spark, str(tmp_path))).collect()}
    assert all(whole[r.boldfile].grid_key == r.grid_key and whole[r.boldfile].n_frames == r.n_frames for r in rows.values())


def test_grids_are_told_apart(spark, tmp_path):
    x, straight = np.zeros((2, 6), np.float32), [1.0, 0, 0, -9, 0, 1, 0, -8, 0, 0, 1, -7]
    c, s = np.cos(0.1), np.sin(0.1)
    kinds = {
        "same": {"sform": straight}, "near": {"sform": [1.00004, *straight[1:]]}, "turned": {"sform": [c, -s, 0, -9, s, c, 0, -8, 0, 0, 1, -7]},
        "by_quaternion": {"quaternion": (0.0, 0.0, 0.0, -9.0, -8.0, -7.0)}, "turned_by_quaternion": {"quaternion": (0.0, 0.0, np.sin(0.05), -9.0, -8.0, -7.0)}, "other_offset": {"quaternion": (0.0, 0.0, 0.0, -9.0, -8.0, -7.1)},
    }
    for name, how in kinds.items():
        (tmp_path / f"{name}_bold.nii").write_bytes(images.encode(x, [2, 3, 1], 1.0, **how))
    key = {r.boldfile.rpartition("/")[2][:-9]: r.grid_key for r in images.scan_headers(spark, str(tmp_path)).collect()}
    assert key["same"] == key["near"] == key["by_quaternion"] == "2x3x1 1.000000,1.000000,1.000000 1.000,0.000,0.000,-9.000,0.000,1.000,0.000,-8.000,0.000,0.000,1.000,-7.000"
    assert key["turned"] == key["turned_by_quaternion"] != key["same"] and key["other_offset"] != key["same"]


def test_masks_from_files(spark, tmp_path):
    frames = np.arange(4 * 12, dtype=np.float32).reshape(4, 12)
    for sub, ses in (("01", "a"), ("01", "b"), ("02", "a")):
        folder = tmp_path / f"sub-{sub}" / f"ses-{ses}"
        folder.mkdir(parents=True)
        mask = np.zeros((1, 12), np.float32)
        mask[0, [1, 4, 7] if sub == "01" else [0, 11]] = 2.0
        (folder / f"sub-{sub}_ses-{ses}_mask.nii.gz").write_bytes(gzip.compress(images.encode(mask, [2, 3, 2], 1.0)))
        (folder / f"sub-{sub}_ses-{ses}_task-x_run-1_bold.nii.gz").write_bytes(gzip.compress(images.encode(frames, [2, 3, 2], 2.0)))
    wanted = spark.createDataFrame([("01", "a"), ("01", "b"), ("02", "a")], "subject string, session string")
    template = f"{tmp_path}/sub-{{subject}}/ses-{{session}}/sub-{{subject}}_*_mask.nii*"
    masks = images.read_masks(wanted, template)
    assert {(r.subject, r.session): r.voxel_idx for r in masks.collect()} == {("01", "a"): [1, 4, 7], ("01", "b"): [1, 4, 7], ("02", "a"): [0, 11]}
    got = images.read_patterns(spark, str(tmp_path), masks=masks).collect()
    assert len(got) == 12 and all(r.features == frames[r.volume][[1, 4, 7] if "sub-01" in r.boldfile else [0, 11]].tolist() for r in got)
    one = spark.createDataFrame([("01", "a")], "subject string, session string")
    assert images.read_masks(one, f"{tmp_path}/**/*sub-02*_mask.nii.gz").first().voxel_idx == [0, 11]  # no keys: a file for all
    with pytest.raises(ValueError, match="missing or ambiguous.*'03'"):
        images.read_masks(wanted.unionByName(spark.createDataFrame([("03", "a")], wanted.schema)), template)
    with pytest.raises(ValueError, match="ambiguous"):
        images.read_masks(one, f"{tmp_path}/sub-{{subject}}/**/*_mask.nii.gz")  # both sessions' files
    # in a workflow's sections
    rows = [(s, e, 1, t, f"{s}{e}", "ab"[t % 2], float(t), 1.0, t) for s, e in (("01", "a"), ("02", "a")) for t in range(4)]
    table = spark.createDataFrame(rows, "subject string, session string, run int, trial_index int, boldfile string, trial_type string, onset double, duration double, volume_of_interest int")
    every = spark.createDataFrame([(s, e, f"{s}{e}", t, frames[t].tolist()) for s, e in (("01", "a"), ("02", "a")) for t in range(4)], "subject string, session string, boldfile string, volume int, features array<double>")
    leaf = {c: {"column": "trial_type", "match": "exact", "value": c} for c in "ab"}
    parts = workflows.sections(table, every, None, {"model_conditions": {"training": {"conditions": leaf}, "testing": {"conditions": leaf}}}, masks.drop("grid_key"))
    assert {(r.subject, len(r.features)) for r in parts["training"].collect()} == {("01", 3), ("02", 2)}


def test_tables(spark, tmp_path):
    v = spark.createDataFrame([("001", None, "t", "x", 1, 2)], "subject string, session string, task string, trial_type string, run int, volume_of_interest int")
    tables.write_volumes(v, str(tmp_path / "v"))
    back = tables.read_volumes(spark, str(tmp_path / "v")).first()
    assert back.session == "" and back.subject == "001" and tables.read_volumes(spark, str(tmp_path / "v")).where("subject = '001'").count() == 1
    tables.write_volumes(v.unionByName(v.withColumn("volume_of_interest", v.run)), str(tmp_path / "c"), csv=True)
    assert [r.volume_of_interest for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["1", "2"]
    m = spark.createDataFrame([("d", "001", "cv", 1, "accuracy", "a", "b", 0.5)], "desc string, subject string, stage string, fold int, metric string, row_label string, col_label string, value double")
    tables.write_metrics(m, str(tmp_path / "m"))
    read = tables.read_metrics(spark, str(tmp_path / "m"), stage="cv")
    assert tables.catalog(read).first().n_folds == 1 and read.first().subject == "001"
    assert tables.wide_matrix(read, ["a", "b"]).first().b == 0.5
    assert tables.missing_results(read, m.selectExpr("desc", "'2' as subject", "stage")).count() == 1
    assert {r.trial_type for r in tables.expected_values(spark, '["a", "b"]').collect()} == {"a", "b"}
    tables.write_decoding(m, str(tmp_path / "d"))
    assert tables.read_decoding(spark, str(tmp_path / "d")).first().subject == "001"
    maps = spark.createDataFrame([("d", "01", "face", [0.5, 0.0])], "desc string, subject string, label string, weights array<double>")
    tables.write_importance(maps, str(tmp_path / "i"))
    assert tables.read_decoding(spark, str(tmp_path / "i")).select("subject", "weights").first() == ("01", [0.5, 0.0])
    tables.write_folds(spark.createDataFrame([("01", 1, [2, 3])], "subject string, fold int, runs array<int>"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).first().runs == [2, 3]
    assert tables.result_name(m, "desc", "metric").first().name == "d_accuracy"


def test_results_by_listing(spark, tmp_path):
    """Catalog, folds and categories from folders and one small file: no result is read."""
    names = ["zebra", "ape", "a/b c+d"]
    rows = [("d%1", s, "cv", f, "auc", c, "", k + f / 10) for s in ("001", "x y") for f in (1, 2) for k, c in enumerate(names)] + [("d%1", "001", "test", None, "total_scores", "", "", 0.25)]
    m = spark.createDataFrame(rows, "desc string, subject string, stage string, fold int, metric string, row_label string, col_label string, value double")
    path = str(tmp_path / "m")
    tables.write_metrics(m, path, names)
    found = tables.listed_catalog(spark, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower() and "content" not in plan  # names of files alone
    assert sorted(map(tuple, found.collect())) == [("d%1", "001", "cv", 2, True), ("d%1", "001", "test", 0, False), ("d%1", "x y", "cv", 2, True)]
    assert tables.read_categories(spark, path, "d%1") == names and tables.read_categories(spark, path, "other") == []
    assert sorted(map(str, tables.read_metrics(spark, path, stage="cv", fold=2).select(*m.columns).collect())) == sorted(map(str, m.where("fold = 2").collect()))
    maps = spark.createDataFrame([("d", "01", True, "face", [0.5]), ("d", "02", False, "face", [0.5])], "desc string, subject string, mni boolean, label string, weights array<double>")
    tables.write_importance(maps, str(tmp_path / "i"))
    assert sorted(map(tuple, tables.listed_maps(spark, str(tmp_path / "i")).collect())) == [("d", "01", "mni"), ("d", "02", "unasserted")]


def test_wide_results(spark, tmp_path):
    names = ["zebra", "ape", "b,c"]
    matrix = [("d", "01", "test", None, "accuracy", a, b, 1 / (2 + i + 3 * j)) for i, a in enumerate(names) for j, b in enumerate(names)]
    rows = matrix + [("d", "01", "test", None, "auc", a, "", float("nan") if a == "ape" else 0.5) for a in names] + [("d", "01", "cv", 3, "total_scores", "", "", 2 / 3)]
    m = spark.createDataFrame(rows, "desc string, subject string, stage string, fold int, metric string, row_label string, col_label string, value double")
    path = str(tmp_path / "w")
    tables.write_wide(m, path, names)
    text = {r.metric: r.value for r in spark.read.option("basePath", path).text(path, wholetext=True).collect()}
    assert text["accuracy"].splitlines()[0] == ',zebra,ape,"b,c"' and text["accuracy"].splitlines()[1] == "zebra,0.5,0.2,0.125"
    assert text["auc"].splitlines() == [",auc", "zebra,0.5", "ape,", '"b,c",0.5'] and text["total_scores"].strip() == "0.666667"
    back = tables.read_wide(spark, path).collect()
    got = {(r.metric, r.row_label, r.col_label): r.value for r in back}
    assert {k for k in got} == {(r[4], r[5], r[6]) for r in rows} and all(got["accuracy", r[5], r[6]] == r[7] for r in matrix)
    assert got["total_scores", "", ""] == 0.666667 and np.isnan(got["auc", "ape", ""])
    order = sorted({(r.row_place, r.row_label) for r in back if r.metric == "accuracy"})
    assert [c for _, c in order] == names and [r.fold for r in back if r.metric == "total_scores"] == [3]


def test_frames_by_recording(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"r{k}", v, rng.normal(size=5).tolist()) for k in range(6) for v in range(10)]
    given = spark.createDataFrame(rows, "boldfile string, volume int, features array<double>")
    stored = frames.store_frames(given)
    wanted = spark.createDataFrame([("r1", 3, "a"), ("r1", 3, "b"), ("r4", 9, "a"), ("r9", 1, "a"), ("r0", -1, "a"), ("r0", 99, "a")], "boldfile string, volume_of_interest int, regressor_label string")
    key = lambda d: sorted((r.boldfile, r.volume_of_interest, r.regressor_label, np.round(r.features, 9).tolist()) for r in d.collect())
    want = key(patterns.slice_patterns(wanted, patterns.zscore(given)))
    sliced = frames.slice_stored(wanted, patterns.zscore(stored))
    assert key(sliced) == want and len(want) == 3
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (patterns.zscore(stored), patterns.detrend(stored), patterns.temporal_mean(stored)):
            assert not exchanges(df)
        moved = exchanges(frames.slice_stored(wanted, patterns.zscore(stored)))
        assert moved and not any("features" in x for x in moved)  # the rows alone
        assert any("features" in x for x in exchanges(patterns.slice_patterns(wanted, patterns.zscore(given))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(str, patterns.detrend(stored).select("boldfile", "volume").collect())) == sorted(map(str, given.select("boldfile", "volume").collect()))
    place = stored.inputFiles()[0].removeprefix("file://")
    frames.drop_frames(spark, stored)
    assert not os.path.exists(place)


def exchanges(df):
    """What each exchange of the plan moves: the text of its output and below."""
    out = []

    def walk(node):
        if node.nodeName() == "Exchange":
            out.append(node.output().mkString(","))
        children = node.children() if node.nodeName() != "AdaptiveSparkPlan" else None
        for k in range(children.size() if children is not None else 0):
            walk(children.apply(k))
        if children is None:
            walk(node.executedPlan())

    walk(df._jdf.queryExecution().executedPlan())
    return out
