from pyspark.sql import functions as F

from onsetlab.functions import volume_range
from onsetlab.operators import volumes as V
from onsetlab.sources import tables

EVENTS = "event_id int, subject string, task string, run int, trial_type string, onset double, duration double, boldfile string"


def _range(spark, start, stop, tr, n):
    first, after = volume_range(F.lit(start), F.lit(stop), F.lit(tr), F.lit(n))
    return tuple(spark.range(1).select(first, after).first())


def test_volume_range(spark):
    assert _range(spark, 0.0, 2.774, 0.46, 100) == (0, 6)
    assert _range(spark, 4.0, 4.0, 2.0, 20) == (2, 3)  # one frame at least
    assert _range(spark, 18.0, 30.0, 1.0, 20) == (18, 20)  # clipped at the end
    assert _range(spark, 50.0, 60.0, 1.0, 20) == (50, 50)  # beyond the recording
    assert _range(spark, -3.0, 0.0, 1.0, 20)[0] == -3  # the start isn't clipped
    assert _range(spark, 0.0, 2.5, 1.0, 20) == (0, 2)  # half to even


def test_build_volumes(spark):
    rows = [
        (1, "01", "t", 1, "face", 0.0, 2.0, "r"),
        (2, "01", "t", 1, "Fixation", 3.0, 2.0, "r"),
        (3, "01", "t", 1, "place", 6.0, None, "r"),
        (4, "01", "t", 1, "place", 9.0, 2.0, "r"),
        (5, "01", "t", 1, None, 12.0, 1.0, "r"),
        (6, "01", "t", 1, "place", float("inf"), 1.0, "r"),
    ]
    rec = spark.createDataFrame([("r", 1.0, 20)], "boldfile string, tr double, n_frames int")
    out = V.build_volumes(spark.createDataFrame(rows, EVENTS), rec).orderBy("volume_of_interest").collect()
    assert [(r.trial_index, r.volume_of_interest) for r in out] == [(1, 0), (1, 1), (2, 9), (2, 10), (3, 12)]


def test_entities_and_rejects(spark):
    files = spark.createDataFrame([("a/sub-01_task-x_run-02_task-y_bold.nii",), ("sub-01_task-x.nii",), ("sub-1_task-x_run-b_e.nii",)], "eventfile string")
    right, wrong = V.require_entities(V.parse_entities(files))
    assert [r.entities for r in right.collect()] == [{"sub": "01", "task": "y", "run": "02"}]
    assert sorted(r.reason for r in wrong.collect()) == ["missing run", "run is no number"]


def test_lookup_pivot_and_diff(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "eventfile string, subject string")
    recs = spark.createDataFrame([("1", "ra"), ("2", "rb"), ("2", "rc")], "subject string, boldfile string")
    one, other = V.recording_lookup(files, recs, ["subject"])
    assert [tuple(r) for r in one.collect()] == [("a", "ra")]
    assert sorted((r.eventfile, r.reason) for r in other.collect()) == [("b", "ambiguous"), ("c", "missing")]
    vols = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "trial_index int, volume_of_interest int")
    assert V.widest(vols, ["trial_index"]) == 2
    assert sorted(tuple(r) for r in V.trial_pivot(vols, ["trial_index"], 2).collect()) == [(1, 3, 5), (2, 9, None)]
    a = spark.createDataFrame([("x",), (None,), ("y",)], "trial_type string")
    b = spark.createDataFrame([("x",), ("z",)], "trial_type string")
    assert sorted(tuple(r) for r in V.expected_diff(a, b).collect()) == [("y", "unexpected"), ("z", "missing")]


def test_bad_rows_and_union(spark):
    v = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "volume_of_interest double")
    assert V.drop_bad_volumes(v).count() == 1
    a = spark.createDataFrame([("1", "t", 1, 2, "x")], "subject string, task string, run int, volume_of_interest int, acq string")
    b = spark.createDataFrame([("1", "t", 1, 1)], "subject string, task string, run int, volume_of_interest int")
    assert [r.acq for r in V.union_tables([a, b]).collect()] == [None, "x"]


def test_pivot_is_as_wide_as_the_widest_event(spark):
    vols = spark.createDataFrame([(1, k) for k in range(9, 0, -1)] + [(2, 5)], "trial_index int, volume_of_interest int")
    got = {r[0]: r[1:] for r in V.trial_pivot(vols, ["trial_index"]).collect()}
    assert got == {1: tuple(range(1, 10)), 2: (5, *[None] * 8)}
    assert V.trial_pivot(vols.limit(0), ["trial_index"]).columns == ["trial_index"]


def test_files_to_volumes(spark, tmp_path):
    """Event files of several headers, to the volume table and the skipped files, in one plan."""
    names = {"sub-01_task-x_run-01_dir-pa": "trial_type\tonset\tduration\nface\t2.0\t2.0\nFixation\t0\t1\nplace\t0.5\t1\n", "sub-01_ses-b_task-x_run-02": "onset\tduration\ttrial_type\n0\t1\tface\n", "sub-02_task-x": "onset\tduration\ttrial_type\n0\t1\tface\n", "sub-02_task-x_run-09": "onset\tduration\ttrial_type\n0\t1\tface\n", "sub-03_task-x_run-1": "onset\tduration\ttrial_type\n0\t1\tface\n"}
    for n, text in names.items():
        (tmp_path / f"{n}_events.tsv").write_text(text)
    bold = ["out/sub-01/sub-01_task-x_run-01_bold.nii.gz", "out/sub-01_ses-a_task-x_run-02_bold.nii.gz", "out/sub-01_ses-b_task-x_run-02_bold.nii.gz", "out/sub-03_task-x_run-1_bold.nii.gz", "out/sub-03_task-x_run-1_desc-y_bold.nii.gz", "out/sub-02_task-x_run-09_mask.nii.gz"]
    rec = spark.createDataFrame([(b, 1.0, 20) for b in bold], "boldfile string, tr double, n_frames int")
    volumes, skipped = V.study_volumes(tables.read_events(spark, str(tmp_path)), rec)
    got = sorted((r.subject, r.session, r.run, r.trial_type, r.trial_index, r.volume_of_interest, r.dir, r.boldfile) for r in volumes.collect())
    assert got == [("01", "", 1, "face", 2, 2, "pa", bold[0]), ("01", "", 1, "face", 2, 3, "pa", bold[0]), ("01", "", 1, "place", 1, 0, "pa", bold[0]), ("01", "b", 2, "face", 1, 0, None, bold[2])]
    assert sorted((r.eventfile.rsplit("/", 1)[1].removesuffix("_events.tsv"), r.reason) for r in skipped.collect()) == [("sub-02_task-x", "missing run"), ("sub-02_task-x_run-09", "missing"), ("sub-03_task-x_run-1", "ambiguous")]
    files = spark.createDataFrame([(f"{n}_events.tsv",) for n in names], "eventfile string")
    matched = V.match_recordings(files, rec, "**/sub-{subject}_task-{task}_run-{run}_bold.nii.gz").where("boldfile is not null").collect()
    assert sorted((r.eventfile, r.boldfile) for r in matched) == [("sub-01_task-x_run-01_dir-pa_events.tsv", bold[0]), ("sub-03_task-x_run-1_events.tsv", bold[3])]
