"""Recorder files through all stages, survey cleaning, and what the plans must look like."""

import pytest
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.operators import survey
from saccadia.plans import stages
from saccadia.plans.features import experiment_features, report_features
from saccadia.sources import logs, tables
from tests.conftest import plan_of


def write_logs(folder):
    """Two SHAPES recordings with three trials each and samples every 10 ms; participant 8 has the left eye only."""
    for p, eyes in ((7, "LR"), (8, "L")):
        lines, samples = ["** header", "MSG 1 TRIAL_VAR_LABELS shape time_elapsed"], []
        for t in range(3):
            at = 1000 + t * 10_000
            lines += [f"MSG {at} TRIALID {t}", f"START\t{at + 1}\tLEFT", f"MSG {at + 50} !V FIXPOINT 255 255 255 0 0 0 500 400",
                      "INPUT 5 5"]
            for i in range(6):
                s = at + 100 + i * 500
                eye = eyes[i % len(eyes)]
                lines += [f"SSACC {eye} {s}", f"ESACC {eye} {s} {s + 20} 20 {100 + i * 50}.5 200 {300 + i * 90} 250 4.5 120",
                          f"EFIX {eye} {s + 30} {s + 300} 270 {300 + i * 90}.0 {-5 if i == 5 else 250} 800"]
            lines += [f"MSG {at + 4000} !V TRIAL_VAR_DATA circle 3.5", f"END\t{at + 4000}\tSAMPLES"]
            for i in range(0, 500):
                n = at - 200 + i * 10
                left = ["960.5", "540.1", "800", "1.5", "0.5"] if i % 9 else [".", ".", ".", ".", "."]
                right = ["961.5", "541.1", "810", "1.25", "0.25"]
                if eyes == "LR":
                    row = [str(n), *left[:3], *right[:3], *left[3:], *right[3:], "30", "31", ".", "."]
                else:
                    row = [str(n), *left, "30", "31", ".", "."]
                samples.append("\t ".join(row))
        (folder / "events").mkdir(exist_ok=True)
        (folder / "samples").mkdir(exist_ok=True)
        (folder / "events" / f"Shapes_{p}_a.asc").write_text("\n".join(lines) + "\n")
        (folder / "samples" / f"Shapes_{p}_a.asc").write_text("\n".join(samples) + "\n")
    (folder / "events" / "Reaction_7_a.asc").write_text("MSG 1 TRIALID 0\n")


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("recordings")
    write_logs(folder)
    return folder


def test_parse_events(spark, recordings):
    rows = logs.extract_events(spark, str(recordings / "events"), "SHAPES")
    counts = {(r["participant_id"], r["event"]): r["count"] for r in rows.groupBy("participant_id", "event").count().collect()}
    assert counts[(7, "EFIX")] == 18 and counts[(8, "TRIALID")] == 3 and (7, "TRIAL_VAR_LABELS") not in counts
    data = rows.where("event = 'TRIAL_VAR_DATA' and participant_id = 7 and trial_id = 2").first()
    assert (data["shape"], data["time_elapsed"], data["side"]) == ("circle", "3.5", None)
    point = rows.where("event = 'FIXPOINT'").first()
    assert (point["colour"], point["stimulus_x"], point["stimulus_y"]) == (S.WHITE, 500.0, 400.0)
    fix = rows.where("event = 'EFIX' and participant_id = 8").orderBy("seq").collect()
    assert fix[0]["time"] is None and fix[0]["x"] == 300.0 and fix[5]["y"] is None and fix[0]["eye"] == "L"


def test_blocks_keep_the_line_order(spark, recordings):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        small = logs.extract_events(spark, str(recordings / "events"), "SHAPES")
        assert small.sparkSession.read.text(str(recordings / "events" / "Shapes_7_a.asc")).rdd.getNumPartitions() > 2
        split = sorted(map(str, small.drop("seq").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = sorted(map(str, logs.extract_events(spark, str(recordings / "events"), "SHAPES").drop("seq").collect()))
    assert split == whole


def test_stages_end_to_end(spark, recordings, tmp_path):
    out = {n: str(tmp_path / n) for n in ("raw", "clean", "prep", "raw_s", "prep_s", "features", "matrix")}
    only = ["SHAPES"]
    stages.extract_event_stage(spark, str(recordings / "events"), out["raw"], only)
    stages.clean_stage(spark, out["raw"], out["clean"], only)
    stages.preprocess_event_stage(spark, out["clean"], out["prep"], only)
    stages.extract_sample_stage(spark, str(recordings / "samples"), out["clean"], out["raw_s"], only)
    samples = tables.read_parquet(spark, out["raw_s"], experiment="SHAPES")
    assert set(samples.columns) == {*S.SAMPLE_TYPES, "seq"}
    sizes = {(r[0], r[1]): r[2] for r in samples.groupBy("participant_id", "trial_id").count().collect()}
    assert sizes == {(p, t): 400 for p in (7, 8) for t in range(3)}
    assert samples.where("participant_id = 8 and x_right is not null").count() == 0
    stages.preprocess_sample_stage(spark, out["raw_s"], out["prep_s"], only)
    stages.feature_stage(spark, out["prep"], out["prep_s"], out["features"], only)
    rows = {r["participant_id"]: r for r in spark.read.parquet(out["features"] + "/SHAPES").collect()}
    assert set(rows) == {7, 8} and rows[8]["Var_total"] is None and rows[7]["Var_total"] == pytest.approx(2.0)
    assert rows[7]["duration_mean_fix"] == 270.0 and rows[7]["fixations_per_second_mean"] > 0
    people = spark.createDataFrame([(7, 1), (9, 0)], "participant_id long, y int")
    table = stages.matrix_stage(spark, out["features"], people, out["matrix"], only)
    got = {r["participant_id"]: r["SHAPES_duration_mean_fix"] for r in table.collect()}
    assert got == {7: 270.0, 9: None}


def test_filters_reach_the_scan(spark, recordings, tmp_path):
    path = str(tmp_path / "events")
    stages.extract_event_stage(spark, str(recordings / "events"), path, ["SHAPES"])
    plan = plan_of(tables.read_parquet(spark, path, ["participant_id", "time"], "SHAPES", 7))
    assert "PushedFilters: [IsNotNull(participant_id), EqualTo(participant_id,7)]" in plan
    assert "PartitionFilters: [isnotnull(experiment" in plan and "stimulus_x" not in plan


def test_overwrite_keeps_other_experiments_and_append_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("A", 1)], "experiment string, v int")
    tables.write_parquet(one, path)
    tables.write_parquet(spark.createDataFrame([("B", 2)], "experiment string, v int"), path)
    tables.write_parquet(one, path, mode="append")
    assert sorted((r["experiment"], r["v"]) for r in spark.read.parquet(path).collect()) == [("A", 1), ("A", 1), ("B", 2)]
    tables.write_csv(one, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "experiment string, v int").first()["v"] == 1


def test_survey_steps(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "PATIENT", "x", None, "['1', '6']"), (1, "2024-03-01", "PATIENT", "y", None, "['2']"), (2, None, "CONTROL", None, "z", "[]")],
        "id int, date string, category string, `rivermead_1:0` string, `rivermead_1_control:0` string, `pain:0_position` string")
    merged = survey.merge_questions(survey.rename_topics(df), survey.CONTROL_QUESTIONS)
    assert merged.columns == ["id", "date", "category", "rivermead_1:0", "pain:0"]
    latest = survey.category_code(survey.latest_per_id(merged))
    rows = {r["id"]: r for r in survey.multi_hot(latest, "pain:0", "pain:", drop=["6"]).collect()}
    assert rows[1]["rivermead_1:0"] == "y" and rows[2]["rivermead_1:0"] == "z" and rows[1]["pain:2"] == 1 and rows[2]["category"] == 0
    assert survey.topic_columns(["pain:1", "reading:0", "pain:2"]) == {"pain": ["pain:1", "pain:2"], "reading": ["reading:0"]}


def test_clean_survey(spark):
    question = "reading:6_" + survey.REWORDED_QUESTIONS["reading:6"][0]
    other = "reading:6_" + survey.REWORDED_QUESTIONS["reading:6"][1]
    rows = [(i, f"2024-01-0{i + 1}", "PATIENT" if i % 2 else "CONTROL", "v", "ja" if i % 2 else None, None if i % 2 else "nej",
             None if i else "x", "['1', '6']" if i else "['2']") for i in range(4)]
    df = spark.createDataFrame([*rows, (1, "2024-02-01", "PATIENT", "v", "nu", None, None, "['2']")],
                               f"id int, date string, category string, version string, `{question}` string, `{other}` string, "
                               "`screen:1_x` string, `pain:0_position` string")
    done = {r["id"]: r.asDict() for r in survey.clean_survey(df).collect()}
    assert set(done) == {0, 1, 2, 3} and "screen:1" not in done[0]
    assert [done[i]["reading:6"] for i in range(4)] == ["nej", "nu", "nej", "ja"]
    assert done[1]["pain:2"] == 1 and done[2]["pain:1"] == 1 and "pain:6" not in done[2] and done[3]["category"] == 1


def test_feature_plans_stay_in_the_jvm(spark, sf):
    from workload import inputs, sample_queries

    events, samples = inputs.prepared_events(spark, sf, "SHAPES"), sample_queries.samples(spark, sf)
    plan = plan_of(experiment_features("SHAPES", events, samples))
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("experiment", ["ANTI_SACCADE", "KING_DEVICK"])
def test_report_features_run(spark, sf, experiment):
    from workload import inputs, sample_queries

    samples = sample_queries.samples(spark, sf).withColumn("experiment", F.lit(experiment))
    rows = report_features(experiment, inputs.prepared_events(spark, sf, experiment), samples, how="left", width=inputs.CHUNK)
    assert rows.count() > 0 and "Var_total" in rows.columns


def test_cleaning_shuffles_rows_once_per_side(spark, sf):
    from saccadia.operators.clean import clean_events
    from workload import inputs

    plan = plan_of(clean_events(inputs.gaze_events(spark, sf, "REACTION"), "REACTION"))
    assert plan.count("Exchange hashpartitioning") <= 3


def test_registry_is_consistent(spark, sf):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    first = entry.entry(spark)
    assert first.columns[:2] == ["experiment", "participant_id"] and first.count() > 0


def test_two_recordings_of_one_participant_have_one_numbering(spark, tmp_path):
    for part, trial in ((1, 4), (2, 5)):
        (tmp_path / f"Shapes_7_{part}.asc").write_text(
            f"MSG {part}00 TRIALID {trial}\nSTART {part}01 LEFT\nEFIX L {part}02 {part}09 7 1.0 2.0 3.0\nEND {part}10\n")
    events = logs.extract_events(spark, str(tmp_path), "SHAPES").collect()
    assert len(events) == 8 and sorted(r["seq"] for r in events) == list(range(8))
    assert [r["trial_id"] for r in sorted(events, key=lambda r: r["seq"])] == [4] * 4 + [5] * 4


def test_many_recordings_are_listed_as_one_folder_and_read_once(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"Shapes_{i}_a.asc").write_text(f"MSG 1 TRIALID {i}\nMSG 2 TRIALID {i + 1}\n")
    (tmp_path / "Reaction_7_a.asc").write_text("MSG 1 TRIALID 99\n")
    lines = logs.read_lines(spark, logs.log_paths(str(tmp_path), "SHAPES"))
    assert "InMemoryFileIndex(1 paths)" in plan_of(lines)
    events = logs.extract_events(spark, str(tmp_path), "SHAPES")
    assert "text" not in plan_of(events).lower().split("filescan ")[1][:8]
    assert sorted((r["participant_id"], r["trial_id"], r["seq"]) for r in events.collect()) == [(i, i + j, j) for i in range(40) for j in range(2)]
    with pytest.raises(FileNotFoundError):
        logs.read_lines(spark, logs.log_paths(str(tmp_path), "FITTS_LAW"))


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_lines_of_tasks_are_those_of_the_text_source(spark, tmp_path, monkeypatch, block):
    texts = {"Shapes_1_a b.asc": b"\xef\xbb\xbffirst\r\n\r\n second \rthird\n\nlast", "Shapes_2_a.asc": b"\n", "Shapes_3_%.asc": b"x" * 100 + b"\r\n" + b"y\r" * 9,
             "Shapes_4_a.asc": "umlaut ä\n".encode() + b"\xff\xfe\n", "Shapes_5_a.asc": b"", "Reaction_1_a.asc": b"other\n", "_Shapes_1.asc": b"hidden\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "Shapes_dir.asc").mkdir()
    monkeypatch.setattr(logs, "PIECE_BYTES", 8)
    path = logs.log_paths(str(tmp_path), "SHAPES")
    order = ["recording", "block", "position"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    want = logs.read_lines(spark, path).orderBy(*order).select("recording", "participant_id", F.hex("line")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        lines = logs.staged_lines(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert lines.orderBy(*order).select("recording", "participant_id", F.hex("line")).collect() == want and len(want) == 19
    assert lines.select("position").distinct().count() == len(want)
    assert block > 100 or lines.where("recording = 'Shapes_3_%25.asc'").select("block").distinct().count() > 1


def test_driver_lists_no_recordings(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"Shapes_{i}_a.asc").write_text(f"MSG 1 TRIALID {i}\n")

    def refuse(*_):
        raise AssertionError("files listed by the driver")

    monkeypatch.setattr(logs, "read_lines", refuse)
    events = logs.extract_events(spark, str(tmp_path), "SHAPES")
    assert sorted(r["trial_id"] for r in events.collect()) == list(range(30))
