import json

from maldure import cli


def test_evaluate_then_build_the_board(spark, tmp_path):
    results, out = str(tmp_path / "results"), str(tmp_path / "board")
    assert cli.main(["evaluate", "--output_dir", results, "--normalization_preset", "strict", "--save_predictions"], spark) == 0
    assert cli.main(["evaluate", "--output_dir", results, "--limit", "2"], spark) == 0
    (tmp_path / "rows.json").write_text(json.dumps([{"run_id": "old", "model": "mock", "dataset": "mock", "is_full_evaluation": True, "metrics": {"macro": {"cer": 0.3}}, "command": "python C:\\a\\tool\\main.py"}, {"run_id": "x", "model": "m", "dataset": "d", "is_full_evaluation": True}]))
    assert cli.main(["board", "--results_dir", results, "--curated", str(tmp_path / "rows.json"), "--output_dir", out], spark) == 0
    rows = json.loads((tmp_path / "board/leaderboard.json").read_text())
    assert [r["model"] for r in rows] == ["mock", "m"] and rows[0]["total_samples"] == 3 and rows[0]["metrics"]["macro"]["cer"] == 0
    assert json.loads((tmp_path / "board/metadata.json").read_text())["row_count"] == 2
    assert cli.main(["validate", str(tmp_path / "board/leaderboard.json")], spark) == 1


def test_validation_of_files(spark, tmp_path, capsys):
    path = tmp_path / "x.json"
    assert cli.main(["validate", str(path)], spark) == 1
    path.write_text("{")
    assert cli.main(["validate", str(path)], spark) == 1
    path.write_text("[]")
    assert cli.main(["validate", str(path)], spark) == 0
    assert "missing file" in capsys.readouterr().out


def test_a_manifest_is_evaluated_on_its_audio(spark, tmp_path, capsys):
    import wave

    import pytest

    for name, channels, rate in (("a.wav", 1, 8000), ("b.wav", 2, 16000)):
        with wave.open(str(tmp_path / name), "wb") as file:
            file.setnchannels(channels), file.setsampwidth(2), file.setframerate(rate)
            file.writeframes(b"\1\0" * 8000 * channels)
    (tmp_path / "c.pcm").write_bytes(b"\1\0" * 4000)
    lines = [{"id": "a", "audio_path": "a.wav", "text": "x"}, {"id": "b", "audio_path": "b.wav", "text": "y"}, {"id": "c", "audio_path": "c.pcm", "text": "z", "sample_rate": 8000}]
    manifest = tmp_path / "m.jsonl"
    manifest.write_text("\n".join(map(json.dumps, lines)))
    args = ["evaluate", "--dataset_name", "manifest", "--manifest", str(manifest), "--output_dir", str(tmp_path / "results")]
    assert cli.main(args, spark) == 0
    found = [json.loads(x) for p in (tmp_path / "results").glob("*/samples.jsonl/part-*") for x in p.read_text().splitlines()]
    assert {r["sample_id"]: (r["audio_duration"], r["sample_rate"]) for r in found} == {"a": (1.0, 8000), "b": (0.5, 16000), "c": (0.5, 8000)}
    assert all(r["metrics"]["rtf"] is not None for r in found)
    [folder] = (tmp_path / "results").glob("2*")
    board, summary = (json.loads((folder / f"{x}.json").read_text()) for x in ("leaderboard_row", "summary"))
    assert list(summary) == ["metadata", "aggregate", "model_metrics"] and summary["aggregate"]["total_samples"] == 3 and summary["metadata"]["environment"]["python"]
    assert [r["index"] for r in sorted(found, key=lambda r: r["sample_id"])] == [0, 1, 2] and {r["metadata"]["audio_path"].rsplit("/", 1)[1] for r in found} == {"a.wav", "b.wav", "c.pcm"}
    assert not list((tmp_path / "results").glob(".staged*"))
    # what validation finds is true: a mock model, and no tokenizer for morphemes
    (tmp_path / "rows.json").write_text(json.dumps([board]))
    capsys.readouterr()
    assert cli.main(["validate", str(tmp_path / "rows.json")], spark) == 1
    assert capsys.readouterr().out.splitlines() == [f"{tmp_path}/rows.json[0]: {x}" for x in ("metrics.macro.mer", "mock")]
    manifest.write_text(json.dumps({"audio_path": "none.wav", "text": "x"}))
    with pytest.raises(Exception, match="none.wav"):
        cli.main(args, spark)


def wav(n, rate=8000):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1), file.setsampwidth(2), file.setframerate(rate)
        file.writeframes(b"\1\0" * n)
    return out.getvalue()


def telephone(folder, domains=("D01", "D02", "D03", "D04")):
    import zipfile

    folder.mkdir()
    for domain in domains:
        with zipfile.ZipFile(folder / f"VL_{domain}.zip", "w") as labels, zipfile.ZipFile(folder / f"VS_{domain}.zip", "w") as sounds:
            labels.writestr(f"{domain}/J01/0001.txt", "o/ 여보세요.")
            sounds.writestr(f"{domain}/J01/0001.wav", wav(4000))


def test_archives_and_transcripts(spark, tmp_path):
    telephone(tmp_path / "zips")
    (tmp_path / "kspon/PCM").mkdir(parents=True)
    (tmp_path / "kspon/PCM/a.pcm").write_bytes(b"\1\0" * 8000)
    (tmp_path / "kspon/eval_clean.trn").write_text("PCM/a.pcm :: (5대)/(다섯 대) 있다\n")
    out = tmp_path / "results"
    assert cli.main(["evaluate", "--dataset_name", "AIHubLowQualityTelephone", "--dataset_subset", "D02", "--dataset_rootpath", str(tmp_path / "zips"), "--output_dir", str(out / "a"), "--warmup_samples", "1", "--save_predictions", "--num_workers", "2"], spark) == 0
    assert cli.main(["evaluate", "--dataset_name", "KsponSpeech", "--dataset_subset", "clean", "--dataset_rootpath", str(tmp_path / "kspon"), "--output_dir", str(out / "b"), "--save_predictions"], spark) == 0
    found = {name: [json.loads(x) for p in (out / name).glob("*/samples.jsonl/part-*") for x in p.read_text().splitlines()] for name in "ab"}
    assert [(r["sample_id"], r["reference"], r["sample_rate"], r["audio_duration"]) for r in found["a"]] == [("D02/J01/0001", "o/ 여보세요.", 16000, 0.5)]
    assert [(r["reference"], r["audio_duration"]) for r in found["b"]] == [("다섯 대 있다", 0.5)]
    import pytest

    with pytest.raises(ValueError, match="AIHubLowQualityTelephone, KsponSpeech, manifest, mock"):
        cli.main(["evaluate", "--dataset_name", "none"], spark)


def test_matrix_rollup_and_scan(spark, tmp_path, capsys):
    from maldure.operators.inference import register_model

    register_model("fixed", repo="a/fixed", total_parameters=7)(lambda: lambda samples: ["여보" for _ in samples])
    telephone(tmp_path / "zips")
    common = ["matrix", "--kspon_root", "/none", "--aihub_telephone_root", str(tmp_path / "zips"), "--output_dir", str(tmp_path / "full"), "--models", "fixed", "--kspon_subsets", "--normalization_preset", "strict"]
    common = [x for x in common if x != "--kspon_subsets"] + ["--aihub_subsets", "D01", "D02", "D03"]
    common += ["--skip_existing"]
    assert cli.main([*common, "--dry_run", "--kspon_subsets", "clean"], spark) == 0
    assert capsys.readouterr().out.count("--model_name fixed") == 4 and not (tmp_path / "full").exists()
    for domain in ("D01", "D02", "D03"):
        assert cli.main(["evaluate", "--dataset_name", "AIHubLowQualityTelephone", "--dataset_subset", domain, "--dataset_rootpath", str(tmp_path / "zips"), "--model_name", "fixed", "--output_dir", str(tmp_path / "full")], spark) == 0
    assert cli.main(["rollup", "--results_dir", str(tmp_path / "full"), "--output_dir", str(tmp_path / "all")], spark) == 0
    assert "fixed: without D04" in capsys.readouterr().out and not (tmp_path / "all").exists()
    args = cli.parser().parse_args([*common, "--kspon_subsets", "clean"])
    args.kspon_subsets, args.aihub_subsets = [], ["D01", "D02", "D03", "D04"]
    assert args.function(spark, args) == 0
    assert capsys.readouterr().out.count("is done") == 3
    assert cli.main(["rollup", "--results_dir", str(tmp_path / "full"), "--output_dir", str(tmp_path / "all")], spark) == 0
    [path] = (tmp_path / "all").glob("*/leaderboard_row.json")
    row = json.loads(path.read_text())
    assert (row["model"], row["model_repo"], row["dataset"], row["subset"], row["total_samples"], row["dataset_total_samples"], row["is_full_evaluation"]) == ("fixed", "a/fixed", "AIHubLowQualityTelephone", "all", 4, 4, True)
    assert 0 < row["metrics"]["micro"]["cer"] < 1
    assert row["model_metrics"]["total_parameters"] == 7 and len(row["aggregation"]["source_run_ids"]) == 4
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo/a.txt").write_text("fine\ncd /mnt/c/x\n")
    assert cli.main(["scan", str(tmp_path / "repo")], spark) == 1 and "mount at column 4" in capsys.readouterr().out
