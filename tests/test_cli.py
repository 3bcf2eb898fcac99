from sonolith.__main__ import main
from sonolith.sources import audio


def test_commands(spark, tmp_path, capsys):
    assert main(["tone", f"{tmp_path}/a", "--hz", "500", "--seconds", "0.1", "--rate", "8000"]) == 0
    assert main(["convert", f"{tmp_path}/a", f"{tmp_path}/b", "--rate", "16000", "--channels", "2", "--codec", "flac"]) == 0
    r = audio.read(spark, f"{tmp_path}/b").first()
    assert (r.codec, r.channels, r.sample_rate, r.frames) == ("flac", 2, 16_000, 1600)
    assert main(["normalize", f"{tmp_path}/a", f"{tmp_path}/c", "--db", "-6"]) == 0 and main(["trim", f"{tmp_path}/a", f"{tmp_path}/d"]) == 0
    assert max(audio.read(spark, f"{tmp_path}/c").first()["samples"]) < 16_500
    (tmp_path / "s.json").write_text('{"tracks": [{"name": "d", "pattern": "x-x-"}]}')
    assert main(["timeline", f"{tmp_path}/s.json"]) == 0 and capsys.readouterr().out.count('"kind":"trigger"') == 2
    assert main(["formats"]) == 0 and main(["info", f"{tmp_path}/a"]) == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.wav").write_bytes(b"BROKEN")
    assert main(["trim", f"{tmp_path}/bad", f"{tmp_path}/e"]) == 1


def test_chain_render_and_doctor(spark, tmp_path, capsys):
    assert main(["tone", f"{tmp_path}/a", "--hz", "500", "--seconds", "0.05", "--rate", "8000"]) == 0
    assert main(["chain", f"{tmp_path}/a", f"{tmp_path}/b", "--effect", "delay:time=0.01,mix=0.5", "--effect", "compressor"]) == 0
    assert audio.read(spark, f"{tmp_path}/b").first().frames > 400
    (tmp_path / "s.json").write_text('{"tracks": [{"name": "n", "notes": "C4 E4"}], "sample_rate": 8000, "tempo": 240}')
    assert main(["render", f"{tmp_path}/s.json", f"{tmp_path}/c"]) == 0 and audio.read(spark, f"{tmp_path}/c").first().channels == 2
    (tmp_path / "t.json").write_text('{"tracks": [{"name": "n"}]}')
    assert main(["render", f"{tmp_path}/t.json", f"{tmp_path}/d"]) == 1 and main(["doctor"]) == 0
    assert "missing: nothing" in capsys.readouterr().out
