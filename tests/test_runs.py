"""Files in, reports and files out."""

import io
import json
import os
import sys

import pytest

from quillsieve import cli
from quillsieve.functions import settings as options, translate
from quillsieve.sources import files, runs, sink


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.MD").write_text("a​b", "utf-8")
    (tmp_path / ".hidden.txt").write_text("plain", "utf-8")
    (tmp_path / "sub" / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "sub" / "big.txt").write_text("x" * 100)
    (tmp_path / "sub" / "x.svg").write_text("<svg><!-- c --></svg>")
    (tmp_path / "node_modules" / "n.md").write_text("​")
    os.symlink(tmp_path / "a.MD", tmp_path / "link.md")
    return tmp_path


def test_listing(tree):
    how = options.defaults()
    names = [(k, os.path.relpath(p, tree)) for k, p in files.listed([str(tree), str(tree / "none")], how)]
    assert names == [("missing", "none"), ("text", ".hidden.txt"), ("text", "a.MD"), ("text", "sub/bad.txt"), ("text", "sub/big.txt"), ("image", "sub/x.svg")]


def test_fix(spark, tree):
    how = options.checked({"max_file_bytes": 50})
    checked = runs.scan(spark, [str(tree)], how, write=False)
    assert (tree / "a.MD").read_text("utf-8") == "a​b"
    assert [r["changed"] for r in checked] == [False, True, False, False, True]
    reports = {os.path.basename(r["path"]): r for r in runs.scan(spark, [str(tree), str(tree / "none")], how, write=True)}
    assert (tree / "a.MD").read_text("utf-8") == "ab"
    assert (tree / "a.MD.bak").read_text("utf-8") == "a​b"
    assert (tree / "sub" / "x.svg").read_text() == "<svg></svg>"
    assert reports["bad.txt"]["findings"][0]["message"] == "skipped (not utf-8 text)"
    assert "larger" in reports["big.txt"]["findings"][0]["message"]
    assert reports["none"]["findings"][0]["message"] == "path not found"
    assert runs.summarised(list(reports.values())).startswith("6 files scanned  |  2 changed")


def test_links_are_refused(spark, tree):
    reports = runs.scan(spark, [str(tree / "link.md")], options.defaults(), write=True)
    assert not reports[0]["changed"] and reports[0]["findings"][-1]["message"].startswith("refused")
    assert (tree / "a.MD").read_text("utf-8") == "a​b"


def test_replace_file(tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("one")
    path.chmod(0o640)
    sink.replace_file(str(path), b"two")
    sink.replace_file(str(path), b"three")
    assert path.read_bytes() == b"three" and (tmp_path / "f.txt.bak").read_text() == "one"
    assert path.stat().st_mode & 0o777 == 0o640 and len(list(tmp_path.iterdir())) == 2


@pytest.mark.parametrize("bad", [{"voice": 1}, {"layers": "x"}, {"normalize_form": "X"}, {"dash_policy": {"a": 1}}, {"max_file_bytes": True}, {"max_file_bytes": 0}])
def test_bad_settings(bad, tmp_path):
    (tmp_path / "quillsieve.config.json").write_text(json.dumps(bad))
    with pytest.raises(options.SettingsError):
        options.load(start=str(tmp_path))


def test_settings_are_found_above(tmp_path):
    (tmp_path / ".quillsieverc").write_text('{"voice": false, "unknown": 1}')
    (tmp_path / "a" / "b").mkdir(parents=True)
    how = options.load(start=str(tmp_path / "a" / "b"))
    assert how["voice"] is False and how["unknown"] == 1


def test_pipe(monkeypatch, capsysbinary):
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO("a​b".encode())}))
    assert cli.main(["fix", "-", "--quiet"]) == 0
    assert capsysbinary.readouterr().out.startswith(b"ab")
    assert cli.main(["check", "-", "x"]) == 2
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(b"we delve into it")}))
    assert cli.main(["check", "-", "--json"]) == 1
    assert json.loads(capsysbinary.readouterr().out)["reports"][0]["counts"]["error"] == 1


def test_gate():
    block, change = {"findings": [{"severity": "error"}], "changed": False}, {"findings": [], "changed": True}
    assert [runs.exit_code([block], s, w) for s in (False, True) for w in (False, True)] == [1, 0, 1, 1]
    assert [runs.exit_code([change], s, w) for s in (False, True) for w in (False, True)] == [0, 0, 1, 0]


def test_translation():
    calls = []

    def client(text, target, source):
        calls.append((text, target, source))
        return f"{text}>{target}", "DE"

    assert translate.back_and_forth("x", client) == "x>EN>DE" and calls[1] == ("x>EN", "DE", "EN")
    with pytest.raises(translate.TranslationError):
        translate.back_and_forth("x", client, source="EN-GB")
    with pytest.raises(translate.TranslationError):
        translate.back_and_forth("x", lambda *a: ("y", None))


def test_staged_files(spark, tmp_path, monkeypatch, capsys):
    import subprocess

    git = lambda *words: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@e", *words], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    for name in ("ä b.md", "part.txt", "other.bin", "later.md"):
        (tmp_path / name).write_text("one\u200btwo", "utf-8")
    git("add", "ä b.md", "part.txt", "other.bin")
    (tmp_path / "part.txt").write_text("one\u200btwo three", "utf-8")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["staged"]) == 0
    assert "1 of 1" in capsys.readouterr().out
    assert git("show", ":ä b.md") == "onetwo" and not (tmp_path / "ä b.md.bak").exists()
    assert git("show", ":part.txt") == "one\u200btwo" and (tmp_path / "later.md").read_text("utf-8") == "one\u200btwo"
    monkeypatch.chdir("/")
    assert cli.main(["staged"]) == 0


def test_gate_command(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("one\u200btwo, without further ado.", "utf-8")
    assert cli.main(["gate", str(tmp_path)]) == 0
    assert (tmp_path / "a.md").read_text("utf-8") == "onetwo, without further ado."
    (tmp_path / "b.md").write_text("We delve into it.", "utf-8")
    assert cli.main(["gate", str(tmp_path)]) == 1 and "delve into" in capsys.readouterr().out


def test_packaging_names_what_there_is():
    import tomllib
    from importlib import import_module
    from pathlib import Path

    made = tomllib.loads((Path(cli.__file__).parent.parent / "pyproject.toml").read_text())
    module, _, name = made["project"]["scripts"]["quillsieve"].partition(":")
    assert callable(getattr(import_module(module), name))


def test_folders_named_by_a_uri(spark, tree):
    base = f"file://{tree}"
    names = [(k, p.removeprefix(base + "/")) for k, p in files.listed([base, f"{base}/none", f"{base}/a.MD"], options.defaults())]
    assert names == [("missing", "none"), ("text", ".hidden.txt"), ("text", "link.md"), ("text", "sub/bad.txt"), ("text", "sub/big.txt"), ("text", "a.MD"), ("image", "sub/x.svg")]
    os.unlink(tree / "link.md")
    reports = {r["path"]: r for r in runs.scan(spark, [base], options.checked({"max_file_bytes": 50}), write=True)}
    assert reports[f"{base}/a.MD"]["changed"] and (tree / "a.MD").read_text("utf-8") == "ab" and (tree / "a.MD.bak").read_text("utf-8") == "a\u200bb"
    assert "larger" in reports[f"{base}/sub/big.txt"]["findings"][0]["message"] and (tree / "sub" / "x.svg").read_text() == "<svg></svg>"
    assert not [n for n in os.listdir(tree) if n.endswith(".new")]


def test_a_folder_is_looked_through_once(tmp_path, monkeypatch):
    import pyarrow as pa

    from quillsieve.plans import casebook

    paths = [tmp_path / f"{i}.txt" for i in range(50)]
    for path in paths:
        path.write_text("x")
    calls = []
    for name in ("listdir", "scandir"):
        real = getattr(os, name)
        monkeypatch.setattr(os, name, lambda at=".", real=real: calls.append(at) or real(at))
    (got,) = casebook._got(iter([pa.RecordBatch.from_arrays([pa.array(map(str, paths))], ["path"])]))
    assert len(calls) == 1 and got.to_pylist()[49] == {"path": str(paths[49]), "now": b"x", "before": None, "mode": paths[49].stat().st_mode & 0o777, "tidy": True}
    (tmp_path / ".left.new").write_text("x")
    assert not next(casebook._got(iter([got.select(["path"])]))).to_pylist()[0]["tidy"]


def test_outcomes_are_as_reports(spark, tree):
    (tree / "a.svg").symlink_to(tree / "sub" / "x.svg")
    (tree / "b.svg").write_bytes(b"\xff\xfe")
    (tree / "c.svg").write_text("<svg/>")
    os.makedirs(tree / "in")
    (tree / "in" / "l.svg").symlink_to(tree / "sub" / "x.svg")
    (tree / "in" / "l.md").symlink_to(tree / "a.MD")
    named, how = [str(tree / "in"), str(tree), str(tree / "none")], options.checked({"max_file_bytes": 50})
    before = {r["path"]: r for r in runs.scan(spark, named, how, write=False)}
    checked = {r.path: (r.changed, r.message) for r in runs.outcomes(spark, named, how, False).collect()}
    assert checked == {p: (r["changed"], next((f["message"] for f in r["findings"] if f["layer"] == "io"), "")) for p, r in before.items()}
    done = {os.path.relpath(r.path, tree): (r.changed, r.message) for r in runs.outcomes(spark, named, how, True).collect()}
    assert done == {
        "none": (False, "path not found"), ".hidden.txt": (False, ""), "in/l.md": (False, "refused to write through symlink"), "sub/bad.txt": (False, "skipped (not utf-8 text)"), "sub/big.txt": (False, "skipped (larger than max_file_bytes)"),
        "in/l.svg": (False, "refused to write through symlink"), "b.svg": (False, "skipped (not utf-8 text)"), "c.svg": (False, ""),
    }


def test_real_paths(tree):
    (tree / "down").symlink_to(tree / "sub")
    folders = {}
    for path in (tree / "link.md", tree / "down" / "x.svg", tree / "sub" / "x.svg", tree / "sub" / ".." / "a.MD", tree / "none" / "x"):
        assert files._real(str(path), folders) == os.path.realpath(path)
