"""Datasets of a registry, fetched from files of a temporary folder."""

import hashlib
import json
import zipfile

import pytest

from chronofold.sources import datasets


@pytest.fixture
def registry(tmp_path):
    (tmp_path / "x.csv").write_text("timestamp,value\n1,2\n")
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("folder/example.csv", "a\n1\n")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../outside.csv", "a")
    url = lambda name: (tmp_path / name).as_uri()
    sha = hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()
    entries = {
        "z": {"source_url": url("x.csv"), "local_path": "a/x.csv", "sha256": sha}, "wrong": {"source_url": url("x.csv"), "local_path": "b.csv", "sha256": "0" * 64},
        "good": {"source_url": url("good.zip"), "local_path": "g/good.zip", "extract_dir": "g/out"}, "bad": {"source_url": url("bad.zip"), "local_path": "bad.zip", "extract_dir": "bad"},
        "up": {"source_url": url("x.csv"), "local_path": "../x.csv"}, "kaggle": {"download_method": "kaggle", "kaggle_dataset": "o/d", "local_path": "k/d.zip"},
    }
    (tmp_path / "registry.json").write_text(json.dumps(entries))
    return tmp_path / "registry.json"


def test_download_and_unpack(registry, tmp_path):
    get = lambda name, **k: datasets.download_dataset(name, registry, tmp_path / "data", **k)
    assert datasets.dataset_names(registry) == ["bad", "good", "kaggle", "up", "wrong", "z"]
    first = get("z")
    assert first["status"] == "downloaded" and get("z")["status"] == "exists" and get("z", force=True)["status"] == "downloaded"
    assert open(first["path"]).read().startswith("timestamp")
    assert (tmp_path / "data/g/out/folder/example.csv").exists() or get("good", extract=True) and (tmp_path / "data/g/out/folder/example.csv").exists()
    with pytest.raises(KeyError):
        get("absent")
    for name, more in (("wrong", {}), ("up", {}), ("bad", {"extract": True}), ("z", {"extract": True})):
        with pytest.raises(ValueError):
            get(name, **more)
    assert not (tmp_path / "data/b.csv").exists() and not (tmp_path / "data/outside.csv").exists()
    (tmp_path / "empty.json").write_text("{}")
    with pytest.raises(ValueError):
        datasets.load_registry(tmp_path / "empty.json")


def test_kaggle(registry, tmp_path, monkeypatch):
    def run(command, check):
        folder = command[command.index("-p") + 1]
        zipfile.ZipFile(f"{folder}/any.zip", "w").close()

    monkeypatch.setattr(datasets.subprocess, "run", run)
    assert datasets.download_dataset("kaggle", registry, tmp_path / "data")["path"].endswith("k/d.zip")
    monkeypatch.setattr(datasets.subprocess, "run", lambda command, check: (_ for _ in ()).throw(FileNotFoundError()))
    with pytest.raises(RuntimeError):
        datasets.download_dataset("kaggle", registry, tmp_path / "data", force=True)
