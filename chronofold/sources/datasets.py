"""Example datasets by name: a registry in a JSON file, downloads that are checked before they count, and archives unpacked inside their folder only.

An entry has local_path and source_url, or local_path, download_method "kaggle" and kaggle_dataset; sha256 and extract_dir are optional. Files go to a folder
on the machine that asks, from which they are read or copied to a store that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterator, Mapping
from pathlib import Path, PurePosixPath


def load_registry(path: str | Path) -> dict[str, dict]:
    """The entries of a registry by name."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not found:
        raise ValueError("a registry is an object with an entry at least")
    return found


def dataset_names(path: str | Path) -> list[str]:
    return sorted(load_registry(path))


def download_dataset(name: str, registry_path: str | Path, data_root: str | Path, *, force: bool = False, extract: bool = False) -> dict[str, str]:
    """Fetch a dataset unless it is there, check it, and with extract unpack it: name, status ("downloaded" or "exists"), path, extracted_to."""
    registry = load_registry(registry_path)
    if name not in registry:
        raise KeyError(f"no dataset {name!r}; there are {', '.join(sorted(registry))}")
    entry, root = registry[name], Path(data_root)
    target = _below(root, str(entry["local_path"]))
    fresh = force or not target.exists()
    if fresh:
        target.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=target.parent) as folder:
            got = _by_kaggle(entry, Path(folder)) if entry.get("download_method") == "kaggle" else _by_url(entry["source_url"], Path(folder))
            _check(got, entry.get("sha256"))
            os.replace(got, target)
    else:
        _check(target, entry.get("sha256"))
    unpacked = _unpack(target, root, entry) if extract else ""
    return {"name": name, "status": "downloaded" if fresh else "exists", "path": str(target), "extracted_to": str(unpacked)}


def _below(root: Path, relative: str) -> Path:
    parts = PurePosixPath(relative.replace("\\", "/"))
    if parts.is_absolute() or ".." in parts.parts or not parts.parts:
        raise ValueError(f"{relative!r} is no path below the data folder")
    return root.joinpath(*parts.parts)


def _pieces(source, size: int = 1 << 20) -> Iterator[bytes]:
    while piece := source.read(size):
        yield piece


def _by_url(url: str, folder: Path) -> Path:
    with urllib.request.urlopen(url) as source, open(folder / "download", "wb") as out:
        out.writelines(_pieces(source))
    return folder / "download"


def _by_kaggle(entry: Mapping, folder: Path) -> Path:
    if not entry.get("kaggle_dataset"):
        raise ValueError("an entry of kaggle's names its kaggle_dataset")
    try:
        subprocess.run(["kaggle", "datasets", "download", "-d", entry["kaggle_dataset"], "-p", str(folder)], check=True)
    except FileNotFoundError as missing:
        raise RuntimeError("the kaggle command isn't installed") from missing
    except subprocess.CalledProcessError as failed:
        raise RuntimeError("kaggle gave no file: are its credentials set?") from failed
    archives = list(folder.glob("*.zip"))
    if len(archives) != 1:
        raise RuntimeError(f"kaggle gave {len(archives)} archives, not one")
    return archives[0]


def _check(path: Path, expected: str | None) -> None:
    if expected:
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            for piece in _pieces(f):
                digest.update(piece)
        if digest.hexdigest() != expected.lower():
            raise ValueError(f"{path.name} has another sha256 than its entry says")


def _unpack(archive: Path, root: Path, entry: Mapping) -> Path:
    if archive.suffix.lower() != ".zip" or not entry.get("extract_dir"):
        raise ValueError("only a .zip whose entry has an extract_dir is unpacked")
    folder = _below(root, str(entry["extract_dir"]))
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():  # all names before the first file is written
            if member.strip("/"):
                _below(folder, member)
        folder.mkdir(parents=True, exist_ok=True)
        z.extractall(folder)
    return folder
