"""Generations of a topic model on disk: each checked by hash, the last ones kept, training resumed from the newest sound one."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
from pyarrow import fs

from .lda import TopicModel


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _generations(system: fs.FileSystem, root: str) -> list[int]:
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(f.base_name[4:-5]) for f in found if f.base_name.startswith("gen-") and f.base_name.endswith(".json"))


def save(model: TopicModel, folder: str, generation: int, keep: int = 2) -> None:
    """Write the arrays, then the manifest that names their hash, then drop generations older than the last `keep`."""
    system, root = _system(folder)
    system.create_dir(root, recursive=True)
    buffer = io.BytesIO()
    np.savez(buffer, lam=model.lam, alpha=model.alpha, history=np.array(model.history))
    data = buffer.getvalue()
    with system.open_output_stream(f"{root}/gen-{generation}.npz") as f:
        f.write(data)
    manifest = {"generation": generation, "sha256": hashlib.sha256(data).hexdigest(), "words": model.words, "checks": model.checks}
    with system.open_output_stream(f"{root}/gen-{generation}.json") as f:
        f.write(json.dumps(manifest).encode())
    for old in _generations(system, root)[:-keep]:
        system.delete_file(f"{root}/gen-{old}.json")
        system.delete_file(f"{root}/gen-{old}.npz")


def restore(folder: str) -> tuple[int, TopicModel] | None:
    """The newest generation whose arrays match their hash, or None."""
    system, root = _system(folder)
    for generation in reversed(_generations(system, root)):
        try:
            with system.open_input_stream(f"{root}/gen-{generation}.json") as f:
                manifest = json.loads(f.read())
            with system.open_input_stream(f"{root}/gen-{generation}.npz") as f:
                data = f.read()
        except (OSError, ValueError):
            continue
        if hashlib.sha256(data).hexdigest() == manifest["sha256"]:
            arrays = np.load(io.BytesIO(data))
            return generation, TopicModel(arrays["lam"], arrays["alpha"], manifest["words"], arrays["history"].tolist(), manifest.get("checks", []))
    return None
