"""Effects on files: storing uploads by content and deleting stored files with the folders they leave empty."""

from __future__ import annotations

import hashlib
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame


def store_upload(root: str, payload: bytes, name: str, now: datetime) -> str:
    """root/yyyymmdd/hash.ext; where a file of that hash is stored already, that one's path (the first in order)."""
    digest = hashlib.sha256(payload).hexdigest()
    if there := sorted(str(p) for p in Path(root).rglob(f"{digest}.*")):
        return there[0]
    suffix = Path(name.replace("\\", "/")).suffix.lower()
    path = Path(root) / f"{now:%Y%m%d}" / f"{digest}{suffix}"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(payload)
    return str(path)


def delete_files(paths: list[str], root: str) -> int:
    """Deletes those of the paths that lie below root, and folders below it that are then empty; how many went."""
    base, gone = Path(root).resolve(), 0
    for path in (Path(p).resolve() for p in paths):
        if base not in path.parents or not path.is_file():
            continue
        path.unlink()
        gone += 1
        for folder in path.parents:
            if folder == base or any(folder.iterdir()):
                break
            folder.rmdir()
    return gone


def delete_entries(gone: DataFrame, root: str) -> int:
    """The files of deleted entries (a column of path lists), in the tasks that hold the rows, on storage that they share."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"n": [delete_files(list(x), root) for x in pdf["paths"]]})

    return gone.select("paths").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0
