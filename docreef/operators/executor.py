"""Carries a plan out. Plans are data; only this touches files."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreef.shared import written


class FolderBackend:
    """A remote store stood in for by a folder: one sub-folder a container; a file's id is its path below the root, as
    ``docreef_listing`` gives it."""

    def __init__(self, remote_root: str, local_root: str):
        self.remote_root, self.local_root = remote_root, local_root

    @staticmethod
    def _below(root: str, *parts: str) -> str:
        path = os.path.normpath(os.path.join(root, *parts))
        if not path.startswith(os.path.normpath(root) + os.sep):
            raise ValueError(f"{path} is not below {root}")
        return path

    def _put(self, source: str, target: str) -> None:
        """Whole or not at all: readers see the old file or the new one."""
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            if not os.path.isdir(os.path.dirname(target)):
                os.makedirs(os.path.dirname(target), exist_ok=True)
            shutil.copyfile(source, part)
            os.replace(part, target)
        except BaseException:
            if os.path.exists(part):
                os.remove(part)
            raise

    def upload(self, container: str, name: str, path: str) -> None:
        self._put(path, self._below(self.remote_root, container, name))

    #: An update replaces in one step, so a failure leaves the old version in place.
    update = upload

    def download(self, container: str, name: str, remote_id: str) -> None:
        self._put(self._below(self.remote_root, remote_id), self._below(self.local_root, container, name))

    def delete(self, remote_id: str) -> None:
        """Removes a remote file; one that is gone already is as wanted."""
        path = self._below(self.remote_root, remote_id)
        if os.path.exists(path):
            os.remove(path)

    def create_folder(self, path: str) -> None:
        os.makedirs(self._below(self.remote_root, path), exist_ok=True)


def _act(backend: FolderBackend, row) -> None:
    if row.action == "DOWNLOAD":
        backend.download(row.container, row.name, row.remote_id)
    elif row.action == "DELETE":
        backend.delete(row.remote_id)
    elif row.action == "CREATE":
        backend.create_folder(row.name)
    elif row.action == "UPLOAD":
        backend.upload(row.container, row.name, row.local_path)
    else:
        backend.update(row.container, row.name, row.local_path)


def execute(plan: DataFrame, backend: FolderBackend | None = None) -> DataFrame:
    """(container, name, action, ok, error) of every action but NOOP; without a backend a dry run.

    The actions are carried out here, once; the report is a written table, so looking at it acts no more. A task that
    runs again overwrites with the same content. Whatever an action fails with is reported and stops no other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            errors = []
            for row in pdf.itertuples(index=False):
                error = None
                if backend is not None:
                    try:
                        _act(backend, row)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                errors.append(error)
            yield pd.DataFrame({"container": pdf["container"], "name": pdf["name"], "action": pdf["action"], "ok": [e is None for e in errors], "error": pd.Series(errors, dtype=object)})

    todo = plan.where(F.col("action") != "NOOP").select("container", "name", "action", "local_path", "remote_id")
    return written(todo.mapInPandas(run, "container string, name string, action string, ok boolean, error string"), "executed")
