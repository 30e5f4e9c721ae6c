"""Backups: the manifest and the files of one pinned version in an archive."""

from __future__ import annotations

import datetime as dt
import os
import tarfile
import tempfile
from dataclasses import replace
from typing import TYPE_CHECKING

from siltstone.model import StoreIOError
from siltstone.sources.files import Files
from siltstone.sources.manifest import ManifestLog

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

    from siltstone.sources.store import Store


def export(store: Store, folder: str) -> str:
    """Writes go on meanwhile: the version's files can't change and its pin keeps them."""
    pin = store.pin()
    name = os.path.join(folder, f"siltstone-{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%fZ}.tar.gz")
    try:
        with tempfile.TemporaryDirectory() as work, tarfile.open(f"{name}.tmp", "w:gz") as tar:
            plain = replace(pin.manifest, dirt=())
            for i, (path, data) in enumerate([(ManifestLog.name(plain.version), plain.to_json()), *((f.path, None) for f in plain.files)]):
                local = os.path.join(work, str(i))
                if data is None:
                    store.files.fetch(path, local)
                else:
                    with open(local, "wb") as out:
                        out.write(data)
                tar.add(local, path)
                os.remove(local)
        os.replace(f"{name}.tmp", name)
    except OSError as e:
        raise StoreIOError("export", name, e) from e
    finally:
        pin.release()
    return name


def unpack(spark: SparkSession, archive: str, data_dir: str) -> None:
    """Lay an archive out as a store's folder, which must not hold one yet."""
    files = Files(spark, data_dir)
    if any(n.endswith(".json") for n, _, _ in files.names("manifest")):
        raise StoreIOError("import", data_dir, "there is a store already")
    with tempfile.TemporaryDirectory() as work, tarfile.open(archive) as tar:
        tar.extractall(work, filter="data")
        for top, _, names in sorted(os.walk(work), reverse=True):  # segments before the manifest
            for n in names:
                if not n.endswith(".crc"):
                    files.put(os.path.join(top, n), os.path.relpath(os.path.join(top, n), work))
