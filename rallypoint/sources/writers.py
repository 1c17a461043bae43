"""One writer at a time: files that are put only where there is none, and fences that grow with each holder.

A writer holds a base folder by the fence file with the greatest number. It gets
the next number by putting a file that isn't there yet, which one of several can;
a fence that is released, or whose time is over (its holder crashed), may be
followed by the next. Before it commits, a writer looks whether a later fence
stands; if so it has been taken over and must not write.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

LEASE_SECONDS = 900.0


class Busy(RuntimeError):
    """Another writer holds the folder."""


class Fenced(RuntimeError):
    """Another writer has taken the folder over."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file whole, or leaves what is there and returns False; of several writers one succeeds.

    A local file is linked into place, which fails where one is; elsewhere the
    store's own exclusive creation decides.
    """
    files, place = _files(spark, path)
    files.mkdirs(place.getParent())
    where = urlsplit(path)
    if where.scheme in ("", "file"):
        own = f"{where.path}.{uuid.uuid4().hex}.tmp"
        hidden = os.path.join(os.path.dirname(own), "." + os.path.basename(own))
        with open(hidden, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(hidden, where.path)
        except FileExistsError:
            return False
        finally:
            os.unlink(hidden)
        return True
    if files.exists(place):
        return False
    try:
        out = files.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(content.encode())
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, folder: str) -> dict[str, dict]:
    """name and JSON content of the small files of a folder; none if there is no folder."""
    files, place = _files(spark, folder)
    if not files.exists(place):
        return {}
    out = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if not name.startswith("."):
            stream = files.open(status.getPath())
            try:
                out[name] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return out


@dataclass
class Writer:
    """The holder of a folder; use as a context, which releases it."""

    spark: SparkSession
    base: str
    fence: int
    owner: str
    clock: Callable[[], float] = time.time

    def check(self) -> None:
        """Raises Fenced if a later writer has taken over."""
        newest = max((int(n) for n in read_small(self.spark, f"{self.base}/fences")), default=0)
        if newest > self.fence:
            raise Fenced(f"{self.owner} holds fence {self.fence} of {self.base}, {newest} stands")

    def renew(self, seconds: float = LEASE_SECONDS) -> None:
        self.check()
        put_if_absent(self.spark, f"{self.base}/renewals/{self.fence:020d}-{uuid.uuid4().hex}", json.dumps({"fence": self.fence, "until": self.clock() + seconds}))

    def commit(self, path: str, content: dict) -> None:
        """Puts a commit file; raises Fenced if this writer isn't the last one or the commit is there already."""
        self.check()
        if not put_if_absent(self.spark, path, json.dumps(content | {"fence": self.fence})):
            raise Fenced(f"{path} is committed already")

    def release(self) -> None:
        put_if_absent(self.spark, f"{self.base}/released/{self.fence:020d}", "{}")

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def hold(spark: SparkSession, base: str, owner: str = "", seconds: float = LEASE_SECONDS, clock: Callable[[], float] = time.time) -> Writer:
    """Makes the caller the folder's writer; raises Busy while another one's lease runs."""
    fences = {int(n): x for n, x in read_small(spark, f"{base}/fences").items()}
    newest = max(fences, default=0)
    if newest and f"{newest:020d}" not in read_small(spark, f"{base}/released"):
        until = max([fences[newest]["until"], *(x["until"] for x in read_small(spark, f"{base}/renewals").values() if x["fence"] == newest)])
        if clock() < until:
            raise Busy(f"{fences[newest]['owner']} writes to {base}")
    owner = owner or uuid.uuid4().hex
    if not put_if_absent(spark, f"{base}/fences/{newest + 1:020d}", json.dumps({"owner": owner, "until": clock() + seconds})):
        raise Busy(f"another writer was first at {base}")
    return Writer(spark, base, newest + 1, owner, clock)
