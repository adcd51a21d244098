"""Content-addressed bytes: a blob's key is its SHA-256, checked whenever it is read. A store is a folder of any file
system that Spark reaches, by its URI (a path of this machine, ``hdfs://``, ``s3a://``); credentials, signing, paging and
retries are the file system's."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlobStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(""))

    def _at(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{key}" if key else self.base)

    def put(self, content: bytes) -> str:
        """Writes to a name of its own first, so that a key never names half a blob."""
        key = hashlib.sha256(content).hexdigest()
        if not self._fs.exists(self._at(key)):
            new = self._at(f"_new-{uuid.uuid4().hex}")
            out = self._fs.create(new, True)
            out.write(bytearray(content))
            out.close()
            self._fs.rename(new, self._at(key))
        return key

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def get(self, key: str) -> bytes:
        try:
            stream = self._fs.open(self._at(key))
        except Py4JJavaError as e:
            if "FileNotFound" in str(e.java_exception):
                raise KeyError(key) from None
            raise
        content = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        stream.close()
        if hashlib.sha256(content).hexdigest() != key:
            raise ValueError(f"{key}: the content does not match its key")
        return content

    def delete(self, key: str) -> None:
        self._fs.delete(self._at(key), False)

    def keys(self) -> list[str]:
        """Of a store that is small enough to be listed by the driver; ``held`` lists any."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")) if not s.getPath().getName().startswith(("_", ".")))


def held(spark: SparkSession, base: str, verify: bool = False) -> DataFrame:
    """(key, size) of all blobs in a folder, and with ``verify`` whether each one's content has its key."""
    files = spark.read.format("binaryFile").load(base)
    key = F.element_at(F.split("path", "/"), -1)
    return files.select(key.alias("key"), F.col("length").alias("size"), *([(F.sha2("content", 256) == key).alias("sound")] if verify else []))


class BlobValue:
    """A node's output kept as a blob: a reference that says where it is and what it was."""

    SCHEME = "runfold-blob"

    def __init__(self, store: BlobStore, backend: str = "hadoop", container: str = "values"):
        self.store, self.head = store, f"{self.SCHEME}+{backend}://{container}/sha256/"

    def put(self, content: bytes) -> tuple[str, dict]:
        key = self.store.put(content)
        return self.head + key, {"content_hash": f"sha256:{key}", "size_bytes": len(content), "scheme": self.SCHEME}

    def get(self, reference: str) -> bytes:
        if not reference.startswith(self.head):
            raise ValueError(f"{reference}: not a reference of this store")
        return self.store.get(reference.removeprefix(self.head))

    def probe(self, reference: str, content_hash: str | None = None) -> str:
        """``present``, ``absent``, ``changed`` (there, but not what it was) or ``unknown``: what a resume asks."""
        try:
            content = self.get(reference)
        except KeyError:
            return "absent"
        except ValueError:
            return "changed" if reference.startswith(self.head) else "unknown"
        own = f"sha256:{hashlib.sha256(content).hexdigest()}"
        return "present" if content_hash in (None, own) else "changed"


# ---- shards: what one attempt elsewhere wrote --------------------------------------------------------------------------


class ShardError(ValueError):
    """A shard that was cut off, or is of another build."""


def shard_lines(header: dict, records: list[dict]) -> list[str]:
    """A header line, the records, and a trailer with their count."""
    dump = lambda kind, row: json.dumps({"kind": kind, **row}, sort_keys=True, separators=(",", ":"))
    return [dump("header", header), *(json.dumps(r, sort_keys=True, separators=(",", ":")) for r in records), dump("trailer", {"n": len(records)})]


def read_shard(lines: list[str], build: dict | None = None) -> tuple[dict, list[dict]]:
    """The header and the records of a whole shard. ``build``: what its header must say (tool version, fingerprint)."""
    rows = [json.loads(line) for line in lines if line.strip()]
    if not rows or rows[0].get("kind") != "header" or rows[-1].get("kind") != "trailer" or rows[-1].get("n") != len(rows) - 2:
        raise ShardError("the shard is not whole")
    wrong = sorted(k for k, v in (build or {}).items() if rows[0].get(k) != v)
    if wrong:
        raise ShardError(f"another build: {', '.join(wrong)}")
    return {k: v for k, v in rows[0].items() if k != "kind"}, rows[1:-1]


def shard_status(lines: DataFrame) -> DataFrame:
    """One row per attempt shard: whether it is whole. lines: path, line, kind, n (the trailer's count)."""
    of = lambda k: F.count_if(F.col("kind") == k)
    out = lines.groupBy("path").agg((F.min_by("kind", "line") == "header").alias("headed"), (F.max_by("kind", "line") == "trailer").alias("ended"), (F.count("*") - of("header") - of("trailer")).alias("records"), F.max_by("n", "line").alias("n"))
    return out.select("path", (F.col("headed") & F.col("ended") & (F.col("records") == F.col("n"))).alias("whole"), "records")
