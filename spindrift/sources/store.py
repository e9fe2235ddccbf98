"""Stored state: the chunk table as a log of manifests, its lexical index, the registry, the settings.

Data are Parquet folders that are never written again, one for each library and commit. A manifest
names the folders of every library; a commit writes the folders of the libraries it changes, and only
those, and then puts the next manifest in place, which succeeds for one writer only. A reader resolves
the newest manifest once, so it sees the old table or the new one and nothing between.

Beside a library's chunks a commit writes an index: lists of the chunks that have a term, sorted by term in
each file. It keeps the library's number of chunks and terms in the manifest, so a lexical search reads its
terms' row groups and no text.
"""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import retrieval
from ..operators.diff import one_of_each

CHUNKS = (
    "chunk_id string, source_id string, library_id string, version string, document_id string, url string, title string, "
    "heading_path string, chunk_index int, content string, content_hash string, embedding array<float>"
)


class ChunkNotFound(LookupError):
    """No chunk of that id."""


class InvalidChunk(ValueError):
    """A chunk that must not be stored."""


class CommitConflict(RuntimeError):
    """Another commit has changed what this one is based on; nothing of this one is visible."""


class Files:
    """Small files on whatever file system Spark has, local or remote."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _path(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.conf)

    def read(self, name: str) -> str | None:
        path, fs = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a temporary file renamed over the old one."""
        path, fs = self._path(name)
        temporary, _ = self._path(f".{name}.new")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(temporary, path, array)

    def create(self, name: str, text: str) -> bool:
        """Whole, and only if there is no file of that name; whether it was written."""
        path, fs = self._path(name)
        temporary, _ = self._path(f".{uuid.uuid4().hex}.new")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.mkdirs(path.getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        try:
            context.rename(temporary, path, options)
        except Py4JJavaError as e:
            fs.delete(temporary, True)
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def make(self, name: str) -> None:
        path, fs = self._path(name)
        fs.mkdirs(path)

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def list(self, name: str = "") -> list[str]:
        path, fs = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


NAMES = [f.split(" ")[0] for f in CHUNKS.split(", ")]
INDEX = retrieval.INDEX + ", library_id string"
DEALT = 4  # files a core, from which texts are read as they lie


class ChunkStore:
    """The chunk table of one folder. ``keep`` manifests before the newest stay, with all that they name."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.files, self.keep = spark, folder.rstrip("/"), Files(spark, folder), keep

    # ------------------------------------------------------------ manifests

    def _numbers(self) -> list[int]:
        return sorted(int(x.split(".")[0]) for x in self.files.list("manifests") if x.endswith(".json"))

    def _manifest(self, n: int) -> dict:
        return json.loads(self.files.read(f"manifests/{n:012d}.json") or '{"version": 0, "identity": "", "libraries": {}}')

    def _state(self) -> dict:
        return self._manifest(max(self._numbers(), default=0))

    @property
    def identity(self) -> str:
        return self._state()["identity"]

    @property
    def version(self) -> int:
        """The number of the newest commit; give it to ``commit`` to build on what was read."""
        return self._state()["version"]

    # ------------------------------------------------------------ reading

    def _read(self, kind: str, schema: str, library_id: str, state: dict | None = None) -> DataFrame:
        known = (state or self._state())["libraries"]
        paths = [f"{self.folder}/{kind}/{x['folder']}" for name, x in known.items() if library_id in ("", name)]
        names = [f.split(" ")[0] for f in schema.split(", ")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths).select(*names)

    def read(self, library_id: str = "", state: dict | None = None) -> DataFrame:
        """The table as it is now, or one library of it; partitioned by library, so a library's clause prunes folders."""
        return self._read("chunks", CHUNKS, library_id, state)

    def listing(self, source_id: str = "", library_id: str = "", version: str = "") -> DataFrame:
        """The chunks of a scope, by id."""
        return retrieval.scoped(self.read(library_id), source_id, library_id, version).orderBy("chunk_id")

    def lexical(self, library_id: str, query: str, k: int | None = retrieval.LEXICAL_K) -> DataFrame:
        """(chunk_id, score) of a library's best chunks by BM25, from the stored index."""
        known = self._state()["libraries"].get(library_id, {"n": 0, "total": 0})
        return retrieval.bm25_from_index(self._read("index", INDEX, library_id), known["n"], known["total"], query, k)

    def get(self, chunk_id: str) -> dict:
        rows = self.read().where(F.col("chunk_id") == chunk_id).take(1)
        if not rows:
            raise ChunkNotFound(chunk_id)
        return rows[0].asDict()

    # ------------------------------------------------------------ writing

    def commit(self, chunks: DataFrame, identity: str | None = None, libraries: list[str] | None = None, base: int | None = None) -> int:
        """Make these the chunks of ``libraries``, or of the whole table if None; the others stay as they are.

        A commit that another writer made since ``base`` (by default, since this one began) is a conflict
        if it has changed one of these libraries or the identity; else this one goes on top of it.
        """
        began = self._manifest(base) if base is not None else self._state()
        folder = f"commit={began['version'] + 1}-{uuid.uuid4().hex[:12]}"
        rows = chunks.select(*NAMES)
        if libraries is not None:
            rows = rows.where(F.col("library_id").isin(list(libraries)))
        rows.write.partitionBy("library_id").parquet(f"{self.folder}/chunks/{folder}")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/chunks/{folder}")
        # Every task's lists are sorted by term where they are made: a folder of segments, none of which is shuffled.
        # Many files are dealt over the cores as they are read; texts in few are dealt out.
        many = len(stored.inputFiles()) >= DEALT * self.spark.sparkContext.defaultParallelism
        lists = retrieval.segments(stored, retrieval.lexical_text(), dealt=many)
        lists.sortWithinPartitions("library_id", "term").write.partitionBy("library_id").parquet(f"{self.folder}/index/{folder}")
        index = self.spark.read.schema(INDEX).parquet(f"{self.folder}/index/{folder}")
        # Sizes of libraries, of which there are few: one row each. Chunks without a term count too.
        n = {r[0]: r[1] for r in stored.groupBy("library_id").agg(F.count("*")).collect()}
        total = {r[0]: r[1] for r in index.groupBy("library_id").agg(F.sum("total")).collect()}
        places = {}
        for x in self.files.list(f"chunks/{folder}"):
            if x.startswith("library_id="):
                places[unquote(x.split("=", 1)[1])] = f"{folder}/{x}"
        new = {k: {"folder": places[k], "n": n[k], "total": total.get(k, 0)} for k in n}
        for k in set(new) - set(total):  # a library of which no chunk has a term has no lists yet
            self.files.make(f"index/{places[k]}")
        while True:
            now = self._state()
            if now["version"] != began["version"]:
                mine = set(libraries) if libraries is not None else set(now["libraries"]) | set(began["libraries"])
                if now["identity"] != began["identity"] or any(now["libraries"].get(k) != began["libraries"].get(k) for k in mine):
                    self._drop(folder)
                    raise CommitConflict(f"version {now['version']} has changed what is based on version {began['version']}")
            kept = {} if libraries is None else {k: v for k, v in now["libraries"].items() if k not in set(libraries)}
            version = now["version"] + 1
            state = {"version": version, "identity": now["identity"] if identity is None else identity, "libraries": kept | new}
            if self.files.create(f"manifests/{version:012d}.json", json.dumps(state)):
                break
        if not new:
            self._drop(folder)
        self._clean(version)
        return version

    def _drop(self, folder: str) -> None:
        for kind in ("chunks", "index"):
            self.files.delete(f"{kind}/{folder}")

    def _clean(self, version: int) -> None:
        """Delete old manifests, and the folders that only they name."""
        numbers = self._numbers()
        old, kept = [x for x in numbers if x <= version - self.keep], [x for x in numbers if x > version - self.keep]
        used = {x["folder"] for n in kept for x in self._manifest(n)["libraries"].values()}
        commits = {x.split("/")[0] for x in used}
        for n in old:
            for x in self._manifest(n)["libraries"].values():
                if x["folder"] not in used:
                    commit = x["folder"].split("/")[0]
                    self._drop(x["folder"] if commit in commits else commit)
            self.files.delete(f"manifests/{n:012d}.json")

    def upsert(self, chunks: DataFrame, identity: str | None = None, vectors: DataFrame | None = None) -> int:
        """Replace by id; a blank id is an error and nothing is written.

        Of an id that stands twice in the batch, the first by URL, content hash and place is taken.
        ``vectors`` (chunk_id, embedding) go before a chunk's own vector where they hold one.
        """
        if not chunks.where(F.trim(C.text("chunk_id")) == "").isEmpty():
            raise InvalidChunk("a chunk has no id")
        base = self._state()
        new = one_of_each(chunks, order=("url", "content_hash", "chunk_index"))
        if vectors is not None:
            given = vectors.where(F.size("embedding") > 0).groupBy("chunk_id").agg(F.min("embedding").alias("__vector"))
            new = new.join(given, "chunk_id", "left").withColumn("embedding", F.coalesce("__vector", "embedding"))
        old = self.read(state=base)
        touched = [r[0] for r in new.select("library_id").union(old.join(new.select("chunk_id"), "chunk_id", "left_semi").select("library_id")).distinct().collect()]
        left = old.where(F.col("library_id").isin(touched)).join(new.select("chunk_id"), "chunk_id", "left_anti")
        return self.commit(left.unionByName(new.select(*NAMES)), identity, touched, base["version"])

    def delete(self, ids: list[str] | DataFrame) -> int:
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "chunk_id string")
        base = self._state()
        old = self.read(state=base)
        touched = [r[0] for r in old.join(gone, "chunk_id", "left_semi").select("library_id").distinct().collect()]
        return self.commit(old.where(F.col("library_id").isin(touched)).join(gone, "chunk_id", "left_anti"), None, touched, base["version"])

    def delete_source(self, source_id: str) -> int:
        base = self._state()
        old = self.read(state=base)
        touched = [r[0] for r in old.where(F.col("source_id") == source_id).select("library_id").distinct().collect()]
        left = old.where(F.col("source_id") != source_id)
        return self.commit(left.where(F.col("library_id").isin(touched)), "" if left.isEmpty() else None, touched, base["version"])


# ---------------------------------------------------------------- registry


@dataclass
class Source:
    library_id: str
    name: str
    base_url: str
    version: str = ""
    description: str = ""
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    created_at: str = ""
    updated_at: str = ""
    synced_at: str | None = None
    id: str = ""


class Registry:
    """The libraries that are known: one small JSON document, sorted by library id."""

    schema = (
        "library_id string, name string, base_url string, version string, description string, includes array<string>, excludes array<string>, "
        "created_at string, updated_at string, synced_at string, id string"
    )

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.files = spark, Files(spark, folder)

    def list(self) -> list[Source]:
        return [Source(**x) for x in json.loads(self.files.read("sources.json") or '{"sources": []}')["sources"]]

    def _save(self, rows: list[Source]) -> None:
        rows = sorted(rows, key=lambda s: s.library_id)
        self.files.write("sources.json", json.dumps({"sources": [vars(s) for s in rows]}, indent=2))

    def get(self, library_id: str) -> Source:
        for s in self.list():
            if s.library_id == library_id:
                return s
        raise LookupError(library_id)

    def add(self, source: Source) -> Source:
        rows = self.list()
        if any(s.library_id == source.library_id for s in rows):
            raise ValueError(f"{source.library_id} is registered")
        now = datetime.now(UTC).isoformat()
        new = replace(source, id=source_id(source.library_id), created_at=now, updated_at=now)
        self._save([*rows, new])
        return new

    def update(self, source: Source) -> Source:
        """Replace a row; the time of its creation stays."""
        old = self.get(source.library_id)
        new = replace(source, id=old.id, created_at=old.created_at, updated_at=datetime.now(UTC).isoformat())
        self._save([new if s.library_id == new.library_id else s for s in self.list()])
        return new

    def delete(self, library_id: str) -> None:
        self.get(library_id)
        self._save([s for s in self.list() if s.library_id != library_id])

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(vars(s)[f.split(" ")[0]] for f in self.schema.split(", ")) for s in self.list()], self.schema)


def source_id(library_id: str) -> str:
    import hashlib

    return hashlib.sha256(library_id.encode()).hexdigest()[:16]


def new_library_id(name: str, version: str = "") -> str:
    import re

    word = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
    if not word:
        raise ValueError(f"{name!r} has no letter or digit")
    return f"/local/{word}" + (f"/{version.strip()}" if version.strip() else "")


def parse_library_id(library_id: str) -> tuple[str, str, str]:
    """(namespace, name, version); an error for anything else."""
    parts = library_id.split("/")
    if parts[0] or len(parts) not in (3, 4) or not all(p.strip() for p in parts[1:]) or (len(parts) == 3 and parts[1] != "local"):
        raise ValueError(f"{library_id!r} is no library id")
    return parts[1], parts[2], parts[3] if len(parts) == 4 else ""


# ---------------------------------------------------------------- settings


@dataclass(frozen=True)
class Config:
    data_path: str = "~/.spindrift"
    concurrency: int = 4
    max_pages: int = 1000
    max_depth: int = 20
    request_timeout: float = 20.0
    rate_limit: int = 0
    max_body_bytes: int = 10 << 20
    provider: str = "default"
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    candidate_count: int = 20
    final_chunks: int = 6

    def check(self) -> Config:
        for name in ("concurrency", "max_pages", "max_depth", "max_body_bytes", "candidate_count", "final_chunks"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive, not {getattr(self, name)}")
        if self.candidate_count < self.final_chunks:
            raise ValueError(f"candidate_count ({self.candidate_count}) must be at least final_chunks ({self.final_chunks})")
        if not self.data_path.strip():
            raise ValueError("data.path is required")
        if self.provider not in ("default", "local", "ollama", "openai", "fake"):
            raise ValueError(f"unknown provider {self.provider!r}")
        if self.provider in ("ollama", "openai") and not self.model:
            raise ValueError(f"{self.provider} needs a model")
        return self


def load_config(path: str = "", api_key_variable: str = "SPINDRIFT_API_KEY", **overrides: object) -> Config:
    """Defaults, then a TOML file if there is one, then overrides. The key comes from the environment only."""
    values: dict[str, object] = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        names = {("data", "path"): "data_path"}
        for section, keys in raw.items():
            for k, v in keys.items():
                values[names.get((section, k), k)] = v
    values.pop("api_key", None)
    if isinstance(values.get("request_timeout"), str):
        values["request_timeout"] = float(str(values["request_timeout"]).rstrip("s"))
    merged = {**values, **{k: v for k, v in overrides.items() if v is not None}}
    unknown = set(merged) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    config = replace(Config(), **merged, api_key=os.environ.get(api_key_variable, "").strip())
    return replace(config, data_path=os.path.expanduser(config.data_path)).check()
