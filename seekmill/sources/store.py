"""Tables in the shared folder, and the chunk store."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own where that is unset on a single machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seekmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Written tables that cut lineage and outlive lost executors. What isn't dropped before goes when the application ends, as
    results may be read until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        files = _Fs(spark, self.root)
        files.fs.mkdirs(files.at(self.root))
        files.fs.deleteOnExit(files.at(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; without names the whole folder."""
        fs = _Fs(self.spark, self.root)
        for path in [self.path(n) for n in names] or [self.root]:
            fs.fs.delete(fs.at(path), True)


CHUNKS = (
    "chunk_id string, document_id string, ordinal int, content string, token_count int, url string, title string, ts timestamp, position double, "
    "section_hierarchy array<string>, preceding_chunk_id string, following_chunk_id string, extra map<string,string>"
)
#: The tables of an index. Postings are stored in order of their terms and carry the length of their chunk; a registry entry's key is "entry:" and its document.
TABLES = {
    "chunks": CHUNKS,
    "postings": "term string, chunk_id string, tf bigint, dl bigint",
    "lengths": "chunk_id string, dl bigint",
    "vectors": "chunk_id string, embedding array<float>",
    "registry": "chunk_id string, entry_id string, content_hash string, simhash bigint, urls array<string>",
    "ads": "chunk_id string, node_id string, centroid_id int, centroid array<double>, size bigint, last_updated timestamp",
}
ORDER = {"postings": ["term", "chunk_id"]}


class _Fs:
    """The file system of a path: small files, written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.at(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Fails if the file is there already."""
        hidden = self.at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(path)) or not self.fs.rename(hidden, self.at(path)):
            self.fs.delete(hidden, False)
            raise RuntimeError(f"another writer made {path}")


class Store:
    """The tables of an index under one folder, as append-only segments.

    A commit writes segments (a Parquet folder a table), a segment of deleted chunk ids, and at last a numbered manifest that names all
    segments there are; readers take the newest manifest, so they never see half a commit, and two writers can't both make the same
    number. A row is dead if a later commit deleted its chunk id. So an update costs what it writes and never rewrites a table; compact()
    folds the segments once there are many. mode: 'create' starts empty, 'open' goes on, 'read' refuses writes.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "open"):
        if mode not in ("open", "read", "create"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.path, self.mode, self._fs = spark, path.rstrip("/"), mode, _Fs(spark, path)
        if mode == "create":
            self._publish(self._number() + 1, {"tables": {}, "dead": []})

    def _number(self) -> int:
        found = [int(n) for n in self._fs.names(f"{self.path}/manifest") if n.isdigit()]
        return max(found, default=0)

    def _manifest(self) -> tuple[int, dict]:
        n = self._number()
        return n, json.loads(self._fs.read(f"{self.path}/manifest/{n:010d}")) if n else {"tables": {}, "dead": []}

    def _publish(self, n: int, manifest: dict) -> None:
        if self.mode == "read":
            raise PermissionError(f"{self.path} is open for reading only")
        self._fs.create(f"{self.path}/manifest/{n:010d}", json.dumps(manifest))

    def read(self, name: str) -> DataFrame:
        _, m = self._manifest()
        segments = m["tables"].get(name, [])
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        load = lambda folder: self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}")
        first = min(n for n, _ in segments)
        dead = [(n, folder) for n, folder in m["dead"] if n > first]
        if not dead:
            return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{folder}" for _, folder in segments))
        rows = reduce(DataFrame.unionByName, (load(folder).withColumn("_n", F.lit(n)) for n, folder in segments))
        gone = reduce(DataFrame.unionByName, (self.spark.read.schema("chunk_id string").parquet(f"{self.path}/{folder}").withColumn("_d", F.lit(n)) for n, folder in dead))
        gone = gone.groupBy("chunk_id").agg(F.max("_d").alias("_d"))
        alive = rows.join(gone, "chunk_id", "left").filter(F.col("_d").isNull() | (F.col("_d") <= F.col("_n")))
        return alive.select(*(f.split(" ")[0] for f in TABLES[name].split(", ")))

    def stage(self, name: str, df: DataFrame, ordered: bool = False) -> tuple[str, DataFrame]:
        """Write a segment that no manifest names yet. ordered: the rows are in the table's order already."""
        if self.mode == "read":
            raise PermissionError(f"{self.path} is open for reading only")
        folder = f"{name}/{uuid.uuid4().hex}"
        missing = [c for c in TABLES.get(name, "chunk_id string").split(", ") if c.split(" ")[0] not in df.columns]
        df = df.withColumns({c.split(" ", 1)[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in missing}) if missing else df
        df = df.select(*(F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in TABLES.get(name, "chunk_id string").split(", ")))
        if name in ORDER and not ordered:  # in order, so that row groups are skipped by their smallest and largest keys; a hot term spans many files
            df = df.orderBy(*ORDER[name])
        df.write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def commit(self, add: dict[str, DataFrame | str] | None = None, dead: DataFrame | None = None, replace: bool = False) -> None:
        """Add segments (DataFrames, or staged ones by name) and delete chunk ids, at once: rows of this commit aren't deleted by it.
        replace: the tables named consist of this commit only."""
        n, m = self._manifest()
        n += 1
        size = m.get("size", [0, 0])
        gone = None
        if dead is not None and any(m["tables"].values()):
            gone, keys = self.stage("dead", dead.select("chunk_id").distinct())
            if m["tables"].get("lengths"):
                lost = self.read("lengths").join(keys, "chunk_id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
                size = [size[0] - lost[0], size[1] - lost[1]]
        for name, df in (add or {}).items():
            folder = df if isinstance(df, str) else self.stage(name, df)[0]
            m["tables"][name] = [*([] if replace else m["tables"].get(name, [])), [n, folder]]
            if name == "lengths":
                new = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
                size = [new[0], new[1]] if replace else [size[0] + new[0], size[1] + new[1]]
        if gone:
            m["dead"].append([n, gone])
        m["size"] = size
        self._publish(n, m)

    def size(self) -> tuple[int, int]:
        """The numbers of chunks and of their tokens, which each commit brings up to date."""
        return tuple(self._manifest()[1].get("size", [0, 0]))

    def write(self, name: str, df: DataFrame) -> None:
        self.commit({name: df}, replace=True)

    def append(self, name: str, df: DataFrame) -> None:
        self.commit({name: df})

    def compact(self, segments: int = 0) -> None:
        """Fold every table of more than so many segments into one, and forget the deletions that no segment needs."""
        _, m = self._manifest()
        many = [name for name, found in m["tables"].items() if len(found) > segments]
        if many:
            self.commit({name: self.stage(name, self.read(name))[0] for name in many}, replace=True)
            n, m = self._manifest()
            first = min((at for found in m["tables"].values() for at, _ in found), default=n)
            m["dead"] = [d for d in m["dead"] if d[0] > first]
            self._publish(n + 1, m)


# the chunk store's operations, on any DataFrame of chunks


def put(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Insert or replace."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def get_batch(store: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of the keys there are."""
    return store.join(keys.select(key).distinct(), key, "left_semi")


def remove(store: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """All rows but those of the keys; key may be chunk_id, document_id or url."""
    return store.join(keys.select(key).distinct(), key, "left_anti")


def url_index(store: DataFrame, order: str = "ts") -> DataFrame:
    """(url, document_id): the document that wrote the URL last."""
    return store.filter("url IS NOT NULL").groupBy("url").agg(F.max_by("document_id", F.struct(order, "document_id")).alias("document_id"))


def export_rows(chunks: DataFrame) -> DataFrame:
    """One JSON text a chunk, with its metadata and without its embedding."""
    return chunks.select(F.to_json(F.struct(*(c for c in chunks.columns if c != "embedding"))).alias("value"))


def export(chunks: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """JSON lines, or one JSON array: the files of the folder in order of their names. Both are written in parallel."""
    rows = export_rows(chunks)
    if fmt == "jsonl":
        rows.write.mode("overwrite").text(path)
    elif fmt == "json":
        # written in parallel; the first row opens the array, the last one closes it, all others end in commas
        parts = Scratch(chunks.sparkSession, "export")
        kept = parts.table(rows.withColumn("n", F.monotonically_increasing_id()), "rows")
        last = kept.agg(F.min("n").alias("low"), F.max("n").alias("high"))
        value = F.concat(F.when(F.col("n") == F.col("low"), "[\n").otherwise(""), F.col("value"), F.when(F.col("n") == F.col("high"), "\n]").otherwise(","))
        lines = kept.crossJoin(F.broadcast(last)).orderBy("n").select(value.alias("value"))  # one row
        if kept.take(1):
            lines.write.mode("overwrite").text(path)
        else:
            chunks.sparkSession.createDataFrame([("[\n]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        parts.drop()
    else:
        raise ValueError(f"unknown export format {fmt}")
