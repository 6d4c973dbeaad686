"""Collections of vectors as Parquet tables: a catalogue, writes, the latest version of each row, logs, exports.

A store is a folder.  vectors/ holds versions (collection, id, values, metadata, version, deleted), partitioned by
collection; the catalogue is catalog/, versioned alike.  Nothing is overwritten in place: writes append, reads
take the latest version of an id and drop deleted ones.  A store has one writer at a time.  A null id or null values are refused by `validated`.
A `Log` keeps entries in segments that are rotated by size and truncated by entry.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import distance as D

VECTOR = "id string, values array<float>, metadata map<string,string>"
VERSIONED = f"{VECTOR}, version bigint, deleted boolean, collection string"
CATALOG = "name string, dimension int, index_type string, distance string, metadata map<string,string>, version bigint, deleted boolean"
WAL = "entry_id bigint, ts timestamp, operation string, collection string, vector_id string, data string, checksum bigint"


def latest(rows: DataFrame, *key: str, order: str = "version", deleted: str = "deleted") -> DataFrame:
    """The last row of each key by order, unless it marks a deletion."""
    by = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth").where(~F.coalesce(F.col(deleted), F.lit(False)))


def checksum(text: Column) -> Column:
    """31-polynomial of the bytes of an ASCII text modulo 2**32."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(None)).otherwise(F.ascii(c)))
    return F.aggregate(F.filter(codes, lambda c: c.isNotNull()), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + c) % F.lit(1 << 32))


def replayed(log: DataFrame) -> DataFrame:
    """The last entry of each vector of a log(WAL), without deleted ones and entries whose checksum doesn't hold."""
    good = log.where((checksum(F.col("data")) == F.col("checksum")) | F.col("data").isNull())
    return latest(good.withColumn("deleted", F.col("operation") == "delete"), "collection", "vector_id", order="entry_id").drop("deleted")


def _tombstones(rows: DataFrame) -> DataFrame:
    """Rows that delete those of rows: their ids, without values."""
    return rows.select("id", F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(True).alias("deleted"))


class Log:
    """A log of entries in a folder: segments of Parquet files, one file or more for each append.

    An append that takes the last segment over `most_bytes` begins the next one.  Entry ids ascend with appends and are unique.
    """

    def __init__(self, spark: SparkSession, path: str, most_bytes: int = 100 << 20):
        self.spark, self.path, self.most_bytes = spark, path.rstrip("/"), most_bytes

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        path, fs = self._fs()
        at = path(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def entries(self) -> DataFrame:
        names = self.segments()
        return self.spark.read.schema(WAL).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], WAL)

    def append(self, rows: DataFrame) -> None:
        """Add rows(ts, operation, collection, vector_id, data) with their checksums, after all entries before."""
        last = self.entries().agg(F.max("entry_id")).first()[0]
        first = last + 1 if last is not None else 0
        each = rows.select((F.monotonically_increasing_id() + first).alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"), "operation", "collection", "vector_id", "data", checksum(F.col("data")).alias("checksum"))
        path, fs = self._fs()
        names = self.segments()
        name = names[-1] if names else f"{0:09d}"
        if names and fs.getContentSummary(path(f"{self.path}/{name}")).getLength() >= self.most_bytes:
            name = f"{int(name) + 1:09d}"
        each.write.mode("append").parquet(f"{self.path}/{name}")

    def rotate(self) -> None:
        """Begin a new segment, whatever the size of the last one."""
        path, fs = self._fs()
        names = self.segments()
        if names:
            self.spark.createDataFrame([], WAL).coalesce(1).write.parquet(f"{self.path}/{int(names[-1]) + 1:09d}")

    def truncate(self, before: int) -> list[str]:
        """Delete the segments all of whose entries come before an entry, but never the last one; their names."""
        path, fs = self._fs()
        gone = []
        for name in self.segments()[:-1]:
            most = self.spark.read.schema(WAL).parquet(f"{self.path}/{name}").agg(F.max("entry_id")).first()[0]
            if most is not None and most >= before:
                break
            fs.delete(path(f"{self.path}/{name}"), True)
            gone.append(name)
        return gone


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, what: str, schema: str) -> DataFrame:
        at = f"{self.path}/{what}"
        return self.spark.read.schema(schema).parquet(at) if self._exists(at) else self.spark.createDataFrame([], schema)

    def _next(self, rows: DataFrame) -> int:
        return (rows.agg(F.max("version")).first()[0] or 0) + 1

    # catalogue

    def collections(self) -> DataFrame:
        return latest(self._rows("catalog", CATALOG), "name").drop("version", "deleted")

    def create(self, name: str, dimension: int, distance: str = "cosine", index_type: str = "flat", metadata: dict | None = None) -> None:
        if self.collections().where(F.col("name") == name).count():
            raise ValueError(f"collection {name!r} is there already")
        if dimension <= 0 or distance not in D.METRICS or index_type not in ("flat", "ivf"):
            raise ValueError("a collection has a positive dimension, a known distance, and a flat or ivf index")
        row = [(name, dimension, index_type, distance, metadata or {}, self._next(self._rows("catalog", CATALOG)), False)]
        self.spark.createDataFrame(row, CATALOG).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def drop(self, name: str) -> None:
        """The collection and all its vectors."""
        info = self._info(name)
        row = [(name, info["dimension"], info["index_type"], info["distance"], {}, self._next(self._rows("catalog", CATALOG)), True)]
        self._append(name, _tombstones(self.vectors(name)))
        self.spark.createDataFrame(row, CATALOG).coalesce(1).write.mode("append").parquet(f"{self.path}/catalog")

    def _info(self, name: str):
        found = self.collections().where(F.col("name") == name).first()
        if found is None:
            raise ValueError(f"no collection {name!r}")
        return found

    def stats(self) -> DataFrame:
        """name, dimension, distance, vectors."""
        n = latest(self._rows("vectors", VERSIONED), "collection", "id").groupBy(F.col("collection").alias("name")).agg(F.count(F.lit(1)).alias("vectors"))
        return self.collections().join(n, "name", "left").select("name", "dimension", "distance", F.coalesce("vectors", F.lit(0)).alias("vectors"))

    # vectors

    def vectors(self, name: str) -> DataFrame:
        """id, values, metadata."""
        rows = self._rows("vectors", VERSIONED).where(F.col("collection") == name)
        return latest(rows, "id").select("id", "values", "metadata")

    def get(self, name: str, id_: str) -> DataFrame:
        """The filter reaches the scan, as does the collection's partition."""
        rows = self._rows("vectors", VERSIONED).where((F.col("collection") == name) & (F.col("id") == id_))
        return latest(rows, "id").select("id", "values", "metadata")

    def _append(self, name: str, rows: DataFrame) -> None:
        version = self._next(self._rows("vectors", VERSIONED).where(F.col("collection") == name))
        out = rows.select("id", F.col("values").cast("array<float>").alias("values"), "metadata", F.lit(version).cast("bigint").alias("version"), "deleted", F.lit(name).alias("collection"))
        out.write.mode("append").partitionBy("collection").parquet(f"{self.path}/vectors")

    def validated(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with a column problem, null where a vector may be written."""
        return rows.withColumn("problem", D.problem(F.col("id"), F.col("values"), self._info(name)["dimension"]))

    def put(self, name: str, rows: DataFrame) -> int:
        """Insert or replace rows(id, values, metadata); all or none: any that isn't valid refuses the batch.  Of equal ids in a batch the last row stays, by the order of partitions and of rows in them."""
        bad = self.validated(name, rows).where("problem is not null").select("problem").first()
        if bad:
            raise ValueError(f"a vector isn't valid: {bad['problem']}")
        rows = latest(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_gone", F.lit(False)), "id", order="_at", deleted="_gone").drop("_at", "_gone")
        self._append(name, rows.withColumn("deleted", F.lit(False)))
        return rows.count()

    def update(self, name: str, rows: DataFrame) -> int:
        """As put, of the ids alone that are there."""
        return self.put(name, rows.join(self.vectors(name).select("id"), "id", "left_semi"))

    def delete(self, name: str, ids: DataFrame) -> None:
        self._append(name, _tombstones(self.vectors(name).join(ids.select("id"), "id", "left_semi")))

    # exports

    def export(self, path: str, names: list[str] | None = None, form: str = "json") -> None:
        """A folder with each collection's vectors and a manifest of them with counts."""
        listed = [r for r in self.collections().collect() if names is None or r["name"] in names]
        manifest = []
        for r in listed:
            rows = self.vectors(r["name"])
            getattr(rows.write.mode("errorifexists"), form)(f"{path}/{r['name']}")
            manifest.append((r["name"], r["dimension"], r["distance"], r["index_type"], form, rows.count()))
        self.spark.createDataFrame(manifest, "name string, dimension int, distance string, index_type string, form string, vectors bigint").coalesce(1).write.json(f"{path}/manifest")

    def load(self, path: str, names: list[str] | None = None, overwrite: bool = False) -> dict[str, int]:
        """Collections of an export; one that is there is refused without overwrite, and a count that differs from the manifest's is an error."""
        done = {}
        for r in self.spark.read.json(f"{path}/manifest").collect():
            name = r["name"]
            if names is not None and name not in names:
                continue
            rows = getattr(self.spark.read.schema(VECTOR), r["form"])(f"{path}/{name}")
            if (n := rows.count()) != r["vectors"]:
                raise ValueError(f"{name!r} has {n} vectors, the manifest says {r['vectors']}")
            if self.collections().where(F.col("name") == name).count():
                if not overwrite:
                    raise ValueError(f"collection {name!r} is there already")
                self.drop(name)
            self.create(name, r["dimension"], r["distance"], r["index_type"])
            done[name] = self.put(name, rows)
        return done

    def verify(self, path: str) -> dict[str, bool]:
        """Whether each collection of an export has the vectors its manifest says."""
        return {r["name"]: getattr(self.spark.read.schema(VECTOR), r["form"])(f"{path}/{r['name']}").count() == r["vectors"] for r in self.spark.read.json(f"{path}/manifest").collect()}


def manifest_of(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r) for r in spark.read.json(f"{path}/manifest").toJSON().collect()]
