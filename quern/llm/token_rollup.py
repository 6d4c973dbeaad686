"""Token counts kept as rollups by signed deltas.

A store is a folder of committed batches.  A batch holds signed totals by source, language and tokenizer
version: +1 document and +n tokens for an insert, -1 and -n for a delete, and both, old and new, for a
revised count.  Totals are additive, so they are the sums over all batches, whatever the order.

A batch is written aside and takes its place by one atomic rename to the folder of its id.  A batch whose id is
there already changes nothing, so a batch that is sent again, or by two writers at once, counts once.
`compact` folds batches into a snapshot that names them; they then still count once.

Null sources and languages are keys like any other.  Null texts count as documents without tokens.  Empty tables make
empty batches, which are committed too.  Rows repeated in a batch count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.shared import new_folder, stored, table
from quern.llm.textvec import Slice, slices

KEY = ["source", "lang", "tokenizer"]
COUNTS = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint"
DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def count_tokens(docs: DataFrame, tokenizer: str, vocabulary: str, anew: Column | None = None) -> DataFrame:
    """`count_all` under one tokenizer."""
    return count_all(docs, {tokenizer: vocabulary}, anew)


def count_all(docs: DataFrame, vocabularies: dict[str, str], anew: Column | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens for each row of docs(doc_id, text, source, lang) and each tokenizer.

    vocabularies names the versions under which the counts of these vocabulary files stand; they split texts alike, so a text is read and split
    once for all.  With anew, another text of each row, n_anew is its count, from the same pass; rows where it is the same text aren't counted twice.
    """
    spark = docs.sparkSession
    machines = [(name, *bpe.compiled(path)) for name, path in vocabularies.items()]
    sent = [(name, key, spark.sparkContext.broadcast(machine)) for name, key, machine in machines]
    text = F.col("text").cast("string")
    other = F.when(~anew.eqNullSafe(text), anew) if anew is not None else F.lit(None).cast("string")

    def counted(own: list[bpe.Automaton], texts: pa.Array) -> np.ndarray:
        out = [np.zeros((len(own), 0), np.int64)]
        for a, b in slices(texts):
            part = Slice(texts.slice(a, b - a))
            split = bpe.Split(part)
            out.append(np.stack([machine.count(part, split) for machine in own]))
        return np.concatenate(out, axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [bpe.automaton(key, machine) for _, key, machine in sent]
        for batch in batches:
            n = counted(own, batch.column(3))
            also = n.copy()
            differs = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False))
            if len(differs):
                also[:, differs] = counted(own, batch.column(4).take(pa.array(differs)))
            for k, (name, _, _) in enumerate(sent):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * batch.num_rows, pa.string()), pa.array(n[k]), pa.array(also[k])], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_anew"])

    columns = (F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), text.alias("text"), other.alias("anew"))
    out = docs.select(*columns).mapInArrow(work, COUNTS + ", n_anew bigint")
    return out if anew is not None else out.drop("n_anew")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("bigint").alias("documents"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows that take back counts as they were inserted."""
    return counts.select(*KEY, F.lit(-1).cast("bigint").alias("documents"), (-F.col("n_tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that put new counts in the place of old ones."""
    return deletes(old).unionByName(inserts(new))


class Store:
    """The rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(self.path)
        return hadoop, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, fs = self._fs()
        at = hadoop.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _place(self, written: str, folder: str, name: str) -> bool:
        """Move what is written to its name; False if that name is taken."""
        hadoop, fs = self._fs()
        fs.mkdirs(hadoop.Path(f"{self.path}/{folder}"))
        jvm = self.spark.sparkContext._jvm
        context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        target = hadoop.Path(f"{self.path}/{folder}/{name}")
        try:
            context.rename(hadoop.Path(written), target, none)
        except jvm_error() as e:
            if not fs.exists(target):
                raise e
            fs.delete(hadoop.Path(written), True)
            return False
        return True

    @staticmethod
    def _name(batch: str) -> str:
        return "batch-" + hashlib.sha256(batch.encode()).hexdigest()

    def committed(self, batch: str) -> bool:
        return self._name(batch) in {*self._names("batches"), *self._folded()}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add signed rows as the batch of this id; False, and no change, if it was committed before."""
        if self.committed(batch):
            return False
        aside = f"{self.path}/aside/{new_folder(self.spark, 'batch').rsplit('/', 1)[1]}"
        deltas.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(aside)
        return self._place(aside, "batches", self._name(batch))

    def _snapshot(self) -> str | None:
        names = self._names("snapshots")
        return f"{self.path}/snapshots/{names[-1]}" if names else None

    def _folded(self) -> set[str]:
        at = self._snapshot()
        return {r[0] for r in self.spark.read.parquet(f"{at}/names").collect()} if at else set()

    def _deltas(self) -> tuple[DataFrame, list[str]]:
        at = self._snapshot()
        folded = self._folded()
        names = [n for n in self._names("batches") if n not in folded]
        paths = [f"{self.path}/batches/{n}" for n in names] + ([f"{at}/totals"] if at else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows, [*folded, *names]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all batches; keys whose documents are all gone are left out."""
        rows, _ = self._deltas()
        sums = rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a new snapshot, which takes effect by one rename.

        What the snapshot before had folded already is deleted: those who began to read before this one may still read what it folds now.
        """
        rows, names = self._deltas()
        before = self._folded()
        aside = f"{self.path}/aside/{new_folder(self.spark, 'snapshot').rsplit('/', 1)[1]}"
        rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{aside}/names")
        if self._place(aside, "snapshots", f"{len(self._names('snapshots')):09d}"):
            hadoop, fs = self._fs()
            for name in before & set(self._names("batches")):
                fs.delete(hadoop.Path(f"{self.path}/batches/{name}"), True)


def jvm_error() -> type[Exception]:
    from py4j.protocol import Py4JJavaError

    return Py4JJavaError


VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def without_repeated_lines(text: Column) -> Column:
    """A text with each of its lines once, in the order of first occurrence."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def maintained(spark: SparkSession, sf_dir: str, folder: str | None = None, tokenizers: str = bpe.TOKENIZERS) -> DataFrame:
    """Totals of documents after four batches for each tokenizer version.

    load: all documents; load again, as a writer that was restarted would send it; withdraw: documents
    labelled toxic are deleted; revise: those labelled of low quality, not withdrawn, are counted anew without repeated lines.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("toxic") == 1).alias("toxic"), F.bool_or(F.col("quality") == 0).alias("low"))
    store = Store(spark, folder or new_folder(spark, "rollup"))
    # texts are read, split and counted in one pass; only counts meet the labels
    counts = stored(count_all(docs, {v: f"{tokenizers}/{file}" for v, file in VERSIONS.items()}, without_repeated_lines(F.col("text"))), "counts")
    counts = stored(counts.join(flags, "doc_id", "left"), "flagged")
    for version in VERSIONS:
        own = counts.where(F.col("tokenizer") == version)
        store.commit(f"load/{version}", inserts(own))
        store.commit(f"load/{version}", inserts(own))
        store.commit(f"withdraw/{version}", deletes(own.where("toxic")))
        low = own.where("low and not coalesce(toxic, false)")
        store.commit(f"revise/{version}", revisions(low, low.withColumn("n_tokens", F.col("n_anew"))))
    return store.totals()
