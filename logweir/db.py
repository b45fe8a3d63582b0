"""A log database on a shared folder: add documents, query them, compact, fetch by id, search by index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import pack_id
from .functions.jsonvals import json_type, text_of, widened
from .functions.labels import label_text, labels_match, stream_id
from .operators import query as q
from .operators import skew, trigram
from .operators.compaction import FOOTERS, footers
from .operators.segments import Segments
from .session import written
from .sources import blobs, wal
from .sources.files import resolve

#: Documents that wait for the index before they make a segment of it.
FLUSH_DOCUMENTS = 1000
#: Bytes to which small log files are merged.
LOG_BYTES = 100 << 20

ARCHIVE = "_id bigint, stream_id bigint, label_set string, l map<string,string>, msg string, ts bigint, ints map<string,bigint>, floats map<string,double>, strings map<string,string>, bools map<string,boolean>"
POSTINGS = "trigram string, document_id bigint, stream_id bigint, position bigint"


class IngestError(ValueError):
    """A document can't be stored."""


class LogDB:
    """Records below ``root``: wal/ holds JSON lines, archive/ typed rows, trigram/ the search index.

    A query reads committed records only: lines of the log that are in no archive segment, and the
    archive. Results carry the stream's id; archived documents have an id of their own. One process
    compacts at a time: of two, the second finds the segment's record taken and raises.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def wal_path(self) -> str:
        return f"{self.root}/wal"

    @property
    def archive(self) -> Segments:
        return Segments(self.spark, f"{self.root}/archive", ARCHIVE)

    @property
    def segments(self) -> Segments:
        return Segments(self.spark, f"{self.root}/trigram", POSTINGS)

    # --- adding

    def add_documents(self, documents: DataFrame) -> DataFrame:
        """Stores the valid ones of (l, doc VARIANT); gives the rejected with their reason."""
        checked = q.validated(documents)
        wal.append(checked.where("error is null").select("l", F.col("doc").alias("d")), self.wal_path)
        return checked.where("error is not null")

    def add(self, labels: dict[str, str], documents: Iterable[str]) -> None:
        """Stores JSON documents under a label set; raises IngestError for the first invalid one."""
        rows = self.spark.createDataFrame([(labels, d) for d in documents], "l map<string,string>, text string")
        checked = q.validated(rows.select("l", F.try_parse_json("text").alias("doc")))
        if bad := checked.where("error is not null").select("error").first():
            raise IngestError(bad["error"])
        wal.append(checked.select("l", F.col("doc").alias("d")), self.wal_path)

    def records(self) -> DataFrame:
        """All lines of the log that are not archived, with their errors; no lines if nothing was stored yet."""
        system, path = resolve(self.wal_path)
        if system.get_file_info(path).type.name == "NotFound":
            return wal.decode(self.spark.createDataFrame([], "value string, object string"))
        taken = [self._taken_path(r) for r in self.archive.records() if r.get("taken")]
        lines = wal.scan(self.spark, self.wal_path)
        return lines.join(self.spark.read.schema("object string").parquet(*taken), "object", "left_anti") if taken else lines

    def _taken_path(self, record: dict) -> str:
        return f"{self.root}/taken/{record['name']}"

    def merge_log(self, target_bytes: int = LOG_BYTES) -> int:
        """Rewrites log files that are smaller than half the target into fewer; gives the files written.

        The merged lines are in place before the small files are told to be taken.
        """
        done = {r["object"] for r in self._taken().collect()}
        files = [r for r in blobs.listed(self.spark, self.wal_path, ".txt").collect() if r["size_bytes"] < target_bytes // 2 and r["key"].rpartition("/")[2] not in done]
        if len(files) < 2:
            return 0
        parts = max(1, -(-sum(r["size_bytes"] for r in files) // target_bytes))
        if parts >= len(files):
            return 0
        old = self.spark.createDataFrame([(r["key"].rpartition("/")[2],) for r in files], "object string")
        lines = self.spark.read.text([r["key"] for r in files])

        def write(folder: str) -> None:
            lines.coalesce(parts).write.text(f"{self.root}/merged/{folder.rpartition('/')[2]}")
            old.write.mode("overwrite").parquet(f"{self.root}/taken/{folder.rpartition('/')[2]}")
            self.spark.createDataFrame([], ARCHIVE).write.parquet(folder)

        record = self.archive.append(write, taken=True, merged=True)
        # the merged files are moved into the log after the small ones are told to be taken
        source, target = (self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{self.root}/merged/{record['name']}", f"{self.wal_path}/{record['name']}"))
        source.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target)
        return parts

    def _taken(self) -> DataFrame:
        paths = [self._taken_path(r) for r in self.archive.records() if r.get("taken")]
        return self.spark.read.schema("object string").parquet(*paths) if paths else self.spark.createDataFrame([], "object string")

    # --- archive

    def last_ids(self) -> DataFrame:
        """(stream_id, n_documents, last_id): where each stream's counter goes on after the process began anew."""
        return self.archive.read().groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("_id").alias("last_id"))

    def compact(self) -> int:
        """Moves the log's records into an archive segment, with ids and typed columns; gives their number.

        A stream's ids go on from its number of archived documents. Fields are kept by the type of
        their values, so segments whose types differ are read together without a cast. A batch is
        read from one list of objects: what comes meanwhile waits for the next.
        """
        lines = self.records()
        objects = written(lines.select("object").distinct(), "batch")
        batch = lines.join(objects, "object", "left_semi").where("error is null").select("object", stream_id(F.col("l")).alias("stream_id"), "l", "d", "value", q.message(F.col("d")).alias("msg"), q.timestamp_ms(F.col("d")).alias("ts"))
        if objects.isEmpty():
            return 0
        placed = skew.pieces(batch.withColumn("tie", F.xxhash64("value")).drop("value", "msg").withColumn("d", F.to_json("d")), "stream_id", ["ts", "object", "tie"], "compact")
        rows = skew.numbered(placed, "stream_id", ["ts", "object", "tie"], 1 << 20)
        before = self.last_ids().select("stream_id", "n_documents")
        ids = rows.join(before, "stream_id", "left").withColumn("_id", pack_id(F.col("ts"), F.col(skew.ROW) + 1 + F.coalesce("n_documents", F.lit(0))))
        document = ids.withColumn("v", F.parse_json("d"))
        fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, x: ~k.isin("msg", "ts") & ~F.is_variant_null(x))
        of = lambda kind: F.map_filter("fields", lambda k, x: json_type(x) == kind)
        typed = document.withColumn("fields", fields).select(
            "_id", "stream_id", label_text(F.col("l")).alias("label_set"), "l", q.message(F.col("v")).alias("msg"), "ts",
            F.transform_values(of("int64"), lambda _, x: F.try_variant_get(x, "$", "bigint")).alias("ints"),
            F.transform_values(of("float64"), lambda _, x: F.try_variant_get(x, "$", "double")).alias("floats"),
            F.transform_values(of("string"), lambda _, x: text_of(x)).alias("strings"),
            F.transform_values(of("bool"), lambda _, x: F.try_variant_get(x, "$", "boolean")).alias("bools"),
        )
        self.archive.append(lambda folder: self._store(typed, objects, folder), taken=True)
        return rows.count()

    def _store(self, typed: DataFrame, objects: DataFrame, folder: str) -> None:
        typed.repartitionByRange("stream_id", "_id").sortWithinPartitions("stream_id", "_id").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#_id", "true").parquet(folder)
        objects.write.mode("overwrite").parquet(f"{self.root}/taken/{folder.rpartition('/')[2]}")

    def level(self) -> int:
        """Merges full levels of the archive and of the index."""
        order = lambda rows, *by: rows.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", "zstd")
        merged = self.archive.level(lambda rows, folder: order(rows, "stream_id", "_id").parquet(folder))
        return merged + self.segments.level(lambda rows, folder: order(rows.distinct(), "trigram", "document_id", "stream_id", "position").parquet(folder))

    def columns(self, labels: dict[str, str] | None = None) -> DataFrame:
        """(col_key, col_type): columns of the archived documents of a label set."""
        docs = self.archive.read().where(labels_match(F.col("l"), labels or {}))
        kinds = {"int64": "ints", "float64": "floats", "string": "strings", "bool": "bools"}
        named = lambda c, t: F.transform(F.map_keys(c), lambda k: F.struct(k.alias("col_key"), F.lit(t).alias("kind")))
        each = docs.select(F.explode(F.concat(*[named(c, t) for t, c in kinds.items()])).alias("e")).select("e.*")
        found = each.groupBy("col_key").agg(F.collect_set("kind").alias("kinds"))
        return found.select("col_key", widened(F.col("kinds")).alias("col_type"))

    def get(self, ids: DataFrame | list[int], labels: dict[str, str] | None = None) -> DataFrame:
        """(stream_id, _id, document): archived documents by id; absent ids have no row.

        ids: numbers, or a DataFrame (stream_id, _id), since an id is unique inside its stream only.
        """
        rows = self.archive.read().where(labels_match(F.col("l"), labels or {}))
        found = q.by_ids(rows, ["stream_id", "_id"], ids) if isinstance(ids, DataFrame) else q.by_ids(rows, "_id", ids)
        return found.select("stream_id", "_id", self._document().alias("document"))

    def _document(self):
        """An archived row as JSON text, its fields in order of kind and name."""
        texts = lambda c: F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), F.to_json(F.array(F.col(c)[k])).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)[k]))) - 2)))
        head = F.to_json(F.struct("msg", "ts"))
        fields = F.concat(texts("ints"), texts("floats"), texts("strings"), texts("bools"))
        return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.when(F.size(fields) > 0, F.concat(F.lit(","), F.array_join(fields, ","))).otherwise(""), F.lit("}"))

    def label_sets(self) -> DataFrame:
        """(label_set, stream_id, n_documents) of the archive: its streams by their labels."""
        return self.archive.read().groupBy("label_set").agg(F.first("stream_id").alias("stream_id"), F.count(F.lit(1)).alias("n_documents"))

    def directory(self) -> DataFrame:
        """(path, size, schema_key, n_blocks, n_rows) of the archive's files, from their footers alone."""
        live = [footers(self.spark, self.archive.path(r["name"])) for r in self.archive.live()]
        if not live:
            return self.spark.createDataFrame([], FOOTERS)
        out = live[0]
        for other in live[1:]:
            out = out.unionAll(other)
        return out

    # --- reading

    def query(self, labels: dict[str, str], text: str) -> DataFrame:
        """(stream_id, labels, msg, ts, document, error): matches, and lines that can't be read."""
        rows = self.records()
        msg = q.message(F.col("d"))
        match = labels_match(F.col("l"), labels) & q.holds(text, msg)
        found = rows.where(F.col("error").isNotNull() | match)
        fresh = found.select(stream_id(F.col("l")).alias("stream_id"), F.col("l").alias("labels"), msg.alias("msg"), q.timestamp_ms(F.col("d")).alias("ts"), F.to_json("d").alias("document"), "error")
        old = self.archive.read().where(labels_match(F.col("l"), labels) & q.holds(text, F.col("msg")))
        return fresh.unionByName(old.select("stream_id", F.col("l").alias("labels"), "msg", "ts", self._document().alias("document"), F.lit(None).cast("string").alias("error")))

    # --- index

    def index(self, flush: bool = True) -> int:
        """Archives what waits in the log and adds what the index lacks, as a segment; gives the number of documents.

        Without ``flush`` nothing is archived, and fewer than FLUSH_DOCUMENTS wait for the next call.
        """
        if flush:
            self.compact()
        known = {name for r in self.segments.records() for name in r.get("of", ())}
        new = [r for r in self.archive.records() if r["name"] not in known and not r["replaces"] and not r.get("merged")]
        if not new:
            return 0
        rows = self.spark.read.schema(ARCHIVE).parquet(*[self.archive.path(r["name"]) for r in new])
        n = rows.count()
        if n == 0 or n < FLUSH_DOCUMENTS and not flush:
            return 0
        found = trigram.postings(rows.select("stream_id", F.col("_id").alias("document_id"), "msg"), "msg", padded=False)
        order = ["trigram", "document_id", "stream_id", "position"]
        self.segments.append(lambda folder: found.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(folder), of=[r["name"] for r in new])
        return n

    def load_index(self) -> DataFrame:
        """The whole index held by the executors, as far as they have room; ``unpersist`` lets it go."""
        return self.segments.read().persist()

    def search(self, text: str) -> DataFrame:
        """(stream_id, _id, document) of documents that hold a text: indexed ones by index, short texts by scan."""
        rows = self.archive.read().withColumn("document_id", F.col("_id"))
        found = trigram.indexed_query(self.segments.read(), rows, "msg", text)
        return found.select("stream_id", "_id", "msg", self._document().alias("document"))

    def close(self) -> None:
        """Archives and indexes what waits in the log."""
        self.index()
