"""The archive's tables in a versioned state directory.

Each commit writes the changed tables to new folders and a small manifest that
names the folder of every table, then renames a pointer file, so that a reader
sees all of a commit or nothing.  Folders of old versions stay readable until
``vacuum``.  One writer at a time; the pointer is checked before it is renamed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtide.operators.shared import bounded, cut

SCHEMA_VERSION = 7

#: The tables of the current schema.
TABLES = {
    "pages": "id long, url string, original_url string, browser_title string, source string, status string, error string, error_kind string, title string, summary string, lang string, note_file string, added_at timestamp, processed_at timestamp, page_title string",
    "tags": "id long, name string, parent_id long, description string, locked boolean, created_at timestamp, placed boolean",
    "page_tags": "page_id long, raw_tag string, resolved_tag_id long",
    "tag_aliases": "alias string, tag_id long, source string, locked boolean, created_at timestamp",
    "embeddings": "kind string, ref_id long, model string, vector array<float>",
    "runs": "id long, started_at timestamp, finished_at timestamp, report string",
    "revisions": "id long, created_at timestamp, status string, changes string, undo string, decision_keys array<string>",
    "moves": "revision long, step long, page_id long, raw_tag string, from_id long, to_id long",
    "tag_decisions": "key string, decision string, source string, created_at timestamp",
    "batches": "name string",
    "files": "path string, size long, modified timestamp",
}

STATUSES = ["pending", "done", "failed", "unreachable"]


class SchemaError(ValueError):
    pass


class State:
    """Reads and commits the tables of one directory; ``read_only`` opens pin the version they found."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        text = self._read("CURRENT")
        if text is None:
            if read_only:
                raise SchemaError(f"no archive in {root}")
            self.manifest = {"schema": SCHEMA_VERSION, "version": 0, "tables": {}, "next_id": {}}
        else:
            self.manifest = json.loads(self._read(text.strip()))
            self._check()

    def _check(self) -> None:
        found = self.manifest["schema"]
        if found > SCHEMA_VERSION:
            raise SchemaError(f"the archive has schema {found}, newer than {SCHEMA_VERSION}")
        if found < 2:
            raise SchemaError("an archive of schema 1 can't be upgraded; import its list again")
        if found < SCHEMA_VERSION and not self.read_only:
            self._upgrade(found)

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        """A table of this version; columns that an older schema lacks have their defaults."""
        folders = self.manifest["tables"].get(name)
        columns = [c.split() for c in TABLES[name].split(", ")]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.parquet(f"{self.root}/{folders}")
        defaults = {"placed": F.lit(False), "locked": F.lit(False)}
        have = set(df.columns)
        return df.select(*(F.col(c) if c in have else defaults.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns))

    def commit(self, batch: str | None = None, next_id: dict | None = None, schema: int | None = None, **tables: DataFrame) -> None:
        """Writes the given tables and makes them current together.  A ``batch`` name that was committed before is skipped."""
        if self.read_only:
            raise PermissionError("the archive was opened for reading")
        if batch is not None:
            if self.committed(batch):
                return
            tables["batches"] = self.table("batches").unionByName(self.spark.createDataFrame([(batch,)], "name string"))
        found = self._read("CURRENT")
        if (found or "").strip() != (self.manifest.get("name") or ""):
            raise RuntimeError("another writer changed the archive")
        new = json.loads(json.dumps(self.manifest))
        new["version"] += 1
        tag = f"{new['version']:08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            folder = f"{name}/{tag}"
            columns = [c.split() for c in TABLES[name].split(", ")]
            df.select(*(F.col(c).cast(t).alias(c) for c, t in columns)).write.parquet(f"{self.root}/{folder}")
            new["tables"][name] = folder
        new["next_id"] |= next_id or {}
        new["schema"] = schema or new["schema"]
        new["name"] = f"manifest-{tag}.json"
        self._write(new["name"], json.dumps(new))
        self._write("CURRENT.next", new["name"])
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(f"{self.root}/CURRENT.next"), self._path(f"{self.root}/CURRENT"), options)
        self.manifest = new

    def committed(self, batch: str) -> bool:
        """Whether a batch of this name was ever committed."""
        return batch in self.manifest.get("batches", ()) or not self.table("batches").where(F.col("name") == batch).isEmpty()

    def next_id(self, name: str) -> int:
        """The id that the next row gets; ids of deleted rows aren't given again."""
        return self.manifest["next_id"].get(name, 1)

    def _upgrade(self, found: int) -> None:
        """Rewrites what older schemas hold differently: failed pages are tried again (2), placement is derived from the tree (below 7)."""
        tables = {}
        if found < 3 and "pages" in self.manifest["tables"]:
            pages = self.table("pages")
            again = F.col("status") == "failed"
            tables["pages"] = pages.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).withColumn("error", F.when(~again, F.col("error")))
        if found < 7 and "tags" in self.manifest["tables"]:
            tags = self.table("tags")
            parents = bounded(tags.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.lit(True).alias("above")).distinct())
            tables["tags"] = tags.join(parents, "id", "left").withColumn("placed", F.col("parent_id").isNotNull() | F.coalesce("above", F.lit(False))).drop("above")
        self.commit(schema=SCHEMA_VERSION, **tables)

    # Scans.

    def pending(self, limit: int | None = None) -> DataFrame:
        rows = self.table("pages").where("status = 'pending'").orderBy("id")
        return rows if limit is None else rows.limit(limit)

    def note_pages(self) -> DataFrame:
        """Pages that have a note: all but pending ones, with fallbacks for what is missing."""
        pages = self.table("pages").where("status != 'pending'")
        return pages.select("id", "url", "source", "status", F.coalesce("title", "url").alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "lang", "note_file", F.coalesce("processed_at", "added_at").alias("captured"), F.coalesce("page_title", "browser_title").alias("page_title")).orderBy("id")

    def vectors(self, kind: str, model: str) -> DataFrame:
        return self.table("embeddings").where((F.col("kind") == kind) & (F.col("model") == model)).select(F.col("ref_id").alias("id"), "vector")

    def missing_vectors(self, kind: str, model: str) -> DataFrame:
        """Tags, or done pages, without a vector of this model."""
        rows = self.table("tags") if kind == "tag" else self.table("pages").where("status = 'done'")
        return rows.join(self.vectors(kind, model).select("id"), "id", "left_anti")

    def failed_pages(self) -> DataFrame:
        pages = self.table("pages").where(F.col("status").isin("failed", "unreachable"))
        return pages.select("url", "status", F.coalesce("error_kind", F.lit("unknown")).alias("error_kind"), F.coalesce("error", F.lit("")).alias("error")).orderBy("status", "error_kind", "url")

    def latest_report(self) -> str | None:
        row = self.table("runs").orderBy(F.desc("id")).select("report").first()
        return row and row[0]

    def status_counts(self) -> dict[str, int]:
        found = {r["status"]: r["n"] for r in self.table("pages").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {s: found.get(s, 0) for s in STATUSES}

    def topic_tags(self) -> DataFrame:
        """(id, name, description, locked, placed, parent_id, pages) of tags on done pages, reserved ones aside."""
        done = self.table("pages").where("status = 'done'").select(F.col("id").alias("page_id"))
        n = self.table("page_tags").join(done, "page_id", "left_semi").select("page_id", "resolved_tag_id").distinct().groupBy(F.col("resolved_tag_id").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
        tags = self.table("tags").where(~F.col("name").startswith("status/"))
        return tags.join(n, "id").select("id", "name", "description", "locked", "placed", "parent_id", "pages").orderBy(F.desc("pages"), "name")

    def links(self) -> DataFrame:
        """(page_id, id) of tags on pages that aren't pending."""
        pages = self.table("pages").where("status != 'pending'").select(F.col("id").alias("page_id"))
        return self.table("page_tags").select("page_id", F.col("resolved_tag_id").alias("id")).distinct().join(pages, "page_id", "left_semi")

    # Changes that return tables for ``commit``.

    def numbered(self, name: str, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
        """(rows with new ids in order, next free id).

        Rows are sorted by range; each partition is numbered from the count of
        those before it, so that no task sees them all.
        """
        start = self.next_id(name)
        laid = rows.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
        laid = laid.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
        laid = cut(laid)
        sizes = {r["_part"]: r["n"] for r in laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
        before, total = {}, 0
        for part in sorted(sizes):
            before[part] = total
            total += sizes[part]
        shift = self.spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
        out = laid.join(F.broadcast(shift), "_part").withColumn("id", F.col("_before") + F.col("_n") + (start - 1))
        return out.drop("_part", "_n", "_before"), start + total

    def add_pages(self, rows: DataFrame, source: str = "list") -> int:
        """Adds pages of (line_no, url, original_url, title) whose url isn't known; how many were new."""
        first = F.row_number().over(Window.partitionBy("url").orderBy("line_no"))
        new = rows.withColumn("_first", first).where("_first = 1").drop("_first").join(self.table("pages").select("url"), "url", "left_anti")
        new, following = self.numbered("pages", new, ["line_no"])
        added = following - self.next_id("pages")
        if added:
            old = self.table("pages")
            fresh = new.select("id", "url", "original_url", F.col("title").alias("browser_title"), F.lit(source).alias("source"), F.lit("pending").alias("status"), F.current_timestamp().alias("added_at"))
            self.commit(pages=old.unionByName(fresh, allowMissingColumns=True), next_id={"pages": following})
        return added

    def retry_failed(self) -> None:
        """Failed and unreachable pages become pending; their title, tags and note file stay."""
        bad = F.col("status").isin("failed", "unreachable")
        clear = {c: F.when(~bad, F.col(c)) for c in ("error", "error_kind")}
        self.commit(pages=self.table("pages").withColumns({**clear, "status": F.when(bad, "pending").otherwise(F.col("status"))}))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys."""
    return old.join(bounded(new.select(*keys).distinct()), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys ``old`` lacks, added; of equal new keys one stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def save_results(state: State, results: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """Tables after pages were processed: every result column is overwritten, the note file stays, tags are replaced.

    ``results`` is (id, status, error, error_kind, title, summary, lang,
    page_title, processed_at); ``tags`` is (page_id, raw_tag, resolved_tag_id).
    """
    keep = ["id", "url", "original_url", "browser_title", "source", "note_file", "added_at"]
    pages = state.table("pages")
    changed = pages.select(*keep).join(results, "id")
    rest = pages.join(results.select("id"), "id", "left_anti")
    old = state.table("page_tags").join(results.select(F.col("id").alias("page_id")), "page_id", "left_anti")
    return {"pages": rest.unionByName(changed, allowMissingColumns=True), "page_tags": old.unionByName(tags.dropDuplicates(["page_id", "raw_tag"]))}
