"""Entity tables in a folder, dealt into buckets by uuid, and manifests that say which files are current.

Parquet has no updates in place. A write makes new files for the buckets that it touches
and then adds a manifest with the next number, so that readers see all tables of a
transaction or none, and keep the manifest they began with. A manifest is put in place
only if no other has its number: of two writers the second begins again on the first
one's result or, where both touched the same, fails. The folder's file system must rename
atomically and refuse to rename over a file, as HDFS does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, MapType, StringType, StructField, StructType, VariantType

from ..errors import CommitConflict, DuplicateEntity, EntityNotFound, PersistenceError, TransactionFailed, VersionConflict, spark_errors, translated
from ..functions import files
from .manifests import Entry, Manifest, Manifests

Stage = Callable[[DataFrame], DataFrame]


#: The order in which handlers of a save run, whatever the order in which they are given.
HANDLERS = ("index", "embed", "version", "cascade")


def _ordered(kind: DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _order(rows: DataFrame) -> list[Column]:
    """By what the rows of one key are compared, see `unique`."""
    times = [F.col("updated_at")] if "updated_at" in rows.columns else []
    plain = [F.col(f.name) for f in rows.schema.fields if _ordered(f.dataType)]
    others = [F.to_json(F.struct(f.name)) for f in rows.schema.fields if not _ordered(f.dataType)]
    return [*times, *plain, *others]


def unique(rows: DataFrame, key: str = "uuid") -> DataFrame:
    """One row of each key: the one updated last, of those the greatest by all columns in turn.

    Columns that have no order (maps, variants) are compared as JSON, behind the others.
    """
    order = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_order(rows))))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def merged(old: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """`old` with the rows of `new` added or put in place of those with the same key.

    A key stays unique when `new` has it several times, see `unique`.
    """
    new = unique(new, key)
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def marked_synced(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows of `confirmed` (uuid, sync_id) become synced, with that id; others stay as they are."""
    given = confirmed.groupBy("uuid").agg(F.max("sync_id").alias("__sync"), F.lit(True).alias("__done"))
    both = rows.join(given, "uuid", "left")
    status = F.when(F.col("__done"), "synced").otherwise(F.col("sync_status"))
    return both.withColumns({"sync_id": F.coalesce("__sync", "sync_id"), "sync_status": status}).drop("__sync", "__done")


def without(old: DataFrame, keys: DataFrame, key: str = "uuid") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def inserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The rows of `new` whose key is not in `old`; of equals in `new` the first by all columns."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    row = F.struct(*fresh.columns)
    return fresh.groupBy(*keys).agg(F.min(row).alias("row")).select("row.*")


def compare_and_set(stored: DataFrame, incoming: DataFrame, key: str = "uuid", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(applied, conflicts): incoming rows whose version is the stored one, with the next
    version; and the others, missing keys included."""
    known = stored.select(F.col(key), F.col(version).alias("__stored"))
    both = incoming.join(known, key, "left")
    same = F.col("__stored").eqNullSafe(F.col(version)) & F.col("__stored").isNotNull()
    applied = both.filter(same).withColumn(version, F.col(version) + 1).drop("__stored")
    return applied, both.filter(~same).withColumnRenamed("__stored", "stored_version")


def nulled_references(rows: DataFrame, column: str, deleted: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows with references to deleted keys set to null."""
    gone = deleted.select(F.col(key).alias("__gone")).distinct()
    joined = rows.join(gone, rows[column] == gone["__gone"], "left")
    return joined.withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


#: Bytes of a bucket, on average, beyond which a table is dealt anew into more of them.
BUCKET_BYTES = 64 << 20
#: Buckets of a new table.
BUCKETS = 8
#: How often a single operation is tried when other writers come in between.
TRIES = 10

_BUCKET, _NEW = "bucket__", "new__"


def _bucket(buckets: int, key: str = "uuid") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bytes(rows: DataFrame) -> int:
    """About how many bytes rows have, unpacked; nested values and numbers count as eight."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in rows.schema.fields if isinstance(f.dataType, (StringType, BinaryType))]
    each = F.lit(8 * (len(rows.columns) - len(wide))).cast("long")
    return rows.select(sum(wide, each).alias("n")).agg(F.sum("n")).first()[0] or 0


def _marked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both together, told apart by a column, for `_upserted` and `_deleted`."""
    return old.withColumn(_NEW, F.lit(False)).unionByName(new.withColumn(_NEW, F.lit(True)), allowMissingColumns=True)


def _upserted(rows: DataFrame) -> DataFrame:
    """What `merged` gives, of marked rows that are dealt by bucket: they need not be exchanged for it, nor sorted again to be written."""
    order = Window.partitionBy(_BUCKET, "uuid").orderBy(F.desc(_NEW), *(c.desc() for c in _order(rows.drop(_BUCKET, _NEW))))
    seen = rows.withColumns({"place__": F.row_number().over(order), "newest__": F.first(_NEW).over(order)})
    return seen.filter(~F.col("newest__") | (F.col("place__") == 1) | F.col("uuid").isNull() & ~F.col(_NEW)).drop("place__", "newest__", _NEW)


def _deleted(rows: DataFrame) -> DataFrame:
    """What `without` gives, of marked rows that are dealt by bucket, the new ones being the keys."""
    gone = F.max(_NEW).over(Window.partitionBy(_BUCKET, "uuid"))
    return rows.withColumn("gone__", gone).filter(~F.col(_NEW) & (~F.col("gone__") | F.col("uuid").isNull())).drop("gone__", _NEW)


class Snapshot:
    """The tables of one manifest: what is read from it never sees a later commit."""

    def __init__(self, store: EntityStore, manifest: Manifest):
        self.store, self.manifest = store, manifest

    def _entry(self, name: str) -> Entry | None:
        return self.manifest.tables.get(name)

    def _known(self, name: str) -> Entry:
        entry = self._entry(name)
        if entry is None:
            raise EntityNotFound(f"there is no table {name}")
        return entry

    def _rows(self, entry: Entry, buckets=None) -> DataFrame:
        """The rows of some buckets of an entry, or of all."""
        schema = StructType.fromJson(entry.schema)
        paths = [f"{self.store.root}/{path}" for k, (path, _, _) in entry.buckets.items() if buckets is None or k in buckets]
        return self.store.spark.read.schema(schema).parquet(*paths) if paths else self.store.spark.createDataFrame([], schema)

    def tables(self) -> list[str]:
        return sorted(self.manifest.tables)

    def read(self, name: str) -> DataFrame:
        with spark_errors(name):
            return self._rows(self._known(name))

    def query(self, name: str, ask: Callable[[DataFrame], DataFrame]) -> list:
        """The rows of `ask` applied to a table; what is wrong with it is QueryFailed."""
        with spark_errors(name):
            return ask(self.read(name)).collect()

    def find(self, name: str, key) -> DataFrame:
        """The row of a key, or none; only its bucket is read."""
        with spark_errors(name):
            entry = self._known(name)
            kind = StructType.fromJson(entry.schema)["uuid"].dataType
            (at,) = self.store.spark.sql("SELECT 1").select(F.pmod(F.xxhash64(F.lit(key).cast(kind)), F.lit(entry.dealt)).cast("int")).first()
            return self._rows(entry, {at}).filter(F.col("uuid") == key).limit(1)

    def get(self, name: str, key):
        """The row of a key; EntityNotFound without one."""
        found = self.find(name, key)
        with spark_errors(name):
            row = found.first()
        if row is None:
            raise EntityNotFound(f"{name} has no {key}")
        return row

    def count(self, name: str) -> int:
        """How many rows a table has, by its manifest."""
        return sum(rows for _, _, rows in self._known(name).buckets.values())


class Transaction(Snapshot):
    """Reads of one manifest and writes that become current together, with `commit`.

    Reads see the transaction's own writes. It fails with CommitConflict if another commit
    has since changed a table that it read whole, or a bucket that it writes.
    """

    def __init__(self, store: EntityStore, manifest: Manifest):
        super().__init__(store, manifest)
        self.changes: dict[str, Entry] = {}
        self.touched: dict[str, set[int] | None] = {}  # None: all buckets
        self.seen: set[str] = set()

    def _entry(self, name):
        return self.changes.get(name) or super()._entry(name)

    def read(self, name):
        self.seen.add(name)
        return super().read(name)

    # Files ---------------------------------------------------------------------------

    @contextmanager
    def _failing(self, name: str) -> Iterator[None]:
        """What goes wrong with a write is one of the store's errors."""
        try:
            yield
        except Exception as e:
            found = translated(e, name)
            raise (TransactionFailed(str(found)) if type(found) is PersistenceError else found) from e

    def _staged(self, name: str, rows: DataFrame, dealt: int, within: Stage | None = None) -> dict[int, tuple[str, int, int]]:
        """Writes rows by bucket; path, bytes and rows of each bucket that has any.

        within: is applied to the rows when they have been dealt, so that what it does by
        bucket and uuid costs no further exchange.
        """
        where = f"{name}/rows-{uuid.uuid4().hex}"
        path = f"{self.store.root}/{where}"
        with self._failing(name):
            rows = rows.withColumn(_BUCKET, _bucket(dealt)).repartition(_BUCKET)
            (within(rows) if within else rows).write.partitionBy(_BUCKET).parquet(path)
            sizes = self.store.manifests.sizes(where, f"{_BUCKET}=")
            if not sizes:
                return {}
            counts = dict(self.store.spark.read.parquet(path).groupBy(_BUCKET).count().collect())  # from the footers
        return {k: (f"{where}/{_BUCKET}={k}", size, counts.get(k, 0)) for k, size in sizes.items()}

    def _incoming(self, name: str, rows: DataFrame, dealt: int) -> tuple[DataFrame, set[int]]:
        """Rows written once, as they may come out otherwise the next time, and the buckets they are for."""
        path = f"{self.store.root}/{name}/incoming-{uuid.uuid4().hex}"
        with self._failing(name):
            rows.withColumn(_BUCKET, _bucket(dealt)).write.parquet(path)
            read = self.store.spark.read.schema(StructType([*rows.schema.fields, StructField(_BUCKET, IntegerType())])).parquet(path)
            touched = {r[0] for r in read.select(_BUCKET).distinct().collect()}
        return read.drop(_BUCKET), touched

    def _put(self, name: str, rows: DataFrame, touched: set[int] | None, within: Stage | None = None) -> None:
        """Rows in place of the touched buckets, or of all; deals the table anew where buckets have grown too large.

        A new table's rows are measured before they are dealt, by reading them once more.
        """
        old = self._entry(name)
        schema = rows.drop(_NEW).schema
        if old:
            dealt = old.dealt
        else:
            with self._failing(name):
                dealt = self._enough(_bytes(rows), self.store.buckets)
        new = self._staged(name, rows, dealt, within)
        kept = {} if touched is None or old is None else {k: v for k, v in old.buckets.items() if k not in touched}
        entry = Entry(schema.jsonValue(), dealt, kept | new)
        more = self._enough(sum(size for _, size, _ in entry.buckets.values()), dealt)
        if more > dealt:
            entry, touched = Entry(entry.schema, more, self._staged(name, self._rows(entry), more)), None
        self.changes[name] = entry
        before = self.touched.get(name, set())
        self.touched[name] = None if touched is None or before is None or old is None else before | touched

    def _enough(self, size: int, dealt: int) -> int:
        """As many buckets, or so many more that so many bytes fill half of them."""
        if size > self.store.bucket_bytes * dealt:
            while size * 2 > self.store.bucket_bytes * dealt:
                dealt *= 2
        return dealt

    # Writes --------------------------------------------------------------------------

    def replace(self, name: str, rows: DataFrame) -> None:
        """`rows` in place of the whole table."""
        self._put(name, rows, None)

    def save(self, name: str, rows: DataFrame) -> None:
        """Upsert; of rows with one uuid one stays, see `unique`."""
        entry = self._entry(name)
        if entry is None:
            self._put(name, rows.withColumn(_NEW, F.lit(True)), None, _upserted)
            return
        known = {f.name: f.dataType for f in StructType.fromJson(entry.schema).fields}
        if any(known.get(f.name, f.dataType) != f.dataType for f in rows.schema.fields):
            self._put(name, merged(self.read(name), rows), None)  # a column gets another type
            return
        rows, touched = self._incoming(name, rows, entry.dealt)
        self._put(name, _marked(self._rows(entry, touched), rows), touched, _upserted)

    def combine(self, name: str, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`how(old, rows)` in place of the buckets that rows (each uuid once) belong to; a missing table counts as empty."""
        entry = self._entry(name)
        if entry is None:
            self._put(name, how(rows.limit(0), rows), None)
            return
        rows, touched = self._incoming(name, rows, entry.dealt)
        if touched:
            self._put(name, how(self._rows(entry, touched), rows), touched)

    def insert(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Adds rows; DuplicateEntity if a unique key is stored already or comes twice."""
        keys = keys or ("uuid",)
        entry = self._entry(name)
        touched = None
        if entry is not None:
            rows, touched = self._incoming(name, rows, entry.dealt)
        there = rows.limit(0) if entry is None else self._rows(entry, touched) if keys == ("uuid",) else self.read(name)
        twice = rows.groupBy(*keys).count().filter("count > 1")
        if not rows.join(there.select(*keys), list(keys), "left_semi").isEmpty() or not twice.isEmpty():
            raise DuplicateEntity(f"{name}: {', '.join(keys)} must be unique")
        old = rows.limit(0) if entry is None else self._rows(entry, touched)
        self._put(name, old.unionByName(rows), touched)

    def delete(self, name: str, keys: DataFrame, before: list[Stage] = ()) -> DataFrame | None:
        """Deletes keys; the rows that went, None where no key is there."""
        entry = self._known(name)
        kind = StructType.fromJson(entry.schema)["uuid"].dataType
        keys, touched = self._incoming(name, keys.select(F.col("uuid").cast(kind).alias("uuid")).distinct(), entry.dealt)
        old = self._rows(entry, touched)
        gone = old.join(keys, "uuid", "left_semi")
        if gone.isEmpty():
            return None
        for stage in before:
            stage(gone)
        self._put(name, _marked(old, keys), touched, _deleted)
        return gone

    def delete_where(self, name: str, condition: Column) -> int:
        """Deletes rows that meet a condition; how many. Only their buckets are written."""
        entry = self._known(name)
        found = self._rows(entry).filter(condition).groupBy(_bucket(entry.dealt).alias("b")).count().collect()
        if found:
            touched = {r["b"] for r in found}
            self._put(name, self._rows(entry, touched).filter(~F.coalesce(condition, F.lit(False))), touched)
        return sum(r["count"] for r in found)

    def clear(self, name: str) -> int:
        """Deletes all rows of a table without reading them; the table stays."""
        entry = self._known(name)
        n = self.count(name)
        self.changes[name], self.touched[name] = Entry(entry.schema, entry.dealt, {}), None
        return n

    def swap(self, name: str, rows: DataFrame) -> DataFrame:
        """Compare and set: rows whose version is stored are written, the conflicts returned."""
        entry = self._known(name)
        rows, touched = self._incoming(name, rows, entry.dealt)
        old = self._rows(entry, touched)
        if not rows.join(old.select("uuid"), "uuid", "left_anti").isEmpty():
            raise EntityNotFound(f"{name}: a key is missing")
        applied, conflicts = compare_and_set(old, rows)
        self._put(name, _marked(old, applied), touched, _upserted)
        return conflicts

    def mark_synced(self, name: str, confirmed: DataFrame) -> None:
        """See marked_synced."""
        entry = self._known(name)
        confirmed, touched = self._incoming(name, confirmed, entry.dealt)
        self._put(name, marked_synced(self._rows(entry, touched), confirmed), touched)

    # The end -------------------------------------------------------------------------

    def _conflict(self, name: str, now: Manifest) -> bool:
        mine, theirs, touched = self.manifest.tables.get(name), now.tables.get(name), self.touched.get(name)
        if mine == theirs:
            return False
        if mine is None or theirs is None or name in self.seen or touched is None or (mine.schema, mine.dealt) != (theirs.schema, theirs.dealt):
            return True
        return any(mine.buckets.get(k) != theirs.buckets.get(k) for k in touched)

    def commit(self) -> None:
        """Makes all writes current at once, or none: CommitConflict."""
        while self.changes:
            now = self.store.manifests.latest()
            if bad := [n for n in sorted(self.seen | set(self.changes)) if self._conflict(n, now)]:
                raise CommitConflict(f"{', '.join(bad)}: changed by another commit")
            tables = dict(now.tables)
            for name, entry in self.changes.items():
                touched = self.touched[name]
                others = {} if touched is None else {k: v for k, v in tables[name].buckets.items() if k not in touched}
                own = entry.buckets if touched is None else {k: v for k, v in entry.buckets.items() if k in touched}
                tables[name] = Entry(entry.schema, entry.dealt, others | own)
            if self.store.manifests.put(Manifest(now.version + 1, tables)):
                self.manifest, self.changes, self.touched, self.seen = Manifest(now.version + 1, tables), {}, {}, set()


class EntityStore:
    """Tables of entities with a unique `uuid`, below one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.buckets, self.bucket_bytes = spark, root.rstrip("/"), buckets, bucket_bytes
        self.manifests = Manifests(spark, self.root)

    def snapshot(self) -> Snapshot:
        """The tables as they are now, for several reads of one state."""
        return Snapshot(self, self.manifests.latest())

    def transaction(self) -> Transaction:
        return Transaction(self, self.manifests.latest())

    def _tried(self, name: str, write: Callable[[Transaction], object]):
        """One operation in a transaction of its own, begun again where another writer was faster."""
        for last in [*[False] * (TRIES - 1), True]:
            transaction = self.transaction()
            with spark_errors(name):
                result = write(transaction)
            try:
                transaction.commit()
                return result
            except CommitConflict:
                if last:
                    raise

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Puts all tables in place at once, whatever was there; TransactionFailed if that fails."""

        def write(transaction):
            for name, rows in tables.items():
                transaction.replace(name, rows)

        self._tried(", ".join(tables), write)

    def tables(self) -> list[str]:
        return self.snapshot().tables()

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def query(self, name: str, ask: Callable[[DataFrame], DataFrame]) -> list:
        return self.snapshot().query(name, ask)

    def find(self, name: str, key) -> DataFrame:
        return self.snapshot().find(name, key)

    def get(self, name: str, key):
        return self.snapshot().get(name, key)

    def count(self, name: str) -> int:
        return self.snapshot().count(name)

    def save(self, name: str, rows: DataFrame, touch: Column | None = None, before: list[Stage] = (), after: list[Stage] = (), handlers: dict[str, Stage] | None = None) -> DataFrame:
        """Upsert. `before` stages change the rows and may raise; `after` stages see the result.

        handlers: stages by name, which run behind those of `after` in the order of HANDLERS.
        """
        if unknown := set(handlers or ()) - set(HANDLERS):
            raise ValueError(f"handlers are {', '.join(HANDLERS)}, not {', '.join(sorted(unknown))}")
        if touch is not None:
            rows = rows.withColumn("updated_at", touch)
        for stage in before:
            rows = stage(rows)
        self._tried(name, lambda t: t.save(name, rows))
        saved = self.read(name)
        for stage in [*after, *(handlers[h] for h in HANDLERS if handlers and h in handlers)]:
            stage(saved)
        return saved

    def insert(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Adds rows; DuplicateEntity if a unique key is stored already or comes twice."""
        self._tried(name, lambda t: t.insert(name, rows, *keys))

    def delete(self, name: str, keys: DataFrame, before: list[Stage] = (), after: list[Stage] = ()) -> int:
        """Deletes keys, missing ones are ignored; how many rows went.

        `before` stages see the rows that will go and may raise, `after` stages the rows
        that went; neither runs where no key is there.
        """
        gone = self._tried(name, lambda t: t.delete(name, keys, before))
        if gone is None:
            return 0
        for stage in after:
            stage(gone)  # read from the files before, which stay until a vacuum
        return gone.count()

    def clear(self, name: str) -> int:
        """Deletes all rows of a table; the table stays."""
        return self._tried(name, lambda t: t.clear(name))

    def delete_where(self, name: str, condition: Column) -> int:
        """Deletes rows that meet a condition; how many."""
        return self._tried(name, lambda t: t.delete_where(name, condition))

    def swap(self, name: str, rows: DataFrame) -> DataFrame:
        """Compare and set: rows whose version is stored are written, the conflicts returned."""
        return self._tried(name, lambda t: t.swap(name, rows))

    def swap_one(self, name: str, row: DataFrame) -> None:
        if not self.swap(name, row).isEmpty():
            raise VersionConflict(name)

    def mark_synced(self, name: str, confirmed: DataFrame) -> None:
        """See marked_synced."""
        self._tried(name, lambda t: t.mark_synced(name, confirmed))

    def vacuum(self, age_seconds: float = 7 * 24 * 3600) -> int:
        """Removes manifests older than that, but for the current one, and files that no other names; how many folders.

        Readers and writers that began longer ago than the age lose their files.
        """
        return self.manifests.vacuum(int((time.time() - age_seconds) * 1000))


class BlobStore:
    """Binary contents by id, in a table `blobs` (uuid, content) of an entity store."""

    def __init__(self, store: EntityStore):
        self.store = store

    def all(self) -> DataFrame:
        if "blobs" in self.store.tables():
            return self.store.read("blobs")
        return self.store.spark.createDataFrame([], "uuid string, content binary")

    def save(self, blobs: DataFrame) -> None:
        """Writes blobs (uuid, content), over those with the same id."""
        self.store.save("blobs", blobs.select("uuid", "content"))

    def load(self, ids: DataFrame) -> DataFrame:
        """uuid, content of the ids that are there."""
        return self.all().join(ids.select("uuid").distinct(), "uuid", "left_semi")

    def delete(self, ids: DataFrame) -> int:
        """How many of the ids were there."""
        return self.store.delete("blobs", ids) if "blobs" in self.store.tables() else 0

    def sizes(self, ids: DataFrame) -> DataFrame:
        return blob_sizes(ids, self.all())

    def slices(self, ids: DataFrame, size: int = 65_536) -> DataFrame:
        return blob_slices(self.load(ids), size)


def blob_sizes(ids: DataFrame, blobs: DataFrame) -> DataFrame:
    """uuid, present, size of each id; -1 where there is no blob."""
    known = blobs.select("uuid", F.octet_length("content").cast("long").alias("size"))
    rows = ids.select("uuid").join(known, "uuid", "left")
    return rows.select("uuid", F.col("size").isNotNull().alias("present"), F.coalesce("size", F.lit(-1).cast("long")).alias("size"))


def blob_slices(blobs: DataFrame, size: int = 65_536) -> DataFrame:
    """uuid, position, slice: contents in slices of `size` bytes; an empty one has none."""
    return blobs.select("uuid", F.posexplode(files.slices(F.col("content"), size)).alias("position", "slice"))


def blob_metadata(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """The ids' rows of the metadata table and whether it has them."""
    rows = ids.select("uuid").join(metadata.withColumn("remote", F.lit(True)), "uuid", "left")
    return rows.withColumn("remote", F.coalesce("remote", F.lit(False)))


def described(tables: dict[str, DataFrame]) -> list[tuple[str, str, int, str]]:
    """(table, column, position, type) of tables, for a catalogue's listing."""
    return [(name, f.name, i + 1, f.dataType.simpleString()) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]


def typed_view(entities: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """Entities of one type with fields of their JSON as columns (name: Spark type)."""
    picked = [F.get_json_object("data", f"$.{name}").cast(t).alias(name) for name, t in fields.items()]
    return entities.filter((F.col("type") == kind) & F.col("deleted_at").isNull()).select("uuid", *picked)


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
