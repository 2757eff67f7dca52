"""The term dictionary and the mapping store: table operations, and small local files behind them.

Order is a column (``ord``), as tables have none of their own.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from tagveil.functions import text as T
from tagveil.operators.order import numbered
from tagveil.sources.scratch import dealt, shared_dir

ENTRY = "term string, tag string, source string, ord long"
RECENT = 25
#: Bytes of JSON that Spark surely holds as a variant.
MOST_VARIANT = 1 << 24
_FILE_ENTRIES = ty.ArrayType(ty.StructType([ty.StructField("tag", ty.StringType()), ty.StructField("value", ty.StringType()), ty.StructField("count", ty.LongType())]))
_FILE = ty.StructType([ty.StructField("source", ty.StringType()), ty.StructField("generated", ty.StringType()), ty.StructField("entries", _FILE_ENTRIES)])


_TERM_ENTRIES = ty.ArrayType(ty.StructType([ty.StructField(n, ty.StringType()) for n in ("term", "tag", "source")]))
_TERM_FILE = ty.StructType([ty.StructField("entries", _TERM_ENTRIES)])
#: Names of a dictionary's file in its folder: today's, and one that is renamed where it is found alone.
DICTIONARY_FILE, OLD_DICTIONARY_FILE = "terms.json", "dictionary.json"


def merge(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of (term, tag, source, ord) by comparison key: the last incoming row wins, the first row's place stays."""
    sides = base.where("term != ''").withColumn("side", F.lit(0)).unionByName(incoming.where(T.strip(F.col("term")) != "").withColumn("side", F.lit(1)))
    keyed = sides.withColumn("key", T.norm_key(F.col("term")))
    won = keyed.groupBy("key").agg(F.max_by(F.struct("term", "tag", "source"), F.struct("side", "ord")).alias("w"), F.min(F.struct("side", "ord")).alias("place"))
    return _placed(won.select("w.term", "w.tag", "w.source", "place"))


def upsert(base: DataFrame, new: DataFrame) -> DataFrame:
    """Confirmed pairs into the dictionary: term and tag are replaced, how a term first came in is kept."""
    fresh = new.withColumn("term", T.strip(F.col("term"))).withColumn("tag", T.strip(F.col("tag"))).where("term != '' and tag != ''")
    sides = base.where("term != ''").withColumn("side", F.lit(0)).unionByName(fresh.withColumn("side", F.lit(1)))
    keyed = sides.withColumn("key", T.norm_key(F.col("term"))).withColumn("source", F.nullif(F.col("source"), F.lit("")))
    latest = F.max_by(F.struct("term", "tag", "side"), F.struct("side", "ord"))
    # of the base only the last row of a key exists; a new row without a source is "manual" and stays so
    of_base = F.max_by(F.when(F.col("side") == 0, F.col("source")), F.when(F.col("side") == 0, F.col("ord")))
    first_new = F.min_by(F.when(F.col("side") == 1, F.coalesce("source", F.lit("manual"))), F.when(F.col("side") == 1, F.col("ord")))
    won = keyed.groupBy("key").agg(latest.alias("w"), of_base.alias("old"), first_new.alias("new"), F.min(F.struct("side", "ord")).alias("place"))
    source = F.when(F.col("w.side") == 0, F.col("old")).otherwise(F.coalesce("old", "new"))
    return _placed(won.select("w.term", "w.tag", source.alias("source"), "place"))


def _placed(rows: DataFrame) -> DataFrame:
    """Give each row its number by ``place``: those of the base first."""
    return numbered(rows, ["place"], "ord").select("term", "tag", "source", "ord")


def add(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Terms typed in by hand: tags normalised, blank ones refused, source ``manual`` for new ones."""
    return upsert(base, pairs.withColumn("tag", T.normalize_tag(F.col("tag"))).withColumn("source", F.lit("manual")))


def learn(base: DataFrame, clean: DataFrame) -> DataFrame:
    """All confirmed entries of a redaction, used or not."""
    return upsert(base, clean.withColumn("source", F.lit("redaction")))


def remove(base: DataFrame, terms: DataFrame) -> DataFrame:
    """Without the entries whose comparison key is one of ``terms``."""
    keys = terms.select(T.norm_key(F.col("term")).alias("gone")).distinct()
    return base.join(keys, T.norm_key(F.coalesce("term", F.lit(""))) == F.col("gone"), "left_anti")


def all_entries(mappings: DataFrame, when: Column | None = None) -> DataFrame:
    """(tag, value, n) over all saved mappings (mapping_id, saved_at, entries): of a tag the newest entry, in order of first sight.

    ``when``, by which an entry is newer, may be given of those columns, its place ``pos`` and the entry ``e``.
    """
    each = mappings.select("mapping_id", "saved_at", F.posexplode_outer("entries").alias("pos", "e")).where("pos is not null and e.tag != ''")
    when = F.struct("saved_at", "mapping_id", "pos") if when is None else when
    won = each.groupBy("e.tag").agg(F.max_by("e", when).alias("w"), F.min(when).alias("first"))
    return numbered(won, ["first"], "ord").select("tag", F.col("w.value").alias("value"), F.col("w.count").alias("n"), "ord")


def recent(mappings: DataFrame, limit: int = RECENT) -> DataFrame:
    """Newest mappings' metadata, never their values; of the newest those that cannot be read (entries null) are left out."""
    meta = mappings.orderBy(F.col("saved_at").desc(), "mapping_id").limit(limit).where("entries is not null")
    return meta.select("mapping_id", F.coalesce("source", F.lit("document")).alias("source"), F.coalesce("generated", F.lit("")).alias("generated"), F.size("entries").alias("n"))


def count(mappings: DataFrame) -> DataFrame:
    """(n): how many mappings are saved."""
    return mappings.agg(F.count("*").alias("n"))


def forget(mappings: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the mappings of the valid ones among ``ids`` (mapping_id)."""
    return mappings.join(ids.where(T.mapping_id_valid(F.col("mapping_id"))), "mapping_id", "left_anti")


def savable(mappings: DataFrame) -> DataFrame:
    """Mappings with an id that may be a file name; others are left out without a word."""
    return mappings.where(T.mapping_id_valid(F.col("mapping_id")))


def parse(raw: DataFrame) -> DataFrame:
    """(mapping_id, json) to (mapping_id, source, generated, entries), other columns kept: an object with entries, or a bare list; entries are null if it is neither."""
    bare = F.col("json").rlike(r"^\s*\[")
    # a variant has a largest size; beyond it the text is walked
    walked = F.when(bare, F.json_array_length("json").isNotNull()).otherwise(F.json_object_keys("json").isNotNull())
    readable = F.when(F.octet_length("json") < MOST_VARIANT, F.try_parse_json("json").isNotNull()).otherwise(walked) & F.col("json").rlike(r"^\s*[\[{]")
    # a text is read as the one or the other, once
    o = F.when(bare, F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("generated"), F.from_json("json", _FILE_ENTRIES).alias("entries"))).otherwise(F.from_json("json", _FILE))
    read = F.transform(F.array(o), lambda o: o.withField("entries", F.when(bare & readable, o["entries"]).when(readable, F.coalesce(o["entries"], F.array().cast(_FILE_ENTRIES)))))[0]
    rest = [c for c in raw.columns if c not in ("mapping_id", "json")]
    return raw.select("mapping_id", read.alias("o"), *rest).select("mapping_id", "o.source", "o.generated", "o.entries", *rest)


def dictionary_entries(raw: DataFrame) -> DataFrame:
    """(file_id, json) of dictionary files to (file_id, term, tag, source, ord) in their order; what cannot be read has no entries."""
    entries = F.when(F.col("json").rlike(r"^\s*\["), F.from_json("json", _TERM_ENTRIES)).otherwise(F.from_json("json", _TERM_FILE)["entries"])
    # without a filter on the array's size, which would make it again
    listed = raw.select("file_id", F.posexplode_outer(entries).alias("at", "e")).where("at is not null")
    return listed.select("file_id", "e.term", "e.tag", "e.source", F.col("at").cast("long").alias("ord"))


def resolve(saved: DataFrame, uploaded: DataFrame | None = None, inline: DataFrame | None = None) -> DataFrame:
    """The mapping to restore with: an uploaded one, else one given in the call, else the union of all saved."""
    given = uploaded if uploaded is not None else inline
    found = all_entries(saved) if given is None else given.select("tag", "value", "n", "ord")
    if found.isEmpty():
        raise ValueError("there is no mapping to restore with: redact something first, or give a mapping")
    return found


def dictionary_path(override: str | None = None, folder: str | None = None, default: str = "~/.tagveil") -> Path:
    """Where the dictionary is: a file named outright, else in the chosen folder, else in the default one.

    A file under the old name is given the new one if there is none yet; where that fails, the old one is used.
    """
    if override:
        return Path(override)
    place = Path(folder or default).expanduser()
    new, old = place / DICTIONARY_FILE, place / OLD_DICTIONARY_FILE
    if not new.exists() and old.exists():
        try:
            old.rename(new)
        except OSError:
            return old
    return new


class Dictionary:
    """A dictionary file (JSON, private to the user), small by nature, with the operations above.

    A plain path is a file of the driver's user, read as it is at the time. A path with a scheme
    (``hdfs:``, ``file:``, ...) is a file of that filesystem, read by tasks when rows are asked for.
    """

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.shared = spark, bool(re.match("[a-zA-Z][a-zA-Z0-9+.-]+:", str(path)))
        self.path = str(path) if self.shared else Path(path)

    def load(self) -> DataFrame:
        """An unreadable or missing file is an empty dictionary; a bare list of entries is one, too."""
        if self.shared:
            fs, path = _hadoop(self.spark, self.path)
            if fs.exists(path):
                raw = self.spark.read.format("binaryFile").load(self.path).select(F.lit("").alias("file_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("json"))
                # one task reads the file; what is made of its entries is no longer that task's
                return dealt(dictionary_entries(raw).select("term", "tag", "source", "ord"), "ord")
            return self.spark.createDataFrame([], ENTRY)
        try:
            data = json.loads(self.path.read_text("utf-8"))
            rows = data.get("entries", []) if isinstance(data, dict) else data
            rows = [(e.get("term"), e.get("tag"), e.get("source"), i) for i, e in enumerate(rows or [])]
        except (OSError, ValueError, AttributeError, TypeError):
            rows = []
        return self.spark.createDataFrame(rows, ENTRY)

    def save(self, entries: DataFrame) -> DataFrame:
        head = {"note": "Saved terms. Private; may be deleted."}
        if self.shared:
            lines = F.to_json(F.struct("term", "tag", "source"))
            _put(self.spark, *self.path.rsplit("/", 1), head, entries.orderBy("ord").select(lines))
        else:
            rows = ({k: v for k, v in (("term", r.term), ("tag", r.tag), ("source", r.source)) if v is not None} for r in entries.orderBy("ord").toLocalIterator())
            _private(self.path, _json(head, rows))
        return self.load()

    def upsert(self, new: DataFrame) -> DataFrame:
        return self.save(upsert(self.load(), new))

    def add(self, pairs: DataFrame) -> DataFrame:
        return self.save(add(self.load(), pairs))

    def remove(self, term: str) -> DataFrame:
        return self.save(remove(self.load(), self.spark.createDataFrame([(term,)], "term string")))

    def clear(self) -> None:
        if self.shared:
            fs, path = _hadoop(self.spark, self.path)
            fs.delete(path, False)
        else:
            self.path.unlink(missing_ok=True)

    def _place(self) -> str:
        """The whole address of the file, the same for every way to write it."""
        if not self.shared:
            return f"file:{self.path.resolve()}"
        fs, path = _hadoop(self.spark, self.path)
        return fs.makeQualified(path).toString()

    def move(self, path: str) -> Dictionary:
        """Merge into the file at the new place and give up the old one; the same place changes nothing."""
        other = Dictionary(self.spark, path)
        if other._place() == self._place():
            return self
        if not other.shared:
            _usable(other.path.parent)
        other.save(merge(other.load(), self.load()))
        self.clear()
        return other

    def reset(self, default: str) -> Dictionary:
        """Back to the default place, with what is there and here; the file here is left."""
        other = Dictionary(self.spark, default)
        if other._place() != self._place():
            other.save(merge(other.load(), self.load()))
        return other


class MappingStore:
    """A folder of mapping files, one a redaction, on any filesystem that Spark reads; the driver lists names, tasks read contents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder)

    def _at(self, name: str = ""):
        """(filesystem, path) of a name in the folder."""
        return _hadoop(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def save(self, mapping_id: str, text: str) -> None:
        if _valid(mapping_id):
            _put(self.spark, self.folder, f"{mapping_id}.json", text)

    def save_rows(self, mapping_id: str, source: str, generated: str, rows: DataFrame) -> None:
        """A mapping of (tag, value, n), longest tags first, made by tasks. The same id again replaces it; an invalid one is left out without a word."""
        if _valid(mapping_id):
            lines = F.to_json(F.struct("tag", "value", F.col("n").alias("count")), {"ignoreNullFields": "false"})
            _put(self.spark, self.folder, f"{mapping_id}.json", {"source": source, "generated": generated}, rows.orderBy(F.length("tag").desc(), "tag").select(lines))

    def _raw(self) -> DataFrame:
        """(mapping_id, saved_at, json) of all files, read by tasks."""
        fs, path = self._at()
        if not (fs.exists(path) and fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*.json"))):
            return self.spark.createDataFrame([], "mapping_id string, saved_at long, json string")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.folder)
        name = F.regexp_extract(F.url_decode("path") if "%" in self.folder else F.col("path"), r"([^/]*)\.json$", 1)
        return files.select(name.alias("mapping_id"), F.unix_micros("modificationTime").alias("saved_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("json"))

    def load(self) -> DataFrame:
        """(mapping_id, source, generated, entries, saved_at); a file that cannot be read has no entries."""
        return parse(self._raw())

    def get(self, mapping_id: str) -> str | None:
        found = self._raw().where(F.col("mapping_id") == mapping_id).first() if _valid(mapping_id) else None
        return found and found["json"]

    def recent(self, limit: int = RECENT) -> DataFrame:
        return recent(self.load(), limit)

    def count(self) -> int:
        fs, path = self._at()
        return len(fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "*.json")) or ()) if fs.exists(path) else 0

    def all_entries(self) -> DataFrame:
        return all_entries(self.load())

    def forget(self, mapping_id: str) -> bool:
        if not _valid(mapping_id):
            return False
        fs, path = self._at(f"{mapping_id}.json")
        return bool(fs.exists(path) and fs.delete(path, False))


def _valid(mapping_id: str) -> bool:
    return bool(mapping_id) and all(c.isascii() and (c.isalnum() or c in "_-") for c in mapping_id)


def _hadoop(spark: SparkSession, name: str):
    """(filesystem, path) of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _put(spark: SparkSession, folder: str, name: str, head: dict[str, str] | str, entries: DataFrame | None = None) -> None:
    """A file on any filesystem, written whole under another name first, for the owner's eyes: a text, or an object with ``entries`` (one column of JSON, sorted) as its last member.

    Tasks write the entries in pieces beside the file, which are then copied into it as streams.
    """
    fs, path = _hadoop(spark, f"{folder}/{name}")
    _, draft = _hadoop(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    private = spark._jvm.org.apache.hadoop.fs.permission.FsPermission
    fs.mkdirs(path.getParent(), private("700"))
    made = _pieces(spark, entries) if entries is not None else None
    out = fs.create(draft, True)
    fs.setPermission(draft, private("600"))
    try:
        if made is None:
            out.write(head.encode("utf-8"))
        else:
            out.write((json.dumps(head)[:-1] + ', "entries": [\n').encode("utf-8"))
            for piece, size in made:
                source = piece.getFileSystem(spark._jsc.hadoopConfiguration()).open(piece)
                try:
                    spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size)
                finally:
                    source.close()
            out.write(b"\n]}")
    finally:
        out.close()
        for piece, _ in made or ():
            piece.getFileSystem(spark._jsc.hadoopConfiguration()).delete(piece, False)
    fs.delete(path, False)
    fs.rename(draft, path)


def _pieces(spark: SparkSession, entries: DataFrame) -> list[tuple]:
    """(path, bytes) of the pieces of a list, in its order: a line an entry, with a comma behind each but the last."""
    between = ",\n"
    fs, folder = _hadoop(spark, f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}")
    entries.write.option("lineSep", between).option("compression", "none").text(folder.toString())
    found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen())
    pieces = [(spark._jvm.org.apache.hadoop.fs.Path(folder, name), size) for name, size in found]
    return pieces[:-1] + [(path, size - len(between)) for path, size in pieces[-1:]]


def _usable(folder: Path) -> None:
    """Refuse a folder that cannot be written to."""
    try:
        folder.mkdir(mode=0o700, parents=True, exist_ok=True)
    except OSError as e:
        raise ValueError(f"this folder cannot be used: {folder}") from e
    if not os.access(folder, os.W_OK):
        raise ValueError(f"this folder cannot be written to: {folder}")


def _json(head: dict[str, str], entries: Iterable[dict]) -> Iterator[str]:
    """An object with ``entries`` as its last member, piece by piece."""
    yield json.dumps(head)[:-1] + ', "entries": ['
    for i, e in enumerate(entries):
        yield (",\n" if i else "\n") + json.dumps(e)
    yield "\n]}"


def _private(path: Path, pieces: Iterable[str]) -> None:
    """Write whole or not at all, for the owner's eyes."""
    path.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)  # made with mode 0600
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.writelines(pieces)
    os.replace(name, path)
