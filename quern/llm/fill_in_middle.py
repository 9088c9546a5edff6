"""Fill-in-the-middle transformation by secondary sort.

Each text is cut into a prefix, a middle and a suffix, and these into pieces of bounded
length. The pieces are dealt by document and sorted by document and output position
within their partition (what RDD.repartitionAndSortWithinPartitions does, in its
DataFrame form, so that texts stay in Spark's own rows). A task then streams through them:
digests grow piece by piece, and no document is ever put together to be digested. To
restore the texts, the pieces that were read back from the output are sorted again, by
source position, within the same partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What begins the prefix, the middle and the suffix in an output (fixed values).
MARKERS = ("<P>", "<M>", "<S>")
#: Order of the parts in each form's output: 0 the prefix, 1 the middle, 2 the suffix.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Percent of texts that are transformed, and of these that have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points of a piece at most.
UNIT = 1 << 16

_MARKED = re.compile("|".join(MARKERS))
_PARTS = {m.encode(): i for i, m in enumerate(MARKERS)}
_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_NAMES = [c.split()[0] for c in _HEAD.split(", ")]
_KEY = ["doc_id", "h", "g"]

#: Rows and bytes of the Arrow batches that a task gives.
_ROWS, _BYTES = 2000, 4 << 20


def _drawn(i: int, digest: Column) -> Column:
    """The digest's group number i of eight hexadecimal digits, as a number."""
    return F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")


def planned(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, h, g, text, n, form, prefix_chars, middle_chars: how each text will be cut.

    h and g are two hashes of the text; with doc_id they name equal rows alike.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn("cuts", F.array(*(_drawn(i, digest) % (F.col("n") + 1) for i in (0, 1))))
    plain = (F.col("n") == 0) | F.col("text").rlike("|".join(MARKERS)) | (_drawn(2, digest) % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(_drawn(3, digest) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    low, high = F.array_min("cuts"), F.array_max("cuts")
    sizes = [F.when(~plain, c).alias(name) for c, name in ((low, "prefix_chars"), (high - low, "middle_chars"))]
    return rows.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"), "text", "n", form.alias("form"), *sizes)


def _units(text: str) -> Iterator[str]:
    """A text in pieces; an empty one is one empty piece."""
    for at in range(0, max(1, len(text)), UNIT):
        yield text[at : at + UNIT]


def output_pieces(text: str, form: str, prefix: int | None, middle: int | None) -> Iterator[bytes]:
    """The output piece by piece; each part begins a piece, with its marker in front."""
    if form == "plain":
        yield from (u.encode() for u in _units(text))
        return
    parts = (text[:prefix], text[prefix : prefix + middle], text[prefix + middle :])
    for part in ORDERS[form]:
        mark = MARKERS[part]
        for unit in _units(parts[part]):
            yield (mark + unit).encode()
            mark = ""


class _Rows:
    """Rows for Arrow batches of bounded size."""

    def __init__(self, schema: str, spark_types: dict[str, pa.DataType]):
        self.schema = pa.schema([(c.split()[0], spark_types[c.split()[1]]) for c in schema.split(", ")])
        self.rows, self.bytes = [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= _ROWS or self.bytes >= _BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_PIECES = f"{_HEAD}, h long, g int, position long, copies long, piece binary"
_SOURCES = f"{_HEAD}, h long, g int, copies long, part int, position long, piece binary, output_sha256 string"
_RESULT = f"{_HEAD}, output_sha256 string, restored_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of planned rows; equal rows of a batch are cut once, the first piece tells how many they are."""
    out = _Rows(_PIECES, _TYPES)
    for batch in batches:
        found: dict[tuple, list] = {}
        for doc_id, h, g, text, *plan in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "g", "text", "n", "form", "prefix_chars", "middle_chars"))):
            found.setdefault((doc_id, h, g), [0, text, plan])[0] += 1
        for (doc_id, h, g), (copies, text, plan) in found.items():
            for at, piece in enumerate(output_pieces(text, *plan[1:])):
                yield from out.add((doc_id, *(plan if at == 0 else (None,) * 4), h, g, at, copies, piece), len(piece))
        del found
        yield from out.rest()


def pieces(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The output's pieces, dealt by document and sorted by document and position within partitions."""
    return planned(docs, seed).mapInArrow(_cut, _PIECES).repartition(*_KEY).sortWithinPartitions(*_KEY, "position")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int, bytes]]:
    """head, position, piece of sorted pieces; what equal rows repeat is given once.

    head is None but for a document's first piece: then it is its head, key and number of
    rows, of which the last may still grow until the next piece is asked for.
    """
    key, last, head = None, -1, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_NAMES, "h", "g", "position", "copies", "piece")]
        for doc_id, n, form, prefix, middle, h, g, position, copies, piece in zip(*columns):
            if (doc_id, h, g) != key:
                key, last, head = (doc_id, h, g), 0, [doc_id, n, form, prefix, middle, h, g, copies]
                yield head, 0, piece
            elif position == last:
                head[-1] += copies if position == 0 else 0
            else:
                last = position
                yield None, position, piece


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through outputs: digests them and gives the pieces of the source that they hold.

    Behind a document's pieces comes a row that closes it (part 3), with its head and digest.
    """
    out, head, part = _Rows(_SOURCES, _TYPES), None, 0

    def closing():
        doc_id, n, form, prefix, middle, h, g, copies = head
        return doc_id, n, form, prefix, middle, h, g, copies, len(MARKERS), 0, None, digest.hexdigest()

    for new, position, piece in _once(batches):
        if new is not None:
            if head is not None:
                yield from out.add(closing())
            head, digest, part = new, hashlib.sha256(), 0
        digest.update(piece)
        if head[2] != "plain" and piece[:3] in _PARTS:  # no text with a marker is transformed
            part, piece = _PARTS[piece[:3]], piece[3:]
        yield from out.add((head[0], None, None, None, None, *head[5:7], None, part, position, piece, None), len(piece))
    if head is not None:
        yield from out.add(closing())
    yield from out.rest()


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams through the pieces of the sources and digests them; one row for each row of docs."""
    out, digest = _Rows(_RESULT, _TYPES), hashlib.sha256()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_NAMES, "copies", "part", "piece", "output_sha256")]
        for *head, copies, part, piece, output in zip(*columns):
            if part < len(MARKERS):
                digest.update(piece)
                continue
            for _ in range(copies):
                yield from out.add((*head, output, digest.hexdigest()))
            digest = hashlib.sha256()
    yield from out.rest()


def digests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs.

    A null or empty text is plain and has an empty output; so are texts with a marker in
    them, whole. A null id is drawn for as an empty one. Repeated rows are cut once a
    batch, meet when sorted, and each give a row; rows that share an id only are apart.
    Very long texts are cut into as many pieces as they need. The cuts may be equal: the
    parts are empty then. Other columns are not read; an empty table gives an empty one.
    """
    sources = pieces(docs, seed).mapInArrow(_outputs, _SOURCES)
    return sources.sortWithinPartitions(*_KEY, "part", "position").mapInArrow(_restored, _RESULT)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, head, held = _Rows(f"{_HEAD}, output string", _TYPES), None, []

    def closed():
        text = b"".join(held).decode()
        for _ in range(head[-1]):
            yield from out.add((*head[:5], text), len(text))

    for new, _, piece in _once(batches):
        if new is not None:
            if head is not None:
                yield from closed()
            head, held = new, []
        held.append(piece)
    if head is not None:
        yield from closed()
    yield from out.rest()


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the texts to train on. See `digests`."""
    return pieces(docs, seed).mapInArrow(_joined, f"{_HEAD}, output string")


def original(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    marks = list(_MARKED.finditer(output))
    ends = [*(m.start() for m in marks[1:]), len(output)]
    parts = {m.group(): output[m.end() : end] for m, end in zip(marks, ends)}
    return "".join(parts[m] for m in MARKERS)


def restored(outputs: DataFrame) -> DataFrame:
    """The rows of `outputs` (form, output and any others) with the text that each output holds.

    A null output has a null text. A column named text in any case is replaced.
    """
    names = [c for c in outputs.columns if c.lower() != "text"]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in outputs.select(names).schema.fields)}, text string"

    def run(batches):
        for batch in batches:
            texts = [None if o is None else original(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return outputs.select(names).mapInArrow(run, schema)
