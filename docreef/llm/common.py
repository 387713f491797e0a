"""What the operators of this subpackage share: written tables, words, folds and Arrow passes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreef.shared import BROADCAST_ROWS, new_folder, shared_dir, sized_join, written

__all__ = ["BROADCAST_ROWS", "new_folder", "shared_dir", "sized_join", "written"]

#: A word, where a contract says so: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}

#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def folded_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8. None: no words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema for a list like ``doc_id long, tags array<string>``."""

    def kind(name: str) -> pa.DataType:
        inner = re.fullmatch(r"array<(.*)>", name)
        return pa.list_(kind(inner[1])) if inner else _ARROW[name]

    return pa.schema([pa.field(*((f := part.split())[0], kind(f[1]))) for part in ddl.split(",")])


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches without copies, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(
    df: DataFrame, columns: list[str], ddl: str, start: Callable[[], Callable[..., Iterable[tuple] | tuple | None]]
) -> DataFrame:
    """A narrow pass in Python: ``start()`` runs once a task and returns a function of the columns' values.

    The function returns a tuple for the output row. Arrow batches bound the memory; nothing is kept between rows
    except what ``start`` keeps.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in slices(batches):
            out = [row(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
            )

    return df.select(*columns).mapInArrow(run, ddl)


def row_blocks(batches: Iterable[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[list, list]]:
    """(keys, texts) of rows in two columns, as many at once as hold ``chars`` characters."""
    keys, values, held = [], [], 0
    for batch in slices(batches, 64):
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            values.append(v)
            held += len(v or "")
            if held >= chars:
                yield keys, values
                keys, values, held = [], [], 0
    if keys:
        yield keys, values


def fold_of(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo parts (null key: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fold_number(key: int | None, parts: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts
