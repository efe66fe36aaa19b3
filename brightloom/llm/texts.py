"""Running a function over whole texts, batch by batch, and turning texts into letter codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship

#: Characters of a text that are turned into codes at once, which bounds memory for very long texts.
AT_ONCE = 1 << 20


def each_text(docs: DataFrame, id_col: str, text_col: str, fields: str, f: Callable[[str], tuple], carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fields): f of every text, null as empty. `f` is called in Python workers, on one text at a time."""
    ship(docs.sparkSession)
    kept = (id_col, *carry)
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), *new])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f(t.as_py() or "") for t in b.column(len(kept))]
            cols = [b.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            cols += [pa.array([r[i] for r in rows], arrow.field(len(kept) + i).type) for i in range(len(new))]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return docs.select(*(F.col(c) for c in kept), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for anything but letters."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(text: str) -> Iterator[str]:
    """The text in blocks of bounded size, cut at a space where there is one."""
    at = 0
    while at < len(text):
        end = at + AT_ONCE
        if end < len(text):
            end = (text.rfind(" ", at, end) + 1) or end
        yield text[at:end]
        at = end


def letter_stream(text: str) -> np.ndarray:
    """Codes of the text's letters, lower-cased; each run of other characters is one 0, and so are start and end."""
    a = letters()[code_points(text)]
    keep = a != 0
    keep[1:] |= a[:-1] != 0
    return np.concatenate([[0], a[keep], [0]]).astype(np.uint64)


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of all letter n-grams of one to three characters, repeats included, block by block. A code holds its characters in 21 bits each; 0 is a word's edge."""
    for block in blocks(text):
        a = letter_stream(block)
        pair = (a[:-1] << np.uint64(21)) | a[1:]
        yield np.concatenate([a[a != 0], pair[pair != 0], ((a[:-2] << np.uint64(42)) | pair[1:])[a[1:-1] != 0]])


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their summed counts."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def gram_counts(docs: DataFrame, key_col: str, text_col: str, codes_of: Callable[[str], Iterator[np.ndarray]]) -> DataFrame:
    """(key, gram, n): how often each code occurs in all texts of a key; `codes_of` gives a text's codes block by block.

    Counts are merged in each task before they are shuffled. A task holds a bounded number of codes, whatever the length of a text.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str | None, list[np.ndarray]] = {}
        waiting: dict[str | None, int] = {}

        def merge(key: str | None) -> None:
            new = [np.unique(np.concatenate(held.pop(key)), return_counts=True)]
            waiting.pop(key)
            kept[key] = counted([kept[key], *new]) if key in kept else new[0]

        def out() -> Iterator[pa.RecordBatch]:
            for key in list(held):
                merge(key)
            for key, (codes, n) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)
            kept.clear()

        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                k = key.as_py()
                for codes in codes_of(text.as_py() or ""):
                    held.setdefault(k, []).append(codes)
                    waiting[k] = waiting.get(k, 0) + codes.size
                    if waiting[k] > 1 << 20:
                        merge(k)
                        if sum(c.size for c, _ in kept.values()) > 4 << 20:
                            yield from out()
            if sum(c.size for c, _ in kept.values()) + sum(waiting.values()) > 8 << 20:  # many keys: memory stays bounded
                yield from out()
        yield from out()

    rows = docs.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
    return rows.groupBy("key", "gram").agg(F.sum("n").alias("n"))
