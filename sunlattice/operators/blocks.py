"""Blocks of pixels with a halo, for operators that look at a neighbourhood.

Pixels are shuffled once, a row each, to their own block, which packs them: one row of compressed Arrow bytes for itself, and one for each block
whose halo reaches into it, with the part that is reached only. What is shuffled a second time are those rows: about ((side + 2 halo) / side)^2
values a pixel, whatever is computed from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that goes back to the JVM.
BATCH = 65_536


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def with_halo(pixels: DataFrame, side: int, halo: int, around: tuple[str, ...] = (), only: str | None = None) -> DataFrame:
    """(br, bc, own, data): the packed pixels (row, col, ...) of each block, all columns, and of the halo pixels around it, the columns `around`.
    only: a boolean column that says which pixels matter to other blocks."""
    schema = "br long, bc long, own boolean, data binary"
    keyed = pixels.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}).withColumns({"_br": F.floor(F.col("row") / side), "_bc": F.floor(F.col("col") / side)})
    reach = -(-halo // side)

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        br, bc = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches)).drop_columns(["_br", "_bc"])
        t = t.set_column(t.column_names.index("row"), "row", pc.cast(pc.subtract(t["row"], br * side), pa.int32())).set_column(t.column_names.index("col"), "col", pc.cast(pc.subtract(t["col"], bc * side), pa.int32()))
        t = t.sort_by([("row", "ascending"), ("col", "ascending")])
        out = [(br, bc, True, _packed(t))]
        seen = t.filter(t[only]) if only else t
        seen = seen.select(["row", "col", *around])
        r, c = seen["row"].to_numpy(), seen["col"].to_numpy()
        for dr in range(-reach, reach + 1):
            for dc in range(-reach, reach + 1):
                if dr or dc:
                    # in the other block's own coordinates it must be within its halo
                    near = (r >= dr * side - halo) & (r < (dr + 1) * side + halo) & (c >= dc * side - halo) & (c < (dc + 1) * side + halo)
                    if near.any():
                        part = seen.filter(pa.array(near))
                        part = part.set_column(0, "row", pc.subtract(part["row"], pa.scalar(dr * side, pa.int32()))).set_column(1, "col", pc.subtract(part["col"], pa.scalar(dc * side, pa.int32())))
                        out.append((br + dr, bc + dc, False, _packed(part)))
        for one in out:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in one], names=["br", "bc", "own", "data"])

    return keyed.groupBy("_br", "_bc").applyInArrow(pack, schema)


def apply(packed: DataFrame, kernel: Callable[..., Iterator[pa.Table]], schema: str, keys: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """kernel(top, left, own, pieces, *keys, *extra) of each block: own is the table of its pixels and pieces those of its halo, addresses counted from the block's first pixel.
    keys: further grouping columns; extra: columns that are the same in all rows of a group. Blocks without pixels of their own give nothing."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        br, bc, *more = (k.as_py() for k in key)
        own, pieces, given = [], [], None
        for b in batches:
            for is_own, data in zip(b.column(b.schema.names.index("own")).to_pylist(), b.column(b.schema.names.index("data")).to_pylist(), strict=True):
                (own if is_own else pieces).append(data)
            if b.num_rows and given is None:
                given = [b.column(b.schema.names.index(c))[0].as_py() for c in extra]
        if own:
            for t in kernel(br, bc, _unpacked(own[0]), map(_unpacked, pieces), *more, *(given or [])):
                yield from t.select(names).combine_chunks().to_batches(max_chunksize=BATCH)

    return packed.groupBy("br", "bc", *keys).applyInArrow(run, schema)


def field(own: pa.Table, pieces: Iterator[pa.Table], side: int, halo: int, value: str, dtype=np.float32, empty=np.nan) -> np.ndarray:
    """The block with its halo as an array of one column."""
    out = np.full((side + 2 * halo,) * 2, empty, dtype)
    for t in (own, *pieces):
        out[t["row"].to_numpy() + halo, t["col"].to_numpy() + halo] = t[value].to_numpy()
    return out
