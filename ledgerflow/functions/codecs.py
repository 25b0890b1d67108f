"""Binary key-value commands and snapshots, in Arrow batches."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = {0: "get", 1: "put", 2: "del"}


def encode_command(op: str, key: str, value: str | None) -> bytes:
    """``op u8, key length u32, key, value length u32, value``, little-endian."""
    k, v = key.encode(), (value or "").encode()
    code = next(c for c, name in OPS.items() if name == op)
    return struct.pack("<BI", code, len(k)) + k + struct.pack("<I", len(v)) + v


def decode_command(b: bytes) -> tuple[str, str, str | None] | None:
    """None for bytes that are no command."""
    try:
        op, n = struct.unpack_from("<BI", b)
        key = b[5 : 5 + n].decode()
        (m,) = struct.unpack_from("<I", b, 5 + n)
        if len(b) < 9 + n + m or op not in OPS:
            return None
        return OPS[op], key, b[9 + n : 9 + n + m].decode() if op == 1 else None
    except (struct.error, UnicodeDecodeError):
        return None


def decode_commands(entries: DataFrame, column: str = "command") -> DataFrame:
    """``idx`` with ``op, k, v``; nulls where the bytes are no command."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [decode_command(c) if c is not None else None for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g and g[i] for g in got], pa.string()) for i in range(3))], names=["idx", "op", "k", "v"])

    return entries.select("idx", column).mapInArrow(run, "idx long, op string, k string, v string")


def encode_commands(commands: DataFrame) -> DataFrame:
    """The same bytes from ``idx, op, k, v`` by built-in functions alone."""
    def u32(n):
        return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))

    k, v = F.encode(F.col("k").cast("string"), "UTF-8"), F.encode(F.coalesce(F.col("v").cast("string"), F.lit("")), "UTF-8")
    op = F.when(F.col("op") == "get", F.lit("00")).when(F.col("op") == "put", "01").otherwise("02")
    return commands.select("idx", F.concat(F.unhex(op), u32(F.length(k)), k, u32(F.length(v)), v).alias("command"))


def decode_snapshots(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, k, v`` of ``count u64`` and length-prefixed pairs: a row each, in batches, whatever the size."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for sid, state in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, rows = 8, []
                for _ in range(struct.unpack_from("<Q", state)[0] if state and len(state) >= 8 else 0):
                    pair = []
                    for _ in range(2):
                        (n,) = struct.unpack_from("<I", state, at)
                        pair.append(state[at + 4 : at + 4 + n].decode())
                        at += 4 + n
                    rows.append((sid, *pair))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(("snapshot_id", "k", "v"), r)) for r in rows])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("snapshot_id", "k", "v"), r)) for r in rows])

    return snapshots.select("snapshot_id", "state").mapInArrow(run, "snapshot_id long, k string, v string")
