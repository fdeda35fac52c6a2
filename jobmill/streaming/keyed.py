"""Claims and cursor reservations as keyed streams: one value of state per key, a decision per request."""

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from jobmill.operators.state import CLAIM, DECISION, REQUEST, as_requests, decide, plain

#: Decisions that are passed on at once.
CHUNK = 10_000
CURSOR = "signature string, size long, next_offset long, epoch long"


def in_order(rows: Iterator[pd.DataFrame], columns: list[str], seq: str) -> Iterator[dict]:
    """Rows of one key in one micro-batch in order of seq. They are held as tuples; the source's limit on a micro-batch bounds them."""
    held = [r for f in rows for r in zip(*(f[c] for c in columns), strict=True)]
    at = columns.index(seq)
    held.sort(key=lambda r: r[at])
    for r in held:
        yield dict(zip(columns, map(plain, r), strict=True))


class _Fold(StatefulProcessor):
    """One value of state per key; ``step`` turns state and request into state and a row."""

    def __init__(self, state: str, columns: list[str], seq: str, out: StructType) -> None:
        self.state, self.columns, self.seq, self.out = state, columns, seq, out
        self.names = [c.split()[0] for c in state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.state)

    def step(self, held: dict | None, r: dict) -> tuple[dict | None, list]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.names, map(plain, self.held.get()), strict=True)) if self.held.exists() else None
        out, names = [], self.out.fieldNames()
        for r in in_order(rows, self.columns, self.seq):
            held, row = self.step(held, r)
            out.append([*key, *row])
            if len(out) == CHUNK:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held is not None:
            self.held.update(tuple(held[n] for n in self.names))
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


class _Claims(_Fold):
    def step(self, held: dict | None, r: dict) -> tuple[dict | None, list]:
        held, row = decide(held, r)
        return held, row


class _Cursors(_Fold):
    def step(self, held: dict | None, r: dict) -> tuple[dict, list]:
        same = held is not None and (held["signature"], held["size"]) == (r["signature"], r["size"])
        start, epoch = (held["next_offset"], held["epoch"]) if same else (0, (held["epoch"] if held else 0) + 1)
        step = min(r["window"], r["size"])
        held = {"signature": r["signature"], "size": r["size"], "next_offset": (start + step) % r["size"], "epoch": epoch}
        return held, [r["seq"], epoch, start, held["next_offset"], start + step >= r["size"]]


def _stream(rows: DataFrame, key: list[str], processor: _Fold) -> DataFrame:
    return rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.out, outputMode="Update", timeMode="None")


def _schema(df: DataFrame, key: list[str], rest: str) -> StructType:
    return StructType.fromDDL(", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in key), rest]))


def claim_stream(requests: DataFrame, key: list[str]) -> DataFrame:
    """``decide_claims`` over a stream of requests: a decision per request, with the claim after it.

    A micro-batch must hold a closed range of a key's seq. ``refusals`` and the
    granted rows of the result are the two outputs. Needs the RocksDB state store.
    """
    return _stream(as_requests(requests, key), key, _Claims(CLAIM, list(REQUEST), "seq", _schema(requests, key, DECISION)))


def cursor_stream(requests: DataFrame, profile: list[str], seq: str, signature: str, size: str, window: str) -> DataFrame:
    """``reserve_windows`` over a stream: profile, seq, epoch, start_offset, next_offset, wrapped per request; sizes and windows are at least 1.

    A changed signature or size begins a new epoch at 0. A micro-batch must hold a closed range of a profile's seq.
    """
    rows = requests.select(*profile, F.col(seq).cast("long").alias("seq"), F.col(signature).cast("string").alias("signature"), F.col(size).cast("long").alias("size"), F.col(window).cast("long").alias("window"))
    out = _schema(requests, profile, "seq long, epoch long, start_offset long, next_offset long, wrapped boolean")
    return _stream(rows, profile, _Cursors(CURSOR, ["seq", "signature", "size", "window"], "seq", out))

