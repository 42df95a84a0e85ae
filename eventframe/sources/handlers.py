"""User code over events in the order of a key: state carried along a key, hooks around a task, single events as objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Event(Mapping):
    """One event: fields as attributes and items, ``get``, ``keys``, ``values``, ``items``, ``in``, ``len``; iterates (name, value)."""

    __slots__ = ("_fields",)

    def __init__(self, fields: dict[str, Any]):
        self._fields = fields

    def __getattr__(self, name: str) -> Any:
        try:
            return self._fields[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Any:
        return self._fields[name]

    def __contains__(self, name: object) -> bool:
        return name in self._fields

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self._fields.items())

    def __len__(self) -> int:
        return len(self._fields)

    def keys(self) -> list[str]:
        return list(self._fields)

    def values(self) -> list[Any]:
        return list(self._fields.values())

    def items(self) -> list[tuple[str, Any]]:
        return list(self._fields.items())

    def to_dict(self) -> dict[str, Any]:
        return dict(self._fields)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Event) and self._fields == other._fields

    def __hash__(self) -> int:
        return hash(tuple((k, str(v)) for k, v in self._fields.items()))

    def __repr__(self) -> str:
        return f"Event({', '.join(f'{k}={v!r}' for k, v in self._fields.items())})"


class Handler:
    """What ``run_in_order`` calls; override what is needed. One object serves one task.

    ``init`` and ``exit`` surround a task; ``exit`` is not called when the task fails. ``start`` gives the state of a key at its first
    event, ``rows`` takes consecutive events of one key, in order, and returns output rows or None; it changes the state in place. ``end``
    comes behind a key's last event. A task may run again after a failure, so effects outside the output must bear repetition.
    """

    def init(self) -> None: ...

    def exit(self) -> None: ...

    def start(self, key: tuple) -> Any:
        return {}

    def rows(self, key: tuple, state: Any, events: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def end(self, key: tuple, state: Any) -> pd.DataFrame | None:
        return None


class EventHandler(Handler):
    """A handler of single events: ``names[event](state, Event)`` or else ``default`` returns an output row as a dict, or None."""

    def __init__(self, names: Mapping[str, Callable], default: Callable | None = None, name: str = "event"):
        self.names, self.default, self.name = dict(names), default, name

    def rows(self, key: tuple, state: Any, events: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for fields in events.to_dict("records"):
            call = self.names.get(fields[self.name], self.default)
            row = call(state, Event(fields)) if call else None
            if row is not None:
                out.append(row)
        return pd.DataFrame(out) if out else None


def _pieces(batch: pd.DataFrame, key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The stretches of equal key of a batch that is ordered by key, nulls equal to each other."""
    keys = batch[key]
    same = (keys.eq(keys.shift()) | (keys.isna() & keys.shift().isna())).all(axis=1).to_numpy()
    edges = [0, *(i for i in range(1, len(batch)) if not same[i]), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        piece = batch.iloc[a:b].reset_index(drop=True)
        yield tuple(None if pd.isna(v) else v for v in piece[key].iloc[0]), piece


def run_in_order(df: DataFrame, handler: Handler, key: Sequence[str], schema: str | T.StructType,
                 order: Sequence[str] = ("_time", "seq")) -> DataFrame:
    """Rows that ``handler`` returns for the events of each key, in ``order``.

    Events are dealt by key and sorted inside tasks; a task hands its sorted rows on in Arrow batches, and a key's state goes
    from batch to batch. So a key's events are never in memory together, however many they are; as they come one
    after the other, the largest key bounds the time of a task. Null keys are one key. An empty table calls nothing but ``init`` and ``exit``.
    """
    key = list(key)
    names = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        handler.init()
        now, state = None, None
        for batch in batches:
            for k, piece in _pieces(batch, key):
                if k != now:
                    if now is not None:
                        yield from _shaped(handler.end(now, state), names)
                    now, state = k, handler.start(k)
                yield from _shaped(handler.rows(k, state, piece), names)
        if now is not None:
            yield from _shaped(handler.end(now, state), names)
        handler.exit()

    dealt = df.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, *order)
    return dealt.mapInPandas(run, schema)


def _shaped(out: pd.DataFrame | None, names: list[str]) -> Iterator[pd.DataFrame]:
    if out is not None and len(out):
        yield out[names]
