"""Streams of changes into a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.model import UNSET
from siltstone.sources.store import Store

DONE = "_siltstone_stream"


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: Sequence[str], tag: object = UNSET, removed: str | None = None, **options: object) -> StreamingQuery:
    """Put each micro-batch in one transaction, in the given order; ``removed`` names a flag of removals.

    A batch that was committed before a restart isn't written again: its id is committed with it, under
    a tag of its own, so each batch counts once.
    """
    layout = store.layout
    if layout.values[0].dataType.typeName() not in ("string", "long", "integer", "double") or layout.keys[0].dataType.typeName() != "string" and layout.keys[0].dataType.typeName() not in ("long", "integer"):
        raise ValueError("the store's first key and value columns can't hold a batch id")
    mark = layout.key_row("last") if layout.keys[0].dataType.typeName() == "string" else layout.key_row(0)
    kind = str if layout.values[0].dataType.typeName() == "string" else float if layout.values[0].dataType.typeName() == "double" else int
    key = mark[0] if len(layout.keys) == 1 else (mark[0], *(None,) * (len(layout.keys) - 1))
    name = f"{DONE}:{checkpoint}"

    def write(batch: DataFrame, batch_id: int) -> None:
        def act(tx):
            last = tx.get(key, None, tag=name)
            last = last[0] if isinstance(last, tuple) else last
            if last is not None and int(last) >= batch_id:
                return tx.abort()
            kept = batch if removed is None else batch.where(~F.coalesce(F.col(removed), F.lit(False)))
            if removed is None:
                tx.put_multi(kept, tag, list(order))
            else:
                tx.put_changes(batch, removed, tag, list(order))
            value = kind(batch_id)
            tx.put(key, value if len(layout.values) == 1 else (value, *(None,) * (len(layout.values) - 1)), tag=name)
            return tx.commit()

        store.transaction(act)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()
