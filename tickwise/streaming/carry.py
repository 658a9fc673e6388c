"""W3 on a stream – provider carried forward per session with keyed state.

``applyInPandasWithState`` keeps one row per session: the last provider by
event time, with that time. A micro-batch's rows of a session join the stored
row, are put in event order and filled forward at once, so a late row with an
older provider does not displace a newer one. Only a session's rows *of the
current micro-batch* are held together; the micro-batch is bounded by the
source's trigger options. A late row whose own time lies before the stored one
and that has no provider in its batch gets none: older providers are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def stream_carry_provider(calls: DataFrame, key: str, order: list[str], provider: str = "provider",
                          out: str = "current_provider") -> DataFrame:
    fields = list(calls.schema.fields)
    cols = [f.name for f in fields]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + f", {out} string"
    kept = [*order, provider]

    def fold(_key, chunks, state):
        import pandas as pd
        batch = pd.concat(list(chunks), ignore_index=True)
        types = dict(batch.dtypes)
        batch["_new"] = True
        if state.exists:
            before = pd.DataFrame([dict(zip(kept, state.get))]).astype({c: batch[c].dtype for c in order})
            batch = pd.concat([before.assign(_new=False), batch], ignore_index=True)
        batch = batch.sort_values(order, kind="stable")
        batch[out] = batch[provider].ffill()
        known = batch[batch[provider].notna()]
        if len(known):
            last = known.iloc[-1]
            state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else getattr(x, "item", lambda x=x: x)()
                               for x in (last[c] for c in kept)))
        res = batch[batch["_new"]][[*cols, out]]
        yield res.astype({c: t for c, t in types.items() if res[c].notna().all()})

    state_schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
    return calls.groupBy(key).applyInPandasWithState(fold, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
