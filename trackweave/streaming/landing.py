"""The landing sequence of each runway over a stream of arrivals, kept as state by runway."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.operators.runway import HEAVY_SPACING, NOT_SPECIFIED, SPACING

COLUMNS = ("eta", "load_seq", "track_id", "optimal_eta", "wake")


def sequence(arrivals: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The rows of ``runway.sequence`` (runway, track_id, eta, number, spacing, required, violation, overtaking, scheduled, sequence_delay),
    each once the watermark has passed its eta.

    ``arrivals`` has runway, track_id, load_seq, eta, optimal_eta, wake and event time ``ts``, that of eta.  The state of a runway is the
    last landing (its number, wake, times and schedule) and the arrivals that the watermark hasn't passed, so it doesn't grow with the
    stream; the next landing's schedule is the later of its eta and the last schedule with its spacing.  Arrivals behind the watermark are
    dropped and counted, see ``conflicts.late_rows``; those without a runway or an eta have no place and give no row.
    """
    kinds = dict(arrivals.dtypes)
    row = f"eta double, load_seq long, track_id {kinds['track_id']}, optimal_eta double, wake string"
    held = f"pending array<struct<{row}>>, number int, wake string, eta double, optimal double, scheduled double"
    schema = f"runway string, track_id {kinds['track_id']}, eta double, number int, spacing double, required int, violation boolean, overtaking boolean, scheduled double, sequence_delay double"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, number, wake, eta, optimal, scheduled = ([tuple(p) for p in state.get[0]], *state.get[1:]) if state.exists else ([], 0, None, None, None, None)
        for pdf in batches:
            pending += list(pdf[list(COLUMNS)].itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs()
        pending.sort(key=lambda p: p[:3])
        ready = [p for p in pending if p[0] * 1000 <= mark]
        pending = pending[len(ready) :]
        out = []
        for at, _, track, best, kind in ready:
            required = HEAVY_SPACING if wake == "heavy" and kind != "heavy" else SPACING
            first = not number
            scheduled = at if first else max(at, scheduled + required)
            spacing = None if first else at - eta
            out.append((key[0], track, at, number + 1, spacing, required, not first and spacing < required, not first and best < optimal and at > eta, scheduled, scheduled - at))
            number, wake, eta, optimal = number + 1, kind, at, best
        state.update((pending, number, wake, eta, optimal, scheduled))
        if pending:
            state.setTimeoutTimestamp(max(mark + 1, int(pending[0][0] * 1000)))
        if out:
            yield pd.DataFrame(out, columns=["runway", "track_id", "eta", "number", "spacing", "required", "violation", "overtaking", "scheduled", "sequence_delay"])

    own = arrivals.withWatermark("ts", late).where((F.col("runway") != NOT_SPECIFIED) & F.col("eta").isNotNull())
    own = own.select("runway", "ts", *(F.col(c).cast("double").alias(c) if c in ("eta", "optimal_eta") else F.col(c) for c in COLUMNS))
    return own.groupBy("runway").applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
