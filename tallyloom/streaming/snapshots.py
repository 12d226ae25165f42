"""Opened and closed windows from a stream of snapshots, with the last snapshot of each host as state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROW = "ts timestamp, host string, windows array<string>"
OUT = "ts timestamp, host string, kind string, window string"
_FOUND = "at long, host string, opened array<string>, closed array<string>"
#: Stands for a null time, and comes after all times.
_NO_TIME = (1 << 63) - 1


def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What each snapshot (at, host, windows) has opened and closed against the one before; the first is only the base line. There is a
    call for each host, so it works on plain lists and makes one frame at most."""
    rows = sorted((r for b in batches for r in zip(b["at"].tolist(), b["windows"].tolist(), strict=True)), key=itemgetter(0))
    before = list(state.get[0]) if state.exists else None
    out = []
    for at, windows in rows:
        now = [] if windows is None else list(windows)
        if before is not None and now != before:
            diff = Counter(now)
            diff.subtract(before)
            out.append((at, *(sorted(w for w, n in diff.items() for _ in range(sign * n)) for sign in (1, -1))))
        before = now
    state.update((before,))
    if out:
        at, opened, closed = zip(*out, strict=True)
        yield pd.DataFrame({"at": at, "host": key[0], "opened": opened, "closed": closed})


def _until_silent(silent_ms: int):
    def gone(host: str, before: Counter, last: int) -> list[tuple]:
        """Its windows are closed at the time when nothing more was seen."""
        return [(pd.Timestamp(last + silent_ms, unit="ms"), host, "closed", w) for w in sorted(before.elements())]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, last, out = (Counter(state.get[0]), state.get[1], []) if state.exists else (None, 0, [])
        if state.hasTimedOut:
            out = gone(key[0], before, last)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ts, windows in zip(rows["ts"], rows["windows"], strict=True):
                now, at = Counter(windows), int(ts.timestamp() * 1000)
                # a host that comes back before its silence was noticed
                if before is not None and at - last > silent_ms:
                    out, before = out + gone(key[0], before, last), None
                if before is not None:
                    out += [(ts, key[0], kind, w) for kind, diff in (("opened", now - before), ("closed", before - now)) for w in sorted(diff.elements())]
                before, last = now, at
            state.update((list(before.elements()), last))
            state.setTimeoutTimestamp(max(last + silent_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ts", "host", "kind", "window"])

    return run


def window_changes(snapshots: DataFrame, silent_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """snapshots: a stream of ts, host and windows. State is one snapshot a host. silent_ms: a host of which nothing is seen for so
    long in the time of the stream has all its windows closed and is forgotten; then a snapshot is a base line again."""
    if silent_ms is None:
        # times go to Python and back as numbers: a column of times costs a conversion of time zones for each host
        numbered = snapshots.select(F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).alias("at"), "host", "windows")
        found = numbered.groupBy("host").applyInPandasWithState(changes, _FOUND, "windows array<string>", "append", GroupStateTimeout.NoTimeout)
        kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("windows")) for k in ("opened", "closed")]))
        each = found.select(F.timestamp_micros(F.nullif("at", F.lit(_NO_TIME))).alias("ts"), "host", kinds)
        return each.select("ts", "host", "kind", F.explode("windows").alias("window"))
    seen = snapshots.withWatermark("ts", late)
    return seen.groupBy("host").applyInPandasWithState(_until_silent(silent_ms), OUT, "windows array<string>, last long", "append", GroupStateTimeout.EventTimeTimeout)
