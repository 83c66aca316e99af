"""Series that go on as a stateful stream: the state of each series lies in Spark's state store.

Series share a call and a row of the store by buckets of their names, as a call a series costs far more than its rows do. A micro-batch
touches the states of the buckets that it has rows of; nothing of the others is read or written. The rows of one bucket in one batch
meet in one task, in pieces; how large a batch is, the source's options say (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series string, seq long, time double, value double, step double, flag int, n long, s double, ss double, mn double, mx double"
#: Of each series of a bucket: its last time and its reference step (NaN: none yet), and the running statistics of its values.
STATE = "series array<string>, last_time array<double>, ref_step array<double>, n array<long>, s array<double>, ss array<double>, mn array<double>, mx array<double>"
#: Buckets of series. A stream that goes on keeps the number that it began with.
BUCKETS = 1024
_NONE = float("nan")
_NEW = (_NONE, _NONE, 0, 0.0, 0.0, _NONE, _NONE)


def continued(stream: DataFrame, slack: float = 1.25) -> DataFrame:
    """``stream`` (series, seq, time, value) with ``step`` to the series' record before, ``flag`` (1 negative, 4 identical, 2 a step beyond ``slack``
    times the series' first), and the statistics of the series up to each record: n, s, ss, mn, mx.

    Records of a series lie by ``seq`` in a batch, and batches follow each other, so the result is the same wherever the stream is cut
    between records of rising ``seq``. Null and NaN values are in no statistic; a null time has no step and no flag, and the one before stays the last.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {series: of for series, *of in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = []
        for series, seq, time, value in zip(*[rows[c].tolist() for c in ("series", "seq", "time", "value")], strict=True):
            last, ref, n, s, ss, mn, mx = known.get(series, _NEW)
            step = time - last
            if time == time:
                ref = step if ref != ref and step == step else ref
                last = time
            flag = 1 if step < 0 else 4 if step == 0 else 2 if step > slack * ref else 0
            if value == value and value is not None:
                n, s, ss = n + 1, s + value, ss + value * value
                mn, mx = (value, value) if n == 1 else (min(mn, value), max(mx, value))
            known[series] = (last, ref, n, s, ss, mn, mx)
            out.append((series, seq, time, value, None if step != step else step, flag, n, s, ss, None if n == 0 else mn, None if n == 0 else mx))
        state.update(tuple(map(list, zip(*((series, *of) for series, of in known.items()), strict=True))))
        yield pd.DataFrame(out, columns=["series", "seq", "time", "value", "step", "flag", "n", "s", "ss", "mn", "mx"])

    rows = stream.select(F.pmod(F.xxhash64("series"), F.lit(BUCKETS)).alias("bucket"), "series", "seq", "time", "value")
    return rows.groupBy("bucket").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def continue_into(stream: DataFrame, path: str, checkpoint: str, slack: float = 1.25) -> None:
    """Append what a ``stream`` has now to the table under ``path``; called again it goes on from its checkpoint."""
    continued(stream, slack).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
