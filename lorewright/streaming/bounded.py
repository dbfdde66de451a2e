"""Messages that come again, told by a set of the last ids that has a bound."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

BOUND = 2000


class LastIds(StatefulProcessor):
    """Keeps, for each channel, the ids that came last; the oldest goes when there are too many."""

    def __init__(self, bound: int):
        self.bound = bound

    def init(self, handle) -> None:
        self.ids = handle.getMapState("ids", "message_id string", "came long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        held = dict(sorted(((k[0], v[0]) for k, v in self.ids.iterator()), key=lambda x: x[1]))
        before, n = set(held), self.count.get()[0] if self.count.exists() else 0
        new = []
        for place, message in enumerate(batch["message_id"].tolist()):
            if message not in held:
                new.append(place)
                held[message], n = n, n + 1
                if len(held) > self.bound:
                    del held[next(iter(held))]
        for message in before - set(held):
            self.ids.removeKey((message,))
        for message, came in held.items():
            self.ids.updateValue((message,), (came,))
        self.count.update((n,))
        yield batch.iloc[new]

    def close(self) -> None:
        pass


def first_of_ids(events: DataFrame, bound: int = BOUND) -> DataFrame:
    """Of a stream with ``channel``, ``seq`` and ``message_id``, the rows whose id is none of the channel's last ``bound``.

    Ids count from when they first came; one that comes again after it went is
    new.  All columns are kept.  State has ``bound`` ids a channel at most, and a
    batch's rows of one channel are put in order in one task.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return events.groupBy("channel").transformWithStateInPandas(LastIds(bound), events.schema, "Append", "None")
