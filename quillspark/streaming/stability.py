"""Messages that are given out once they stay as they are: a keyed state with event-time timers.

Observations of a conversation re-arm a timer; only after a quiet time is the conversation looked at, and again after as long. A message
whose signature holds over two looks in a row, and that isn't streaming, is complete; one that changes later is looked at anew. When a
conversation goes out of sight, what isn't given out yet is given out as partial. Times are those of the observations:
arrival in any order, within the lateness of the watermark, gives the same result.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What is observed: at in milliseconds; hidden means that the conversation went out of sight, with nothing observed.
OBSERVED = "conversation string, at timestamp, ms long, sequence long, identity string, signature string, streaming boolean, hidden boolean"
GIVEN = "conversation string, identity string, signature string, status string, ms long"

_ROW = Row(*[x.split()[0] for x in GIVEN.split(", ")])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversation:
    """One conversation's state: when the timer was armed (None: it isn't), looks since then, and of each message what is seen, what
    was seen at the last look, and whether that is given out."""

    def __init__(self, armed: int | None = None, looks: int = 0):
        self.armed, self.looks = armed, looks

    def due(self, quiet: int) -> int | None:
        """When it is looked at next. A third look would find nothing that the second hasn't."""
        return None if self.armed is None or self.looks >= 2 else self.armed + quiet * (self.looks + 1)

    def fold(self, observations: Iterable[tuple], messages, quiet: int, until: int) -> Iterator[tuple]:
        """Rows of GIVEN without the conversation, for observations (ms, sequence, identity, signature, streaming, hidden) in order and
        looks up to `until`. messages is a mapping of an identity to (seen, streaming, tracked, given)."""
        for ms, _, identity, signature, streaming, hidden in observations:
            yield from self._looks(messages, quiet, ms - 1)  # an observation at the time of a look comes first
            if hidden:
                for name, (seen, flows, tracked, given) in list(messages.items()):
                    if tracked is not None and not given:
                        messages[name] = seen, flows, tracked, True
                        yield name, tracked, "partial", ms
                self.armed = None
            else:
                _, _, tracked, given = messages.get(identity) or (None, None, None, False)
                messages[identity] = signature, streaming, tracked, given
                self.armed, self.looks = ms, 0
        yield from self._looks(messages, quiet, until)

    def _looks(self, messages, quiet: int, until: int) -> Iterator[tuple]:
        while (at := self.due(quiet)) is not None and at <= until:
            self.looks += 1
            for name, (seen, flows, tracked, given) in list(messages.items()):
                if tracked != seen:
                    messages[name] = seen, flows, seen, False
                elif not given and not flows:
                    messages[name] = seen, flows, seen, True
                    yield name, seen, "complete", at


class Stability(StatefulProcessor):
    """For transformWithState by conversation, in event time. Each call to a state is a message to the executor, so a conversation's messages
    are one value, read and written once a timer: a look goes through all of them anyway. What waits for the watermark is appended."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, sequence long, identity string, signature string, streaming boolean, hidden boolean")
        self.held = handle.getValueState("held", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own = [tuple(r)[2:] for r in rows]
        self.waiting.appendList(own)
        first = min(r[0] for r in own)
        held = self._held()
        if held["timer"] is None or first + 1 < held["timer"]:
            self._arm(held, first)
            self._put(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() - 1  # what comes later may still have the watermark's millisecond
        held = self._held()
        own = sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2])
        ready, rest = [r for r in own if r[0] <= until], [r for r in own if r[0] > until]
        conversation = Conversation(held["armed"], held["looks"])
        messages = dict(held["messages"])
        out = list(conversation.fold(ready, messages, self.quiet, until))
        if own and not rest:
            self.waiting.clear()
        elif ready:
            self.waiting.put(rest)
        following = [x for x in (rest[0][0] if rest else None, conversation.due(self.quiet)) if x is not None]
        held = {"armed": conversation.armed, "looks": conversation.looks, "timer": None, "messages": list(messages.items())}
        if following:
            self._arm(held, min(following))
        self._put(held)
        return iter([_ROW(key[0], *r) for r in out])

    def _held(self) -> dict:
        found = self.held.get()
        return json.loads(found[0]) if found else {"armed": None, "looks": 0, "timer": None, "messages": []}

    def _put(self, held: dict) -> None:
        self.held.update((json.dumps(held),))

    def _arm(self, held: dict, at: int) -> None:
        if held["timer"] is not None:
            self.handle.deleteTimer(held["timer"])
        self.handle.registerTimer(at + 1)
        held["timer"] = at + 1

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stable(observations: DataFrame, quiet: int) -> DataFrame:
    """GIVEN for a stream of OBSERVED rows with a watermark on `at`: each message once it holds for a look of `quiet` milliseconds after
    another. Looks beyond the watermark aren't taken yet. Start it inside rocks()."""
    own = observations.select([x.split()[0] for x in OBSERVED.split(", ")])
    return own.groupBy("conversation").transformWithState(Stability(quiet), GIVEN, "Append", "EventTime")
