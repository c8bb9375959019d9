"""The TTL registry as keyed streaming state: events in any order, answers revised when an earlier event comes late."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events of a key are kept in the state by days of this length, so that a batch reads and writes the days it touches.
DAY = 86_400
#: A key with no more events than this has them in its index: one value is read and written instead of one a day.
SMALL = 256


def outcome(second: int, event: int, held: list | None, gone: dict[str, list], ttl: int, grace: int) -> str:
    """A request against the latest registration before it: [second, event, name], which its name may have been evicted by."""
    if held is None or any([held[0], held[1]] < x < [second, event] for x in gone.get(held[2], ())):
        return "miss"
    return "hit" if second < held[0] + ttl - grace else "expired"


class Registry(StatefulProcessor):
    """State of a key: its events, by day once they are more than SMALL, the last registration of each day, and evictions by name.

    A new event is put into its day. A request is answered there; a registration or an eviction answers again what comes
    after it, up to the next registration. Answers that change are given again, so the newest one of a request counts
    and the end state does not depend on the order of arrival. With a watermark, days before it are folded into their
    last registration, by the timer of the day or the next event.
    """

    def __init__(self, ttl: int, grace: int, bounded: bool):
        self.ttl, self.grace, self.bounded = ttl, grace, bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "events string")
        self.index = handle.getValueState("index", "found string")

    def _found(self) -> dict:
        """small: the events of a key that has few, null once they are kept by day."""
        held = self.index.get()
        return {"small": None} | json.loads(held[0]) if held else {"base": None, "last": [], "gone": {}, "small": []}

    def _events(self, day: int) -> list[list]:
        return json.loads(self.days.getValue((day,))[0]) if self.days.containsKey((day,)) else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, fresh, turns = self._found(), defaultdict(list), set()
        last, gone = {d: x for d, x in found["last"]}, found["gone"]
        by_day, changed = defaultdict(list), {}
        for e in found["small"] or ():
            by_day[e[0] // DAY].append(e)
        for frame in rows:
            for event, kind, second, name in zip(frame["event_id"], frame["kind"], frame["second"], frame["name"]):
                event, second, name = int(event), int(second), name if isinstance(name, str) else ""
                if kind == "evict":
                    if [second, event] not in gone.setdefault(name, []):
                        gone[name].append([second, event])
                else:
                    fresh[second // DAY].append([second, event, kind, name, None])
                if kind != "request":
                    turns.add(second // DAY)
                    fresh[second // DAY] += []
        answers, passed_on, before = [], False, found["base"]
        for day in sorted({*last, *fresh}):
            if day in fresh or passed_on:
                there = by_day[day] if found["small"] is not None else self._events(day) if day in last else []  # a day that is not in the index has no events
                events = {e[1]: e for e in fresh[day]} | {e[1]: e for e in there}
                ordered, held, inside = sorted(events.values(), key=lambda e: e[:2]), before, None
                for e in ordered:
                    if e[2] == "register":
                        held = inside = [e[0], e[1], e[3]]
                    else:
                        now = outcome(e[0], e[1], held, gone, self.ttl, self.grace)
                        if now != e[4]:
                            e[4] = now
                            answers.append((e[1], now))
                if ordered:
                    changed[day] = ordered
                if self.bounded and day not in last:
                    self.handle.registerTimer((day + 1) * DAY * 1000)
                last[day] = inside
                passed_on = day in turns or (passed_on and inside is None)
            before = last[day] or before
        small = None
        if found["small"] is not None:
            changed = by_day | changed
            if sum(map(len, changed.values())) <= SMALL:
                small, changed = [e for events in changed.values() for e in events], {}
        for day, events in changed.items():
            if events:
                self.days.updateValue((day,), (json.dumps(events),))
        self._keep({"base": found["base"], "last": sorted(last.items()), "gone": gone, "small": small}, timerValues)
        yield self._frame(key, answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.index.exists():
            self._keep(self._found(), timerValues)
        yield self._frame(key, [])

    def _keep(self, found: dict, timers) -> None:
        """Writes the index; with a watermark, days that end before it go."""
        if self.bounded:
            line = timers.getCurrentWatermarkInMs() // 1000
            for day, inside in [x for x in found["last"] if (x[0] + 1) * DAY <= line]:
                found["base"] = inside or found["base"]
                if found["small"] is None and self.days.containsKey((day,)):
                    self.days.removeKey((day,))
            if found["small"] is not None:
                found["small"] = [e for e in found["small"] if (e[0] // DAY + 1) * DAY > line]
            found["last"] = [x for x in found["last"] if (x[0] + 1) * DAY > line]
            names = {found["base"][2]} if found["base"] else set()
            found["gone"] = {n: x for n, x in found["gone"].items() if n in names or any(at[0] >= line for at in x)}
        self.index.update((json.dumps(found),))

    def _frame(self, key, answers: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pd.Series([e for e, _ in answers], dtype="int64"), "cache_key": [key[0]] * len(answers), "outcome": pd.Series([o for _, o in answers], dtype="object")})

    def close(self) -> None:
        pass


class Names(StatefulProcessor):
    """State of a name: the keys registered under it and its evictions. Each pair of the two is given once, whichever comes first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "found string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, evictions = json.loads(self.held.get()[0]) if self.held.exists() else ([], [])
        done = {(k, *e) for k in keys for e in evictions}
        for frame in rows:
            for event, kind, second, k in zip(frame["event_id"], frame["kind"], frame["second"], frame["key_text"]):
                if kind == "register" and k not in keys:
                    keys.append(k)
                if kind == "evict" and [int(second), int(event)] not in evictions:
                    evictions.append([int(second), int(event)])
        self.held.update((json.dumps([keys, evictions]),))
        made = [(e, k, s) for k in keys for s, e in evictions if (k, s, e) not in done]
        yield pd.DataFrame({"event_id": pd.Series([m[0] for m in made], dtype="int64"), "key_text": pd.Series([m[1] for m in made], dtype="object"), "second": pd.Series([m[2] for m in made], dtype="int64"), "name": pd.Series([key[0]] * len(made), dtype="object")})

    def close(self) -> None:
        pass
