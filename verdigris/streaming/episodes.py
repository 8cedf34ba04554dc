"""Episodes as a stateful processor: turns come in any order, in any batches, and each is answered once, in turn.

What is kept for an episode is bounded by its case and its turn limit: the keys
that it has revealed, how often each action was asked, and turns that came
before their turn.  All of it goes when the episode ends or falls idle; that it
has ended is remembered for a while, so that late turns change nothing.

Episodes are dealt by a hash into buckets, and a bucket's episodes are one group
with one value of state: a call from Spark to Python and back costs more than
the turns of an episode, and so there is one for each bucket and batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from verdigris.functions.stats import context_reserve
from verdigris.operators.episodes import parent_key

#: A turn as the processor reads it, in JSON.
TURN = ("turn", "category", "said", "shown", "room", "failed", "ends", "time")
#: What is kept of a bucket: of each episode, as JSON, its next turn, what its environment keeps, its last time, what it has revealed, asked and heard too early, or why it has ended, and when its timer is due.
STATE = "kept string"
OUT = ("turn", "shown", "fresh", "n_revealed", "n_turns", "ended")
#: Why an episode ends.
NOT_STARTED, CONTEXT, FAILED_CALL, ENVIRONMENT, ENVIRONMENT_FAILED, TURN_LIMIT, IDLE = "not_started", "context", "failed_call", "environment", "environment_failed", "turn_limit", "idle"


@dataclass(frozen=True)
class Rules:
    """What ends an episode, and how long it is remembered."""

    max_turns: int = 8
    #: Tokens of the context window (none: no limit), the reserve in it, and the least room that an answer needs.
    window: int | None = None
    fixed: int = 64
    share: float = 0.05
    least: int = 64
    #: An episode that hears nothing for so long ends, by the time of its turns.
    idle_ms: int | None = None
    #: Where turns have a time, an ended episode is remembered for so long after its last one.
    remember_ms: int = 86_400_000
    #: Requests of a category that are answered at the most.
    quotas: tuple[tuple[str, int], ...] = ()


def findings_shown(keys: Column, held: Column, limit: int = 6) -> Column:
    """What a request discloses: of the keys that the case holds, the first `limit` parents, each with its direct children."""
    parents = F.slice(F.array_distinct(F.transform(F.filter(keys, lambda k: F.array_contains(held, k)), parent_key)), 1, limit)
    # bound by a list of one, as the condition of a filter is worked out anew for each element
    return F.transform(F.array(parents), lambda p: F.array_sort(F.array_distinct(F.filter(held, lambda k: F.array_contains(p, k) | F.array_contains(p, parent_key(k))))))[0]


class EpisodeProcessor:
    """Answers each turn of an episode in order.

    `start` opens an episode: it gets the key and the first turn and returns a
    dict, which `step` gets with each turn, may change, and answers by True to
    go on or None to end.  A start that fails ends the episode before its first
    turn; a step that fails ends it there; one that sets state["failed"] says
    that the environment, not the dialogue, has failed.
    """

    def __init__(self, rules: Rules, named: Callable, timed: bool, start: Callable | None = None, step: Callable | None = None):
        self.rules, self.named, self.timed, self.start, self.step = rules, named, timed, start, step

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(json.loads(state.get[0])) if state.exists else {}
        now = state.getCurrentWatermarkMs() if self.timed else None
        heard: dict[str, list[str]] = {}
        if not state.hasTimedOut:
            for part in parts:
                for episode, turn in zip(part["__episode"], part["__turn"], strict=True):
                    heard.setdefault(episode, []).append(turn)
        out = []
        for episode, turns in heard.items():
            if episode not in known or known[episode]["ended"] is None:
                known[episode], rows = self._answered(episode, turns, known.get(episode), now)
                out.extend((episode, *r) for r in rows)
        for episode in [e for e, kept in known.items() if self.timed and kept["at"] is not None and kept["at"] <= now]:
            if known[episode]["ended"] is None:
                n, revealed = known[episode]["next"], len(known[episode]["revealed"])
                known[episode] = self._end(IDLE, known[episode]["last"], now)
                out.append((episode, n, [], 0, revealed, n, IDLE))
            else:
                del known[episode]
        due = min((kept["at"] for kept in known.values() if kept["at"] is not None), default=None)
        if known:
            state.update((json.dumps(list(known.items())),))
            if due is not None:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["__episode", *OUT])

    def _due(self, at: int | None, now: int | None) -> int | None:
        """When an episode's only timer is due: after the watermark."""
        return max(at, now + 1) if self.timed and at is not None else None

    def _end(self, reason: str, last: int, now: int | None) -> dict:
        return {"ended": reason, "at": self._due(last + self.rules.remember_ms, now)}

    def _turn(self, row: tuple, n: int, own: dict, revealed: dict, asked: dict) -> tuple[list, int, str | None]:
        """What a turn shows, how much of it is new, and why the episode ends there."""
        _, category, said, shown, room, failed, ends, _ = row
        if self.rules.window is not None and room is not None and room < self.rules.least:
            return [], 0, CONTEXT
        if failed:
            return [], 0, FAILED_CALL
        reason = ENVIRONMENT if ends else None
        if reason is None and self.step is not None:
            try:
                reason = None if self.step(own, {"turn": n, "category": category, "said": said, "shown": shown}) else ENVIRONMENT
            except Exception:  # noqa: BLE001 - one environment must not stop the stream
                reason = ENVIRONMENT
            if own.get("failed"):
                reason = ENVIRONMENT_FAILED
        if reason is not None:
            return [], 0, reason
        asked[category or ""] = asked.get(category or "", 0) + 1
        if asked[category or ""] > dict(self.rules.quotas).get(category, asked[category or ""]):
            shown = []
        fresh = {f"{category}\0{k}" for k in shown} - revealed.keys()
        revealed |= dict.fromkeys(fresh, n)
        return list(shown), len(fresh), TURN_LIMIT if n + 1 >= self.rules.max_turns else None

    def _answered(self, episode: str, turns: list[str], kept: dict | None, now: int | None) -> tuple[dict, list[tuple]]:
        """What is kept of an episode after these turns, and the rows of those that were answered."""
        kept = kept or {"next": 0, "own": {}, "last": 0, "revealed": {}, "asked": {}, "early": []}
        n, own, revealed, asked = kept["next"], kept["own"], kept["revealed"], kept["asked"]
        waiting: dict[int, tuple] = {r[0]: tuple(r) for r in kept["early"]}
        for row in map(json.loads, turns):
            turn = row.get("turn")
            if turn is not None and turn >= 0:
                waiting.setdefault(turn, (turn, *(row.get(c) for c in TURN[1:])))
        last = max([kept["last"], *(r[7] or 0 for r in waiting.values())])
        out, reason = [], None
        while n in waiting and reason is None:
            if n == 0 and self.start is not None:
                try:
                    own = self.start(self.named(episode), {"category": waiting[0][1], "said": waiting[0][2]})
                except Exception:  # noqa: BLE001 - an episode that cannot start is an error of its own
                    out.append((0, [], 0, 0, 0, NOT_STARTED))
                    reason = NOT_STARTED
                    break
            shown, fresh, reason = self._turn(waiting.pop(n), n, own, revealed, asked)
            used = n if reason == CONTEXT else n + 1
            out.append((n, shown, fresh, len(revealed), used, reason))
            n += 1
        if reason is not None:
            return self._end(reason, last, now), out
        # turns that are past, or come again, are not kept
        late = [waiting[t] for t in sorted(waiting) if n < t < self.rules.max_turns]
        at = self._due(None if self.rules.idle_ms is None else last + self.rules.idle_ms, now)
        return {"next": n, "own": own, "last": last, "revealed": revealed, "asked": asked, "early": late, "ended": None, "at": at}, out


def run_episodes(turns: DataFrame, case: DataFrame, rules: Rules = Rules(), episode: str = "episode", limit: int = 6, time: str | None = None, start: Callable | None = None, step: Callable | None = None, buckets: int = 4096) -> DataFrame:
    """episode, turn, shown, fresh, n_revealed, n_turns, ended: a row for each turn that is answered, in append mode.

    turns (a stream): episode, turn (from 0), category, keys (of the case, in
    order of the request), said, tokens (of the conversation that is sent),
    failed (the call failed), ends (the environment has nothing to add).  case
    (a table): episode, category, key.  A turn is answered when all before it
    have been; of rows with one number the first that comes counts.  `ended`
    says why the episode ends there: its context is full (that turn is not
    sent, so it is not in n_turns), its call failed, the environment ended or
    failed, the turn limit, or no turn came for rules.idle_ms.  Turns after the
    end, and rows without a turn or an episode, are passed over.  A request
    beyond its category's quota shows nothing.

    With `time`, a column of the stream that has a watermark, episodes fall
    idle and ended ones are forgotten as the watermark passes; turns older than
    the watermark come too late.  Without, no timer runs, and that an episode
    has ended is all that is kept of it.

    A batch reads and writes the buckets that it has turns for; `buckets` is
    fixed with the checkpoint.  An episode is named by a string or an integer.
    The session's RocksDB state store keeps the state outside the JVM's memory
    (see use_state_store).
    """
    if rules.idle_ms is not None and time is None:
        raise ValueError("idle episodes need the time of the turns")
    held = case.where(F.col(episode).isNotNull()).groupBy(episode, "category").agg(F.collect_set("key").alias("__held"))  # a case is bounded
    rows = turns.where(F.col(episode).isNotNull()).join(held, [episode, "category"], "left")
    none = F.array().cast("array<string>")
    room = F.lit(rules.window).cast("bigint") - F.col("tokens") - context_reserve(F.col("tokens"), rules.fixed, rules.share)
    what = {
        "turn": F.col("turn").cast("bigint"), "category": F.col("category"), "said": F.col("said"), "shown": findings_shown(F.coalesce("keys", none), F.coalesce("__held", none), limit), "room": room.cast("bigint"),
        "failed": F.coalesce("failed", F.lit(False)), "ends": F.coalesce("ends", F.lit(False)), "time": F.unix_millis(F.col(time)) if time else F.lit(None).cast("bigint"),
    }
    name = F.col(episode).cast("string")
    ready = rows.select(F.pmod(F.xxhash64(name), F.lit(buckets)).alias("__bucket"), name.alias("__episode"), F.to_json(F.struct(*[what[c].alias(c) for c in TURN])).alias("__turn"), *([F.col(time).alias("__event")] if time else []))
    kind = turns.schema[episode].dataType
    processor = EpisodeProcessor(rules, int if isinstance(kind, IntegralType) else str, time is not None, start, step)
    out = "__episode string, turn bigint, shown array<string>, fresh bigint, n_revealed bigint, n_turns bigint, ended string"
    answered = ready.groupBy("__bucket").applyInPandasWithState(processor, out, STATE, "append", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)
    return answered.select(F.col("__episode").cast(kind).alias(episode), *OUT)


def use_state_store(spark) -> None:
    """The state store for large state; a session that names a store of its own keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # what an executor's stores hold together, whatever the number of keys
    for name, value in (("boundedMemoryUsage", "true"), ("maxMemoryUsageMB", "500")):
        if spark.conf.get(f"spark.sql.streaming.stateStore.rocksdb.{name}", None) is None:
            spark.conf.set(f"spark.sql.streaming.stateStore.rocksdb.{name}", value)
