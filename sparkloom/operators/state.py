"""Ordered folds with a state for each key: spaced repetition, levels.

Rows are dealt by key, sorted, and streamed; a key's state is all that is held,
so a key with a third of all rows costs no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], start: Callable[[], tuple], step: Callable[..., tuple], result: str) -> DataFrame:
    """(key, state) after the last row of each key; state has the columns of `result`, SQL types.

    step(state, *values) gives the next state.  Keys come in order in a partition.
    """
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in result.split(", ")]
    dealt = df.select(key, *[c for c in order if c not in values], *values).repartition(key).sortWithinPartitions(key, *order)
    skip = 1 + len([c for c in order if c not in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done, kind = None, None, [], None

        def made():
            rows = [(k, *s) for k, s in done]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *(pa.array([r[i + 1] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields))], [key, *(n for n, _ in fields)])

        for b in batches:
            kind = b.schema.field(0).type
            columns = [b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in range(skip, b.num_columns))]
            for k, *v in zip(*columns, strict=True):
                if state is None or k != last:
                    if state is not None:
                        done.append((last, state))
                    last, state = k, start()
                state = step(state, *v)
            if len(done) >= 1000:
                yield made()
                done = []
        if state is not None:
            done.append((last, state))
            yield made()

    return dealt.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {result}")


def _whole(x: float) -> float:
    """Halves up; numbers beyond 2**53 are whole already, infinity included."""
    return float(math.floor(x + 0.5)) if x < 2**53 else x


def sm2(state: tuple, right: bool) -> tuple:
    """(ease, interval in days, repetitions) after an answer graded 4 or 1: intervals of 1 and 6 days, then by the ease,
    which a right answer leaves as it is; a wrong one takes 0.54 of it, down to 1.3, and starts anew."""
    ease, interval, reps = state
    if not right:
        return max(1.3, ease - 0.54), 1.0, 0
    return ease, 1.0 if reps == 0 else 6.0 if reps == 1 else _whole(interval * ease), reps + 1


#: Minutes until a word is due again, by step.
LADDER = (8, 1440, 3 * 1440, 8 * 1440, 21 * 1440)


def ladder(state: tuple, right: bool, spread: float = 1.0) -> tuple:
    """(step, minutes, misses, ease, held): up a step or down to the first; held after the last.

    Minutes are the step's by the ease, which is 0.55 to 1.6: a step up adds 0.04, a miss takes 0.2, or 0.1 on the
    first step after an earlier miss.  `spread` is the caller's jitter.  A miss of a word that is held begins a new ladder.
    """
    step, _, misses, ease, held = state
    if held:
        return state if right else (0, float(LADDER[0]), misses + 1, 1.0, False)
    if not right:
        ease = max(0.55, ease - (0.2 if step else 0.1)) if step or misses else ease
        return 0, float(LADDER[0]), misses + 1, ease, False
    step += 1
    if step >= len(LADDER):
        return step, 0.0, misses, ease, True
    ease = min(1.6, ease + 0.04)
    return step, LADDER[step] * ease * spread, misses, ease, False


#: The lowest level; from where an easier text is a jump, and to where; how much harder than at first it gets.
FLOOR, HIGH, JUMP, HARDER = 26, 70, 62, 8


def level(state: tuple, score: float | None, n: int) -> tuple:
    """(level, first level, scores as text) after a text of n counted words: of fewer than three nothing is learnt.

    With four scores or more, the mean of the last five decides: from 0.85 on two down (above 70 to 62) if the level
    is above 26, below 0.5 two up if that is less than 8 above the first; a change forgets the scores, of which eight are kept.
    """
    now, first, text = state
    if score is None or n < 3:
        return state
    scores = [*(float(x) for x in text.split(",") if x), score][-8:]
    mean = sum(scores[-5:]) / len(scores[-5:])
    if len(scores) >= 4 and mean >= 0.85 and now > FLOOR:
        return JUMP if now > HIGH else now - 2, first, ""
    if len(scores) >= 4 and mean < 0.5 and now < first + HARDER:
        return now + 2, first, ""
    return now, first, ",".join(map(repr, scores))
