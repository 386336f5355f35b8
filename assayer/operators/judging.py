"""The seam between frames and judges: a judge is a function of a batch, its answers rows of one schema."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

ANSWERS = "frame_id {id}, judge string, judge_rev string, prompt_variant string, hands_visible int, manipulation boolean, status string, raw string"


def judge_frames(frames: DataFrame, judge: str, revision: str, variant: str, ask: Callable[[pd.Series], pd.DataFrame], payload: str, partitions: int | None = None) -> DataFrame:
    """One answer a frame. ask(payloads) gives hands_visible, manipulation and raw in the order of its batch. A batch
    that raises is asked again row by row, and the row at fault becomes an error record: no answer stops a run.
    partitions bounds how many batches are asked at once; the key restores the order."""

    def one(payloads: pd.Series) -> pd.DataFrame:
        try:
            return ask(payloads).assign(status="ok")
        except Exception as e:  # noqa: BLE001  a judge may raise anything, and its record keeps the cause
            if len(payloads) > 1:
                return pd.concat([one(payloads.iloc[i : i + 1]) for i in range(len(payloads))])
            return pd.DataFrame({"hands_visible": [None], "manipulation": [None], "raw": [f"{type(e).__name__}: {e}"[:2000]], "status": ["error"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                got = one(batch[payload])
                head = {"frame_id": batch["frame_id"].to_numpy(), "judge": judge, "judge_rev": revision, "prompt_variant": variant}
                yield pd.DataFrame(head | {"hands_visible": got["hands_visible"].astype("Int32").to_numpy(), "manipulation": got["manipulation"].to_numpy(dtype=object), "status": got["status"].to_numpy(), "raw": got["raw"].to_numpy()})

    rows = frames.select("frame_id", payload)
    rows = rows.repartition(partitions, "frame_id") if partitions else rows
    return rows.mapInPandas(run, ANSWERS.format(id=frames.schema["frame_id"].dataType.simpleString()))


class TransientError(Exception):
    """A failure that may pass: a lost connection, a time-out, a rate limit, a server error. Judges raise it, or a
    subclass, for what is worth asking again; any other exception is permanent."""


@dataclass(frozen=True)
class Retry:
    """Up to `retries` more attempts after transient failures, `base` seconds before the first, twice as long each time, `cap` at most."""

    # Long enough to outlast a server's cold start.
    retries: int = 40
    base: float = 2.0
    cap: float = 30.0

    def delay(self, attempt: int) -> float:
        return min(self.cap, self.base * 2.0 ** min(attempt, 60))


RETRIED = ANSWERS + ", attempts int, waited_s double"


def judge_with_retries(frames: DataFrame, judge: str, revision: str, variant: str, ask: Callable[[object, object], dict], payload: str, retry: Retry = Retry(), workers: int = 8, partitions: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One answer a frame, `workers` at a time in each task, in the order of the task's rows.

    ask(frame_id, payload) gives hands_visible, manipulation and raw. A TransientError is asked again after a delay; when
    the retries are used up, and at once for any other exception, the record says so: status timeout for the first,
    error for the second. attempts and the seconds waited are kept. partitions bounds how many tasks ask at once."""

    def one(item: tuple) -> dict:
        waited = 0.0
        for attempt in range(retry.retries + 1):
            try:
                return {**ask(*item), "status": "ok", "attempts": attempt + 1, "waited_s": waited}
            except TransientError as e:
                if attempt == retry.retries:
                    return {"raw": f"{type(e).__name__}: {e}"[:2000], "status": "timeout", "attempts": attempt + 1, "waited_s": waited}
                waited += retry.delay(attempt)
                sleep(retry.delay(attempt))
            except Exception as e:  # noqa: BLE001  a judge may raise anything, and its record keeps the cause
                return {"raw": f"{type(e).__name__}: {e}"[:2000], "status": "error", "attempts": attempt + 1, "waited_s": waited}
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                if len(batch):
                    got = pd.DataFrame(list(pool.map(one, zip(batch["frame_id"].tolist(), batch[payload].tolist(), strict=True))), columns=["hands_visible", "manipulation", "status", "raw", "attempts", "waited_s"])
                    head = {"frame_id": batch["frame_id"].to_numpy(), "judge": judge, "judge_rev": revision, "prompt_variant": variant}
                    yield pd.DataFrame(head | {"hands_visible": got["hands_visible"].astype("Int32").to_numpy(), "manipulation": got["manipulation"].to_numpy(dtype=object), "status": got["status"].to_numpy(), "raw": got["raw"].to_numpy(dtype=object), "attempts": got["attempts"].astype("int32").to_numpy(), "waited_s": got["waited_s"].to_numpy(float)})

    rows = frames.select("frame_id", payload)
    rows = rows.repartition(partitions, "frame_id") if partitions else rows
    return rows.mapInPandas(run, RETRIED.format(id=frames.schema["frame_id"].dataType.simpleString()))
