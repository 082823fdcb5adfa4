"""Remote sources behind one interface; without a key or network they refuse, and tests use stubs."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equarry.functions.text import filled
from equarry.session import materialize
from equarry.sources.json_files import records


class NotConfigured(RuntimeError):
    """No key or client was given."""


class RateLimited(RuntimeError):
    """The service asks to wait."""


def rate_limited(status: int | None, message: str = "") -> bool:
    low = message.lower()
    return status in (429, 503, 529) or any(x in low for x in ("rate limit", "quota", "overloaded", "resource exhausted"))


def waits(base: float, most: float, tries: int) -> Iterator[float]:
    """Waiting times that double up to a limit."""
    for i in range(tries):
        yield min(base * 2**i, most)


def with_retries(call: Callable[[], object], tries: int = 5, base: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """The result of call, tried again after RateLimited."""
    last = None
    for wait in waits(base, most, tries):
        try:
            return call()
        except RateLimited as e:
            last = e
            sleep(wait)
    raise last or RateLimited("no tries")


def key_from(variable: str) -> str:
    if not (key := os.environ.get(variable, "").strip()):
        raise NotConfigured(f"set {variable}")
    return key


def extract(files: DataFrame, client: Callable[[str, bytes], str] | None, schema: str, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Records that client makes of files(path, content), and (path, error) of files that failed, for the next run.

    client returns JSON text, fenced or not, and must be picklable; it runs in the tasks. A failed file doesn't stop the others.
    """
    if client is None:
        raise NotConfigured("no client for extraction")

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, client(path, bytes(content)), None))
                except Exception as e:  # kept for the dead letters
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(out, columns=["path", "value", "error"])

    answers = files.select("path", "content").mapInPandas(run, "path string, value string, error string")
    answers = materialize(answers, "answers")  # kept, so that no file is asked for twice
    return records(answers.where("value is not null"), schema), answers.where("error is not null").select("path", "error")


def with_source(rows: DataFrame, source: str) -> DataFrame:
    """rows in which a blank source_id is the given one."""
    return rows.withColumn("source_id", F.coalesce(filled("source_id"), F.lit(source)))


def generate(spark: SparkSession, client: Callable[[str], str] | None, prompt: str, schema: str, catalog: DataFrame | None = None, most: int = 100_000, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Records that client makes of a prompt, tried again when it is rate limited. catalog, a table of at most most rows, is handed
    over as JSON lines behind the prompt, so that the generator names only what exists; a larger one is refused. Text that isn't
    JSON gives no rows."""
    if client is None:
        raise NotConfigured("no client for generation")
    if catalog is not None:
        lines = [r[0] for r in catalog.select(F.to_json(F.struct(*catalog.columns))).limit(most + 1).collect()]
        if len(lines) > most:
            raise ValueError(f"a catalog of more than {most} rows doesn't fit into a prompt")
        prompt = prompt + "\n" + "\n".join(lines)
    answer = with_retries(lambda: client(prompt), tries=tries, sleep=sleep)
    return records(spark.createDataFrame([(answer,)], "value string"), schema)


def until_ready(state: Callable[[], str], ready: str = "ACTIVE", failed: tuple[str, ...] = ("FAILED",), pause: float = 2.0, tries: int = 300, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait until an uploaded file is ready; a file that failed or stays unready is an error."""
    for _ in range(tries):
        if (now := state()) == ready:
            return
        if now in failed:
            raise RuntimeError(f"upload is {now}")
        sleep(pause)
    raise TimeoutError(f"not {ready} after {tries} looks")


class Throttle:
    """Leaves at least pause seconds between calls."""

    def __init__(self, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.pause - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def paged(fetch: Callable[[str, int, int], object], query: str, limit: int, page: int = 100, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Up to limit results of a paged service; a page may be {"data": [...]}, a bare list, or anything else for nothing. Waits
    60 s longer after each refusal, four times at most."""
    out: list[dict] = []
    while len(out) < limit:
        for attempt in range(1, 5):
            try:
                got = fetch(query, min(page, limit - len(out)), len(out))
                break
            except RateLimited:
                sleep(60 * attempt)
        else:
            break
        rows = got.get("data", []) if isinstance(got, dict) else got if isinstance(got, list) else []
        if not rows:
            break
        out += rows
    return out[:limit]


def papers_frame(spark: SparkSession, found: list[tuple[str, list[dict]]]) -> DataFrame:
    """(paper_id, query, pos, open_access) from results of several queries, ready for the papers operator."""
    rows = [(p.get("paperId"), q, i, v if isinstance(v := p.get("openAccessPdf"), str) or v is None else json.dumps(v)) for q, ps in found for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "paper_id string, query string, pos int, open_access string")
