"""Pluggable chat models, called in batches on the executors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class ChatClient(Protocol):
    """What a connector offers; it is built once for each task by a picklable factory."""

    def chat(self, prompt: str) -> str: ...


class EchoClient:
    """A deterministic stand-in: an empty payload for the event that the prompt names, signed with the prompt's hash."""

    def chat(self, prompt: str) -> str:
        event = prompt.split("EVENT:", 1)[1].split("\n", 1)[0].strip() if "EVENT:" in prompt else ""
        return json.dumps({"event_id": event, "tuples": [], "signature": hashlib.sha1(prompt.encode()).hexdigest()[:8]})


def ask(df: DataFrame, prompt: str, factory: Callable[[], ChatClient] = EchoClient, retry_prompt: str | None = None, retry_if: Callable[[str], bool] = lambda answer: "{" not in answer, attempts: int = 2) -> DataFrame:
    """df with `answer`, `attempts` and `error`; a bad answer is asked again with the retry prompt. Never raises."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            answers, tries, errors = [], [], []
            for row in pdf.to_dict("records"):
                text, error, n = None, None, 0
                for n in range(1, attempts + 1):
                    try:
                        text, error = client.chat(row[retry_prompt] if n > 1 and retry_prompt else row[prompt]), None
                        if not retry_if(text):
                            break
                    except Exception as e:  # noqa: BLE001 - a connector may raise anything; the row reports it
                        error = f"{type(e).__name__}: {e}"
                answers.append(text)
                tries.append(n)
                errors.append(error)
            yield pdf.assign(answer=answers, attempts=tries, error=errors)

    return df.mapInPandas(run, f"{fields}, answer string, attempts int, error string")
