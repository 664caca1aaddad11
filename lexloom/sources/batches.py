"""Batches of a remote classification service, behind a small client interface."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import SparkSession

from .files import exists

TERMINAL = {"completed", "failed", "cancelled", "expired"}


class BatchClient(Protocol):
    def upload(self, path: str) -> str: ...
    def create(self, file_id: str, endpoint: str, window: str) -> str: ...
    def status(self, batch_id: str) -> dict: ...
    def download(self, file_id: str, path: str) -> None: ...


def enqueue(client: BatchClient, parts: list[str], endpoint: str = "/v1/chat/completions", window: str = "24h") -> list[str]:
    return [client.create(client.upload(p), endpoint, window) for p in parts]


def download_new(spark: SparkSession, client: BatchClient, batch_ids: list[str], folder: str, poll: bool = False, interval: float = 20, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Outputs and errors that are not there yet; returns the new output paths."""
    new = []
    for bid in batch_ids:
        state = client.status(bid)
        while poll and state.get("status") not in TERMINAL:
            sleep(interval)
            state = client.status(bid)
        for field, kind in (("output_file_id", "results"), ("error_file_id", "errors")):
            path = f"{folder}/{kind}/{bid}.jsonl"
            if state.get(field) and not exists(spark, path):
                client.download(state[field], path)
                if kind == "results":
                    new.append(path)
    return new
