"""Transports to a language model: chat messages in, text out."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass


class TemporaryFailure(Exception):
    """A failure that may pass: a timeout, a limit of requests, a server that is busy."""


@dataclass(frozen=True)
class HttpTransport:
    """Asks a chat-completion service of the usual form over HTTP; ``key_variable`` names the environment variable of the key."""

    url: str
    model: str
    temperature: float = 0.75
    max_tokens: int = 64
    timeout: float = 60.0
    key_variable: str = "CHAT_API_KEY"

    def __call__(self, messages: list[dict]) -> str:
        import os

        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            if error.code == 408 or error.code == 429 or error.code >= 500:
                raise TemporaryFailure(str(error)) from error
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            raise TemporaryFailure(str(error)) from error


@dataclass(frozen=True)
class Retrying:
    """Asks again after temporary failures, each time after twice the wait, ``tries`` times at most; then the failure is raised."""

    transport: Callable[[list[dict]], str]
    tries: int = 3
    wait: float = 1.0

    def __call__(self, messages: list[dict]) -> str:
        for n in range(self.tries):
            try:
                return self.transport(messages)
            except TemporaryFailure:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**n)
        raise ValueError("at least one try is needed")
