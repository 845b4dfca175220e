"""Language model providers: what a generator needs, the offline one, and the registry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

Message = dict[str, str]


@dataclass(frozen=True)
class Options:
    """Of a request; None leaves a setting to the provider."""

    model: str | None = None
    temperature: float | None = None
    max_tokens: int | None = None


class Provider(Protocol):
    def complete(self, messages: Sequence[Message], options: Options) -> str: ...

    def models(self) -> list[str]: ...


class ProviderError(RuntimeError):
    """A provider's answer that isn't one."""


class Offline:
    """Replies that follow from the last user message alone: for tests, dry runs and planning."""

    def complete(self, messages: Sequence[Message], options: Options) -> str:
        return f"reply:{_digest(messages)[:8]}"

    def models(self) -> list[str]:
        return ["offline"]


class OfflineJudge:
    """Scores 1 to 5 that follow from the message, in all the shapes that judges answer in."""

    def complete(self, messages: Sequence[Message], options: Options) -> str:
        n = int(hashlib.md5(_last(messages).encode()).hexdigest()[:8], 16)
        score, shape = 1 + n % 5, n // 5 % 4
        if shape == 0:
            return json.dumps({"score": score, "reason": "offline"})
        if shape == 1:
            return f'```json\n{{"score": "{score}"}}\n```'
        return f'{{"score": {score}.5, "reason": 1}}' if shape == 2 else f"score: {score}"

    def models(self) -> list[str]:
        return ["offline-judge"]


def _last(messages: Sequence[Message]) -> str:
    return next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")


def _digest(messages: Sequence[Message]) -> str:
    return hashlib.sha256(_last(messages).encode()).hexdigest()


REGISTRY: dict[str, Callable[..., Provider]] = {"offline": Offline, "offline-judge": OfflineJudge}
# Other names that providers go by.
ALIASES = {"azure": "azure-openai", "google": "gemini", "lm-studio": "lmstudio", "compatible": "openai-compatible"}


def register(name: str, make: Callable[..., Provider]) -> None:
    REGISTRY[name.lower()] = make


def provider(name: str, **settings) -> Provider:
    """A provider by name or alias, in any case."""
    from synthloom.providers import http

    known = {**http.PROVIDERS, **REGISTRY}
    key = ALIASES.get(name.lower(), name.lower())
    if key not in known:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(known))}")
    return known[key](**settings)
