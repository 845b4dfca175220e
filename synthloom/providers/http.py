"""Providers over HTTP: what each service is sent, and where its answer lies."""

from __future__ import annotations

import email.utils
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from synthloom.providers.base import Message, Options, ProviderError

# Answers that are worth another try.
RETRIED = (408, 429, 500, 502, 503, 504)


def error_text(body: str) -> str:
    """The first line of what a service says went wrong."""
    try:
        found = json.loads(body)
    except ValueError:
        found = None
    text = ""
    if isinstance(found, dict):
        error = found.get("error")
        said = (error.get("message") if isinstance(error, dict) else error, found.get("message"))
        text = next((x for x in said if isinstance(x, str) and x), "")
    text = text if isinstance(text, str) and text else body[:200]
    return text.strip().splitlines()[0] if text.strip() else ""


# What services say of a model that they don't have.
NO_MODEL = ("model_not_found", "does not exist", "invalid_model", "model not found")


def model_not_found(status: int, body: str | None) -> bool:
    """Whether an answer says that there is no such model."""
    return status in (400, 404) and any(x in (body or "").lower() for x in NO_MODEL)


def delay(header: str | None, attempt: int, base: float) -> float:
    """Seconds to wait: what the service asks for, as seconds or a date, else doubling from base."""
    if header:
        try:
            return max(0.0, float(header))
        except ValueError:
            pass
        try:
            return max(0.0, (email.utils.parsedate_to_datetime(header) - datetime.now(UTC)).total_seconds())
        except (TypeError, ValueError):
            pass
    return base * 2**attempt


def send(url: str, headers: Mapping[str, str], body: dict | None, retries: int = 3, wait: float = 1.0, timeout: float = 120.0) -> dict:
    """POST body, or GET, as JSON; responses in RETRIED are tried again, failures to connect are not."""
    data = None if body is None else json.dumps(body).encode()
    for attempt in range(retries + 1):
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            if model_not_found(e.code, said):
                raise ProviderError(f"HTTP {e.code}: no such model: {error_text(said)}") from e
            if e.code not in RETRIED or attempt == retries:
                raise ProviderError(f"HTTP {e.code}: {error_text(said)}") from e
            time.sleep(delay(e.headers.get("Retry-After"), attempt, wait))
    raise AssertionError


def _at(answer: object, *path: str | int) -> str:
    try:
        for step in path:
            answer = answer[step]  # type: ignore[index]
    except (KeyError, IndexError, TypeError):
        answer = None
    if not isinstance(answer, str):
        raise ProviderError("the answer holds no text")
    return answer


def _settings(options: Options, **names: str) -> dict:
    values = {"model": options.model, "temperature": options.temperature, "max_tokens": options.max_tokens}
    return {names.get(k, k): v for k, v in values.items() if v is not None and names.get(k, k)}


def _chat(messages: Sequence[Message], options: Options) -> dict:
    return {"messages": list(messages), **_settings(options)}


def _deployed(messages: Sequence[Message], options: Options) -> dict:
    return {"messages": list(messages), **_settings(options, model="")}


def _claude(messages: Sequence[Message], options: Options) -> dict:
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    rest = [m for m in messages if m["role"] != "system"]
    return {"messages": rest, "max_tokens": 4096, **({"system": system} if system else {}), **_settings(options)}


def _parts(messages: Sequence[Message], options: Options) -> dict:
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    turns = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in messages if m["role"] != "system"]
    body: dict = {"contents": turns}
    if system:
        body["systemInstruction"] = {"parts": [{"text": system}]}
    if settings := _settings(options, model="", max_tokens="maxOutputTokens"):
        body["generationConfig"] = settings
    return body


@dataclass(frozen=True)
class Service:
    """How a service is spoken to. URL templates know base, key, model and deployment."""

    base: str
    ask: str
    body: Callable[[Sequence[Message], Options], dict]
    answer: tuple[str | int, ...]
    headers: Mapping[str, str] = field(default_factory=dict)
    listing: str | None = "{base}/models"
    names: tuple[str, str] = ("data", "id")


_CHAT = ("choices", 0, "message", "content")
_BEARER = {"Authorization": "Bearer {key}"}
# The services' public addresses, paths and headers.
SERVICES = {
    "openai": Service("https://api.openai.com/v1", "{base}/chat/completions", _chat, _CHAT, _BEARER),
    "azure-openai": Service("", "{base}/openai/deployments/{deployment}/chat/completions?api-version=2024-06-01", _deployed, _CHAT, {"api-key": "{key}"}, None),
    "ollama": Service("http://localhost:11434/v1", "{base}/chat/completions", _chat, _CHAT, _BEARER),
    "lmstudio": Service("http://localhost:1234/v1", "{base}/chat/completions", _chat, _CHAT),
    "openai-compatible": Service("", "{base}/chat/completions", _chat, _CHAT, _BEARER),
    "anthropic": Service("https://api.anthropic.com/v1", "{base}/messages", _claude, ("content", 0, "text"), {"x-api-key": "{key}", "anthropic-version": "2023-06-01"}),
    "gemini": Service(
        "https://generativelanguage.googleapis.com/v1beta", "{base}/models/{model}:generateContent?key={key}", _parts, ("candidates", 0, "content", "parts", 0, "text"), {}, "{base}/models?key={key}", ("models", "name")
    ),
}


@dataclass(frozen=True)
class Http:
    """A provider for one of SERVICES. Headers that need a key are left out without one."""

    service: Service
    base: str = ""
    key: str = ""
    deployment: str = ""
    model: str = ""
    retries: int = 3
    wait: float = 1.0

    def _filled(self, template: str, model: str = "") -> str:
        return template.format(base=(self.base or self.service.base).rstrip("/"), key=self.key, deployment=self.deployment, model=model)

    def _headers(self) -> dict[str, str]:
        return {k: self._filled(v) for k, v in self.service.headers.items() if self.key or "{key}" not in v}

    def complete(self, messages: Sequence[Message], options: Options) -> str:
        options = Options(options.model or self.model or None, options.temperature, options.max_tokens)
        url = self._filled(self.service.ask, options.model or "")
        return _at(send(url, self._headers(), self.service.body(messages, options), self.retries, self.wait), *self.service.answer)

    def models(self) -> list[str]:
        if not self.service.listing:
            return []
        held, name = self.service.names
        answer = send(self._filled(self.service.listing), self._headers(), None, self.retries, self.wait)
        return sorted((str(x[name]).removeprefix("models/") for x in answer.get(held, [])), key=str.lower)


def _maker(name: str) -> Callable[..., Http]:
    return lambda **settings: Http(SERVICES[name], **settings)


PROVIDERS = {name: _maker(name) for name in SERVICES}
